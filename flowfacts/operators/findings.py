"""Findings as a relation: detection of assigned secrets, suppression, baselines, policies, order and coverage."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .tables import written

#: Bits of Shannon entropy per character from which a quoted value of any name is reported.
ENTROPY_FLOOR = 3.0
ASSIGNMENT = r'([A-Za-z_]+) = "([^"\n]+)"'
CREDENTIAL_NAME = r"(?i)(token|secret|passw|api_?key|credential)"
SEVERITY_RANK = {"critical": 4, "high": 3, "medium": 2, "low": 1, "info": 0}


def entropy(text: Column) -> Column:
    """Shannon entropy in bits per character, rounded to 6 places; null for null, 0 for empty text. The characters are sorted,
    and the lengths of equal runs are summed in one pass: the entropy of n characters is log2(n) - sum(c * log2(c)) / n."""
    def step(acc: Column, c: Column) -> Column:
        again = acc["c"] == c
        run = F.when(again, acc["run"] + 1.0).otherwise(F.lit(1.0))
        return F.struct(c.alias("c"), run.alias("run"), (acc["sum"] + F.when(again, F.lit(0.0)).otherwise(acc["run"] * F.log2(acc["run"]))).alias("sum"))

    chars = F.array_sort(F.filter(F.split(text, ""), lambda c: c != ""))
    start = F.struct(F.lit("").alias("c"), F.lit(1.0).alias("run"), F.lit(0.0).alias("sum"))
    total = F.aggregate(chars, start, step, lambda acc: acc["sum"] + acc["run"] * F.log2(acc["run"]))
    n = F.length(text).cast("double")
    return F.when(text.isNull(), F.lit(None)).when(n == 0, 0.0).otherwise(F.round(F.log2(n) - total / n, 6) + 0.0)


def assigned_secrets(texts: DataFrame, key: str, text: str, names: str = CREDENTIAL_NAME, floor: float = ENTROPY_FLOOR, least: int = 1) -> DataFrame:
    """One finding per assignment of a quoted value in text: key, ordinal (from 1), name, digest, entropy, rule, severity,
    confidence. names: pattern of credential names; floor: entropy of a strong value; least: length of the shortest value. The
    value itself is not kept. Null and empty texts have none."""
    texts = texts.where(F.contains(F.col(text), F.lit(' = "')))  # every hit holds it, and most texts don't
    hits = texts.select(key, F.posexplode(F.regexp_extract_all(F.col(text), F.lit(ASSIGNMENT), F.lit(0))).alias("pos", "hit"))
    parts = hits.select(key, (F.col("pos") + 1).cast("long").alias("ordinal"), F.substring_index("hit", " = ", 1).alias("name"), F.substring_index("hit", '"', -2).alias("value"))
    parts = parts.withColumn("value", F.substring("value", F.lit(1), F.length("value") - 1))
    named = F.col("name").rlike(names)
    scored = parts.where(F.length("value") >= least).withColumn("entropy", entropy(F.col("value"))).where(named | (F.col("entropy") >= floor))
    strong = named & (F.col("entropy") >= floor)
    return scored.select(
        key, "ordinal", "name", F.sha2("value", 256).alias("digest"), "entropy",
        F.when(strong, "hardcoded-secret").when(named, "hardcoded-credential").otherwise("high-entropy-string").alias("rule"),
        F.when(named, "high").otherwise("low").alias("severity"), F.when(strong, "high").when(named, "medium").otherwise("low").alias("confidence"))


def suppression_split(findings: DataFrame, markers: DataFrame, at: list[str], rule: str = "rule") -> DataFrame:
    """findings with a boolean `suppressed`: a marker (at + rules array, null for all rules) lies at the same place."""
    marks = markers.groupBy(*at).agg(F.max(F.col("rules").isNull()).alias("_all"), F.flatten(F.collect_set("rules")).alias("_rules"))
    hit = F.coalesce(F.col("_all"), F.lit(False)) | F.coalesce(F.array_contains("_rules", F.col(rule)), F.lit(False))
    return findings.join(marks, at, "left").withColumn("suppressed", hit).drop("_all", "_rules")


def baseline_split(findings: DataFrame, baseline: DataFrame, fingerprint: list[str], order: list[str]) -> DataFrame:
    """findings with a boolean `known`: each of the baseline's copies of a fingerprint absorbs one equal finding, in order."""
    counts = baseline.groupBy(*fingerprint).agg(F.count("*").alias("_have"))
    keyed = findings.withColumn("_fp", F.to_json(F.struct(*fingerprint)))
    placed = numbered(keyed, "_fp", order, "_nth").drop("_fp")
    return placed.join(counts, fingerprint, "left").withColumn("known", F.col("_nth") <= F.coalesce("_have", F.lit(0))).drop("_nth", "_have")


def in_order(df: DataFrame, order: list, name: str = "position") -> DataFrame:
    """df with its 1-based place in the total order, without gathering rows in one task: rows are dealt by ranges, numbered
    within a range, and moved on by the rows of the ranges before (one row per range)."""
    dealt = written(written(df, "found").repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ordered")
    sizes = dealt.groupBy("_range").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).drop("_n")
    nth = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return dealt.withColumn("_nth", nth).join(F.broadcast(before), "_range").withColumn(name, F.col("_nth") + F.col("_before")).drop("_range", "_nth", "_before")


def coverage(files: DataFrame, by: list[str], status: str = "status") -> DataFrame:
    """Per group: files and files whose status is 'analysed'."""
    return files.groupBy(*by).agg(F.count("*").alias("files"), F.count_if(F.col(status) == "analysed").alias("files_analysed"))


def last_wins(rows: DataFrame, key: list[str], ordinal: list[str], first: str | None = None) -> DataFrame:
    """One row per key: the last by ordinal. first: a column to add with the ordinal (a struct) where the key first stood,
    which is the place it keeps in order. Keeps partial aggregation instead of a window sort."""
    rest = [c for c in rows.columns if c not in key]
    places = [F.min(F.struct(*ordinal)).alias("_first")] if first else []
    kept = rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*ordinal)).alias("_last"), *places)
    return kept.select(*key, *[F.col("_last")[c].alias(c) for c in rest], *([F.col("_first").alias(first)] if first else []))


def numbered(rows: DataFrame, key: str, order: list[str], name: str) -> DataFrame:
    """rows with their 1-based place among the rows of their key, in order (which tells rows apart). Keys may be of any size:
    rows are dealt by ranges of (key, order), numbered within a range, and moved on by the rows of their key in ranges before;
    only a key that crosses ranges has more than one count."""
    dealt = written(rows.repartitionByRange(key, *order).withColumn("_range", F.spark_partition_id()), "numbered")
    sizes = dealt.groupBy(key, "_range").agg(F.count("*").alias("_n"))
    crossing = sizes.withColumn("_before", F.sum("_n").over(Window.partitionBy(key).orderBy("_range")) - F.col("_n")).where("_before > 0").drop("_n")
    nth = F.row_number().over(Window.partitionBy("_range", key).orderBy(*order))
    joined = dealt.withColumn("_nth", nth).join(crossing.withColumnRenamed(key, "_key"), F.col(key).eqNullSafe(F.col("_key")) & (dealt["_range"] == crossing["_range"]), "left")
    return joined.select(*rows.columns, (F.col("_nth") + F.coalesce("_before", F.lit(0))).cast("long").alias(name))


def unique_names(rows: DataFrame, name: str, order: list[str]) -> DataFrame:
    """rows with `unique_name`: in order, the name itself or, if it is taken, the first free one of name__2, name__3, ...

    Names meet only others with the same stem (the name without such endings). Where all names of a stem are equal, the
    number is the place among them; the stems with several names are followed in order, one stem at a time.
    """
    stem = F.regexp_replace(name, r"(__[0-9]+)+$", "")
    mixed = rows.select(stem.alias("_stem"), name).groupBy("_stem").agg(F.min(name).alias("a"), F.max(name).alias("b")).where("a <> b").select("_stem")
    plain = numbered(rows.withColumn("_stem", stem).join(mixed, "_stem", "left_anti").drop("_stem"), name, order, "_nth")
    plain = plain.withColumn("unique_name", F.when(F.col("_nth") == 1, F.col(name)).otherwise(F.concat(F.col(name), F.lit("__"), F.col("_nth")))).drop("_nth")

    def follow(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in order])
        taken: dict[str, int] = {}
        out = []
        for base in table[name].to_pylist():
            unique, n = base, taken.get(base, 1)
            while unique in taken:
                n += 1
                unique = f"{base}__{n}"
            if base in taken:
                taken[base] = n
            taken.setdefault(unique, 1)
            out.append(unique)
        return table.drop_columns(["_stem"]).append_column("unique_name", pa.array(out, pa.string()))

    columns, schema = [*rows.columns, "unique_name"], StructType([*rows.schema.fields]).add("unique_name", "string")
    followed = rows.withColumn("_stem", stem).join(mixed, "_stem").groupBy("_stem").applyInArrow(lambda t: follow(t).select(columns), schema)
    return plain.unionByName(followed)
