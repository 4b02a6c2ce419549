"""Baselines: accepted findings as a multiset of fingerprints that survive moved lines, written as JSON rows."""

from __future__ import annotations

import hashlib
import hmac
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FINGERPRINT = ["path", "rule", "function", "digest", "pointer"]
SCHEMA = "path string, rule string, function string, digest string, pointer string, count long"


def text_digest(text: Column) -> Column:
    """'sha256:' and 16 hex digits."""
    return F.concat(F.lit("sha256:"), F.substring(F.sha2(text, 256), 1, 16))


def pointer_part(name: Column) -> Column:
    """A member's name as a part of a JSON pointer (RFC 6901)."""
    return F.replace(F.replace(name, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))


def keyed(rows: DataFrame, columns: list[str], key: bytes) -> DataFrame:
    """rows with the columns replaced by the first 32 hex digits of their HMAC-SHA256 under key; nulls stay."""
    at = [rows.columns.index(c) for c in columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = list(batch.columns)
            for i in at:
                made[i] = pa.array([None if v is None else hmac.new(key, v.encode(), hashlib.sha256).hexdigest()[:32] for v in made[i].to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays(made, names=batch.schema.names)

    return rows.mapInArrow(run, rows.schema)


def fingerprints(findings: DataFrame, files: DataFrame, key: bytes | None = None) -> DataFrame:
    """findings (path, rule, function, line, end_line, pointer, value and others) with digest: of the lines from line to end_line
    (null: line alone), each without white space around it, or of the value for a finding without a line. Under a key,
    digests and pointers are keyed, as a pointer may itself tell a secret."""
    lines = F.split("text", r"\r\n|\r|\n")
    joined = findings.drop("digest").join(files.select("path", "text"), "path", "left")
    span = F.array_join(F.transform(F.slice(lines, F.col("line").cast("int"), (F.coalesce("end_line", "line") - F.col("line") + 1).cast("int")), lambda x: F.trim(x)), "\n")
    text = F.when(F.col("line").isNotNull(), F.coalesce(span, F.lit(""))).otherwise(F.col("value"))
    out = joined.withColumn("digest", text if key else text_digest(text)).drop("text")
    if key:
        return keyed(out, ["digest", "pointer"], key)
    return out.withColumn("pointer", F.when(F.col("pointer").isNotNull(), text_digest(F.col("pointer"))))


def save(fingerprinted: DataFrame, folder: str) -> None:
    """Write the multiset of fingerprints, replacing what was there once the new rows are written."""
    counted = fingerprinted.groupBy(*FINGERPRINT).agg(F.count("*").alias("count"))
    counted.write.mode("overwrite").json(folder)


def load(spark: SparkSession, folder: str) -> DataFrame:
    """One row per accepted finding: each fingerprint as often as it was counted."""
    rows = spark.read.schema(SCHEMA).json(folder)
    return rows.withColumn("_n", F.explode(F.sequence(F.lit(1).cast("long"), "count"))).select(*FINGERPRINT)
