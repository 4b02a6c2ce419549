"""Ordered sweeps within keys of any size: running sums and last values that are carried over the borders of ranges, and the
innermost of nested intervals around a point."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import written


def _dealt(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """rows by ranges of (keys, order), so that a key with very many rows lies in many ranges; written, with ``_range``."""
    return written(rows.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id()), "sweep")


def _same(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & left[k].eqNullSafe(right[f"_{k}"])
    return out


def swept(rows: DataFrame, keys: list[str], order: list[str], sums: dict[str, Column] | None = None, lasts: dict[str, Column] | None = None) -> DataFrame:
    """rows with running columns over the rows of their keys in order, their own row included: sums (name -> number) and lasts
    (name -> value: the latest that is not null). order must tell the rows of a key apart.

    Each range is swept by windows of its own; what a range hands on to the next ranges of its key (its sum, its last value) is
    one row per key and range, and only keys that cross ranges have such rows behind the first.
    """
    sums, lasts = sums or {}, lasts or {}
    values = rows.select("*", *[v.alias(f"_v_{n}") for n, v in {**sums, **lasts}.items()])
    dealt = _dealt(values, keys, order)
    ends = dealt.groupBy(*keys, "_range").agg(*[F.coalesce(F.sum(f"_v_{n}"), F.lit(0)).alias(f"_e_{n}") for n in sums], *[F.max_by(f"_v_{n}", F.when(F.col(f"_v_{n}").isNotNull(), F.struct(*order))).alias(f"_e_{n}") for n in lasts])
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_range").alias("__range"), F.count("*").over(before).alias("_many"), *[F.sum(f"_e_{n}").over(before).alias(f"_b_{n}") for n in sums],
                          *[F.last(f"_e_{n}", ignorenulls=True).over(before).alias(f"_b_{n}") for n in lasts]).where("_many > 0").drop("_many")
    here = Window.partitionBy("_range", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = dealt.select("*", *[F.coalesce(F.sum(f"_v_{n}").over(here), F.lit(0)).alias(f"_o_{n}") for n in sums], *[F.last(f"_v_{n}", ignorenulls=True).over(here).alias(f"_o_{n}") for n in lasts])
    both = own.join(carried, _same(own, carried, keys) & (F.col("_range") == F.col("__range")), "left")
    return both.select(*[own[c] for c in rows.columns], *[(F.col(f"_o_{n}") + F.coalesce(F.col(f"_b_{n}"), F.lit(0))).alias(n) for n in sums], *[F.coalesce(f"_o_{n}", f"_b_{n}").alias(n) for n in lasts])


def innermost(points: DataFrame, intervals: DataFrame, keys: list[str]) -> DataFrame:
    """points (keys, at, others) with ``inside``, the id of the innermost interval (keys, id, begin, end; ends included) of their
    keys around them, and ``depth``, how many are; null and 0 outside all. Intervals of a key are nested or apart; of two equal
    ones the greater id is the inner one. Points need not differ. An interval that ends before it begins holds nothing.

    Begins, points and ends of a key are swept once in order: a begin opens a level and an end closes it, so a running sum tells
    each row its depth, and the last begin at that depth is the interval that is open there. No pair of point and interval is
    made but those of the result.
    """
    intervals = intervals.where(F.col("begin") <= F.col("end"))
    rest = [c for c in points.columns if c not in keys]
    payload = F.struct(*rest)
    length = F.col("end") - F.col("begin")
    empty = F.lit(None).cast(points.select(payload.alias("p")).schema["p"].dataType)
    # at one place: begins (longer first), points, ends (shorter first)
    opened = intervals.select(*keys, F.col("begin").cast("double").alias("_at"), F.lit(0).alias("_kind"), (-length).cast("double").alias("_by"), F.col("id").alias("_id"), F.lit(0).cast("long").alias("_nth"), empty.alias("_point"))
    closed = intervals.select(*keys, F.col("end").cast("double").alias("_at"), F.lit(2).alias("_kind"), length.cast("double").alias("_by"), F.col("id").alias("_id"), F.lit(0).cast("long").alias("_nth"), empty.alias("_point"))
    marked = points.select(*keys, F.col("at").cast("double").alias("_at"), F.lit(1).alias("_kind"), F.lit(0.0).alias("_by"), F.lit(None).cast(intervals.schema["id"].dataType).alias("_id"), F.monotonically_increasing_id().alias("_nth"), payload.alias("_point"))
    events = written(opened.unionByName(closed).unionByName(marked), "events")
    change = F.when(F.col("_kind") == 0, 1).when(F.col("_kind") == 2, -1).otherwise(0)
    order = ["_at", "_kind", "_by", "_id", "_nth"]
    deep = swept(events, keys, order, sums={"depth": change}).where("_kind < 2")
    found = swept(deep, [*keys, "depth"], order, lasts={"inside": F.col("_id")}).where("_kind = 1")
    return found.select(*keys, *[F.col("_point")[c].alias(c) for c in rest], F.when(F.col("depth") > 0, F.col("inside")).alias("inside"), F.col("depth").cast("long").alias("depth"))
