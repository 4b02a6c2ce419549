"""What the operators of this package share: written tables, connected components, splitting of blocks."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowfacts.operators.tables import discard  # noqa: F401
from flowfacts.operators.tables import written as materialize

#: A side of a join is broadcast only if it was counted and has at most this many (narrow) rows.
BROADCAST_ROWS = 2_000_000


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """While it holds, Arrow batches have at most so many rows: texts of a batch are held on both sides of the pipe to Python."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def release() -> None:
    """Give freed memory back to the system: Python workers are used again, and would keep their highest mark for good."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run for mapInArrow, with a release() after each partition."""
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    return wrapped


def small_join(left: DataFrame, right: DataFrame, on: str | list[str], how: str, rows: int) -> DataFrame:
    """Join; right is broadcast only if its counted rows are within the bound, else both sides are shuffled."""
    return left.join(F.broadcast(right) if rows <= BROADCAST_ROWS else right, on, how)


def free_name(df: DataFrame, wish: str) -> str:
    """A column name like wish that df does not have, whatever the case of its names."""
    taken = {c.lower() for c in df.columns}
    name, k = f"__{wish}", 1
    while name.lower() in taken:
        k += 1
        name = f"__{wish}_{k}"
    return name


#: Keys with at least one in so many rows of a join's large side are hot; there can be no more of them than this.
HOT = 4096
#: Parts that the rows of a hot key are dealt into.
SALTS = 32
#: Keys up to which the keyed side of a join is broadcast.
FEW_KEYS = 100_000
#: Rows from which a key can be hot.
LEAST_HOT = 1000


def keyed_join(left: DataFrame, right: DataFrame, key: str, how: str = "left") -> DataFrame:
    """Join (left or inner) with a written table that has each key once and, in ``n``, its number of rows in left. If right has
    few rows, it is broadcast. If not, both sides are dealt by key, and the rows of the keys that hold one in HOT of all counted
    rows (at most HOT keys, which are broadcast to tell) by a salt as well. n is left out of the result."""
    size = right.agg(F.count("*"), F.sum("n")).first()
    if size[0] <= FEW_KEYS:
        return left.join(F.broadcast(right.drop("n")), key, how)
    bound = max(LEAST_HOT, size[1] // HOT)
    hot = right.where(F.col("n") >= bound)
    if hot.isEmpty():
        return left.join(right.drop("n").hint("shuffle_hash"), key, how)
    salt, mark = free_name(left, "salt"), free_name(left, "hot")
    dealt = left.join(F.broadcast(hot.select(key, F.lit(True).alias(mark))), key, "left")
    dealt = dealt.withColumn(salt, F.when(F.col(mark), F.pmod(F.xxhash64(*left.columns), F.lit(SALTS))).otherwise(F.lit(0).cast("long"))).drop(mark)
    copies = F.when(F.col("n") >= bound, F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    return dealt.join(right.withColumn(salt, F.explode(copies)).drop("n").hint("shuffle_hash"), [key, salt], how).drop(salt)


def connected_components(edges: DataFrame) -> DataFrame:
    """Components of an undirected graph (columns u, v: long): one row (id, component_id) per vertex that
    has an edge; component_id is the smallest vertex of the component. Null ends and self-loops are ignored.

    Alternates large-star and small-star steps (both are aggregations and joins keyed by vertex), each round
    written to the shared folder, until nothing changes. Rounds grow with the logarithm of the longest path. A vertex
    with very many edges is joined by broadcast.
    """
    edges = edges.where("u IS NOT NULL AND v IS NOT NULL AND u <> v").select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = materialize(edges, "edges")
    mark = edges.agg(F.count("*"), F.sum(F.expr("cast(xxhash64(u, v) as decimal(38,0))"))).first()
    while mark[0]:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n")), "least")
        large = materialize(keyed_join(both.where("v > u"), least, "u", "inner").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "large")
        discard(least)
        least = materialize(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "least")
        small = keyed_join(large, least, "u", "inner")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(small.select("u", F.col("m").alias("v")))
        after = materialize(small.where("u <> v").distinct(), "edges")
        new = after.agg(F.count("*"), F.sum(F.expr("cast(xxhash64(u, v) as decimal(38,0))"))).first()
        for used in (edges, large, least):
            discard(used)
        edges = after
        if new == mark:
            break
        mark = new
    out = edges.select(F.col("u").alias("id"), F.col("v").alias("component_id")).unionAll(
        edges.select(F.col("v").alias("id"), F.col("v").alias("component_id")).distinct())
    out._flowfacts_path = edges._flowfacts_path
    return out


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest member of each vertex's component, for edges a-b over 0..n-1, by array operations only."""
    label = np.arange(n)
    while len(a):
        before = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while True:
            jumped = label[label]
            if (jumped == label).all():
                break
            label = jumped
        if (label == before).all():
            break
        keep = label[a] != label[b]
        a, b = a[keep], b[keep]
    return label
