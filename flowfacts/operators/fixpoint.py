"""Least fixpoints of monotone rules over relations, semi-naive."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import SENT_ROWS, dealt, discard, joined, written


#: Rounds after which a fixpoint's tables are folded into one.
FOLD = 8


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionAll, parts)


def least_fixpoint(seed: DataFrame, step: Callable[[DataFrame], DataFrame], name: str = "facts", rounds: int = 10_000) -> DataFrame:
    """All rows derivable from seed: each round applies step to the rows that are new, until none is.

    Rows are facts, so lattices of sets and bits are kept as one row per element or bit, and joins are unions. The rows of
    a round are written once; the known rows are the union of the rounds' tables, which are folded into one every FOLD
    rounds, so that a long run neither reads very many tables nor keeps old ones.
    """
    columns = seed.columns
    parts = [written(seed.distinct(), name)]
    new = parts[0]
    known = new.count()
    for _ in range(rounds):
        new = written(joined(dealt(step(new).select(*columns), known, *columns, narrow=True).distinct(), _union(parts), known, columns, "left_anti", narrow=True), name)
        count = new.count()
        known += count
        if not count:
            discard(new)
            return _union(parts)
        parts.append(new)
        if len(parts) > FOLD:
            whole = written(_union(parts), name)
            # new stays: the next round reads it
            discard(*parts[:-1])
            parts = [whole]
    raise RuntimeError(f"{name}: no fixpoint after {rounds} rounds")


def reach(starts: DataFrame, edges: DataFrame, keys: list[str], node: str = "node") -> DataFrame:
    """Nodes reachable from starts (keys + node) along edges (keys + src, dst), starts included."""
    edges = written(edges.select(*keys, "src", "dst").distinct(), "edges")

    def step(new: DataFrame) -> DataFrame:
        return new.withColumnRenamed(node, "src").join(edges, [*keys, "src"]).withColumnRenamed("dst", node)

    return least_fixpoint(starts.select(*keys, node), step, "reach")


#: Rows of a closure that one task joins or tells apart, about.
ROWS = 500_000


def _dealt(rows: DataFrame, count: int, *by: str) -> DataFrame:
    """rows dealt over tasks by their count: pairs of numbers are packed so well that adaptive execution, which goes by bytes,
    would give one task very many."""
    return rows.repartition(max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-count // ROWS)), *by)


def closure(edges: DataFrame) -> DataFrame:
    """Transitive closure (src, dst) of a graph by path doubling: rounds grow with the logarithm of the longest shortest path.

    A path longer than n and up to 2n steps is one of exactly n steps and a known one behind it. So a round joins the paths of
    exactly n steps with all known ones, which gives a pair about once for each shortest way, and writes its new paths only.
    """
    parts = [written(edges.select("src", "dst").distinct().withColumn("steps", F.lit(1)), "paths")]
    count, reached = parts[0].count(), 1
    while True:
        paths = _union(parts)
        exact = parts[-1].where(F.col("steps") == reached).select(F.col("src").alias("first"), F.col("dst").alias("src"))
        number = exact.count()
        if not number:
            return paths.select("src", "dst")
        longer = _dealt(exact, count, "src").join(_dealt(paths, count, "src").hint("merge"), "src").select(F.col("first").alias("src"), "dst", (F.col("steps") + reached).alias("steps"))
        known = _dealt(paths.select("src", "dst"), 2 * count, "src", "dst").hint("merge")
        new = _dealt(longer, 2 * count, "src", "dst").groupBy("src", "dst").agg(F.min("steps").alias("steps")).join(known, ["src", "dst"], "left_anti")
        parts.append(written(new, "paths"))
        count += parts[-1].count()
        reached *= 2


def met(edges: DataFrame, new: DataFrame, count: int, size: int, waiting: DataFrame | None, parts: list[Column], carried: list[str] = []) -> DataFrame:
    """(above, carried, needed, met, sums of parts) of what waits in a wave, a written table: edges (above, below, needed: the edges
    of above, carried: other columns of above; size rows) to the nodes of the wave before (below, others that parts read; count
    rows), joined with what was met in earlier waves (the same columns)."""
    pushed = edges.join(F.broadcast(new), "below") if count <= SENT_ROWS else joined(edges, new, size, ["below"], narrow=True)
    by = ["above", *carried]
    found = pushed.select(*by, "needed", F.lit(1).cast("long").alias("met"), *parts)
    others = found.columns[len(by) + 1:]
    found = found if waiting is None else found.unionByName(waiting)
    return written(found.groupBy(*by).agg(F.max("needed").alias("needed"), *[F.sum(c).alias(c) for c in others]), "waves")


def needing(edges: DataFrame, size: int) -> DataFrame:
    """Edges (above, below) with the number of above's edges, a written table."""
    return written(joined(edges, edges.groupBy("above").agg(F.count("*").alias("needed")), size, ["above"], narrow=True), "waves")


def longest_levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, level) of an acyclic graph: 0 without outgoing edges (src depends on dst), else 1 + the highest level below.

    Nodes leave in waves: a node whose dependencies all have left gets the next level. A wave takes the edges to the nodes that
    left in the wave before, each edge in one wave only; only nodes that wait for others as well are written again.
    """
    nodes = written(nodes.select("node").distinct(), "waves")
    edges = written(edges.select(F.col("src").alias("above"), F.col("dst").alias("below")).distinct(), "waves")
    total, size = nodes.count(), edges.count()
    own = needing(joined(edges, nodes.withColumnRenamed("node", "above"), max(total, size), ["above"], "left_semi", narrow=True), size)
    discard(edges)
    first = joined(nodes, own.select(F.col("above").alias("node")), max(total, size), ["node"], "left_anti", narrow=True)
    levels, waiting, level = [written(first.withColumn("level", F.lit(0).cast("long")), "waves")], None, 0
    count = found = levels[0].count()
    while found < total:
        if not count:
            raise ValueError("the graph has a cycle")
        level += 1
        state = met(own, levels[-1].select(F.col("node").alias("below")), count, size, waiting, [])
        discard(*[waiting] if waiting is not None else [])
        levels.append(written(state.where("met = needed").select(F.col("above").alias("node"), F.lit(level).cast("long").alias("level")), "waves"))
        count = levels[-1].count()
        found += count
        waiting = state.where("met < needed")
        waiting._flowfacts_path = state._flowfacts_path
    return _union(levels)
