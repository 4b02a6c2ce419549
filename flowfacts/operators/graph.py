"""Graph operators: components and schedules of module graphs, and analyses of control-flow graphs.

Module graphs are one large relation and are solved as fixpoints. Control-flow graphs are very many small ones: a function's
blocks are bounded by its source text, so a grouped Arrow function solves each in one pass after a single shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fixpoint import least_fixpoint, longest_levels
from .tables import discard, joined, written

EXIT = -1


def strong_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component): component is the smallest node that reaches and is reached.

    Nodes without edges on one side are components of their own and are taken away, as long as there are any. Of the rest
    every node takes the smallest node that reaches it as its colour; what reaches a colour's own node inside the colour is
    that node's component. No closure is made: a round reads the edges that are left and writes a row a node.
    """
    edges = written(edges.where("src <> dst").select("src", "dst").distinct(), "edges")
    found = []
    left = edges.count()
    while left:
        trimmed = left + 1
        while left and left < trimmed:
            trimmed = left
            kept = written(joined(joined(edges, edges.select(F.col("dst").alias("src")), left, ["src"], "left_semi", narrow=True), edges.select(F.col("src").alias("dst")), left, ["dst"], "left_semi", narrow=True).select("src", "dst"), "edges")
            discard(edges)
            edges, left = kept, kept.count()
        if not left:
            break
        colours = written(edges.select(F.col("src").alias("node")).unionAll(edges.select(F.col("dst").alias("node"))).distinct().withColumn("colour", F.col("node")), "colours")
        while True:
            better = joined(edges, colours.withColumnRenamed("node", "src"), left, ["src"], narrow=True).groupBy(F.col("dst").alias("node")).agg(F.min("colour").alias("new"))
            moved = written(joined(colours, better, left, ["node"], "left", narrow=True).select("node", F.least("colour", F.coalesce("new", "colour")).alias("colour"), (F.col("new") < F.col("colour")).alias("moved")), "colours")
            changed = not moved.where("moved").isEmpty()
            discard(colours)
            colours = moved.select("node", "colour")
            colours._flowfacts_path = moved._flowfacts_path
            if not changed:
                break
        inside = written(joined(joined(edges, colours.toDF("src", "a"), left, ["src"], narrow=True), colours.toDF("dst", "b"), left, ["dst"], narrow=True).where("a = b").select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("a").alias("colour")), "inside")
        whole = written(least_fixpoint(colours.where("node = colour").select("colour", F.col("node")), lambda new: joined(inside, new.withColumnRenamed("node", "src"), left, ["colour", "src"], narrow=True).withColumnRenamed("dst", "node"), "component").select("node", F.col("colour").alias("component")), "component")
        found.append(whole)
        rest = written(joined(joined(edges, whole.select(F.col("node").alias("src")), left, ["src"], "left_anti", narrow=True), whole.select(F.col("node").alias("dst")), left, ["dst"], "left_anti", narrow=True).select("src", "dst"), "edges")
        discard(edges, colours, inside)
        edges, left = rest, rest.count()
    mutual = reduce(DataFrame.unionAll, found) if found else nodes.select("node", F.col("node").alias("component")).where("false")
    return joined(nodes.select("node"), mutual, nodes.count(), ["node"], "left", narrow=True).select("node", F.coalesce("component", "node").alias("component"))


def schedule(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component, level): what a node depends on lies in its component or on a lower level."""
    parts = written(strong_components(nodes, edges), "parts")
    size = parts.count()
    crossing = (
        joined(joined(edges, parts.select(F.col("node").alias("src"), F.col("component").alias("a")), size, ["src"], narrow=True), parts.select(F.col("node").alias("dst"), F.col("component").alias("b")), size, ["dst"], narrow=True)
        .where("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst")))
    levels = longest_levels(parts.select(F.col("component").alias("node")), crossing)
    return joined(parts, levels.withColumnRenamed("node", "component"), size, ["component"], narrow=True)


def reachable(succ: dict[int, list[int]], start: int, avoiding: int | None = None) -> set[int]:
    """Blocks reached from start without entering `avoiding`."""
    if start == avoiding:
        return set()
    seen, stack = {start}, [start]
    while stack:
        for b in succ.get(stack.pop(), ()):
            if b not in seen and b != avoiding:
                seen.add(b)
                stack.append(b)
    return seen


def immediate_dominators(succ: dict[int, list[int]], start: int) -> dict[int, int]:
    """Immediate dominator of each reachable block but the start, over bit sets in order of discovery."""
    order, seen, stack = [], {start}, [(start, iter(succ.get(start, ())))]
    while stack:
        block, rest = stack[-1]
        for b in rest:
            if b not in seen:
                seen.add(b)
                stack.append((b, iter(succ.get(b, ()))))
                break
        else:
            order.append(block)
            stack.pop()
    order.reverse()
    number = {b: i for i, b in enumerate(order)}
    pred: dict[int, list[int]] = {b: [] for b in order}
    for b in order:
        for t in succ.get(b, ()):
            pred[t].append(b)
    full = (1 << len(order)) - 1
    dom = [full] * len(order)
    dom[0] = 1
    changed = True
    while changed:
        changed = False
        for i, b in enumerate(order[1:], 1):
            got = full
            for p in pred[b]:
                got &= dom[number[p]]
            got |= 1 << i
            if got != dom[i]:
                dom[i], changed = got, True
    # dominators of a block form a chain; the nearest is the one dominated by most
    return {b: max((order[j] for j in range(len(order)) if j != i and dom[i] >> j & 1), key=lambda d: dom[number[d]].bit_count()) for i, b in enumerate(order) if i}


def _graph(table: pa.Table) -> dict[int, list[int]]:
    succ: dict[int, list[int]] = {}
    for a, b in sorted(set(zip(table["src"].to_pylist(), table["dst"].to_pylist()))):
        if a is not None and b is not None:
            succ.setdefault(a, []).append(b)
    return succ


def per_function(facts: DataFrame, solve: Callable[[pa.Table], dict[str, list]], schema: str, key: str = "function") -> DataFrame:
    """solve once for the facts of each function; its columns are returned beside the function. Rows are dealt and sorted by
    function and read as a stream, so that very many small functions cost little more than their rows."""
    names = [part.split()[0] for part in schema.split(",")]
    at = facts.columns.index(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now = kind = None
        owner: list = []
        out: dict[str, list] = {c: [] for c in names}

        def close() -> None:
            got = solve(pa.Table.from_batches(held))
            owner.extend([now] * len(got[names[0]]))
            for c in names:
                out[c].extend(got[c])
            held.clear()

        def flush() -> pa.RecordBatch:
            fields = _schema(kind, schema)
            made = pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip((owner, *(out[c] for c in names)), fields)], schema=fields)
            for v in (owner, *out.values()):
                v.clear()
            return made

        for batch in batches:
            kind = batch.schema.field(at)
            keys = batch.column(at).to_pylist()
            starts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1])] if keys else []
            for start, stop in zip(starts, [*starts[1:], len(keys)]):
                if held and keys[start] != now:
                    close()
                now = keys[start]
                held.append(batch.slice(start, stop - start))
            if len(owner) >= 10_000:
                yield flush()
        if held:
            close()
        if owner:
            yield flush()

    kind = dict(facts.dtypes)[key]
    dealt = facts.repartition(key).sortWithinPartitions(key)
    return dealt.mapInArrow(run, f"{key} {kind}, {schema}")


def _schema(key: pa.Field, schema: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
    return pa.schema([pa.field(key.name, key.type)] + [pa.field(p.split()[0], kinds[p.split()[1]]) for p in schema.split(",")])


def cfg_reachable(edges: DataFrame, entry: int = 0, avoiding: int | None = None) -> DataFrame:
    """(function, block) reached from the entry block; edges: function, src, dst (dst null: no successor)."""
    return per_function(edges, lambda t: {"block": sorted(reachable(_graph(t), entry, avoiding))}, "block long")


def dominators(edges: DataFrame, entry: int = 0) -> DataFrame:
    """(function, block, idom) of each reachable block but the entry."""

    def solve(t: pa.Table) -> dict[str, list]:
        got = sorted(immediate_dominators(_graph(t), entry).items())
        return {"block": [b for b, _ in got], "idom": [d for _, d in got]}

    return per_function(edges, solve, "block long, idom long")


def post_dominators(edges: DataFrame) -> DataFrame:
    """(function, block, ipdom): dominators of the reversed graph from a virtual exit (-1) behind all blocks without successor."""

    def solve(t: pa.Table) -> dict[str, list]:
        succ = _graph(t)
        blocks = {b for b in t["src"].to_pylist() if b is not None} | {b for s in succ.values() for b in s}
        back: dict[int, list[int]] = {EXIT: sorted(b for b in blocks if not succ.get(b))}
        for a, targets in succ.items():
            for b in targets:
                back.setdefault(b, []).append(a)
        got = sorted(immediate_dominators(back, EXIT).items())
        return {"block": [b for b, _ in got], "ipdom": [d for _, d in got]}

    return per_function(edges, solve, "block long, ipdom long")


def dominance_frontier(edges: DataFrame, entry: int = 0) -> DataFrame:
    """(function, block, frontier): blocks where the block's dominance ends: it dominates a predecessor but not strictly the block."""

    def solve(t: pa.Table) -> dict[str, list]:
        succ = _graph(t)
        idom = immediate_dominators(succ, entry)
        found = set()
        for a in {entry, *idom}:
            for b in succ.get(a, ()):
                runner = a
                while runner is not None and runner != idom.get(b):
                    found.add((runner, b))
                    runner = idom.get(runner)
        rows = sorted(found)
        return {"block": [a for a, _ in rows], "frontier": [b for _, b in rows]}

    return per_function(edges, solve, "block long, frontier long")


def _flow(t: pa.Table) -> tuple[dict[int, list[int]], dict[int, list[int]], dict[int, set], dict[int, set]]:
    succ = _graph(t)
    pred: dict[int, list[int]] = {}
    for a, targets in succ.items():
        for b in targets:
            pred.setdefault(b, []).append(a)
    uses: dict[int, set] = {}
    defs: dict[int, set] = {}
    for a, u, d in zip(t["src"].to_pylist(), t["use"].to_pylist(), t["def"].to_pylist()):
        if u is not None:
            uses.setdefault(a, set()).add(u)
        if d is not None:
            defs.setdefault(a, set()).add(d)
    return succ, pred, uses, defs


def liveness(facts: DataFrame) -> DataFrame:
    """(function, block, name) live at the block's start; facts: function, src, dst, use, def (uses come before definitions)."""

    def solve(t: pa.Table) -> dict[str, list]:
        _, pred, uses, defs = _flow(t)
        live = {(b, v) for b, vs in uses.items() for v in vs}
        stack = list(live)
        while stack:
            b, v = stack.pop()
            for p in pred.get(b, ()):
                if v not in defs.get(p, ()) and (p, v) not in live:
                    live.add((p, v))
                    stack.append((p, v))
        rows = sorted(live)
        return {"block": [b for b, _ in rows], "name": [v for _, v in rows]}

    return per_function(facts, solve, "block long, name string")


def reaching_definitions(facts: DataFrame) -> DataFrame:
    """(function, block, definition): blocks whose definition may still hold at the block's start."""

    def solve(t: pa.Table) -> dict[str, list]:
        succ, _, _, defs = _flow(t)
        found = set()
        stack = [(b, a, v) for a, vs in defs.items() for v in vs for b in succ.get(a, ())]
        while stack:
            b, a, v = stack.pop()
            if (b, a, v) not in found:
                found.add((b, a, v))
                if v not in defs.get(b, ()):
                    stack += [(c, a, v) for c in succ.get(b, ())]
        rows = sorted({(b, a) for b, a, _ in found})
        return {"block": [b for b, _ in rows], "definition": [a for _, a in rows]}

    return per_function(facts, solve, "block long, definition long")
