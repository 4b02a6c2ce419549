"""Class hierarchies: linearised ancestors, and the first ancestor that has a member."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import discard, written


def merged(lists: list[list[str]]) -> list[str] | None:
    """One order that keeps the order of each list, by the C3 rule: take the first head that is in no other list's tail. None if
    there is none."""
    rest, out = [list(reversed(x)) for x in lists if x], []
    while rest:
        tails: set[str] = set().union(*(x[:-1] for x in rest))
        head = next((x[-1] for x in rest if x[-1] not in tails), None)
        if head is None:
            return None
        out.append(head)
        rest = [y for y in (x[:-1] if x[-1] == head else x for x in rest) if y]
    return out


def ancestors(classes: DataFrame, bases: DataFrame) -> DataFrame:
    """(class, place, ancestor, own): the ancestors of each class in the order in which members are looked up, itself at place 0.

    classes: class (repeated rows count once); bases: class, position, base. A base that is no class of the table is from
    outside: it is an ancestor without ancestors of its own, and ``own`` is false. Classes whose bases have no common order, that
    inherit from themselves, or from such a class, have no rows but their own at place 0.

    Classes are taken in waves: those all of whose bases are done. A wave joins its bases with their lists, and merges the few
    lists of each class in a worker; waves grow with the depth of the hierarchy, lists with a class's ancestors.
    """
    classes = written(classes.select("class").distinct(), "classes")
    bases = bases.groupBy("class", "position").agg(F.min("base").alias("base"))
    bases = written(bases.join(classes, "class", "left_semi").join(classes.select(F.col("class").alias("base"), F.lit(True).alias("own")), "base", "left").select("class", "position", "base", F.coalesce("own", F.lit(False)).alias("own")), "bases")
    done = [written(classes.join(bases, "class", "left_anti").select("class", F.array("class").alias("line")), "lines")]
    waiting = written(bases.select("class").distinct(), "waiting")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, lines = [], []
            for name, lists in zip(*(c.to_pylist() for c in batch.columns)):
                order = merged([*[x["line"] for x in sorted(lists, key=lambda x: x["position"])], [x["base"] for x in sorted(lists, key=lambda x: x["position"])]])
                names.append(name)
                lines.append(None if order is None or name in order else [name, *order])
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(lines, pa.list_(pa.string()))], names=["class", "line"])

    while not waiting.isEmpty():
        lines = reduce(DataFrame.unionByName, done)
        with_lines = bases.join(waiting, "class", "left_semi").join(lines.select(F.col("class").alias("base"), "line", F.lit(True).alias("there")), "base", "left")
        ready = with_lines.groupBy("class").agg(
            F.bool_and(~F.col("own") | F.coalesce("there", F.lit(False))).alias("ready"), F.bool_or(F.col("own") & F.col("line").isNull()).alias("broken"),
            F.collect_list(F.struct("position", "base", F.coalesce("line", F.array("base")).alias("line"))).alias("lists")).where("ready")
        made = ready.where("NOT broken").select("class", "lists").mapInArrow(merge, "class string, line array<string>")
        made = written(made.unionByName(ready.where("broken").select("class", F.lit(None).cast("array<string>").alias("line"))), "lines")
        if made.isEmpty():  # the rest inherit from themselves
            discard(made)
            break
        done.append(made)
        left = written(waiting.join(made, "class", "left_anti"), "waiting")
        discard(waiting)
        waiting = left
    whole = reduce(DataFrame.unionByName, done)
    alone = classes.join(whole.where("line IS NOT NULL"), "class", "left_anti").select("class", F.array("class").alias("line"))
    rows = whole.where("line IS NOT NULL").unionByName(alone).select("class", F.posexplode("line").alias("place", "ancestor"))
    return rows.join(classes.select(F.col("class").alias("ancestor"), F.lit(True).alias("own")), "ancestor", "left").select("class", "place", "ancestor", F.coalesce("own", F.lit(False)).alias("own"))


def members(wanted: DataFrame, lines: DataFrame, held: DataFrame) -> DataFrame:
    """wanted (class, member and others) with ``owner``: the first ancestor (of ``ancestors``) that holds the member, by held
    (owner, member); null if none does. ``outside``: the first ancestor from outside that comes before it, null if none; it
    may hold the member as well."""
    asked = wanted.select("class", "member").distinct().join(lines, "class")
    found = asked.join(held.select(F.col("owner").alias("ancestor"), "member", F.lit(True).alias("has")).distinct(), ["ancestor", "member"], "left")
    first = found.groupBy("class", "member").agg(F.min_by("ancestor", F.when(F.col("has"), F.col("place"))).alias("owner"), F.min(F.when(F.col("has"), F.col("place"))).alias("_at"),
                                                F.min_by("ancestor", F.when(~F.col("own"), F.col("place"))).alias("outside"), F.min(F.when(~F.col("own"), F.col("place"))).alias("_out"))
    # min_by of rows whose order is null gives none of them only if all are null
    first = first.select("class", "member", F.when(F.col("_at").isNotNull(), F.col("owner")).alias("owner"), F.when(F.col("_out").isNotNull() & (F.col("_at").isNull() | (F.col("_out") < F.col("_at"))), F.col("outside")).alias("outside"))
    return wanted.join(first, ["class", "member"], "left")
