"""Function summaries, and taint that returns to the call it came from.

A summary says which kinds of a parameter's value come back as the function's result. Summaries are tabulated over the whole
project, callee and caller alike, by a semi-naive fixpoint of two relations that feed one another: what a parameter reaches
inside its function, and which parameters come back. A call of a known function is then one step from argument to result.

Values travel along matched calls only: up from where they arise to the callers of the function, for as long as they have not
gone down; once down a call, they come back by that call's own step. Fields are shared by all callers, so a value that is read
from one begins anew.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowfacts.operators.tables import discard, written

from . import models
from .classes import shared_fields
from .tables import of
from .taint import key_of

#: Marks a place whose value came down by a call.
DOWN = "|down"


def _all() -> F.Column:
    return F.lit(models.ALL).cast("long")


def pieces(facts: DataFrame, calls: DataFrame) -> dict[str, DataFrame]:
    """The parts of which steps are made, keyed by in-ports:
    'given' (key, into, result, module, function): an argument's value, the parameter it becomes, the result of its call;
    'plain' (key, into, mask): steps inside a function, by calls of what is not known; 'fields' (key, into);
    'returned' (key, module, function): what comes to a function's result; 'results' (module, function, result): results of calls
    of a known function; 'parameters' (key, module, function, index)."""
    flow = of(facts, "flow").select("module", "function", key_of("module", "function", F.col("role"), "a", "name").alias("key"), F.col("role").alias("role"), F.col("a").alias("index"),
                                    F.col("text").alias("out"), F.col("b").alias("call"), F.col("c").alias("pos"), F.col("more").alias("keyword"))
    into = calls.select("module", "function", F.col("a").alias("call"), "symbol", "to_module", "to_function", "shift", key_of("module", "function", "result", "a", F.lit("")).alias("result"))
    args = flow.where("out = 'arg'").drop("role", "index").join(into, ["module", "function", "call"])
    known = args.where("to_function IS NOT NULL")
    named = of(facts, "parameter").select(F.col("module").alias("to_module"), F.col("function").alias("to_function"), F.col("a").alias("_index"), F.col("name").alias("keyword"))
    place = F.when(F.col("pos") == -1, 0).otherwise(F.col("pos") + F.col("shift"))
    by_place = known.where("(keyword = '' AND pos >= 0) OR (pos = -1 AND shift = 1)").withColumn("_index", place)
    by_name = known.where("keyword <> ''").join(named, ["to_module", "to_function", "keyword"])
    columns = ["key", key_of("to_module", "to_function", "param", "_index", F.lit("")).alias("into"), "result", F.col("to_module").alias("module"), F.col("to_function").alias("function")]
    cleared = models.clear_table(facts.sparkSession)
    plain = args.where("to_function IS NULL").join(F.broadcast(cleared), "symbol", "left").select("key", F.col("result").alias("into"), (_all().bitwiseXOR(F.coalesce("cleared", F.lit(0)))).alias("mask"))
    field = F.concat_ws("|", "module", F.lit("field"), "keyword")
    held = flow.where("out = 'field'").select("key", field.alias("into"))
    read = of(facts, "flow").where("role = 'field'").select(F.concat_ws("|", "module", F.lit("field"), "name").alias("key"), key_of("module", "function", F.col("role"), "a", "name").alias("into"))
    return {
        "given": by_place.select(columns).unionByName(by_name.select(columns)).distinct(),
        "plain": plain.groupBy("key", "into").agg(F.bit_or("mask").alias("mask")).where("mask <> 0"),
        "fields": held.unionByName(read).distinct(),
        "returned": flow.where("out = 'return'").select("key", "module", "function").distinct(),
        "results": into.where("to_function IS NOT NULL").select(F.col("to_module").alias("module"), F.col("to_function").alias("function"), "result").distinct(),
        "parameters": flow.where("role = 'param'").select("key", "module", "function", "index").distinct(),
    }


def _union(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def _fresh(found: DataFrame, known: list[DataFrame], on: list[str], name: str) -> DataFrame:
    """Bits of found that are not known yet, as a written table."""
    found = found.where("mask <> 0").groupBy(*on).agg(F.bit_or("mask").alias("mask"))
    old = _union(known).groupBy(*on).agg(F.bit_or("mask").alias("_old"))
    mask = F.col("mask").bitwiseAND(F.bitwise_not(F.coalesce("_old", F.lit(0).cast("long"))))
    return written(found.join(old, on, "left").withColumn("mask", mask).where("mask <> 0").select(*on, "mask"), name)


def _folded(parts: list[DataFrame], on: list[str], name: str, most: int = 8) -> list[DataFrame]:
    """parts as few tables, the last of which stays as it is: the next round reads it."""
    if len(parts) <= most:
        return parts
    whole = written(_union(parts[:-1]).groupBy(*on).agg(F.bit_or("mask").alias("mask")), name)
    discard(*parts[:-1])
    return [whole, parts[-1]]


def summaries(parts: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(into, mask): kinds of each parameter (by its in-port) that its function gives back; and (key, into, mask): steps from an
    argument to the result of its call. parts: of ``pieces``, written tables.

    Rounds: what is new of 'a parameter reaches a place of its function' meets returns and makes new summaries; new summaries
    make new steps at all calls of their function; new reach and new steps are joined with all of the other. A round reads only
    what the last one found, so calls of one another end when nothing new comes back, however they are nested.
    """
    start = parts["parameters"].select(F.col("key").alias("entry"), "key").withColumn("mask", _all())
    reach, on = [written(start, "reach")], ["entry", "key"]
    sums, steps = [], [written(parts["plain"], "steps")]
    empty = written(parts["plain"].where("false").select("into", "mask"), "summaries")
    sums.append(empty)
    new = reach[0]
    while True:
        back = new.join(parts["returned"].select("key"), "key").select(F.col("entry").alias("into"), "mask")
        made = _fresh(back, sums, ["into"], "summaries")
        sums = _folded([*sums, made], ["into"], "summaries")
        more = _fresh(parts["given"].join(made, "into").select("key", F.col("result").alias("into"), "mask"), steps, ["key", "into"], "steps")
        moved = [new.join(_union(steps).withColumnsRenamed({"mask": "_m", "into": "_to"}), "key"), _union(reach).join(more.withColumnsRenamed({"mask": "_m", "into": "_to"}), "key")]
        found = _union(moved).select("entry", F.col("_to").alias("key"), F.col("mask").bitwiseAND(F.col("_m")).alias("mask"))
        # steps found now have met all that was reached; what is reached next meets them with the others
        new = _fresh(found, reach, on, "reach")
        steps = _folded([*steps, more], ["key", "into"], "steps")
        if new.isEmpty():
            discard(new, *reach)
            return _union(sums).groupBy("into").agg(F.bit_or("mask").alias("mask")), _union(steps).groupBy("key", "into").agg(F.bit_or("mask").alias("mask"))
        reach = _folded([*reach, new], on, "reach")


def summary_table(facts: DataFrame, calls: DataFrame) -> DataFrame:
    """One row per parameter that comes back: module, function, index, mask (kinds of taint that survive)."""
    parts = {k: written(v, k) for k, v in pieces(facts, calls).items()}
    found, _ = summaries(parts)
    return parts["parameters"].join(found.withColumnRenamed("into", "key"), "key").select("module", "function", "index", "mask")


def matched_steps(facts: DataFrame, calls: DataFrame, lines: DataFrame | None = None) -> DataFrame:
    """(key, into, mask) over places, each of which is there twice: as it is, and with DOWN behind it for values that came by a
    call from above. Those never go on to all callers. lines: the classes' ancestors, with which classes share fields."""
    parts = {k: written(v, k) for k, v in pieces(facts, calls).items()}
    _, inside = summaries(parts)
    low = F.lit(DOWN)
    inside = inside.unionByName(inside.select(F.concat("key", low).alias("key"), F.concat("into", low).alias("into"), "mask"))
    held = parts["fields"] if lines is None else parts["fields"].unionByName(shared_fields(facts, lines))
    fields = held.select(F.explode(F.array("key", F.concat("key", low))).alias("key"), "into").withColumn("mask", _all())
    down = parts["given"].select(F.explode(F.array("key", F.concat("key", low))).alias("key"), F.concat("into", low).alias("into")).withColumn("mask", _all())
    up = parts["returned"].join(parts["results"], ["module", "function"]).select("key", F.col("result").alias("into")).withColumn("mask", _all())
    return _union([inside, fields, down, up]).groupBy("key", "into").agg(F.bit_or("mask").alias("mask"))


def places(state: DataFrame) -> DataFrame:
    """(key, source, bits) without marks, of a state over marked places."""
    return state.withColumn("key", F.regexp_replace("key", r"\|down$", "")).groupBy("key", "source").agg(F.bit_or("bits").alias("bits"))
