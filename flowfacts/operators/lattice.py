"""Least solutions of equations over a lattice, semi-naive, with widening.

A state is a row per variable whose columns are joined by aggregates (the least lower end, the greatest upper end, the union of
bits). An equation gives a variable a contribution made of the states of its operands; a variable may have many. Each round
evaluates the equations an operand of which changed, joins their contributions with what was known, and from a given round on
moves ends that still grow to the lattice's top, which ends loops. A variable without a row is unreached.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import SENT_ROWS, dealt, discard, joined, written

def each_bit_or(column: str) -> Column:
    """The union of bits place by place, over arrays of one length."""
    every = F.collect_list(column)
    return F.aggregate(F.slice(every, 2, F.size(every)), F.get(every, F.lit(0)), lambda a, b: F.zip_with(a, b, lambda x, y: x.bitwiseOR(y)))


JOINS = {"min": F.min, "max": F.max, "bit_or": F.bit_or, "each_bit_or": each_bit_or}
#: Rounds whose tables of changes are kept before they are folded into one.
FOLD = 8


def _joined(rows: DataFrame, key: list[str], join: dict[str, str]) -> DataFrame:
    return rows.groupBy(*key).agg(*[JOINS[how](c).alias(c) for c, how in join.items()])


def solve(seeds: DataFrame, equations: DataFrame, operands: DataFrame, evaluate: dict[str, Column], join: dict[str, str], key: list[str], variable: str = "variable",
          widen: Callable[[Column, Column, str], Column] | None = None, widen_from: int = 4, rounds: int = 10_000) -> DataFrame:
    """(key, variable, state columns): the least solution above seeds (key, variable, state columns).

    equations: key, equation, variable and what evaluate reads; operands: key, equation, place, operand (a variable; places from
    0). evaluate: state column -> expression over the equation's columns and ``states``, a map from place to a struct of state
    columns, in which unreached operands are missing; a null in every column is no contribution. join: state column -> 'min',
    'max', 'bit_or' or 'each_bit_or' (arrays). widen: (old, new, column) -> value, applied to what changed from round widen_from on; monotone steps
    without infinite chains need none. ValueError if there is no end after ``rounds`` rounds.
    """
    columns = [*key, variable, *join]
    equations, operands = written(equations, "equations"), written(operands.select(*key, "equation", "place", F.col("operand").alias("_operand")), "operands")
    delta = written(_joined(seeds, [*key, variable], join).select(columns), "states")
    parts = [delta]
    count = delta.count()
    size = max(equations.count(), operands.count(), count)
    for round_ in range(rounds):
        state = _joined(dealt(reduce(DataFrame.unionByName, parts), size, *key, variable), [*key, variable], join)
        changed = delta.select(*key, F.col(variable).alias("_operand"))
        # few changes may be sent
        touched = operands.join(changed, [*key, "_operand"], "left_semi") if count <= SENT_ROWS else joined(operands, changed, size, [*key, "_operand"], "left_semi")
        touched = dealt(touched.select(*key, "equation"), size, *key, "equation").distinct()
        held = state.withColumnRenamed(variable, "_operand").select(*key, "_operand", F.struct(*join).alias("_state"))
        read = joined(joined(operands, touched, size, [*key, "equation"], "left_semi"), held, size, [*key, "_operand"])
        states = dealt(read, size, *key, "equation").groupBy(*key, "equation").agg(F.map_from_entries(F.collect_list(F.struct("place", "_state"))).alias("states"))
        made = joined(equations, states, size, [*key, "equation"]).select(*key, variable, *[e.alias(c) for c, e in evaluate.items()])
        made = made.where(~reduce(lambda a, b: a & b, [F.col(c).isNull() for c in join]))
        made = _joined(dealt(made, size, *key, variable), [*key, variable], join)
        old = state.select(*key, variable, *[F.col(c).alias(f"_{c}") for c in join])
        both = joined(made, old, size, [*key, variable], "left")
        after = {}
        for c, how in join.items():
            now, before = F.col(c), F.col(f"_{c}")
            value = {"min": F.least(now, before), "max": F.greatest(now, before)}.get(how)
            if how == "bit_or":
                value = now.bitwiseOR(F.coalesce(before, now))
            elif how == "each_bit_or":
                value = F.when(before.isNull(), now).otherwise(F.zip_with(now, before, lambda x, y: x.bitwiseOR(y)))
            after[c] = F.when(before.isNotNull() & (value != before), widen(before, value, c)).otherwise(value) if widen and round_ >= widen_from else value
        grown = both.select(*key, variable, *[e.alias(c) for c, e in after.items()], *[f"_{c}" for c in join])
        grown = grown.where(reduce(lambda a, b: a | b, [~F.col(c).eqNullSafe(F.col(f"_{c}")) for c in join])).select(columns)
        delta = written(grown, "states")
        count = delta.count()
        if not count:
            discard(delta, equations, operands)
            return state.select(columns)
        parts.append(delta)
        if len(parts) > FOLD:
            whole = written(_joined(dealt(reduce(DataFrame.unionByName, parts), size, *key, variable), [*key, variable], join).select(columns), "states")
            discard(*parts[:-1])
            parts = [whole]  # holds delta's rows, too
    raise ValueError(f"no fixpoint after {rounds} rounds")


INF = float("inf")
#: Calls of builtins whose results are bounded whatever they are given, by name: (low, high). Fixed values.
BOUNDED_CALLS = {"len": (0.0, INF), "abs": (0.0, INF), "ord": (0.0, 1114111.0)}
#: Operations whose result is a number of the operands.
ARITHMETIC = ("Add", "Sub", "Mult", "FloorDiv", "Mod")


def _product(a: Column, b: Column) -> Column:
    return F.when((a == 0) | (b == 0), F.lit(0.0)).otherwise(a * b)


def interval_of(name: Column, text: Column, states: Column) -> dict[str, Column]:
    """low and high of an instruction's result: a phi takes any operand, the sum, difference and product of two are exact, a
    quotient by a number of one sign lies between the quotients of the ends, a remainder by positive numbers below the greatest;
    anything else is unbounded. No operand, or one of two, gives nothing."""
    low, high = (lambda p: states[F.lit(p)]["low"]), (lambda p: states[F.lit(p)]["high"])
    both = F.map_contains_key(states, F.lit(0)) & F.map_contains_key(states, F.lit(1))
    values = F.map_values(states)
    products = [_product(low(0), low(1)), _product(low(0), high(1)), _product(high(0), low(1)), _product(high(0), high(1))]
    one_sign = (low(1) > 0) | (high(1) < 0)

    def quotient(a: Column, b: Column) -> Column:
        # an end that is not finite over one that is not may be any quotient between 0 and that end
        whole = F.when(F.abs(a / b) < 2.0**52, F.floor(a / b).cast("double")).otherwise(a / b)
        return F.when((F.abs(a) == INF) & (F.abs(b) == INF), a * F.signum(b)).otherwise(whole)

    quotients = [quotient(low(0), low(1)), quotient(low(0), high(1)), quotient(high(0), low(1)), quotient(high(0), high(1))]

    def of(sum_: Column, difference: Column, ends: Callable[..., Column], phi: Column, remainder: Column, open_: float) -> Column:
        operation = F.when(text == "Add", sum_).when(text == "Sub", difference).when(text == "Mult", ends(*products))
        operation = operation.when((text == "FloorDiv") & one_sign, ends(*quotients)).when((text == "Mod") & (low(1) > 0), remainder).otherwise(open_)
        operation = F.when(F.isnan(operation), open_).otherwise(operation)
        return F.when(name == "phi", phi).when(both, operation)

    return {
        "low": of(low(0) + low(1), low(0) - high(1), F.least, F.array_min(F.transform(values, lambda v: v["low"])), F.lit(0.0), -INF),
        "high": of(high(0) + high(1), high(0) - low(1), F.greatest, F.array_max(F.transform(values, lambda v: v["high"])), high(1), INF),
    }


def widened(old: Column, new: Column, column: str) -> Column:
    """An end that moved goes to infinity on its side."""
    return F.lit(-INF if column == "low" else INF)


def intervals(facts: DataFrame) -> DataFrame:
    """(path, function, value, low, high) of values that may be numbers, from facts of kinds instruction, operand and constant: the
    fixpoint of ``interval_of`` over all functions at once. Known integers and floats start with themselves, results of
    BOUNDED_CALLS with their bounds, everything else that arithmetic can't tell with all numbers."""
    def kind(k: str) -> DataFrame:
        return facts.where(F.col("kind") == k)

    made = kind("instruction").where("c IS NOT NULL").select("path", "function", F.col("a").alias("block"), F.col("b").alias("at"), F.col("c").alias("variable"), "name", "text")
    number = kind("constant").where("name IN ('int', 'float')").select("path", "function", F.col("a").alias("variable"), F.col("text").try_cast("double").alias("low"))
    number = number.where("low IS NOT NULL AND NOT isnan(low)").withColumn("high", F.col("low"))
    worked = (F.col("name") == "phi") | ((F.col("name") == "binary") & F.col("text").isin(*ARITHMETIC))
    rest = made.where(~worked).join(number, ["path", "function", "variable"], "left_anti")
    low, high = F.lit(-INF), F.lit(INF)
    for name, (a, b) in BOUNDED_CALLS.items():
        bounded = (F.col("name") == "call") & (F.col("text") == name)
        low, high = F.when(bounded, a).otherwise(low), F.when(bounded, b).otherwise(high)
    seeds = number.unionByName(rest.select("path", "function", "variable", low.alias("low"), high.alias("high")))
    equations = made.where(worked).join(number, ["path", "function", "variable"], "left_anti").withColumn("equation", F.col("variable"))
    read = kind("operand").select("path", "function", F.col("a").alias("block"), F.col("b").alias("at"), F.col("c").alias("operand"), F.col("more").try_cast("int").alias("given"), "role", F.col("name").alias("argument"))
    read = read.join(equations.select("path", "function", "block", "at", "equation"), ["path", "function", "block", "at"])
    place = F.row_number().over(Window.partitionBy("path", "function", "equation").orderBy("given", "role", "argument", "operand")) - 1
    operands = read.withColumn("place", place).select("path", "function", "equation", "place", "operand")
    found = solve(seeds, equations.select("path", "function", "equation", "variable", "name", "text"), operands, interval_of(F.col("name"), F.col("text"), F.col("states")),
                  {"low": "min", "high": "max"}, ["path", "function"], widen=widened)
    return found.withColumnRenamed("variable", "value")
