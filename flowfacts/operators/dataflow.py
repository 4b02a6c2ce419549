"""Lattices, taint and verdicts over instruction sequences and flows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Earlier calls on a receiver are followed only up to so many calls (a fixed value of the analysis).
FOLLOWED_CALLS = 12


def constant_lattice(values: DataFrame, key: list[str], value: str) -> DataFrame:
    """(key, state, constant): 'bottom' without values, 'const' with one distinct value, else 'top'."""
    low, high = F.min(value), F.max(value)
    state = F.when(low.isNull(), "bottom").when(low == high, "const").otherwise("top")
    return values.groupBy(*key).agg(state.alias("state"), F.when(low == high, low).alias("constant"))


def interval_hull(values: DataFrame, key: list[str], value: str) -> DataFrame:
    """(key, low, high): the smallest interval around all values."""
    return values.groupBy(*key).agg(F.min(value).alias("low"), F.max(value).alias("high"))


def taint_along(steps: DataFrame, key: str, order: list[str], adds: str, clears: str, bits: list[int]) -> DataFrame:
    """steps with `kinds`: the taint bits before each step, where earlier steps of the same key added or cleared bits.

    A bit holds if the last step that touched it added it, so one ordered window per key answers all bits.
    """
    frame = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)

    def bit(b: int) -> Column:
        added, cleared = F.col(adds).bitwiseAND(F.lit(b)) != 0, F.col(clears).bitwiseAND(F.lit(b)) != 0
        last = F.last(F.when(cleared, 0).when(added, b), ignorenulls=True).over(frame)
        return F.coalesce(last, F.lit(0))

    return steps.withColumn("kinds", sum((bit(b) for b in bits[1:]), bit(bits[0])).cast("long"))


def prior_calls(calls: DataFrame, receiver: list[str], order: list[str], call: str) -> DataFrame:
    """(call, prior): earlier calls on the same receiver; receivers with more than FOLLOWED_CALLS calls are not followed."""
    few = calls.groupBy(*receiver).agg(F.count("*").alias("_n")).where(F.col("_n") <= FOLLOWED_CALLS).drop("_n")
    before = F.collect_list(call).over(Window.partitionBy(*receiver).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return calls.join(few, receiver, "left_semi").withColumn("_before", before).select(call, F.explode("_before").alias("prior"))


def judge(flows: DataFrame, key: list[str]) -> DataFrame:
    """Verdict per key over its origins (boolean columns reachable, proved, authorized, guarded), the first that applies:
    unreachable or every origin proved: refuted; authorized: hotspot; an origin without a guard: vulnerability; else hotspot."""
    verdict = (
        F.when(~F.bool_or("reachable"), "refuted").when(F.bool_and("proved"), "refuted")
        .when(F.bool_or("authorized"), "hotspot").when(~F.bool_and(F.col("guarded") | F.col("proved")), "vulnerability").otherwise("hotspot"))
    return flows.groupBy(*key).agg(F.count("*").alias("origins"), verdict.alias("verdict"))
