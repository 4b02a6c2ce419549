"""Must-analysis over a call graph: what holds on every way by which a function can be reached."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fixpoint import least_fixpoint
from .tables import written


def uncovered(functions: DataFrame, calls: DataFrame) -> DataFrame:
    """(function) of the functions that can run without a guard: not guarded themselves, and either begun from outside or called
    without a guard by a function that can.

    functions: function, guarded (boolean), entry (boolean: begun from outside); calls: caller, callee, guarded. A function that
    nothing calls counts as begun from outside. This is the complement of the greatest set in which every caller of every
    member either guards its call or is a member; it is reached forward, by rounds over what is new, so a function with very many
    callers is decided by the first that does not guard it. Repeated rows count once; a function is guarded if one of its rows is.
    """
    functions = written(functions.groupBy("function").agg(F.bool_or(F.coalesce("guarded", F.lit(False))).alias("guarded"), F.bool_or(F.coalesce("entry", F.lit(False))).alias("entry")), "functions")
    open_ = functions.where("NOT guarded").select("function")
    called = calls.where("caller <> callee").select(F.col("callee").alias("function")).distinct()
    begun = functions.where("entry AND NOT guarded").select("function").unionByName(open_.join(called, "function", "left_anti"))
    ways = calls.where(~F.coalesce("guarded", F.lit(False))).select("caller", "callee").distinct()
    ways = written(ways.join(open_.withColumnRenamed("function", "callee"), "callee", "left_semi").select("caller", "callee"), "ways")
    return least_fixpoint(begun, lambda new: new.withColumnRenamed("function", "caller").join(ways, "caller").select(F.col("callee").alias("function")), "uncovered")


def covered(functions: DataFrame, calls: DataFrame) -> DataFrame:
    """(function) of functions with a guard on every way to them; see ``uncovered``."""
    return functions.select("function").distinct().join(uncovered(functions, calls), "function", "left_anti")
