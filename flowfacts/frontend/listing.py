"""Instructions of functions as text, one line each, in order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import of


def listing(facts: DataFrame) -> DataFrame:
    """(module, function, block, place, line) of facts with nodes: ``%3 = call name (callee=%1, arg=%2)``; order by all but line."""
    at = ["module", "function", "a", "b"]
    operands = of(facts, "operand").groupBy(*at).agg(F.array_sort(F.collect_list(F.struct(
        F.when(F.col("role") == "callee", -1).otherwise(F.col("more").cast("int")).alias("pos"), "role", "name", "c"))).alias("operands"))
    shown = F.transform("operands", lambda o: F.concat(o["role"], F.when(F.coalesce(o["name"], F.lit("")) != "", F.concat(F.lit(" "), o["name"])).otherwise(""), F.lit("=%"), o["c"].cast("string")))
    head = F.when(F.col("c").isNotNull(), F.concat(F.lit("%"), F.col("c").cast("string"), F.lit(" = "))).otherwise("")
    rows = of(facts, "instruction").select(*at, head.alias("head"), "name", "text").join(operands, at, "left")
    line = F.concat("head", F.concat_ws(" ", "name", F.when(F.col("text") != "", F.col("text")), F.when(F.col("operands").isNotNull(), F.concat(F.lit("("), F.array_join(shown, ", "), F.lit(")")))))
    return rows.select("module", "function", F.col("a").alias("block"), F.col("b").alias("place"), line.alias("line"))
