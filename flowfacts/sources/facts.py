"""Facts projected from the driver's tables by arithmetic and string expressions alone, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCKS = 24


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def module_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Import edges (src, dst), a module a part: every module imports its half, large parts their third as well, and the half
    of the largest imports it back."""
    part = table(spark, sf_dir, "part")
    half = part.selectExpr("p_partkey AS src", "p_partkey DIV 2 AS dst")
    far = part.where("p_size > 45").selectExpr("p_partkey AS src", "p_partkey DIV 3 AS dst")
    back = part.where("p_size = 50").selectExpr("p_partkey DIV 2 AS src", "p_partkey AS dst")
    return half.unionAll(far).unionAll(back).where("src <> dst").distinct()


def modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = module_edges(spark, sf_dir)
    return edges.select(F.col("src").alias("node")).unionAll(edges.select(F.col("dst").alias("node"))).distinct()


def cfg_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Control-flow edges (function, src, dst): one function for each customer with orders, one edge per order."""
    return table(spark, sf_dir, "orders").selectExpr("o_custkey AS function", f"o_orderkey % {BLOCKS} AS src", f"(o_orderkey DIV 7) % {BLOCKS} AS dst").distinct()


def cfg_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same edges with the name that src reads and the name that it then defines."""
    return cfg_edges(spark, sf_dir).selectExpr("*", "concat('v', dst % 4) AS use", "concat('v', src % 3) AS def")


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, url, symbol): page addresses as dotted symbols."""
    from flowfacts.operators.models import dotted

    return table(spark, sf_dir, "pages").select("page_id", "url", dotted(F.col("url")).alias("symbol"))


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(requirement, package, version, spec) from parts."""
    return table(spark, sf_dir, "part").selectExpr(
        "p_partkey AS requirement", "p_brand AS package", "concat(p_size, '.', p_partkey % 10, '.', p_partkey % 3) AS version",
        "concat('>=', p_size, '.', p_partkey % 7, ',<', p_size + 1) AS spec")
