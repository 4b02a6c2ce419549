"""Sharding by vector bin packing (operator 6).

Rows with equal texts form a group with a size vector (bytes, tokens, rows). Groups are placed, largest first, into
the shard whose residual capacity has the highest dot product with the group's vector; a group never goes to a shard
whose bytes it would overfill while another has room.

Placement is sequential, so its input must be bounded: groups that hold more than 1/``BUNDLES`` of the bytes or rows
are placed alone, all others are first joined by hash into ``BUNDLES`` bundles. Only a group larger than a whole shard
is split, by doc_id, into pieces of half a shard. At most about 3 * ``BUNDLES`` vectors reach the driver, whatever the
size of the table.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize

SHARDS = 8
#: Bundles of small groups; a shard's bytes end within about one bundle of the mean.
BUNDLES = 4096


def place(vectors: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each row of a (items, dimensions) table of sizes, by dot product with the residual capacity."""
    total = np.maximum(vectors.sum(0), 1)
    scaled = vectors / total * shards  # a shard's fair share is 1 in every dimension
    residual = np.ones((shards, vectors.shape[1]))
    out = np.zeros(len(vectors), np.int64)
    for i in np.lexsort((np.arange(len(vectors)), -scaled.max(1))):
        v = scaled[i]
        fits = (residual[:, 0] >= v[0]) if (residual[:, 0] >= v[0]).any() else residual[:, 0] >= residual[:, 0].max()
        score = np.where(fits, residual @ v, -np.inf)
        out[i] = score.argmax()
        residual[out[i]] -= v
    return out


def shard(documents: DataFrame, shards: int = SHARDS, bundles: int = BUNDLES) -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    size is the text's UTF-8 bytes plus 1; a null text has none, and its crc32 is that of no bytes (0). tokens, the
    second dimension, are the runs between spaces, tabs and newlines. law is 'bytes': shard sizes are near equal.
    slot counts from 0 without gaps in each shard; grown_shard is null under this law. Repeated rows are each placed;
    null ids are placed too (last in their bundle). An empty table gives no rows. Other columns are not read.
    """
    spark = documents.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    blank = F.length(text) - F.length(F.translate(text, " \n\t", ""))
    rows = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.when(F.length(text) > 0, blank + 1).otherwise(0).cast("long").alias("tokens"), F.xxhash64(text).alias("h"), F.xxhash64(F.lit(1), text).alias("h2"))
    rows = materialize(rows, "sizes")
    groups = rows.groupBy("h", "h2", "size").agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens"))
    total = rows.agg(F.sum("size").alias("b"), F.count("*").alias("n")).first()
    # a group's share of all bytes or rows; one above a shard's is cut into pieces of half a shard
    share = F.greatest(F.col("size") * F.col("n") / max(1, total["b"] or 0), F.col("n") / max(1, total["n"]))
    pieces = F.when(share > 1 / shards, F.ceil(share * 2 * shards)).otherwise(1).cast("long")
    # rows of a piece are numbered in parts, each at most 1 / bundles of all rows
    parts = F.ceil(F.col("n") * bundles / max(1, total["n"]) / pieces).cast("long")
    large = groups.where(share > 1 / bundles).select("h", "h2", "size", pieces.alias("pieces"), parts.alias("parts"))
    # at most 2 * bundles groups can pass a limit, so this side is bounded whatever the table's size
    item = F.when(F.col("pieces").isNull(), F.concat(F.lit("b"), F.pmod(F.xxhash64("h", "h2", "size"), F.lit(bundles)).cast("string"))).otherwise(
        F.concat_ws(":", F.lit("g"), F.col("h").cast("string"), F.col("h2").cast("string"), F.col("size").cast("string"), F.pmod(F.xxhash64("doc_id"), F.col("pieces")).cast("string")))
    placed = rows.join(F.broadcast(large), ["h", "h2", "size"], "left").withColumn("item", item)
    placed = placed.withColumn("part", F.coalesce(F.pmod(F.xxhash64(F.lit(2), "doc_id"), "parts"), F.lit(0))).drop("pieces", "parts", "h", "h2")
    sizes = placed.groupBy("item", "part").agg(F.sum("size").alias("b"), F.sum("tokens").alias("t"), F.count("*").alias("n")).orderBy("item", "part").collect()
    items: dict[str, np.ndarray] = {}
    for r in sizes:
        items[r["item"]] = items.get(r["item"], 0) + np.array([r["b"], r["t"], r["n"]], dtype=float)
    where = dict(zip(items, place(np.array(list(items.values())).reshape(-1, 3), shards)))
    at, table = [0] * shards, []
    for r in sizes:
        s = int(where[r["item"]])
        table.append((r["item"], r["part"], s, at[s]))
        at[s] += r["n"]
    lookup = spark.createDataFrame(table, "item string, part long, shard int, first long")
    within = F.row_number().over(Window.partitionBy("item", "part").orderBy(F.col("doc_id").asc_nulls_last(), "size", "text_crc32"))
    return (
        placed.withColumn("i", within).join(F.broadcast(lookup), ["item", "part"])
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("first") + F.col("i") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` in 8 shards of near equal bytes."""
    return shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))
