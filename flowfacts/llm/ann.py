"""Approximate nearest neighbours by a hash-prefix forest (operator 2).

Each tree draws one long string of random-hyperplane bits per vector and keeps the strings of a block of rows as
one sorted array. A query descends in every tree to the longest prefix it shares with any row, found by binary
search; then all trees ascend together, one bit shorter at a time, until the prefixes reached hold ``MET`` entries a row.
A row's rank among those met is the sum, over all trees, of the bits by which the prefix it shares is longer than where
the ascent began to meet too few. The first ``share`` of the block, ties at the edge included, are scored exactly in double
precision.

Rows are indexed in blocks of about ``block`` rows, as segments of an index; every query visits every block once, a block's
forest is built once, and the blocks' answers are merged. A block's size is fixed, so the share of a block that is looked at,
and with it the recall, does not depend on the size of the table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .embedding_dedup import units_of, valid_vectors

TREES = 128
BITS = 24
#: Share of a block that is scored.
SHARE = 0.15
#: Entries, over all trees, that a query meets for each row of the block.
MET = 4
#: A query scores at least so many rows of a block, or all of a smaller one.
LEAST = 256
BLOCK = 8192
QUERIES = 512
SEED = 77


class Forest:
    """The sorted hash strings of one block of unit vectors."""

    def __init__(self, unit: np.ndarray, trees: int = TREES, bits: int = BITS):
        self.unit, self.trees, self.bits = unit, trees, bits
        keys = self.hashes(unit)
        self.order = np.argsort(keys, axis=1, kind="stable").astype(np.int32)
        self.sorted = np.take_along_axis(keys, self.order, 1)

    def hashes(self, unit: np.ndarray) -> np.ndarray:
        """(trees, rows) hash strings, the first bit highest."""
        planes = np.random.RandomState(SEED).standard_normal((self.trees, unit.shape[1], self.bits))
        weights = np.uint64(1) << np.arange(self.bits - 1, -1, -1).astype(np.uint64)
        return np.stack([((unit @ p) >= 0).astype(np.uint64) @ weights for p in planes])

    def candidates(self, queries: np.ndarray, own: list[np.ndarray], share: float):
        """For each query, the rows to score: own are the places of the query's own rows, which don't count."""
        keys = self.hashes(queries)
        n, rows = len(queries), self.sorted.shape[1]
        low, high = np.zeros((self.trees, n), np.int32), np.full((self.trees, n), rows, np.int32)
        level = np.zeros(n, np.int64)  # the deepest at which all trees together hold enough entries: the ascent ends there
        for depth in range(1, self.bits + 1):
            shift = np.uint64(self.bits - depth)
            here = np.nonzero(level == depth - 1)[0]
            if not len(here):
                break
            prefix = keys[:, here] >> shift
            begin = np.stack([np.searchsorted(s, p << shift, "left") for s, p in zip(self.sorted, prefix)])
            end = np.stack([np.searchsorted(s, ((p + np.uint64(1)) << shift) - np.uint64(1), "right") for s, p in zip(self.sorted, prefix)])
            deep = (end - begin).sum(0) >= MET * rows
            level[here[deep]] = depth
            low[:, here[deep]], high[:, here[deep]] = begin[:, deep], end[:, deep]
        for q in range(n):
            spans = list(zip(range(self.trees), low[:, q].tolist(), high[:, q].tolist()))
            met = np.concatenate([self.order[t, a:b] for t, a, b in spans])
            apart = np.concatenate([self.sorted[t, a:b] ^ keys[t, q] for t, a, b in spans])
            shared = self.bits - np.frexp(apart.astype(np.float64))[1]  # bits of the common prefix
            rank = np.bincount(met, shared - level[q] + 1, rows)
            rank[own[q]] = 0
            enough = min(max(LEAST, math.ceil(share * rows)), rows - len(own[q]))
            if not enough:
                yield np.zeros(0, np.int64)
                continue
            if np.count_nonzero(rank) < enough:
                rank = np.ones(rows)
                rank[own[q]] = 0
                yield np.nonzero(rank)[0]
                continue
            cut = np.partition(rank, rows - enough)[rows - enough]
            yield np.nonzero((rank >= cut) & (rank > 0))[0]


def nearest(forest: Forest, ids: np.ndarray, place: dict[int, list[int]], query_ids: np.ndarray, asked: np.ndarray, k: int, share: float = SHARE) -> list[np.ndarray]:
    """Per query the k nearest different ids of a block found, as [query_id, vec_id, score] arrays. place: rows by id."""
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    own = [np.array(place.get(int(q), []), np.int64) for q in query_ids]
    for q, found in enumerate(forest.candidates(asked, own, share)):
        score = (forest.unit[found] * asked[q]).sum(1)  # row by row, so that equal vectors have equal scores
        best = np.lexsort((ids[found], -score))
        _, first = np.unique(ids[found[best]], return_index=True)
        best = best[np.sort(first)[:k]]
        out.append((np.full(len(best), query_ids[q]), ids[found[best]], score[best]))
    return [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]


def search(embeddings: DataFrame, queries: DataFrame, k: int = 5, block: int = BLOCK, trees: int = TREES, bits: int = BITS, share: float = SHARE,
           key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Each query's k nearest rows by cosine: query_id, rank (from 1), vec_id, score (double).

    Null, empty, zero or non-finite vectors and null ids take no part on either side; a row is never its own
    answer; rows of another dimension are no candidates. Equal scores go to the smaller vec_id. An id that is repeated
    counts once, with the vector that comes nearest; so does a repeated query. With fewer than k candidates all are
    returned; an empty table gives no rows. Columns other than key and vector are not read. Queries are a stated set: each
    is sent to every block.
    """
    def clean(df: DataFrame) -> DataFrame:
        got = df.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
        return got.where(F.col("vec_id").isNotNull() & valid_vectors(got, "v")).withColumn("d", F.size("v"))

    rows, asked = clean(embeddings), clean(queries).dropDuplicates(["vec_id", "v"])
    blocks = max(1, math.ceil(rows.count() / block))
    base = rows.withColumns({"b": F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"), "ask": F.lit(0)})
    query = asked.withColumns({"b": F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))), "ask": F.lit(1)})
    dealt = base.unionByName(query).repartition(blocks, "d", "b").sortWithinPartitions("d", "b", "ask", "vec_id").select("d", "b", "ask", "vec_id", "v")

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of a block come before its queries; at most one block and QUERIES queries are held."""
        block_now, forest, held_ids, held, place = None, None, [], [], {}

        def flush(ask: int) -> pa.RecordBatch | None:
            nonlocal forest, place, held_ids, held
            out = None
            if held_ids:
                ids = np.concatenate(held_ids)
                x = units_of(np.concatenate(held))
                if ask:
                    if forest is not None:
                        got = nearest(forest, forest.ids, place, ids, x, k, share)
                        out = pa.RecordBatch.from_pydict({"query_id": pa.array(got[0].astype(np.int64)), "vec_id": pa.array(got[1].astype(np.int64)), "score": pa.array(got[2].astype(np.float64))})
                else:
                    forest = Forest(x, trees, bits)
                    forest.ids = ids
                    place = {}
                    for i, v in enumerate(ids.tolist()):
                        place.setdefault(v, []).append(i)
                held_ids, held = [], []
            return out

        ask_now = 0
        for batch in batches:
            d, b, ask = (batch.column(i).to_numpy() for i in range(3))
            edges = np.nonzero((np.diff(d) != 0) | (np.diff(b) != 0) | (np.diff(ask) != 0))[0] + 1
            for at, upto in zip([0, *edges.tolist()], [*edges.tolist(), len(d)]):
                if (d[at], b[at]) != block_now or ask[at] != ask_now:
                    made = flush(ask_now)
                    if made is not None:
                        yield made
                    if (d[at], b[at]) != block_now:
                        block_now, forest = (d[at], b[at]), None
                    ask_now = ask[at]
                for cut in range(at, upto, QUERIES):
                    part = batch.slice(cut, min(QUERIES, upto - cut))
                    held_ids.append(part.column(3).to_numpy())
                    held.append(part.column(4).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1))
                    if ask_now and sum(map(len, held_ids)) >= QUERIES:
                        made = flush(1)
                        if made is not None:
                            yield made
        made = flush(ask_now)
        if made is not None:
            yield made

    found = dealt.mapInArrow(answer, "query_id long, vec_id long, score double").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest of each row whose vec_id is divisible by 50, among all other rows of ``embeddings``."""
    embeddings = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return search(embeddings, embeddings.where("vec_id % 50 = 0"), 5)
