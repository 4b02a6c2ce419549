"""Exact top-k by inner product, in buckets of like length (operator 12).

Vectors are grouped by length: a class holds lengths within a factor, a class of many vectors is dealt by hash into buckets of
bounded size. A bucket that a query meets with a known bound (the k-th best product found so far) can hold an answer only
at a cosine of at least bound / (query's length x the bucket's greatest length), its local threshold. If that is high, few
coordinates decide: a vector at that cosine must have each coordinate near the query's, so the rows of a sorted list's range
are candidates, cut down by the other focus coordinates. If it is low, only length prunes: rows in falling order of length
until a row is too short. What is left is verified by its product, which is exact.

Two waves: buckets of the longest vectors give each query its bound, then all others are met under that bound.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import BROADCAST_ROWS, materialize

SCALE = 1024
#: Lengths of a class differ by at most this factor.
FACTOR = 1.05
BLOCK = 8192
QUERIES = 256
#: Local cosine from which coordinates prune.
BY_COORDINATE = 0.5
#: Coordinates that a query looks at.
FOCUS = 4
#: Products up to here are exact in doubles.
EXACT = 2.0**53
LARGEST = 2**63 - 1
#: Bounds are eased by this, for rounding in lengths and angles.
EASE = 1e-9


class Bucket:
    """Integer vectors (as doubles) in falling order of length, with sorted lists of their unit coordinates made when asked for."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        with np.errstate(over="ignore"):
            length = np.sqrt((x * x).sum(1))
        order = np.lexsort((ids, -length))
        self.ids, self.x, self.length = ids[order], x[order], length[order]
        self.largest = float(np.abs(x).max()) if x.size else 0.0
        self.by_id = np.argsort(self.ids, kind="stable")
        self.sorted_ids = self.ids[self.by_id]
        self.often = int(np.unique(ids, return_counts=True)[1].max()) if len(ids) else 0
        self.lists: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def list_of(self, f: int) -> tuple[np.ndarray, np.ndarray]:
        """(values, rows) of coordinate f of the unit vectors, sorted."""
        if f not in self.lists:
            value = np.divide(self.x[:, f], self.length, out=np.zeros(len(self.x)), where=self.length > 0)
            rows = np.argsort(value, kind="stable")
            self.lists[f] = value[rows], rows
        return self.lists[f]

    def local(self, length: float, bound: float) -> float:
        """The least cosine at which a row of the bucket can reach the bound."""
        top = length * self.length[0]
        if not top > 0:
            return -1.0 if bound <= 0 else 2.0
        return bound / top if np.isfinite(top) else -1.0

    def candidates(self, q: np.ndarray, length: float, bound: float | None) -> tuple[str, np.ndarray | None]:
        """How the query was pruned, and the rows left (None: all)."""
        if bound is None:
            return "all", None
        cosine = self.local(length, bound)
        if cosine > 1 + EASE:
            return "none", np.zeros(0, np.int64)
        if cosine < BY_COORDINATE:
            if bound <= 0 or not np.isfinite(length):
                return "length", None
            return "length", np.arange(np.searchsorted(-self.length, -bound / length * (1 - EASE), "right"))
        unit = q / length
        wide = np.arccos(min(1.0, cosine - EASE))
        ranges = []
        for f in np.argsort(-np.abs(unit), kind="stable")[:FOCUS].tolist():
            angle = np.arccos(np.clip(unit[f], -1, 1))
            low, high = np.cos(min(np.pi, angle + wide)) - EASE, np.cos(max(0.0, angle - wide)) + EASE
            value, rows = self.list_of(f)
            begin, end = np.searchsorted(value, low, "left"), np.searchsorted(value, high, "right")
            ranges.append((end - begin, f, low, high, rows[begin:end]))
        ranges.sort(key=lambda r: r[:2])
        rows = ranges[0][4]
        for _, f, low, high, _ in ranges[1:]:
            value = np.divide(self.x[rows, f], self.length[rows], out=np.zeros(len(rows)), where=self.length[rows] > 0)
            rows = rows[(value >= low) & (value <= high)]
        return "coordinate", rows

    def own(self, query: int) -> np.ndarray:
        return self.by_id[np.searchsorted(self.sorted_ids, query, "left") : np.searchsorted(self.sorted_ids, query, "right")]

    def products(self, rows: np.ndarray | None, q: np.ndarray) -> np.ndarray:
        """Exact products, as doubles where these hold them, else as Python integers, the nearest within a long."""
        x = self.x if rows is None else self.x[rows]
        if len(q) * self.largest * float(np.abs(q).max() if len(q) else 0.0) < EXACT:
            return x @ q
        whole = [int(v) for v in q]
        return np.array([max(-LARGEST - 1, min(LARGEST, sum(int(a) * b for a, b in zip(row, whole)))) for row in x.tolist()], object)

    def best(self, query: int, q: np.ndarray, bound: float | None, k: int) -> tuple[np.ndarray, list[int]]:
        """ids and scores of the k best different rows of the bucket, less what cannot reach the bound."""
        with np.errstate(over="ignore"):
            length = float(np.sqrt((q * q).sum()))
        _, rows = self.candidates(q, length, bound)
        got = self.products(rows, q)
        rows = np.arange(len(self.ids)) if rows is None else rows
        other = ~np.isin(rows, self.own(query))
        rows, got = rows[other], got[other]
        many = k * self.often
        if len(got) > many and got.dtype != object:
            keep = got >= np.partition(got, len(got) - many)[len(got) - many]
            rows, got = rows[keep], got[keep]
        ids = self.ids[rows]
        order = np.lexsort((ids, -got)) if got.dtype != object else np.array(sorted(range(len(got)), key=lambda i: (-got[i], ids[i])), np.int64)
        _, first = np.unique(ids[order], return_index=True)
        order = order[np.sort(first)[:k]]
        return ids[order], [int(s) for s in got[order]]


def _met(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Answers of sorted rows (d, c, b, ask, vec_id, v, bound): a bucket's rows come before its queries; at most one bucket and
    a batch of queries are held."""
    def vectors(part: pa.RecordBatch) -> np.ndarray:
        return part.column(5).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)

    now, ids, held, bucket = None, [], [], None
    for batch in batches:
        keys = np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(4)], 1)
        edges = np.nonzero((np.diff(keys, axis=0) != 0).any(1))[0] + 1
        for at, upto in zip([0, *edges.tolist()], [*edges.tolist(), len(keys)]):
            own, ask = tuple(keys[at, :3].tolist()), keys[at, 3]
            if own != now:
                now, ids, held, bucket = own, [], [], None
            part = batch.slice(at, upto - at)
            if not ask:
                ids.append(part.column(4).to_numpy())
                held.append(vectors(part))
                continue
            if bucket is None:
                if not held:
                    continue
                bucket = Bucket(np.concatenate(ids), np.concatenate(held))
                held = []
            out: list[tuple[int, int, int]] = []
            for query, q, bound in zip(part.column(4).to_pylist(), vectors(part), part.column(6).to_pylist()):
                found, scores = bucket.best(query, q, bound, k)
                out += [(query, int(i), s) for i, s in zip(found, scores)]
            columns = list(zip(*out)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["query_id", "vec_id", "score"])


def _top(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    distinct = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return distinct.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def whole(vector: Column, scale: int) -> Column:
    """floor(scale x component) of each, kept as doubles; null where the vector is null or anything in it is not finite."""
    def down(x: Column) -> Column:
        y = x.cast("double") * float(scale)
        return F.when(F.abs(y) < EXACT / 2, F.floor(y).cast("double")).otherwise(y)

    made = F.transform(vector, down)
    bad = F.exists(made, lambda y: y.isNull() | F.isnan(y) | (F.abs(y) == float("inf")))
    return F.when(~F.coalesce(bad, F.lit(True)), made)


def search_products(embeddings: DataFrame, queries: DataFrame, k: int = 10, scale: int = SCALE, block: int = BLOCK, factor: float = FACTOR, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Each query's k rows of highest inner product over floor(scale x component): query_id, rank (from 1), vec_id, score.

    Null vectors, vectors with a null or non-finite component (or one that scaling takes beyond a double) and null ids take
    no part on either side; zero and empty vectors do. A row is never the answer of a query with its id; rows of another
    dimension are no candidates. Ties go to the smaller vec_id. An id that is repeated counts once, with its highest product;
    so does a repeated query. With fewer than k candidates all are returned; an empty table gives no rows. Products are exact;
    those beyond a long count as the nearest long. Columns other than key and vector are not read.

    Queries are a stated set: each is sent to the buckets it may find an answer in. Very many equal vectors are dealt over
    buckets by id. Tables are written on the way, so work is done when the DataFrame is made.
    """
    def clean(df: DataFrame) -> DataFrame:
        got = df.select(F.col(key).cast("long").alias("vec_id"), whole(F.col(vector), scale).alias("v")).where("vec_id IS NOT NULL AND v IS NOT NULL")
        length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, y: a + y * y))
        level = F.when(length == 0, -1).otherwise(F.least(F.floor(F.log(length) / float(np.log(factor))), F.lit(1_000_000))).cast("long")
        return got.select("vec_id", "v", F.size("v").alias("d"), length.alias("length"), level.alias("c"))

    rows, asked = clean(embeddings), clean(queries).dropDuplicates(["vec_id", "v"]).drop("c")
    sizes = rows.groupBy("d", "c").agg(F.count("*").alias("n"), F.max("length").alias("longest"))
    ahead = F.coalesce(F.sum("n").over(Window.partitionBy("d").orderBy(F.desc("longest"), F.desc("c")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = F.ceil(F.col("n") / block).cast("int").alias("parts")
    classes = materialize(sizes.select("d", "c", "longest", parts, (ahead < block).alias("leads")), "classes")
    n, buckets = classes.agg(F.count("*"), F.sum("parts")).first()
    small = F.broadcast(classes) if n <= BROADCAST_ROWS else classes  # a row for each factor of lengths within a dimension
    dealt = rows.join(small, ["d", "c"]).withColumn("b", F.pmod(F.xxhash64("vec_id", "v"), F.col("parts")).cast("int"))

    def wave(base: DataFrame, asks: DataFrame) -> DataFrame:
        cut = ["d", "c", "b", "ask", "vec_id", "v", "bound"]
        both = base.withColumns({"ask": F.lit(0), "bound": F.lit(None).cast("double")}).select(cut).unionByName(asks.withColumn("ask", F.lit(1)).select(cut))
        return both.repartition(max(1, buckets or 1), "d", "c", "b").sortWithinPartitions("d", "c", "b", "ask", "vec_id").mapInArrow(lambda it: _met(it, k), "query_id long, vec_id long, score long")

    first = (F.col("leads")) & (F.col("b") == 0)
    met = asked.join(small, "d").withColumn("b", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    begun = materialize(_top(wave(dealt.where(first), met.where(first).withColumn("bound", F.lit(None).cast("double"))), k), "first-products")
    bounds = begun.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").cast("double").alias("bound"))
    may = F.col("bound").isNull() | (F.col("length") * F.col("longest") * (1 + EASE) >= F.col("bound"))
    later = wave(dealt.where(~first), met.where(~first).join(bounds, "vec_id", "left").where(may))
    best = _top(begun.drop("rank").unionByName(later), k)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op12_topk_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 highest products of each row whose vec_id is divisible by 100, among all other rows of ``embeddings``."""
    embeddings = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return search_products(embeddings, embeddings.where("vec_id % 100 = 0"), 10)


ORACLE = f"""
WITH scaled AS (SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT q.vec_id AS query_id, c.vec_id, max(list_inner_product(q.v, c.v))::BIGINT AS score
  FROM scaled q JOIN scaled c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(c.v) = len(q.v) GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""
