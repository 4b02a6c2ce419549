"""Near-duplicate embeddings by randomised-rotation binary codes (operator 1).

Every unit vector is rotated by a fixed random orthogonal matrix and kept as its sign bits, with a correction
factor f = <code, vector>. For a query vector q the estimate <code, q> / f of <vector, q> is unbiased, and its
error is at most ``epsilon * sqrt((1 - f^2) / f^2) / sqrt(d - 1)`` but for a chance that falls with
exp(-c * epsilon^2). Pairs whose upper bound reaches the threshold are recomputed exactly in double precision;
all others are dropped unseen. The query's rotated coordinates are rounded at random to four bits, so that
<code, q> is a sum of four popcounts over packed words.

Codes, factors and rounded coordinates are made once for every different vector of a group and stored; the units
that compare blocks read them. Of equal vectors one is stored, with their number.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import connected_components, discard, keyed_join, materialize, roots

THRESHOLD = 0.93
#: Width of the confidence bound; at 6 a link is lost with a chance of about 1e-7.
EPSILON = 6.0
#: Rows of one block: a label's rows are dealt over blocks of about this size, and pairs of blocks are tasks.
BLOCK = 2048
SEED = 20_24


@lru_cache(4)
def rotation(d: int, seed: int = SEED) -> np.ndarray:
    """A random orthogonal matrix, the same on every machine."""
    q, r = np.linalg.qr(np.random.RandomState(seed).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def units_of(x: np.ndarray) -> np.ndarray:
    """Rows of length 1."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _packed(bits: np.ndarray) -> np.ndarray:
    """(n, words of 64) of an (n, d) array of booleans."""
    padded = np.zeros((len(bits), -(-bits.shape[1] // 64) * 64), dtype=bool)
    padded[:, : bits.shape[1]] = bits
    return np.packbits(padded, axis=1).view(np.uint64)


def encode(unit: np.ndarray, rng: np.random.RandomState) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of unit rows: packed sign bits (n, words), factors <code, vector>, the coordinates rounded at random to levels 0..15
    as bit planes (n, 4, words), and (low, step, sum of levels) of each row (n, 3)."""
    turned = unit @ rotation(unit.shape[1])
    factor = np.abs(turned).sum(1) / np.sqrt(unit.shape[1])
    low = turned.min(1, keepdims=True)
    step = np.maximum((turned.max(1, keepdims=True) - low) / 15, 1e-12)
    level = np.clip(np.floor((turned - low) / step + rng.random_sample(turned.shape)), 0, 15).astype(np.uint8)
    planes = np.stack([_packed((level >> p) & 1 > 0) for p in range(4)], 1)
    return _packed(turned >= 0), factor, planes, np.concatenate([low, step, level.sum(1, dtype=np.int64)[:, None]], 1)


def estimate(codes: np.ndarray, factor: np.ndarray, planes: np.ndarray, scale: np.ndarray, d: int) -> tuple[np.ndarray, np.ndarray]:
    """Estimated inner products (queries x codes), from the queries' planes and scales, and the error each code's rounding may
    add, at epsilon 1."""
    dot = np.zeros((len(planes), len(codes)), dtype=np.int32)
    for plane in range(4):
        for w in range(codes.shape[1]):
            dot += np.bitwise_count(planes[:, plane, w, None] & codes[None, :, w]).astype(np.int32) << plane
    ones = np.bitwise_count(codes).sum(1).astype(np.int32)
    low, step, total = scale[:, :1], scale[:, 1:2], scale[:, 2:]
    # sum over set bits of q minus sum over clear bits of q, with q = low + step * level
    raw = step * (2.0 * dot - total) + low * (2.0 * ones[None, :] - d)
    spread = np.sqrt(np.maximum(1 - factor**2, 0) / factor**2) / np.sqrt(max(d - 1, 1))
    rounding = step * 0.5 / factor[None, :]
    return raw / np.sqrt(d) / factor[None, :], spread[None, :] + rounding


def compare_blocks(x: np.ndarray, stored: tuple, times: np.ndarray, one: np.ndarray, two: np.ndarray, threshold: float, epsilon: float) -> tuple[np.ndarray, np.ndarray]:
    """Of unit rows x: how many vectors each is linked with between the rows one and two (the same array: within), and the
    smallest row of each row's component. times: how many equal vectors a row stands for. Pairs are never kept."""
    codes, factor, planes, scale = stored
    n, same = len(x), one is two
    count, root = np.zeros(n, np.int64), np.arange(n)
    for at in range(0, len(one), 256):
        left = one[at : at + 256]
        got, error = estimate(codes[two], factor[two], planes[left], scale[left], x.shape[1])
        i, j = np.nonzero(got + epsilon * error >= threshold)
        if same:
            keep = i + at < j
            i, j = i[keep], j[keep]
        p, q = left[i], two[j]
        hits = []
        for s in range(0, len(p), 1 << 14):
            hit = np.einsum("ij,ij->i", x[p[s : s + (1 << 14)]], x[q[s : s + (1 << 14)]]) >= threshold
            hits.append(np.nonzero(hit)[0] + s)
        if hits:
            hit = np.concatenate(hits)
            p, q = p[hit], q[hit]
            count += np.bincount(p, times[q], n).astype(np.int64) + np.bincount(q, times[p], n).astype(np.int64)
            root = roots(n, np.concatenate([p, np.arange(n)]), np.concatenate([q, root]))
    return count, root


def valid_vectors(embeddings: DataFrame, vector: str = "embedding") -> F.Column:
    """True where the vector takes part: not null, not empty, all components finite, not zero."""
    v = F.col(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & ~F.coalesce(bad, F.lit(True)) & F.exists(v, lambda x: x != 0)


def near_duplicate_embeddings(embeddings: DataFrame, threshold: float = THRESHOLD, epsilon: float = EPSILON, block: int = BLOCK,
                              key: str = "vec_id", vector: str = "embedding", group: str = "label") -> DataFrame:
    """One row per input row: vec_id, n_links, component_id, kept.

    Rows are compared only within an equal, non-null ``group`` and an equal dimension. Null, empty, zero or
    non-finite vectors and null ids link with nothing (n_links 0, component_id = vec_id). Equal vectors link
    as any others do. Rows that repeat an id with its vector count once; an id repeated with other vectors is one
    vertex, each of its rows has the links of its own vector, and none of its rows is lost. An empty table gives an
    empty result. Other columns, whatever their names, are not read. The work is done when the DataFrame is made.

    A group's different vectors are dealt by hash over ceil(n / block) blocks; every pair of blocks is one unit of
    work, so no task holds more than two blocks. A unit returns link counts and a spanning forest, never its pairs.
    """
    rows = embeddings.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"), F.col(group).cast("string").alias("g"))
    ok = F.col("vec_id").isNotNull() & F.col("g").isNotNull() & valid_vectors(rows, "v")

    def stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Group and dimension, a digest of both with the vector, and the vector as bytes."""
        for batch in batches:
            own, keys, blobs = [], [], []
            flat, at = batch.column(1), batch.column(1).offsets.to_numpy()
            values = flat.values.to_numpy(zero_copy_only=False)
            for i, (good, g) in enumerate(zip(batch.column(3).to_pylist(), batch.column(2).to_pylist())):
                blob = values[at[i] : at[i + 1]].tobytes() if good else None
                own.append(f"{len(blob) // 8}|{g}" if good else None)
                keys.append(hashlib.blake2b(blob + own[-1].encode("utf-8", "surrogatepass"), digest_size=16).digest() if good else None)
                blobs.append(blob)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.string()), pa.array(keys, pa.binary()), pa.array(blobs, pa.binary())], names=["vec_id", "own", "key", "v"])

    table = materialize(rows.select("vec_id", "v", "g", F.coalesce(ok, F.lit(False)).alias("ok")).mapInArrow(stored, "vec_id long, own string, key binary, v binary"), "vectors")
    valid = table.where("key IS NOT NULL")
    classes = materialize(valid.select("vec_id", "own", "key").distinct().groupBy("own", "key").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("n")), "classes")
    firsts = materialize(valid.join(classes, ["own", "key", "vec_id"]).dropDuplicates(["key"]), "firsts")

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.RandomState(SEED)
        for batch in batches:
            blobs = batch.column(3).to_pylist()
            for d in {len(b) for b in blobs}:
                at = np.array([i for i, b in enumerate(blobs) if len(b) == d])
                unit = units_of(np.frombuffer(b"".join(blobs[i] for i in at), np.float64).reshape(len(at), -1))
                codes, factor, planes, scale = encode(unit, rng)
                part = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array([x.tobytes() for x in unit]), part.column(4), *(pa.array([r.tobytes() for r in x]) for x in (codes, planes, scale)), pa.array(factor)],
                                                 names=["own", "key", "vec_id", "v", "n", "code", "planes", "scale", "factor"])

    codes = firsts.select("own", "key", "vec_id", "v", "n").mapInArrow(encoded, "own string, key binary, vec_id long, v binary, n long, code binary, planes binary, scale binary, factor double")
    codes = materialize(codes.withColumnRenamed("n", "times"), "codes")
    sizes = materialize(codes.groupBy("own").agg(F.count("*").alias("n")).where("n > 1").withColumn("blocks", F.ceil(F.col("n") / block).cast("int")), "sizes")
    # a unit (own, i, j) with i <= j takes the rows of block i and of block j: each row goes to `blocks` units
    dealt = keyed_join(codes, sizes, "own", "inner").withColumn("b", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    units = dealt.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"i": F.least("b", "o"), "j": F.greatest("b", "o")}).drop("o", "blocks")

    def compare(rows: pa.Table) -> pa.Table:
        def array(name: str, kind: type, *shape: int) -> np.ndarray:
            return np.frombuffer(b"".join(rows[name].to_pylist()), kind).reshape(rows.num_rows, *shape)

        x = array("v", np.float64, -1)
        stored = array("code", np.uint64, -1), rows["factor"].to_numpy(), array("planes", np.uint64, 4, -1), array("scale", np.float64, 3)
        b, i, j = rows["b"].to_numpy(), rows["i"][0].as_py(), rows["j"][0].as_py()
        one = np.nonzero(b == i)[0]
        count, root = compare_blocks(x, stored, rows["times"].to_numpy(), one, one if i == j else np.nonzero(b == j)[0], threshold, epsilon)
        keep = pa.array(count > 0)
        ids = rows["vec_id"].to_numpy()
        return pa.table({"key": rows["key"].filter(keep), "vec_id": ids[count > 0], "root": ids[root[count > 0]], "links": count[count > 0]})

    found = materialize(units.groupBy("own", "i", "j").applyInArrow(compare, "key binary, vec_id long, root long, links long"), "links")
    # equal vectors share their class's component; so do the vectors of one id
    several = valid.select("vec_id", "key").distinct().groupBy("vec_id").agg(F.count("*").alias("keys")).where("keys > 1").select("vec_id")
    same = valid.join(several, "vec_id").select(F.col("vec_id").alias("u"), "key").join(classes.select("key", F.col("vec_id").alias("v")), "key").select("u", "v")
    components = connected_components(found.select(F.col("vec_id").alias("u"), F.col("root").alias("v")).unionAll(same))
    links = found.groupBy("key").agg(F.sum("links").alias("links"))
    made = classes.join(links, "key", "left").join(components.withColumnRenamed("id", "vec_id"), "vec_id", "left").select(
        "key", "n", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    made = materialize(made, "made")
    for used in (firsts, codes, sizes, found, classes, components):
        discard(used)
    return (
        keyed_join(table.select("vec_id", "key"), made, "key")
        .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
        .withColumn("kept", F.col("vec_id") == F.col("component_id"))
    )


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate vectors of the whole ``embeddings`` table at cosine 0.93."""
    return near_duplicate_embeddings(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE = """
WITH RECURSIVE e AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), u AS (
  SELECT vec_id, label, v, sqrt(list_dot_product(v, v)) AS norm FROM e
), p AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND len(a.v) = len(b.v) AND a.vec_id <> b.vec_id
  WHERE CASE WHEN len(a.v) = len(b.v) THEN list_dot_product(a.v, b.v) END >= 0.93 * a.norm * b.norm
), r(a, b) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a
)
SELECT r.a AS vec_id, coalesce(max(n.links), 0)::BIGINT AS n_links, min(r.b) AS component_id, r.a = min(r.b) AS kept
FROM r LEFT JOIN (SELECT a, count(*) AS links FROM p GROUP BY a) n ON n.a = r.a GROUP BY r.a
"""
