"""N-gram Jaccard self-join by a size-aware heavy-light scheme (operator 5).

Two sets with Jaccard similarity of at least t share at least ceil(t * n) elements of a set of size n, and differ in at
most (1 - t) / (1 + t) * (n + m) elements. Candidates come from exact signatures, so no linked pair is missed:

* light sets (n up to a boundary): of the n - ceil(t * n) + 2 first elements in hash order, linked sets share two, so
  all 2-subsets of these are enumerated as keys;
* heavy sets: the hash space is cut into k ranges, k greater by ``spare`` than half of what linked sets can differ in, so
  linked sets differ in at most one element in more than ``spare`` ranges. Each range is cut in three; the contents of two
  of the three are a term of an inverted index whose lists are scanned, so linked sets share a term of each such range.
  Terms of few elements, which chance would share, are left out as long as they leave linked sets two ranges with a shared
  term. Terms of no element are always left out; a set that would need them has the keys of a light one as well.
  k depends on a class of sizes; a set is listed under its own class and the next.

Light sets within reach of the boundary are listed as heavy ones as well, for their links across it. The boundary is
chosen by cost over the table's own histogram of sizes: the number of keys that both ways would write, each of which is
also one list entry to be scanned. Lists of single elements are not scanned: common n-grams would join most documents
into one candidate group.

All pairs on a list are candidates. One that shares terms of one range only, or whose sketches (a bit for each remainder of
the hash: is the number of elements with it odd?) differ in more bits than linked sets can differ in elements, is no link.
A list too long for pairs is dealt into units of blocks with its sets' sketches, which are compared there all with all; only a
list of more than BLOCKS blocks has its sets tied to its first member, unchecked. Connected groups of what is left hold every
link, and chance seldom joins them. Of documents with equal sets one, the smallest doc_id, is compared; the others take its class. Each set is sent, once, to its group to be
compared exactly (there with an inverted index in true order of frequency, and union-find, so that near copies cost few
pairs). A group larger than a bound is dealt into parts: first each part is compared by itself, then pairs of parts, for
links between members that aren't connected yet.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, connected_components, discard, free_name, keyed_join, materialize, released, small_batches

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_ODD = np.uint64(0xD1342543DE82EF95)
_TABLE = np.random.RandomState(9).randint(1, 2**63 - 1, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1)
#: UTF-8 bytes handled at once.
CHUNK = 1 << 20
#: Shingles and sets of one part; a unit of exact comparison holds two parts at most.
PART = 750_000
PART_DOCS = 4096
#: Entries of a list up to which all its pairs are candidates.
LIST = 16
#: Entries of a longer list in one block, and the number of blocks up to which sketches are compared.
BLOCK = 8192
BLOCKS = 32
#: The low bits of a key tell the range of its term: 1 + number modulo SLOTS; 0 for a key that needs no second one.
SLOTS = 2047


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 1..n of the multiplier and of its inverse modulo 2^64; remembered up to a portion's usual size."""
    if _POWERS and len(_POWERS[0]) >= n:
        return _POWERS[0][:n], _POWERS[1][:n]
    inverse = _ODD
    for _ in range(6):  # Newton's iteration
        inverse = inverse * (np.uint64(2) - _ODD * inverse)
    made = [np.cumprod(np.full(max(n, CHUNK + CHUNK // 4), x, np.uint64)) for x in (_ODD, inverse)]
    if n <= 2 * CHUNK:
        _POWERS[:] = made
    return made[0][:n], made[1][:n]


def shingle_sets(texts: list[bytes], words: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text: words are runs of bytes other than space and 9-13, A-Z
    lower-cased; a text with fewer words than a shingle is one shingle; one without words is empty."""
    joined = b" ".join(texts) + b" "
    raw = np.frombuffer(joined, np.uint8)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(lengths + 1)
    low = np.where((raw >= 65) & (raw <= 90), raw + 32, raw).astype(np.uint8)
    blank = (low == 32) | ((low >= 9) & (low <= 13))
    edge = np.diff(np.concatenate([[1], blank.view(np.int8), [1]]))
    start, stop = np.nonzero(edge == -1)[0], np.nonzero(edge == 1)[0]
    with np.errstate(over="ignore"):
        power, back = _powers(len(raw))
        prefix = np.zeros(len(raw) + 1, np.uint64)
        np.multiply(_TABLE[low], power, out=prefix[1:])
        np.cumsum(prefix[1:], out=prefix[1:])
        word = mix((prefix[stop] - prefix[start]) * back[start] + (stop - start).astype(np.uint64))
        first = np.searchsorted(start, np.concatenate([[0], ends[:-1]]))
        last = np.concatenate([first[1:], [len(start)]])
        run = word * _A
        for i in range(1, words):
            if len(word) > i:
                run = mix(run[: len(word) - i] + np.uint64(i)) + word[i:]
        run = mix(run)
        out = []
        for a, b in zip(first.tolist(), last.tolist()):
            if b - a >= words:
                out.append(np.unique(run[a : b - words + 1]))
            elif b > a:
                h = np.uint64(b - a)
                for w in word[a:b]:
                    h = mix(np.array([h * _A + w]))[0]
                out.append(np.array([h], np.uint64))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def sketch(h: np.ndarray) -> bytes:
    """Parity of the number of elements of each remainder, modulo a power of two not below the size, 64 at least."""
    bits = max(64, 1 << (len(h) - 1).bit_length())
    return np.packbits((np.bincount((h & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(bool), bitorder="little").tobytes()


def may_link(a: bytes, b: bytes, total: int, per_cent: int) -> bool:
    """False only if sets with these sketches and so many elements together differ in too many."""
    if len(a) < len(b):
        a, b = b, a
    x, size = int.from_bytes(a, "little"), len(a)
    while size > len(b):  # remainders modulo half as much
        size //= 2
        x = (x >> (8 * size)) ^ (x & ((1 << (8 * size)) - 1))
    return (x ^ int.from_bytes(b, "little")).bit_count() * (100 + per_cent) <= total * (100 - per_cent)


class Scheme:
    """Signatures of sets for a threshold of per_cent / 100."""

    def __init__(self, per_cent: int, boundary: int = 16):
        self.t, self.per_cent, self.boundary = per_cent / 100, per_cent, boundary
        self.differ = (1 - self.t) / (1 + self.t)

    def size_class(self, n: int) -> int:
        """Number of the size class: class c holds sizes of top(c - 1) + 1 .. top(c), so that linked sizes are at most one class apart."""
        c = max(0, int(math.log(max(n, 1)) / math.log(1 / self.t)) - 2)
        while self.top(c) < n:
            c += 1
        return c

    def top(self, c: int) -> int:
        return max(1, math.floor(self.t**-(c + 1) + 1e-9))

    def ranges(self, c: int) -> tuple[int, int]:
        """(number of hash ranges, spare ranges) of a size class."""
        half = math.floor(self.differ * 2 * self.top(c) + 1e-9) // 2
        spare = 3 + math.ceil(0.2 * half)
        return half + 1 + spare, spare

    def light_keys(self, n: int) -> int:
        p = n - self.least(n) + 2
        return 1 if n == 1 else p * (p - 1) // 2

    def heavy_keys(self, n: int) -> int:
        c = self.size_class(n)
        return 3 * (self.ranges(c)[0] + self.ranges(c + 1)[0])

    def least(self, n: int) -> int:
        """Elements that a linked set shares with a set of size n, at least."""
        return -(-self.per_cent * n // 100)

    def choose(self, histogram: dict[int, int]) -> int:
        """The boundary with the fewest keys over a histogram of set sizes (0: all sets are heavy)."""
        best, cost = 0, math.inf
        sizes = sorted(n for n in histogram if n)
        for s in [0, *[n for n in sizes if n <= 200]]:
            now = sum(histogram[n] * (self.light_keys(n) if n <= s else self.heavy_keys(n)) for n in sizes)
            now += sum(histogram[n] * self.heavy_keys(n) for n in sizes if self.t * s <= n <= s)
            if now < cost:
                best, cost = s, now
        return best

    def keys(self, h: np.ndarray) -> np.ndarray:
        """All signature keys of a non-empty sorted set. Linked sets share one of slot 0 or two of different slots."""
        n = len(h)
        out = []
        low = np.uint64(SLOTS)
        light = n <= self.boundary
        with np.errstate(over="ignore"):
            if n > self.boundary or n >= self.t * self.boundary:
                c = self.size_class(n)
                mixed = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h ^ _A))])
                for k in (c, c + 1):
                    parts, spare = self.ranges(k)
                    width = (1 << 64) // (3 * parts) + 1
                    cut = np.searchsorted(h, np.arange(1, 3 * parts, dtype=np.uint64) * np.uint64(width))
                    at = np.concatenate([[0], cut, [n]])
                    size = np.diff(at).reshape(parts, 3)
                    content = mix((mixed[at[1:]] - mixed[at[:-1]]) + size.ravel().astype(np.uint64) * _B).reshape(parts, 3)
                    number = np.arange(parts, dtype=np.uint64) * _A + np.uint64(k)
                    # term j of a range leaves its third j out
                    term = np.stack([mix(mix(content[:, (j + 1) % 3] + number) + content[:, (j + 2) % 3] * _ODD + np.uint64(j)) for j in range(3)], 1)
                    held = size.sum(1, keepdims=True) - size
                    # ranges of one slot count as one, so that many must be left
                    left = spare - -(-parts // SLOTS)
                    few = np.partition(held.min(1), left)[left]
                    light |= few == 0
                    slot = (1 + np.arange(parts, dtype=np.uint64) % low)[:, None]
                    out.append(((term & ~low) | slot)[held >= max(few, 1)])
            if light:
                p = h[: n - self.least(n) + 2]
                i, j = np.triu_indices(len(p), 1)
                out.append((mix(p[i] * _A + mix(p[j])) if n > 1 else mix(h * _A)) & ~low)
        return np.concatenate(out)


def _flushes(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, list[bytes], pa.RecordBatch]]:
    """(ids, texts as bytes, rows) in portions of bounded size."""
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        texts = [x or b"" for x in batch.column(1).to_pylist()]
        at, size = 0, 0
        for i, t in enumerate(texts):
            size += len(t)
            if size >= CHUNK or i + 1 == len(texts):
                yield ids[at : i + 1], texts[at : i + 1], batch.slice(at, i + 1 - at)
                at, size = i + 1, 0


def _lists(keys: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Entries (key, document) of the lists longer than LIST, and the pairs (u, v, slot) of all others."""
    order = np.lexsort((docs, keys))
    keys, docs = keys[order], docs[order]
    start = np.nonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))[0]
    length = np.diff(np.concatenate([start, [len(keys)]]))
    entries = np.repeat(length, length)
    long = entries > LIST
    listed, entry = keys[long].view(np.int64), docs[long]
    short = (entries > 1) & (entries <= LIST)
    keys, docs = keys[short], docs[short]
    u, v, slot = [], [], []
    for d in range(1, LIST):
        at = np.nonzero((keys[:-d] == keys[d:]) & (docs[:-d] != docs[d:]))[0]
        u.append(docs[at])
        v.append(docs[at + d])
        slot.append((keys[at] & np.uint64(SLOTS)).astype(np.int32))
    return listed, entry, np.concatenate(u), np.concatenate(v), np.concatenate(slot)


def _once(u: np.ndarray, v: np.ndarray, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs (u, v) with their least and greatest slot."""
    order = np.lexsort((slot, v, u))
    u, v, slot = u[order], v[order], slot[order]
    new = np.ones(len(u) + 1, bool)
    new[1:-1] = (u[1:] != u[:-1]) | (v[1:] != v[:-1])
    new, end = new[:-1], new[1:]
    return u[new], v[new], slot[new], slot[end]


def _ties(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(a):
        return a, b
    pairs = np.unique(np.stack([a, b], 1), axis=0)
    return pairs[:, 0], pairs[:, 1]


def near_forest(docs: np.ndarray, sizes: np.ndarray, sketches: list[bytes | None], side: np.ndarray | None, per_cent: int) -> tuple[np.ndarray, np.ndarray]:
    """Ties of documents that connect all pairs of one list whose sketches may link; one without a sketch may link with all.
    side: if given, only ties between its 0s and 1s need be found. Those near the first are joined at once, so that near copies
    cost few comparisons; each of the others is compared with all of like size."""
    blank = np.array([s is None for s in sketches])
    if blank.any():
        head = docs[int(np.argmax(blank))]
        return np.full(len(docs), head), docs
    order = np.argsort(sizes, kind="stable")
    docs, sizes, side = docs[order], sizes[order], None if side is None else side[order]
    widths = np.array([len(sketches[k]) for k in order]) // 8
    folded: dict[int, np.ndarray] = {}  # sketches of at least a width, modulo it
    for width in np.unique(widths)[::-1].tolist():
        rows = np.zeros((len(docs), width), np.uint64)
        for k in np.nonzero(widths == width)[0].tolist():
            rows[k] = np.frombuffer(sketches[order[k]], np.uint64)
        for wider in [w for w in folded if w > width]:
            at = widths == wider
            whole = folded[wider][at]
            while whole.shape[1] > width:
                whole = whole[:, : whole.shape[1] // 2] ^ whole[:, whole.shape[1] // 2 :]
            rows[at] = whole
        folded[width] = rows
    component = np.arange(len(docs))
    left, right = [], []

    def join(k: int) -> None:
        low, high = np.searchsorted(sizes * 100, per_cent * sizes[k]), np.searchsorted(sizes * per_cent, 100 * sizes[k], "right")
        near = np.arange(low, high)
        near = near[component[near] != component[k]]
        if side is not None:
            near = near[side[near] != side[k]]
        for at, width in ((near[widths[near] >= widths[k]], int(widths[k])), *((near[widths[near] == w], w) for w in folded if w < widths[k])):
            if len(at):
                apart = np.bitwise_count(folded[width][at] ^ folded[width][k]).sum(1, dtype=np.int64)
                at = at[apart * (100 + per_cent) <= (sizes[at] + sizes[k]) * (100 - per_cent)]
                _, first = np.unique(component[at], return_index=True)
                at = at[first]
                left.append(np.full(len(at), docs[k]))
                right.append(docs[at])
                gone = component[at]
                component[np.isin(component, gone)] = component[k]

    join(len(docs) // 2)
    main = component[len(docs) // 2]
    for k in np.nonzero(component != main)[0].tolist():
        join(k)
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def exact_links(sets: list[np.ndarray], side: np.ndarray | None, per_cent: int, group: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links (indices) that connect all linked sets, a spanning forest. side: if given, only links between its 0s and 1s
    need be found. group: if given, members of one group are known to be connected. Sets by size probe an inverted index
    of prefixes, rarest elements first, for members of other components only. All is held in arrays, some sixty bytes an
    element."""
    left, right = [], []
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    own = np.argsort(size, kind="stable")
    own = own[size[own] > 0]
    if len(own) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    sizes = size[own]
    at = np.concatenate([[0], np.cumsum(sizes)])
    distinct, code, count = np.unique(np.concatenate([sets[i] for i in own]), return_inverse=True, return_counts=True)
    # elements met once can't be shared: they fill the prefix, first in order, but need no list
    single = int((count == 1).sum())
    rank = np.empty(len(distinct), np.int32)
    rank[np.argsort(count, kind="stable")] = np.arange(len(distinct), dtype=np.int32)
    coded = rank[code]
    del distinct, code, count, rank
    prefix = sizes - -(-per_cent * sizes // 100) + 1
    for k in range(len(own)):
        coded[at[k] : at[k + 1]].sort()
    # the inverted index: list entries by element, then place in own
    inside = np.arange(len(coded)) - np.repeat(at[:-1], sizes) < np.repeat(prefix, sizes)
    inside &= coded >= single
    element, place = coded[inside], np.repeat(np.arange(len(own), dtype=np.int32), sizes)[inside]
    order = np.lexsort((place, element))
    element, place = element[order], place[order]
    begin = np.searchsorted(element, np.arange(single, int(coded.max()) + 2)).tolist()
    del inside, element, order
    sides = None if side is None else np.asarray(side)[own]
    labels = np.arange(len(own)) if group is None else np.asarray(group)[own]
    _, comp = np.unique(labels, return_inverse=True)
    members: dict[int, np.ndarray] = {int(c): np.nonzero(comp == c)[0] for c in np.nonzero(np.bincount(comp) > 1)[0]}
    for k in range(len(own)):
        c, n = coded[at[k] : at[k + 1]], int(sizes[k])
        met = []
        for e in c[: prefix[k]].tolist():
            if e >= single:
                listed = place[begin[e - single] : begin[e - single + 1]]
                if listed[0] < k:
                    met.append(listed[: np.searchsorted(listed, k)])
        if not met:
            continue
        near = np.unique(np.concatenate(met))
        near = near[(sizes[near] * 100 >= per_cent * n) & (comp[near] != comp[k])]
        if sides is not None:
            near = near[sides[near] != sides[k]]
        while len(near):
            j = int(near[0])
            near = near[1:]
            shared = len(np.intersect1d(coded[at[j] : at[j + 1]], c, assume_unique=True))
            if 100 * shared >= per_cent * (n + int(sizes[j]) - shared):
                left.append(own[j])
                right.append(own[k])
                a, b = int(comp[j]), int(comp[k])
                ours, theirs = members.pop(a, np.array([j])), members.pop(b, np.array([k]))
                if len(ours) < len(theirs):
                    ours, theirs, a = theirs, ours, b
                comp[theirs] = a
                members[a] = np.concatenate([ours, theirs])
                near = near[comp[near] != a]
    return np.array(left, np.int64), np.array(right, np.int64)


def jaccard_components(documents: DataFrame, words: int = 4, per_cent: int = 85) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id.

    Null, empty and wordless texts have an empty set and link with nothing (component_id = doc_id); equal sets link,
    whatever their texts. Rows that repeat a doc_id are one vertex, and each repeat is returned; a null doc_id links with
    nothing and has a null component_id. An empty table gives no rows. Other columns are not read.
    """
    spark = documents.sparkSession
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))

    # about six bytes a word: only the choice between two exact ways and the number of buckets depend on it
    size = F.greatest(F.lit(1), F.coalesce(F.octet_length("text"), F.lit(1)) / 6 - (words - 1)).cast("long")
    histogram = docs.select(size.alias("n")).groupBy(F.least("n", F.lit(400)).alias("n")).agg(F.count("*").alias("sets"), F.sum("n").alias("total")).collect()
    scheme = Scheme(per_cent)
    scheme.boundary = scheme.choose({r["n"]: r["sets"] for r in histogram})
    shingles = sum(r["total"] for r in histogram)
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(shingles / 200_000))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """kind 0: doc_id, n_shingles, a digest of the set and its sketch; 1: a tie of two documents; 2: a bucket of keys with
        their documents. Equal sets of a portion are joined here, so a hot group of copies leaves one entry per portion."""
        for ids, texts, rows in _flushes(batches):
            sets = shingle_sets(texts, words)
            n = len(ids)
            known = ~np.asarray(rows.column(0).is_null())
            ids = np.where(known, ids, 0).astype(np.int64)
            first: dict[bytes, int] = {}
            digests: list[bytes | None] = []
            sketches: list[bytes | None] = []
            a, b, keys, owners = [], [], [], []
            for i, s in enumerate(sets):
                if not len(s) or not known[i]:
                    digests.append(None)
                    sketches.append(None)
                    continue
                digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                sketches.append(sketch(s))
                j = first.setdefault(digests[i], i)
                if j != i:
                    a.append(ids[j])
                    b.append(ids[i])
                else:
                    keys.append(scheme.keys(s))
                    owners.append(np.full(len(keys[-1]), ids[i]))
            key, doc = np.concatenate([np.zeros(0, np.uint64), *keys]), np.concatenate([np.zeros(0, np.int64), *owners])
            x, y = _ties(np.array(a, np.int64), np.array(b, np.int64))
            bucket = (key >> np.uint64(11)) % np.uint64(buckets)
            order = np.argsort(bucket, kind="stable")
            key, doc, bucket = key[order], doc[order], bucket[order]
            at = np.searchsorted(bucket, np.arange(buckets + 1, dtype=np.uint64))
            used = np.nonzero(np.diff(at))[0]
            blobs = [key[at[u] : at[u + 1]].tobytes() + doc[at[u] : at[u + 1]].tobytes() for u in used]
            yield pa.RecordBatch.from_pydict({
                "kind": pa.array(np.repeat([0, 1, 2], [n, len(x), len(used)]).astype(np.int32)),
                "a": pa.concat_arrays([pa.array(ids, mask=~known), pa.array(x), pa.nulls(len(used), pa.int64())]),
                "b": pa.concat_arrays([pa.array([len(s) for s in sets], pa.int64()), pa.array(y), pa.nulls(len(used), pa.int64())]),
                "bucket": pa.array(np.concatenate([ids % buckets, x % buckets, used]).astype(np.int64)),
                "blob": pa.concat_arrays([pa.array(digests, pa.binary()), pa.nulls(len(x), pa.binary()), pa.array(blobs, pa.binary())]),
                "sketch": pa.concat_arrays([pa.array(sketches, pa.binary()), pa.nulls(len(x) + len(used), pa.binary())]),
            })
        _POWERS.clear()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of kinds 0 and 1 pass; of the lists of a partition's buckets come pairs (2) with their slots and entries of long lists
        (3: key, document)."""
        names = ["kind", "a", "b", "digest", "sketch", "low", "high"]
        keys, docs = [], []
        for batch in batches:
            listed = pa.compute.equal(batch.column(0), 2)
            plain = batch.filter(pa.compute.invert(listed))
            if plain.num_rows:
                yield pa.RecordBatch.from_arrays([*plain.columns[:3], *plain.columns[4:], *[pa.nulls(plain.num_rows, pa.int32())] * 2], names=names)
            for blob in batch.column(4).filter(listed).to_pylist():
                half = len(blob) // 16
                keys.append(np.frombuffer(blob, np.uint64, half))
                docs.append(np.frombuffer(blob, np.int64, half, half * 8))
        if keys:
            x, y, u, v, slot = _lists(np.concatenate(keys), np.concatenate(docs))
            x, y = _ties(x, y)
            u, v, low, high = _once(u, v, slot)
            for kind, *columns in ((3, x, y, None, None), (2, u, v, low, high)):
                n = len(columns[0])
                blank = [pa.nulls(n, pa.binary())] * 2
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), *map(pa.array, columns[:2]), *blank, *[pa.nulls(n, pa.int32()) if c is None else pa.array(c) for c in columns[2:]]], names=names)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The pairs that may be links; one without a sketch may be."""
        for batch in batches:
            total, *sides = (c.to_pylist() for c in batch.columns[2:])
            stay = [a is None or b is None or may_link(a, b, n, per_cent) for n, a, b in zip(total, *sides)]
            yield batch.select([0, 1]).filter(pa.array(stay, pa.bool_()))

    signed = docs.mapInArrow(released(sign), "kind int, a long, b long, bucket long, blob binary, sketch binary")
    with small_batches(spark):
        listed = materialize(signed.repartition(buckets, "bucket").mapInArrow(released(scan), "kind int, a long, b long, digest binary, sketch binary, low int, high int"), "listed")
    sizes = listed.where("kind = 0").select(F.col("a").alias("doc_id"), F.col("b").alias("n_shingles"), "digest")
    # groups of ties hold all links; of equal sets one takes part; each group is dealt into parts of bounded size
    pairs = listed.where("kind = 2").groupBy(F.col("a").alias("u"), F.col("b").alias("v")).agg(F.min("low").alias("low"), F.max("high").alias("high"))
    pairs = materialize(pairs.where("low < high OR low = 0").select("u", "v"), "pairs")
    # a doc_id with several texts has no sketch
    sketches = listed.where("kind = 0 AND digest IS NOT NULL").groupBy("a").agg(F.min("digest").alias("x"), F.max("digest").alias("y"), F.max("b").alias("n"), F.min("sketch").alias("sketch"))
    sketches = materialize(sketches.where("x = y").select("a", "n", "sketch"), "sketches")
    both = pairs.join(sketches.select(F.col("a").alias("u"), F.col("n").alias("nu"), F.col("sketch").alias("su")), "u", "left")
    both = both.join(sketches.select(F.col("a").alias("v"), F.col("n").alias("nv"), F.col("sketch").alias("sv")), "v", "left")
    with small_batches(spark):
        near = materialize(both.select("u", "v", F.expr("nu + nv"), "su", "sv").mapInArrow(released(check), "u long, v long"), "near")
    entries = listed.where("kind = 3").select(F.col("a").alias("list"), F.col("b").alias("doc_id"))
    lists = materialize(entries.groupBy("list").agg(F.count("*").alias("n"), F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"), F.min("doc_id").alias("head")), "lists")
    entries = keyed_join(entries, lists, "list", "inner")
    compared = entries.where(F.col("blocks") <= BLOCKS).join(sketches.withColumnRenamed("a", "doc_id").hint("shuffle_hash"), "doc_id", "left")
    own = F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")
    compared = compared.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    compared = compared.select("list", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "doc_id", "own", "n", "sketch")
    compared = compared.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(shingles / 10_000_000)), "list", "i", "j").sortWithinPartitions("list", "i", "j")

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by unit; a unit is looked through when its last row has come."""
        now, held = None, []

        def found() -> pa.RecordBatch:
            doc, own, n, sketches = (list(c) for c in zip(*held))
            u, v = near_forest(np.array(doc, np.int64), np.array([x or 0 for x in n], np.int64), sketches, np.array(own) if now[1] != now[2] else None, per_cent)
            return pa.RecordBatch.from_pydict({"u": pa.array(u), "v": pa.array(v)})

        for batch in batches:
            for *unit, doc, own, n, one in zip(*(c.to_pylist() for c in batch.columns)):
                if unit != now:
                    if len(held) > 1:
                        yield found()
                    now, held = unit, []
                held.append((doc, own, n, one))
        if len(held) > 1:
            yield found()

    with small_batches(spark):
        seen = materialize(compared.mapInArrow(released(look), "u long, v long"), "seen")
    ties = listed.where("kind = 1").select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(near).unionAll(seen)
    ties = ties.unionAll(entries.where(F.col("blocks") > BLOCKS).select("head", "doc_id"))
    groups = connected_components(ties).select(F.col("id").alias("doc_id"), F.col("component_id").alias("group"))
    for used in (pairs, sketches, near, lists, seen):
        discard(used)
    groups = materialize(groups.join(sizes.where("digest IS NOT NULL").distinct(), "doc_id"), "groups")
    chosen = materialize(groups.groupBy("group", "digest").agg(F.min("doc_id").alias("doc_id"), F.max("n_shingles").alias("n"), F.count("*").alias("copies")), "chosen")
    size_class = F.size(F.filter(F.array(*[F.lit(scheme.top(c)).cast("long") for c in range(scheme.size_class(10**9))]), lambda top: top < F.col("n")))
    enough = F.ceil(F.greatest(F.sum("n") / PART, F.count("*") / PART_DOCS)).cast("int")
    whole = chosen.groupBy("group").agg(enough.alias("units"), F.count("*").alias("sets")).where("sets > 1")
    # a large group is dealt by classes of sizes, as links reach no further than the next, and by hash within a class
    dealt_by = chosen.select("group", size_class.alias("c"), "n").groupBy("group", "c").agg(enough.alias("parts"))
    dealt_by = whole.join(dealt_by.groupBy("group").agg(F.map_from_entries(F.collect_list(F.struct("c", "parts"))).alias("classes")), "group")
    dealt_by = materialize(dealt_by.select("group", F.col("sets").alias("n"), F.when(F.col("units") > 1, F.col("classes")).alias("classes")), "parts")
    # a doc_id that is repeated with other texts connects them
    several = groups.groupBy("doc_id").agg(F.min("digest").alias("a"), F.max("digest").alias("b")).where("a <> b").select("doc_id")
    own = groups.join(several, "doc_id").join(chosen.select("group", "digest", F.col("doc_id").alias("u")), ["group", "digest"]).select("u", F.col("doc_id").alias("v"))
    at = F.shiftleft(F.col("c").cast("long"), 32) + F.pmod(F.xxhash64("doc_id"), F.col("classes")[F.col("c")])
    dealt = keyed_join(chosen.select("doc_id", "group", "digest", size_class.alias("c")), dealt_by, "group", "inner")
    dealt = materialize(dealt.select("doc_id", "group", "digest", "classes", "c", F.when(F.col("classes").isNull(), F.lit(0)).otherwise(at).cast("long").alias("part")), "dealt")
    shape = dealt.agg(F.count("*"), F.count("classes")).first()
    few = shape[0] <= BROADCAST_ROWS

    def shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sets of the rows whose digest is the one looked for: a repeated doc_id may have other texts."""
        for _, texts, rows in _flushes(batches):
            blobs = [s.tobytes() for s in shingle_sets(texts, words)]
            same = [hashlib.blake2b(s, digest_size=16).digest() == d for s, d in zip(blobs, rows.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([rows.column(0), *rows.columns[3:], pa.array(blobs, pa.binary())], names=["doc_id", "group", "part", "set"]).filter(pa.array(same, pa.bool_()))
        _POWERS.clear()

    wanted = docs.join(F.broadcast(dealt) if few else dealt, "doc_id").select("doc_id", "text", "digest", "group", "part")
    sets = wanted.mapInArrow(released(shingle), "doc_id long, group long, part long, set binary")
    number = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(shingles / 10_000_000))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by unit; a unit is compared when its last row has come."""
        now, held = None, []

        def links() -> pa.RecordBatch:
            doc = np.array([r[0] for r in held], np.int64)
            two = now[1] != now[2]
            x, y = exact_links([r[3] for r in held], np.array([r[1] for r in held]) if two else None, per_cent, np.array([r[2] for r in held]) if two else None)
            return pa.RecordBatch.from_pydict({"u": pa.array(doc[x]), "v": pa.array(doc[y])})

        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                for *unit, doc, part, known, blob in zip(*(c.to_pylist() for c in batch.slice(at, 512).columns)):
                    if unit != now:
                        if len(held) > 1:
                            yield links()
                        now, held = unit, []
                    held.append((doc, part, known, np.frombuffer(blob, np.uint64)))
        if len(held) > 1:
            yield links()

    def edges_of(units: DataFrame, name: str) -> DataFrame:
        """units: group, i, j, doc_id, part, known, set."""
        dealt_out = units.select("group", "i", "j", "doc_id", "part", "known", "set").repartition(number, "group", "i", "j").sortWithinPartitions("group", "i", "j", "doc_id")
        with small_batches(spark, 250):
            return materialize(dealt_out.mapInArrow(released(compare), "u long, v long"), name)

    one = sets.withColumns({"i": F.col("part"), "j": F.col("part"), "known": F.col("doc_id")})
    edges = edges_of(one, "links")
    components = connected_components(edges.unionAll(own))
    if shape[1]:
        known = components.select(F.col("id").alias("doc_id"), F.col("component_id").alias("known"))
        near = F.flatten(F.transform(F.array(*[F.col("c") + k for k in (-1, 0, 1)]), lambda c: F.transform(
            F.filter(F.sequence(F.lit(0), F.coalesce(F.col("classes")[c], F.lit(0))), lambda p: p < F.coalesce(F.col("classes")[c], F.lit(0))), lambda p: F.shiftleft(c.cast("long"), 32) + p)))
        reach = dealt.where("classes IS NOT NULL").select("doc_id", "group", "part", F.explode(F.filter(near, lambda o: o != F.col("part"))).alias("other"))
        reach = reach.join(known, "doc_id", "left").withColumn("known", F.coalesce("known", "doc_id"))
        across = sets.join(reach, ["doc_id", "group", "part"])
        more = edges_of(across.withColumns({"i": F.least("part", "other"), "j": F.greatest("part", "other")}), "links")
        ties = components.select(F.col("id").alias("u"), F.col("component_id").alias("v"))
        whole = connected_components(ties.unionAll(more))
        for used in (components, more):
            discard(used)
        components = whole
    # every document takes the class of the one with an equal set
    linked = chosen.join(components.select(F.col("id").alias("doc_id"), "component_id"), "doc_id", "left")
    classes = linked.where("copies > 1 OR component_id IS NOT NULL").select("digest", F.coalesce("component_id", "doc_id").alias("class"), F.col("copies").alias("n"))
    classes = materialize(classes, "classes")
    for used in (groups, chosen, dealt_by, dealt, edges, components):
        discard(used)
    out = keyed_join(sizes, classes, "digest")
    return out.select("doc_id", "n_shingles", F.coalesce("class", "doc_id").alias("component_id"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of ``documents`` that share 85 of 100 distinct 4-word shingles."""
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), 4, 85)


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS l FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(l[i : least(i + 3, len(l))], ' ') AS g
  FROM (SELECT doc_id, l, unnest(range(1, greatest(1, len(l) - 3) + 1)) AS i FROM w WHERE len(l) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), c AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY x.doc_id, y.doc_id
), p AS (
  SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 85 * (x.n + y.n - common)
), r(a, b) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a
)
SELECT r.a AS doc_id, coalesce(max(n.n), 0)::BIGINT AS n_shingles, min(r.b) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.a GROUP BY r.a
"""


def keep_one_of_each_group(documents: DataFrame, words: int = 5, per_cent: int = 80) -> DataFrame:
    """The documents, all columns, but of each linked group only the one with the smallest doc_id.

    Null ids and empty texts stay; so does every row of a repeated doc_id that is the smallest of its group. Other columns
    may have any name. Only the ids to drop take part in the last join, broadcast if they are few.
    """
    found = jaccard_components(documents, words, per_cent)
    name = free_name(documents, "gone")
    gone = materialize(found.where("component_id <> doc_id").select(F.col("doc_id").alias(name)).distinct(), "gone")
    few = gone.count() <= BROADCAST_ROWS
    return documents.join(F.broadcast(gone) if few else gone, F.col("doc_id").cast("long") == F.col(name), "left_anti")
