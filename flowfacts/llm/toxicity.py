"""Toxicity by subword-bag embeddings averaged into a linear softmax (operator 10).

A word is the bag of itself and its character 3- to 5-grams, hashed into a fixed table of embeddings; words and then
texts are averages, and a linear layer with softmax tells toxic from other texts. Table and layer are trained jointly
in numpy, so a misspelling that was never seen still shares most n-gram vectors with the word it hides.

A label marks a whole document while a few words earn it, so the classifier reads windows of ``SPAN`` words: it is
first trained on whole documents, then on the windows that speak most for each label, and a document's score is that
of its most toxic window. Every word of a text lies in a window.

The model is fitted on at most ``TRAINING_ROWS`` labelled rows, those with the smallest hash of doc_id.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from .common import free_name, release, released, small_batches

#: The documented bound of the labelled sample that the classifier is fitted on.
TRAINING_ROWS = 6000
BUCKETS = 1 << 17
WIDTH = 8
SPAN = 4
ROUNDS, EPOCHS, RATE = 4, 6, 0.05
#: Weight decay of embeddings and layer, relative to the step size.
DECAY = 0.05
#: Words whose n-grams are worked out at once; some two kilobytes of arrays a word.
AT_ONCE = 4000
#: Words whose scores a worker remembers; beyond, the memory is emptied and filled anew.
REMEMBERED = 200_000
_EDGE = "\"'()[]{}<>.,;:!?…«»“”‘’*_-|"
_MULTIPLY = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Flat bucket numbers and, per word, where its own begin (one more entry at the end)."""
    words = [f"<{w.lower().strip(_EDGE)}>" for w in words]
    length = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(length)
    code = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    owner = np.repeat(np.arange(len(words)), length)
    ids, who = [], []
    rolling = np.zeros(len(code), np.uint64)
    with np.errstate(over="ignore"):
        for n in range(1, 6):
            # after this step rolling[i] is the hash of code[i : i + n]
            rolling = rolling[: len(code) - n + 1] * _MULTIPLY[4] + code[n - 1 :] * _MULTIPLY[n - 1] if len(code) >= n else rolling[:0]
            if n >= 3 and len(rolling):
                at = np.nonzero(np.arange(len(rolling)) + n <= end[owner[: len(rolling)]])[0]
                ids.append(rolling[at])
                who.append(owner[at])
        ids.append(np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in words), np.uint64, len(words)) * _MULTIPLY[1])
        who.append(np.arange(len(words)))
        flat = np.concatenate(ids)
        flat = (flat ^ (flat >> np.uint64(29))) * _MULTIPLY[2] >> np.uint64(64 - 17)
    who = np.concatenate(who)
    order = np.argsort(who, kind="stable")
    return flat[order].astype(np.int64), np.searchsorted(who[order], np.arange(len(words) + 1))


@dataclass
class Model:
    """Per bucket the embedding's share of the log-odds, the bias, and the score of an empty text."""

    odds: np.ndarray
    bias: float
    prior: float


class _Trainer:
    """Embeddings and layer under Adam steps over small batches of texts.

    A text's vector is the mean over its words of the mean over their n-grams, a sparse row of weights times the table.
    N-grams met in fewer than ``least`` training texts keep a zero vector: they could only learn single texts by heart.
    """

    def __init__(self, words: list[str], texts: list[np.ndarray], labels: np.ndarray, least: int = 5, seed: int = 1):
        parts, sizes = [], []
        for k in range(0, len(words), AT_ONCE):
            part, edge = subwords(words[k : k + AT_ONCE])
            parts.append(part.astype(np.int32))
            sizes.append(np.diff(edge))
        at = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
        sub = np.empty(at[-1], np.int32)
        for k in range(len(parts)):  # each goes once it is copied
            part, parts[k] = parts[k], None
            sub[at[k * AT_ONCE] : at[k * AT_ONCE] + len(part)] = part
        del part, parts
        seen = np.zeros((2, BUCKETS), np.int64)
        for t, y in zip(texts, labels):
            t = np.unique(t)
            size = at[t + 1] - at[t]
            seen[y, np.unique(sub[np.arange(size.sum()) + np.repeat(at[t] - np.concatenate([[0], np.cumsum(size)[:-1]]), size)])] += 1
        self.used = np.nonzero(seen.sum(0) >= min(least, max(1, len(texts) // 50)))[0]
        place = np.full(BUCKETS, -1, np.int32)
        place[self.used] = np.arange(len(self.used))
        # n-grams without a vector go; words are taken in portions and moved to the front, so that no second copy is held
        sizes, held = [], 0
        for k in range(0, len(words), AT_ONCE):
            edge = at[k : k + AT_ONCE + 1]
            kept, size = place[sub[edge[0] : edge[-1]]], np.diff(edge)
            sizes.append(np.bincount(np.repeat(np.arange(len(size)), size)[kept >= 0], minlength=len(size)))
            kept = kept[kept >= 0]
            sub[held : held + len(kept)] = kept
            held += len(kept)
        sub.resize(held, refcheck=False)
        self.sub, self.share = sub, (1.0 / np.diff(at)).astype(np.float32)
        self.at = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
        r = np.random.RandomState(seed)
        self.random = r
        self.params = [(r.standard_normal((len(self.used), WIDTH)) * 0.1).astype(np.float32), (r.standard_normal((WIDTH, 2)) * 0.1).astype(np.float32), np.zeros(2, np.float32)]
        # training starts from each n-gram's log-odds between the documents of both labels, in standard errors
        clean, toxic = seen[0, self.used] + 0.5, seen[1, self.used] + 0.5
        gap = np.log(toxic / (labels.sum() + 1)) - np.log(clean / ((1 - labels).sum() + 1))
        self.params[0][:, 0] = gap / np.sqrt(1 / toxic + 1 / clean)
        self.params[1][0] = (-0.5, 0.5)
        self.m = [np.zeros_like(p) for p in self.params]
        self.v = [np.zeros_like(p) for p in self.params]
        self.step = 0

    def odds(self) -> np.ndarray:
        """Log-odds of each word."""
        table, layer, _ = self.params
        gram, out = table @ (layer[:, 1] - layer[:, 0]), np.zeros(len(self.at) - 1)
        for k in range(0, len(out), AT_ONCE):
            at = self.at[k : k + AT_ONCE + 1]
            inside = slice(at[0], at[-1])
            out[k : k + AT_ONCE] = np.bincount(np.repeat(np.arange(len(at) - 1), np.diff(at)), gram[self.sub[inside]] * np.repeat(self.share[k : k + AT_ONCE], np.diff(at)), len(at) - 1)
        return out

    def row(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """N-grams and weights of a text, given as word numbers."""
        words, times = np.unique(text, return_counts=True)
        size = self.at[words + 1] - self.at[words]
        index = np.arange(size.sum()) + np.repeat(self.at[words] - np.concatenate([[0], np.cumsum(size)[:-1]]), size)
        grams, back = np.unique(self.sub[index], return_inverse=True)
        return grams, (np.bincount(back, np.repeat(self.share[words], size) * np.repeat(times, size), len(grams)) / len(text)).astype(np.float32)

    def fit(self, texts: list[np.ndarray], labels: np.ndarray, rounds: int, rate: float, size: int = 250) -> None:
        # rows of a portion are joined at once: the many small arrays of all would take twice as much
        grams, values, sizes = [], [], []
        for at in range(0, len(texts), 500):
            part = [self.row(t) for t in texts[at : at + 500]]
            grams.append(np.concatenate([g.astype(np.int32) for g, _ in part]))
            values.append(np.concatenate([v for _, v in part]))
            sizes += [len(g) for g, _ in part]
        all_grams, all_values, sizes = np.concatenate(grams), np.concatenate(values), np.array(sizes)
        del grams, values
        begin = np.cumsum(sizes) - sizes
        weight = np.where(labels == 1, 0.5 / max(1, labels.sum()), 0.5 / max(1, (1 - labels).sum())).astype(np.float32) * len(labels)
        for _ in range(rounds):
            order = self.random.permutation(len(texts))
            for at in range(0, len(order), size):
                part = order[at : at + size]
                size_of = sizes[part]
                index = np.arange(size_of.sum()) + np.repeat(begin[part] - (np.cumsum(size_of) - size_of), size_of)
                grams, value = all_grams[index], all_values[index]
                owner = np.repeat(np.arange(len(part)), size_of)
                if not len(grams):
                    continue
                table, layer, bias = self.params
                text = np.stack([np.bincount(owner, table[grams, k] * value, len(part)) for k in range(WIDTH)], 1).astype(np.float32)
                logits = text @ layer + bias
                logits -= logits.max(1, keepdims=True)
                p = np.exp(logits)
                p /= p.sum(1, keepdims=True)
                p[np.arange(len(part)), labels[part]] -= 1
                p *= weight[part, None] / len(part)
                g_text = p @ layer.T
                g_table = np.stack([np.bincount(grams, g_text[owner, k] * value, len(self.used)) for k in range(WIDTH)], 1).astype(np.float32)
                self._adam([g_table, text.T @ p + 1e-4 * layer, p.sum(0)], rate)

    def _adam(self, grads: list[np.ndarray], rate: float) -> None:
        self.step += 1
        for i, g in enumerate(grads):
            self.m[i] = 0.9 * self.m[i] + 0.1 * g
            self.v[i] = 0.99 * self.v[i] + 0.01 * g * g
            self.params[i] = self.params[i] * (1 - (DECAY * rate if i < 2 else 0)) - rate * (self.m[i] / (1 - 0.9**self.step)) / (np.sqrt(self.v[i] / (1 - 0.99**self.step)) + 1e-7)

    def model(self, prior: float) -> Model:
        table, layer, bias = self.params
        odds = np.zeros(BUCKETS, np.float32)
        odds[self.used] = table @ (layer[:, 1] - layer[:, 0])
        return Model(odds, float(bias[1] - bias[0]), prior)


def _windows(n: int, span: int) -> list[tuple[int, int]]:
    """Half-overlapping windows that cover 0..n."""
    return [(0, n)] if n <= span else [(a, a + span) for a in range(0, n - span, span // 2)] + [(n - span, n)]


def train(texts: Iterable[str], labels: Sequence[int] | np.ndarray, span: int = SPAN) -> Model:
    """Fit on labelled texts (0 or 1). Without both labels the model scores the share of ones everywhere. Each text is dropped
    once its words are numbered, and labels are read after the texts, so that both may come from one stream."""
    number: dict[str, int] = {}
    memory: dict[str, int] = {}  # of words that are not in normal form; that of the others is themselves

    def code(word: str) -> int:
        got = number.get(word)
        if got is None:
            got = memory.get(word)
        if got is None:
            normal = word.lower().strip(_EDGE)
            got = number.setdefault(normal, len(number))
            if normal != word:
                memory[word] = got
        return got

    coded = [np.fromiter(map(code, t.split()), np.int32) for t in texts]
    labels = np.asarray(labels, np.int64)
    prior = float(labels.mean()) if len(labels) else 0.0
    labels = labels[[i for i, c in enumerate(coded) if len(c)]]
    coded = [c for c in coded if len(c)]
    memory.clear()
    if len(set(labels.tolist())) < 2:
        p = min(max(prior, 1e-3), 1 - 1e-3)
        return Model(np.zeros(BUCKETS, np.float32), float(np.log(p / (1 - p))), p)
    # every fifth row stays out of training and sets the bias at the end
    check = [i for i in range(len(coded)) if i % 5 == 4]
    rest = [i for i in range(len(coded)) if i % 5 != 4]
    if len(set(labels[rest].tolist())) < 2 or len(coded) < 200:
        rest, check = list(range(len(coded))), []
    spare, spare_labels = [coded[i] for i in check], labels[check]
    coded, labels = [coded[i] for i in rest], labels[rest]
    words = list(number)
    number.clear()
    t = _Trainer(words, coded, labels)
    del words
    release()
    r = np.random.RandomState(2)
    clean: list[np.ndarray] = []
    for _ in range(ROUNDS):
        odds, toxic = t.odds(), []
        for c, y in zip(coded, labels):
            runs = _windows(len(c), span)
            sums = np.concatenate([[0], np.cumsum(odds[c])])
            score = np.array([(sums[b] - sums[a]) / (b - a) for a, b in runs])
            # a toxic document shows its most toxic window; a clean one its hardest, of all rounds, and a random one
            for k in {int(score.argmax())} | ({int(r.randint(len(runs)))} if y == 0 else set()):
                (toxic if y else clean).append(c[slice(*runs[k])])
        t.fit(clean + toxic, np.array([0] * len(clean) + [1] * len(toxic)), EPOCHS, RATE)
    model, odds = t.model(prior), t.odds()
    if len(set(spare_labels.tolist())) == 2:
        best = []
        for c in spare:
            sums = np.concatenate([[0], np.cumsum(odds[c])])
            best.append(max((sums[b] - sums[a]) / (b - a) for a, b in _windows(len(c), span)))
        model.bias = _balanced(np.array(best), spare_labels)
    return model


def _balanced(score: np.ndarray, labels: np.ndarray) -> float:
    """The bias with the fewest errors; amid equally good ones the middle."""
    order = np.argsort(score)
    cut = np.concatenate([[0], np.cumsum(labels[order])]) + np.concatenate([np.cumsum((1 - labels[order])[::-1])[::-1], [0]])
    at = np.nonzero(cut == cut.min())[0]
    k = int(at[len(at) // 2])
    edge = np.concatenate([[score[order[0]] - 1], score[order], [score[order[-1]] + 1]])
    return -float((edge[k] + edge[k + 1]) / 2)


class Scorer:
    """Scores texts; remembers words."""

    def __init__(self, model: Model, span: int = SPAN):
        self.model, self.span, self.memory = model, span, {}

    def __call__(self, texts: list[str]) -> np.ndarray:
        out = np.empty(len(texts))
        split = [t.split() for t in texts]
        if len(self.memory) > REMEMBERED:
            self.memory = {}
        memory = self.memory
        new = [w for w in dict.fromkeys(w for s in split for w in s) if w not in memory]
        if new:
            for at in range(0, len(new), AT_ONCE):
                part = new[at : at + AT_ONCE]
                sub, start = subwords(part)
                memory.update(zip(part, (np.add.reduceat(self.model.odds[sub], start[:-1]) / np.diff(start)).tolist()))
        for i, s in enumerate(split):
            n, span = len(s), self.span
            if not n:
                out[i] = self.model.prior
                continue
            odds = np.fromiter(map(memory.__getitem__, s), np.float64, n)
            if n <= span:
                best = odds.mean()
            else:
                sums = np.concatenate([[0.0], np.cumsum(odds)])
                best = (sums[span:] - sums[:-span]).max() / span
            out[i] = 1 / (1 + np.exp(-np.clip(best + self.model.bias, -60, 60)))
        return out


def held_out(doc_id: str = "doc_id") -> F.Column:
    """Rows whose crc32 of the id's text leaves 0 when divided by 5; null ids are not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("long").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(documents: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS) -> Model:
    """A model from the labelled rows that are not held out; of repeated labels of a document the highest counts."""
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id IS NOT NULL AND toxic IN (0, 1)")
    usable = usable.where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sample = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    got = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels: list[int] = []

        def texts() -> Iterator[str]:
            for batch in batches:
                for text, label in zip(*(c.to_pylist() for c in batch.columns)):
                    labels.append(label)
                    yield text or ""

        model = train(texts(), labels)
        yield pa.RecordBatch.from_pydict({"odds": pa.array([model.odds.astype(np.float32).tobytes()], pa.binary()), "bias": pa.array([float(model.bias)]), "prior": pa.array([float(model.prior)])})

    # one task on an executor fits the model: its input is bounded by `rows`, comes in order and is held as word numbers only;
    # the driver gets the model alone
    dealt = got.repartition(1).sortWithinPartitions("doc_id", "text").select("text", "toxic")
    with small_batches(documents.sparkSession, 500):
        fitted = dealt.mapInArrow(released(run), "odds binary, bias double, prior double").first()
    if fitted is None:
        return train([], np.zeros(0, np.int64))
    return Model(np.frombuffer(fitted["odds"], np.float32), fitted["bias"], fitted["prior"])


def with_scores(documents: DataFrame, model: Model, column: str = "text", name: str = "__toxicity") -> DataFrame:
    """The documents with one more column, the score, under a name they don't have; no shuffle."""
    place = documents.columns.index(column)
    schema = StructType([*documents.schema.fields]).add(name, DoubleType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                score = scorer([x or "" for x in part.column(place).to_pylist()])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score)], names=[*part.schema.names, name])

    return documents.mapInArrow(released(run), schema)


def score(documents: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted.

    Null and empty texts get the share of toxic labels as score. Repeated rows are each scored, null ids stay (not
    held out); without labels of both kinds every score is the same; an empty table gives no rows. Labels, lang,
    source and doc_id are no inputs of a score. Other columns are not read.
    """
    model = fit(documents, labels, rows)
    got = with_scores(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model)
    return got.select("doc_id", held_out().alias("held_out"), F.col("__toxicity").alias("score"), (F.col("__toxicity") >= 0.5).cast("int").alias("predicted"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every text of ``documents``, learned from ``labels``."""
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_toxic(documents: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS) -> DataFrame:
    """The documents, all columns, whatever their names, whose score is below one half; rows as in ``score``."""
    name = free_name(documents, "toxicity")
    got = with_scores(documents, fit(documents, labels, rows), name=name)
    return got.where(F.col(name) < 0.5).drop(name)
