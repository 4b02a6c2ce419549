"""Sum-of-squares packing of tokenised documents into windows (operator 8).

Documents are tokenised where they are read and cut into full windows and one rest. Each rest goes, online, to the
fill level that minimises the sum over levels of the squared counts of partially filled windows: from level h to
h + s the sum changes by 2 * (count[h + s] - count[h]) + 2, and by 2 * count[s] + 1 for a new window (full windows
are not counted). The counts are kept in an array over levels, with the open windows of each level on a stack.

Each partition of the scan has windows of its own. The pieces of the windows still open at its end go into a second round,
which packs those of all partitions together: the largest first, each into the fullest window that takes it.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, released, small_batches, small_join

WINDOW = 4096
END = 2
#: Words whose ids a worker remembers, in each of two generations: when the young one is full, it becomes the old one, and what
#: was not used since goes.
REMEMBERED = 200_000
#: Pieces of open windows that one task of the second round packs, about.
LOOSE = 50_000


#: What keeps a text from being read in lower case with its commas and full stops apart: letters whose lower case hangs on their
#: neighbours, or that NFC may join; a comma or full stop that ends a run of other signs; what may be a special token.
_HIGH = re.compile("[\u0130-\U0010ffff]")
#: Signs that, behind letters, are read apart from them: all of ASCII but the apostrophe, which may join.
_SIGNS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


def _has_high(text: str) -> bool:
    if text.isascii():
        return False
    try:
        text.encode("latin-1")  # faster than the search, which most texts need not have
    except UnicodeEncodeError:
        return _HIGH.search(text) is not None
    return False


def _plain(text: str) -> bool:
    if "<|" in text or _has_high(text):
        return False
    for end in (". ", ", ", ".\n", ",\n"):
        for part in text.split(end)[:-1]:
            # Python takes U+001C to U+001F for white space, the tokenizer does not
            if part and not (part[-1].isalnum() or part[-1].isspace() and not "\x1c" <= part[-1] <= "\x1f"):
                return False
    return True


class WordIds:
    """Ids of a text, word by word. Words are what spaces and newlines part: the tokenizer drops white space and never
    joins across it, so the ids of a text are those of its words in order. It also lower-cases, and takes signs behind letters
    or digits for words of their own, so most texts are read in lower case, with commas and full stops at ends of words apart."""

    def __init__(self, path: str, remembered: int = REMEMBERED):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.remembered = Tokenizer.from_file(path), remembered
        # the same model without normalizer and expressions: lower-case words of letters need neither
        self.bare = Tokenizer(self.tokenizer.model)
        self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.memory: dict[str, bytes] = {"": b""}
        self.old: dict[str, bytes] = {}
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    def learn(self, words: set[str]) -> None:
        """Remember the ids of new words. Signs behind letters are a word of their own."""
        whole, stems, ends, rest = [], [], [], []
        for w in words:
            stem = w.rstrip(_SIGNS)
            if stem.isalpha() and not _has_high(stem):
                whole.append(w)
                stems.append(stem)
                ends.append(w[len(stem) :])
            else:
                rest.append(w)
        rest.extend(set(ends).difference(self.memory, rest))
        for w, e in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)):
            self.memory[w] = np.array(e.ids, dtype="<u4").tobytes()
        for w, ids, end in zip(whole, self._letters(stems), ends):
            self.memory[w] = ids + self.memory[end] if end else ids

    def _letters(self, words: list[str]) -> Iterator[bytes]:
        """Ids of words of letters only, encoded as one text: each ends with its only end-of-word token."""
        for at in range(0, len(words), 500):
            part = words[at : at + 500]
            ids = np.array(self.bare.encode_batch_fast([" ".join(part).lower()], add_special_tokens=False)[0].ids, dtype="<u4")
            ends = np.nonzero(self.last[ids])[0] + 1
            if len(ends) != len(part):
                yield from (np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(part, add_special_tokens=False))
                continue
            blob, start = ids.tobytes(), 0
            for end in (ends * 4).tolist():
                yield blob[start:end]
                start = end

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        split = []
        for t in texts:
            if _plain(t):
                t = t.lower().replace(", ", " , ").replace(". ", " . ").replace(".\n", " . ").replace(",\n", " , ")
            split.append(t.replace("\n", " ").split(" "))
        if len(self.memory) > self.remembered:
            self.old, self.memory = self.memory, {"": b""}
        missing = set().union(*split).difference(self.memory)
        known = missing.intersection(self.old)
        self.memory.update(zip(known, map(self.old.__getitem__, known)))
        if len(known) < len(missing):
            self.learn(missing - known)
        return [b"".join(map(self.memory.__getitem__, words)) for words in split]


class SumOfSquares:
    """Online packing into windows of a fixed size."""

    def __init__(self, size: int = WINDOW):
        self.size, self.count, self.open, self.made = size, np.zeros(size + 1, np.int64), [[] for _ in range(size)], 0

    def add(self, length: int) -> tuple[int, int]:
        """(window, offset) for a piece of 1..size ids."""
        if length == self.size:
            self.made += 1
            return self.made - 1, 0
        count = self.count
        top = self.size - length  # levels 1..top can take the piece
        change = 2 * (count[length + 1 : self.size + 1] - count[1 : top + 1]) + 2
        change[top - 1] = 1 - 2 * count[top]  # it fills up, and a full window is not counted
        change[count[1 : top + 1] == 0] = np.iinfo(np.int64).max
        level = int(change.argmin()) + 1
        if 2 * count[length] + 1 < change[level - 1]:
            level = 0
            window = self.made
            self.made += 1
        else:
            window = self.open[level].pop()
            count[level] -= 1
        if level + length < self.size:
            count[level + length] += 1
            self.open[level + length].append(window)
        return window, level


_ENCODERS: dict[str, WordIds] = {}


def pack(documents: DataFrame, tokenizer: str, window: int = WINDOW, end: int = END, ids: bool = True, remembered: int = REMEMBERED, keep: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if asked, ids (binary,
    uint32 LE).

    A document's ids are its text's plus the closing id ``end``; a null text is empty, so every row, repeated rows and
    null ids too, gives at least one piece. Pieces are written once, with windows local to a partition of the scan
    (sequence_id holds the partition in its upper bits); then the pieces of windows that are not full are packed again over
    all partitions (bit 62 of sequence_id is set). Only places and lengths are shuffled. What the second round leaves open
    is the only padding. An empty table gives no rows. Other columns are not read.

    remembered bounds the words of a generation of a worker's memory; without keep, a worker forgets tokenizer and words after
    each partition. The ids don't depend on either.
    """
    from public_tokenizers import path

    file = path(tokenizer)
    names = NAMES if ids else NAMES[:-1]
    types = ([pa.int64()] * 7 + [pa.binary()])[: len(names)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _ENCODERS.get(file) or WordIds(file, remembered)
        if keep:
            _ENCODERS[file] = encoder
        packer, base = SumOfSquares(window), TaskContext.get().partitionId() << 32
        closing = np.array([end], "<u4").tobytes()
        for batch in batches:
            docs, texts = batch.column(0).to_pylist(), batch.column(1)
            for at in range(0, len(docs), 256):
                rows: list[tuple] = []
                for doc, got in zip(docs[at : at + 256], encoder.encode([x or "" for x in texts.slice(at, 256).to_pylist()])):
                    got += closing
                    n = len(got) // 4
                    for start in range(0, n, window):
                        length = min(window, n - start)
                        seq, offset = packer.add(length)
                        piece = got[4 * start : 4 * (start + length)]
                        rows.append((doc, start, length, zlib.crc32(piece), n, base + seq, offset, piece if ids else None))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for t, c in zip(types, zip(*rows))], names=names)

    schema = ", ".join(f"`{n}` {'binary' if n == 'ids' else 'long'}" for n in names)
    with small_batches(documents.sparkSession):
        pieces = materialize(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(released(run), schema), "pieces")
    moved, rows = repack_open(pieces, window)
    joined = small_join(pieces, moved, ["sequence_id", "offset"], "left", rows)
    put = {"sequence_id": F.coalesce("to", "sequence_id"), "offset": F.coalesce("at", "offset")}
    return joined.select(*[put[n].alias(n) if n in put else n for n in names])


def repack_open(pieces: DataFrame, window: int) -> tuple[DataFrame, int]:
    """(sequence_id, offset, to, at) of the pieces in windows that are not full, with their new places, and their number."""
    fill = F.sum("length").over(Window.partitionBy("sequence_id"))
    loose = materialize(pieces.select("sequence_id", "offset", "length", fill.alias("fill")).where(F.col("fill") < window).drop("fill"), "loose")
    rows = loose.count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, base = SumOfSquares(window), (1 << 62) + (TaskContext.get().partitionId() << 32)
        for batch in batches:
            places = [packer.add(n) for n in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([base + w for w, _ in places], pa.int64()), pa.array([x for _, x in places], pa.int64())], names=["sequence_id", "offset", "to", "at"])

    dealt = loose.repartition(max(1, -(-rows // LOOSE)), "sequence_id", "offset").sortWithinPartitions(F.desc("length"), "sequence_id", "offset")
    return materialize(dealt.mapInArrow(released(run), "sequence_id long, offset long, to long, at long"), "repacked"), rows


NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` as sequences of at most 4096 ids; the ids themselves are left out."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), "word_bpe_49k.json", ids=False)
