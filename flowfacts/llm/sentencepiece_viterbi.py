"""SentencePiece encoding and decoding by a streaming search over piece boundaries (operator 7).

A text becomes a space mark, then the text with its spaces as space marks. The model is a BPE model: from single characters
on, the neighbours whose union is the piece of the best score (the leftmost at equal scores) are merged until none is left.
A row of pieces is what the merges give exactly if each two neighbours in it are what the merges give for the two alone, so
each boundary has one last piece, and the search goes over boundaries as Viterbi does, with this test in place of sums. A
character that no piece covers stands alone and becomes its UTF-8 bytes. The search keeps the last ``longest`` positions
only, since no piece reaches further back, and hands out ids as soon as the paths of all positions meet in one boundary.

Where the model's pieces show that no piece reaches from letters to other characters or before the space mark that follows
them, all paths meet in the boundaries between such runs, whatever stands around them. So the search commits there, and a worker
remembers what it committed for a short run; ids of every run come from the search.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE = "▁"
#: Stands for a space mark that was in the text itself: it is written as bytes, so that decoding gives it back.
LITERAL = "▁"
#: Runs, and pairs of pieces, that a worker remembers; about 200 bytes each.
REMEMBERED = 1_500_000
#: Runs of up to so many characters are remembered.
LONG_RUN = 64
LETTER = re.compile(r"[^\W\d_¹²³]")
RUN = re.compile(r" *(?:[^\W\d_¹²³]+|(?:[\d_¹²³]|[^\w ])+)| +")
_NONE = float("-inf")
_MISS = ()


class Pieces:
    """A model file's pieces, scores and bytes."""

    def __init__(self, file: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=file)
        n = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i))]
        self.byte = np.full(256, -1)
        for i in range(n):
            if model.is_byte(i):
                self.byte[int(names[i][3:5], 16)] = i
        if (self.byte < 0).any():
            raise ValueError("the model has no byte pieces")
        self.longest = max(len(names[i]) for i in plain)
        #: every prefix of a piece, with (score, id) where it is a piece; spaces stand for space marks
        self.prefix: dict[str, tuple[float, int] | None] = {}
        for i in plain:
            name = names[i].replace(SPACE, " ")
            for k in range(1, len(name)):
                self.prefix.setdefault(name[:k], None)
            self.prefix[name] = (model.get_score(i), i)
        pairs = {pair for i in plain for pair in zip(names[i].replace(SPACE, " "), names[i].replace(SPACE, " ")[1:])}
        #: no piece has a space behind another character, or a letter beside a character that is neither letter nor space
        self.meets = not any(a != " " and (b == " " or bool(LETTER.match(a)) != bool(LETTER.match(b))) for a, b in pairs)
        #: whether two pieces stay two when merged together
        self.pairs: dict[tuple[str, str], bool] = {}
        self.text = [b""] * n
        for i in plain:
            self.text[i] = names[i].replace(SPACE, " ").encode()
        for b, i in enumerate(self.byte):
            self.text[i] = bytes([b])


    def merged(self, text: str) -> list[str]:
        """The pieces that merging gives for a short text; characters no piece covers stand alone."""
        parts, prefix = list(text), self.prefix
        scores = [prefix.get(a + b) for a, b in zip(parts, parts[1:])]
        while True:
            best, at = _NONE, -1
            for k, got in enumerate(scores):
                if got and got[0] > best:
                    best, at = got[0], k
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del scores[at]
            if at:
                scores[at - 1] = prefix.get(parts[at - 1] + parts[at])
            if at < len(scores):
                scores[at] = prefix.get(parts[at] + parts[at + 1])

    def fits(self, left: str, right: str) -> bool:
        """Whether right may stand behind left (empty at the start of a text)."""
        got = self.pairs.get((left, right))
        if got is None:
            if len(self.pairs) > REMEMBERED:
                self.pairs.clear()
            got = self.pairs[left, right] = self.merged(left + right) == ([left, right] if left else [right])
        return got

    def ids(self, part: str) -> tuple[int, ...]:
        got = self.prefix.get(part)
        return got[1:] if got else tuple(int(self.byte[b]) for b in part.encode("utf-8", "surrogatepass"))


class Stream:
    """The search over characters that come in portions; ids come out as soon as they are certain.

    Boundaries are numbered from the last certain one. last[p] is the only last piece that merging gives for the text up to
    boundary p (None while it isn't found), back[p] the boundary before it; only the boundaries within the longest piece
    behind the current one can still be extended. When the current boundary is the furthest that any piece begun so far
    ends at, every path runs through it. Otherwise, whenever the undecided part has doubled, the paths are traced back to
    their latest common boundary.
    """

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.pending = ""  # characters from the current boundary on, kept until the longest piece would fit
        self._reset("")

    def _reset(self, last: str) -> None:
        self.at, self.far, self.back, self.last = 0, 0, [0], [last]
        self.check = 4 * self.pieces.longest

    def push(self, text: str, last: bool = False) -> list[int]:
        """Ids that became certain with these characters."""
        out: list[int] = []
        pending = self.pending + text if self.pending else text
        prefix, longest, fits, known = self.pieces.prefix.get, self.pieces.longest, self.pieces.fits, self.pieces.pairs.get
        at, far, back, names = self.at, self.far, self.back, self.last
        i, n = 0, len(pending)
        stop = n if last else n - longest
        while i < stop:
            before, p = names[at], at
            end = i + longest if i + longest < n else n
            room = at + end - i + 1 - len(names)
            if room > 0:
                names += [None] * room
                back += [0] * room
            for j in range(i + 1, end + 1):
                p += 1
                part = pending[i:j]
                got = prefix(part, _MISS)
                if got is _MISS and p > at + 1:
                    break
                if names[p] is None and (got or p == at + 1):
                    fit = known((before, part))
                    if fits(before, part) if fit is None else fit:
                        back[p], names[p] = at, part
                        if p > far:
                            far = p
                if got is _MISS:
                    break
            i += 1
            at += 1
            if far == at:
                if back[at] == 0:  # one piece reaches from the last certain boundary to this one
                    out += self.pieces.ids(names[at])
                else:
                    out += self._path(at)
                self._reset(names[at])
                at, far, back, names = 0, 0, self.back, self.last
            elif at >= self.check:
                done = self._meeting(at)
                if done:
                    out += self._path(done)
                    self.last = names[done:]
                    self.back = [max(0, p - done) for p in back[done:]]
                    at, far = at - done, far - done
                    back, names = self.back, self.last
                    self.check = at + 4 * longest
                else:
                    self.check = 2 * at
        self.pending, self.at, self.far = pending[i:], at, far
        return out

    def _path(self, to: int) -> list[int]:
        """Ids of the path from the last certain boundary to this one."""
        parts = []
        while to:
            parts.append(self.last[to])
            to = self.back[to]
        return [x for part in reversed(parts) for x in self.pieces.ids(part)]

    def _meeting(self, at: int) -> int:
        """The latest boundary that all paths share; 0 if only the last certain one."""
        alive = {p for p in range(at, len(self.last)) if self.last[p] is not None}
        while len(alive) > 1:
            p = max(alive)
            alive.remove(p)
            alive.add(self.back[p])
        return min(alive.pop(), at)


class Codec:
    """Encodes texts to little-endian unsigned 32-bit ids and back."""

    def __init__(self, file: str):
        self.pieces = Pieces(file)
        self.memory: dict[str, bytes] = {}

    def run(self, text: str) -> bytes:
        """Ids of a run, by the search."""
        ids = Stream(self.pieces).push(text, True)
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if not self.pieces.meets:
            stream, out = Stream(self.pieces), []
            for at in range(0, len(text) + 1, 4096):
                out += stream.push((" " + text)[at : at + 4096], at + 4096 > len(text))
            return np.array(out, "<u4").tobytes()
        memory = self.memory
        if len(memory) > REMEMBERED:
            memory.clear()
        out = []
        for word in RUN.findall(" " + text):
            got = memory.get(word)
            if got is None:
                got = self.run(word)
                if len(word) <= LONG_RUN:
                    memory[word] = got
            out.append(got)
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        raw = b"".join(map(self.pieces.text.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        return raw.decode("utf-8", "surrogatepass")[1:]


_CODECS: dict[str, Codec] = {}


def encode_documents(documents: DataFrame, model: str, ids: bool = True) -> DataFrame:
    """One row per input row: doc_id, n_ids, ids_crc32, round_trip and, if asked, ids (binary, uint32 LE).

    round_trip tells that decoding the ids gives back the text. A null or empty text has no ids (crc32 0, round trip
    true). Texts of any length are read whole; repeated rows and null ids are each answered; an empty table gives no rows.
    Other columns are not read. There is no shuffle.
    """
    from public_tokenizers import path

    file = path(model)
    names = ["doc_id", "n_ids", "ids_crc32", "round_trip", "ids"][: 5 if ids else 4]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _CODECS.get(file) or _CODECS.setdefault(file, Codec(file))
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [x or "" for x in part.column(1).to_pylist()]
                coded = [codec.encode(t) for t in texts]
                columns = [part.column(0), pa.array([len(c) // 4 for c in coded], pa.int64()), pa.array([zlib.crc32(c) for c in coded], pa.int64()),
                           pa.array([codec.decode(c) == t for c, t in zip(coded, texts)], pa.bool_())]
                yield pa.RecordBatch.from_arrays(columns + ([pa.array(coded, pa.binary())] if ids else []), names=names)

    schema = "doc_id long, n_ids long, ids_crc32 long, round_trip boolean" + (", ids binary" if ids else "")
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, model: str) -> DataFrame:
    """doc_id and text of rows with ids; null ids of a row give a null text."""
    from public_tokenizers import path

    file = path(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _CODECS.get(file) or _CODECS.setdefault(file, Codec(file))
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([None if c is None else codec.decode(c) for c in batch.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text of ``documents``, decoded again; the ids themselves are left out."""
    return encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), "piece_bpe_32k.model", ids=False)
