"""Removal of repeated passages by content-defined line chunks (operator 3). DataFrame functions only.

A text is cut into lines: the pieces that end with a newline or, as prose is often not broken, with a full stop and a
space. White space around a line is left aside, and blank lines count with their neighbours. A rolling hash (cyclic
polynomial) over the hashes of ``WINDOW`` = 3 lines ends a chunk where its two lowest bits are 0, so a chunk has four lines
on average and boundaries depend on what stands there and not on where it stands. Chunks of three lines or more are counted
over the whole table. As a chunk at the edge of a repeated passage takes in a line of its neighbours and then matches
nothing, the finest chunks are counted as well: every two lines that follow one another, and every line of ``LONG_WORDS``
words. All occurrences but the first (smallest doc_id, then place) are marked.

Runs of marked pairs that reach ``MIN_WORDS`` words, and marked long lines, are removed after the bytes under each hash
were compared, by whole chunks where a chunk is marked and by pairs at its edges. Where a hash stands for two texts, its
occurrences are told apart by their bytes. So every repeated passage of more than 50 words in whole lines goes, and each
line that is removed stands before, where it is kept. What is removed does not depend on where chunks end: a chunk that
occurs again consists of pairs that do; the SQL states the rule on pairs and long lines alone.

The text is read three times: for the hashes of its lines, which are written once, for the bytes of marked chunks, and to
take lines out; the last two read the documents with marked lines only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import BROADCAST_ROWS, discard, free_name, keyed_join, materialize

WINDOW = 3
MIN_WORDS = 25
LONG_WORDS = 50
#: Kinds of units: a chunk of three lines or more, a pair of lines, a long line.
CHUNK, PAIR, LONG = 0, 1, 2
_SPACE = " \n\t\r"
_MARK = "\x01"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value evaluated once for all uses, also those inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def lines_of(text: Column) -> Column:
    """array<string> of the lines of a non-null text; joined they give the text."""
    marked = F.replace(F.replace(text, F.lit("\n"), F.lit("\n" + _MARK)), F.lit(". "), F.lit(". " + _MARK))
    cut = F.when(F.contains(text, F.lit(_MARK)), F.split(text, r"(?<=\n)|(?<=\. )")).otherwise(F.split(marked, _MARK))
    return F.filter(cut, lambda x: x != "")


def hashed_lines(text: Column) -> Column:
    """array<struct<place, h, w>>: place, hash and words of the lines that aren't blank."""
    bare = F.filter(F.transform(lines_of(text), lambda x, i: F.struct(F.trim(x, F.lit(_SPACE)).alias("x"), i.alias("i"))), lambda s: s["x"] != "")
    return F.transform(bare, lambda s: F.struct(
        s["i"].alias("place"), F.xxhash64(s["x"]).alias("h"),
        (F.octet_length(s["x"]) - F.octet_length(F.replace(s["x"], F.lit(" "), F.lit(""))) + 1).alias("w")))


def _rolled(h: Column, i: Column) -> Column:
    """The rolling hash over the window that ends with line i."""
    out = F.get(h, i)
    for k in range(1, WINDOW):
        x, turn = F.coalesce(F.get(h, i - k), F.lit(0)), 21 * k
        out = out.bitwiseXOR(F.shiftleft(x, turn).bitwiseOR(F.shiftrightunsigned(x, 64 - turn)))
    return out


def chunk_starts(h: Column) -> Column:
    """array<int>: the places in an array of line hashes where chunks begin."""
    return F.when(F.size(h) > 0, F.filter(F.sequence(F.lit(0), F.size(h) - 1), lambda i: (i == 0) | (_rolled(h, i - 1).bitwiseAND(F.lit(3)) == 0))).otherwise(F.array().cast("array<int>"))


def _cut(h: Column, bits: int) -> Column:
    return h if bits == 64 else h.bitwiseAND(F.lit((1 << bits) - 1))


def _chunks(h: Column) -> Column:
    """array<struct<s, e>>: first and last line of the chunks of three lines or more in an array of line hashes."""

    def of(starts: Column) -> Column:
        ends = F.transform(starts, lambda s, k: F.struct(s.alias("s"), (F.coalesce(F.get(starts, k + 1), F.size(h)) - 1).alias("e")))
        return F.filter(ends, lambda c: c["e"] - c["s"] >= 2)

    return _let(chunk_starts(h), of)


def _chunk_hash(h: Column, c: Column) -> Column:
    return F.xxhash64(F.lit(CHUNK), F.slice(h, c["s"] + 1, c["e"] - c["s"] + 1))


def _hashes(lines: Column, bits: int) -> Column:
    """array<long>: the hashes of the units of hashed lines, and nothing else of them."""
    return _let(lines.getField("h"), lambda h: _hashes_of(lines, h, bits))


def _hashes_of(lines: Column, h: Column, bits: int) -> Column:
    pairs = F.zip_with(F.slice(h, 1, F.greatest(F.size(h) - 1, F.lit(0))), F.slice(h, 2, F.greatest(F.size(h) - 1, F.lit(0))), lambda x, y: _cut(F.xxhash64(F.lit(PAIR), x, y), bits))
    alone = F.transform(F.filter(lines, lambda x: x["w"] >= LONG_WORDS), lambda x: _cut(F.xxhash64(F.lit(LONG), x["h"]), bits))
    return F.concat(F.transform(_chunks(h), lambda c: _cut(_chunk_hash(h, c), bits)), pairs, alone)


def _units(lines: Column, bits: int) -> Column:
    """array<struct<kind, i0, i1, place, upto, h, words, last>> of hashed lines: a chunk's lines are i0..i1 among those that
    aren't blank, at place..upto among all; words are those of all lines but the last of a pair."""

    def unit(kind: int, i0: Column, i1: Column, place: Column, upto: Column, h: Column, words: Column, last: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), i0.cast("int").alias("i0"), i1.cast("int").alias("i1"), place.alias("place"), upto.alias("upto"), _cut(h, bits).alias("h"), words.alias("words"), last.alias("last"))

    n, zero = F.size(lines), F.lit(0)
    both = F.zip_with(F.slice(lines, 1, F.greatest(n - 1, zero)), F.slice(lines, 2, F.greatest(n - 1, zero)), lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    pairs = F.transform(both, lambda p, i: unit(PAIR, i, i + 1, p["x"]["place"], p["y"]["place"], F.xxhash64(F.lit(PAIR), p["x"]["h"], p["y"]["h"]), p["x"]["w"], p["y"]["w"]))
    numbered = F.transform(lines, lambda x, i: F.struct(x.alias("x"), i.alias("i")))
    alone = F.transform(F.filter(numbered, lambda s: s["x"]["w"] >= LONG_WORDS), lambda s: unit(LONG, s["i"], s["i"], s["x"]["place"], s["x"]["place"], F.xxhash64(F.lit(LONG), s["x"]["h"]), s["x"]["w"], zero))
    chunks = _let(lines.getField("h"), lambda h: F.transform(_chunks(h), lambda c: unit(CHUNK, c["s"], c["e"], F.get(lines, c["s"])["place"], F.get(lines, c["e"])["place"], _chunk_hash(h, c), zero, zero)))
    return F.concat(chunks, pairs, alone)


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of wanted (doc_id, th, place, upto, h and others) with their bytes, the lines as compared, in ``bytes``."""
    rest = [c for c in wanted.columns if c not in ("doc_id", "th")]
    by_doc = wanted.groupBy("doc_id", "th").agg(F.collect_set(F.struct(*rest)).alias("w"))
    by_doc = materialize(by_doc.select(F.col("doc_id").alias("d"), F.col("th").alias("t"), "w"), "wanted")
    few = (by_doc.agg(F.sum(F.size("w"))).first()[0] or 0) <= BROADCAST_ROWS
    found = docs.join(F.broadcast(by_doc) if few else by_doc, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("t")))
    bare = F.transform(lines_of(F.col("text")), lambda x: F.trim(x, F.lit(_SPACE)))
    texts = _let(bare, lambda t: F.transform(F.col("w"), lambda u: F.struct(
        *[u[c].alias(c) for c in rest], F.array_join(F.filter(F.slice(t, u["place"] + 1, u["upto"] - u["place"] + 1), lambda x: x != ""), "\n").alias("bytes"))))
    return found.select("doc_id", "th", F.explode(texts).alias("u")).select("doc_id", "th", "u.*")


_AT = ("doc_id", "th", "place")


def _marked(occurrences: DataFrame, by: list[str]) -> DataFrame:
    """The occurrences that aren't the first of their key, with the first one's doc, text and places in ``first``."""
    firsts = materialize(occurrences.groupBy(*by).agg(F.min(F.struct(*_AT, "upto")).alias("first"), F.count("*").alias("n")), "firsts")
    joined = keyed_join(occurrences, firsts, by[0], "inner") if len(by) == 1 else occurrences.join(firsts.drop("n"), by)
    # rows that repeat a doc_id and text are one document
    return joined.where(F.col("doc_id").isNotNull() & ~F.struct(*_AT).eqNullSafe(F.struct(*[F.col("first")[c].alias(c) for c in _AT]))).dropDuplicates(["kind", *_AT])


def _passing(marked: DataFrame) -> DataFrame:
    """Marked pairs in runs of MIN_WORDS words, marked long lines, and marked chunks; ``inner`` tells those of the former that
    lie in one of the latter."""
    pairs = marked.where(F.col("kind") == PAIR)
    pairs = pairs.withColumn("run", F.col("i0") - F.row_number().over(Window.partitionBy("doc_id", "th").orderBy("i0")))
    whole = Window.partitionBy("doc_id", "th", "run")
    pairs = pairs.withColumn(
        "total", F.sum("words").over(whole) + F.max(F.struct("i0", "last")).over(whole)["last"]).where(F.col("total") >= MIN_WORDS).drop("total", "run")
    rows = pairs.unionByName(marked.where(F.col("kind") != PAIR))
    before = Window.partitionBy("doc_id", "th").orderBy("i0", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reach = F.max(F.when(F.col("kind") == CHUNK, F.col("i1"))).over(before)
    return rows.withColumn("inner", (F.col("kind") != CHUNK) & F.coalesce(reach >= F.col("i1"), F.lit(False)))


def _clashes(docs: DataFrame, marked: DataFrame) -> DataFrame:
    """(h) of the hashes that stand for more than one text among marked units and the first occurrences."""
    places = marked.select("doc_id", "th", "place", "upto", "h").unionByName(marked.select("first.doc_id", "first.th", "first.place", "first.upto", "h")).distinct()
    return materialize(_texts(docs, places).select("h", "bytes").distinct().groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "clash")


def repeated_lines(documents: DataFrame, bits: int = 64) -> DataFrame:
    """(doc_id, th, runs: array<struct<lo, hi>>, lines) of the documents that lose lines: th is the text's hash, lo..hi are
    places of lines, in order and apart, lines is their number. bits: of a unit's hash that are used."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text <> ''").withColumn("th", F.xxhash64("text"))
    lines = materialize(docs.select("doc_id", "th", hashed_lines(F.col("text")).alias("lines")), "lines")
    units = lines.select("doc_id", "th", F.explode(_units(F.col("lines"), bits)).alias("u")).select("doc_id", "th", "u.*")
    hashes = lines.select(F.explode(_hashes(F.col("lines"), bits)).alias("h"))
    many = materialize(hashes.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"), "many")
    again = materialize(keyed_join(units, many, "h", "inner"), "again")
    marked = materialize(_marked(again, ["h"]), "marked")
    passing = materialize(_passing(marked), "passing")
    # compare the bytes of what is to be removed and of the first occurrences
    clash = _clashes(docs, passing.where("NOT inner"))
    if clash.count():
        discard(clash)
        clash = _clashes(docs, marked)  # a chunk that clashes vouches for none of its pairs
        told = F.broadcast(clash) if clash.count() <= BROADCAST_ROWS else clash
        exact = _marked(materialize(_texts(docs, again.join(told, "h")), "apart"), ["h", "bytes"]).drop("bytes")
        passing = materialize(_passing(materialize(marked.join(told, "h", "left_anti").unionByName(exact), "marked")), "passing")
    gone = passing.where(F.col("kind") != CHUNK).select("doc_id", "th", F.col("place").alias("lo"), F.col("upto").alias("hi"))
    order = Window.partitionBy("doc_id", "th").orderBy("lo", "hi")
    upto = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = gone.withColumn("new", F.when(F.col("lo") <= upto, 0).otherwise(1)).withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = opened.groupBy("doc_id", "th", "run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    out = materialize(runs.groupBy("doc_id", "th").agg(F.sort_array(F.collect_list(F.struct("lo", "hi"))).alias("runs"), F.sum(F.col("hi") - F.col("lo") + 1).alias("lines")), "cuts")
    for used in (lines, many, again, marked, passing, clash):
        discard(used)
    return out


def dedup_lines(documents: DataFrame, drop_emptied: bool = False, count: str | None = None, bits: int = 64) -> DataFrame:
    """The documents with repeated lines taken out of ``text``; count, if given, names one more column (long) with the
    number of lines taken out.

    All columns are kept, whatever their names; n_chars, if there, follows the text. Null and empty texts stay as they are.
    Rows that repeat a doc_id and its text count as one document: they lose the same lines and never take each other's; a
    repeated doc_id with another text is a document of its own. A null doc_id keeps its text and counts as the first. An
    empty table gives no rows. With drop_emptied, a document that loses its whole text, so that nothing is said there that
    isn't said before, is left out. The work is done when the DataFrame is made, and its result is read from written tables.
    """
    d, t, runs, lines = (free_name(documents, x) for x in ("d", "t", "runs", "lines"))
    cuts = repeated_lines(documents, bits).toDF(d, t, runs, lines)
    few = (cuts.agg(F.sum(F.size(runs))).first()[0] or 0) <= BROADCAST_ROWS
    joined = documents.join(F.broadcast(cuts) if few else cuts, (F.col("doc_id").cast("long") == F.col(d)) & (F.xxhash64("text") == F.col(t)), "left")

    def rest(all_lines: Column) -> Column:
        """What stands before, between and after the runs."""
        edges = F.concat(F.col(runs), F.array(F.struct(F.size(all_lines).alias("lo"), F.size(all_lines).alias("hi"))))
        gaps = F.transform(edges, lambda e, k: F.slice(all_lines, F.when(k == 0, 1).otherwise(F.get(edges, k - 1)["hi"] + 2), e["lo"] - F.when(k == 0, 0).otherwise(F.get(edges, k - 1)["hi"] + 1)))
        return F.array_join(F.flatten(gaps), "")

    text = F.when(F.col(d).isNull(), F.col("text")).otherwise(_let(lines_of(F.col("text")), rest))
    put = {"text": text}
    if "n_chars" in documents.columns:
        put["n_chars"] = F.when(F.col(d).isNull(), F.col("n_chars")).otherwise(F.length(text).cast(documents.schema["n_chars"].dataType))
    if drop_emptied:
        joined = joined.where(F.col(d).isNull() | (F.length(F.trim(text, F.lit(_SPACE))) > 0))
    more = [F.coalesce(F.col(lines), F.lit(0)).cast("long").alias(count)] if count else []
    return joined.select(*[put.get(c, F.col(f"`{c}`")).alias(c) for c in documents.columns], *more)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of ``documents`` without repeated passages."""
    return dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"), count="removed_lines").select("doc_id", "text", "removed_lines")


ORACLE = r"""
WITH u AS (
  SELECT doc_id, i - 1 AS place, list_extract(l, i) AS line FROM (
    SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (
      SELECT doc_id, list_filter(regexp_extract_all(text, '(?s)(?:.*?(?:\n|\. )|.+$)'), lambda x: x <> '') AS l FROM documents WHERE doc_id IS NOT NULL))
), t AS (
  SELECT *, length(line) - length(replace(line, ' ', '')) + 1 AS words, row_number() OVER (PARTITION BY doc_id ORDER BY place) AS j
  FROM (SELECT doc_id, place, trim(line, ' ' || chr(10) || chr(9) || chr(13)) AS line FROM u) WHERE line <> ''
), p AS (
  SELECT doc_id, j, place, words, line AS a, lead(line) OVER w AS b, lead(place) OVER w AS upto, lead(words) OVER w AS last
  FROM t WINDOW w AS (PARTITION BY doc_id ORDER BY place)
), m AS (
  SELECT *, j - row_number() OVER (PARTITION BY doc_id ORDER BY j) AS run
  FROM (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY doc_id, place) AS nth FROM p WHERE b IS NOT NULL) WHERE nth > 1
), r AS (
  SELECT doc_id, min(place) AS lo, max(upto) AS hi FROM m GROUP BY doc_id, run HAVING sum(words) + arg_max(last, j) >= 25
  UNION ALL
  SELECT doc_id, place, place FROM (SELECT *, row_number() OVER (PARTITION BY line ORDER BY doc_id, place) AS nth FROM t WHERE words >= 50) WHERE nth > 1
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(lo, hi + 1)) AS place FROM r
), kept AS (
  SELECT u.doc_id, string_agg(CASE WHEN g.place IS NULL THEN u.line ELSE '' END, '' ORDER BY u.place) AS text, count(g.place) AS removed
  FROM u LEFT JOIN gone g ON g.doc_id = u.doc_id AND g.place = u.place GROUP BY u.doc_id
)
SELECT d.doc_id, CASE WHEN k.doc_id IS NULL THEN d.text ELSE k.text END AS text, coalesce(k.removed, 0)::BIGINT AS removed_lines
FROM documents d LEFT JOIN kept k ON k.doc_id = d.doc_id
"""
