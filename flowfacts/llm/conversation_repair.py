"""Repair of the structure of conversations (operator 11).

The turns of a conversation must read ``(s?(ua)+)?`` by the initials of their roles. A forward Viterbi pass walks the turns
of each conversation over four states of that grammar (nothing yet, after s, after u, after a) and carries for each the
smallest (cost, audit string); after every turn two rounds of insert transitions close the layer, since no gap ever needs
more than two inserted turns. Letters of the audit are the edits' initials: Keep, Rerole, Delete, Insert.

Of two audits of equal cost that end in the same state none begins the other (what is longer has paid for more inserts), so
the least string of a whole is made of least strings of its parts. That lets a conversation of any length be cut: a segment
is a 4 x 4 table of (cost, audit), and the tables of a conversation are multiplied in order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, materialize

#: A conversation of more turns, or more bytes of text, is walked in segments by several tasks.
LONG_ROWS = 4096
LONG_BYTES = 16 << 20
#: Places a segment spans, as a power of two.
SEGMENT_BITS = 12

NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: Role initial -> moves (from, to) of a turn that has it.
MOVES = {"s": ((NOTHING, SYSTEM),), "u": ((NOTHING, USER), (SYSTEM, USER), (ASSISTANT, USER)), "a": ((USER, ASSISTANT),)}
FINAL = (NOTHING, ASSISTANT)
LEGAL = ("su", "ua", "au")
LONGEST = 2**63 - 1

Layer = list  # of four (cost, audit) or None

SUMMARY = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
TURNS = "conv_id long, place long, role string, text string, edit string"


def offer(layer: Layer, state: int, way: tuple[int, str]) -> None:
    if layer[state] is None or way < layer[state]:
        layer[state] = way


def closed(layer: Layer) -> Layer:
    """The layer after up to two inserted turns."""
    for _ in range(2):
        before = list(layer)
        for initial in "ua":
            for p, q in MOVES[initial]:
                if before[p] is not None:
                    offer(layer, q, (before[p][0] + 2, before[p][1] + "I"))
    return layer


def advance(layer: Layer, initial: str, fault: str, copies: int = 1) -> Layer:
    """The closed layer after a turn, and after further copies of it, which must all be deleted."""
    after: Layer = [None] * 4
    extra = 1 if fault == "truncated" else 0
    for p, best in enumerate(layer):
        if best is not None:
            offer(after, p, (best[0] + 3, best[1] + "D"))
    if fault not in ("blank", "duplicate"):
        for letter, initials, price in (("K", initial, 0), ("R", "ua", 2)):
            for name in initials:
                for p, q in MOVES.get(name, ()):
                    if layer[p] is not None:
                        offer(after, q, (layer[p][0] + price + extra, layer[p][1] + letter))
    if copies > 1:
        after = [None if w is None else (w[0] + 3 * (copies - 1), w[1] + "D" * (copies - 1)) for w in after]
    return closed(after)


def start() -> Layer:
    return closed([(0, ""), None, None, None])


def applied(audit: str, turns: Iterable[tuple[str, str]], copies: Iterable[int] | None = None) -> Iterator[tuple[str, str, str]]:
    """(role, text, edit) of the repaired conversation, turn by turn. Its number of turns tells the role at each place."""
    odd = (len(audit) - audit.count("D")) % 2
    place, at, often = 0, 0, iter(copies) if copies is not None else None

    def role() -> str:
        return "user" if (place - odd) % 2 == 0 else "assistant"

    def inserts() -> Iterator[tuple[str, str, str]]:
        nonlocal place, at
        while at < len(audit) and audit[at] == "I":
            yield role(), "", "I"
            place, at = place + 1, at + 1

    yield from inserts()
    for own, text in turns:
        letter = audit[at]
        at += next(often) if often is not None else 1
        if letter != "D":
            yield (own if letter == "K" else role()), text, letter
            place += 1
        yield from inserts()


def digest(turns: Iterable[tuple[str, str, str]]) -> str:
    whole, first = hashlib.sha256(), True
    for role, text, _ in turns:
        whole.update(f"{'' if first else chr(10)}{role}:{text}".encode("utf-8", "surrogatepass"))
        first = False
    return whole.hexdigest()


def ending(text: Column) -> Column:
    """The last character that is no white space ('' if there is none)."""
    return F.substring(F.rtrim(text, F.lit(" \t\n\x0b\x0c\r")), -1, 1)


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, gone: each turn of the table with the damage that crc32(conv_id:turn) % 20 names: 0 gone, 1
    empty, 2 without ends of sentences, 3 said twice, 4 said by the user. Nulls are one space in the key, in role and in text."""
    turn, conv = F.col("turn").cast("long"), F.col("conv_id").cast("long")
    key = F.concat(F.coalesce(conv.cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(turn.cast("string"), F.lit(" ")))
    kind = F.crc32(key.cast("binary")) % 20
    role, text = F.coalesce(F.col("role"), F.lit(" ")), F.coalesce(F.col("text"), F.lit(" "))
    rows = conversations.select(
        conv.alias("conv_id"), turn.alias("turn"), F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind <= 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"), (kind == 0).alias("gone"),
        F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))
    return rows.drop("copy")


def _prepared(rows: DataFrame) -> DataFrame:
    gone = F.coalesce(F.col("gone"), F.lit(False)) if "gone" in rows.columns else F.lit(False)
    text = F.coalesce(F.col("text"), F.lit(" "))
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role"), F.lit(" ")).alias("role"),
                       text.alias("text"), gone.alias("gone"), ending(text).alias("ending"))


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, list[tuple]]]:
    """(conv_id, rows) of each conversation of a sorted partition."""
    now, held, begun = None, [], False
    for batch in batches:
        for conv, *row in zip(*(c.to_pylist() for c in batch.columns)):
            if not begun or conv != now:
                if begun:
                    yield now, held
                now, held, begun = conv, [], True
            held.append(row)
    if begun:
        yield now, held


def _fault(last: str, seen: bool) -> str:
    return "blank" if last == "" else "duplicate" if seen else "" if last in ".!?" else "truncated"


def _walk(rows: list[tuple]) -> tuple[dict[str, int], int, str, list[tuple[str, str]]]:
    """Counts, cost, audit and kept rows of one conversation, given as sorted (turn, role, text, gone, ending)."""
    rows = [r for r in rows if not r[3]]
    counts = {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}
    layer, seen = start(), set()
    for _, role, text, _, last in rows:
        fault = _fault(last, (role, text) in seen)
        seen.add((role, text))
        if fault:
            counts[fault] += 1
        layer = advance(layer, role[:1], fault)
    counts["illegal"] = sum(a[1][:1] + b[1][:1] not in LEGAL for a, b in zip(rows, rows[1:]))
    turns = {r[0] for r in rows if r[0] is not None}
    counts["gaps"] = min(LONGEST, max(turns) - min(turns) + 1 - len(turns)) if turns else 0
    cost, audit = min(layer[s] for s in FINAL if layer[s] is not None)
    return counts, cost, audit, [(r[1], r[2]) for r in rows]


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def lines() -> Iterator[dict]:
        for conv, rows in _conversations(batches):
            counts, cost, audit, kept = _walk(rows)
            yield {"conv_id": conv, **counts, "cost": cost, "audit": audit, "repaired_sha256": digest(applied(audit, kept))}

    yield from _batched(lines(), pa.schema([("conv_id", pa.int64()), *((c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string()), ("repaired_sha256", pa.string())]))


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def lines() -> Iterator[dict]:
        for conv, rows in _conversations(batches):
            _, _, audit, kept = _walk(rows)
            for place, (role, text, edit) in enumerate(applied(audit, kept)):
                yield {"conv_id": conv, "place": place, "role": role, "text": text, "edit": edit}

    yield from _batched(lines(), pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("edit", pa.string())]))


def _batched(lines: Iterator[dict], schema: pa.Schema, rows: int = 1000) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    for line in lines:
        held.append(line)
        if len(held) == rows:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


# --- conversations of many turns ------------------------------------------------------------------------------------------

def _in_order(rows: DataFrame) -> DataFrame:
    """The turns of long conversations as a written table: equal turns are one with their number n, ``first`` tells whether
    role and text were not said before, and ``at`` puts them in order. Every join and group is by a key that few rows have."""
    rows = rows.groupBy("conv_id", "turn", "role", "text", "ending").agg(F.count("*").alias("n")).withColumn("h", F.sha2("text", 256))
    said = rows.groupBy("conv_id", "role", "h").agg(F.when(F.max(F.col("turn").isNull()), F.lit(None)).otherwise(F.min("turn")).cast("long").alias("turn"))
    said = said.select(*[F.col(c).alias(f"_{c}") for c in ("conv_id", "turn", "role", "h")], F.lit(True).alias("first"))
    same = F.lit(True)
    for c in ("conv_id", "turn", "role", "h"):
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    marked = rows.join(said, same, "left").select("conv_id", "turn", "role", "text", "ending", "n", F.coalesce("first", F.lit(False)).alias("first"))
    dealt = marked.repartitionByRange("conv_id", "turn", "role", F.substring("text", 1, 64)).sortWithinPartitions("conv_id", "turn", "role", "text")
    fault = F.when(F.col("ending") == "", "blank").when(~F.col("first"), "duplicate").when(~F.col("ending").isin(".", "!", "?"), "truncated").otherwise("")
    return materialize(dealt.select("conv_id", F.monotonically_increasing_id().alias("at"), "turn", "role", "text", "n", fault.alias("fault")), "long-conversations")


def _tables(group: pa.Table) -> pa.Table:
    """One segment: its table of (cost, audit) by entry and end state, as 16 entries, with its first and last initial."""
    group = group.sort_by("at")
    initials, faults, copies = (group[c].to_pylist() for c in ("initial", "fault", "n"))
    costs, audits = [], []
    for entry in range(4):
        layer: Layer = [None] * 4
        layer[entry] = (0, "")
        for initial, fault, n in zip(initials, faults, copies):
            layer = advance(layer, initial, fault, n)
        costs += [None if w is None else w[0] for w in layer]
        audits += [None if w is None else w[1] for w in layer]
    illegal = sum(a + b not in LEGAL for a, b in zip(initials, initials[1:])) + sum(n - 1 for n in copies)
    return pa.table({"conv_id": group["conv_id"][:1], "segment": group["segment"][:1], "costs": pa.array([costs], pa.list_(pa.int64())), "audits": pa.array([audits], pa.list_(pa.string())),
                     "illegal": pa.array([illegal], pa.int64()), "begin": pa.array([initials[0]]), "end": pa.array([initials[-1]])})


def _multiplied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """conv_id, cost, audit, illegal of the conversations whose segments come in order; one table at a time is held."""
    schema = pa.schema([("conv_id", pa.int64()), ("cost", pa.int64()), ("audit", pa.string()), ("illegal", pa.int64())])

    def done(conv, layer, illegal) -> pa.RecordBatch:
        cost, audit = min(layer[s] for s in FINAL if layer[s] is not None)
        return pa.RecordBatch.from_pylist([{"conv_id": conv, "cost": cost, "audit": audit, "illegal": illegal}], schema)

    now, layer, illegal, end, begun = None, start(), 0, None, False
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            if not begun or row["conv_id"] != now:
                if begun:
                    yield done(now, layer, illegal)
                now, layer, illegal, end, begun = row["conv_id"], start(), 0, None, True
            after: Layer = [None] * 4
            for p in range(4):
                for q in range(4):
                    cost = row["costs"][4 * p + q]
                    if layer[p] is not None and cost is not None:
                        offer(after, q, (layer[p][0] + cost, layer[p][1] + row["audits"][4 * p + q]))
            illegal += row["illegal"] + (end is not None and end + row["begin"] not in LEGAL)
            layer, end = after, row["end"]
    if begun:
        yield done(now, layer, illegal)


def _with_audit(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """The turns of each conversation in order, its audit ahead of them."""
    head = audits.select("conv_id", F.lit(-1).cast("long").alias("at"), F.lit("").alias("role"), F.col("audit").alias("text"), F.lit(0).cast("long").alias("n"))
    return rows.select("conv_id", "at", "role", "text", "n").unionByName(head).repartition("conv_id").sortWithinPartitions("conv_id", "at").select("conv_id", "role", "text", "n")


def _long_turns(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, Iterator[tuple[str, str, str]]]]:
    """(conv_id, repaired turns) of each conversation, as a stream: its audit and one batch are held."""
    rows = ((conv, role, text, n) for batch in batches for conv, role, text, n in zip(*(c.to_pylist() for c in batch.columns)))
    head = next(rows, None)
    while head is not None:
        conv, audit, waiting = head[0], head[2], []

        def turns() -> Iterator[tuple[str, str]]:
            for row in rows:
                if row[3] == 0:
                    waiting.append(row)
                    return
                often.append(row[3])
                yield row[1], row[2]

        often: list[int] = []
        yield conv, applied(audit, turns(), iter(lambda: often.pop(), None))
        head = waiting[0] if waiting else None


def _long_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from _batched(({"conv_id": conv, "repaired_sha256": digest(turns)} for conv, turns in _long_turns(batches)), pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())]))


def _long_repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    lines = ({"conv_id": conv, "place": place, "role": role, "text": text, "edit": edit} for conv, turns in _long_turns(batches) for place, (role, text, edit) in enumerate(turns))
    yield from _batched(lines, pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("edit", pa.string())]))


def _audits(rows: DataFrame) -> DataFrame:
    narrow = rows.select("conv_id", F.shiftright("at", SEGMENT_BITS).alias("segment"), "at", F.substring("role", 1, 1).alias("initial"), "fault", "n")
    tables = narrow.groupBy("conv_id", "segment").applyInArrow(_tables, "conv_id long, segment long, costs array<long>, audits array<string>, illegal long, begin string, end string")
    return tables.repartition("conv_id").sortWithinPartitions("conv_id", "segment").mapInArrow(_multiplied, "conv_id long, cost long, audit string, illegal long")


def _split(rows: DataFrame, long_rows: int, long_bytes: int) -> tuple[DataFrame, DataFrame | None]:
    """The rows of short conversations, dealt and sorted; those of long ones, or None if there are none."""
    rows = _prepared(rows)
    sizes = rows.where("NOT gone").groupBy(F.col("conv_id").alias("_conv")).agg(F.count("*").alias("rows"), F.sum(F.octet_length("text")).alias("bytes"))
    long = materialize(sizes.where((F.col("rows") > long_rows) | (F.col("bytes") > long_bytes)).select("_conv"), "long-ids")
    n = long.count()
    kept, of_long = rows, None
    if n:
        side = F.broadcast(long) if n <= BROADCAST_ROWS else long
        same = F.col("conv_id").eqNullSafe(F.col("_conv"))
        kept, of_long = rows.join(side, same, "left_anti"), rows.where("NOT gone").join(side, same, "left_semi")
    return kept.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text"), of_long


def report(rows: DataFrame, long_rows: int = LONG_ROWS, long_bytes: int = LONG_BYTES) -> DataFrame:
    """One row per conversation of rows (conv_id, turn, role, text and, if it is there, a boolean ``gone``: the row only names
    its conversation): conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Turns are in order of turn (nulls first), then role, then text. Null roles and texts are one space; a role whose initial
    is not s, u or a (an empty one, too) is illegal and can't be kept as it is; null ids are one conversation, repeated rows are duplicates.
    A conversation without turns has zeros, an empty audit and the hash of an empty string. Text of any length is read whole.
    Other columns, whatever their names, are not read; an empty table gives no rows. gaps beyond a long are the largest long.

    Conversations go to tasks by id and are held one at a time. Those of more than long_rows turns or long_bytes bytes are
    dealt by ranges of turns: segments of up to 4,096 places each become a table, tables are multiplied in order, and the
    texts pass a hash as a stream. Finding these reads sizes alone; that one job runs when the DataFrame is made.
    """
    short, long = _split(rows, long_rows, long_bytes)
    out = short.mapInArrow(_summaries, SUMMARY)
    if long is None:
        return out
    rows = _in_order(long)
    audits = materialize(_audits(rows), "audits")
    later = F.when(F.col("fault") == "blank", 0).otherwise(F.col("n") - 1)
    distinct = F.count_distinct("turn")
    counts = rows.groupBy(F.col("conv_id").alias("_conv")).agg(
        F.when(distinct == 0, 0).otherwise(F.max("turn").cast("decimal(38,0)") - F.min("turn") + 1 - distinct).alias("gaps"),
        F.sum(F.when(F.col("fault") == "blank", F.col("n")).otherwise(0)).alias("blank"),
        F.sum(F.when(F.col("fault") == "duplicate", 1).otherwise(0) + later).alias("duplicate"), F.count_if(F.col("fault") == "truncated").alias("truncated"))
    digests = _with_audit(rows, audits).mapInArrow(_long_digests, "conv_id long, repaired_sha256 string").withColumnRenamed("conv_id", "_other")
    joined = audits.join(counts, F.col("conv_id").eqNullSafe(F.col("_conv"))).join(digests, F.col("conv_id").eqNullSafe(F.col("_other")))
    return out.unionByName(joined.select("conv_id", F.least("gaps", F.lit(LONGEST)).cast("long").alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"))


def repair(rows: DataFrame, long_rows: int = LONG_ROWS, long_bytes: int = LONG_BYTES) -> DataFrame:
    """The repaired turns themselves: conv_id, place (from 0), role, text, edit (K, R or I); rows and rules as in ``report``."""
    short, long = _split(rows, long_rows, long_bytes)
    out = short.mapInArrow(_repaired, TURNS)
    if long is None:
        return out
    rows = _in_order(long)
    return out.unionByName(_with_audit(rows, materialize(_audits(rows), "audits")).mapInArrow(_long_repaired, TURNS))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report on all ``conversations`` after the stated damage."""
    return report(damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


def crc32_sql(text: str) -> str:
    """DuckDB SQL of the unsigned crc32 of a text's UTF-8 bytes: eight shifts a byte, by the polynomial 0xEDB88320."""
    octets = f"list_transform(range(strlen({text})), lambda i: ('0x' || substr(hex({text}), 2 * i + 1, 2))::BIGINT)"
    return (f"xor(list_reduce([4294967295::BIGINT] || {octets}, lambda c, b: list_reduce([xor(c, b)] || repeat([0::BIGINT], 8), "
            "lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)")


def _sql_way(state: str, price: str, letters: str, condition: str = "") -> str:
    way = f"{{'c': {state}.c + {price}, 'a': {state}.a || '{letters}'}}"
    return f"CASE WHEN {condition} THEN {way} END" if condition else way


def _sql_step() -> str:
    """The four states after a turn, from v0 .. v3, before inserts."""
    sound, extra = "fault NOT IN ('blank', 'duplicate')", "(fault = 'truncated')::BIGINT"
    out = []
    for q in range(4):
        ways = [_sql_way(f"v{q}", "3", "D")]
        for initial, moves in MOVES.items():
            for p, to in moves:
                if to == q:
                    ways.append(_sql_way(f"v{p}", extra, "K", f"{sound} AND initial = '{initial}'"))
                    if initial != "s":
                        ways.append(_sql_way(f"v{p}", f"2 + {extra}", "R", sound))
        out.append(f"list_min([{', '.join(ways)}]) AS w{q}")
    return ", ".join(out)


_CLOSED = (f"w0 AS v0, w1 AS v1, list_min([w2, {_sql_way('w0', '2', 'I')}, {_sql_way('w1', '2', 'I')}, {_sql_way('w3', '2', 'I')}]) AS v2, "
           f"list_min([w3, {_sql_way('w2', '2', 'I')}, {_sql_way('w0', '4', 'II')}, {_sql_way('w1', '4', 'II')}]) AS v3")

#: The same walk as a recursion over turns; unreachable states cost 10^12.
ORACLE = f"""
WITH RECURSIVE hit AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc32_sql("concat(coalesce(conv_id::VARCHAR, ' '), ':', coalesce(turn::VARCHAR, ' '))")} % 20 AS kind FROM conversations),
hurt AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM hit, range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)),
placed AS (
  SELECT *, row_number() OVER w AS i, right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS ending, left(role, 1) AS initial, left(lag(role) OVER w, 1) AS before
  FROM hurt WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
faulty AS (
  SELECT *, CASE WHEN ending = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN ending NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM placed),
walk AS (
  SELECT conv_id, 0::BIGINT AS i, {_CLOSED} FROM (SELECT DISTINCT conv_id, {{'c': 0::BIGINT, 'a': ''}} AS w0, {{'c': 1000000000000::BIGINT, 'a': ''}} AS w1, {{'c': 1000000000000::BIGINT, 'a': ''}} AS w2, {{'c': 1000000000000::BIGINT, 'a': ''}} AS w3 FROM conversations)
  UNION ALL
  SELECT conv_id, i, {_CLOSED} FROM (
    SELECT faulty.conv_id, faulty.i, {_sql_step()} FROM walk JOIN faulty ON faulty.conv_id IS NOT DISTINCT FROM walk.conv_id AND faulty.i = walk.i + 1)),
best AS (
  SELECT conv_id, (list_min([arg_max(v0, i), arg_max(v3, i)])).c AS cost, (list_min([arg_max(v0, i), arg_max(v3, i)])).a AS audit FROM walk GROUP BY conv_id),
letters AS (
  SELECT conv_id, audit, k, substr(audit, k, 1) AS letter, length(replace(substr(audit, 1, k), 'I', '')) AS i, length(replace(substr(audit, 1, k), 'D', '')) - 1 - length(replace(audit, 'D', '')) % 2 AS place
  FROM (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS k FROM best)),
repaired AS (
  SELECT l.conv_id, string_agg(CASE letter WHEN 'K' THEN f.role ELSE CASE WHEN place % 2 = 0 THEN 'user' ELSE 'assistant' END END || ':' || CASE letter WHEN 'I' THEN '' ELSE f.text END, chr(10) ORDER BY k) AS whole
  FROM letters l LEFT JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM l.conv_id AND f.i = l.i WHERE letter <> 'D' GROUP BY l.conv_id),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (i > 1 AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM faulty GROUP BY conv_id)
SELECT b.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, cost, audit, sha256(coalesce(whole, '')) AS repaired_sha256
FROM best b LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM b.conv_id LEFT JOIN repaired r ON r.conv_id IS NOT DISTINCT FROM b.conv_id
"""
