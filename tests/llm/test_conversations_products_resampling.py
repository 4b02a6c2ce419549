"""Operators 11 to 13 against plain versions, with edge cases."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowfacts.llm import conversation_repair, registry
from flowfacts.llm.conversation_repair import damaged, repair, report
from flowfacts.llm.importance_resampling import resample
from flowfacts.llm.topk_products import Bucket, search_products
from tests.compare import differences

SF = "/root/testdata/sf0.001"
TURNS = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("name", ["op11_conversation_repair", "op12_topk_products", "op13_importance_resampling"])
def test_matches_sql(spark, name):
    assert differences(registry.QUERIES[name](spark, SF), SF, registry.ORACLES[name]) == ""


def plain_report(rows):
    """All edit strings with up to two inserts in a gap are tried; rows: (turn, role, text) in order."""
    faults, seen = [], set()
    for _, role, text in rows:
        last = re.sub(r"[\x20\x09-\x0D]+$", "", text)[-1:]
        faults.append("blank" if not last else "duplicate" if (role, text) in seen else "" if last in ".!?" else "truncated")
        seen.add((role, text))
    best = None
    choices = [[("D", None)] if f in ("blank", "duplicate") else [("D", None), ("K", r[1][:1] or "?"), ("R", "u"), ("R", "a")] for f, r in zip(faults, rows)]
    gaps = [""] + ["".join(g) for n in (1, 2) for g in itertools.product("ua", repeat=n)]
    for edits in itertools.product(*choices):
        for inserts in itertools.product(gaps, repeat=len(rows) + 1):
            initials, audit, cost = inserts[0], "I" * len(inserts[0]), 2 * len(inserts[0])
            for (letter, initial), fault, more in zip(edits, faults, inserts[1:]):
                initials += (initial or "") + more
                audit += letter + "I" * len(more)
                cost += {"D": 3, "K": 0, "R": 2}[letter] + (letter != "D" and fault == "truncated") + 2 * len(more)
            if re.fullmatch("(s?(ua)+)?", initials) and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, initials)
    cost, audit, initials = best
    names, out, i = {"s": "system", "u": "user", "a": "assistant"}, [], 0
    for letter, nth in zip(audit, itertools.count()):
        if letter in "KRI":
            initial = initials[len(out)]
            out.append((rows[i][1] if letter == "K" else names[initial]) + ":" + ("" if letter == "I" else rows[i][2]))
        i += letter != "I"
    turns = {r[0] for r in rows if r[0] is not None}
    count = Counter(faults)
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


def some_conversations():
    rng = random.Random(4)
    texts = ["Yes.", "no", "Why? ", " \t", "", "É!\n", None]
    roles = ["system", "user", "assistant", "assistant", "user", "tool", None, ""]
    return [(c, t if rng.random() < 0.9 else None, rng.choice(roles), rng.choice(texts)) for c in range(60) for t in range(rng.randrange(1, 4))]


def test_op11_equals_a_search_of_all_edits(spark):
    rows = some_conversations()
    got = {r.conv_id: tuple(r)[1:] for r in report(spark.createDataFrame(rows, TURNS)).collect()}
    for c in {r[0] for r in rows}:
        own = [(t, " " if r is None else r, " " if x is None else x) for k, t, r, x in rows if k == c]
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        assert got[c] == plain_report(own), own


def test_op11_cuts_long_conversations_without_a_difference(spark, monkeypatch):
    rng = random.Random(5)
    rows = some_conversations() + [(None, t // 2, rng.choice(["user", "assistant"]), rng.choice(["Yes.", "no", "", f"Number {t % 50}."])) for t in range(900)]
    rows += [(77, None, "user", "Again.")] * 300 + [(78, t * 10, "user" if t % 2 else "assistant", f"{t}.") for t in range(300)]
    df = spark.createDataFrame(rows, TURNS).repartition(7)
    monkeypatch.setattr(conversation_repair, "SEGMENT_BITS", 3)
    for made in (report, repair):
        assert sorted(map(str, made(df, long_rows=5).collect())) == sorted(map(str, made(df).collect()))
        assert sorted(map(str, made(df, long_bytes=100).collect())) == sorted(map(str, made(df).collect()))
    whole = {r.conv_id: r for r in report(df).collect()}
    lines = {}
    for r in sorted(repair(df, long_rows=50).collect(), key=lambda r: r.place):
        lines.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
        assert r.edit in "KRI"
    for c, r in whole.items():
        assert r.repaired_sha256 == hashlib.sha256("\n".join(lines.get(c, [])).encode()).hexdigest()
        assert len(lines.get(c, [])) == len(r.audit) - r.audit.count("D")


def test_op11_damage_missing_conversations_and_edge_cases(spark):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"Text {t}! Yes.") for c in range(40) for t in range(3)] + [(None, None, None, None)]
    df = spark.createDataFrame(rows, TURNS).withColumns({"ending": F.lit("x"), "gone_": F.lit(1), "copy": F.lit(2), "at": F.lit(3)})
    got = Counter((r.conv_id, r.turn, r.role, r.text, r.gone) for r in damaged(df).collect())
    want = Counter()
    for c, t, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        line = (c, t, "user" if kind == 4 else role, "" if kind < 2 else re.sub("[.!?]", "", text) if kind == 2 else text, kind == 0)
        want[line] += 2 if kind == 3 else 1
    assert got == want
    alone = [c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0][:2]
    lost = report(damaged(spark.createDataFrame([(c, 0, "user", "Hello.") for c in alone], TURNS))).collect()
    assert sorted(tuple(r) for r in lost) == [(c, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for c in alone]
    assert report(damaged(df.where("false"))).count() == 0
    wide = report(spark.createDataFrame([(1, -(2**63), "user", "A."), (1, 2**63 - 1, "assistant", "B." * 100_000)], TURNS)).collect()
    assert [(r.gaps, r.audit) for r in wide] == [(2**63 - 1, "KK")]


def plain_products(rows, k, divisor):
    def whole(v):
        if v is None or any(x is None or not math.isfinite(x) for x in v):
            return None
        return [math.floor(1024 * x) for x in v]

    good = [(i, w) for i, w in ((i, whole(v)) for i, v in rows) if i is not None and w is not None]
    out = []
    for q in sorted({i for i, _ in good if i % divisor == 0}):
        best = {}
        for a in [w for i, w in good if i == q]:
            for i, w in good:
                if i != q and len(w) == len(a):
                    best[i] = max(best.get(i, -(2**63)), min(2**63 - 1, sum(x * y for x, y in zip(a, w))))
        out += [(q, n + 1, i, s) for n, (i, s) in enumerate(sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k])]
    return out


@pytest.mark.parametrize("block", [32, 8192])
def test_op12_equals_brute_force(spark, block):
    rng = np.random.RandomState(3)
    centre = rng.standard_normal((6, 8))
    rows = [(i, ((centre[i % 6] + 0.1 * rng.standard_normal(8)) * rng.choice([0.1, 1.0, 30.0])).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[0][1]) for i in range(120)]  # very many copies of one vector
    rows += [(5, rows[7][1]), rows[9], rows[10], (10, rows[11][1]), (None, rows[0][1]), (2000, None), (2010, [1.0, None]), (2020, [float("nan")] * 8), (2030, [0.0] * 8), (2040, []), (2041, []), (2050, [1.0, 2.0]), (2051, [float("inf")] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"d": F.lit(1), "bound": F.lit("x"), "rank": F.lit(2)}).repartition(6)
    got = search_products(df, df.where("vec_id % 10 = 0"), 10, block=block).collect()
    assert sorted(tuple(r) for r in got) == plain_products(rows, 10, 10)
    assert search_products(df.where("false"), df.where("false")).count() == 0


def test_op12_products_beyond_doubles(spark):
    rows = [(i, [float(2**40 + i), 3.0**i, -1.0]) for i in range(12)] + [(20, [1e200, 0.0, 0.0]), (21, [-1e200, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(tuple(r) for r in search_products(df, df.where("vec_id % 5 = 0"), 4).collect()) == plain_products(rows, 4, 5)


@pytest.mark.parametrize("how, d, lengths, most", [("length", 64, (0.1, 3), 3500), ("coordinate", 16, (1, 1.05), 2500)])
def test_op12_prunes_by_length_and_by_coordinate(how, d, lengths, most):
    rng = np.random.RandomState(6)
    x = rng.standard_normal((4000, d))
    x[:40] = x[40] + 0.1 * rng.standard_normal((40, d))
    x = np.floor(1024 * x / np.linalg.norm(x, axis=1, keepdims=True) * rng.uniform(*lengths, (4000, 1)))
    bucket = Bucket(np.arange(4000), x)
    left = []
    for q in range(0, 400, 8):
        got = x @ x[q]
        bound = float(np.sort(np.delete(got, q))[-10])
        pruned, rows = bucket.candidates(x[q], float(np.linalg.norm(x[q])), bound)
        if pruned == how:
            left.append(len(rows))
        assert set(np.nonzero(got >= bound)[0].tolist()) <= set(bucket.ids[rows].tolist())
        ids, scores = bucket.best(q, x[q], bound, 10)
        want = sorted(((-int(s), i) for i, s in enumerate(got) if i != q))[:10]
        assert [(-s, i) for i, s in zip(ids.tolist(), scores)] == want
    assert len(left) > 5 and min(left) < most
    assert bucket.candidates(x[0], 1.0, float(bucket.length[0] * 2))[0] == "none"


def plain_resample(rows, target):
    def grams(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({a: a + 32 for a in range(65, 91)}))
        return len(words), words + [f"{a} {b}" for a, b in zip(words, words[1:])]

    def bucket(gram):
        return zlib.crc32(gram.encode()) % 10_000

    docs = [(d, *grams(t)) for d, t in rows]
    s = Counter(bucket(g) for _, _, gs in docs for g in gs)
    t = Counter(bucket(g) for text in target for g in grams(text)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    out = []
    for d, n, gs in docs:
        gains = [math.floor(1000 * math.log((t[b] + 1) * (all_s + 10_000) / ((s[b] + 1) * (all_t + 10_000)))) for b in map(bucket, gs)]
        weight = sum(gains) // len(gains) if gains else 0
        h = int(hashlib.sha256(f"7:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append([d, len(gs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n >= 20])
    drawn = sorted((r for r in out if r[5]), key=lambda r: (-r[3], r[0] is not None, r[0] or 0, r[2], r[1]))
    for place, r in enumerate(drawn[: 25 * len(drawn) // 100]):
        r[4] = place + 1
    return Counter(tuple(r[:5]) for r in out)


def test_op13_equals_a_plain_version(spark):
    rng = random.Random(9)
    words = ["The", "ÉTÉ", "été", "naïve", "a1", "B2b", "x", "Ünder", "the", "　", "z\x00y"]
    rows = [(i, rng.choice(["", " ", "-- "]) + rng.choice([" ", ", ", "\n"]).join(rng.choice(words) for _ in range(rng.choice([0, 1, 2, 19, 20, 21, 60])))) for i in range(120)]
    rows += [(3, rows[5][1]), rows[9], rows[9], (None, rows[9][1]), (None, None), (200, None), (201, ""), (202, "!!"), (203, "long " * 40_000)]
    target = ["the naïve x", "été a1 a1", None, ""]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"r": F.lit("x"), "bucket": F.lit(1), "b0": F.lit(2), "rank": F.lit(3)}).repartition(5)
    aim = spark.createDataFrame([(t, 1) for t in target], "text string, r long")
    assert Counter(tuple(r) for r in resample(df, aim).collect()) == plain_resample(rows, target)
    assert Counter(tuple(r) for r in resample(df, aim.where("false")).collect()) == plain_resample(rows, [])
    assert resample(df.where("false"), aim).count() == 0
