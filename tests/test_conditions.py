"""Conditions of advisories in three values: every kind, their order, entry points and attackers' arguments."""

from flowfacts.plans.conditions import ARGUMENTS, CONDITION, PASSED, PRIOR, checked, correlated, decided, exploitable_through
from pyspark.sql import functions as F

SCHEMA = f"n int, conditions array<{CONDITION}>, arguments {ARGUMENTS}, origin string, stays boolean, passed {PASSED}, prior {PRIOR}"
MODE = ("argument", "mode", "mode", 1, ["lib.UNSAFE"], True, False, None)
TAG = ("semantic", "tag", None, None, None, None, None, None)
KEYS = ("keyword_name", "keys", None, None, None, None, None, None)
HOST = ("host", "host", "url", 0, None, None, None, None)
LOGIN = ("sequence", "login first", "verify", None, ["False"], False, False, "Session.login")
ANY = ("sequence", "opened first", None, None, None, None, None, "open")


def args(positional=None, keywords=None, unpacked=False, keys_unpacked=False):
    return (positional or {}, keywords or {}, unpacked, keys_unpacked)


CASES = [
    # conditions, arguments, origin, stays, passed, prior -> met, pending, contradicted, passed
    ([MODE, TAG], args({0: None, 1: "lib.UNSAFE"}), None, False, [], None, ["mode"], ["tag"], None, None),
    ([TAG, MODE, KEYS], args({0: None}, {"mode": "lib.SAFE"}), None, False, [], None, [], ["tag"], "mode", "lib.SAFE"),
    ([MODE], args({0: None}), None, False, [], None, ["mode"], [], None, None),
    ([MODE], args({}, {"mode": None}), None, False, [], None, [], ["mode"], None, None),
    ([MODE], args({}, {}, True), None, False, [], None, [], ["mode"], None, None),
    ([MODE], args({}, {"mode": "None"}, False, True), None, False, [], None, [], [], "mode", "None"),
    ([MODE, KEYS], None, None, False, [], None, [], ["mode", "keys"], None, None),
    ([KEYS], args({}, {"b": "1", "a": None}), None, False, [], None, [], [], "keys", "a, b"),
    ([KEYS], args(), None, False, [], None, [], [], "keys", None),
    ([KEYS], args(keys_unpacked=True), None, False, [(None, "**")], None, ["keys"], [], None, None),
    ([HOST], args({0: None}), "http://h", True, [(0, None)], None, [], [], "host", "'http://h'"),
    ([HOST], args({0: None}), "http://h", False, [(0, None)], None, [], ["the host is fixed by 'http://h', but a redirect may lead elsewhere"], None, None),
    ([HOST], args({0: None}), "http://h", True, [(2, None)], None, [], ["host"], None, None),
    ([LOGIN], args({}, {"verify": "True"}), None, False, [], [("a.Session.login", True, args({}, {"verify": "False"}))], ["login first"], [], None, None),
    ([LOGIN], args({}, {"verify": "True"}), None, False, [], [("a.Session.login", False, args({}, {"verify": "False"}))], [], ["login first"], None, None),
    ([LOGIN], args({}, {"verify": "True"}), None, False, [], [("a.Session.login", True, args({}, {"verify": "True"})), ("a.Session.logout", True, args())], [], [], "login first", None),
    ([LOGIN], args({}, {"verify": None}), None, False, [], [], [], ["login first"], None, None),
    ([LOGIN], args({}, {"verify": "True"}), None, False, [], None, [], ["login first"], None, None),
    ([ANY], args(), None, False, [], [("io.open", True, None)], ["opened first"], [], None, None),
    ([], args(), None, False, [], None, [], [], None, None),
    (None, None, None, None, None, None, [], [], None, None),
]


def test_states_of_conditions(spark):
    rows = spark.createDataFrame([(n, *case[:6]) for n, case in enumerate(CASES)], SCHEMA)
    found = rows.select("n", checked(*[F.col(c) for c in ("conditions", "arguments", "origin", "stays", "passed", "prior")]).alias("c")).select("n", "c.*")
    got = {r.n: (r.met, r.pending, r.contradicted, r.passed) for r in found.collect()}
    for n, case in enumerate(CASES):
        assert got[n] == case[6:], (n, case)


def test_entry_points_and_decisions(spark):
    calls = spark.createDataFrame([(1, "x.lib.parse", args({0: None}), None, False, [], None), (2, "lib.parse", args({0: None}, {"mode": "lib.SAFE"}), None, False, [], None), (3, "lib.other", args(), None, False, [], None)], SCHEMA.replace(f"conditions array<{CONDITION}>", "symbol string"))
    entries = spark.createDataFrame([("A", "lib.parse", [MODE]), ("A", "parse", [KEYS]), ("B", "lib.parse", [MODE, TAG])], f"advisory string, symbol string, conditions array<{CONDITION}>")
    got = {(r.n, r.advisory): (r.entries, r.decision) for r in decided(correlated(calls, entries), ["n", "advisory"]).collect()}
    assert got == {(1, "A"): (2, "reached"), (1, "B"): (1, "review"), (2, "A"): (2, "ruled out"), (2, "B"): (1, "ruled out")}


def test_attackers_arguments(spark):
    attackers = "array<struct<argument:string,position:int,variadic:boolean>>"
    rows = [(1, [], [(0, None)]), (2, [], []), (3, [("url", 0, None)], [(0, None)]), (4, [("url", 0, None)], [(None, "url")]), (5, [("url", 0, None)], [(1, None), (None, "data")]), (6, [("parts", 1, True)], [(3, None)]), (7, [("parts", 1, True)], [(0, None)]), (8, [("url", None, None)], [(None, None)]), (9, None, [(4, None)])]
    df = spark.createDataFrame(rows, f"n int, attackers {attackers}, passed {PASSED}")
    got = {r.n: r.e for r in df.select("n", exploitable_through(F.col("attackers"), F.col("passed")).alias("e")).collect()}
    assert got == {1: True, 2: False, 3: True, 4: True, 5: False, 6: True, 7: False, 8: True, 9: True}
