"""Lattice fixpoints against a plain worklist, class orders against the interpreter's own, matched calls on small projects."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from flowfacts.frontend import models, tables, taint
from flowfacts.frontend.summaries import summary_table
from flowfacts.operators.hierarchy import ancestors, members
from flowfacts.operators.lattice import interval_of, intervals, solve, widened


def test_solve_equals_a_plain_worklist(spark):
    """Bits along random graphs with cycles: an equation passes its operand's bits through a mask; two graphs at once."""
    rng = random.Random(1)
    edges = [(g, n, rng.randrange(40), rng.randrange(40), rng.randrange(1, 64)) for g in "ab" for n in range(70)]
    seeds = [(g, rng.randrange(40), 1 << rng.randrange(6)) for g in "ab" for _ in range(6)]
    want = {}
    for g, v, bits in seeds:
        want[g, v] = want.get((g, v), 0) | bits
    while True:
        before = dict(want)
        for g, _, src, dst, mask in edges:
            if want.get((g, src), 0) & mask:
                want[g, dst] = want.get((g, dst), 0) | want[g, src] & mask
        if want == before:
            break
    equations = spark.createDataFrame([(g, n, dst, mask) for g, n, _, dst, mask in edges], "graph string, equation long, variable long, mask long")
    operands = spark.createDataFrame([(g, n, 0, src) for g, n, src, _, _ in edges], "graph string, equation long, place int, operand long")
    passed = F.col("states")[F.lit(0)]["bits"].bitwiseAND(F.col("mask"))
    got = solve(spark.createDataFrame(seeds, "graph string, variable long, bits long"), equations, operands, {"bits": F.when(passed != 0, passed)}, {"bits": "bit_or"}, ["graph"])
    assert {(r.graph, r.variable): r.bits for r in got.collect()} == want


def test_solve_counts_down_without_widening_and_reports_endless_chains(spark):
    seeds = spark.createDataFrame([("g", 0, 0.0, 0.0)], "graph string, variable long, low double, high double")
    equations = spark.createDataFrame([("g", 0, 0, "binary", "Add")], "graph string, equation long, variable long, name string, text string")
    operands = spark.createDataFrame([("g", 0, 0, 0), ("g", 0, 1, 1)], "graph string, equation long, place int, operand long")
    one = spark.createDataFrame([("g", 1, 1.0, 1.0)], seeds.schema)
    args = (seeds.unionByName(one), equations, operands, interval_of(F.col("name"), F.col("text"), F.col("states")), {"low": "min", "high": "max"}, ["graph"])
    with pytest.raises(ValueError, match="no fixpoint"):
        solve(*args, rounds=6)
    assert {(r.variable, r.low, r.high) for r in solve(*args, widen=widened).collect()} == {(0, 0.0, float("inf")), (1, 1.0, 1.0)}
    assert solve(seeds.where("false"), *args[1:]).count() == 0


def test_intervals_hold_what_programs_compute(spark):
    rng = random.Random(3)
    programs = {}
    for k in range(12):
        lines, names = [], ["a", "b", "c"]
        for _ in range(6):
            op = rng.choice(["+", "-", "*", "//", "%"])
            right = rng.choice([*names, *"1234"]) if op in "+-*" else rng.choice("1234")
            lines.append(f"        {rng.choice(names)} = {rng.choice(names)} {op} {right}")
        programs[f"p/m{k}.py"] = f"def work(n):\n    a, b, c = {rng.randrange(9)}, {rng.randrange(9)}, {rng.randrange(9)}\n    a = {rng.randrange(9)}\n    b = {rng.randrange(9)}\n    c = {rng.randrange(9)}\n    for i in range(n):\n" + "\n".join(lines) + "\n    r = a + b\n    return r\n"
    made = tables.facts(spark.createDataFrame(list(programs.items()), "path string, text string"))
    results = tables.of(made, "instruction").where("name = 'return' AND function = 'work'").select("path", "function", "a", "b").join(tables.of(made, "operand").select("path", "function", "a", "b", F.col("c").alias("value")), ["path", "function", "a", "b"])
    got = {r.path: (r.low, r.high) for r in intervals(made).join(results, ["path", "function", "value"]).collect()}
    for path, text in programs.items():
        space = {}
        exec(text, space)  # the test's own text
        for n in range(6):
            low, high = got[path]
            assert low <= space["work"](n) <= high, (path, text, got[path])


def random_hierarchy(rng):
    bases = {}
    for k in range(30):
        bases[f"C{k}"] = rng.sample([f"C{j}" for j in range(k)] + ["ext.E"], min(k + 1, rng.choice([0, 1, 1, 2, 3])))
    return bases


def test_ancestors_are_in_the_interpreters_order(spark):
    rng = random.Random(2)
    rows, want = [], {}
    for n in range(4):
        made, bases = {"ext.E": type("E", (), {})}, random_hierarchy(rng)
        for name, own in bases.items():
            rows += [(f"{n}.{name}", k, b if b == "ext.E" else f"{n}.{b}") for k, b in enumerate(own)]
            try:
                made[name] = type(name, tuple(made[b] for b in own), {}) if all(b in made for b in own) else None
            except TypeError:
                made[name] = None
            if made.get(name) is None:
                made.pop(name, None)
                want[f"{n}.{name}"] = [f"{n}.{name}"]
            else:
                want[f"{n}.{name}"] = ["ext.E" if c.__name__ == "E" else f"{n}.{c.__name__}" for c in made[name].__mro__[:-1]]
    rows += [("loop.A", 0, "loop.B"), ("loop.B", 0, "loop.A"), ("loop.C", 0, "loop.A"), ("loop.D", 0, "loop.D")]
    want |= {f"loop.{c}": [f"loop.{c}"] for c in "ABCD"}
    classes = spark.createDataFrame([(c,) for c in want] * 2, "class string")
    got = {}
    for r in ancestors(classes, spark.createDataFrame(rows, "class string, position int, base string")).orderBy("class", "place").collect():
        got.setdefault(r["class"], []).append(r.ancestor)
        assert r.own == (r.ancestor != "ext.E")
    assert got == want
    assert len([c for c, line in want.items() if len(line) > 1]) > 40 and len([c for c, line in want.items() if len(line) == 1]) > 10


def test_members_are_those_of_the_first_ancestor(spark):
    lines = spark.createDataFrame([("A", 0, "A", True), ("A", 1, "B", True), ("A", 2, "x.E", False), ("A", 3, "C", True), ("B", 0, "B", True)], "class string, place int, ancestor string, own boolean")
    held = spark.createDataFrame([("B", "m"), ("C", "m"), ("C", "n"), ("A", "k")], "owner string, member string")
    asked = spark.createDataFrame([("A", m) for m in "mnko"] + [("B", "n")], "class string, member string")
    got = {(r["class"], r.member): (r.owner, r.outside) for r in members(asked, lines, held).collect()}
    assert got == {("A", "m"): ("B", None), ("A", "n"): ("C", "x.E"), ("A", "k"): ("A", None), ("A", "o"): (None, "x.E"), ("B", "n"): (None, None)}


HELPER = "def same(v):\n    return v\n\ndef none(v):\n    return 'x'\n\ndef deep(n, v):\n    if n:\n        return deep(n - 1, same(v))\n    return v\n\ndef forever(v):\n    return forever(v)\n"


def flows_of(spark, body, more=()):
    files = [("a/__init__.py", ""), ("a/helper.py", HELPER), ("a/main.py", "import os\nimport shlex\nfrom . import helper\n" + body), *more]
    return sorted((r.function, r.line) for r in taint.flows(tables.facts(spark.createDataFrame(files, "path string, text string"), models.prefixes(), nodes=False)).collect())


def test_values_return_to_their_own_callers(spark):
    body = "".join(f"def f{k}():\n    x = helper.same({a})\n    os.system(helper.deep(2, {b}))\n" for k, (a, b) in enumerate(itertools.product(["input()", "'c'"], ["x", "'c'"])))
    assert flows_of(spark, body + "def g():\n    os.system(helper.forever(input()))\n    os.system(helper.none(input()))\n    os.system(shlex.quote(helper.same(input())))\n") == [("f0", 6)]


def test_a_cycle_of_thirty_modules_ends(spark):
    chain = [(f"a/m{k}.py", f"from .m{(k + 1) % 30} import go as on\ndef go(v, n):\n    if n == {k}:\n        return v\n    return on(v, n)\n") for k in range(30)]
    assert flows_of(spark, "from .m0 import go\ndef f():\n    os.system(go(input(), 3))\ndef g():\n    os.system(go('c', input()))\n", chain) == [("f", 6)]


def test_summaries_say_what_survives(spark):
    text = "import shlex, html\ndef both(a, b):\n    return shlex.quote(a) + html.escape(b)\ndef outer(x, y):\n    return both(b=x, a=html.escape(y))\n"
    made = tables.facts(spark.createDataFrame([("m.py", text)], "path string, text string"), (), nodes=False)
    got = {(r.function, r["index"]): r.mask for r in summary_table(made, taint.resolved(made)).collect()}
    command, page = models.KINDS["command"], models.KINDS["html"]
    assert got == {("both", 0): models.ALL - command, ("both", 1): models.ALL - page, ("outer", 0): models.ALL - page, ("outer", 1): models.ALL - command - page}


def test_tables_of_rounds_are_not_sent_whole(spark, monkeypatch):
    """Beyond few rows no side of a round's joins goes by way of the driver; bits along a chain and around its end's cycle."""
    from pyspark.sql import functions as F

    from flowfacts.operators import lattice, tables

    plans = []

    def noted(df, name, by=None):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return tables.written(df, name, by)

    for module in (lattice, tables):
        monkeypatch.setattr(module, "SENT_ROWS", 0, raising=False)
    monkeypatch.setattr(lattice, "written", noted)
    links = [("p", f"e{n}", 0, n, n + 1) for n in range(4)] + [("p", "back", 0, 4, 2)]
    rows = spark.createDataFrame(links, "k string, equation string, place int, operand long, variable long")
    seeds = spark.createDataFrame([("p", 0, 1), ("p", 3, 2)], "k string, variable long, bits long")
    found = lattice.solve(seeds, rows.select("k", "equation", "variable"), rows, {"bits": F.col("states")[F.lit(0)]["bits"]}, {"bits": "bit_or"}, ["k"])
    assert {r.variable: r.bits for r in found.collect()} == {0: 1, 1: 1, 2: 3, 3: 3, 4: 3}
    assert len(plans) > 6 and not any("Broadcast" in p for p in plans)
