"""Edge cases of the analysis operators on small fixtures."""

from pyspark.sql import functions as F

from flowfacts.functions import versions
from flowfacts.operators import dataflow, findings, fixpoint, graph, models


def got(df):
    return sorted(map(tuple, df.collect()))


def test_waves_of_a_module_graph(spark):
    edges = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("e", "f"), ("f", "e")], "src string, dst string")
    nodes = spark.createDataFrame([(x,) for x in "abcdefg"], "node string")
    levels = {r.node: (r.component, r.level) for r in graph.schedule(nodes, edges).collect()}
    assert levels == {"a": ("a", 2), "b": ("b", 1), "c": ("c", 1), "d": ("d", 0), "e": ("e", 0), "f": ("e", 0), "g": ("g", 0)}


def test_closure_of_a_long_cycle_and_of_nothing(spark):
    n = 30
    edges = spark.createDataFrame([(i, (i + 1) % n) for i in range(n)], "src long, dst long")
    assert fixpoint.closure(edges).count() == n * n
    assert fixpoint.closure(edges.where("false")).count() == 0


def test_post_dominators_of_a_diamond(spark):
    edges = spark.createDataFrame([("f", 0, 1), ("f", 0, 2), ("f", 1, 3), ("f", 2, 3)], "function string, src long, dst long")
    assert got(graph.post_dominators(edges)) == [("f", 0, 3), ("f", 1, 3), ("f", 2, 3), ("f", 3, -1)]


def test_baseline_counts_copies(spark):
    found = spark.createDataFrame([(1, "x"), (2, "x"), (3, "x"), (4, "y")], "id long, fp string")
    base = spark.createDataFrame([("x",), ("x",)], "fp string")
    assert got(findings.baseline_split(found, base, ["fp"], ["id"]).select("id", "known")) == [(1, True), (2, True), (3, False), (4, False)]


def test_suppression_by_rule_and_for_all_rules(spark):
    found = spark.createDataFrame([("a", 1, "r"), ("a", 2, "r"), ("a", 3, "s"), ("b", 1, "r")], "path string, line long, rule string")
    marks = spark.createDataFrame([("a", 1, None), ("a", 2, ["r"]), ("a", 3, ["r"])], "path string, line long, rules array<string>")
    assert [r.suppressed for r in findings.suppression_split(found, marks, ["path", "line"]).orderBy("path", "line").collect()] == [True, True, False, False]


def test_entropy_and_empty_texts(spark):
    rows = spark.createDataFrame([(1, "ab"), (2, ""), (3, None), (4, "aaaa")], "id long, t string").select("id", findings.entropy(F.col("t")).alias("e"))
    assert [r.e for r in rows.orderBy("id").collect()] == [1.0, 0.0, None, 0.0]


def test_receivers_with_many_calls_are_not_followed(spark):
    calls = spark.createDataFrame([("few", i) for i in range(12)] + [("many", 100 + i) for i in range(13)], "receiver string, id long")
    pairs = dataflow.prior_calls(calls, ["receiver"], ["id"], "id").collect()
    assert len(pairs) == 66 and all(p.prior < p.id < 100 for p in pairs)


def test_longest_prefix_needs_two_components(spark):
    symbols = spark.createDataFrame([(1, "flask.request.args.get"), (2, "flask"), (3, None)], "id long, symbol string")
    table = spark.createDataFrame([("flask",), ("flask.request",), ("flask.request.args",)], "model string")
    assert got(models.longest_prefix(symbols, table, "id")) == [(1, "flask.request.args")]


def test_version_clauses(spark):
    cases = [("1.2", ">=1.0,<2", True), ("2.0", "~=1.4", False), ("1.5", "~=1.4", True), ("1.3.9", "==1.3.*", True), ("0.3.5", "^0.3", True), ("0.4", "^0.3", False), ("3", "<1 || >=3", True), ("1", "", True), ("1.0", "==1", True), ("1", "!=1.0", False)]
    df = spark.createDataFrame(cases, "v string, s string, want boolean").withColumn("holds", versions.satisfies(versions.parse(F.col("v")), F.col("s")))
    assert [r.v + r.s for r in df.where("holds <> want").collect()] == []


def test_unique_names_count_on_until_one_is_free(spark):
    names = ["f", "f", "f__2", "g", "f", "g__2", "g", "h", "h", "h", "f__2", "i__2", "i__2", "i"]
    taken, want = set(), []
    for base in names:
        unique, n = base, 2
        while unique in taken:
            unique, n = f"{base}__{n}", n + 1
        taken.add(unique)
        want.append(unique)
    rows = spark.createDataFrame(list(enumerate(names)), "k long, name string").repartition(3)
    assert [r.unique_name for r in findings.unique_names(rows, "name", ["k"]).orderBy("k").collect()] == want


def test_last_wins_can_keep_the_first_place(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y"), ("a", 3, "z")], "k string, n long, v string")
    got = findings.last_wins(rows, ["k"], ["n"], first="at").orderBy("at").collect()
    assert [(r.k, r.v, r["at"].n) for r in got] == [("a", "z", 1), ("b", "y", 2)]


def test_numbers_within_keys_that_cross_ranges(spark):
    rows = spark.range(0, 3000).selectExpr("id", "if(id % 3 = 0, cast(id as string), 'hot') as k")
    got = findings.numbered(rows, "k", ["id"], "n").where("k = 'hot'").orderBy("id").collect()
    assert [r.n for r in got] == list(range(1, 2001))


def test_closure_of_random_graphs_in_many_tasks(spark, monkeypatch):
    """Cycles, loops and long chains, over tasks by the number of rows: a task of the last exchange holds few pairs."""
    import random

    from flowfacts.operators import fixpoint

    monkeypatch.setattr(fixpoint, "ROWS", 50)
    rng = random.Random(3)
    pairs = [(rng.randrange(40), rng.randrange(40)) for _ in range(45)] + [(100 + k, 101 + k) for k in range(21)] + [(7, 7)]
    after = {}
    for a, b in pairs:
        after.setdefault(a, set()).add(b)
    want = set()
    for a in after:
        stack, seen = list(after[a]), set()
        while stack:
            n = stack.pop()
            if n not in seen:
                seen.add(n)
                stack += after.get(n, ())
        want |= {(a, b) for b in seen}
    got = [tuple(r) for r in fixpoint.closure(spark.createDataFrame(pairs, "src long, dst long")).collect()]
    assert len(got) == len(want) and set(got) == want
    tasks = fixpoint._dealt(spark.createDataFrame(pairs, "src long, dst long"), 5000, "src").rdd.getNumPartitions()
    assert tasks >= 100


def test_facts_of_some_kinds_are_those_of_all():
    """What is left out for want of other kinds changes no fact of the kinds asked for, and a file's status stays."""
    from flowfacts.frontend import corpus, models, taint
    from flowfacts.frontend.tables import KINDS, file_facts

    texts = [corpus.WEB.replace("{line}", x).replace("{k}", "1") for x in corpus.LINES] + [corpus.SHARED, corpus.LEAF, corpus.HANDLERS, "def (", "return 1\nbreak", "def f(a, a): pass", None]
    for text in texts:
        whole = list(file_facts("p.m", False, text, models.prefixes(), False))
        for kinds in (("file",), ("prefix",), taint.FLOW_KINDS, taint.CALL_KINDS, tuple(KINDS)):
            made = [f for f in file_facts("p.m", False, text, models.prefixes(), False, kinds=kinds) if f["kind"] in kinds]
            assert made == [f for f in whole if f["kind"] in kinds], kinds


def test_waves_push_each_edge_once_and_send_no_table_whole(spark, monkeypatch):
    from flowfacts.operators import tables

    plans = []

    def noted(df, name, by=None):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return tables.written(df, name, by)

    for module in (fixpoint, tables):
        monkeypatch.setattr(module, "SENT_ROWS", 0, raising=False)
    monkeypatch.setattr(fixpoint, "written", noted)
    edges = spark.createDataFrame([(1, 0), (2, 1), (2, 0), (3, 2), (3, 0), (9, 0)], "src long, dst long")
    nodes = spark.createDataFrame([(n,) for n in (0, 1, 2, 3, 5)], "node long")
    assert got(fixpoint.longest_levels(nodes, edges)) == [(0, 0), (1, 1), (2, 2), (3, 3), (5, 0)]
    assert not any("Broadcast" in p for p in plans)
    try:
        fixpoint.longest_levels(nodes, spark.createDataFrame([(1, 2), (2, 1)], "src long, dst long"))
        raise AssertionError("a cycle has levels")
    except ValueError:
        pass
