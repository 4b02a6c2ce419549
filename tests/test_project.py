"""Frontend, project checks, plugins, baselines, policies, comments and the stream on small fixtures."""

import ast
import hashlib
import hmac
import time

import pytest
from pyspark.sql import functions as F

from flowfacts import plugins
from flowfacts.frontend import lower, tables, taint
from flowfacts.plans import project
from flowfacts.plans.store import Store, component_keys
from flowfacts.sources import baselines, comments, policy
from flowfacts.sources.dependencies import read_files
from flowfacts.sources.project_files import project_files
from flowfacts.streaming import watch

HELP = "import os\n\ndef run(cmd, times=1):\n    for i in range(times):\n        os.system(cmd)\n    return cmd\n"
MAIN = "from .helpers import run\nfrom . import clean\n\ndef main():\n    text = input()\n    run(times=2, cmd=clean.safe(text))\n    run(text)  # flowfacts-allow: command-injection\n"
CLEAN = "import shlex\n\ndef safe(x):\n    if x:\n        y = shlex.quote(x)\n    else:\n        y = ''\n    return y\n"
FILES = [("app/__init__.py", ""), ("app/helpers.py", HELP), ("app/main.py", MAIN), ("app/clean.py", CLEAN), ("app/bad.py", "def ("), ("app/deep.py", "x = " + "-" * 300 + "1"), ("tests/test_a.py", "import hashlib\nhashlib.md5(b'')\nhashlib.md5(b'', usedforsecurity=False)\n"), ("app/none.py", None)]


@pytest.fixture
def files(spark):
    return spark.createDataFrame(FILES, "path string, text string")


def test_values_of_a_function():
    """Phis, constants behind a branch never taken, intervals and what a list holds."""
    text = "def f(n):\n    x = 2\n    if x > 1:\n        y = x * 3\n    else:\n        y = n\n    while n:\n        y = y + 1\n    z = [y]\n    z.append(n)\n    return z\n"
    m = lower.Module("m", False, lower.parsed(text))
    m.lower()
    f = next(f for f in m.functions if f.name == "f")
    order, idom = lower.ssa(f)
    values = {i.result: i for b in order for i in f.blocks[b].instrs if i.result is not None}
    assert not any(i.op in ("load", "store") for i in values.values())
    known, edges = lower.constants(f, order)
    assert [known[v] for v, i in values.items() if i.op == "binary" and i.text == "Mult"] == [6]
    phis = [v for v, i in values.items() if i.op == "phi"]
    assert sorted(repr(known[p]) for p in phis if known[p] is not lower.TOP) == ["6"] and len(phis) == 2
    spans = lower.ranges(f, order, known)
    assert any(spans.get(p) == (6.0, lower.INF) for p in phis)
    to, heap = lower.points_to(f, order)
    param = next(v for v, i in values.items() if i.op == "param")
    made = next(v for v, i in values.items() if i.op == "build_list")
    assert (made, "elements", param) in heap and (made, made) in to


def test_lowering_reads_every_statement():
    text = """
import a.b as c, os.path
from ..up import thing
class K(c.Base):
    z: int = 0
    def m(self, *a, k=1, **w):
        global g
        g = lambda q: q + k
        try:
            with open('x') as f, c:
                self.v, [u, *r] = f.read(), [1, 2, 3]
        except (ValueError, OSError) as e:
            raise RuntimeError from e
        else:
            del self.v, r[0]
        finally:
            assert u, 'no'
        for i, j in enumerate(a):
            if i: continue
            elif j: break
        else:
            pass
        while (n := k) > 0:
            k -= 1
        match a:
            case [1, *rest] if rest: return rest
            case {'x': y, **others}: return y
            case K(z=2) | None: return {p: s for p in a if p for s in p}
            case _: pass
        return f'{k!r:>{k}}' if a and not w else {**w, 'b': (yield)}[1:2, ::3] @ -k
async def co(x):
    async for y in x:
        await y
    def inner():
        nonlocal x
        x = 1
    return [v async for v in x], {*x}, inner, x < 1 < 2
"""
    m = lower.Module("p.q.r", False, lower.parsed(text))
    m.lower()
    assert {"<module>", "K.<body>", "K.m", "co", "co.inner"} <= {f.name for f in m.functions}
    assert ("thing", "p.up.thing") in {(n, s) for n, s, _ in m.imports}
    seen = set()
    for f in m.functions:
        order, _ = lower.ssa(f)
        lower.constants(f, order), lower.points_to(f, order)
        seen |= {i.op for b in order for i in f.blocks[b].instrs}
    assert {"phi", "call", "catch", "with_enter", "with_exit", "yield", "await", "set_attr", "del_item", "set_global", "set_nonlocal", "make_class", "make_function", "for_next", "branch", "raise", "assert", "get_iter", "build_slice", "build_string"} <= seen


def test_facts_keep_a_row_for_files_that_cannot_be_read(files):
    got = {r.path: r.name for r in tables.of(tables.facts(files), "file").collect()}
    assert got == {p: "analysed" for p, _ in FILES} | {"app/bad.py": "syntax-error", "app/deep.py": "unsupported-syntax", "app/none.py": "undecodable"}


def test_taint_between_modules(files):
    """The quoted call is clean of commands; the plain one is not, and is reported where the harm is done."""
    found = taint.flows(tables.facts(files, ("builtins.input",), nodes=False)).collect()
    assert [(r.path, r.line, r.rule, r.sources) for r in found] == [("app/helpers.py", 5, "command-injection", ["builtins.input"])]


def test_a_project_check_with_suppression_baseline_and_tests(spark, files):
    base = spark.createDataFrame([("app/helpers.py", "command-injection", "run", "os.system(cmd)")], "path string, rule string, function string, line_text string")
    got = {(r.path, r.line, r.rule): (r.known, r.test) for r in project.check(files, baseline=base).collect()}
    assert got == {("app/helpers.py", 5, "command-injection"): (True, False), ("tests/test_a.py", 2, "weak-crypto"): (False, True)}
    found = project.check(files)
    assert project.fails(found, "high") and not project.fails(found.where("test"), "high")
    row = project.coverage(tables.facts(files, (), nodes=False)).first()
    assert (row.files, row.files_analysed, row.partial) == (8, 5, ["app/bad.py", "app/deep.py", "app/none.py"])


def test_comments(spark):
    texts = {
        "a.py": "a = '# flowfacts-allow'\nb = 1  # flowfacts-allow\nc = 2 # flowfacts-allow: x, y -- as z says\n\x0cd = 3\r#flowfacts-allow:z\n",
        "b.py": "x = (  # flowfacts-allow",
        "c.py": None,
        "d.py": '"""one\n# flowfacts-allow\n\\""" """\r\ny = "\\"# flowfacts-allow" # flowfacts-allow: w\n',
        "e.py": "z = r'\\' # flowfacts-allowed\n# flowfacts-allow:\n# see flowfacts-allow\nq = 'open # flowfacts-allow\nr = 1 # flowfacts-allow because\n",
        "f.py": "'''never closed\n# flowfacts-allow\n",
        "g.py": "s = ''''a''' # flowfacts-allow: g\n",
        "h.py": "k = \"'\" + \"#\" + '\"' # flowfacts-allow: h\n",
        "i.py": "x = 'a\\\n# flowfacts-allow' # flowfacts-allow: i",
        "j.py": '"""' + "\\x # it's " * 50_000 + '"""\n# flowfacts-allow: j',
    }
    rows = comments.suppressions(spark.createDataFrame(list(texts.items()), "path string, text string")).collect()
    assert sorted((r.path, r.line, r.rules) for r in rows) == [
        ("a.py", 2, None), ("a.py", 3, ["x", "y"]), ("a.py", 5, ["z"]), ("b.py", 1, None), ("d.py", 4, ["w"]), ("e.py", 2, []), ("e.py", 5, None), ("g.py", 1, ["g"]), ("h.py", 1, ["h"]), ("i.py", 2, ["i"]), ("j.py", 2, ["j"])]


def test_baselines(spark, tmp_path):
    found = spark.createDataFrame([("a.py", "r", "f", 2, None, None, None), ("a.py", "r", "f", 3, None, None, None), ("k.toml", "s", None, None, None, "/a~b", "v")], "path string, rule string, function string, line long, end_line long, pointer string, value string")
    files = spark.createDataFrame([("a.py", "x\n  same()\nsame()  \n")], "path string, text string")
    marked = baselines.fingerprints(found, files)
    want = "sha256:" + hashlib.sha256(b"same()").hexdigest()[:16]
    assert sorted(str(r.digest) for r in marked.collect()) == sorted([want, want, "sha256:" + hashlib.sha256(b"v").hexdigest()[:16]])
    baselines.save(marked, str(tmp_path / "base"))
    assert sorted(map(str, baselines.load(spark, str(tmp_path / "base")).collect())) == sorted(map(str, marked.select(*baselines.FINGERPRINT).collect()))
    secret = baselines.fingerprints(found, files, b"key").where("line = 2").first()
    assert secret.digest == hmac.new(b"key", b"same()", hashlib.sha256).hexdigest()[:32]
    assert spark.range(1).select(baselines.pointer_part(F.lit("a/~b"))).first()[0] == "a~1~0b"


def test_policies_and_advisory_files(spark):
    rules = policy.policy('[dependencies]\ndeny = ["Bad_Lib"]\nrequire_pinned = true\n[advisories]\nignore = ["A-1"]\n')
    packages = spark.createDataFrame([("bad-lib", "==1", None, False), ("free", ">=1", None, False), ("locked", "", "1.0", False)], "package string, specifier string, version string, optional boolean")
    assert sorted((r.package, r.rule) for r in policy.policy_findings(packages, rules).collect()) == [("bad-lib", "denied-dependency"), ("free", "unpinned-dependency")]
    found = spark.createDataFrame([("A-1",), ("A-2",), (None,)], "advisory string")
    assert sorted(str(r.advisory) for r in policy.accepted(found, rules).collect()) == ["A-2", "None"]
    for wrong in ("x = [", "[dependencies]\ndeny = 1", "[dependencies]\nrequire_pinned = 'yes'"):
        with pytest.raises(ValueError):
            policy.policy(wrong)
    text = '{"schema": 1, "advisories": [{"id": "A-1", "package": "The_Lib", "vulnerable": "<2"}, {"package": "x"}]}'
    rows = policy.advisories(spark.createDataFrame([("a", text), ("b", '{"schema": 9}'), ("c", "no json")], "path string, text string"))
    assert sorted((r.path, r.package or r.error) for r in rows.collect()) == [("a", "advisory without id or package"), ("a", "the-lib"), ("b", "unknown schema"), ("c", "unknown schema")]
    assert policy.dump_advisories(rows.where("advisory IS NOT NULL")).count() == 1


def test_plugins(spark, files):
    facts = tables.facts(files, (), nodes=False)
    rule = plugins.call_detector("no-range", "range is called", "low", ["builtins.range"])
    nosy = plugins.Plugin("nosy", ("call",), lambda ctx: ctx.facts("flow"))
    lift = plugins.Plugin("lift", (), None, lambda found: found.withColumn("severity", F.lit("high")))
    got = plugins.Registry([rule, lift]).run(facts).collect()
    assert [(r.path, r.line, r.severity, r.metadata["original_severity"], r.metadata["refined_by"]) for r in got] == [("app/helpers.py", 4, "high", "low", "lift")]
    with pytest.raises(plugins.Undeclared):
        plugins.Registry([nosy]).run(facts)
    for bad in (lambda f: f.withColumn("line", F.lit(1).cast("long")), lambda f: f.where("false"), lambda f: f.withColumn("metadata", F.create_map().cast("map<string,string>"))):
        with pytest.raises(ValueError):
            plugins.Registry([rule, plugins.Plugin("bad", (), None, bad)]).run(facts)
    with pytest.raises(ValueError):
        plugins.Registry([rule, rule])
    with pytest.raises(ValueError):
        plugins.Registry([plugins.Plugin("odd", ("no such fact",))])
    assert plugins.Registry([rule]).providing("vulnerability.no-range") == [rule]
    found = plugins.secret_detector(spark.createDataFrame([("a", 'token = "abcdefgh12345678"'), ("b", 'x = "ab"')], "path string, text string"), least=4).collect()
    assert [(r.path, r.rule, r.metadata["name"]) for r in found] == [("a", "hardcoded-secret", "token")]


def test_manifests():
    text = 'name = "p"\nversion = "1"\nplugin_api = ">=1,<3"\nrequires = ["call"]\nprovides = []\n[entrypoint]\nmodule = "m"\nclass = "C"\n'
    read = plugins.manifest(text)
    assert (read.name, read.cls, read.accepts(1), read.accepts(3)) == ("p", "C", True, False)
    for wrong in (text.replace('name = "p"', ""), text.replace(">=1,<3", "~1"), text.replace('["call"]', '"call"'), text.split("[entry")[0], "a = ["):
        with pytest.raises(ValueError):
            plugins.manifest(wrong)


def test_only_changed_modules_and_their_importers_are_analysed_again(spark, tmp_path):
    root, store = tmp_path / "src" / "app", str(tmp_path / "store")
    root.mkdir(parents=True)
    for name, text in FILES[:4]:
        (tmp_path / "src" / name).write_text(text)

    def update():
        read = read_files(spark, str(root), "*.py").select(F.regexp_replace("path", "^.*/src/", "").alias("path"), "text")
        return sorted(r.module for r in watch.update(read, store).collect())

    assert update() == ["app", "app.clean", "app.helpers", "app.main"] and update() == []
    (root / "clean.py").write_text(CLEAN + "# more\n")
    assert update() == ["app.clean", "app.main"]
    made = spark.read.parquet(store + "/facts")
    assert {r.path for r in made.where("v = 3").select("path").distinct().collect()} == {"app/clean.py"}  # nothing else was parsed
    kept = Store(spark, store)
    now = sorted(map(str, kept.facts().where("kind = 'call'").drop("kind").collect()))
    want = tables.of(tables.facts(read_files(spark, str(root), "*.py").select(F.regexp_replace("path", "^.*/src/", "").alias("path"), "text"), kept.sources, nodes=False), "call")
    assert now == sorted(map(str, want.collect()))
    kept.compact()
    assert sorted(map(str, kept.facts().where("kind = 'call'").drop("kind").collect())) == now and update() == []
    (root / "helpers.py").unlink()
    assert "app.helpers" not in update() and kept.keys().count() == 3


def test_a_watched_edit_begins_a_batch(spark, tmp_path):
    root, store = tmp_path / "src" / "app", str(tmp_path / "store")
    root.mkdir(parents=True)
    for name, text in FILES[:4]:
        (tmp_path / "src" / name).write_text(text)

    def batches():
        time.sleep(1.2)  # files settle
        query = watch.watch(spark, str(tmp_path / "src"), store, str(tmp_path / "check"))
        query.awaitTermination(120)
        return sum(p["numInputRows"] for p in query.recentProgress)

    assert batches() and {r.module for r in Store(spark, store).keys().collect()} == {"app", "app.clean", "app.helpers", "app.main"}
    before = {r.module: r.key for r in Store(spark, store).keys().collect()}
    (root / "clean.py").write_text(CLEAN + "# more\n")
    assert batches()
    after = {r.module: r.key for r in Store(spark, store).keys().collect()}
    assert {m for m in after if after[m] != before[m]} == {"app.clean", "app.main"}
    assert {r.path.rsplit("/", 1)[1] for r in spark.read.parquet(store + "/facts").where("v = 2").select("path").distinct().collect()} == {"clean.py"}
    assert not batches()
    files = project_files(spark, str(tmp_path / "src"), "__init__.py").collect()
    assert [(r.path.rsplit("/", 1)[1], bytes(r.content)) for r in files] == [("__init__.py", dict(FILES)["app/__init__.py"].encode())]


def test_component_keys(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "b"), ("c", "d"), ("e", "d"), ("f", "f"), ("g", "x")], "src string, dst string")

    def keys(**edited):
        own = spark.createDataFrame([(m, edited.get(m, m)) for m in "abcdefg"], "module string, own string")
        return {r.module: (r.component, r.key) for r in component_keys(own, edges).collect()}

    first = keys()
    assert {m: c for m, (c, _) in first.items()} == {"a": "a", "b": "b", "c": "b", "d": "d", "e": "e", "f": "f", "g": "g"} and first["b"] == first["c"]
    for edited, stale in (("d", "abcde"), ("c", "abc"), ("a", "a"), ("f", "f"), ("e", "e")):
        second = keys(**{edited: "new"})
        assert "".join(m for m in sorted(first) if first[m] != second[m]) == stale


def test_names_and_resolution(spark):
    rows = [("a/app.py", ""), ("z/app.py", ""), ("pkg/__init__.py", ""), ("pkg/sub/__init__.py", ""), ("pkg/sub/x-y.py", ""), ("lone.py", ""), ("w/pkg2/__init__.py", ""), ("w/pkg2/m.py", "")]
    got = {r.path: (r.module, r.ambiguous) for r in tables.named(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert got == {"a/app.py": ("a.app", True), "z/app.py": ("z.app", True), "pkg/__init__.py": ("pkg", False), "pkg/sub/__init__.py": ("pkg.sub", False), "pkg/sub/x-y.py": ("pkg.sub.x_y", False), "lone.py": ("lone", False), "w/pkg2/__init__.py": ("pkg2", False), "w/pkg2/m.py": ("pkg2.m", False)}


def test_dominators_against_a_plain_version():
    import random

    rng = random.Random(4)
    for _ in range(60):
        n = rng.randint(2, 12)
        succs = [[rng.randrange(n) for _ in range(rng.randint(0, 3))] for _ in range(n)]
        order, idom = lower.dominators(succs)

        def reached(without):
            seen, stack = set(), [0] if without != 0 else []
            while stack:
                b = stack.pop()
                if b not in seen and b != without:
                    seen.add(b)
                    stack += succs[b]
            return seen

        live = reached(None)
        assert set(order) == live
        doms = {b: {d for d in live if d == b or b not in reached(d)} for b in live}
        for b in live - {0}:
            assert idom[b] == max(doms[b] - {b}, key=lambda d: len(doms[d]))
    assert ast.dump(lower.parsed("x = 1"))


def test_vex_of_a_project(spark, files):
    from flowfacts.plans import advisories

    whole = tables.facts(files.where("path LIKE 'app/%' AND path NOT LIKE '%bad%' AND path NOT LIKE '%deep%' AND path NOT LIKE '%none%'"), (), nodes=False)
    known = spark.createDataFrame([("A", "lib", "<2", "high", ["os.system"], ["os"]), ("B", "lib", "<2", "high", ["os.gone"], ["os"]), ("C", "lib", "<2", "high", [], ["os"]), ("D", "lib", ">=2", "high", ["os.system"], ["os"]), ("E", "used", "", "low", ["os.gone"], [])], "advisory string, package string, vulnerable string, severity string, affected_symbols array<string>, modules array<string>")
    packages = spark.createDataFrame([("lib", "", "1.0", []), ("used", "", None, ["lib"])], "package string, specifier string, version string, dependents array<string>")
    got = {r.advisory: r.status for r in advisories.vex(whole, packages, known).collect()}
    assert got == {"A": "affected", "B": "not_affected", "C": "under_investigation", "E": "under_investigation"}
    partial = {r.advisory: r.status for r in advisories.vex(tables.facts(files, (), nodes=False), packages, known).collect()}
    assert partial == {"A": "affected", "B": "under_investigation", "C": "under_investigation", "E": "under_investigation"}


def test_ranges_of_nested_loops_are_sound():
    import ast

    from flowfacts.frontend import lower

    for depth in range(1, 12):
        body = "".join("    " * (k + 1) + f"for i{k} in range(n):\n" for k in range(depth))
        m = lower.Module("m", False, ast.parse("def f(n):\n    x = 0\n" + body + "    " * (depth + 1) + "x = x + 1\n    return x\n"))
        m.lower()
        f = next(f for f in m.functions if f.name == "f")
        order, _ = lower.ssa(f)
        returned = next(i.args[0][3] for b in order for i in f.blocks[b].instrs if i.op == "return" and i.args)
        assert lower.ranges(f, order, lower.constants(f, order)[0]).get(returned, (0.0, float("inf"))) == (0.0, float("inf"))


def test_facts_are_parsed_by_as_many_tasks_as_cores(spark):
    rows = spark.range(400).selectExpr("concat('p/m', id, '.py') AS path", "concat('x = ', id) AS text").coalesce(1)
    made = tables.facts(rows, imports_only=True)
    assert tables.of(made, "file").count() == 400
    assert len({r.f for r in made.selectExpr("input_file_name() AS f").distinct().collect()}) >= spark.sparkContext.defaultParallelism


def test_module_keys_over_tasks_by_the_number_of_pairs(spark, monkeypatch):
    """The lists of what a module reaches are made by tasks of few pairs, and nothing is sent whole to all tasks."""
    import hashlib

    from flowfacts.operators import fixpoint
    from flowfacts.plans.project import module_keys

    monkeypatch.setattr(fixpoint, "ROWS", 100)
    own = {n: hashlib.sha256(str(n).encode()).hexdigest() for n in range(200)}
    edges = spark.createDataFrame([(n, n // 2) for n in own] + [(150, 151), (151, 150)], "src long, dst long")
    made = module_keys(spark.createDataFrame(list(own.items()), "module long, own string"), edges)

    def below(n):
        seen, stack = set(), [n]
        while stack:
            m = stack.pop()
            for d in {m // 2, {150: 151, 151: 150}.get(m, m)} - {m}:
                if d not in seen:
                    seen.add(d)
                    stack.append(d)
        return sorted(seen - {n})

    assert {r.module: r.key for r in made.collect()} == {n: hashlib.sha256("".join(own[m] + "\0" for m in [n, *below(n)]).encode()).hexdigest() for n in own}
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert made.rdd.getNumPartitions() >= 12 and "Broadcast" not in plan


def test_component_keys_push_each_component_once(spark, monkeypatch):
    """A wave takes what the wave before made, and not all that is known; what waits for two keeps what it met."""
    from flowfacts.plans import store

    pushed = []
    whole = store.met
    monkeypatch.setattr(store, "met", lambda edges, new, count, *rest: (pushed.append(count), whole(edges, new, count, *rest))[1])
    own = spark.createDataFrame([(m, m) for m in "abcd"], "module string, own string")
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("c", "d"), ("a", "d")], "src string, dst string")
    keys = {r.module: r.key for r in component_keys(own, edges).collect()}
    assert len(set(keys.values())) == 4 and set(keys) == set("abcd") and pushed == [1, 1, 1, 1]


def test_component_keys_of_two_states_in_one_run_of_waves(spark, monkeypatch):
    """Another state is a column of the same graph: its keys are those of a run for it alone, by as many waves, each written once."""
    from flowfacts.operators import fixpoint
    from flowfacts.plans import store

    made = []
    for module in (store, fixpoint):
        monkeypatch.setattr(module, "written", lambda df, name, *rest, whole=module.written: (made.append(name), whole(df, name, *rest))[1])
    own = spark.createDataFrame([(m, m, "new" if m in "cf" else m) for m in "abcdefg"], "module string, own string, edited string")
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "b"), ("c", "d"), ("a", "d"), ("e", "d"), ("f", "f"), ("g", "x")], "src string, dst string")
    both = {r.module: r for r in component_keys(own, edges).collect()}
    assert {m for m in both if both[m].key != both[m].edited_key} == set("abcf")
    assert made.count("waves") == 3 and "ready" not in made and made.count("keys") == 0
    for column, key in (("own", "key"), ("edited", "edited_key")):
        alone = {r.module: (r.component, r.key) for r in component_keys(own.select("module", own[column].alias("own")), edges).collect()}
        assert alone == {m: (r.component, r[key]) for m, r in both.items()}


def test_rounds_start_tasks_by_their_rows(spark):
    """With many shuffle partitions, joins of some ten thousand rows start few tasks; nothing is sent whole."""
    from flowfacts.operators.tables import joined

    rows = spark.range(60_000).selectExpr("id AS src", "id DIV 2 AS dst")
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        for how, right in (("left_semi", rows.select(rows.dst.alias("src"))), ("inner", rows.select("src", (rows.dst + 1).alias("x"))), ("left", rows.groupBy("src").agg({"dst": "max"}))):
            made = joined(rows, right, 60_000, ["src"], how, narrow=True)
            assert made.rdd.getNumPartitions() <= 3 and made.count() == (30_000 if how == "left_semi" else 60_000)
            assert "Broadcast" not in made._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
