"""Registered queries of the frontend, over projects written from the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import corpus, models, taint
from .tables import facts, named, of

QUERIES = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts(corpus.number_project(spark, sf_dir))


@query
def py_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole check of a web project of one module a customer: taint over calls between modules, reported calls, bad files."""
    return taint.check(corpus.web_project(spark, sf_dir)).withColumn("line", F.col("line").cast("long"))


@query
def py_taint_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = taint.flows(facts(corpus.web_project(spark, sf_dir), models.prefixes(), nodes=False, kinds=taint.FLOW_KINDS))
    return found.select("module", "function", "rule", "symbol")


@query
def py_call_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = taint.reported_calls(facts(corpus.web_project(spark, sf_dir), models.prefixes(), nodes=False, kinds=taint.CALL_KINDS))
    return found.select("module", "function", "rule", "symbol", "severity")


@query
def py_call_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = taint.resolved(facts(corpus.web_project(spark, sf_dir), (), nodes=False))
    return calls.where("to_function IS NOT NULL").groupBy("to_module", "to_function").agg(F.count("*").alias("calls"))


@query
def py_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = corpus.number_project(spark, sf_dir).unionByName(corpus.web_project(spark, sf_dir))
    return named(both).select("path", "module", "is_package", "ambiguous")


@query
def py_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = of(facts(corpus.web_project(spark, sf_dir), (), nodes=False, kinds=("file",)), "file")
    return files.groupBy(F.col("name").alias("status")).agg(F.count("*").alias("files"), F.sum("b").alias("functions"), F.sum("c").alias("functions_analysed"), F.sum("a").alias("lines"))


@query
def py_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return of(_numbers(spark, sf_dir), "import").select("path", "name", F.col("text").alias("symbol"), F.col("line").cast("long").alias("line"))


@query
def py_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return of(_numbers(spark, sf_dir), "function").select("path", "function", F.col("name").alias("how"), F.col("a").alias("parameters"))


@query
def py_bindings(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _numbers(spark, sf_dir)
    scopes = of(made, "scope").where("text = 'function'").select("path", F.col("a").alias("scope"), F.col("name").alias("function"), F.col("line").alias("at"))
    bound = of(made, "binding").select("path", F.col("a").alias("scope"), "name", F.col("text").alias("resolution"))
    return scopes.where("at = 4").join(bound, ["path", "scope"]).select("path", "name", "resolution")


@query
def py_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return of(_numbers(spark, sf_dir), "node").where("name IN ('FunctionDef', 'For', 'If', 'Try', 'Call', 'BinOp', 'Compare')").groupBy("path", F.col("name").alias("node")).agg(F.count("*").alias("nodes"))


@query
def py_instructions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return of(_numbers(spark, sf_dir), "instruction").where("function = 'work' AND name IN ('phi', 'binary', 'call', 'branch', 'for_next', 'return', 'param', 'get_iter', 'compare', 'build_list', 'jump')").groupBy("path", F.col("name").alias("operation")).agg(F.count("*").alias("instructions"))


@query
def py_control_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return of(_numbers(spark, sf_dir), "edge").where("function = 'work'").groupBy("path", F.col("role").alias("how")).agg(F.count("*").alias("edges"))


@query
def py_dominators(spark: SparkSession, sf_dir: str) -> DataFrame:
    return of(_numbers(spark, sf_dir), "block").where("function = 'work' AND b IS NOT NULL").select("path", F.col("a").alias("block"), F.col("b").alias("idom"))


@query
def py_constants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What `work` returns, by conditional constant propagation: the branch not taken does not count."""
    made = _numbers(spark, sf_dir)
    returned = of(made, "operand").join(of(made, "instruction").where("name = 'return' AND function = 'work'").select("path", "function", "a", "b"), ["path", "function", "a", "b"]).select("path", F.col("c").alias("value"))
    known = of(made, "constant").where("function = 'work'").select("path", F.col("a").alias("value"), F.col("name").alias("type"), F.col("text").alias("literal"))
    return returned.join(known, ["path", "value"]).select("path", "type", "literal")


@query
def py_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The interval of what the loop of `work` sums up: open on both sides, as the items are not known."""
    made = _numbers(spark, sf_dir)
    b = of(made, "instruction").where("function = 'work' AND name = 'binary' AND text = 'Mult'").select("path", F.col("c").alias("value"))
    known = of(made, "range").where("function = 'work'").select("path", F.col("a").alias("value"), F.col("name").cast("double").alias("low"), F.col("text").cast("double").alias("high"))
    return b.join(known, ["path", "value"]).select("path", "low", "high")


@query
def py_points_to(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects that the list of `work` holds."""
    made = _numbers(spark, sf_dir)
    lists = of(made, "instruction").where("function = 'work' AND name = 'build_list'").select("path", F.col("c").alias("object"))
    to = of(made, "points").where("function = 'work'").select("path", F.col("b").alias("object"))
    return lists.join(to, ["path", "object"]).groupBy("path").agg(F.count("*").alias("values"))


@query
def py_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return of(_numbers(spark, sf_dir), "call").where("text <> ''").groupBy("path", F.col("text").alias("symbol")).agg(F.count("*").alias("calls"))


@query
def py_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on flows behind guards of every form; what a guard proves harmless is no row."""
    return taint.flows(facts(corpus.guard_project(spark, sf_dir), models.prefixes(), nodes=False, kinds=taint.FLOW_KINDS)).select("path", "verdict")


@query
def py_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each function gives back of its parameters: kinds of taint as bits, over calls, recursion and a cycle of modules."""
    from .summaries import summary_table

    made = facts(corpus.helper_project(spark, sf_dir), models.prefixes(), nodes=False, kinds=taint.FLOW_KINDS)
    return summary_table(made, taint.resolved(made)).select("module", "function", "index", "mask")


@query
def py_matched_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows through helpers that have untrusted and clean callers: a value comes back to its own caller only."""
    found = taint.flows(facts(corpus.helper_project(spark, sf_dir), models.prefixes(), nodes=False, kinds=taint.FLOW_KINDS))
    return found.select("module", "function", "rule", "symbol")


@query
def py_class_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .classes import ancestors

    return ancestors(facts(corpus.class_project(spark, sf_dir), (), nodes=False))


@query
def py_base_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Methods that a library calls, as their class is three levels below one of its bases."""
    from .classes import ancestors, entry_points

    made = facts(corpus.class_project(spark, sf_dir), (), nodes=False)
    return entry_points(made, ancestors(made))


@query
def py_base_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows from parameters, attributes, inherited methods and inherited fields of request handlers."""
    return taint.flows(facts(corpus.class_project(spark, sf_dir), models.prefixes(), nodes=False, kinds=taint.FLOW_KINDS)).select("module", "function", "rule", "symbol")


@query
def py_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals of all variables that loops change, and of what is computed of them, by a lattice fixpoint over the fact tables."""
    from flowfacts.operators.lattice import intervals

    made = facts(corpus.loop_project(spark, sf_dir))
    shown = of(made, "instruction").where("name = 'phi' OR (name = 'binary' AND text IN ('Mod', 'FloorDiv'))").select("path", "function", F.col("c").alias("value"), F.col("text").alias("what"))
    return intervals(made).join(shown, ["path", "function", "value"]).select("path", "what", "low", "high").distinct()


@query
def py_authorized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on flows in helpers that are called behind a decorator, behind a test, or openly: a hotspot only if no way is open."""
    found = taint.flows(facts(corpus.handler_project(spark, sf_dir), models.prefixes(), nodes=False, kinds=taint.FLOW_KINDS))
    return found.select("path", "function", F.col("line").cast("long").alias("line"), "verdict")


@query
def py_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each call tells of its advisory's conditions: met, pending, the first contradicted, and what was passed."""
    from flowfacts.plans.conditions import CONDITION, calls_of, correlated

    entries = spark.createDataFrame([(f"ADV-{n}", symbol, conditions) for n, (symbol, conditions) in enumerate(corpus.CONDITIONS.items())], f"advisory string, symbol string, conditions array<{CONDITION}>")
    found = correlated(calls_of(facts(corpus.caller_project(spark, sf_dir), (), nodes=False)), entries)
    return found.select("path", "advisory", "entry", F.array_join("met", "; ").alias("met"), F.array_join("pending", "; ").alias("pending"), "contradicted", "shown")


@query
def py_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which templates escape all they print, over blocks, bases and a cycle of includes."""
    from .templates import verdicts

    return verdicts(corpus.template_project(spark, sf_dir))


@query
def py_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Constant beginnings of arguments, and what they fix of a URL."""
    made = facts(corpus.web_project(spark, sf_dir), (), nodes=False, kinds=("prefix",))
    rows = of(made, "prefix").where("function LIKE 'view%' AND c = 0")
    return rows.select("module", F.col("text").alias("prefix"), taint.url_proof(F.col("text")).alias("proof"))


@query
def py_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The branch of `work` as text."""
    from .listing import listing

    rows = listing(_numbers(spark, sf_dir)).where("function = 'work' AND line LIKE 'branch%'")
    return rows.groupBy("line").agg(F.count("*").alias("modules"))


def _advisories(spark: SparkSession) -> DataFrame:
    rows = [("ADV-1", "requests", "<3", "high", ["requests.get"], ["requests"]), ("ADV-2", "flask", ">=1", "medium", ["flask.redirect"], ["flask"]), ("ADV-3", "flask", "<1", "low", ["flask.redirect"], ["flask"]), ("ADV-4", "absent", "", "low", ["x"], ["os"])]
    return spark.createDataFrame(rows, "advisory string, package string, vulnerable string, severity string, affected_symbols array<string>, modules array<string>")


@query
def py_reachable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence of advisories in the web project: flask is locked at 2.0, so one of its advisories does not hold."""
    from flowfacts.plans import advisories

    packages = spark.createDataFrame([("requests", "", None), ("flask", "", "2.0")], "package string, specifier string, version string")
    known = _advisories(spark)
    found = advisories.findings(advisories.evidence(facts(corpus.web_project(spark, sf_dir), (), nodes=False), packages, known), known)
    return found.groupBy("advisory", "rule", "level", "severity").agg(F.count("*").alias("places"))


@query
def py_module_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    from flowfacts.plans.project import module_graph

    return module_graph(facts(corpus.web_project(spark, sf_dir), imports_only=True)).groupBy("dst", "symbol").agg(F.count("*").alias("importers"))


@query
def module_key_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content keys over the import graph of parts, with their names as texts."""
    from flowfacts.plans.project import module_keys
    from flowfacts.sources import facts as projected

    own = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("module"), F.sha2("p_name", 256).alias("own"))
    return module_keys(own, projected.module_edges(spark, sf_dir))


@query
def stale_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modules whose component keys change when some are edited: those that reach an edited one by imports."""
    from flowfacts.plans.store import component_keys
    from flowfacts.sources import facts as projected

    # both states of the project are columns of one graph, so that one run gives the keys of both
    part = spark.read.parquet(f"{sf_dir}/part.parquet").groupBy(F.col("p_partkey").alias("module")).agg(F.min("p_name").alias("name"), F.max(F.coalesce(F.col("p_size") == 7, F.lit(False))).alias("edits"))
    texts = F.concat_ws("/", F.col("module").cast("string"), "name"), F.concat_ws("/", F.col("module").cast("string"), "name", F.when(F.col("edits"), "new"))
    own = part.select("module", F.sha2(texts[0], 256).alias("own"), F.sha2(texts[1], 256).alias("edited"))
    return component_keys(own, projected.module_edges(spark, sf_dir), named=False).where("key <> edited_key").select("module", "component")


@query
def py_plugins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All bundled plugins over the web project, with suppressions, test code and a baseline that absorbs one finding in two."""
    from flowfacts.plans.project import check

    files = corpus.web_project(spark, sf_dir)
    base = files.where(F.col("path").rlike("[02468][.]py$")).selectExpr("path", "'weak-crypto' AS rule", "concat('view_', regexp_extract(path, '([0-9]+)', 1)) AS function", "'hashlib.md5(q.encode())' AS line_text")
    return check(files, baseline=base).select("path", "line", "rule", "severity", "confidence", "known", "suppressed", "test")


_WEB = "SELECT c_custkey AS k, concat('proj/mod', c_custkey, '.py') AS path, concat('proj.mod', c_custkey) AS module, concat('view_', c_custkey) AS function, c_custkey % 12 AS s FROM customer"
_RULES = """rules(s, rule, severity, symbol, flow) AS (VALUES (0, 'sql-injection', 'high', 'sqlite3.connect.execute', true), (2, 'command-injection', 'critical', 'os.system', true),
  (4, 'weak-crypto', 'medium', 'hashlib.md5', false), (5, 'ssrf', 'high', 'requests.get', true), (6, 'insecure-tls', 'high', 'requests.get', false), (6, 'missing-timeout', 'low', 'requests.get', false),
  (7, 'code-injection', 'critical', 'builtins.eval', true), (7, 'dangerous-eval', 'medium', 'builtins.eval', false), (9, 'path-traversal', 'high', 'builtins.open', true), (10, 'open-redirect', 'medium', 'flask.redirect', true))"""
#: Flows inside the shared module: run_0 takes what run_0 and run_2 are given, run_1 what Runner was made with.
_SHARED = """shared AS (SELECT 'proj/shared.py' AS path, 'proj.shared' AS module, * FROM (
  SELECT 'Runner.run_0' AS function, 8 AS line, 'os.system' AS symbol WHERE EXISTS (SELECT 1 FROM w WHERE s = 8 AND k % 3 <> 1)
  UNION ALL SELECT 'Runner.run_1', 11, 'os.popen' WHERE EXISTS (SELECT 1 FROM w WHERE s = 8)))"""
_NUM = """n AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 5 = 0 THEN concat('a', s_suppkey % 2, '/num', s_suppkey // 10, '.py') ELSE concat('b/num_', s_suppkey, '.py') END AS path FROM supplier)"""


def _counts(label: str, number: str, **values: int) -> str:
    rows = ", ".join(f"('{k}', {v})" for k, v in values.items())
    return f"WITH {_NUM}, v({label}, {number}) AS (VALUES {rows}) SELECT path, {label}, {number}::BIGINT AS {number} FROM n, v"


#: below gives back its value where a walk along the modules meets a tenth one before it has gone round.
_HELPERS = """k AS (SELECT s_suppkey AS k, concat('helpers.mod', s_suppkey) AS module FROM supplier),
  nexts AS (SELECT k, coalesce(lead(k) OVER (ORDER BY k), (SELECT min(k) FROM k)) AS n FROM k),
  walk(k, calls, place) AS (SELECT k, [k], k FROM nexts UNION ALL SELECT w.k, list_append(calls, n), n FROM walk w JOIN nexts x ON x.k = w.place WHERE w.place % 10 <> 0 AND NOT list_contains(calls, n)),
  back AS (SELECT DISTINCT k FROM walk WHERE place % 10 = 0)"""
def _text(value: str | None) -> str:
    return "NULL::VARCHAR" if value is None else "'" + value.replace("'", "''") + "'"


_CALLS = ", ".join(f"({n}, 'ADV-{list(corpus.CONDITIONS).index(e)}', '{e}', {_text('; '.join(met))}, {_text('; '.join(pending))}, {_text(against)}, {_text(shown)})"
                   for n, (call, met, pending, against, shown) in enumerate(corpus.CALLS) for e in corpus.CONDITIONS if e.split(".")[-1] == call.split("(")[0])
_GUARDS = ", ".join(f"({k}, '{v}')" for k, (_, v) in enumerate(corpus.GUARDS) if v)
ORACLES = {
    "py_conditions": f"WITH v(n, advisory, entry, met, pending, contradicted, shown) AS (VALUES {_CALLS}) SELECT concat('calls/mod', s_suppkey, '.py') AS path, advisory, entry, met, pending, contradicted, shown FROM supplier JOIN v ON n = s_suppkey % {len(corpus.CALLS)}",
    "py_authorized": """SELECT concat('web/mod', s_suppkey, '.py') AS path, 'deep' AS function, 7::BIGINT AS line, CASE WHEN s_suppkey % 2 = 0 AND s_suppkey % 3 = 0 THEN 'hotspot' ELSE 'vulnerability' END AS verdict FROM supplier
        UNION ALL SELECT concat('web/mod', s_suppkey, '.py'), 'three', 26, 'hotspot' FROM supplier
        UNION ALL SELECT concat('web/mod', s_suppkey, '.py'), 'three', 27, 'vulnerability' FROM supplier WHERE s_suppkey % 5 = 0""",
    "stale_modules": """WITH RECURSIVE edges AS (SELECT DISTINCT src, dst FROM (
          SELECT p_partkey AS src, p_partkey // 2 AS dst FROM part UNION ALL SELECT p_partkey, p_partkey // 3 FROM part WHERE p_size > 45
          UNION ALL SELECT p_partkey // 2, p_partkey FROM part WHERE p_size = 50) WHERE src <> dst AND dst IN (SELECT p_partkey FROM part) AND src IN (SELECT p_partkey FROM part)),
        paths(src, dst) AS (SELECT src, dst FROM edges UNION SELECT p.src, e.dst FROM paths p JOIN edges e ON p.dst = e.src),
        mutual AS (SELECT a.src AS module, min(least(a.dst, a.src)) AS component FROM paths a JOIN paths b ON a.src = b.dst AND a.dst = b.src GROUP BY a.src),
        stale AS (SELECT p_partkey AS module FROM part WHERE p_size = 7 UNION SELECT src FROM paths JOIN part ON dst = p_partkey WHERE p_size = 7)
        SELECT module, coalesce(component, module) AS component FROM stale LEFT JOIN mutual USING (module)""",
    "py_templates": """WITH RECURSIVE k AS (SELECT s_suppkey AS k FROM supplier), nexts AS (SELECT k, CASE WHEN k = 1 THEN (SELECT max(k) FROM k) ELSE k // 2 END AS n FROM k),
        walk(k, n) AS (SELECT k, k FROM k UNION SELECT w.k, i.n FROM walk w JOIN nexts i ON i.k = w.n), part AS (SELECT k, NOT bool_or(n % 11 = 0) AS escapes FROM walk GROUP BY k)
        SELECT concat('part', k, '.html') AS name, escapes FROM part UNION ALL SELECT concat('page', k, '.html'), escapes AND (k % 3 = 0 OR (k % 3 = 2 AND k % 2 = 0)) FROM part
        UNION ALL VALUES ('base0.html', true), ('base1.html', true), ('base2.html', false)""",
    "py_class_ancestors": """WITH m AS (SELECT n_nationkey AS n, unnest([['Mid', 'Mid'], ['Mid', 'Root'], ['Mid', 'T'], ['Mix', 'Mix'], ['Mix', 'Mid'], ['Mix', 'Root'], ['Mix', 'T'], ['Mix', 'Extra'], ['Extra', 'Extra']]) AS c, unnest([0, 1, 2, 0, 1, 2, 3, 4, 0]) AS place FROM nation),
        l AS (SELECT s_suppkey AS k, s_suppkey % 25 AS n, unnest(['Leaf', 'Mix', 'Mid', 'Root', 'T', 'Extra']) AS a, unnest([0, 1, 2, 3, 4, 5]) AS place FROM supplier)
        SELECT concat('views.mid', n, '.', c[1], CASE WHEN c[1] <> 'Extra' THEN n::VARCHAR ELSE '' END) AS class, place, CASE c[2] WHEN 'T' THEN 'tornado.web.RequestHandler' WHEN 'Root' THEN 'views.root.Root' ELSE concat('views.mid', n, '.', c[2], CASE WHEN c[2] <> 'Extra' THEN n::VARCHAR ELSE '' END) END AS ancestor, c[2] <> 'T' AS own FROM m
        UNION ALL SELECT concat('views.leaf', k, '.Leaf', k), place, CASE a WHEN 'T' THEN 'tornado.web.RequestHandler' WHEN 'Root' THEN 'views.root.Root' WHEN 'Leaf' THEN concat('views.leaf', k, '.Leaf', k) ELSE concat('views.mid', n, '.', a, CASE WHEN a <> 'Extra' THEN n::VARCHAR ELSE '' END) END, a <> 'T' FROM l
        UNION ALL SELECT concat('views.leaf', s_suppkey, '.Plain', s_suppkey), 0, concat('views.leaf', s_suppkey, '.Plain', s_suppkey), true FROM supplier
        UNION ALL VALUES ('views.root.Root', 0, 'views.root.Root', true), ('views.root.Root', 1, 'tornado.web.RequestHandler', false)""",
    "py_base_entries": "SELECT concat('views.leaf', s_suppkey) AS module, concat('Leaf', s_suppkey, '.get') AS function, 'tornado.web.RequestHandler' AS base FROM supplier",
    "py_base_flows": """SELECT concat('views.leaf', s_suppkey) AS module, concat('Leaf', s_suppkey, '.get') AS function, 'command-injection' AS rule, 'os.system' AS symbol FROM supplier WHERE s_suppkey % 6 IN (1, 2, 3, 5)
        UNION ALL SELECT 'views.root', 'Root.run', 'command-injection', 'os.system' WHERE EXISTS (SELECT 1 FROM supplier WHERE s_suppkey % 6 = 0)""",
    "py_intervals": """WITH n AS (SELECT concat('loops/mod', s_suppkey, '.py') AS path, (s_suppkey % 7)::DOUBLE AS x, (s_suppkey % 5 + 1)::DOUBLE AS y, s_suppkey % 3 AS s, (s_suppkey % 4 + 1)::DOUBLE AS m FROM supplier), inf AS (SELECT 'inf'::DOUBLE AS inf)
        SELECT path, 'up' AS what, x AS low, CASE WHEN s = 0 THEN x ELSE inf END AS high FROM n, inf UNION ALL SELECT path, 'down', -inf, y FROM n, inf
        UNION ALL SELECT path, 'both', CASE WHEN x < y THEN -inf ELSE x END, CASE WHEN x > y THEN inf ELSE x END FROM n, inf
        UNION ALL SELECT path, 'Mod', 0, m FROM n UNION ALL SELECT path, 'FloorDiv', floor(x / 2), CASE WHEN s = 0 THEN floor(x / 2) ELSE inf END FROM n, inf""",
    "py_summaries": f"""WITH RECURSIVE {_HELPERS}, v(function, index, mask) AS (VALUES ('quoted', 0, {models.ALL - models.KINDS["command"]}), ('even', 1, {models.ALL}), ('odd', 1, {models.ALL}))
        SELECT module, function, index::BIGINT AS index, mask::BIGINT AS mask FROM k, v UNION ALL SELECT module, 'pick', k % 2, {models.ALL} FROM k UNION ALL SELECT module, 'below', 0, {models.ALL} FROM k JOIN back USING (k)""",
    "py_matched_flows": f"""WITH RECURSIVE {_HELPERS}, v(function, rule, symbol) AS (VALUES ('third', 'command-injection', 'os.system'), ('fifth', 'sql-injection', 'sqlite3.connect.execute'), ('eighth', 'command-injection', 'os.system'))
        SELECT module, function, rule, symbol FROM k, v UNION ALL SELECT module, 'first', 'command-injection', 'os.system' FROM k WHERE k % 2 = 0 UNION ALL SELECT module, 'sixth', 'command-injection', 'os.system' FROM k JOIN back USING (k)""",
    "py_reachable": f"""WITH w AS ({_WEB}), v(advisory, rule, level, severity, places) AS (
        SELECT 'ADV-1', 'vulnerable-dependency', 'declared', 'high', 1 UNION ALL SELECT 'ADV-2', 'vulnerable-dependency', 'declared', 'medium', 1
        UNION ALL SELECT 'ADV-1', 'vulnerable-dependency', 'imported', 'high', count(*) FROM w WHERE s <> 11 UNION ALL SELECT 'ADV-2', 'vulnerable-dependency', 'imported', 'medium', count(*) FROM w WHERE s <> 11
        UNION ALL SELECT 'ADV-1', 'reachable-vulnerability', 'called', 'high', count(*) FROM w WHERE s IN (5, 6) UNION ALL SELECT 'ADV-2', 'reachable-vulnerability', 'called', 'medium', count(*) FROM w WHERE s = 10)
        SELECT advisory, rule, level, severity, places::BIGINT AS places FROM v WHERE places > 0""",
    "py_prefixes": f"WITH w AS ({_WEB}), v(s, prefix, proof) AS (VALUES (0, 'select ', NULL), (2, 'ls ', NULL), (3, 'ls ', NULL), (5, 'http://host/', 'origin'), (9, '/data/', 'site')) SELECT module, prefix, proof FROM w JOIN v USING (s)",
    "py_listing": "SELECT 'branch 1|2 (test=%5)' AS line, count(*) AS modules FROM supplier",
    "py_guards": f"WITH v(g, verdict) AS (VALUES {_GUARDS}) SELECT concat('g/mod', s_suppkey, '.py') AS path, verdict FROM supplier JOIN v ON g = s_suppkey % {len(corpus.GUARDS)}",
    "py_module_graph": f"""WITH w AS ({_WEB}), v(dst, symbol) AS (VALUES (NULL, 'os'), (NULL, 'sqlite3'), (NULL, 'hashlib'), (NULL, 'requests'), (NULL, 'flask.Flask'), (NULL, 'flask.request'), (NULL, 'flask.redirect'), ('proj.shared', 'proj.shared.Runner'))
        SELECT dst, symbol, (SELECT count(*) FROM w WHERE s <> 11) + CASE WHEN symbol = 'os' THEN 1 ELSE 0 END AS importers FROM v""",
    "module_key_digests": """WITH RECURSIVE edges AS (SELECT DISTINCT src, dst FROM (
          SELECT p_partkey AS src, p_partkey // 2 AS dst FROM part UNION ALL SELECT p_partkey, p_partkey // 3 FROM part WHERE p_size > 45
          UNION ALL SELECT p_partkey // 2, p_partkey FROM part WHERE p_size = 50) WHERE src <> dst),
        paths(src, dst) AS (SELECT src, dst FROM edges UNION SELECT p.src, e.dst FROM paths p JOIN edges e ON p.dst = e.src),
        own AS (SELECT p_partkey AS module, sha256(p_name) AS own FROM part),
        below AS (SELECT src AS module, string_agg(own, chr(0) ORDER BY dst) AS b FROM paths JOIN own ON module = dst WHERE src <> dst GROUP BY src)
        SELECT own.module, sha256(concat(own, chr(0), CASE WHEN b IS NULL THEN '' ELSE concat(b, chr(0)) END)) AS key FROM own LEFT JOIN below ON below.module = own.module""",
    "py_plugins": f"""WITH w AS ({_WEB}), {_RULES}, {_SHARED} SELECT path, 15::BIGINT AS line, rule, severity, CASE WHEN flow AND rule <> 'ssrf' THEN 'high' ELSE 'medium' END AS confidence, rule = 'weak-crypto' AND k % 2 = 0 AS known, false AS suppressed, false AS test FROM w JOIN rules USING (s)
        UNION ALL SELECT path, line::BIGINT, 'command-injection', 'critical', 'high', false, false, false FROM shared""",
    "py_check": f"""WITH w AS ({_WEB}), {_RULES}, {_SHARED} SELECT path, 15::BIGINT AS line, rule, severity, symbol FROM w JOIN rules USING (s)
        UNION ALL SELECT path, line::BIGINT, 'command-injection', 'critical', symbol FROM shared
        UNION ALL SELECT path, 15::BIGINT, 'syntax-error', 'info', '' FROM w WHERE s = 11""",
    "py_taint_flows": f"WITH w AS ({_WEB}), {_RULES}, {_SHARED} SELECT module, function, rule, symbol FROM w JOIN rules USING (s) WHERE flow UNION ALL SELECT module, function, 'command-injection', symbol FROM shared",
    "py_call_rules": f"WITH w AS ({_WEB}), {_RULES} SELECT module, function, rule, symbol, severity FROM w JOIN rules USING (s) WHERE NOT flow",
    "py_call_targets": f"""WITH w AS ({_WEB}), c AS (SELECT 'proj.shared' AS to_module, concat('Runner.run_', k % 3) AS to_function FROM w WHERE s = 8
        UNION ALL SELECT 'proj.shared', 'Runner.__init__' FROM w WHERE s = 8 UNION ALL SELECT 'proj.shared', 'Runner.run_0' UNION ALL SELECT module, 'clean' FROM w WHERE s = 3)
        SELECT to_module, to_function, count(*) AS calls FROM c GROUP BY ALL""",
    "py_modules": f"""WITH w AS ({_WEB}), {_NUM}, f AS (SELECT path, regexp_replace(path, '^.*/|\\.py$', '', 'g') AS stem, replace(regexp_replace(path, '\\.py$', ''), '/', '.') AS whole FROM n)
        SELECT path, CASE WHEN count(*) OVER (PARTITION BY stem) > 1 THEN whole ELSE stem END AS module, false AS is_package, count(*) OVER (PARTITION BY stem) > 1 AS ambiguous FROM f
        UNION ALL SELECT path, module, false, false FROM w UNION ALL VALUES ('proj/__init__.py', 'proj', true, false), ('proj/shared.py', 'proj.shared', false, false)""",
    "py_coverage": f"""WITH w AS ({_WEB}) SELECT CASE WHEN s = 11 THEN 'syntax-error' ELSE 'analysed' END AS status, count(*) + CASE WHEN s = 11 THEN 0 ELSE 2 END AS files,
        CAST(CASE WHEN s = 11 THEN 0 ELSE 3 * count(*) + 7 END AS BIGINT) AS functions, CAST(CASE WHEN s = 11 THEN 0 ELSE 3 * count(*) + 7 END AS BIGINT) AS functions_analysed,
        CAST(16 * count(*) + CASE WHEN s = 11 THEN 0 ELSE 14 END AS BIGINT) AS lines FROM (SELECT CASE WHEN s = 11 THEN 11 ELSE 0 END AS s FROM w) GROUP BY s""",
    "py_imports": f"WITH {_NUM}, v(name, symbol, line) AS (VALUES ('m', 'math', 1), ('path', 'os.path', 2)) SELECT path, name, symbol, line::BIGINT AS line FROM n, v",
    "py_functions": f"""WITH {_NUM} SELECT path, '<module>' AS function, 'module' AS how, 0::BIGINT AS parameters FROM n UNION ALL SELECT path, 'work', 'function', 1 FROM n
        UNION ALL SELECT path, CASE WHEN k % 3 = 0 THEN 'work__2' ELSE 'other' END, 'function', 2 FROM n""",
    "py_bindings": f"""WITH {_NUM}, v(name, resolution) AS (VALUES ('n', 'parameter'), ('a', 'local'), ('b', 'local'), ('c', 'local'), ('total', 'local'), ('i', 'local'), ('items', 'local'), ('range', 'global'))
        SELECT path, name, resolution FROM n, v""",
    "py_nodes": _counts("node", "nodes", FunctionDef=2, For=1, If=1, Try=1, Call=3, BinOp=3, Compare=1),
    "py_instructions": _counts("operation", "instructions", phi=2, binary=3, call=2, branch=1, for_next=1, param=1, get_iter=1, compare=1, build_list=1, jump=5, **{"return": 1}),
    "py_control_flow": _counts("how", "edges", then=1, jump=5, body=1, exit=1, **{"else": 1}),
    "py_dominators": f"WITH {_NUM}, v(block, idom) AS (VALUES (0, 0), (1, 0), (2, 0), (3, 0), (4, 3), (5, 4), (6, 4), (7, 6)) SELECT path, block::BIGINT AS block, idom::BIGINT AS idom FROM n, v",
    "py_constants": f"WITH {_NUM} SELECT path, 'int' AS type, CAST(CASE WHEN k % 7 > 3 THEN (k % 7) * (k % 5 + 1) + 1 ELSE 0 END AS VARCHAR) AS literal FROM n",
    "py_ranges": f"WITH {_NUM} SELECT path, CAST((k % 7) * (k % 5 + 1) AS DOUBLE) AS low, CAST((k % 7) * (k % 5 + 1) AS DOUBLE) AS high FROM n",
    "py_points_to": f"WITH {_NUM} SELECT path, 1::BIGINT AS values FROM n",
    "py_symbols": f"WITH {_NUM}, v(symbol) AS (VALUES ('math.sqrt'), ('builtins.range')) SELECT path, symbol, 1::BIGINT AS calls FROM n, v",
}
