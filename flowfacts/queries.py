"""Registered queries over the driver's tables: each applies one operator to facts projected from whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowfacts.functions import versions
from flowfacts.operators import dataflow, findings, fixpoint, graph, models, sweep
from flowfacts.sources import dependencies, facts, reports
from flowfacts.sources.facts import table

from .frontend import queries as frontend
from .oracles import ORACLES as OWN_ORACLES

QUERIES = dict(frontend.QUERIES)
ORACLES = {**OWN_ORACLES, **frontend.ORACLES}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.assigned_secrets(table(spark, sf_dir, "documents"), "doc_id", "text")


@query
def secret_assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _secrets(spark, sf_dir)


@query
def secret_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets that no label marks as accepted (quality 1), worst first."""
    accepted = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id", F.lit(None).cast("array<string>").alias("rules"))
    kept = findings.suppression_split(_secrets(spark, sf_dir), accepted, ["doc_id"]).where("NOT suppressed").withColumn("rank", F.when(F.col("severity") == "high", 3).otherwise(1).cast("long"))
    return findings.in_order(kept, [F.col("rank").desc(), "doc_id", "ordinal"]).select("position", "doc_id", "ordinal", "rule", "severity", "confidence", "digest")


@query
def suppress_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("rule"))
    marks = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("toxic") == 1, F.lit(None)).otherwise(F.array(F.concat(F.lit("src"), F.col("quality")))).cast("array<string>").alias("rules"))
    return findings.suppression_split(found, marks, ["doc_id"])


@query
def report_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    return findings.in_order(orders, ["o_orderpriority", "o_orderstatus", "o_orderkey"]).withColumn("position", F.col("position").cast("long"))


@query
def coverage_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = table(spark, sf_dir, "labels").select("doc_id").distinct().withColumn("status", F.lit("analysed"))
    return findings.coverage(table(spark, sf_dir, "documents").select("doc_id", "source", "lang").join(labelled, "doc_id", "left"), ["source", "lang"])


@query
def advisories_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice")
    return findings.last_wins(rows, ["l_partkey"], ["l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice"])


@query
def shared_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy("p_name").agg(F.count("*").alias("parts")).where("parts > 1")


@query
def innermost_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The innermost of nested intervals around each item's part, and how many there are; an interval reaches down from a part's
    number by its lowest bit. There are two keys, so each is far larger than a task."""
    part, item = table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem")
    intervals = part.select((F.col("p_size") % 2).cast("long").alias("half"), F.col("p_partkey").alias("id"), F.expr("p_partkey - (p_partkey & -p_partkey) + 1").alias("begin"), F.col("p_partkey").alias("end"))
    points = item.select((F.col("l_suppkey") % 2).alias("half"), F.col("l_partkey").alias("at"), "l_orderkey", "l_linenumber")
    return sweep.innermost(points, intervals, ["half"]).select("l_orderkey", "l_linenumber", "inside", "depth")


@query
def unique_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.unique_names(table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_name", ["p_partkey"]).select("p_partkey", "unique_name")


@query
def baseline_multiset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of large value absorb equal findings (user and kind) in order of id."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    return findings.baseline_split(events, events.where("value > 50"), ["user_id", "event_type"], ["event_id"]).select("event_id", "known")


@query
def fingerprint_sha(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))


@query
def policy_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    denied = table(spark, sf_dir, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("s_nationkey"))
    return table(spark, sf_dir, "supplier").join(denied, "s_nationkey", "left_anti").select("s_suppkey", "s_name")


@query
def version_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.expr("concat(p_size, '.', p_partkey % 10, 'rc', p_partkey % 3, '.7')")
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(versions.parse(text).cast("array<string>"), ".").alias("parsed"))


@query
def version_satisfies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.versions(spark, sf_dir).select("requirement", versions.satisfies(versions.parse(F.col("version")), F.col("spec")).alias("holds"))


#: Forms of specifiers by p_partkey % 16, over a = p_partkey * 7 % 50 and b = p_partkey % 10; the SQL says what each means.
FORMS = [
    "concat('>=', a, '.', b)", "concat('>', a, '.', b)", "concat('<', a, '.', b)", "concat('<= ', a, '.', b)", "concat('==', p_size, '.', b)", "concat('===', p_size, '.*')", "concat('==', a, '.*')",
    "concat('!=', p_size, '.', b)", "concat('!=', a, '.*')", "concat('~=', a, '.', b)", "concat('~=', a)", "concat('^0.', b)", "concat('^', a + 1, '.', b)", "concat(' || >=', a, '.', b)",
    "concat('<10 || >=40, !=', p_size, '.', b, '.1')", "'==foo,bogus'"]


@query
def specifier_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A version of every part against a specifier of every form."""
    rows = table(spark, sf_dir, "part").selectExpr("*", "p_partkey * 7 % 50 AS a", "p_partkey % 10 AS b", "concat(p_size, '.', p_partkey % 10, '.', p_partkey % 3) AS version")
    spec = F.expr("CASE p_partkey % 16 " + " ".join(f"WHEN {k} THEN {form}" for k, form in enumerate(FORMS)) + " END")
    return rows.select(F.col("p_partkey").alias("requirement"), versions.satisfies(versions.parse(F.col("version")), spec).alias("holds"))


@query
def osv_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Advisory records written from parts: ranges of every shape, other ecosystems and kinds of ranges, and severities."""
    events = F.expr("""CASE p_partkey % 7 WHEN 0 THEN concat('[{"introduced":"0"},{"fixed":"', p_size, '.1"}]') WHEN 1 THEN concat('[{"introduced":"', p_size, '.0"},{"fixed":"', p_size + 1, '"}]')
        WHEN 2 THEN concat('[{"introduced":"1.0"},{"last_affected":"', p_size, '"}]') WHEN 3 THEN concat('[{"introduced":"', p_size, '"}]')
        ELSE concat('[{"introduced":"0"},{"fixed":"1.1"},{"introduced":"2.0"},{"fixed":"2.', p_size, '"}]') END""")
    rows = table(spark, sf_dir, "part").withColumn("events", events)
    text = F.format_string('{"id":"R-%d","summary":"s","database_specific":{"severity":"%s"},"affected":[{"package":{"ecosystem":"%s","name":"The_Lib"},"ranges":[{"type":"%s","events":%s}]}]}',
                           "p_partkey", F.expr("element_at(array('MODERATE', 'HIGH', 'other'), cast(p_partkey % 3 AS int) + 1)"), F.expr("if(p_partkey % 7 = 5, 'npm', 'PyPI')"), F.expr("if(p_partkey % 7 = 6, 'GIT', if(p_partkey % 2 = 0, 'SEMVER', 'ECOSYSTEM'))"), "events")
    records = rows.select(F.from_json(text, dependencies.OSV_SCHEMA).alias("r")).select("r.*")
    return dependencies.osv_advisories(records).select("advisory", "package", "vulnerable", "severity")


@query
def may_affect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as requirements, pinned, bounded or free, against an advisory for each brand below its mean size."""
    part = table(spark, sf_dir, "part")
    advisories = part.groupBy("p_brand").agg(F.floor(F.avg("p_size")).alias("mean")).select(F.concat(F.lit("ADV-"), "p_brand").alias("advisory"), F.col("p_brand").alias("package"), F.concat(F.lit("<"), "mean").alias("vulnerable"))
    declared = part.selectExpr("p_partkey AS requirement", "p_brand AS package", "CASE p_partkey % 4 WHEN 0 THEN concat('==', p_size) WHEN 1 THEN concat('>=', p_size) WHEN 2 THEN '' ELSE '<99' END AS specifier")
    return models.may_affect(declared, advisories).select("requirement", "advisory")


@query
def vex_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence rows from line items: reached, not reached or not known; named, complete, and other packages that require it."""
    evidence = table(spark, sf_dir, "lineitem").selectExpr(
        "l_suppkey AS advisory", "l_linestatus AS package", "CASE l_returnflag WHEN 'R' THEN true WHEN 'A' THEN false END AS reached", "l_tax > 0.01 AS named", "l_discount > 0.01 AS complete", "if(l_quantity < 50, array(), array('x')) AS dependents")
    return reports.vex_status(evidence).select("advisory", "package", "status")


@query
def merged_requirements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declarations and pins of packages written from parts, merged in order."""
    rows = table(spark, sf_dir, "part").selectExpr(
        "'p' AS path", "p_partkey AS ordinal", "concat('lib-', p_size) AS package", "CASE p_partkey % 3 WHEN 0 THEN '' ELSE concat('>=', p_partkey % 10) END AS specifier", "p_partkey % 5 = 0 AS pinned",
        "p_partkey % 4 = 0 AS optional", "concat('d', p_partkey % 6) AS dependent", "CASE WHEN p_partkey % 5 = 0 THEN concat(p_size, '.', p_partkey % 7) END AS version", "cast(null AS string) AS error")
    return dependencies.merged(rows).select("package", "specifier", "version", "optional", F.size("dependents").cast("long").alias("dependents"))


@query
def affected_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts against one advisory per brand, open below the brand's mean size."""
    brands = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.floor(F.avg("p_size")).alias("mean"))
    advisories = brands.select(F.concat(F.lit("ADV-"), "p_brand").alias("advisory"), F.col("p_brand").alias("package"), F.concat(F.lit("<"), F.col("mean"), F.lit(".5 || >="), F.col("mean") + 10).alias("vulnerable"))
    return models.affected(facts.versions(spark, sf_dir), advisories)


@query
def longest_prefix_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model symbols: every host, and every host's English section."""
    rows = facts.symbols(spark, sf_dir)
    host = F.regexp_extract("url", r"^[a-z]+://([^/?#]+)", 1)
    hosts = rows.select(host.alias("host")).distinct()
    return models.longest_prefix(rows, hosts.select(F.col("host").alias("model")).unionAll(hosts.select(F.concat("host", F.lit(".en")).alias("model"))), "page_id")


#: Suffix models of the query below and their bits; fixed values, the same in its SQL.
SUFFIX_BITS = [("com.fr", 1), ("net.fr", 2), ("org.fr", 4), ("com.en", 8), ("net.en", 16), ("org.en", 32), ("en", 64), ("fr", 128), ("example.com.de", 256)]


@query
def suffix_sinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = facts.symbols(spark, sf_dir).select("page_id", F.regexp_replace("symbol", r"\.[0-9]+(\.html)?$", "").alias("symbol"))
    return models.suffix_kinds(rows, spark.createDataFrame(SUFFIX_BITS, "suffix string, bits long"), "page_id")


@query
def url_proof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a literal start of a URL fixes: host and path (refuted), the host alone (hotspot) or nothing."""
    fixed_path, fixed_host = F.col("url").rlike(r"^https?://[^/?#]+/[^?#]*[?#]"), F.col("url").rlike(r"^https?://[^/?#]+/")
    return table(spark, sf_dir, "pages").select("page_id", F.when(fixed_path, "refuted").when(fixed_host, "hotspot").otherwise("vulnerability").alias("verdict"))


@query
def value_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", findings.entropy(F.col("props")).alias("entropy"))


@query
def test_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with a path component of the given names."""
    return facts.symbols(spark, sf_dir).select("page_id", F.arrays_overlap(F.split("symbol", r"\."), F.array(*map(F.lit, ("blog", "m", "test", "tests")))).alias("in_test"))


@query
def module_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixpoint.closure(facts.module_edges(spark, sf_dir))


@query
def module_waves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.schedule(facts.modules(spark, sf_dir), facts.module_edges(spark, sf_dir))


@query
def cfg_reachable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.cfg_reachable(facts.cfg_edges(spark, sf_dir))


@query
def avoid_reachable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.cfg_reachable(facts.cfg_edges(spark, sf_dir), avoiding=3)


@query
def fixpoint_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = facts.cfg_edges(spark, sf_dir)
    starts = edges.select("function").distinct().withColumn("node", F.lit(0).cast("long"))
    return fixpoint.reach(starts, edges, ["function"])


@query
def dominators(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.dominators(facts.cfg_edges(spark, sf_dir))


@query
def dominance_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.dominance_frontier(facts.cfg_edges(spark, sf_dir))


@query
def liveness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.liveness(facts.cfg_names(spark, sf_dir))


@query
def reaching_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.reaching_definitions(facts.cfg_names(spark, sf_dir))


@query
def constant_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataflow.constant_lattice(table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_returnflag")


@query
def interval_hull(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataflow.interval_hull(table(spark, sf_dir, "lineitem"), ["l_partkey"], "l_extendedprice")


@query
def taint_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases and clicks add kinds, errors and signups clear them; the sinks are the views."""
    steps = table(spark, sf_dir, "events").selectExpr(
        "event_id", "user_id", "ts", "event_type", "CASE event_type WHEN 'purchase' THEN 13 WHEN 'click' THEN 2 ELSE 0 END AS adds",
        "CASE event_type WHEN 'error' THEN 5 WHEN 'signup' THEN 10 ELSE 0 END AS clears")
    return dataflow.taint_along(steps, "user_id", ["ts", "event_id"], "adds", "clears", [1, 2, 4, 8]).where("event_type = 'view' AND kinds <> 0").select("event_id", "kinds")


@query
def prior_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = table(spark, sf_dir, "events").selectExpr("event_id", "user_id", "event_type", "ts")
    return dataflow.prior_calls(calls, ["user_id", "event_type"], ["ts", "event_id"], "event_id")


@query
def guard_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    flows = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_quantity > 5 AS reachable", "l_returnflag = 'A' AS proved", "l_linestatus = 'O' AND l_tax > 0.06 AS authorized", "l_discount > 0.03 AS guarded")
    return dataflow.judge(flows, ["l_orderkey"])


@query
def route_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer")
    decorated = customer.where("c_acctbal > 5000").selectExpr("c_custkey", "0 AS precedence", "'decorator' AS model")
    based = customer.where("c_mktsegment = 'BUILDING'").selectExpr("c_custkey", "1 AS precedence", "'base' AS model")
    routed = customer.where("c_nationkey < 12").selectExpr("c_custkey", "2 AS precedence", "concat('route-', c_nationkey) AS model")
    return models.first_by_precedence(decorated.unionAll(based).unionAll(routed), "c_custkey")


@query
def severity_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders per status: how many, and the worst priority's rank (1-URGENT is 5)."""
    rank = 6 - F.substring("o_orderpriority", 1, 1).cast("long")
    return table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("findings"), F.sum(rank).alias("weight"), F.max(rank).alias("worst"))
