"""A whole project: module graph, content keys of modules, and the check from files to a report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowfacts.frontend import models as library
from flowfacts.frontend.tables import facts as facts_of
from flowfacts.frontend.tables import named, of
from flowfacts.operators import findings as ops
from flowfacts.operators.fixpoint import _dealt, closure
from flowfacts.operators.models import prefixes
from flowfacts.operators.tables import written
from flowfacts.plugins import Plugin, Registry, finding, taint_detector
from flowfacts.sources.comments import suppressions
from flowfacts.sources.policy import Policy, accepted

#: Folders and file names of tests; fixed values.
TESTS = r"(^|/)(tests?|testing)/|(^|/)(test_[^/]*|[^/]*_test|conftest)\.py$"


def is_test_code(path: F.Column) -> F.Column:
    return path.rlike(TESTS)


def module_graph(facts: DataFrame) -> DataFrame:
    """(src, dst, symbol): the module that each import names, the longest dotted prefix that is a module; null if none is."""
    modules = of(facts, "file").select(F.col("module").alias("dst")).distinct()
    wanted = of(facts, "import").select(F.col("module").alias("src"), F.col("text").alias("symbol")).distinct()
    spread = wanted.select("src", "symbol", F.explode(prefixes(F.col("symbol"), 1)).alias("dst"))
    found = spread.join(modules, "dst").groupBy("src", "symbol").agg(F.max_by("dst", F.length("dst")).alias("dst"))
    return wanted.join(found, ["src", "symbol"], "left").select("src", "dst", "symbol")


def module_keys(modules: DataFrame, edges: DataFrame) -> DataFrame:
    """(module, key) of modules (module, own: digest of its text) and import edges (src, dst): a key is made of the module's own
    digest and those of all it imports, directly or not, so that it changes when anything below changes."""
    reached = closure(edges.where("src <> dst")).where("src <> dst")
    count = reached.count()
    digests = _dealt(modules.select(F.col("module").alias("dst"), F.col("own").alias("below")), count, "dst").hint("shuffle_hash")
    below = _dealt(_dealt(reached, count, "dst").join(digests, "dst"), count, "src").groupBy(F.col("src").alias("module")).agg(
        F.array_sort(F.collect_list(F.struct("dst", "below"))).alias("b"))
    parts = F.concat(F.array("own"), F.coalesce(F.transform("b", lambda x: x["below"]), F.array().cast("array<string>")))
    # modules are what both joins hold in memory: what reaches a module that many import is very long, and only read
    return modules.hint("shuffle_hash").join(below, "module", "left").select("module", F.sha2(F.concat(F.array_join(parts, "\0"), F.lit("\0")), 256).alias("key"))


def changed_modules(keys: DataFrame, stored: DataFrame) -> DataFrame:
    """Modules whose key is not among the stored ones (module, key): those edited and whatever imports them."""
    return keys.join(stored.select("module", "key"), ["module", "key"], "left_anti").select("module")


def call_rules() -> Plugin:
    """The rules of the call models as one plugin."""
    from flowfacts.frontend import taint

    return Plugin("call-rules", ("call", "argument"), lambda ctx: finding(taint.reported_calls(ctx.table), F.col("rule"), F.col("severity"), "medium", F.concat(F.lit("call of "), "symbol"), symbol=F.col("symbol")))


def bundled() -> Registry:
    """All rules that come with the library."""
    return Registry([*(taint_detector(rule, f"untrusted value reaches a sink of {kind}") for rule, (kind, _, _) in library.SINKS.items()), call_rules()])


def check(files: DataFrame, registry: Registry | None = None, policy: Policy | None = None, baseline: DataFrame | None = None) -> DataFrame:
    """Findings of a project's files (path, text) with ``suppressed`` (a comment at the line), ``known`` (absorbed by a baseline of
    (path, rule, function, line text)) and ``test`` (in test code); findings of accepted advisories are left out.
    """
    registry = registry or bundled()
    facts = facts_of(files, library.prefixes(), nodes=False, kinds=tuple(sorted({k for p in registry.plugins.values() for k in p.requires})))
    found = written(registry.run(facts), "findings")
    found = accepted(found.withColumn("advisory", F.col("metadata")["advisory"]), policy or Policy()).drop("advisory")
    marked = ops.suppression_split(found, suppressions(files), ["path", "line"]).withColumn("test", is_test_code(F.col("path")))
    if baseline is None:
        return marked.withColumn("known", F.lit(False))
    lines = F.split("text", r"\r\n|\r|\n")
    texts = marked.join(files.select("path", "text"), "path", "left").withColumn("line_text", F.trim(F.get(lines, (F.col("line") - 1).cast("int")))).drop("text")
    return ops.baseline_split(texts, baseline, ["path", "rule", "function", "line_text"], ["line", "rule", "plugin_order"]).drop("line_text")


def coverage(facts: DataFrame) -> DataFrame:
    """One row: files, files analysed, functions, functions analysed, and the paths that were not fully analysed, sorted."""
    files = of(facts, "file")
    return files.agg(F.count("*").alias("files"), F.count_if(F.col("name") == "analysed").alias("files_analysed"), F.sum("b").alias("functions"), F.sum("c").alias("functions_analysed"),
                     F.array_sort(F.collect_list(F.when((F.col("name") != "analysed") | (F.col("c") < F.col("b")), F.col("path")))).alias("partial"))


def fails(findings: DataFrame, threshold: str) -> bool:
    """Whether a finding that is neither suppressed nor known has at least a severity."""
    rank = F.coalesce(*[F.when(F.col("severity") == k, v) for k, v in ops.SEVERITY_RANK.items()], F.lit(0))
    return not findings.where(~F.col("suppressed") & ~F.col("known") & (rank >= ops.SEVERITY_RANK[threshold])).limit(1).isEmpty()


def names_of(files: DataFrame) -> DataFrame:
    """Files with module names, and the names that several files would have (``ambiguous``)."""
    return named(files)
