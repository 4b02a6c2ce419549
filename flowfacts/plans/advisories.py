"""Vulnerable dependencies with evidence: declared, imported or called, and the VEX statements that follow."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowfacts.frontend.taint import resolved
from flowfacts.frontend.tables import of
from flowfacts.operators.models import may_affect, prefixes, suffixes
from flowfacts.operators.tables import if_small, written
from flowfacts.sources.reports import vex_status

#: Evidence, weakest first; a place counts at its highest level.
LEVELS = {"declared": 0, "imported": 1, "called": 2}


def affected_packages(packages: DataFrame, advisories: DataFrame) -> DataFrame:
    """(advisory, package) of merged packages (package, specifier, version) that may be a vulnerable version; a locked version decides."""
    declared = packages.select(F.col("package").alias("requirement"), "package", F.coalesce(F.concat(F.lit("=="), "version"), "specifier").alias("specifier"))
    return may_affect(declared, advisories).select("advisory", "package").distinct()


def evidence(facts: DataFrame, packages: DataFrame, advisories: DataFrame) -> DataFrame:
    """(advisory, package, level, path, line, symbol) of advisories (advisory, package, vulnerable, affected_symbols, modules).

    declared: one row without a place for every pair that may be vulnerable. imported: imports of one of the advisory's modules
    or of something in it. called: calls of an affected symbol, by its whole name or, as packages give names to others' things,
    its dotted end, but for calls of the project's own functions.
    """
    pairs = written(affected_packages(packages, advisories).join(advisories.select("advisory", "package", "affected_symbols", "modules"), ["advisory", "package"]), "affected")
    few = pairs.count()
    declared = pairs.select("advisory", "package", F.lit("declared").alias("level"), F.lit(None).cast("string").alias("path"), F.lit(None).cast("long").alias("line"), F.lit(None).cast("string").alias("symbol"))
    modules = if_small(pairs.select("advisory", "package", F.explode("modules").alias("name")), few)
    imports = of(facts, "import").select("path", F.col("line").cast("long").alias("line"), F.col("text").alias("symbol")).withColumn("name", F.explode(prefixes(F.col("symbol"), 1)))
    imported = imports.join(modules, "name").select("advisory", "package", F.lit("imported").alias("level"), "path", "line", "symbol").distinct()
    symbols = if_small(pairs.select("advisory", "package", F.explode("affected_symbols").alias("name")), few)
    calls = resolved(facts).where("to_function IS NULL AND symbol <> ''").select("path", F.col("line").cast("long").alias("line"), "symbol").withColumn("name", F.explode(suffixes(F.col("symbol"))))
    called = calls.join(symbols, "name").select("advisory", "package", F.lit("called").alias("level"), "path", "line", "symbol").distinct()
    return declared.unionByName(imported).unionByName(called)


def findings(found: DataFrame, advisories: DataFrame) -> DataFrame:
    """One finding per advisory, package and place at its highest level: rule 'reachable-vulnerability' for calls, else
    'vulnerable-dependency', with the advisory's severity."""
    rank = F.coalesce(*[F.when(F.col("level") == k, v) for k, v in LEVELS.items()])
    best = found.groupBy("advisory", "package", "path", "line").agg(F.max_by(F.struct("level", "symbol"), F.struct(rank, "symbol")).alias("b")).select("advisory", "package", "path", "line", "b.*")
    return best.join(advisories.select("advisory", "package", "severity"), ["advisory", "package"]).withColumn("rule", F.when(F.col("level") == "called", "reachable-vulnerability").otherwise("vulnerable-dependency"))


def vex(facts: DataFrame, packages: DataFrame, advisories: DataFrame) -> DataFrame:
    """(advisory, package, status, justification) of a project: packages (package, specifier, version, dependents; dependents is null
    where no lock file tells them)."""
    found = written(evidence(facts, packages, advisories), "evidence")
    called = found.groupBy("advisory", "package").agg(F.bool_or(F.col("level") == "called").alias("reached"))
    partial = of(facts, "file").where("name <> 'analysed' OR c < b").limit(1).count()
    named = advisories.select("advisory", "package", (F.size("affected_symbols") > 0).alias("named"))
    rows = called.join(named, ["advisory", "package"]).join(packages.select("package", "dependents"), "package", "left").withColumn("complete", F.lit(not partial))
    return vex_status(rows)
