"""Project policies (TOML) and advisory files (JSON, schema 1)."""

from __future__ import annotations

import re
import tomllib
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowfacts.functions import versions

SCHEMA_VERSION = 1
ADVISORIES = "schema int, advisories array<struct<id: string, package: string, vulnerable: string, summary: string, severity: string, affected_symbols: array<string>, aliases: array<string>, modules: array<string>, entry_points: array<struct<symbol: string, justification: string>>>>"


@dataclass(frozen=True)
class Policy:
    """Packages that are denied, whether every requirement must be pinned, and advisories that are accepted."""

    deny: frozenset[str] = frozenset()
    require_pinned: bool = False
    ignore: frozenset[str] = frozenset()


def policy(text: str) -> Policy:
    """A policy from TOML: [dependencies] deny and require_pinned, [advisories] ignore. ValueError if a part has a wrong type."""
    try:
        data = tomllib.loads(text)
    except tomllib.TOMLDecodeError as error:
        raise ValueError(f"policy: {error}") from error
    dependencies, advisories = data.get("dependencies", {}), data.get("advisories", {})
    names, ignored, pinned = dependencies.get("deny", []), advisories.get("ignore", []), dependencies.get("require_pinned", False)
    if not all(isinstance(x, list) and all(isinstance(n, str) for n in x) for x in (names, ignored)) or not isinstance(pinned, bool):
        raise ValueError("policy: deny and ignore are lists of names, require_pinned is true or false")
    return Policy(frozenset(re.sub(r"[-_.]+", "-", n).lower() for n in names), pinned, frozenset(ignored))


def policy_findings(packages: DataFrame, rules: Policy) -> DataFrame:
    """(package, rule, severity) of merged packages (package, specifier, version, optional) that break a policy."""
    denied = packages.where(F.col("package").isin(*rules.deny) if rules.deny else F.lit(False)).select("package", F.lit("denied-dependency").alias("rule"), F.lit("high").alias("severity"))
    loose = packages.where((F.col("version").isNull() & versions.pinned(F.col("specifier")).isNull()) if rules.require_pinned else F.lit(False))
    return denied.unionByName(loose.select("package", F.lit("unpinned-dependency").alias("rule"), F.lit("low").alias("severity")))


def accepted(findings: DataFrame, rules: Policy, advisory: str = "advisory") -> DataFrame:
    """findings without those of accepted advisories; findings of no advisory stay."""
    return findings.where(F.col(advisory).isNull() | ~F.col(advisory).isin(*rules.ignore)) if rules.ignore else findings


def advisories(files: DataFrame) -> DataFrame:
    """(advisory, package, vulnerable, summary, severity, aliases, modules, affected_symbols, entry_points) of advisory files (path,
    text). A file of another schema, or an advisory without id or package, gives a row with ``error`` alone."""
    read = files.select("path", F.from_json("text", ADVISORIES).alias("r"))
    wrong = read.where(F.col("r").isNull() | F.col("r.schema").isNull() | (F.col("r.schema") != SCHEMA_VERSION)).select("path", F.lit("unknown schema").alias("error"))
    rows = read.where(F.col("r.schema") == SCHEMA_VERSION).select("path", F.explode("r.advisories").alias("a"))
    broken = rows.where("a.id IS NULL OR a.package IS NULL").select("path", F.lit("advisory without id or package").alias("error"))
    good = rows.where("a.id IS NOT NULL AND a.package IS NOT NULL").select(
        "path", F.col("a.id").alias("advisory"), versions.normalize(F.col("a.package")).alias("package"), F.coalesce("a.vulnerable", F.lit("")).alias("vulnerable"), "a.summary", F.coalesce("a.severity", F.lit("medium")).alias("severity"),
        *[F.coalesce(f"a.{c}", F.array().cast("array<string>")).alias(c) for c in ("aliases", "modules", "affected_symbols")], "a.entry_points")
    return good.unionByName(wrong.unionByName(broken), allowMissingColumns=True)


def dump_advisories(rows: DataFrame) -> DataFrame:
    """One JSON record per advisory row, to be read again by ``advisories`` inside a document of schema 1."""
    return rows.select(F.to_json(F.struct(F.col("advisory").alias("id"), "package", "vulnerable", "summary", "severity", "affected_symbols", "aliases", "modules", "entry_points")).alias("value"))
