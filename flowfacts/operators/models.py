"""Joins of dotted symbols with model tables: longest prefix, suffixes, version ranges, precedence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowfacts.functions import versions

from .tables import if_small


def dotted(url: Column) -> Column:
    """Host and path of a URL as a dotted symbol, without scheme, query, fragment and a last slash."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(url, r"^[a-z]+://|[?#].*$", ""), r"/+$", ""), "/", ".")


def prefixes(symbol: Column, least: int = 2) -> Column:
    """All dotted prefixes with at least `least` components."""
    parts = F.split(symbol, r"\.")
    lengths = F.when(F.size(parts) >= least, F.sequence(F.lit(least), F.size(parts))).otherwise(F.array().cast("array<int>"))
    return F.transform(lengths, lambda n: F.array_join(F.slice(parts, 1, n), "."))


def suffixes(symbol: Column) -> Column:
    """The symbol and all its dotted suffixes."""
    parts = F.split(symbol, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, n, F.size(parts)), "."))


def longest_prefix(symbols: DataFrame, models: DataFrame, key: str, symbol: str = "symbol") -> DataFrame:
    """(key, model): the longest model (column model) that is a dotted prefix of the symbol. Rows without one are left out."""
    spread = symbols.select(key, F.explode(prefixes(F.col(symbol))).alias("model"))
    return spread.join(models.select("model").distinct(), "model").groupBy(key).agg(F.max_by("model", F.length("model")).alias("model"))


def suffix_kinds(symbols: DataFrame, models: DataFrame, key: str, symbol: str = "symbol") -> DataFrame:
    """(key, kinds): bits of all models (suffix, bits) that end the symbol at a dot, merged."""
    spread = symbols.select(key, F.explode(suffixes(F.col(symbol))).alias("suffix"))
    return spread.join(models, "suffix").groupBy(key).agg(F.bit_or("bits").alias("kinds"))


def affected(requirements: DataFrame, advisories: DataFrame) -> DataFrame:
    """Requirements (requirement, package, version text) joined with the advisories (advisory, package, vulnerable) whose
    range they meet: an equi join on the package, then the range. Both sides are parsed once, before they meet. Advisories
    are broadcast if they are few; if not, a popular package is left to the skew join of adaptive execution."""
    specifiers = advisories.select("advisory", "package", versions.compiled(F.col("vulnerable")).alias("compiled"))
    parsed = requirements.select("requirement", "package", "version", versions.parse(F.col("version")).alias("parsed"))
    both = parsed.join(if_small(specifiers, advisories.count()), "package")
    return both.where(versions.meets(F.col("parsed"), F.col("compiled"))).select("requirement", "advisory", "package", "version")


def may_affect(requirements: DataFrame, advisories: DataFrame) -> DataFrame:
    """(requirement, advisory, package) of the requirements (requirement, package, specifier) some version of which may be
    vulnerable by an advisory (advisory, package, vulnerable)."""
    spec = F.coalesce("specifier", F.lit(""))
    left = requirements.select("requirement", "package", versions.pinned(spec).alias("pin"), versions.compiled(spec).alias("declared"))
    right = advisories.select("advisory", "package", versions.compiled(F.col("vulnerable")).alias("vulnerable"))
    both = left.join(if_small(right, advisories.count()), "package")
    return both.where(versions.may_meet(F.col("pin"), F.col("declared"), F.col("vulnerable"))).select("requirement", "advisory", "package")


def first_by_precedence(candidates: DataFrame, key: str) -> DataFrame:
    """(key, model): the candidate with the least precedence, ties to the smaller model name."""
    return candidates.groupBy(key).agg(F.min_by("model", F.struct("precedence", "model")).alias("model"))
