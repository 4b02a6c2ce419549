"""Plugins: rules as functions from fact tables to findings, with declared inputs, manifests and checked refinements."""

from __future__ import annotations

import re
import tomllib
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowfacts.frontend.tables import KINDS, of
from flowfacts.operators import findings as secrets
from flowfacts.operators.tables import written

API_VERSION = 1
#: Columns of findings; ``metadata`` is a map of strings.
COLUMNS = ["path", "line", "rule", "severity", "confidence", "message", "function", "metadata"]
_SAME = ("path", "line", "rule", "message", "function")


class Undeclared(Exception):
    """A plugin asked for facts it did not declare."""


class Context:
    """What a plugin may see: the facts of the kinds it requires."""

    def __init__(self, facts: DataFrame, requires: Iterable[str], shared: dict[tuple, DataFrame] | None = None):
        self._facts, self.requires, self._shared = facts, frozenset(requires), {} if shared is None else shared

    def facts(self, kind: str) -> DataFrame:
        if kind not in self.requires:
            raise Undeclared(f"'{kind}' is not among the plugin's requires")
        return of(self._facts, kind)

    def once(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """A result that all plugins with the same requires share in a run."""
        key = (name, self.requires)
        if key not in self._shared:
            self._shared[key] = make()
        return self._shared[key]

    @property
    def table(self) -> DataFrame:
        """All facts of the declared kinds in one table."""
        return self._facts.where(F.col("kind").isin(*self.requires))


@dataclass
class Plugin:
    """A rule: ``analyze`` gets a Context and gives findings; ``refine``, if given, gets all findings of a project and may change
    severity and confidence and add metadata."""

    name: str
    requires: tuple[str, ...]
    analyze: Callable[[Context], DataFrame] | None = None
    refine: Callable[[DataFrame], DataFrame] | None = None
    provides: tuple[str, ...] = ()


def finding(df: DataFrame, rule: str | Column, severity: str | Column, confidence: str | Column, message: str | Column, **metadata: Column) -> DataFrame:
    """Rows (path, line, function and others) as findings."""
    def column(x: str | Column) -> Column:
        return F.lit(x) if isinstance(x, str) else x

    pairs = [c for k, v in metadata.items() for c in (F.lit(k), v.cast("string"))]
    return df.select("path", F.col("line").cast("long").alias("line"), column(rule).alias("rule"), column(severity).alias("severity"), column(confidence).alias("confidence"), column(message).alias("message"), "function",
                     (F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")).alias("metadata"))


def taint_detector(rule: str, title: str, confidence: str = "high") -> Plugin:
    """Flows of one rule of the sink models; a hotspot lowers the confidence by one step."""
    from flowfacts.frontend import taint

    lower = {"high": "medium", "medium": "low", "low": "low"}[confidence]

    def analyze(ctx: Context) -> DataFrame:
        found = ctx.once("flows", lambda: written(taint.flows(ctx.table), "flows")).where(F.col("rule") == rule)
        sure = F.when(F.col("verdict") == "hotspot", lower).otherwise(confidence)
        return finding(found, rule, F.col("severity"), sure, title, symbol=F.col("symbol"), sources=F.array_join("sources", ", "), verdict=F.col("verdict"))

    return Plugin(rule, ("flow", "call", "parameter", "decorator", "function", "prefix"), analyze, provides=(f"vulnerability.{rule}",))


def call_detector(rule: str, title: str, severity: str, symbols: list[str], accepts: Column | None = None, confidence: str = "high") -> Plugin:
    """Calls of the given symbols for which accepts holds, a column over the facts of kind 'call'."""
    def analyze(ctx: Context) -> DataFrame:
        calls = ctx.facts("call").where(F.col("text").isin(*symbols))
        return finding(calls.where(accepts) if accepts is not None else calls, rule, severity, confidence, title, symbol=F.col("text"))

    return Plugin(rule, ("call",), analyze, provides=(f"vulnerability.{rule}",))


def secret_detector(texts: DataFrame, names: str = secrets.CREDENTIAL_NAME, floor: float = secrets.ENTROPY_FLOOR, least: int = 1) -> DataFrame:
    """Findings of assigned secrets in texts (path, text): names is the pattern of credential names, floor the entropy from which a
    value of any name is reported, least the shortest value."""
    found = secrets.assigned_secrets(texts, "path", "text", names, floor, least)
    return finding(found.withColumns({"line": F.lit(None), "function": F.lit(None).cast("string")}), F.col("rule"), F.col("severity"), F.col("confidence"), "a value that looks like a secret", name=F.col("name"), digest=F.col("digest"))


class Registry:
    """Plugins by unique name, and what provides a capability."""

    def __init__(self, plugins: Iterable[Plugin] = ()):
        self.plugins: dict[str, Plugin] = {}
        for p in plugins:
            self.register(p)

    def register(self, plugin: Plugin) -> None:
        if plugin.name in self.plugins:
            raise ValueError(f"two plugins are named '{plugin.name}'")
        unknown = set(plugin.requires) - set(KINDS)
        if unknown:
            raise ValueError(f"plugin '{plugin.name}' requires facts that nothing makes: {sorted(unknown)}")
        self.plugins[plugin.name] = plugin

    def providing(self, capability: str) -> list[Plugin]:
        return [p for p in self.plugins.values() if capability in p.provides]

    def run(self, facts: DataFrame) -> DataFrame:
        """Findings of all plugins, in their order (``plugin_order``), then refined by those that refine."""
        out, shared = None, {}
        for k, p in enumerate(self.plugins.values()):
            if p.analyze:
                part = p.analyze(Context(facts, p.requires, shared)).select(*COLUMNS).withColumn("plugin_order", F.lit(k))
                out = part if out is None else out.unionByName(part)
        if out is None:
            raise ValueError("no plugin analyses anything")
        for p in self.plugins.values():
            if p.refine:
                out = apply_refinement(p.name, out, p.refine)
        return out


def apply_refinement(name: str, findings: DataFrame, refine: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Findings refined by a plugin, which sees them with a ``finding_id``. ValueError if it drops, adds or moves findings, changes
    what is fixed, or alters metadata; changed severities and confidences are kept in the metadata with the refiner's name."""
    before = written(findings.withColumn("finding_id", F.monotonically_increasing_id()), "findings")
    after = written(refine(before).select(*before.columns), "refined")
    both = before.select("finding_id", F.struct(*before.columns).alias("b")).join(after.select("finding_id", F.struct(*before.columns).alias("a")), "finding_id", "full")
    moved = F.coalesce(F.col("a").isNull() | F.col("b").isNull(), F.lit(True))
    for c in _SAME:
        moved = moved | ~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    lost = F.exists(F.map_entries("b.metadata"), lambda e: ~F.col("a.metadata")[e["key"]].eqNullSafe(e["value"]))
    if after.count() != before.count() or both.where(moved | F.coalesce(lost, F.lit(False))).limit(1).count():
        raise ValueError(f"plugin '{name}' did more than reclassify findings")
    metadata, changed = F.col("a.metadata"), F.lit(False)
    for c in ("severity", "confidence"):
        differs = F.col(f"a.{c}") != F.col(f"b.{c}")
        metadata = F.when(differs & ~F.map_contains_key(metadata, F.lit(f"original_{c}")), F.map_concat(metadata, F.create_map(F.lit(f"original_{c}"), F.col(f"b.{c}")))).otherwise(metadata)
        changed = changed | differs
    by = F.concat_ws(",", metadata["refined_by"], F.lit(name))
    metadata = F.when(changed, F.map_concat(F.map_filter(metadata, lambda k, v: k != "refined_by"), F.create_map(F.lit("refined_by"), by))).otherwise(metadata)
    return both.withColumn("_m", metadata).select("a.*", "_m").withColumn("metadata", F.col("_m")).drop("_m", "finding_id")


_RANGE = re.compile(r"(>=|<=|==|>|<)?\s*([0-9]+)")


@dataclass(frozen=True)
class Manifest:
    """What a plugin's TOML file says."""

    name: str
    version: str
    plugin_api: str
    requires: tuple[str, ...]
    provides: tuple[str, ...]
    module: str
    cls: str
    bounds: tuple[tuple[str, int], ...] = field(default=())

    def accepts(self, api: int = API_VERSION) -> bool:
        """Whether the range of API versions holds a version."""
        holds = {"==": api.__eq__, ">=": api.__ge__, "<=": api.__le__, ">": api.__gt__, "<": api.__lt__}
        return all(holds[op](n) for op, n in self.bounds)


def manifest(text: str) -> Manifest:
    """A manifest from TOML; ValueError names the first part that is missing or has a wrong type."""
    try:
        data = tomllib.loads(text)
    except tomllib.TOMLDecodeError as error:
        raise ValueError(f"manifest: {error}") from error
    entry = data.get("entrypoint")
    for name, value, kind in (*((k, data.get(k), str) for k in ("name", "version", "plugin_api")), *((k, data.get(k), list) for k in ("requires", "provides")), ("entrypoint", entry, dict)):
        if not isinstance(value, kind) or kind is str and not value or kind is list and not all(isinstance(v, str) for v in value):
            raise ValueError(f"manifest: '{name}' is missing or of a wrong type")
    if not all(isinstance(entry.get(k), str) for k in ("module", "class")):
        raise ValueError("manifest: 'entrypoint' needs a module and a class")
    bounds = []
    for part in data["plugin_api"].split(","):
        found = _RANGE.fullmatch(part.strip())
        if not found:
            raise ValueError("manifest: 'plugin_api' is no range of versions")
        bounds.append((found[1] or "==", int(found[2])))
    return Manifest(data["name"], data["version"], data["plugin_api"], tuple(data["requires"]), tuple(data["provides"]), entry["module"], entry["class"], tuple(bounds))
