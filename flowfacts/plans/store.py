"""A store of facts by content: only files whose content was never seen are parsed; what they import says which modules changed.

A file's facts depend on its own text, name and the options, so they are stored under a digest of these. A module's key is made
of its component (modules that import one another) and of the keys of the components these import; keys are combined in waves
from the modules that import nothing, and no closure is made. A folder of the store is whole if Spark marked it so, and the
newest whole one counts; so a run that is cut off leaves the store as it was.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowfacts.frontend import models as library
from flowfacts.frontend.tables import SCHEMA, named
from flowfacts.frontend.tables import facts as facts_of
from flowfacts.operators.fixpoint import met
from flowfacts.operators.graph import strong_components
from flowfacts.operators.tables import discard, joined, written

from .project import module_graph

#: Raised whenever what is stored would be made otherwise from the same text.
VERSION = "1"


def _parts(digests: Column) -> list[Column]:
    """Four numbers of 15 digits each of digests: their sums are the same for the same digests in any order."""
    return [F.conv(F.substring(digests, 15 * k + 1, 15), 16, 10).cast("decimal(38,0)") for k in range(4)]


def _text(parts: list[Column]) -> Column:
    return F.concat_ws("/", *[F.coalesce(p.cast("string"), F.lit("-")) for p in parts])


def component_keys(modules: DataFrame, edges: DataFrame, named: bool = True) -> DataFrame:
    """(module, component, key) of modules (module, own: digest) and import edges (src, dst), a written table: modules that reach
    one another have one key, which changes when anything they reach changes. Edges to what is no module are left out. named:
    whether a module's name is part of its key; if not, own must tell modules apart. More columns of modules are digests of other
    states of the same graph: a column x gives x_key, by the same components and waves.

    A wave gives keys to all components whose imports have theirs. It takes the edges to components of the wave before, each edge
    in one wave only, and keeps sums for components that wait for others as well. Waves grow with the depth of imports between
    components; a wave writes one table, and edges carry the digests of the component that imports.
    """
    states = [c for c in modules.columns if c != "module"]
    key = {c: "key" if c == "own" else f"{c}_key" for c in states}
    modules = written(modules.groupBy("module").agg(*[F.min(c).alias(c) for c in states]), "modules")
    names = modules.select("module")
    total = modules.count()
    edges = written(edges.select("src", "dst").distinct(), "imports")
    size = max(total, edges.count())
    inside = written(joined(joined(edges, names.toDF("src"), size, ["src"], "left_semi", narrow=True), names.toDF("dst"), size, ["dst"], "left_semi", narrow=True).select("src", "dst"), "imports")
    of = written(strong_components(names.toDF("node"), inside).withColumnRenamed("node", "module"), "components")
    side = of.select(F.col("module").alias("src"), F.col("component").alias("above")), of.select(F.col("module").alias("dst"), F.col("component").alias("below"))
    crossing = written(joined(joined(inside, side[0], size, ["src"], narrow=True), side[1], size, ["dst"], narrow=True).where("above <> below").select("above", "below").distinct(), "between")
    digests = {c: F.sha2(F.concat_ws("/", F.col("module").cast("string"), c), 256) if named else F.col(c) for c in states}
    own = joined(modules, of, size, ["module"], narrow=True).select("component", F.lit(0).alias("needed"), *[d.alias(c) for c, d in digests.items()])
    imports = crossing.select(F.col("above").alias("component"), F.lit(1).alias("needed"), *[F.lit(None).cast("string").alias(c) for c in states])
    own = written(own.unionAll(imports).groupBy("component").agg(F.sum("needed").alias("needed"), *[_text([F.sum(p) for p in _parts(F.col(c))]).alias(c) for c in states]), "component-digests")
    between = written(joined(crossing, own.withColumnRenamed("component", "above"), size, ["above"], narrow=True), "between")
    parts = [p.alias(f"{c}{k}") for c in states for k, p in enumerate(_parts(F.col(key[c])))]
    done, waiting, waves = [own.where("needed = 0").select("component", *[F.sha2(c, 256).alias(key[c]) for c in states])], None, []
    count = done[0].count()
    while count:
        waves.append(met(between, done[-1].withColumnRenamed("component", "below"), count, size, waiting, parts, states))
        waiting = waves[-1].where("met < needed")
        ready = waves[-1].where("met = needed")
        done.append(ready.select(F.col("above").alias("component"), *[F.sha2(F.concat_ws("/", c, _text([F.col(f"{c}{k}") for k in range(4)])), 256).alias(key[c]) for c in states]))
        count = ready.count()
    found = written(joined(of, reduce(DataFrame.unionByName, done), size, ["component"], narrow=True).select("module", "component", *key.values()), "module-keys")
    discard(modules, edges, inside, of, own, crossing, between, *waves)
    return found


def _versions(spark: SparkSession, folder: str) -> list[int]:
    """Whole versions below a folder, oldest first."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not system.exists(path):
        return []
    inside = [s.getPath() for s in system.listStatus(path)]
    return sorted(int(p.getName()[2:]) for p in inside if p.getName().startswith("v=") and system.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


class Store:
    """Facts and keys of a project in a folder that all executors share.

    facts/v=N holds what version N added: facts with ``content``, the digest of the file they are of. keys/v=N holds the state
    after it: path, module, content, component, key of every file. Nothing is changed in place; ``compact`` joins the versions
    of facts into one that holds current contents only.
    """

    def __init__(self, spark: SparkSession, folder: str, sources: tuple[str, ...] | None = None):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.sources = library.prefixes() if sources is None else sources

    def _read(self, kind: str, versions: list[int], schema: str) -> DataFrame:
        if not versions:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.folder}/{kind}/v={v}" for v in versions])

    def keys(self) -> DataFrame:
        """The state after the last update; empty before the first."""
        return self._read("keys", _versions(self.spark, f"{self.folder}/keys")[-1:], "path string, module string, content string, component string, key string")

    def _stored(self) -> DataFrame:
        return self._read("facts", _versions(self.spark, f"{self.folder}/facts"), f"content string, {SCHEMA}")

    def facts(self) -> DataFrame:
        """Facts (SCHEMA) of the files as they were at the last update."""
        return self._stored().join(self.keys().select("content"), "content", "left_semi").drop("content")

    def update(self, files: DataFrame) -> DataFrame:
        """Brings the store up to the files (path, text) of a project; (module) of those to analyse again: edited, new, or
        reaching one that is, by imports. Files of known content are not parsed, files that are gone are forgotten. Repeated
        paths count once."""
        rows = named(files.select("path", "text").groupBy("path").agg(F.min("text").alias("text"))).select("path", "module", "is_package", "text")
        options = F.lit("/".join([VERSION, *self.sources]))
        content = F.sha2(F.concat_ws("\0", options, "path", "module", F.col("is_package").cast("string"), F.coalesce("text", F.lit("\0"))), 256)
        rows = written(rows.withColumn("content", content), "files")
        before = written(self.keys(), "keys-before")
        fresh = rows.join(self._stored().select("content").distinct(), "content", "left_anti")
        versions = [*_versions(self.spark, f"{self.folder}/facts"), *_versions(self.spark, f"{self.folder}/keys"), 0]
        version = max(versions) + 1
        if not fresh.isEmpty():
            made = facts_of(fresh.select("path", "module", "is_package", "text"), self.sources, nodes=False)
            made.join(fresh.select("path", "content"), "path").select("content", *made.columns).write.mode("overwrite").parquet(f"{self.folder}/facts/v={version}")
            discard(made)
        current = self._stored().join(rows.select("content"), "content", "left_semi")
        edges = module_graph(current.where("kind IN ('file', 'import')")).where("dst IS NOT NULL").select("src", "dst")
        keyed = component_keys(rows.select("module", F.col("content").alias("own")), edges)
        rows.select("path", "module", "content").join(keyed, "module").select("path", "module", "content", "component", "key").write.mode("overwrite").parquet(f"{self.folder}/keys/v={version}")
        changed = written(keyed.join(before.select("module", "key").distinct(), ["module", "key"], "left_anti").select("module").distinct(), "changed")
        discard(rows, before, keyed)
        return changed

    def compact(self) -> None:
        """Joins all versions of facts into a new one of current contents, and removes the older ones and older keys."""
        facts, keys = (_versions(self.spark, f"{self.folder}/{kind}") for kind in ("facts", "keys"))
        if not facts:
            return
        version = max(facts + keys) + 1
        self._stored().join(self.keys().select("content"), "content", "left_semi").write.mode("overwrite").parquet(f"{self.folder}/facts/v={version}")
        for kind, old in (("facts", facts), ("keys", keys[:-1])):
            for v in old:
                _remove(self.spark, f"{self.folder}/{kind}/v={v}")
