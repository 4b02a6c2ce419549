"""Declared and locked packages from requirements files, pyproject.toml and lock files.

Input is a table of files (path string, text string), e.g. from ``read_files``; every reader gives rows of SCHEMA. A file
that can't be parsed gives one row with a null package and the reason in ``error``.
"""

from __future__ import annotations

import fnmatch
import re
import tomllib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowfacts.functions import versions
from flowfacts.operators.tables import shared_dir

SCHEMA = "path string, ordinal long, package string, specifier string, pinned boolean, optional boolean, dependent string, version string, error string"
_FIELDS = pa.schema([("path", pa.string()), ("ordinal", pa.int64()), ("package", pa.string()), ("specifier", pa.string()), ("pinned", pa.bool_()), ("optional", pa.bool_()), ("dependent", pa.string()), ("version", pa.string()), ("error", pa.string())])
#: Parts of a requirement in the grammar of PEP 508: name, extras in brackets, then a URL after @ or version clauses, which may
#: stand in parentheses; a marker follows a semicolon.
NAME = r"^[A-Za-z0-9](?:[A-Za-z0-9._-]*[A-Za-z0-9])?"
EXTRAS = r"^\s*\[[A-Za-z0-9,._\s-]*\]"
CLAUSES = r"^\s*\(?\s*([=<>!~^][^()@]*?)\s*\)?\s*$"
#: Files below folders of these names, or of hidden ones, are not a project's own; fixed values of the analysis.
SKIPPED = ("__pycache__", "node_modules", "venv", "build", "dist", "site-packages")


#: Files that the driver reads at once where Spark's readers pass them over.
AT_ONCE = 500


def _underscored(spark: SparkSession, root: str, pattern: str) -> DataFrame | None:
    """(path, content) of the matching files below root whose names begin with an underscore, such as __init__.py. Spark's file
    readers take these for its own and pass them over, so the driver reads them, AT_ONCE at a time, into a written table."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(root)
    system = hadoop.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    found, listed = [], system.listFiles(hadoop, True)
    while listed.hasNext():
        path = listed.next().getPath()
        if path.getName().startswith("_") and fnmatch.fnmatch(path.getName(), pattern):
            found.append(path)
    folder = f"{shared_dir(spark)}/flowfacts/underscored-{uuid.uuid4().hex}"
    for at in range(0, len(found), AT_ONCE):
        rows = []
        for path in found[at : at + AT_ONCE]:
            stream = system.open(path)
            try:
                rows.append((path.toString(), bytearray(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))))
            finally:
                stream.close()
        spark.createDataFrame(rows, "path string, content binary").write.mode("append").parquet(folder)
    return spark.read.parquet(folder) if found else None


def read_files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(path, text, status) of a project's own files below root whose names match the glob, in UTF-8, or UTF-16 by a byte
    order mark. Hidden and SKIPPED folders and environments (folders with a pyvenv.cfg) are left out. A file that can't be
    decoded keeps its row, with a null text and the status 'undecodable'; others are 'read'."""
    def load(glob: str) -> DataFrame:
        return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)

    base = spark._jvm.org.apache.hadoop.fs.Path(root).toUri().getPath().rstrip("/")
    own = F.regexp_replace(F.regexp_replace("path", r"^[a-z]+:/*", "/"), "^" + re.escape(base) + "/", "")
    folders = F.slice(F.split(own, "/"), 1, F.size(F.split(own, "/")) - 1)
    files, hidden = load(pattern).select("path", "content"), _underscored(spark, root, pattern)
    files = (files if hidden is None else files.unionByName(hidden)).where(~F.exists(folders, lambda f: f.startswith(".") | f.isin(*SKIPPED)))
    # few environments, but unbounded in principle: an anti join on the folders above each file
    environments = load("pyvenv.cfg").select(F.regexp_replace("path", r"/[^/]*$", "").alias("folder")).distinct()
    above = files.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("path", "/")) - 1), lambda n: F.array_join(F.slice(F.split("path", "/"), 1, n), "/"))).alias("folder"))
    files = files.join(above.join(environments, "folder").select("path").distinct(), "path", "left_anti")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [decoded(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_pydict({"path": batch.column(0), "text": pa.array(texts, pa.string()), "status": pa.array(["undecodable" if t is None else "read" for t in texts])})

    return files.select("path", "content").mapInArrow(decode, "path string, text string, status string")


def decoded(content: bytes) -> str | None:
    """Text of a file's bytes by its byte order mark, UTF-8 without one; None if they are no such text."""
    for mark, charset in ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be"), (b"", "utf-8")):
        if content.startswith(mark):
            try:
                return content[len(mark) :].decode(charset)
            except UnicodeDecodeError:
                return None
    return None


def _requirement(line: Column) -> Column:
    """struct<package, specifier> of a line without comment and marker; a URL leaves the specifier empty."""
    name = F.regexp_extract(line, NAME, 0)
    rest = F.regexp_replace(F.substring(line, F.length(name) + 1, F.length(line)), EXTRAS, "")
    return F.struct(versions.normalize(name).alias("package"), F.regexp_replace(F.regexp_extract(rest, CLAUSES, 1), r"\s+", "").alias("specifier"))


def requirements(files: DataFrame) -> DataFrame:
    """Lines ``name[extras]specifier ; marker # comment``; blank lines, comments and options (-r, --hash) are passed over. Of
    a package that a file names again the last line counts."""
    lines = files.select("path", F.posexplode(F.split("text", r"\r\n|\r|\n")).alias("ordinal", "line"))
    bare = F.trim(F.split(F.split("line", "#")[0], ";")[0])
    kept = lines.select("path", F.col("ordinal").cast("long"), bare.alias("line")).where("line <> '' AND NOT startswith(line, '-')")
    rows = kept.select("path", "ordinal", _requirement(F.col("line")).alias("r")).select("path", "ordinal", "r.package", "r.specifier").where("package <> ''")
    rows = rows.groupBy("path", "package").agg(F.max_by(F.struct("ordinal", "specifier"), "ordinal").alias("r")).select("path", "r.ordinal", "package", "r.specifier")
    return rows.select("path", "ordinal", "package", "specifier", versions.pinned(F.col("specifier")).isNotNull().alias("pinned"), F.lit(False).alias("optional"), F.lit(None).cast("string").alias("dependent"), F.lit(None).cast("string").alias("version"), F.lit(None).cast("string").alias("error"))


def _normal(name: str) -> str:
    return re.sub(r"[-_.]+", "-", name).lower()


def _pins(spec: str) -> bool:
    return spec.startswith("==") and "," not in spec and "|" not in spec and not spec.endswith(".*")


def _declared(text: str, optional: bool) -> tuple | None:
    text = text.split("#")[0].split(";")[0].strip()
    name = re.match(NAME, text)
    if not name:
        return None
    clauses = re.match(CLAUSES, re.sub(EXTRAS, "", text[name.end() :]))
    spec = re.sub(r"\s+", "", clauses[1]) if clauses else ""
    return _normal(name[0]), spec, _pins(spec), optional, None, None


def _pyproject(document: dict) -> list[tuple]:
    project, poetry = document.get("project", {}), document.get("tool", {}).get("poetry", {})
    rows = [_declared(x, False) for x in project.get("dependencies", [])]
    rows += [_declared(x, True) for group in project.get("optional-dependencies", {}).values() for x in group]
    groups = [(poetry.get("dependencies", {}), False), (poetry.get("dev-dependencies", {}), True)]
    groups += [(g.get("dependencies", {}), True) for g in poetry.get("group", {}).values()]
    for table, dev in groups:
        for name, value in table.items():
            if name.lower() == "python":
                continue
            spec = value if isinstance(value, str) else value.get("version", "") if isinstance(value, dict) else ""
            spec = "" if spec == "*" else re.sub(r"\s+", "", spec)
            spec = f"=={spec}" if re.fullmatch(r"[0-9][0-9.]*", spec) else spec
            maybe = isinstance(value, dict) and bool(value.get("optional"))
            rows.append((_normal(name), spec, _pins(spec), dev or maybe, None, None))
    return [r for r in rows if r]


def _needs(package: dict) -> list[str]:
    """Names a locked package requires, those of its extras and development groups included."""
    tables = [package.get("dependencies") or []]
    for key in ("optional-dependencies", "dev-dependencies"):
        tables += (package.get(key) or {}).values()
    return [_normal(n if isinstance(n, str) else n["name"]) for t in tables for n in t]


def _lock(document: dict) -> list[tuple]:
    """Pins, with an empty specifier, and edges; a project's own package is pinned, but is no dependent of others."""
    rows = []
    for package in document.get("package", []):
        name, source = _normal(package["name"]), package.get("source", {})
        own = isinstance(source, dict) and ("editable" in source or "virtual" in source)
        if isinstance(package.get("version"), str):
            rows.append((name, "", True, False, None, package["version"]))
        rows += [(need, None, False, False, None if own else name, None) for need in _needs(package)]
    return rows


def toml_packages(files: DataFrame) -> DataFrame:
    """Packages of pyproject.toml, poetry.lock and uv.lock files; lock edges are rows with a ``dependent`` and no specifier."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    document = tomllib.loads(text or "")
                    rows = _lock(document) if path.endswith(".lock") else _pyproject(document)
                    out += [(path, i, *r, None) for i, r in enumerate(rows)]
                except (tomllib.TOMLDecodeError, KeyError, TypeError, AttributeError) as error:
                    out.append((path, 0, None, None, False, False, None, None, f"{type(error).__name__}: {error}"))
            yield pa.RecordBatch.from_pylist([dict(zip(_FIELDS.names, r)) for r in out], schema=_FIELDS)

    return files.select("path", "text").mapInArrow(run, SCHEMA)


def packages(files: DataFrame) -> DataFrame:
    """Rows of all dependency files, each read by its name; other files give none."""
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    plain = requirements(files.where(name.rlike(r"^requirements.*\.txt$")))
    return plain.unionByName(toml_packages(files.where(name.isin("pyproject.toml", "poetry.lock", "uv.lock"))))


def merged(rows: DataFrame) -> DataFrame:
    """One row per package over (path, ordinal) order: the first specifier that isn't empty, the last pin, optional only if
    every declaration is, and all dependents. One aggregation keyed by package."""
    at = F.struct("path", "ordinal")
    declared = F.col("specifier").isNotNull()
    pin = F.coalesce("version", F.regexp_replace("specifier", r"^={2,3}", ""))
    return rows.where("package IS NOT NULL").groupBy("package").agg(
        F.min_by("specifier", F.when(F.col("specifier") != "", at)).alias("specifier"),
        F.max_by(pin, F.when(F.col("pinned"), at)).alias("version"),
        F.coalesce(F.bool_and(F.when(declared, F.col("optional"))), F.lit(False)).alias("optional"),
        F.array_sort(F.collect_set("dependent")).alias("dependents"),
    ).select("package", F.coalesce("specifier", F.lit("")).alias("specifier"), "version", "optional", "dependents")


#: Severities of advisory records; fixed names. Any other is medium.
SEVERITIES = {"low": "low", "moderate": "medium", "medium": "medium", "high": "high", "critical": "critical"}


def osv_advisories(records: DataFrame) -> DataFrame:
    """(advisory, package, vulnerable, summary, severity, aliases) of OSV records read by spark.read.json with OSV_SCHEMA, one
    row per affected package of the PyPI ecosystem (in any case) with a usable range.

    Only ranges of versions count (ECOSYSTEM and SEMVER); all stretches of one package are alternatives. A package without
    such a range gives no row. A blank summary becomes the first line of the details, or the id; records without id are left
    out.
    """
    label = F.lower("database_specific.severity")
    severity = F.coalesce(*[F.when(label == k, v) for k, v in SEVERITIES.items()], F.lit("medium"))
    first = F.split(F.trim("details"), r"\r\n|\r|\n")[0]
    summary = F.coalesce(F.when(F.trim("summary") != "", F.trim("summary")), F.when(F.trim("details") != "", first), F.col("id"))
    affected = records.where("id IS NOT NULL").select("id", summary.alias("summary"), "aliases", severity.alias("severity"), F.explode("affected").alias("a"))
    affected = affected.where("lower(a.package.ecosystem) = 'pypi' AND a.package.name <> ''")
    ranges = F.filter("a.ranges", lambda r: r["type"].isin("ECOSYSTEM", "SEMVER"))
    found = F.flatten(F.transform(ranges, lambda r: versions.osv_specifiers(r["events"])))
    rows = affected.withColumn("found", found).where("size(found) > 0")
    return rows.select(F.col("id").alias("advisory"), versions.normalize(F.col("a.package.name")).alias("package"), F.array_join("found", " || ").alias("vulnerable"), "summary", "severity", F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"))


OSV_SCHEMA = (
    "id string, summary string, details string, aliases array<string>, database_specific struct<severity: string>, "
    "affected array<struct<package: struct<ecosystem: string, name: string>, "
    "ranges: array<struct<type: string, events: array<struct<introduced: string, fixed: string, last_affected: string>>>>>>"
)
