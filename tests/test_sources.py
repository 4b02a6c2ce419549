"""Readers of dependency files and report sinks on small fixtures."""

import json

import pytest
from flowfacts.functions import versions
from flowfacts.sources import dependencies, reports
from pyspark.sql import functions as F

FILES = [
    ("a/requirements.txt", "Zope_Kit[all]>=4.2, !=4.3 ; python_version > '3'\n# note\n-r other.txt\n\nquart==0.19.4  # pinned\nbare\ntool @ https://example.org/tool.whl\n(no name)\nlast>=1\nlast>=2\nparen (>=3,<4)\n"),
    ("b/pyproject.toml", '[project]\ndependencies = ["Quart>=0.18"]\n[project.optional-dependencies]\ntest = ["mypkg-dev"]\n[tool.poetry.dependencies]\npython = "^3.11"\ntables = "*"\npretty = {version = "^13.0", optional = true}\n'),
    ("c/uv.lock", '[[package]]\nname = "app"\nversion = "0"\nsource = {editable = "."}\ndependencies = [{name = "quart"}]\n[[package]]\nname = "quart"\nversion = "0.19.9"\ndependencies = [{name = "hyper"}]\n[package.optional-dependencies]\ndot = [{name = "dots"}]\n[package.dev-dependencies]\ndev = [{name = "checks"}]\n[[package]]\nname = "hyper"\nversion = "7.4"\n'),
    ("d/pyproject.toml", "[project\n"),
    ("e/notes.txt", "quart==1"),
    ("f/requirements.txt", None),
    ("g/poetry.lock", '[[package]]\nname = "dots"\nversion = "2.0"\n[package.dependencies]\nhyper = ">=7"\n'),
]


def test_dependency_files(spark):
    rows = dependencies.packages(spark.createDataFrame(FILES, "path string, text string"))
    bad = rows.where("error IS NOT NULL").collect()
    assert [r.path for r in bad] == ["d/pyproject.toml"]
    got = {r.package: (r.specifier, r.version, r.optional, r.dependents) for r in dependencies.merged(rows).collect()}
    assert got == {
        "zope-kit": (">=4.2,!=4.3", None, False, []),
        "quart": ("==0.19.4", "0.19.9", False, []),
        "bare": ("", None, False, []),
        "tool": ("", None, False, []),
        "last": (">=2", None, False, []),
        "paren": (">=3,<4", None, False, []),
        "mypkg-dev": ("", None, True, []),
        "tables": ("", None, False, []),
        "pretty": ("^13.0", None, True, []),
        "app": ("", "0", False, []),
        "hyper": ("", "7.4", False, ["dots", "quart"]),
        "dots": ("", "2.0", False, ["quart"]),
        "checks": ("", None, False, ["quart"]),
    }


def test_no_dependency_files(spark):
    none = spark.createDataFrame([], "path string, text string")
    assert dependencies.merged(dependencies.packages(none)).collect() == []


def test_a_project_s_own_files(spark, tmp_path):
    files = {"app/a.py": b"x = 1", "app/b.py": b"\xff\xfe" + "y".encode("utf-16-le"), "app/bad.py": b"\xff\x00\xff", "app/mark.py": b"\xef\xbb\xbfz", "app/__init__.py": b"", "venv/__init__.py": b"", ".git/c.py": b"", "build/d.py": b"", "env/pyvenv.cfg": b"", "env/lib/e.py": b"", "app/node_modules/f.py": b""}
    for name, content in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(content)
    got = {r.path.split("/")[-1]: (r.text, r.status) for r in dependencies.read_files(spark, str(tmp_path), "*.py").collect()}
    assert got == {"a.py": ("x = 1", "read"), "b.py": ("y", "read"), "bad.py": (None, "undecodable"), "mark.py": ("z", "read"), "__init__.py": ("", "read")}


def test_osv_ranges(spark):
    def record(number, ranges, kind="ECOSYSTEM", ecosystem="PyPI", **more):
        return {"id": f"R-{number}", "summary": "s", "affected": [{"package": {"ecosystem": ecosystem, "name": "Lib_One"}, "ranges": [{"type": kind, "events": r} for r in ranges]}], **more}

    low, high = [{"introduced": "0"}, {"fixed": "7.1"}], [{"introduced": "8.0"}, {"last_affected": "8.6"}]
    records = [
        record(0, [low]), record(1, [high]), record(2, [[{"introduced": "9.2"}]]), record(3, [low, high], "SEMVER", database_specific={"severity": "MODERATE"}),
        record(4, [[*low, {"introduced": "8.0"}, {"fixed": "8.3"}]], ecosystem="pypi", database_specific={"severity": "odd"}), record(5, [[{"introduced": "0"}]]),
        record(6, [low], ecosystem="npm"), record(7, [low], "GIT"), record(8, []), {"summary": "s", "affected": record(9, [low])["affected"]},
        record(10, [low], summary=" ", details="first line\nsecond", database_specific={"severity": "CRITICAL"}), record(11, [low], summary=None)]
    lines = spark.createDataFrame([(json.dumps(r),) for r in records], "value string")
    read = lines.select(F.from_json("value", dependencies.OSV_SCHEMA).alias("r")).select("r.*")
    got = {r.advisory: (r.vulnerable, r.severity, r.summary) for r in dependencies.osv_advisories(read).collect()}
    assert got == {
        "R-0": ("<7.1", "medium", "s"), "R-1": (">=8.0,<=8.6", "medium", "s"), "R-2": (">=9.2", "medium", "s"), "R-3": ("<7.1 || >=8.0,<=8.6", "medium", "s"),
        "R-4": ("<7.1 || >=8.0,<8.3", "medium", "s"), "R-5": ("", "medium", "s"), "R-10": ("<7.1", "critical", "first line"), "R-11": ("<7.1", "medium", "R-11")}


def test_specifiers(spark):
    cases = [
        ("4.4", "~=4.3", True), ("5.0", "~=4.3", False), ("4.3.9", "~=4.3.1", True), ("0.6.9", "^0.6", True), ("0.7", "^0.6", False), ("2.2.7", "==2.2.*", True), ("3.0", "==3", True), ("9", "", True),
        ("5", "<2 || >=4", True), ("3", "<2 || >=4", False), ("1", "??", True), ("1", "|| >=3", False), ("9", "<2 ||", False), ("1", " || ", True), ("1.5", "==foo", True), ("1", ">=a", True),
        ("1", "==1.0.*", False), ("1.2.7", "!=1.2.*", True), ("1.2", "!=1.2.*", False), ("1", "<" + "0" * 2000 + "2", True), ("99999999999999999999", ">5", True)]
    df = spark.createDataFrame(cases, "v string, spec string, want boolean")
    assert df.where(versions.satisfies(versions.parse(F.col("v")), F.col("spec")) != F.col("want")).collect() == []


def test_requirements_that_may_be_vulnerable(spark):
    cases = [("==4.1", "<4.2", True), ("==4.2", "<4.2", False), (">=4.2", "<4.2", False), (">=4.1", "<4.2", True), ("", "<4.2", True), ("", ">=4.2", True), ("<4.2", ">=4.2", False), ("==4.*", ">=4,<5", True), ("~=3.1", ">=4", False), (">=2 || <1", "<1", True)]
    df = spark.createDataFrame(cases, "spec string, vulnerable string, want boolean")
    assert df.where(versions.may_match(F.col("spec"), F.col("vulnerable")) != F.col("want")).collect() == []


FINDINGS = [("src/a.py", 3, 1, "high", "r2", "see [x]", False, None), ("src/a.py", 1, 0, "low", "r1", "m", True, True), ("pkg.lock", None, None, "medium", "r1", "n", False, False)]
SCHEMA = "path string, line long, column long, severity string, rule string, message string, suppressed boolean, known boolean"


def test_sarif(spark):
    found = spark.createDataFrame(FINDINGS, SCHEMA)
    rows = reports.sarif_results(found, ["path", "line", "column"])
    results = json.loads(reports.whole_document(rows, ["path", "line", "column"], "[", "]").first().value)
    assert [(r["ruleId"], r["ruleIndex"], r["level"]) for r in results] == [("r1", 0, "warning"), ("r1", 0, "note"), ("r2", 1, "error")]
    assert results[2]["message"]["text"] == "see \\[x\\]" and "region" not in results[0]["locations"][0]["physicalLocation"]
    assert results[1]["suppressions"] == [{"kind": "inSource"}] and [r.get("baselineState") for r in results] == ["new", "unchanged", None]


def test_text_and_json(spark):
    found = spark.createDataFrame(FINDINGS, SCHEMA)
    assert sorted(r.value for r in reports.text_lines(found).collect()) == ["pkg.lock: medium r1 n", "src/a.py:1:0: low r1 m", "src/a.py:3:1: high r2 see [x]"]
    assert all(set(json.loads(r.value)) == set(found.columns) for r in reports.json_records(found).collect())


def test_vex_statuses(spark):
    rows = [
        ("reached", True, None, None, None), ("clear", False, True, True, []), ("nameless", False, False, True, []), ("partial", False, True, False, []),
        ("required", False, True, True, ["other"]), ("lockless", False, True, True, None), ("unknown", None, None, None, None), ("unsearched", None, True, True, [])]
    evidence = spark.createDataFrame([(a, "p", *r) for a, *r in rows], "advisory string, package string, reached boolean, named boolean, complete boolean, dependents array<string>")
    got = {r.advisory: (r.status, r.justification) for r in reports.vex_status(evidence).collect()}
    assert got == {a: ("under_investigation", None) for a, *_ in rows} | {"reached": ("affected", None), "clear": ("not_affected", "vulnerable_code_not_in_execute_path")}
    assert len(reports.vex_statements(reports.vex_status(evidence)).collect()) == 8


def test_documents_in_parts_and_too_large_ones(spark, monkeypatch):
    records = spark.createDataFrame([(k, f"[{k}]") for k in range(7, 0, -1)], "k long, value string")
    whole = reports.whole_document(records, ["k"], "{", "}").first().value
    parts = reports.document_parts(records, ["k"], "{", "}").orderBy("position").collect()
    assert "".join(r.value for r in parts) == whole == "{" + ",".join(f"[{k}]" for k in range(1, 8)) + "}"
    monkeypatch.setattr(reports, "DOCUMENT_RECORDS", 3)
    with pytest.raises(ValueError):
        reports.whole_document(records, ["k"], "{", "}")


def test_components(spark):
    packages = spark.createDataFrame([("flask", "1.2", False), ("idna", None, True)], "package string, version string, optional boolean")
    got = {r.package: json.loads(r.value) for r in reports.sbom_components(packages).collect()}
    assert got["flask"]["purl"] == "pkg:pypi/flask@1.2" and got["idna"]["purl"] == "pkg:pypi/idna" and got["idna"]["scope"] == "optional"


def test_relative_paths(spark):
    rows = spark.createDataFrame([("/r/a.py",), ("/rx/a.py",), ("/r/" + "d" * 1_200_000,)], "path string")
    assert [r[0] for r in rows.select(reports.relative(F.col("path"), "/r")).collect()] == ["a.py", "/rx/a.py", "d" * 1_200_000]


def test_whole_documents(spark):
    found = spark.createDataFrame([(*r, [("b.py", 4, "see [b]")] if r[1] == 3 else []) for r in FINDINGS], SCHEMA + ", related array<struct<path: string, line: long, message: string>>")
    log = json.loads(reports.sarif_document(found, ["path", "line", "column"]).first().value)
    run = log["runs"][0]
    assert log["version"] == "2.1.0" and [r["id"] for r in run["tool"]["driver"]["rules"]] == ["r1", "r2"] and len(run["results"]) == 3
    assert [r["relatedLocations"][0]["message"]["text"] for r in run["results"] if "relatedLocations" in r] == ["see \\[b\\]"]
    read = json.loads(reports.json_document(found, ["path", "line", "rule"], {"files": 2}).first().value)
    assert read["schema"] == 1 and len(read["findings"]) == 3 and read["coverage"] == {"files": 2}
    packages = spark.createDataFrame([("flask", "1.2", False), ("idna", None, True)], "package string, version string, optional boolean")
    affected = spark.createDataFrame([("A-1", "flask", "high"), ("A-1", "idna", "high")], "advisory string, package string, severity string")
    bom = json.loads(reports.sbom_document(packages, affected).first().value)
    assert [c["name"] for c in bom["components"]] == ["flask", "idna"] and [len(v["affects"]) for v in bom["vulnerabilities"]] == [2]
    assert json.loads(reports.sbom_document(packages).first().value)["vulnerabilities"] == []
    statuses = spark.createDataFrame([("A-1", "flask", "affected", None)], "advisory string, package string, status string, justification string")
    one, two = (json.loads(reports.vex_document(statuses, "me", t).first().value) for t in ("2026-01-01T00:00:00Z", "2027-01-01T00:00:00Z"))
    assert one["@id"] == two["@id"] and one["statements"][0]["status"] == "affected" and one["timestamp"] != two["timestamp"]
