"""Sinks: findings and package tables as text lines, JSON records, SARIF, CycloneDX and OpenVEX.

Every renderer builds its records with column expressions, one string per record, so that ``df.write.text`` stays
distributed. ``whole_document`` joins records into the one document a format asks for, and is meant for reports
that a person or a tool reads in one piece.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowfacts.functions import versions
from flowfacts.operators.tables import if_small, written

#: SARIF levels of severities; fixed values of the format.
LEVELS = {"critical": "error", "high": "error", "medium": "warning", "low": "note", "info": "note"}
NULLS = {"ignoreNullFields": "false"}


def _level(severity: Column) -> Column:
    out = F.lit("none")
    for name, level in LEVELS.items():
        out = F.when(severity == name, level).otherwise(out)
    return out


def relative(path: Column, root: str) -> Column:
    """The path below root; other paths as they are."""
    head = root.rstrip("/") + "/"
    return F.when(F.startswith(path, F.lit(head)), F.substring(path, F.lit(len(head) + 1), F.length(path))).otherwise(path)


def text_lines(findings: DataFrame) -> DataFrame:
    """``path:line:column: severity rule message`` per finding (path, line, column, severity, rule, message)."""
    place = F.concat_ws(":", "path", F.col("line").cast("string"), F.when(F.col("line").isNotNull(), F.col("column").cast("string")))
    return findings.select(F.concat(place, F.lit(": "), F.concat_ws(" ", "severity", "rule", "message")).alias("value"))


def json_records(findings: DataFrame) -> DataFrame:
    """One JSON object per finding, nulls kept."""
    return findings.select(F.to_json(F.struct(*findings.columns), NULLS).alias("value"))


def escaped(message: Column) -> Column:
    """SARIF message text: backslashes and square brackets escaped, as brackets embed links."""
    return F.regexp_replace(message, r"([\\\[\]])", r"\\$1")


def sarif_rules(findings: DataFrame, order: list[str]) -> DataFrame:
    """(rule, rule_index): rules numbered from 0 by first appearance. The aggregation leaves one row per rule, and only
    those rows are numbered."""
    first = findings.groupBy("rule").agg(F.min(F.struct(*order)).alias("first"))
    ranked = first.groupBy().agg(F.array_sort(F.collect_list(F.struct("first", "rule"))).alias("rules"))
    return ranked.select(F.posexplode("rules").alias("rule_index", "r")).select(F.col("r.rule").alias("rule"), F.col("rule_index").cast("long"))


def sarif_results(findings: DataFrame, order: list[str]) -> DataFrame:
    """One SARIF 2.1.0 result per finding (path, line, column, severity, rule, message, suppressed, known)."""
    rules = written(sarif_rules(findings, order), "rules")
    region = F.when(F.col("line").isNotNull(), F.struct(F.col("line").alias("startLine"), F.col("column").alias("startColumn")))
    place = F.struct(F.struct(F.struct(F.col("path").alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))
    related = []
    if "related" in findings.columns:  # array<struct<path, line, message>>
        related = [F.when(F.size("related") > 0, F.transform("related", lambda r: F.struct(
            F.struct(F.struct(r["path"].alias("uri")).alias("artifactLocation"), F.struct(r["line"].alias("startLine")).alias("region")).alias("physicalLocation"),
            F.struct(escaped(r["message"]).alias("text")).alias("message")))).alias("relatedLocations")]
    result = F.struct(
        F.col("rule").alias("ruleId"), F.col("rule_index").alias("ruleIndex"), _level(F.col("severity")).alias("level"),
        F.struct(escaped(F.col("message")).alias("text")).alias("message"), F.array(place).alias("locations"),
        F.when(F.col("suppressed"), F.array(F.struct(F.lit("inSource").alias("kind")))).alias("suppressions"),
        F.when(F.col("known"), "unchanged").when(~F.col("known"), "new").alias("baselineState"), *related)
    return findings.join(if_small(rules, rules.count()), "rule").select(*order, F.to_json(result).alias("value"))


#: Rules that one SARIF run lists, at most.
RULES = 10_000


def sarif_document(findings: DataFrame, order: list[str], tool: str = "flowfacts", version: str = "0") -> DataFrame:
    """One row: a whole SARIF log with one run. The rules, at most RULES, are listed by first appearance."""
    rules = sarif_rules(findings, order).orderBy("rule_index").limit(RULES + 1).collect()
    if len(rules) > RULES:
        raise ValueError(f"more than {RULES} rules")
    driver = {"name": tool, "version": version, "rules": [{"id": r["rule"]} for r in rules]}
    head = '{"$schema":"https://json.schemastore.org/sarif-2.1.0.json","version":"2.1.0","runs":[{"tool":{"driver":' + json.dumps(driver) + '},"results":['
    return whole_document(sarif_results(findings, order), order, head, "]}]}")


def json_document(findings: DataFrame, order: list[str], coverage: dict | None = None) -> DataFrame:
    """One row: a versioned JSON document of findings, and the coverage if given."""
    rows = findings.select(*order, F.to_json(F.struct(*findings.columns), NULLS).alias("value"))
    return whole_document(rows, order, '{"schema":1,"findings":[', '],"coverage":' + json.dumps(coverage) + "}")


def sbom_document(packages: DataFrame, affected: DataFrame | None = None) -> DataFrame:
    """One row: a CycloneDX 1.5 document of merged packages and, from affected (advisory, package, severity), their vulnerabilities."""
    parts = sbom_components(packages).select(F.lit(0).alias("part"), F.col("package").alias("key"), "value")
    if affected is not None:
        found = affected.groupBy("advisory").agg(F.max("severity").alias("severity"), F.array_sort(F.collect_set("package")).alias("packages"))
        shown = F.struct(F.col("advisory").alias("id"), F.array(F.struct(F.col("severity").alias("severity"))).alias("ratings"), F.transform("packages", lambda p: F.struct(F.concat(F.lit("pkg:pypi/"), p).alias("ref"))).alias("affects"))
        parts = parts.unionByName(found.select(F.lit(1).alias("part"), F.col("advisory").alias("key"), F.to_json(shown).alias("value")))
    if parts.limit(DOCUMENT_RECORDS + 1).count() > DOCUMENT_RECORDS:
        raise ValueError(f"more than {DOCUMENT_RECORDS} records")
    lists = parts.groupBy().agg(*[F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("part") == k, F.struct("key", "value")))), lambda r: r["value"]), ",").alias(f"p{k}") for k in (0, 1)])
    return lists.select(F.concat(F.lit('{"bomFormat":"CycloneDX","specVersion":"1.5","version":1,"components":['), "p0", F.lit('],"vulnerabilities":['), "p1", F.lit("]}")).alias("value"))


def vex_document(statuses: DataFrame, author: str, timestamp: str) -> DataFrame:
    """One row: an OpenVEX document; its @id is made of its sorted statements, so equal statements have equal ids."""
    rows = whole_document(vex_statements(statuses), ["advisory", "package"], "", "")
    head = F.concat(F.lit('{"@context":"https://openvex.dev/ns/v0.2.0","@id":"urn:sha256:'), F.sha2("value", 256), F.lit(f'","author":{json.dumps(author)},"timestamp":{json.dumps(timestamp)},"version":1,"statements":['))
    return rows.select(F.concat(head, "value", F.lit("]}")).alias("value"))


def sbom_components(packages: DataFrame) -> DataFrame:
    """One CycloneDX component per merged package (package, version, optional)."""
    known = versions.parse(F.col("version"))
    purl = versions.purl(F.col("package"), F.when(F.col("version").isNotNull(), known))
    return packages.select("package", F.to_json(F.struct(
        F.lit("library").alias("type"), F.col("package").alias("name"), F.col("version"), purl.alias("purl"),
        F.when(F.col("optional"), "optional").otherwise("required").alias("scope"))).alias("value"))


def vex_status(evidence: DataFrame) -> DataFrame:
    """(advisory, package, status, justification) from evidence rows (advisory, package, reached, named, complete, dependents),
    one aggregation per advisory and package of those that may be vulnerable, then the first case that holds.

    Affected: some code reaches the vulnerable code. Not affected: all facts are known, the advisory names its entry points,
    every file was analysed whole, and a lock shows that no other package requires it. Under investigation: anything else. A
    null fact is not known.
    """
    def every(fact: Column) -> Column:
        return F.bool_and(F.coalesce(fact, F.lit(False)))

    seen = evidence.groupBy("advisory", "package").agg(
        F.coalesce(F.bool_or("reached"), F.lit(False)).alias("open"), every(F.col("reached").isNotNull()).alias("looked"),
        every(F.col("named")).alias("named"), every(F.col("complete")).alias("whole"), every(F.size("dependents") == 0).alias("alone"))
    clear = F.col("looked") & F.col("named") & F.col("whole") & F.col("alone")
    status = F.when(F.col("open"), "affected").when(clear, "not_affected").otherwise("under_investigation")
    return seen.select("advisory", "package", status.alias("status"), F.when(~F.col("open") & clear, "vulnerable_code_not_in_execute_path").alias("justification"))


def vex_statements(statuses: DataFrame) -> DataFrame:
    """One OpenVEX statement per status row."""
    return statuses.select("advisory", "package", F.to_json(F.struct(
        F.struct(F.col("advisory").alias("name")).alias("vulnerability"),
        F.array(F.struct(F.concat(F.lit("pkg:pypi/"), "package").alias("@id"))).alias("products"), "status", "justification")).alias("value"))


#: Records that ``whole_document`` puts into one row, at most.
DOCUMENT_RECORDS = 100_000


def whole_document(records: DataFrame, order: list[str], head: str, tail: str) -> DataFrame:
    """One row: head, the records (column value) in order with commas between, tail. Raises ValueError for more than
    DOCUMENT_RECORDS records, whose document ``document_parts`` writes."""
    if records.limit(DOCUMENT_RECORDS + 1).count() > DOCUMENT_RECORDS:
        raise ValueError(f"more than {DOCUMENT_RECORDS} records; write document_parts instead")
    rows = records.groupBy().agg(F.array_sort(F.collect_list(F.struct(*order, "value"))).alias("rows"))
    return rows.select(F.concat(F.lit(head), F.array_join(F.transform("rows", lambda r: r["value"]), ","), F.lit(tail)).alias("value"))


def document_parts(records: DataFrame, order: list[str], head: str, tail: str) -> DataFrame:
    """Lines (position, value) that, in order of position, are the document: head (0), a record a line with commas between,
    tail. Dealt by ranges, so ``df.write.text`` of the values writes parts whose files follow one another."""
    from flowfacts.operators.findings import in_order

    spark = records.sparkSession
    placed = in_order(records.select(*order, "value"), order)
    body = placed.select(F.col("position").cast("long").alias("position"), F.concat(F.when(F.col("position") > 1, ",").otherwise(""), "value").alias("value"))
    ends = spark.createDataFrame([(0, head), (2**62, tail)], "position long, value string")
    return body.unionByName(ends).repartitionByRange("position").sortWithinPartitions("position")
