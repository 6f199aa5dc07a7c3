"""Report formats: JSON, SARIF, CSV, bills of materials, CI annotations.

Every format is a table of document parts, one row each. Documents that wrap all rows
of a scan are ordered parts too, a header and a trailer among them: building one value
would take one task for all rows."""

from __future__ import annotations

import json
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.identity import purl
from ..functions.paths import relative_uri
from ..functions.severity import sarif_level, sarif_number
from ..operators.ordering import rank_within

SUPPRESSED_AUDIT = ("IGNORED", "TRIAGE")


def findings_json(f: DataFrame) -> DataFrame:
    return f.select(F.to_json(F.struct(*f.columns)).alias("value"))


def write_findings_json(f: DataFrame, path: str) -> None:
    findings_json(f).write.mode("overwrite").text(path)


def _reportable(f: DataFrame) -> DataFrame:
    return f.filter(
        (F.col("status") == "ABSENT")
        & ~F.coalesce("audit_status", F.lit("")).isin(*SUPPRESSED_AUDIT)
        & (F.coalesce("file", F.lit("")) != "")
    )


def sarif_results(f: DataFrame, by: Sequence[str] = ("project",), root: str | None = None) -> DataFrame:
    """SARIF 2.1.0 result fields: absent checks, not suppressed, with a place; absolute paths
    are cited relative to ``root``."""
    text = F.concat(
        F.lit("["), F.col("severity"), F.lit("] "), F.col("name"), F.lit(": "), F.col("suggestion")
    )
    return _reportable(f).select(
        *by, "rule_id", sarif_level(F.col("severity")).alias("level"), text.alias("message"),
        relative_uri(F.col("file"), root).alias("uri"), F.greatest(F.col("line"), F.lit(1)).alias("start_line"),
    )


def sarif_rules(f: DataFrame, by: Sequence[str] = ("project",)) -> DataFrame:
    """One descriptor per rule of a scan."""
    per = _reportable(f).groupBy(*by, "rule_id").agg(
        F.min(F.struct("name", "severity", "evidence", "suggestion")).alias("m")
    )
    help_text = F.concat(F.col("m.evidence"), F.lit("\n\nSuggestion: "), F.col("m.suggestion"))
    return per.select(
        *by, "rule_id", F.col("m.name").alias("name"), sarif_number(F.col("m.severity")).alias("security_severity"),
        help_text.alias("help"),
    )


def to_sarif(f: DataFrame, by: Sequence[str] = ("project",), root: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(results, rules) as JSON objects of a SARIF run, one per row."""
    place = F.struct(
        F.struct(
            F.struct(F.col("uri")).alias("artifactLocation"),
            F.struct(F.col("start_line").alias("startLine")).alias("region"),
        ).alias("physicalLocation")
    )
    result = F.struct(
        F.col("rule_id").alias("ruleId"), F.struct(F.col("message").alias("text")).alias("message"),
        F.col("level"), F.array(place).alias("locations"),
    )
    rule = F.struct(
        F.col("rule_id").alias("id"), F.col("name"), F.struct(F.col("name").alias("text")).alias("shortDescription"),
        F.struct(F.col("help").alias("text")).alias("help"),
        F.struct(F.col("security_severity").alias("security-severity")).alias("properties"),
    )
    results = sarif_results(f, by, root).select(*by, F.to_json(result).alias("value"))
    return results, sarif_rules(f, by).select(*by, F.to_json(rule).alias("value"))


def _listed(parts: DataFrame, by: Sequence[str], section: int, order: Sequence[str]) -> DataFrame:
    """JSON parts as elements of one array: a comma before all but the first."""
    ranked = rank_within(parts, list(by), [F.col(c) for c in order], "place")
    value = F.when(F.col("place") > 1, F.concat(F.lit(","), F.col("value"))).otherwise(F.col("value"))
    return ranked.select(*by, F.lit(section).alias("section"), "place", value.alias("value"))


def _fixed(groups: DataFrame, by: Sequence[str], section: int, text: str) -> DataFrame:
    return groups.select(*by, F.lit(section).alias("section"), F.lit(1).cast("long").alias("place"), F.lit(text).alias("value"))


# The frame of a SARIF log and of a bill of materials.
SARIF_SCHEMA = "https://json.schemastore.org/sarif-2.1.0.json"


def sarif_document(f: DataFrame, tool: str, version: str, by: Sequence[str] = ("project",), root: str | None = None) -> DataFrame:
    """One SARIF log per project as ordered parts (by.., section, place, value): the values
    put together in this order are the document, and no task ever holds one."""
    results, rules = to_sarif(f, by, root)
    groups = f.select(*by).distinct()
    driver = json.dumps({"name": tool, "version": version})[:-1]
    head = f'{{"version":"2.1.0","$schema":"{SARIF_SCHEMA}","runs":[{{"tool":{{"driver":{driver},"rules":['
    parts = [
        _fixed(groups, by, 0, head), _listed(rules, by, 1, ["value"]), _fixed(groups, by, 2, ']}},"results":['),
        _listed(results, by, 3, ["value"]), _fixed(groups, by, 4, "]}]}"),
    ]
    return reduce(DataFrame.unionByName, parts)


def sbom_document(deps: DataFrame, edges: DataFrame, serial: str) -> DataFrame:
    """One CycloneDX document per project of ``deps`` as ordered parts, as above; ``serial``
    goes before the project's name."""
    rows = to_sbom(deps, edges)
    # Every project has a component; the written slices tell them without working out ``deps`` again.
    components = _listed(rows.filter("section = 'components'").select("project", "value"), ["project"], 1, ["value"])
    groups = components.select("project").distinct()
    name = F.to_json(F.struct(F.concat(F.lit(serial), F.col("project")).alias("serialNumber")))
    head = groups.select(
        "project", F.lit(0).alias("section"), F.lit(1).cast("long").alias("place"),
        F.concat(F.lit('{"bomFormat":"CycloneDX","specVersion":"1.5","version":1,'), F.substr(name, F.lit(2), F.length(name) - 2),
                 F.lit(',"components":[')).alias("value"),
    )
    needs = rows.filter("section = 'dependencies'").join(groups, "project", "left_semi")
    parts = [
        head, components.filter(F.col("project").isNotNull()),
        _fixed(groups, ["project"], 2, '],"dependencies":['),
        _listed(needs.select("project", "value"), ["project"], 3, ["value"]),
        _fixed(groups, ["project"], 4, "]}"),
    ]
    return reduce(DataFrame.unionByName, parts)


def severity_csv(f: DataFrame) -> DataFrame:
    return f.groupBy(F.col("severity").alias("Severity")).agg(F.count(F.lit(1)).alias("Count"))


def engagement_csv(f: DataFrame) -> DataFrame:
    """Rows of the engagement report, blanks for a missing file or line."""
    return f.select(
        F.col("engagement_id"), F.col("title").alias("Title"), F.col("severity").alias("Severity"),
        F.coalesce("file_path", F.lit("")).alias("File"),
        F.coalesce(F.col("line_number").cast("string"), F.lit("")).alias("Line"), F.col("status").alias("Status"),
    )


def write_report_csv(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    writer = df.write.mode("overwrite").option("header", "true")
    (writer.partitionBy(partition_by) if partition_by else writer).csv(path)


def sbom_components(deps: DataFrame, fmt: str = "cyclonedx") -> DataFrame:
    """Component rows: CycloneDX 1.5, SPDX 2.3 or a plain list.

    deps: project, name, version, type, ecosystem."""
    url = purl(F.col("ecosystem"), F.col("name"), F.col("version"))
    if fmt == "cyclonedx":
        scope = F.when(F.col("type") == "dev", F.lit("optional"))
        return deps.select(
            "project", F.lit("library").alias("type"), "name", "version", url.alias("purl"), scope.alias("scope")
        )
    if fmt == "spdx":
        # A package id must be stable and unique per project: a hash of its url does both.
        ident = F.left(F.sha2(F.concat_ws("|", "ecosystem", "name", "version"), 256), F.lit(16))
        return deps.select(
            "project", F.concat(F.lit("SPDXRef-Package-"), ident).alias("spdx_id"), "name",
            F.col("version").alias("version_info"), F.lit("NOASSERTION").alias("download_location"),
            url.alias("purl"), F.lit("SPDXRef-DOCUMENT").alias("element"), F.lit("DESCRIBES").alias("relationship"),
        )
    return deps.select("project", "name", "version", "type", "ecosystem", url.alias("purl"))


def to_sbom(deps: DataFrame, edges: DataFrame | None = None, fmt: str = "cyclonedx") -> DataFrame:
    """Rows of (project, section, value) with JSON parts of the bill of materials.

    A ``ref`` has one ``dependsOn`` entry whatever its size: its list is what the
    document format puts in one value, and it is as long as one package's own
    manifest, not as the corpus."""
    parts = sbom_components(deps, fmt)
    cols = [c for c in parts.columns if c != "project"]
    out = parts.select(
        "project", F.lit("components").alias("section"), F.to_json(F.struct(*cols)).alias("value")
    )
    if edges is not None and fmt == "cyclonedx":
        lists = edges.groupBy("project", "parent").agg(F.array_sort(F.collect_set("child")).alias("c"))
        doc = F.struct(F.col("parent").alias("ref"), F.col("c").alias("dependsOn"))
        out = out.unionByName(
            lists.select("project", F.lit("dependencies").alias("section"), F.to_json(doc).alias("value"))
        )
    return out


def ci_annotations(f: DataFrame, root: str | None = None) -> DataFrame:
    """One workflow command per finding that is not suppressed."""
    live = f.filter(~F.coalesce("audit_status", F.lit("")).isin(*SUPPRESSED_AUDIT))
    level = F.when(F.col("severity").isin("CRITICAL", "HIGH"), F.lit("error")).otherwise(F.lit("warning"))
    body = F.concat(
        F.lit("["), F.col("rule_id"), F.lit("] "), F.col("name"), F.lit(" - "), F.col("suggestion")
    )
    file = F.coalesce("file", F.lit(""))
    line = F.greatest(F.coalesce("line", F.lit(0)), F.lit(1)).cast("string")
    place = F.concat(F.lit(" file="), relative_uri(file, root), F.lit(",line="), line)
    text = F.concat(F.lit("::"), level, F.when(file == "", F.lit("")).otherwise(place), F.lit("::"), body)
    return live.select(text.alias("value"))


