"""Report formats, stores, and the streaming forms."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import compare as X
from ..session import shared_dir
from ..sources import reports as O
from ..sources import stores as S
from ..streaming import changes, feeds, lifecycle
from . import duck as D
from .corpus_q import SUPPRESS_RULES, SUPPRESS_SQL
from .registry import Tables, query
from .views import spark_sql_text

c = F.col
REPORTABLE = "status = 'ABSENT' AND audit_status NOT IN ('IGNORED', 'TRIAGE') AND file <> ''"


def _folder(t: Tables, name: str) -> str:
    return f"{shared_dir(t.spark)}/{name}-{uuid.uuid4().hex}"


# ---- documents ------------------------------------------------------------


@query(
    "write_findings_json",
    "SELECT to_json({'scan_id': scan_id, 'rule_id': rule_id, 'name': name, 'severity': severity, 'file': file, 'line': line})::VARCHAR AS value FROM results",
)
def _(t):
    path = _folder(t, "findings-json")
    O.write_findings_json(t.results.select("scan_id", "rule_id", "name", "severity", "file", "line"), path)
    return t.spark.read.text(path)


@query(
    "sarif_results",
    f"""SELECT project, rule_id, {D.case('severity', {'CRITICAL': 'error', 'HIGH': 'error', 'LOW': 'note'}, 'warning')} AS level,
    '[' || severity || '] ' || name || ': ' || suggestion AS message, regexp_replace(file, '^/+', '') AS uri, greatest(line, 1) AS start_line FROM audited WHERE {REPORTABLE}""",
)
def _(t):
    return O.sarif_results(t.audited)


@query(
    "sarif_rules",
    f"""SELECT project, rule_id, name, {D.case('severity', {'CRITICAL': '9.0', 'HIGH': '7.0', 'MEDIUM': '5.0', 'LOW': '2.0'}, '5.0')} AS security_severity,
    evidence || chr(10) || chr(10) || 'Suggestion: ' || suggestion AS help FROM audited WHERE {REPORTABLE}
    QUALIFY row_number() OVER (PARTITION BY project, rule_id ORDER BY name, severity, evidence, suggestion) = 1""",
)
def _(t):
    return O.sarif_rules(t.audited)


@query(
    "to_sarif",
    f"""SELECT project, to_json({{'ruleId': rule_id, 'message': {{'text': '[' || severity || '] ' || name || ': ' || suggestion}},
    'level': {D.case('severity', {'CRITICAL': 'error', 'HIGH': 'error', 'LOW': 'note'}, 'warning')},
    'locations': [{{'physicalLocation': {{'artifactLocation': {{'uri': regexp_replace(file, '^/+', '')}}, 'region': {{'startLine': greatest(line, 1)}}}}}}]}})::VARCHAR AS value FROM audited WHERE {REPORTABLE}""",
)
def _(t):
    results, _rules = O.to_sarif(t.audited)
    return results


@query(
    "sarif_relative_uris",
    f"""SELECT project, rule_id, line, CASE length(p) % 4 WHEN 0 THEN p WHEN 1 THEN '../other/' || p WHEN 2 THEN '../../opt/' || p ELSE p END AS uri, count(*) AS n
    FROM (SELECT *, regexp_replace(file, '^/+', '') AS p FROM audited WHERE {REPORTABLE}) WHERE p <> '' AND NOT contains(p, '//') AND NOT contains(p, './') GROUP BY ALL""",
)
def _(t):
    """Absolute paths inside the project, beside it and elsewhere, and relative ones."""
    file = F.regexp_replace("file", "^/+", "")
    n, plain = F.length(file) % 4, (file != "") & ~F.contains(file, F.lit("//")) & ~F.contains(file, F.lit("./"))
    where = F.when(n == 0, F.concat(F.lit("/srv/app/"), file)).when(n == 1, F.concat(F.lit("/srv/other/./"), file)).when(
        n == 2, F.concat(F.lit("/opt/"), F.replace(file, F.lit("/"), F.lit("\\")))
    ).otherwise(file)
    found = t.audited.filter(plain).withColumns({"file": where, "own_line": c("line")})
    uris = O.sarif_results(found, ("project", "own_line"), "/srv/app/").select("project", "rule_id", c("own_line").alias("line"), "uri")
    return uris.groupBy("project", "rule_id", "line", "uri").agg(F.count(F.lit(1)).alias("n"))


_RESULT_JSON = f"""SELECT project, to_json({{'ruleId': rule_id, 'message': {{'text': '[' || severity || '] ' || name || ': ' || suggestion}},
    'level': {D.case('severity', {'CRITICAL': 'error', 'HIGH': 'error', 'LOW': 'note'}, 'warning')},
    'locations': [{{'physicalLocation': {{'artifactLocation': {{'uri': regexp_replace(file, '^/+', '')}}, 'region': {{'startLine': greatest(line, 1)}}}}}}]}})::VARCHAR AS value FROM audited WHERE {REPORTABLE}"""
_RULE_JSON = f"""SELECT project, to_json({{'id': rule_id, 'name': name, 'shortDescription': {{'text': name}}, 'help': {{'text': evidence || chr(10) || chr(10) || 'Suggestion: ' || suggestion}},
    'properties': {{'security-severity': {D.case('severity', {'CRITICAL': '9.0', 'HIGH': '7.0', 'MEDIUM': '5.0', 'LOW': '2.0'}, '5.0')}}}}})::VARCHAR AS value FROM audited WHERE {REPORTABLE}
    QUALIFY row_number() OVER (PARTITION BY project, rule_id ORDER BY name, severity, evidence, suggestion) = 1"""


def _listed_sql(section: int, rows: str) -> str:
    return (
        f"SELECT project, {section} AS section, place, CASE WHEN place > 1 THEN ',' ELSE '' END || value AS value "
        f"FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY value) AS place FROM ({rows}))"
    )


def _fixed_sql(section: int, text: str, table: str) -> str:
    return f"SELECT DISTINCT project, {section} AS section, CAST(1 AS BIGINT) AS place, {text} AS value FROM {table}"


@query(
    "sarif_document",
    " UNION ALL ".join(
        [
            _fixed_sql(0, """'{"version":"2.1.0","$schema":"https://json.schemastore.org/sarif-2.1.0.json","runs":[{"tool":{"driver":{"name": "ambersift", "version": "1","rules":['""", "audited"),
            _listed_sql(1, _RULE_JSON), _fixed_sql(2, """']}},"results":['""", "audited"), _listed_sql(3, _RESULT_JSON),
            _fixed_sql(4, "']}]}'", "audited"),
        ]
    ),
)
def _(t):
    return O.sarif_document(t.audited, "ambersift", "1")


@query("write_report_csv", "SELECT severity AS \"Severity\", count(*) AS \"Count\" FROM findings GROUP BY ALL")
def _(t):
    path = _folder(t, "severity-csv")
    O.write_report_csv(O.severity_csv(t.findings), path)
    return t.spark.read.schema("Severity string, Count long").option("header", "true").csv(path)


@query(
    "engagement_csv",
    "SELECT engagement_id, title AS \"Title\", severity AS \"Severity\", coalesce(file_path, '') AS \"File\", CAST(line_number AS VARCHAR) AS \"Line\", status AS \"Status\" FROM findings",
)
def _(t):
    return O.engagement_csv(t.findings)


PURL = (
    "coalesce('pkg:' || CASE ecosystem WHEN 'go' THEN 'golang' WHEN 'npm' THEN 'npm' WHEN 'pypi' THEN 'pypi' WHEN 'rubygems' THEN 'gem' "
    "WHEN 'cargo' THEN 'cargo' END || '/' || name || '@' || version, '')"
)


@query(
    "to_sbom",
    f"""SELECT project, 'components' AS section, CASE WHEN type = 'dev' THEN to_json({{'type': 'library', 'name': name, 'version': version, 'purl': {PURL}, 'scope': 'optional'}})::VARCHAR
      ELSE to_json({{'type': 'library', 'name': name, 'version': version, 'purl': {PURL}}})::VARCHAR END AS value FROM deps
    UNION ALL SELECT project, 'dependencies', to_json({{'ref': parent, 'dependsOn': list(child ORDER BY child)}})::VARCHAR FROM dep_edges GROUP BY project, parent""",
)
def _(t):
    return O.to_sbom(t.deps, t.dep_edges)


_COMPONENT_JSON = f"""SELECT project, CASE WHEN type = 'dev' THEN to_json({{'type': 'library', 'name': name, 'version': version, 'purl': {PURL}, 'scope': 'optional'}})::VARCHAR
      ELSE to_json({{'type': 'library', 'name': name, 'version': version, 'purl': {PURL}}})::VARCHAR END AS value FROM deps"""


@query(
    "sbom_document",
    " UNION ALL ".join(
        [
            _fixed_sql(0, """'{"bomFormat":"CycloneDX","specVersion":"1.5","version":1,"serialNumber":"urn:scan:' || project || '","components":['""", "deps"),
            _listed_sql(1, _COMPONENT_JSON), _fixed_sql(2, """'],"dependencies":['""", "deps"),
            _listed_sql(3, "SELECT project, to_json({'ref': parent, 'dependsOn': list(child ORDER BY child)})::VARCHAR AS value FROM dep_edges WHERE project IN (SELECT project FROM deps) GROUP BY project, parent"),
            _fixed_sql(4, "']}'", "deps"),
        ]
    ),
)
def _(t):
    return O.sbom_document(t.deps, t.dep_edges, "urn:scan:")


@query(
    "to_sbom_spdx",
    f"""SELECT project, 'SPDXRef-Package-' || left(sha256(ecosystem || '|' || name || '|' || version), 16) AS spdx_id, name, version AS version_info, 'NOASSERTION' AS download_location,
    {PURL} AS purl, 'SPDXRef-DOCUMENT' AS element, 'DESCRIBES' AS relationship FROM deps""",
)
def _(t):
    return O.sbom_components(t.deps, "spdx")


@query(
    "ci_annotations",
    """SELECT '::' || CASE WHEN severity IN ('CRITICAL', 'HIGH') THEN 'error' ELSE 'warning' END || CASE WHEN file = '' THEN '' ELSE ' file=' || regexp_replace(file, '^/+', '') || ',line=' || CAST(greatest(line, 1) AS VARCHAR) END
    || '::[' || rule_id || '] ' || name || ' - ' || suggestion AS value FROM audited WHERE audit_status NOT IN ('IGNORED', 'TRIAGE')""",
)
def _(t):
    return O.ci_annotations(t.audited)


@query(
    "rule_coverage",
    """SELECT CASE WHEN instr(id, '-') > 1 THEN string_split(id, '-')[1] ELSE id END AS category, stack, severity, count(*) AS n
    FROM (SELECT DISTINCT rule_id AS id, coalesce(stack, 'universal') AS stack, severity FROM findings) GROUP BY ALL""",
)
def _(t):
    rules = t.findings.select(
        c("rule_id").alias("id"), F.coalesce("stack", F.lit("universal")).alias("stack"), "severity"
    ).distinct()
    return X.rule_coverage(rules)


# ---- stores ---------------------------------------------------------------


@query(
    "read_scan_history",
    """SELECT project AS project_path, rule_id, severity, file, line FROM results r WHERE scan_id = (SELECT max(scan_id) FROM results m WHERE m.project = r.project)""",
)
def _(t):
    result = F.struct(
        c("rule_id").alias("id"), c("name"), c("status"), c("severity"), c("file"), c("line"), c("evidence"),
        c("suggestion"),
    )
    at = F.date_format(F.timestamp_seconds("scan_id"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    doc = F.struct(
        at.alias("timestamp"), c("project").alias("project_path"), F.struct(F.array(result).alias("results")).alias("report")
    )
    path = _folder(t, "scan-history")
    t.results.select(F.to_json(doc).alias("value")).write.text(path)
    latest = S.latest_scan_results(S.read_scan_history(t.spark, path, multi_line=False))
    return latest.select("project_path", "rule_id", "severity", "file", "line")


@query(
    "write_baseline",
    """SELECT left(sha256(rule_id || '|' || file || '|' || evidence), 24) AS fingerprint, min(rule_id) AS rule_id, min(file) AS file FROM results GROUP BY 1""",
)
def _(t):
    path = _folder(t, "baseline")
    S.write_baseline(t.results, path)
    return S.read_baseline(t.spark, path).select("fingerprint", "rule_id", "file")


@query(
    "read_baseline",
    """SELECT severity, count(*) AS accepted FROM (SELECT left(sha256(rule_id || '|' || file || '|' || evidence), 24) AS fp, rule_id, file, line, severity FROM results
    QUALIFY row_number() OVER (PARTITION BY fp ORDER BY rule_id, file, line, severity) = 1) GROUP BY ALL""",
)
def _(t):
    path = _folder(t, "baseline")
    S.write_baseline(t.results, path)
    return S.read_baseline(t.spark, path).groupBy("severity").agg(F.count(F.lit(1)).alias("accepted"))


@query(
    "read_findings_store",
    """SELECT id, product_id, coalesce(nullif(status, ''), 'open') AS status, CASE WHEN kanban_column = 'done' THEN 'backlog' ELSE kanban_column END AS kanban_column,
    false AS is_duplicate, sla_deadline FROM findings""",
)
def _(t):
    path = _folder(t, "store")
    rows = t.findings.select(
        "id", "product_id", F.nullif(c("status"), F.lit("")).alias("status"),
        F.nullif(c("kanban_column"), F.lit("done")).alias("kanban_column"), "sla_deadline",
    )
    rows.write.parquet(f"{path}/findings")
    store = S.read_findings_store(t.spark, path, ["findings"])
    return store["findings"].select("id", "product_id", "status", "kanban_column", "is_duplicate", "sla_deadline")


# ---- streams --------------------------------------------------------------


def _stream(t: Tables, view: str) -> DataFrame:
    """A derived view over the events table read as a stream of files."""
    static = t.events
    stream = t.spark.readStream.schema(static.schema).parquet(f"{t.sf_dir}/event[s].parquet")
    for base in ("orders",):
        if base in spark_sql_text(view):
            getattr(t, base)
    stream.createOrReplaceTempView("events")
    out = t.spark.sql(spark_sql_text(view))
    static.createOrReplaceTempView("events")
    return out


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields)


def _run(t: Tables, stream: DataFrame, mode: str, key: Sequence[str] = ()) -> DataFrame:
    """Run a stream over what is there and return its final table; in update mode the last
    row of every ``key``."""
    out, marks = _folder(t, "stream-out"), _folder(t, "stream-marks")
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", marks).trigger(availableNow=True)
    if mode == "append":
        writer.format("parquet").option("path", out).start().awaitTermination()
        return t.spark.read.schema(stream.schema).parquet(out)

    if mode == "update":

        def add(batch: DataFrame, epoch: int) -> None:
            # An epoch that is run again writes its own folder again.
            batch.withColumn("_epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{out}/epoch-{epoch}")

        writer.foreachBatch(add).start().awaitTermination()
        rows = t.spark.read.schema(f"{_ddl(stream)}, _epoch long").option("recursiveFileLookup", "true").parquet(out)
        rest = [n for n in stream.columns if n not in key]
        last = rows.groupBy(*key).agg(*[F.max_by(n, "_epoch").alias(n) for n in rest])
        return last.select(*stream.columns)

    def save(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/latest")

    writer.foreachBatch(save).start().awaitTermination()
    return t.spark.read.schema(stream.schema).parquet(f"{out}/latest")


def _plain(name: str) -> Column:
    return c(name).cast("timestamp_ntz").alias(name)


_RELEVANT = r"""op IN ('write', 'create', 'rename') AND NOT regexp_matches(string_split(path, '/')[-1], '^\.|~$|\.swp$|\.tmp$')"""
SESSIONS = f"""rel AS (SELECT * FROM file_events WHERE {_RELEVANT}),
 marked AS (SELECT *, CASE WHEN lag(changed_at) OVER (PARTITION BY workspace ORDER BY changed_at, event_id) IS NULL OR epoch_us(changed_at) - epoch_us(lag(changed_at) OVER (PARTITION BY workspace ORDER BY changed_at, event_id)) >= {{gap}} THEN changed_at END AS fresh FROM rel),
 sess AS (SELECT *, max(fresh) OVER (PARTITION BY workspace ORDER BY changed_at, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS started_at FROM marked)"""
HOURS6 = 6 * 3600


@query(
    "debounced_changes",
    f"WITH {SESSIONS.replace('{gap}', str(HOURS6 * 1000000))} SELECT workspace, started_at, path, min(changed_at) AS first_change, count(*) AS events FROM sess GROUP BY ALL",
)
def _(t):
    return changes.debounced_changes_batch(t.file_events, HOURS6)


@query(
    "debounced_changes_stream",
    f"""WITH {SESSIONS.replace('{gap}', str(HOURS6 * 1000000))}, g AS (SELECT workspace, started_at, max(changed_at) AS last FROM sess GROUP BY ALL)
    SELECT s.workspace, s.started_at, s.path, min(s.changed_at) AS first_change, count(*) AS events FROM sess s JOIN g ON g.workspace = s.workspace AND g.started_at = s.started_at
    WHERE g.last + INTERVAL 6 HOUR <= (SELECT max(changed_at) FROM rel) - INTERVAL 10 SECOND GROUP BY ALL""",
)
def _(t):
    # Groups that the watermark has passed at the end of the input; the others are still open.
    out = _run(t, changes.debounced_changes(_stream(t, "file_events"), HOURS6, "10 seconds", None), "append")
    return out.select("workspace", _plain("started_at"), "path", _plain("first_change"), "events")


@query(
    "incremental_scan",
    f"""WITH changed AS (SELECT DISTINCT project, file AS path FROM enriched) SELECT s.project, s.path, s.rule_id, s.line FROM ({SUPPRESS_SQL}) s JOIN changed USING (project, path)""",
)
def _(t):
    out = _folder(t, "stream-hits")
    events = _stream(t, "enriched").select(
        c("project").alias("workspace"), c("file").alias("path"), F.lit("write").alias("op")
    )

    def save(hits: DataFrame, epoch: int) -> None:
        hits.select("project", "path", "rule_id", "line").write.mode("overwrite").parquet(f"{out}/epoch-{epoch}")

    changes.incremental_scan(
        events, t.code_files, SUPPRESS_RULES, save, _folder(t, "stream-marks")
    ).awaitTermination()
    hits = t.spark.read.schema("project string, path string, rule_id string, line int")
    return hits.option("recursiveFileLookup", "true").parquet(out).distinct()


def _feed(f: DataFrame) -> DataFrame:
    return f.select(
        "id", "rule_id", F.coalesce("stack", F.lit("core")).alias("type"), F.coalesce("file_path", F.lit("")).alias("file"),
        (c("line_number") % 5).alias("line"), c("title").alias("message"), "created_at", "severity",
    )


@query(
    "stream_dedup",
    f"""SELECT DISTINCT {D.fingerprint("rule_id", "coalesce(stack, 'core')", "coalesce(file_path, '')", "line_number % 5", "title")} AS fingerprint FROM findings""",
)
def _(t):
    return _run(t, feeds.stream_dedup(_feed(_stream(t, "findings")), late="60 days").select("fingerprint"), "append")


@query(
    "running_telemetry",
    "SELECT project, count(*) AS scans, CAST(sum(files_scanned) AS BIGINT) AS files, CAST(sum(findings_total) AS BIGINT) AS findings, round(avg(security_score), 6) AS mean_score FROM scan_metrics GROUP BY ALL",
)
def _(t):
    out = _run(t, feeds.running_telemetry(_stream(t, "scan_metrics")), "update", ["project"])
    return out.withColumn("mean_score", F.round("mean_score", 6))


@query(
    "severity_windows",
    f"SELECT date_trunc('day', created_at) AS window_start, upper({D.strip('severity')}) AS severity, count(*) AS n FROM findings GROUP BY ALL",
)
def _(t):
    out = _run(t, feeds.severity_windows(_feed(_stream(t, "findings")), "1 day"), "update", ["window_start", "severity"])
    return out.withColumn("window_start", _plain("window_start"))


@query(
    "severity_windows_sliding",
    """WITH w AS (SELECT unnest([time_bucket(INTERVAL 12 HOUR, created_at), time_bucket(INTERVAL 12 HOUR, created_at) - INTERVAL 12 HOUR]) AS window_start, severity FROM findings)
    SELECT window_start, severity, count(*) AS n FROM w GROUP BY ALL""",
)
def _(t):
    out = _run(t, feeds.severity_windows(_feed(_stream(t, "findings")), "1 day", "12 hours"), "update", ["window_start", "severity"])
    return out.withColumn("window_start", _plain("window_start"))


MOVES_SQL = (
    "CASE WHEN status NOT IN (" + ", ".join(D.q(s) for s in lifecycle.MOVES) + ") THEN 'invalid' WHEN prev IS NULL THEN 'start' WHEN prev = status THEN 'same' WHEN status = 'failed' THEN 'ok' "
    + " ".join(
        f"WHEN prev = '{a}' AND status IN ({', '.join(D.q(b) for b in bs)}) THEN 'ok'" for a, bs in lifecycle.MOVES.items() if bs
    )
    + " ELSE 'illegal' END"
)
LIFE_SQL = f"""WITH p AS (SELECT run_id, seq, status, lag(status) OVER (PARTITION BY run_id ORDER BY seq) AS prev FROM run_events),
 m AS (SELECT run_id, seq, coalesce(prev, '') AS before, status, {MOVES_SQL} AS move, status IN ('completed', 'failed') AS terminal FROM p) """


@query("run_lifecycle", LIFE_SQL + "SELECT * FROM m")
def _(t):
    return lifecycle.run_lifecycle(t.run_events)


@query(
    "run_summary",
    LIFE_SQL + "SELECT run_id, count(*) AS events, count(*) FILTER (WHERE move = 'illegal') AS illegal, arg_max(status, seq) AS last_status, arg_max(terminal, seq) AS terminal FROM m GROUP BY run_id",
)
def _(t):
    return lifecycle.run_summary(t.run_events)


@query("run_lifecycle_stream", LIFE_SQL + "SELECT * FROM m")
def _(t):
    return _run(t, lifecycle.stream_run_lifecycle(_stream(t, "run_events")), "append")

