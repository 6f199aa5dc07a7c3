"""The composed scan, next to the SQL of its parts put together."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import scan as W
from ..operators.health import PROFILES
from ..operators.rules import Rule
from . import duck as D
from .corpus_q import (
    _LS, _MINE, _PLACE, ASSIGN_SHOWN, ROOT_LOCK_RULES, ROOT_NAME_RULES, ROOT_RULES, SUPPRESS_RULES, _directive, _gate,
    _head, _own, _rule_rows, DEPLOY_SQL,
)
from .registry import query

STACK_RULES = (
    Rule(id="T-FLASK", name="flask import", stack="flask", extensions=(".py",), target="all", pattern=r"import os", severity="LOW"),
    Rule(id="T-GO", name="go total", stack="go", extensions=(".go", ".ts"), target="all", pattern=r"total =", severity="MEDIUM"),
)
FILE_RULES = SUPPRESS_RULES + STACK_RULES
ALL_RULES = FILE_RULES + ROOT_RULES + ROOT_NAME_RULES + ROOT_LOCK_RULES

_FILE_HITS = f"""SELECT h.project, h.path, h.rule_id, h.name, h.severity, h.line, h.suggestion FROM (
  {_rule_rows(FILE_RULES, "repo_files", lambda r: D.hit_line("content", r.pattern))}) h JOIN repo_files f ON h.project = f.project AND h.path = f.path
WHERE h.line > 0 AND NOT (
  len(list_filter({_LS}[1:10], lambda s: contains(s, 'scan-ignore-file') OR contains(s, 'scan:ignore-file'))) > 0
  OR ({_directive(f'{_LS}[h.line]')} AND (contains({_LS}[h.line], 'all') OR contains({_LS}[h.line], h.rule_id)))
  OR (h.line > 1 AND {_directive(f'{_LS}[h.line - 1]')} AND (contains({_LS}[h.line - 1], 'all') OR contains({_LS}[h.line - 1], h.rule_id))))"""


def _flag(rule, where: str) -> str:
    i, name, severity, suggestion = rule
    return f"SELECT project, path, {D.q(i)}, {D.q(name)}, {D.q(severity)}, 0, {D.q(suggestion)} FROM repo_files WHERE {where}"


_FILES = " UNION ALL ".join(
    [
        f"SELECT * FROM ({_FILE_HITS})",
        f"SELECT project, path, rule_id, {D.q(W.SECRET[0])}, severity, line, {D.q(W.SECRET[1])} FROM ({ASSIGN_SHOWN})",
        _flag(W.LARGE, f"{D.newlines('content')} > 1500"),
        _flag(W.RESIDUE, f"regexp_matches(path, '\\.(go|ts|tsx|js|jsx|py)$') AND NOT contains(path, 'node_modules') AND len(regexp_extract_all(content, '{_PLACE}')) > 5"),
        _flag(W.BRITTLE, f"{D.ext('path')} IN ('.go', '.js', '.ts') AND strlen(content) > 2000 AND NOT contains(content, 'err') AND NOT contains(content, 'catch')"),
    ]
)
_STACKED = " AND ".join(f"(h.rule_id <> {D.q(r.id)} OR m.stack = {D.q(r.stack)})" for r in STACK_RULES)
_PROJECT = " UNION ALL ".join(
    [
        f"{_head(r)} FROM roots r WHERE {_gate(r)} AND EXISTS ({_own(r)}) AND NOT EXISTS ({_own(r)} AND regexp_matches(m.content, {D.q(r.pattern)}))"
        for r in ROOT_RULES
    ]
    + [
        f"{_head(r)} FROM roots r WHERE {_gate(r)} AND NOT EXISTS ({_own(r)} AND regexp_matches({D.base('m.path')}, {D.q(r.pattern)}))"
        for r in ROOT_NAME_RULES
    ]
    + [
        f"{_head(r)} FROM roots r WHERE {_gate(r)} AND NOT EXISTS (SELECT 1 FROM repo_files f WHERE f.project = r.project AND f.path IN ("
        + ", ".join(f"CASE WHEN r.root = '.' THEN {D.q(n)} ELSE r.root || {D.q('/' + n)} END" for n in r.files) + "))"
        for r in ROOT_LOCK_RULES
    ]
)
CORE_SQL = _MINE.rstrip() + f""", hits(project, path, rule_id, name, severity, line, suggestion) AS MATERIALIZED ({_FILES}),
 every AS (SELECT m.project, m.root, m.stack, h.rule_id, h.name, h.severity, h.path AS file, CAST(h.line AS INT) AS line, h.suggestion FROM hits h JOIN mine m ON m.project = h.project AND m.path = h.path WHERE {_STACKED}
   UNION ALL SELECT project, root, stack, rule_id, name, severity, '', 0, suggestion FROM ({_PROJECT})),
 core AS (SELECT * FROM every QUALIFY row_number() OVER (PARTITION BY project, root, stack, rule_id, file, line ORDER BY {D.rank('severity')}, severity, name, suggestion) = 1) """


@query("core_scan", CORE_SQL + "SELECT * FROM core")
def _(t):
    return W.core_scan(t.repo_files, ALL_RULES)


@query(
    "core_scan_summary",
    CORE_SQL + """SELECT project, count(*) AS results, count(DISTINCT root) AS roots, count(DISTINCT rule_id) AS rules, count(*) FILTER (WHERE severity = 'CRITICAL') AS critical,
  count(*) FILTER (WHERE severity = 'HIGH') AS high, count(*) FILTER (WHERE severity = 'MEDIUM') AS medium, count(*) FILTER (WHERE severity = 'LOW') AS low FROM core GROUP BY project""",
)
def _(t):
    return W.scan_summary(W.core_scan(t.repo_files, ALL_RULES))


# ---- on to the gate ---------------------------------------------------------

GATES = (PROFILES["baseline"], PROFILES["strict"])
_AUDIT = (("T-EVAL", "IGNORED"), ("ENTROPY-SECRET", "TRIAGE"), ("dockerfile_root_user", "IGNORED"))
_KEY = "CASE WHEN file = '' AND line = 0 THEN source || '|' || lower(rule_id) ELSE lower(rule_id) || '|' || lower(file) || '|' || CAST(line AS VARCHAR) END"
# Every third length of a path has been audited.
AUDITED_SQL = (
    CORE_SQL.rstrip()
    + f""", feed AS (SELECT *, 'core' AS source FROM core UNION ALL
   SELECT DISTINCT project, '', '', issue, issue, severity, path, CAST(line AS INT), advice, 'deploy' FROM ({DEPLOY_SQL})),
 notes(rule_id, status) AS (VALUES {", ".join(f"({D.q(r)}, {D.q(s)})" for r, s in _AUDIT)}),
 audit AS (SELECT f.project, n.rule_id, f.path AS file, n.status FROM (SELECT DISTINCT project, path FROM repo_files WHERE length(path) % 3 = 0) f CROSS JOIN notes n),
 checked AS (SELECT f.*, coalesce(a.status, 'OPEN') AS audit_status, {D.owasp('f.rule_id')} AS owasp FROM feed f LEFT JOIN audit a ON a.project = f.project AND a.rule_id = f.rule_id AND a.file = f.file) """
)
GATE_SQL = (
    AUDITED_SQL.rstrip()
    + f""", keyed AS (SELECT *, {_KEY} AS k, audit_status IN ('IGNORED', 'TRIAGE') AS ignored, {D.tenths('severity', 'source')} AS t FROM checked),
 rep AS (SELECT * FROM keyed QUALIFY row_number() OVER (PARTITION BY project, k ORDER BY ignored, t DESC, {D.rank('severity')}, source, rule_id, severity, file, line) = 1),
 agg AS (SELECT project, CAST(coalesce(sum(t) FILTER (WHERE NOT ignored), 0) AS BIGINT) AS t, count(*) FILTER (WHERE NOT ignored) AS active_findings, count(*) FILTER (WHERE ignored) AS ignored_findings,
   count(*) FILTER (WHERE NOT ignored AND severity IN ('CRITICAL', 'HIGH')) AS bad, count(*) FILTER (WHERE NOT ignored AND severity = 'CRITICAL') AS critical,
   count(*) FILTER (WHERE NOT ignored AND severity = 'HIGH') AS high, count(*) FILTER (WHERE NOT ignored AND severity = 'MEDIUM') AS medium FROM rep GROUP BY project),
 every_project AS (SELECT p.project, coalesce(t, 0) AS t, coalesce(active_findings, 0) AS active_findings, coalesce(ignored_findings, 0) AS ignored_findings, coalesce(bad, 0) AS bad,
   coalesce(critical, 0) AS critical, coalesce(high, 0) AS high, coalesce(medium, 0) AS medium FROM (SELECT DISTINCT project FROM repo_files) p LEFT JOIN agg a ON a.project = p.project),
 scored AS (SELECT *, CAST(least(greatest(round(100.0::DOUBLE - 100.0::DOUBLE * (1.0::DOUBLE - exp(-(t / 10.0::DOUBLE) / 55.0::DOUBLE))), 0), 100) AS BIGINT) AS score FROM every_project),
 gated AS (SELECT *, 'baseline' AS profile, CAST(bad > 0 AS BIGINT) AS reasons FROM scored
   UNION ALL SELECT *, 'strict', CAST(active_findings > 0 AS BIGINT) + CAST(critical > 0 AS BIGINT) + CAST(high > 0 AS BIGINT) + CAST(medium > 0 AS BIGINT) + CAST(score < 90 AS BIGINT) FROM scored)
SELECT project, profile, reasons, CASE WHEN reasons = 0 THEN 'passed' ELSE 'failed' END AS status, score, {D.grade('score')} AS grade, active_findings, ignored_findings FROM gated"""
)


def _audit(t):
    notes = F.array(*[F.struct(F.lit(r).alias("rule_id"), F.lit(s).alias("status")) for r, s in _AUDIT])
    noted = t.repo_files.filter(F.length("path") % 3 == 0).select("project", "path").distinct()
    return noted.select("project", F.col("path").alias("file"), F.explode(notes).alias("n")).select("project", "file", "n.*")


@query(
    "core_audited",
    AUDITED_SQL + "SELECT project, root, stack, source, rule_id, name, severity, file, line, suggestion, audit_status, owasp FROM checked",
)
def _(t):
    return W.audited_scan(W.written(W.file_facts(t.repo_files, ALL_RULES)), ALL_RULES, _audit(t))


@query("core_gate", GATE_SQL)
def _(t):
    return W.scan_gate(t.repo_files, ALL_RULES, _audit(t), GATES)
