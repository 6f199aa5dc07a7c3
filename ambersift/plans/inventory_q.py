"""Merging, numbering, scoring and triage of findings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import SENSITIVE_SHAPES
from ..operators import file_checks as C
from ..operators import health as H
from ..operators import merge as M
from ..operators import triage as G
from . import duck as D
from .corpus_q import _first_secret, _preview
from .registry import query

c = F.col
NO_FINDING = "file = '' AND line = 0"

# ---- merge and order ------------------------------------------------------

MERGE_KEY = (
    f"CASE WHEN {D.semantic('rule_id')} = '' THEN 'exact|' || {D.fingerprint()} "
    f"WHEN file <> '' OR line <> 0 THEN {D.semantic('rule_id')} || '|' || {D.normal('file')} || '|' || CAST(line AS VARCHAR) "
    f"ELSE {D.semantic('rule_id')} || '|project' END"
)
_PREF = D.case(f"lower({D.strip('type')})", {"core": 3, "external": 2, "nfr": 1}, 0)
MERGE_SQL = f"""WITH keyed AS (SELECT *, {MERGE_KEY} AS merge_key, {_PREF} AS pref, {D.rank('severity')} AS rank, upper({D.strip('severity')}) AS sev FROM raw_findings),
 rep AS (SELECT * FROM keyed QUALIFY row_number() OVER (PARTITION BY product_id, merge_key ORDER BY pref DESC, file = '', lower(rule_id), rank, file, line, message, source, type, rule_id) = 1),
 worst AS (SELECT product_id, merge_key, min(rank) AS rank, count(*) AS merged FROM keyed GROUP BY ALL),
 sev AS (SELECT k.product_id, k.merge_key, min(k.sev) AS severity, any_value(w.merged) AS merged FROM keyed k JOIN worst w USING (product_id, merge_key) WHERE k.rank = w.rank GROUP BY ALL),
 place AS (SELECT product_id, merge_key, file AS pf, line AS pl FROM keyed WHERE file <> '' QUALIFY row_number() OVER (PARTITION BY product_id, merge_key ORDER BY file, line) = 1),
 org AS (SELECT product_id, merge_key, string_agg(o, ';' ORDER BY lower(replace(o, '/', chr(0)))) AS origins FROM (SELECT DISTINCT product_id, merge_key, type || '/' || source || '/' || rule_id AS o FROM keyed) GROUP BY ALL)
"""


@query(
    "dedup_semantic",
    MERGE_SQL + """SELECT r.product_id, r.merge_key, r.rule_id, r.type, r.source, s.severity,
    CASE WHEN r.file = '' AND p.pf IS NOT NULL THEN p.pf ELSE r.file END AS file, CASE WHEN r.file = '' AND p.pf IS NOT NULL THEN p.pl ELSE r.line END AS line,
    r.message, CAST(s.merged AS BIGINT) AS merged, o.origins
    FROM rep r JOIN sev s USING (product_id, merge_key) LEFT JOIN place p USING (product_id, merge_key) JOIN org o USING (product_id, merge_key)""",
)
def _(t):
    return M.dedup_semantic(t.raw_findings, ["product_id"]).withColumn("origins", M.origins_text(c("origins")))


@query(
    "merge_origins",
    f"SELECT product_id, merge_key, count(DISTINCT type || '/' || source || '/' || rule_id) AS origins FROM (SELECT *, {MERGE_KEY} AS merge_key FROM raw_findings) GROUP BY ALL",
)
def _(t):
    merged = M.dedup_semantic(t.raw_findings, ["product_id"])
    return merged.select("product_id", "merge_key", F.size("origins").cast("long").alias("origins"))


@query(
    "dedup_exact",
    f"""WITH k AS (SELECT idx, project, {D.fingerprint()} AS fingerprint FROM enriched)
    SELECT project, idx, fingerprint, min(idx) OVER w AS first_idx, count(*) OVER w AS group_size, idx = min(idx) OVER w AS is_first
    FROM k WINDOW w AS (PARTITION BY project, fingerprint)""",
)
def _(t):
    return M.dedup_exact(t.enriched, "idx", ["project"])


@query(
    "dedup_scan",
    f"""SELECT scan_id, CASE WHEN {NO_FINDING} THEN rule_id ELSE rule_id || ':' || file || ':' || CAST(line AS VARCHAR) END AS scan_key,
    min(severity) AS severity, min(rule_id) AS rule_id FROM results GROUP BY ALL""",
)
def _(t):
    # Columns that the result does not show would move with every row.
    shown = t.results.select("scan_id", "rule_id", "file", "line", "severity")
    return M.dedup_scan(shown, ["scan_id"], ["severity"]).select("scan_id", "scan_key", "severity", "rule_id")


_ORDER = (
    f"{D.type_order('type')}, lower({D.strip('source')}), {D.rank('severity')}, {D.normal('file')}, line, "
    f"lower({D.strip('rule_id')}), {D.strip('message')}, {D.fingerprint()}"
)


@query(
    "canonical_vuln_ids",
    f"""SELECT idx, project, class_code, 'CS-' || class_code || '-' || CASE WHEN length(CAST(n AS VARCHAR)) < 3 THEN lpad(CAST(n AS VARCHAR), 3, '0') ELSE CAST(n AS VARCHAR) END AS vuln_id
    FROM (SELECT *, row_number() OVER (PARTITION BY project, class_code ORDER BY {_ORDER}, idx) AS n FROM (SELECT *, {D.vuln_code('message')} AS class_code FROM enriched))""",
)
def _(t):
    # A hot project or class is spread over slices.
    return M.canonical_vuln_ids(t.enriched.drop("vuln_id"), ["project"], tie=["idx"]).select("idx", "project", "class_code", "vuln_id")


@query("canonical_sort", f"SELECT idx, project, row_number() OVER (PARTITION BY project ORDER BY {_ORDER}, idx) AS place FROM enriched")
def _(t):
    return M.canonical_places(t.enriched, "idx", by=["project"]).select("idx", "project", "place")


@query(
    "batches",
    f"SELECT idx, project, position, CAST(floor((position - 1) / 5) AS BIGINT) AS batch FROM (SELECT idx, project, row_number() OVER (PARTITION BY project ORDER BY {_ORDER}, idx) AS position FROM enriched)",
)
def _(t):
    return M.batches(t.enriched, [*M.canonical_order(), c("idx")], 5, ["project"]).select("idx", "project", "position", "batch")


@query(
    "project_verdicts",
    """WITH u AS (SELECT project, fingerprint, min(idx) AS first_idx FROM inventory GROUP BY ALL)
    SELECT i.project, i.idx, i.vuln_id, i.fingerprint, v.disposition, v.rationale FROM inventory i JOIN u USING (project, fingerprint) JOIN verdicts v ON v.idx = u.first_idx""",
)
def _(t):
    unique = M.unique_findings(t.enriched, "idx", ["project"]).select("project", "fingerprint", "idx")
    verdicts = unique.join(t.verdicts.select("idx", "disposition", "rationale"), "idx").drop("idx")
    return M.project_verdicts(t.enriched, verdicts, ["project"]).select(
        "project", "idx", "vuln_id", "fingerprint", "disposition", "rationale"
    )


@query(
    "mark_duplicates",
    """SELECT id, id <> min(id) OVER w AS is_duplicate, CASE WHEN id <> min(id) OVER w THEN min(id) OVER w END AS duplicate_of
    FROM findings WINDOW w AS (PARTITION BY product_id, hash_code)""",
)
def _(t):
    return M.mark_duplicates(t.findings).select("id", "is_duplicate", "duplicate_of")


def _feeds(t):
    r, code = t.raw_findings, c("type")
    core = t.results.select("project", "rule_id", "severity", "file", "line", "name", "evidence")
    ext = r.filter(code == "external").select("project", "rule_id", "source", "severity", "file", "line", "message")
    nfr = r.filter(code == "nfr").select("project", "rule_id", "severity", c("rule_id").alias("name"), "message")
    dep = r.filter(code == "deploy").select(
        "project", "severity", "file", "line", c("rule_id").alias("issue"), c("message").alias("advice")
    )
    net = r.filter(code == "network").select(
        "project", "severity", (c("scan_id") % 100).alias("port"), c("source").alias("service"), "message"
    )
    return core, ext, nfr, dep, net


UNION_SQL = """SELECT project, rule_id, 'core' AS type, 'core' AS source, severity, file, line, name || ': ' || evidence AS message FROM results
UNION ALL SELECT project, rule_id, 'external', source, severity, file, line, '[' || source || '] ' || message FROM raw_findings WHERE type = 'external'
UNION ALL SELECT project, rule_id, 'nfr', 'core', severity, '', 0, rule_id || ': ' || message FROM raw_findings WHERE type = 'nfr'
UNION ALL SELECT project, rule_id, 'deploy', 'core', severity, file, line, rule_id || '. Advice: ' || message FROM raw_findings WHERE type = 'deploy'
UNION ALL SELECT project, 'port-' || CAST(scan_id % 100 AS VARCHAR), 'network', 'core', severity, '', 0,
  'Port ' || CAST(scan_id % 100 AS VARCHAR) || ' (' || source || '): ' || message FROM raw_findings WHERE type = 'network'"""


@query("union_scanners", UNION_SQL)
def _(t):
    return M.union_scanners(*_feeds(t))


INGEST_SQL = """SELECT product_id, rule_id, name AS title, upper(severity) AS severity, file AS file_path, line AS line_number, suggestion AS description, suggestion AS fix_suggestion,
  'open' AS status, 'backlog' AS kanban_column, stack FROM (SELECT *, CAST(substr(project, 5) AS BIGINT) AS product_id, 'fastapi' AS stack FROM results)
UNION ALL SELECT product_id, rule_id, '[' || source || '] ' || CASE WHEN rule_id = '' THEN message ELSE rule_id END, coalesce(nullif(upper(severity), ''), 'MEDIUM'), file, line, message, message, 'open', 'backlog', source FROM raw_findings WHERE type = 'external'
UNION ALL SELECT product_id, rule_id, rule_id, coalesce(nullif(upper(severity), ''), 'LOW'), NULL, 0, message, message, 'open', 'backlog', 'nfr' FROM raw_findings WHERE type = 'nfr'
UNION ALL SELECT product_id, 'deploy-' || string_split(file, '/')[-1] || '-' || CAST(line AS VARCHAR), rule_id, coalesce(nullif(upper(severity), ''), 'MEDIUM'), file, line, rule_id, message, 'open', 'backlog', 'deploy' FROM raw_findings WHERE type = 'deploy'
UNION ALL SELECT product_id, 'net-' || project || '-' || CAST(scan_id % 100 AS VARCHAR), 'Open port ' || CAST(scan_id % 100 AS VARCHAR) || ' (' || source || ') on ' || project, coalesce(nullif(upper(severity), ''), 'HIGH'), project, 0, message, message, 'open', 'backlog', 'network' FROM raw_findings WHERE type = 'network'
UNION ALL SELECT CAST(substr(project, 5) AS BIGINT), 'gitleak-' || left(commit_id, 8), 'Secret leak: ' || pattern || ' in ' || path, 'HIGH', path, 0, note, note, 'open', 'backlog', 'git-history'
  FROM (SELECT *, 'Pattern ' || chr(39) || pattern || chr(39) || ' found in commit ' || commit_id || ' by ' || author || ': ' || preview AS note FROM (
    SELECT f.project, f.path, f.commit_id, f.committed_at, f.author, u.line, {FIRST_SECRET} AS pattern, {PREVIEW} AS preview FROM git_lines f, {LINES} WHERE {FIRST_SECRET} IS NOT NULL)
    QUALIFY row_number() OVER (PARTITION BY project, path, pattern, commit_id ORDER BY committed_at, line) = 1)"""


INGEST_SQL = INGEST_SQL.replace("{FIRST_SECRET}", _first_secret("u.text")).replace("{PREVIEW}", _preview("u.text")).replace("{LINES}", D.lines())


@query("ingest_union", INGEST_SQL)
def _(t):
    core = t.results.select(
        F.substring("project", 5, 20).cast("long").alias("product_id"), "rule_id", "name", "severity", "file", "line",
        "suggestion", F.lit("fastapi").alias("stack"),
    )
    r = t.raw_findings
    ext = r.filter(c("type") == "external")
    nfr = r.filter(c("type") == "nfr").withColumn("name", c("rule_id"))
    dep = r.filter(c("type") == "deploy").withColumns({"issue": c("rule_id"), "advice": c("message")})
    net = r.filter(c("type") == "network").withColumns(
        {"port": c("scan_id") % 100, "service": c("source"), "target": c("project")}
    )
    hits = C.secret_scan(t.git_lines, ("project", "path", "commit_id", "committed_at", "author"))
    leaks = C.history_leaks(hits, limit=None).withColumn("product_id", F.substring("project", 5, 20).cast("long"))
    return M.ingest_union(core, ext, nfr, dep, net, leaks)


# ---- health ---------------------------------------------------------------

_HEALTH_KEY = (
    f"CASE WHEN {NO_FINDING} THEN lower(source) || '|' || lower({D.strip('rule_id')}) "
    f"ELSE lower({D.strip('rule_id')}) || '|' || lower(file) || '|' || CAST(line AS VARCHAR) END"
)
REP_SQL = f"""keyed AS (SELECT *, {_HEALTH_KEY} AS dedup_key, {D.tenths('severity', 'source')} AS tenths, {D.rank('severity')} AS rank FROM raw_findings),
 rep AS (SELECT *, count(*) OVER (PARTITION BY product_id, dedup_key) AS copies FROM keyed
   QUALIFY row_number() OVER (PARTITION BY product_id, dedup_key ORDER BY ignored, tenths DESC, rank, source, rule_id, severity, file, line) = 1),
 act AS (SELECT product_id, dedup_key, copies, ignored, tenths, coalesce(nullif(upper({D.strip('severity')}), ''), 'UNKNOWN') AS severity, lower(source) AS source, lower(rule_id) AS class FROM rep)"""
_PEN = "100.0::DOUBLE * (1.0::DOUBLE - exp(-(t / 10.0::DOUBLE) / 55.0::DOUBLE))"


def _scan(t):
    return t.raw_findings.select(
        "product_id", "source", c("rule_id").alias("class"), "severity", "file", "line", "ignored"
    )


def _positives(t):
    good = t.results.filter(c("status") == "PRESENT")
    return good.groupBy(F.substring("project", 5, 20).cast("long").alias("product_id")).agg(
        F.countDistinct("rule_id").alias("positives")
    )


@query("health_representative", f"WITH {REP_SQL} SELECT product_id, dedup_key, copies, ignored, tenths, severity, source, class FROM act")
def _(t):
    return H.health_representative(_scan(t), ["product_id"])


SCORE_SQL = f"""WITH {REP_SQL},
 pos AS (SELECT CAST(substr(project, 5) AS BIGINT) AS product_id, count(DISTINCT rule_id) AS positives FROM results WHERE status = 'PRESENT' GROUP BY ALL),
 agg AS (SELECT product_id, CAST(coalesce(sum(tenths) FILTER (WHERE NOT ignored), 0) AS BIGINT) AS t, count(*) FILTER (WHERE NOT ignored) AS active_findings, count(*) FILTER (WHERE ignored) AS ignored_findings,
   CAST(sum(copies - 1) AS BIGINT) AS deduped_findings, count(*) FILTER (WHERE NOT ignored AND severity = 'CRITICAL') AS critical, count(*) FILTER (WHERE NOT ignored AND severity = 'HIGH') AS high,
   count(*) FILTER (WHERE NOT ignored AND severity = 'MEDIUM') AS medium FROM act GROUP BY product_id),
 parts AS (SELECT a.*, {_PEN} AS pen, CASE WHEN critical + high > 0 THEN 0 ELSE least(round(coalesce(p.positives, 0) * 0.6::DOUBLE), 10.0::DOUBLE) END AS bonus FROM agg a LEFT JOIN pos p USING (product_id)),
 scored AS (SELECT *, CAST(least(greatest(round(100.0::DOUBLE - pen + bonus), 0), 100) AS BIGINT) AS score FROM parts),
 health AS (SELECT product_id, score, {D.grade('score')} AS grade, critical + high > 0 AS has_critical_failures, round(t / 10.0::DOUBLE, 2) AS raw_weight, CAST(round(pen) AS BIGINT) AS penalty, CAST(bonus AS BIGINT) AS bonus,
   active_findings, ignored_findings, deduped_findings, critical, high, medium FROM scored)
"""


@query("health_score", SCORE_SQL + "SELECT * FROM health")
def _(t):
    return H.health_score(_scan(t), ["product_id"], _positives(t))


PENALTY_SQL = f"""WITH {REP_SQL}, src AS (SELECT product_id, source, CAST(sum(tenths) AS BIGINT) AS s FROM act WHERE NOT ignored GROUP BY ALL),
 tot AS (SELECT product_id, sum(s) AS t FROM src GROUP BY ALL),
 shares AS (SELECT product_id, source, CAST(round({_PEN} * (s / t)) AS BIGINT) AS penalty FROM src JOIN tot USING (product_id) WHERE t > 0)
"""


@query("penalty_by_source", PENALTY_SQL + "SELECT * FROM shares")
def _(t):
    return H.penalty_by_source(_scan(t), ["product_id"])


@query(
    "top_penalty_sources",
    PENALTY_SQL + "SELECT *, CAST(row_number() OVER (PARTITION BY product_id ORDER BY penalty DESC, source) AS INT) AS place FROM shares",
)
def _(t):
    return H.top_penalty_sources(_scan(t), ["product_id"])


COUNTS_SQL = """counts AS (SELECT product_id, 'severity' AS dimension, severity AS value, count(*) AS n FROM act WHERE NOT ignored GROUP BY ALL
 UNION ALL SELECT product_id, 'source', source, count(*) FROM act WHERE NOT ignored GROUP BY ALL
 UNION ALL SELECT product_id, 'class', class, count(*) FROM act WHERE NOT ignored GROUP BY ALL
 UNION ALL SELECT product_id, 'total', CASE WHEN ignored THEN 'ignored' ELSE 'active' END, count(*) FROM act GROUP BY ALL
 UNION ALL SELECT product_id, 'total', 'deduped', CAST(sum(copies - 1) AS BIGINT) FROM act WHERE copies > 1 GROUP BY product_id)"""


@query("health_counts", f"WITH {REP_SQL}, {COUNTS_SQL} SELECT * FROM counts")
def _(t):
    return H.health_counts(_scan(t), ["product_id"])


POLICIES = (
    H.PROFILES["baseline"],
    H.Policy("standard", "critical", 70, 0, 40, H.UNLIMITED, ("Trivy ",), ("ENTR-18",)),
    H.PROFILES["strict"],
)
REASONS_SQL = SCORE_SQL.rstrip() + f""", {COUNTS_SQL}, reasons AS (
 SELECT product_id, 'baseline' AS profile, 'critical_or_high_findings' AS code, 'HIGH' AS severity, '' AS source, '' AS class, critical + high AS n, 0::BIGINT AS threshold FROM health WHERE critical + high > 0
 UNION ALL SELECT product_id, 'standard', 'critical_or_high_findings', 'HIGH', '', '', critical + high, 0 FROM health WHERE critical + high > 0
 UNION ALL SELECT product_id, 'standard', 'critical_threshold', 'CRITICAL', '', '', critical, 0 FROM health WHERE critical > 0
 UNION ALL SELECT product_id, 'standard', 'high_threshold', 'HIGH', '', '', high, 40 FROM health WHERE high > 40
 UNION ALL SELECT product_id, 'standard', 'minimum_score', '', '', '', score, 70 FROM health WHERE score < 70
 UNION ALL SELECT product_id, 'standard', 'blocked_source', '', 'trivy', '', n, 0 FROM counts WHERE dimension = 'source' AND value = 'trivy'
 UNION ALL SELECT product_id, 'standard', 'blocked_class', '', '', 'entr-18', n, 0 FROM counts WHERE dimension = 'class' AND value = 'entr-18'
 UNION ALL SELECT product_id, 'strict', 'active_findings', '', '', '', active_findings, 0 FROM health WHERE active_findings > 0
 UNION ALL SELECT product_id, 'strict', 'critical_threshold', 'CRITICAL', '', '', critical, 0 FROM health WHERE critical > 0
 UNION ALL SELECT product_id, 'strict', 'high_threshold', 'HIGH', '', '', high, 0 FROM health WHERE high > 0
 UNION ALL SELECT product_id, 'strict', 'medium_threshold', 'MEDIUM', '', '', medium, 0 FROM health WHERE medium > 0
 UNION ALL SELECT product_id, 'strict', 'minimum_score', '', '', '', score, 90 FROM health WHERE score < 90)
"""


def _gate_scores(t):
    return H.gate_scores(_scan(t), ["product_id"], POLICIES, _positives(t))


@query("gate_reasons", REASONS_SQL + "SELECT * FROM reasons")
def _(t):
    return H.gate_reasons(_gate_scores(t), ["product_id"], POLICIES)


@query(
    "gate_verdict",
    REASONS_SQL + """SELECT h.product_id, p.profile, count(r.code) AS reasons, CASE WHEN count(r.code) = 0 THEN 'passed' ELSE 'failed' END AS status
    FROM health h CROSS JOIN (SELECT unnest(['baseline', 'standard', 'strict']) AS profile) p LEFT JOIN reasons r ON r.product_id = h.product_id AND r.profile = p.profile GROUP BY ALL""",
)
def _(t):
    return H.gate_verdict(_gate_scores(t), ["product_id"], POLICIES)


# ---- triage ---------------------------------------------------------------

_TEST = "regexp_matches('/' || {f} || '/', '/tests?/|_test\\.(go|py)/$|\\.(test|spec)\\.[^/]*/$')"
VALID_SQL = f"""chk AS (SELECT v.*, i.vuln_id, i.fingerprint, i.project, i.file, i.line, string_split(f.content, chr(10)) AS ls,
   {D.normal('i.file')} = {D.normal('v.ev_file')} AS same, {_TEST.replace('{f}', 'lower(i.file)')} AS istest
   FROM raw_verdicts v LEFT JOIN inventory i USING (idx) LEFT JOIN repo_files f ON f.project = i.project AND f.path = i.file),
 why AS (SELECT *, ls IS NOT NULL AND same AS there FROM chk),
 fpr AS (SELECT idx, seq, disposition, CASE
   WHEN vuln_id IS NULL THEN 'unknown_finding'
   WHEN disposition NOT IN ('True Positive', 'False Positive', 'Needs Manual Review') THEN 'unknown_disposition'
   WHEN finding_id <> vuln_id THEN 'other_finding_id'
   WHEN v_fingerprint <> fingerprint THEN 'other_fingerprint'
   WHEN disposition <> 'False Positive' THEN ''
   WHEN basis IS NULL THEN 'no_evidence'
   WHEN basis = 'test_only' THEN CASE WHEN NOT istest THEN 'test_only_not_a_test' WHEN ev_file = '' THEN 'test_only_no_file'
     WHEN NOT there THEN 'test_only_bad_file' WHEN ev_line > 0 AND line > 0 AND ev_line <> line THEN 'test_only_other_line' ELSE '' END
   WHEN basis = 'code_mitigation' THEN CASE WHEN ev_file = '' OR ev_line < 1 OR strlen({D.strip('observed')}) < 4 THEN 'code_incomplete'
     WHEN NOT there THEN 'code_bad_file' WHEN ev_line > len(ls) THEN 'code_no_such_line'
     WHEN NOT contains(ls[ev_line], observed) THEN 'code_not_in_source' ELSE '' END
   ELSE 'unverifiable_basis' END AS reason FROM why)"""


def _checked(t):
    return t.raw_verdicts.select(
        "idx", "seq", "finding_id", "v_fingerprint", "disposition", "basis", "ev_file", "ev_line", "observed"
    )


@query("validate_fp_evidence", f"WITH {VALID_SQL} SELECT idx, seq, disposition, reason FROM fpr")
def _(t):
    out = G.validate_fp_evidence(_checked(t), t.inventory, t.repo_files)
    return out.select("idx", "seq", "disposition", "reason")


@query(
    "validate_verdicts",
    f"""WITH {VALID_SQL}, got AS (SELECT idx, min(seq) AS first FROM fpr WHERE reason = '' GROUP BY idx),
    done AS (SELECT f.idx, f.seq, f.disposition, CASE WHEN f.seq > g.first AND reason NOT IN ('unknown_finding', 'unknown_disposition') THEN 'later_duplicate' ELSE reason END AS reason FROM fpr f LEFT JOIN got g USING (idx))
    SELECT *, reason = '' AS accepted FROM done""",
)
def _(t):
    out = G.validate_verdicts(_checked(t), t.inventory, t.repo_files)
    return out.select("idx", "seq", "disposition", "reason", "accepted")


_ACCEPTED = f"WITH {VALID_SQL}, got AS (SELECT DISTINCT idx FROM fpr WHERE reason = '') "


def _accepted(t):
    return G.validate_verdicts(_checked(t), t.inventory, t.repo_files).filter("accepted")


@query(
    "verdict_completeness",
    _ACCEPTED + "SELECT idx, CAST(0 AS BIGINT) AS verdicts FROM inventory WHERE idx NOT IN (SELECT idx FROM got)",
)
def _(t):
    return G.incomplete_findings(t.inventory, _accepted(t))


@query(
    "fallback_verdicts",
    _ACCEPTED + f"""SELECT idx, fingerprint, 'Needs Manual Review' AS disposition, {D.q(G.FALLBACK_RATIONALE)} AS rationale, 'low' AS confidence, 'nr-fallback' AS disposition_source
    FROM inventory WHERE idx NOT IN (SELECT idx FROM got)""",
)
def _(t):
    return G.fallback_verdicts(t.inventory, _accepted(t))


@query(
    "verdict_cache_lookup",
    f"""WITH u AS (SELECT project, fingerprint, min(idx) AS idx, min(vuln_id) AS vuln_id, min(file) AS file, min(line) AS line FROM inventory GROUP BY project, fingerprint),
    j AS (SELECT u.*, v.disposition, v.confidence, v.ev_file, v.ev_line, v.observed, string_split(f.content, chr(10)) AS ls FROM u LEFT JOIN verdict_cache v ON v.fingerprint = u.fingerprint AND v.namespace = 'v1:now'
      LEFT JOIN repo_files f ON f.project = u.project AND f.path = u.file),
    s AS (SELECT idx, fingerprint, CASE WHEN disposition IS NULL THEN 'miss' WHEN disposition = 'False Positive' AND NOT (ls IS NOT NULL AND contains(ls[ev_line], observed)) THEN 'invalidated' ELSE 'hit' END AS state, disposition, confidence FROM j)
    SELECT idx, fingerprint, state, CASE WHEN state = 'hit' THEN disposition END AS disposition, CASE WHEN state = 'hit' THEN confidence END AS confidence FROM s""",
)
def _(t):
    first = t.inventory.groupBy("project", "fingerprint").agg(
        F.min("idx").alias("idx"), F.min("vuln_id").alias("vuln_id"), F.min("file").alias("file"),
        F.min("line").alias("line"),
    )
    return G.verdict_cache_lookup(first, t.verdict_cache, t.repo_files, "v1:now")


_LOW = "upper(trim(severity)) NOT IN ('CRITICAL', 'HIGH')"


@query(
    "gate_severity",
    f"""SELECT idx, NOT {_LOW} AS to_triage, CASE WHEN {_LOW} THEN 'Needs Manual Review' END AS disposition,
    CASE WHEN {_LOW} THEN 'Severity ' || coalesce(nullif(upper(trim(severity)), ''), 'UNKNOWN') || ' is below the LLM triage threshold (gating). Not auto-suppressed; manual review recommended.' END AS rationale,
    CASE WHEN {_LOW} THEN 'deterministic' END AS disposition_source FROM inventory""",
)
def _(t):
    return G.gate_severity(t.inventory, True).select("idx", "to_triage", "disposition", "rationale", "disposition_source")


@query(
    "llm_budget",
    "SELECT idx, project, row_number() OVER (PARTITION BY project ORDER BY idx) <= 2 AS sent FROM inventory WHERE severity IN ('CRITICAL', 'HIGH')",
)
def _(t):
    todo = t.inventory.filter(c("severity").isin("CRITICAL", "HIGH"))
    return G.llm_budget(todo, ["idx"], 2, ["project"]).select("idx", "project", "sent")


@query(
    "verdict_source_metrics",
    """SELECT 'findings' AS metric, count(*) AS n FROM inventory UNION ALL SELECT 'unique', count(DISTINCT fingerprint) FROM inventory
    UNION ALL SELECT 'deduped', count(*) - count(DISTINCT fingerprint) FROM inventory
    UNION ALL SELECT 'source:' || disposition_source, count(*) FROM verdicts GROUP BY ALL UNION ALL SELECT 'disposition:' || disposition, count(*) FROM verdicts GROUP BY ALL""",
)
def _(t):
    return G.verdict_source_metrics(t.inventory, t.verdicts)


@query(
    "severity_by_disposition",
    "SELECT d.disposition, " + ", ".join(
        f"count(*) FILTER (WHERE j.severity = '{s}') AS {s.lower()}" for s in ("CRITICAL", "HIGH", "MEDIUM", "LOW")
    ) + """ FROM (SELECT unnest(['True Positive', 'Needs Manual Review']) AS disposition) d
    LEFT JOIN (SELECT v.disposition, i.severity FROM inventory i JOIN verdicts v USING (idx)) j USING (disposition) GROUP BY ALL""",
)
def _(t):
    return G.severity_by_disposition(t.inventory, t.verdicts)


@query(
    "top_critical",
    """SELECT i.idx, i.project, i.vuln_id, i.severity, i.file, i.line, CAST(row_number() OVER w AS INT) AS place FROM inventory i JOIN verdicts v USING (idx) WHERE v.disposition <> 'False Positive' AND i.severity IN ('CRITICAL', 'HIGH')
    WINDOW w AS (PARTITION BY i.project ORDER BY CASE i.severity WHEN 'CRITICAL' THEN 0 ELSE 1 END, i.idx) QUALIFY row_number() OVER w <= 5""",
)
def _(t):
    return G.top_critical(t.inventory, t.verdicts, by=["project"]).select("idx", "project", "vuln_id", "severity", "file", "line", "place")


@query(
    "handoff",
    f"""WITH gate AS (SELECT project, sum(CASE severity WHEN 'CRITICAL' THEN 1 ELSE 0 END) AS crit FROM inventory GROUP BY project)
    SELECT i.project, i.idx, i.vuln_id, i.severity, i.file, i.line, replace(CASE WHEN length(i.message) > 120 THEN left(i.message, 117) || '...' ELSE i.message END, chr(10), ' ') AS title,
      v.disposition, v.rationale AS recommendation, CAST(100 - least(g.crit, 100) AS BIGINT) AS score, {D.grade('(100 - least(g.crit, 100))')} AS grade,
      CASE WHEN g.crit = 0 THEN 'PASSED' ELSE 'FAILED' END AS gate_status
    FROM inventory i JOIN verdicts v USING (idx) JOIN gate g ON g.project = i.project WHERE v.disposition <> 'False Positive'""",
)
def _(t):
    from ..functions.severity import grade

    crit = F.count_if(c("severity") == "CRITICAL")
    gates = t.inventory.groupBy("project").agg(crit.alias("n")).select(
        "project", (F.lit(100) - F.least("n", F.lit(100))).cast("long").alias("score"),
        F.when(c("n") == 0, "passed").otherwise("failed").alias("status"),
    ).withColumn("grade", grade(c("score")))
    return G.handoff(t.inventory, t.verdicts, gates, ["project"])


@query(
    "handoff_totals",
    """SELECT i.project, count(*) FILTER (WHERE v.disposition = 'True Positive') AS true_positives, count(*) FILTER (WHERE v.disposition = 'False Positive') AS false_positives,
    count(*) FILTER (WHERE v.disposition = 'Needs Manual Review') AS needs_review, count(*) AS total FROM inventory i JOIN verdicts v USING (idx) GROUP BY ALL""",
)
def _(t):
    return G.handoff_totals(t.inventory, t.verdicts, ["project"])


@query(
    "triage_artifact",
    """SELECT i.idx, v.disposition, to_json({'finding_index': i.idx, 'finding': {'project': i.project, 'vuln_id': i.vuln_id, 'severity': i.severity, 'file': i.file, 'line': i.line},
    'disposition': {'disposition': v.disposition, 'rationale': v.rationale, 'confidence': v.confidence, 'disposition_source': v.disposition_source}})::VARCHAR AS document FROM inventory i JOIN verdicts v USING (idx)""",
)
def _(t):
    findings = t.inventory.select("idx", "project", "vuln_id", "severity", "file", "line")
    return G.triage_artifact(findings, t.verdicts)


_SENS = " OR ".join(
    f"regexp_matches({{x}}, {D.q(p)})" for p in SENSITIVE_SHAPES
)


@query(
    "uncached_verdicts",
    f"""WITH m AS (SELECT count(DISTINCT fingerprint) FILTER (WHERE disposition_source = 'nr-fallback') AS fallbacks,
      count(*) FILTER (WHERE disposition_source = 'llm' AND ({_SENS.replace('{x}', 'rationale')} OR {_SENS.replace('{x}', 'observed')})) AS sensitive FROM verdicts)
    SELECT fallbacks, sensitive, fallbacks + sensitive AS uncached FROM m""",
)
def _(t):
    return G.uncached_verdicts(t.verdicts)


_VH = (
    "sha256(fingerprint || chr(31) || disposition || chr(31) || "
    + D.case(f"lower({D.strip('confidence')})", {"high": "high", "medium": "medium", "med": "medium", "low": "low"}, "")
    + " || chr(31) || rationale)"
)


@query(
    "bundle_key",
    f"""WITH e AS (SELECT i.project, i.idx, i.fingerprint || ':' || {_VH.replace('fingerprint', 'v.fingerprint')} AS x FROM inventory i JOIN verdicts v USING (idx)),
    l1 AS (SELECT project, idx // 64 AS g, sha256(string_agg(CAST(idx AS VARCHAR) || '|' || x, chr(10) ORDER BY idx)) AS d, count(*) AS n FROM e GROUP BY ALL),
    l2 AS (SELECT project, g // 64 AS h, sha256(string_agg(d, chr(10) ORDER BY g)) AS d, sum(n) AS n FROM l1 GROUP BY ALL)
    SELECT project, CAST(sum(n) AS BIGINT) AS entries, sha256(string_agg(d, chr(10) ORDER BY h)) AS digest FROM l2 GROUP BY project""",
)
def _(t):
    return G.bundle_key(t.inventory, t.verdicts, ["project"], chunk=64)


def _approved(t):
    return t.inventory.filter(c("severity") == "CRITICAL").select(c("project").alias("run_id"), "vuln_id")


def _after(t):
    return t.inventory.select("idx", "vuln_id").join(t.verdicts.select("idx", "disposition"), "idx")


FIXED_SQL = """WITH r AS (SELECT i.project AS run_id, i.vuln_id, CASE WHEN v.disposition = 'True Positive' THEN 'still_present' ELSE 'resolved' END AS result
  FROM inventory i JOIN verdicts v USING (idx) WHERE i.severity = 'CRITICAL') """


@query("fix_verification", FIXED_SQL + "SELECT * FROM r")
def _(t):
    return G.fix_verification(_approved(t), _after(t))


@query("fix_verification_summary", FIXED_SQL + "SELECT run_id, count(*) AS approved, bool_and(result = 'resolved') AS all_resolved FROM r GROUP BY run_id")
def _(t):
    return G.fix_verification_summary(_approved(t), _after(t))
