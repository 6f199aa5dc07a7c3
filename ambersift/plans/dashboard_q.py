"""Dashboard metrics, lists, orders and comparisons."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import compare as X
from ..operators import dashboard as B
from ..operators import timeline as L
from ..operators.paging import Paged, next_page
from ..operators.project_shape import detect_components
from . import duck as D
from .corpus_q import COMPONENTS_SQL
from .registry import query

c = F.col
OPEN = "status NOT IN ('resolved', 'closed', 'risk_accepted', 'false_positive')"
FINDING = ("id", "product_id", "severity", "status")
COLS = ", ".join(FINDING)
ACTIVE = (
    "NOT coalesce(is_false_positive, false) AND lower(trim(coalesce(status, ''))) NOT IN "
    "('resolved', 'closed', 'risk_accepted', 'accepted_risk', 'false_positive')"
)

# ---- predicates -----------------------------------------------------------


@query("open_findings", f"SELECT {COLS} FROM findings WHERE {OPEN}")
def _(t):
    return B.open_findings(t.findings).select(*FINDING)


@query("active_for_summary", f"SELECT {COLS} FROM findings WHERE {ACTIVE}")
def _(t):
    return B.active_for_summary(t.findings).select(*FINDING)


@query(
    "facet_filter",
    f"SELECT {COLS} FROM findings WHERE lower(severity) = 'critical' AND coalesce(nullif(status, ''), 'open') = 'open' AND "
    "(contains(lower(title), 'in') OR contains(lower(description), 'in') OR contains(lower(coalesce(file_path, '')), 'in') OR contains(CAST(id AS VARCHAR), 'IN'))",
)
def _(t):
    return B.facet_filter(t.findings, severity="CRITICAL", status="open", query="IN").select(*FINDING)


@query(
    "min_severity",
    f"SELECT {COLS} FROM findings WHERE severity IN ('CRITICAL', 'HIGH', 'MEDIUM') ORDER BY created_at, id LIMIT 50",
)
def _(t):
    return B.min_severity(t.findings, "medium", 50, [c("created_at"), c("id")]).select(*FINDING)


@query("target_finding", f"SELECT {COLS} FROM findings WHERE rule_id = 'FAST-AUTH' AND line_number = 3")
def _(t):
    return B.target_finding(t.findings, "FAST-AUTH", line=3).select(*FINDING)


@query("entropy_family", f"SELECT {COLS}, rule_id FROM findings WHERE rule_id LIKE 'ENTR-%'")
def _(t):
    return B.entropy_family(t.findings).select(*FINDING, "rule_id")


@query(
    "list_findings",
    "SELECT id, product_id, severity, CASE WHEN status = '' THEN 'open' ELSE status END AS status, created_at FROM findings ORDER BY created_at DESC, id DESC",
)
def _(t):
    return B.list_findings(t.findings).select(*FINDING, "created_at")


@query(
    "visible_triage_rows",
    "SELECT scan_id, rule_id, severity, name, file, CASE WHEN audit_status <> 'OPEN' THEN audit_status ELSE status END AS status FROM audited WHERE audit_status <> 'IGNORED'",
)
def _(t):
    return B.visible_triage_rows(t.audited).select("scan_id", "rule_id", "severity", "name", "file", "status")


@query("deps_filter", "SELECT project, name, version FROM deps WHERE contains(lower(name), 'py') OR contains(lower(type), 'py') OR contains(lower(ecosystem), 'py')")
def _(t):
    return B.deps_filter(t.deps, "py").select("project", "name", "version")


@query(
    "list_audit_log",
    "SELECT id, user_id, entity_type, created_at FROM audit_log WHERE entity_type = 'finding' ORDER BY created_at DESC, id DESC LIMIT 50 OFFSET 25",
)
def _(t):
    return B.list_audit_log(t.audit_log, "finding", 50, 25).select("id", "user_id", "entity_type", "created_at")


@query("unread_notifications", "SELECT id, user_id, title, created_at FROM notifications WHERE NOT is_read")
def _(t):
    return B.unread_notifications(t.notifications, None).select("id", "user_id", "title", "created_at")


# ---- aggregates -----------------------------------------------------------


@query("open_by_severity", f"SELECT severity, count(*) AS n FROM findings WHERE {OPEN} GROUP BY ALL")
def _(t):
    return B.open_by_severity(t.findings)


@query("status_breakdown", "SELECT coalesce(status, 'unknown') AS status, count(*) AS n FROM findings GROUP BY ALL")
def _(t):
    return B.status_breakdown(t.findings)


@query("stack_breakdown", f"SELECT coalesce(stack, 'core') AS stack, count(*) AS n FROM findings WHERE {OPEN} GROUP BY ALL")
def _(t):
    return B.stack_breakdown(t.findings)


@query(
    "top_files",
    f"SELECT file_path, count(*) AS n FROM findings WHERE {OPEN} AND coalesce(file_path, '') <> '' GROUP BY ALL ORDER BY n DESC, file_path LIMIT 8",
)
def _(t):
    return B.top_files(t.findings)


@query(
    "dashboard_kpis",
    f"""SELECT (SELECT count(*) FROM products) AS total_products, (SELECT count(*) FROM engagements WHERE status IN ('in_progress', 'not_started')) AS active_engagements,
    (SELECT count(*) FROM engagements) AS total_engagements, (SELECT count(*) FROM findings WHERE {OPEN}) AS open_findings, (SELECT count(*) FROM findings) AS total_findings,
    (SELECT count(*) FROM findings WHERE status IN ('resolved', 'closed')) AS resolved_findings, (SELECT count(*) FROM findings WHERE sla_breached AND {OPEN}) AS sla_breached""",
)
def _(t):
    return B.dashboard_kpis(t.products, t.engagements, t.findings)


@query(
    "mttr",
    "SELECT severity, round(avg((epoch_us(resolved_at) - epoch_us(created_at)) // 1000000) / 86400, 1) AS mean_days FROM findings WHERE resolved_at IS NOT NULL GROUP BY ALL",
)
def _(t):
    return B.mttr(t.findings)


@query(
    "executive_summary",
    """SELECT 'total' AS dimension, 'all' AS value, count(*) AS n FROM findings UNION ALL SELECT 'severity', severity, count(*) FROM findings GROUP BY severity
    UNION ALL SELECT 'status', status, count(*) FROM findings GROUP BY status""",
)
def _(t):
    return B.executive_summary(t.findings)


def _count(cond: str, name: str) -> str:
    return f"count(*) FILTER (WHERE {cond}) AS {name}"


@query(
    "project_stats",
    "SELECT p.id AS product_id, p.name, count(f.id) AS total, "
    + ", ".join(
        [_count("f.id IS NOT NULL AND coalesce(f.status, '') IN ('', 'open')", "open"), _count("f.status = 'triage'", "triaged"),
         _count("f.status = 'false_positive'", "false_positive"), _count("f.status = 'risk_accepted'", "risk_accepted")]
        + [_count(f"f.severity = '{s}'", s.lower()) for s in B.SEVERITIES]
    )
    + " FROM products p LEFT JOIN findings f ON f.product_id = p.id GROUP BY ALL",
)
def _(t):
    return B.project_stats(t.products, t.findings)


def _groups(by: str, key: str) -> None:
    name = "group_findings" if by == "product" else f"group_findings_{by}"

    @query(name, f"SELECT {key} AS \"group\", count(*) AS n FROM findings f LEFT JOIN products p ON f.product_id = p.id GROUP BY ALL")
    def _(t):
        return B.group_findings(t.findings, by, t.products)


for _by, _key in (
    ("severity", "upper(coalesce(nullif(severity, ''), 'unknown'))"), ("title", "coalesce(nullif(title, ''), 'Untitled')"),
    ("file", "coalesce(nullif(file_path, ''), 'No file')"), ("scanner", "coalesce(nullif(stack, ''), 'core')"),
    ("product", "CASE WHEN coalesce(f.product_id, 0) = 0 THEN 'Unassigned' ELSE coalesce(p.name, 'Project #' || CAST(f.product_id AS VARCHAR)) END"),
):
    _groups(_by, _key)


@query(
    "category_stats",
    f"""SELECT CASE WHEN instr(rule_id, '-') > 1 THEN string_split(rule_id, '-')[1] ELSE rule_id END AS category, count(*) AS n,
    CASE max({D.level('severity')}) WHEN 4 THEN 'CRITICAL' WHEN 3 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' WHEN 1 THEN 'LOW' ELSE '' END AS top_severity FROM findings GROUP BY 1""",
)
def _(t):
    return B.category_stats(t.findings)


@query("owasp_counts", f"SELECT * FROM (SELECT {D.owasp('rule_id')} AS category, count(*) AS n FROM findings GROUP BY ALL) WHERE category <> ''")
def _(t):
    return B.owasp_counts(t.findings)


@query(
    "posture_counts",
    "SELECT product_id, "
    + ", ".join(
        [_count(f"({ACTIVE}) AND severity = '{s}'", f"active_{s.lower()}") for s in B.SEVERITIES]
        + [_count(f"({ACTIVE}) AND severity NOT IN ('CRITICAL', 'HIGH', 'MEDIUM', 'LOW')", "active_other")]
        + [_count(f"NOT ({ACTIVE}) AND severity = '{s}'", f"suppressed_{s.lower()}") for s in B.SEVERITIES]
        + [_count(f"NOT ({ACTIVE}) AND severity NOT IN ('CRITICAL', 'HIGH', 'MEDIUM', 'LOW')", "suppressed_other")]
    )
    + " FROM findings GROUP BY ALL",
)
def _(t):
    return B.posture_counts(t.findings)


@query(
    "triaged_counts",
    "SELECT " + ", ".join(_count(f"status = '{s}'", s) for s in B.TRIAGED)
    + ", count(*) FILTER (WHERE status IN ('triage', 'false_positive', 'risk_accepted')) AS total FROM findings",
)
def _(t):
    return B.triaged_counts(t.findings)


@query(
    "kanban_counts",
    "SELECT CAST(k.i - 1 AS INT) AS place, k.c AS kanban_column, count(f.id) AS n FROM unnest(['backlog', 'todo', 'in_progress', 'review', 'done']) WITH ORDINALITY AS k(c, i) "
    "LEFT JOIN findings f ON f.kanban_column = k.c GROUP BY ALL",
)
def _(t):
    return B.kanban_counts(t.findings)


@query(
    "run_status_counts",
    "SELECT count(*) AS total, count(*) FILTER (WHERE status = 'completed') AS completed, count(*) FILTER (WHERE status IN ('running', 'in_progress')) AS in_progress, "
    "count(*) FILTER (WHERE status = 'failed') AS failed FROM runs",
)
def _(t):
    return B.run_status_counts(t.runs)


@query(
    "resolved_share",
    """WITH s AS (SELECT p.id AS product_id, count(f.id) AS total, count(*) FILTER (WHERE lower(f.status) IN ('resolved', 'closed', 'false_positive', 'risk_accepted')) AS resolved
    FROM products p LEFT JOIN findings f ON f.product_id = p.id GROUP BY ALL)
    SELECT *, total - resolved AS open, CAST(CASE WHEN total > 0 THEN round(resolved / total * 100) ELSE 0 END AS BIGINT) AS resolved_pct FROM s""",
)
def _(t):
    return B.resolved_share(t.findings, t.products)


@query(
    "risky_products",
    f"""SELECT p.id, p.name, count(f.id) AS n, CASE WHEN count(f.id) > 20 THEN 'up' WHEN count(f.id) < 5 THEN 'down' ELSE 'stable' END AS trend
    FROM products p LEFT JOIN findings f ON f.product_id = p.id AND f.{OPEN} GROUP BY p.id, p.name HAVING count(f.id) > 0 ORDER BY n DESC, p.name, p.id LIMIT 5""",
)
def _(t):
    return B.risky_products(t.products, t.findings)


@query(
    "products_for_user",
    "SELECT DISTINCT m.user_id, p.id, p.name FROM members m JOIN products p ON m.product_id = p.id",
)
def _(t):
    return B.visible_products(t.products, t.members)


# ---- top-k and order ------------------------------------------------------


@query(
    "posture_evidence",
    f"""SELECT id, severity, status FROM findings ORDER BY CASE WHEN {OPEN} AND NOT is_false_positive THEN 0 ELSE 1 END,
    CASE severity WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 3 ELSE 4 END, id LIMIT 40""",
)
def _(t):
    return B.posture_evidence(t.findings).select("id", "severity", "status")


@query(
    "recent_engagements",
    "SELECT id, name, status, coalesce(completed_at, started_at) AS day FROM engagements ORDER BY day DESC, id DESC LIMIT 5",
)
def _(t):
    return B.recent_engagements(t.engagements)


@query("paginate", f"SELECT id, severity FROM findings ORDER BY {D.rank('severity')}, id LIMIT 25 OFFSET 50")
def _(t):
    from ..functions.severity import severity_rank

    return B.paginate(t.findings, [severity_rank(c("severity")), c("id")], 2, 25).select("id", "severity")


_DEEP = "FROM findings ORDER BY {} LIMIT 40 OFFSET (SELECT count(*) // 3 * 2 FROM findings)"


@query("paginate_deep", f"SELECT id, severity, title {_DEEP.format(D.rank('severity') + ', id')}")
def _(t):
    from ..functions.severity import severity_rank

    pages = Paged(t.findings, [severity_rank(c("severity")), c("id")])
    return pages.at(pages.rows // 3 * 2, 40).select("id", "severity", "title")


@query(
    "next_page",
    """SELECT f.id, f.status, f.created_at FROM findings f, (SELECT id, created_at FROM findings ORDER BY id LIMIT 1 OFFSET 100) l
    WHERE f.created_at < l.created_at OR (f.created_at = l.created_at AND f.id > l.id) ORDER BY f.created_at DESC, f.id LIMIT 30""",
)
def _(t):
    last = t.findings.select("id", "created_at").orderBy("id").offset(100).first()
    return next_page(t.findings, [("created_at", True), ("id", False)], last.asDict(), 30).select("id", "status", "created_at")


@query(
    "list_audit_log_deep",
    "SELECT id, user_id, entity_type, created_at FROM audit_log WHERE entity_type = 'finding' ORDER BY created_at DESC, id DESC LIMIT 50 OFFSET 400",
)
def _(t):
    return B.list_audit_log(t.audit_log, "finding", 50, 400, shallow=0).select("id", "user_id", "entity_type", "created_at")


@query("sort_findings", f"SELECT id, severity, stack FROM findings ORDER BY {D.level('severity')} DESC, id")
def _(t):
    return B.sort_findings(t.findings, "severity", True).select("id", "severity", "stack")


@query(
    "top_per_product",
    f"""SELECT product_id, id, severity, CAST(row_number() OVER (PARTITION BY product_id ORDER BY least({D.rank('severity')}, 4), id) AS INT) AS place FROM findings
    WHERE coalesce(nullif(status, ''), 'open') = 'open' QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY least({D.rank('severity')}, 4), id) <= 5""",
)
def _(t):
    return B.top_per_product(t.findings).select("product_id", "id", "severity", "place")


@query(
    "latest_per_product",
    "SELECT product_id, id, name, started_at FROM engagements QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY started_at DESC, id DESC) = 1",
)
def _(t):
    return B.latest_per_product(t.engagements).select("product_id", "id", "name", "started_at")


@query("keep_newest", "SELECT id, product_id, started_at FROM engagements ORDER BY started_at DESC, name LIMIT 200")
def _(t):
    return B.keep_newest(t.engagements, "started_at", "name", 200).select("id", "product_id", "started_at")


@query("distinct_stacks", "SELECT DISTINCT stack FROM findings WHERE coalesce(stack, '') <> ''")
def _(t):
    return B.distinct_stacks(t.findings)


@query("products_with_findings", "SELECT id, name FROM products WHERE id IN (SELECT product_id FROM findings)")
def _(t):
    return B.products_with_findings(t.products, t.findings).select("id", "name")


# ---- comparisons ----------------------------------------------------------

_FP = "left(sha256(rule_id || '|' || file || '|' || evidence), 24)"


def _old(t):
    return t.results.filter(c("scan_round") == "F")


def _new(t):
    return t.results.filter(c("scan_round") == "O")


@query(
    "baseline_filter",
    f"""WITH base AS (SELECT DISTINCT {_FP} AS fp FROM results WHERE scan_round = 'F'),
    cur AS (SELECT *, {_FP} AS fp FROM results WHERE scan_round = 'O')
    SELECT scan_id, rule_id, file, fp AS fingerprint, CASE WHEN fp IN (SELECT fp FROM base) THEN 'accepted' ELSE 'new' END AS state FROM cur""",
)
def _(t):
    out = X.split_by_baseline(_new(t), X.make_baseline(_old(t)))
    return out.select("scan_id", "rule_id", "file", "fingerprint", "state")


@query(
    "baseline_new",
    f"SELECT scan_id, rule_id, file FROM results WHERE scan_round = 'O' AND {_FP} NOT IN (SELECT {_FP} FROM results WHERE scan_round = 'F')",
)
def _(t):
    new, _accepted = X.baseline_filter(_new(t), X.make_baseline(_old(t)))
    return new.select("scan_id", "rule_id", "file")


@query(
    "baseline_stats",
    f"""WITH b AS (SELECT scan_round, {_FP} AS fp, rule_id, file, line, severity FROM results QUALIFY row_number() OVER (PARTITION BY scan_round, fp ORDER BY rule_id, file, line, severity) = 1),
    k AS (SELECT scan_round, severity FROM b UNION ALL SELECT scan_round, 'TOTAL' FROM b)
    SELECT severity, count(*) FILTER (WHERE scan_round = 'O') AS now, count(*) FILTER (WHERE scan_round = 'F') AS before, count(*) FILTER (WHERE scan_round = 'O') - count(*) FILTER (WHERE scan_round = 'F') AS delta FROM k GROUP BY ALL""",
)
def _(t):
    return X.baseline_stats(X.make_baseline(_new(t)), X.make_baseline(_old(t)))


_SIDE = "(SELECT rule_id, file, max(row(name, severity)) AS m FROM results WHERE scan_round = '{r}' GROUP BY ALL)"
DIFF_SQL = f"""SELECT coalesce(n.rule_id, o.rule_id) AS rule_id, coalesce(n.file, o.file) AS file, coalesce(n.m, o.m)[1] AS name, coalesce(n.m, o.m)[2] AS severity,
  CASE WHEN o.m IS NULL THEN 'added' ELSE 'fixed' END AS change
  FROM {_SIDE.replace('{r}', 'F')} o FULL JOIN {_SIDE.replace('{r}', 'O')} n ON o.rule_id = n.rule_id AND o.file = n.file WHERE o.m IS NULL OR n.m IS NULL"""


@query("scan_diff", DIFF_SQL)
def _(t):
    return X.scan_diff(_old(t), _new(t), ["rule_id", "file"])


@query(
    "set_compare",
    f"""WITH a AS (SELECT DISTINCT {_FP} AS fingerprint FROM results WHERE scan_round = 'F'), b AS (SELECT DISTINCT {_FP} AS fingerprint FROM results WHERE scan_round = 'O')
    SELECT fingerprint, 'both' AS state FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT fingerprint, 'only_first' FROM (SELECT * FROM a EXCEPT SELECT * FROM b)
    UNION ALL SELECT fingerprint, 'only_second' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""",
)
def _(t):
    return X.set_compare(
        X.with_baseline_fingerprint(_old(t)), X.with_baseline_fingerprint(_new(t)), "fingerprint"
    )


@query(
    "suppress_by_content",
    """WITH i AS (SELECT content_hash, arg_min(reason, id) AS reason FROM ignored GROUP BY content_hash)
    SELECT f.id, CASE i.reason WHEN 'False Positive' THEN 'false_positive' WHEN 'Accepted Risk' THEN 'risk_accepted' WHEN 'Won''t Fix' THEN 'risk_accepted'
      ELSE coalesce(nullif(f.status, ''), 'open') END AS status FROM findings f LEFT JOIN i ON i.content_hash = sha256(trim(f.code_snippet))""",
)
def _(t):
    return X.suppress_by_content(t.findings, t.ignored).select("id", "status")


@query("audit_overlay", "SELECT scan_id, rule_id, file, status, audit_status FROM audited")
def _(t):
    out = X.audit_overlay(t.results, t.audit_entries)
    return out.select("scan_id", "rule_id", "file", "status", "audit_status")


@query(
    "resolve_scan_path",
    """SELECT f.id, coalesce(nullif(e.scan_path, ''), nullif(p.repo_url, ''), CASE WHEN starts_with(f.file_path, '/') THEN regexp_replace(f.file_path, '/[^/]*$', '') END) AS resolved_path
    FROM findings f LEFT JOIN engagements e ON f.engagement_id = e.id LEFT JOIN products p ON f.product_id = p.id""",
)
def _(t):
    return X.resolve_scan_path(t.findings, t.engagements, t.products).select("id", "resolved_path")


_LOC = "trim(regexp_replace(coalesce({x}, ''), '/\\./', '/', 'g'), '/')"


@query(
    "still_present",
    f"""WITH s AS (SELECT id, product_id, rule_id, lower(trim(description)) AS title, {_LOC.replace('{x}', 'file_path')} AS f, coalesce(file_path, '') = '' AS anywhere FROM findings),
    r AS (SELECT DISTINCT l_suppkey AS product_id, CASE l_linenumber WHEN 1 THEN 'core' WHEN 2 THEN 'external' WHEN 3 THEN 'nfr' WHEN 4 THEN 'deploy' WHEN 5 THEN 'network' WHEN 6 THEN 'leak' ELSE 'core' END AS type,
      rr.rule_id, lower(CASE l_linenumber WHEN 2 THEN 'External: ' || rr.message || ' again' WHEN 5 THEN 'redis' ELSE rr.message END) AS title, rr.file FROM rescan_rows rr)
    SELECT DISTINCT s.id, s.product_id FROM s JOIN r ON s.product_id = r.product_id
    WHERE (r.type IN ('nfr') AND (s.rule_id = r.rule_id OR s.title = r.title))
      OR (r.type = 'network' AND (s.rule_id = r.rule_id OR contains(s.title, r.title)))
      OR (r.type = 'deploy' AND s.rule_id = r.rule_id)
      OR ((s.anywhere OR s.f = r.file OR ends_with(s.f, '/' || r.file) OR ends_with(r.file, '/' || s.f)) AND (
        (r.type = 'core' AND (s.rule_id = r.rule_id OR s.title = r.title)) OR (r.type = 'external' AND (s.rule_id = r.rule_id OR contains(r.title, s.title)))
        OR (r.type = 'deploy' AND s.title = r.title) OR (r.type = 'leak' AND starts_with(s.rule_id, 'gitleak-'))))""".replace(
        "rescan_rows rr",
        """(SELECT *, CASE l_partkey % 24 WHEN 0 THEN 'FAST-AUTH' WHEN 4 THEN 'B110' ELSE 'RULE-' || CAST(l_partkey % 24 AS VARCHAR) END AS rule_id,
        CASE l_partkey % 5 WHEN 0 THEN 'Open redirect after login authentication' WHEN 1 THEN 'Path traversal in download' ELSE 'Rule message ' || CAST(l_partkey % 48 AS VARCHAR) END AS message,
        CASE l_partkey % 3 WHEN 0 THEN 'repo/svc' || CAST(l_suppkey AS VARCHAR) || '/file' || CAST(l_partkey % 60 AS VARCHAR) || '.py' ELSE 'file' || CAST(l_partkey % 60 AS VARCHAR) || '.py' END AS file FROM lineitem) rr""",
    ),
)
def _(t):
    k, n = c("l_partkey"), c("l_linenumber")
    rule = F.when(k % 24 == 0, "FAST-AUTH").when(k % 24 == 4, "B110").otherwise(
        F.concat(F.lit("RULE-"), (k % 24).cast("string"))
    )
    text = F.when(k % 5 == 0, "Open redirect after login authentication").when(
        k % 5 == 1, "Path traversal in download"
    ).otherwise(F.concat(F.lit("Rule message "), (k % 48).cast("string")))
    name = F.concat(F.lit("file"), (k % 60).cast("string"), F.lit(".py"))
    file = F.when(
        k % 3 == 0, F.concat(F.lit("repo/svc"), c("l_suppkey").cast("string"), F.lit("/"), name)
    ).otherwise(name)
    kind = F.when(n == 2, "external").when(n == 3, "nfr").when(n == 4, "deploy").when(n == 5, "network").when(
        n == 6, "leak"
    ).otherwise("core")
    title = F.when(n == 2, F.concat(F.lit("External: "), text, F.lit(" again"))).when(n == 5, "redis").otherwise(text)
    rescan = t.lineitem.select(
        c("l_suppkey").alias("product_id"), kind.alias("type"), rule.alias("rule_id"), title.alias("title"),
        file.alias("file"),
    )
    stored = t.findings.select("id", "product_id", "rule_id", c("description").alias("title"), "file_path")
    return X.still_present(stored, rescan, ["product_id"])


@query(
    "component_risk",
    f"""WITH comps AS (SELECT CAST(substr(project, 5) AS BIGINT) AS product_id, component, type FROM ({COMPONENTS_SQL})),
    hits AS (SELECT c.product_id, c.component, max(CASE f.severity WHEN 'CRITICAL' THEN 3 WHEN 'HIGH' THEN 2 WHEN 'MEDIUM' THEN 1 ELSE 0 END) AS lvl
      FROM comps c JOIN findings f ON f.product_id = c.product_id AND (contains(lower(f.title), lower(c.component)) OR contains(lower(f.description), lower(c.component))) GROUP BY ALL)
    SELECT c.product_id, c.component, c.type, CASE coalesce(h.lvl, 0) WHEN 3 THEN 'CRITICAL' WHEN 2 THEN 'HIGH' WHEN 1 THEN 'MEDIUM' ELSE 'LOW' END AS risk FROM comps c LEFT JOIN hits h USING (product_id, component)""",
)
def _(t):
    parts = detect_components(t.repo_files, t.projects).select(
        F.substring("project", 5, 20).cast("long").alias("product_id"), "component", "type"
    )
    return X.component_risk(parts, t.findings)


# ---- keyed table changes --------------------------------------------------


@query(
    "upsert",
    """WITH old AS (SELECT id, name, repo_url AS type, 'LOW' AS risk FROM products), new AS (SELECT l_partkey AS id, max(l_returnflag) AS name, 'node' AS type, max(l_linestatus) AS risk FROM lineitem GROUP BY ALL)
    SELECT coalesce(o.id, n.id) AS id, CASE WHEN n.id IS NOT NULL THEN n.name ELSE o.name END AS name, CASE WHEN o.id IS NULL THEN n.type ELSE o.type END AS type,
      CASE WHEN n.id IS NOT NULL THEN n.risk ELSE o.risk END AS risk FROM old o FULL JOIN new n ON o.id = n.id""",
)
def _(t):
    old = t.products.select("id", "name", c("repo_url").alias("type"), F.lit("LOW").alias("risk"))
    new = t.lineitem.groupBy(c("l_partkey").alias("id")).agg(
        F.max("l_returnflag").alias("name"), F.lit("node").alias("type"), F.max("l_linestatus").alias("risk")
    )
    return X.upsert(old, new, ["id"], ["name", "risk"])


AS_OF = "2024-02-01 00:00:00"


def _at():
    return F.lit(AS_OF).cast("timestamp_ntz")


@query(
    "mark_sla_breach",
    f"SELECT id, sla_breached OR (sla_deadline IS NOT NULL AND {OPEN} AND TIMESTAMP '{AS_OF}' > sla_deadline) AS sla_breached FROM findings",
)
def _(t):
    return X.mark_sla_breach(t.findings, _at()).select("id", "sla_breached")


@query(
    "apply_verification",
    f"""WITH r AS (SELECT DISTINCT o_orderkey AS id, o_orderstatus = 'F' AS fixed, o_orderpriority AS summary FROM orders WHERE o_orderstatus <> 'P')
    SELECT f.id, CASE WHEN r.fixed THEN 'resolved' WHEN NOT r.fixed THEN 'verification_failed' ELSE f.status END AS status,
      CASE WHEN r.fixed THEN 'done' WHEN NOT r.fixed THEN 'in_progress' ELSE f.kanban_column END AS kanban_column, coalesce(r.fixed, f.is_verified) AS is_verified,
      CASE WHEN r.fixed THEN TIMESTAMP '{AS_OF}' WHEN NOT r.fixed THEN NULL ELSE f.verified_at END AS verified_at, CASE WHEN r.fixed THEN TIMESTAMP '{AS_OF}' WHEN NOT r.fixed THEN NULL ELSE f.resolved_at END AS resolved_at,
      CASE WHEN r.fixed THEN 'fixed' WHEN NOT r.fixed THEN 'not_fixed' ELSE f.verification_status END AS verification_status,
      CASE WHEN r.id IS NULL THEN f.verification_summary ELSE r.summary END AS verification_summary
    FROM findings f LEFT JOIN r ON r.id = f.id""",
)
def _(t):
    results = t.orders.filter(c("o_orderstatus") != "P").select(
        c("o_orderkey").alias("id"), (c("o_orderstatus") == "F").alias("fixed"), c("o_orderpriority").alias("summary")
    )
    return X.apply_verification(t.findings, results, _at()).select(
        "id", "status", "kanban_column", "is_verified", "verified_at", "resolved_at", "verification_status",
        "verification_summary",
    )


@query(
    "ingest_findings",
    f"""WITH i AS (SELECT content_hash, arg_min(reason, id) AS reason FROM ignored GROUP BY content_hash)
    SELECT f.id, sha256(trim(f.code_snippet)) AS hash_code, CASE i.reason WHEN 'False Positive' THEN 'false_positive' WHEN 'Accepted Risk' THEN 'risk_accepted' WHEN 'Won''t Fix' THEN 'risk_accepted' ELSE 'open' END AS status,
      'backlog' AS kanban_column, TIMESTAMP '{AS_OF}' AS created_at,
      CASE f.severity WHEN 'CRITICAL' THEN TIMESTAMP '{AS_OF}' + to_days(p.sla_critical) WHEN 'HIGH' THEN TIMESTAMP '{AS_OF}' + to_days(p.sla_high)
        WHEN 'MEDIUM' THEN TIMESTAMP '{AS_OF}' + to_days(p.sla_medium) WHEN 'LOW' THEN TIMESTAMP '{AS_OF}' + to_days(CAST(p.sla_low AS INT)) END AS sla_deadline, false AS sla_breached
    FROM findings f LEFT JOIN i ON i.content_hash = sha256(trim(f.code_snippet)) LEFT JOIN products p ON p.id = f.product_id""",
)
def _(t):
    raw = t.findings.select("id", "product_id", "severity", "code_snippet", F.lit("").alias("status"))
    return X.ingest_findings(raw, t.products, t.ignored, _at()).drop("product_id", "severity", "code_snippet")


@query(
    "purge_cascade",
    """WITH dead AS (SELECT id FROM products WHERE repo_url = ''), de AS (SELECT id FROM engagements WHERE product_id IN (SELECT id FROM dead)),
    df AS (SELECT id FROM findings WHERE engagement_id IN (SELECT id FROM de)), dr AS (SELECT id FROM runs WHERE product_id IN (SELECT id FROM dead))
    SELECT 'products' AS kept, id FROM products WHERE id NOT IN (SELECT id FROM dead) UNION ALL SELECT 'engagements', id FROM engagements WHERE id NOT IN (SELECT id FROM de)
    UNION ALL SELECT 'findings', id FROM findings WHERE id NOT IN (SELECT id FROM df) UNION ALL SELECT 'notes', id FROM notifications WHERE id NOT IN (SELECT id FROM df)
    UNION ALL SELECT 'runs', id FROM runs WHERE id NOT IN (SELECT id FROM dr) UNION ALL SELECT 'artifacts', id FROM engagements WHERE id NOT IN (SELECT id FROM dr)
    UNION ALL SELECT 'members', user_id FROM members WHERE product_id NOT IN (SELECT id FROM dead)""",
)
def _(t):
    tables = {
        "products": t.products.select("id", "repo_url"), "members": t.members,
        "engagements": t.engagements.select("id", "product_id"), "findings": t.findings.select("id", "engagement_id"),
        "notes": t.notifications.select("id", c("id").alias("finding_id")), "runs": t.runs.select("id", "product_id"),
        "artifacts": t.engagements.select("id", c("id").alias("run_id")),
    }
    kept = X.purge_cascade(tables, t.products.filter(c("repo_url") == "").select("id"))
    out = None
    for name, df in kept.items():
        ids = df.select(F.lit(name).alias("kept"), c("user_id" if name == "members" else "id").alias("id"))
        out = ids if out is None else out.unionByName(ids)
    return out


@query(
    "apply_triage",
    """WITH v AS (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'true_positive' WHEN 'O' THEN 'false_positive' ELSE 'needs_review' END AS verdict, o_orderpriority AS summary FROM orders)
    SELECT f.id, CASE v.verdict WHEN 'false_positive' THEN 'false_positive' WHEN 'true_positive' THEN 'triage' ELSE f.status END AS status,
      coalesce(v.verdict = 'false_positive', false) OR f.is_false_positive AS is_false_positive, CASE WHEN v.verdict = 'false_positive' THEN v.summary ELSE f.fp_reason END AS fp_reason,
      CASE WHEN v.id IS NULL THEN f.ai_triage_status ELSE v.verdict END AS ai_triage_status, CASE WHEN v.id IS NULL THEN f.ai_triage_summary ELSE v.summary END AS ai_triage_summary FROM findings f LEFT JOIN v ON v.id = f.id""",
)
def _(t):
    status = c("o_orderstatus")
    verdicts = t.orders.select(
        c("o_orderkey").alias("id"),
        F.when(status == "F", "true_positive").when(status == "O", "false_positive").otherwise("needs_review").alias("verdict"),
        c("o_orderpriority").alias("summary"),
    )
    return X.apply_triage(t.findings, verdicts).select(
        "id", "status", "is_false_positive", "fp_reason", "ai_triage_status", "ai_triage_summary"
    )


# ---- history --------------------------------------------------------------


@query(
    "telemetry_totals",
    "SELECT project, count(*) AS scans, CAST(sum(files_scanned) AS BIGINT) AS files, CAST(sum(findings_total) AS BIGINT) AS findings, round(avg(security_score), 6) AS mean_score FROM scan_metrics GROUP BY ALL",
)
def _(t):
    return L.telemetry_totals(t.scan_metrics)


@query(
    "running_mean_score",
    "SELECT scan_id, project, round(avg(security_score) OVER (PARTITION BY project ORDER BY scanned_at, scan_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS mean_score FROM scan_metrics",
)
def _(t):
    return L.running_mean_score(t.scan_metrics).select("scan_id", "project", "mean_score")


@query(
    "last_n_scans",
    "SELECT scan_id, project, CAST(row_number() OVER (PARTITION BY project ORDER BY scanned_at DESC, scan_id DESC) AS INT) AS age FROM scan_metrics "
    "QUALIFY row_number() OVER (PARTITION BY project ORDER BY scanned_at DESC, scan_id DESC) <= 20",
)
def _(t):
    return L.last_n_scans(t.scan_metrics, 20).select("scan_id", "project", "age")


@query(
    "score_trend",
    """WITH r AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY scanned_at DESC, scan_id DESC) AS n FROM scan_metrics),
    a AS (SELECT project, sum(security_score) FILTER (WHERE n <= 5) AS rs, count(*) FILTER (WHERE n <= 5) AS rn, sum(security_score) FILTER (WHERE n BETWEEN 6 AND 10) AS ps, count(*) FILTER (WHERE n BETWEEN 6 AND 10) AS pn FROM r GROUP BY ALL)
    SELECT project, CAST(CASE WHEN pn > 0 THEN rs // rn - ps // pn ELSE 0 END AS BIGINT) AS trend FROM a""",
)
def _(t):
    return L.score_trend(t.scan_metrics)


@query(
    "llm_usage",
    """SELECT *, greatest(total_tokens - prompt_tokens - completion_tokens, 0) AS other_tokens FROM (SELECT run_id, stage, CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens, CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens,
    CAST(sum(total_tokens) AS BIGINT) AS total_tokens FROM usage_rows GROUP BY ALL) WHERE total_tokens <> 0 OR prompt_tokens <> 0 OR completion_tokens <> 0""",
)
def _(t):
    return L.llm_usage(t.usage_rows)


@query(
    "scanner_coverage",
    """WITH req AS (SELECT unnest(['semgrep', 'trivy', 'gitleaks', 'bandit']) AS scanner, unnest([1, 2, 3, 4]) AS i),
    miss AS (SELECT s.scan_id, r.scanner, r.i FROM (SELECT DISTINCT scan_id FROM executions) s CROSS JOIN req r
      WHERE NOT EXISTS (SELECT 1 FROM executions e WHERE e.scan_id = s.scan_id AND e.scanner = r.scanner AND e.status IN ('completed', 'not_applicable')))
    SELECT s.scan_id, count(m.scanner) AS missing, coalesce(string_agg(m.scanner, ',' ORDER BY m.i), '') AS missing_scanners, CASE WHEN count(m.scanner) = 0 THEN 'full' ELSE 'partial' END AS coverage
    FROM (SELECT DISTINCT scan_id FROM executions) s LEFT JOIN miss m ON m.scan_id = s.scan_id GROUP BY s.scan_id""",
)
def _(t):
    return L.scanner_coverage(t.executions, ["semgrep", "trivy", "gitleaks", "bandit"])


GIT_SQL = """SELECT project, file_path, count(DISTINCT commit_id) AS commits, count(DISTINCT author_email) AS authors, CAST(sum(additions) AS BIGINT) AS additions, CAST(sum(additions + deletions) AS BIGINT) AS lines_changed,
  max(committed_at) AS last_modified, CASE WHEN sum(additions) / count(DISTINCT commit_id) > 500 THEN 0.8::DOUBLE WHEN sum(additions) / count(DISTINCT commit_id) > 200 THEN 0.4::DOUBLE ELSE 0.0::DOUBLE END AS agentic_score FROM git_numstat GROUP BY ALL"""


@query("git_file_stats", GIT_SQL)
def _(t):
    return L.git_file_stats(t.git_numstat, ["project"])


@query("high_churn", f"SELECT * FROM ({GIT_SQL}) WHERE commits >= 3 AND authors <= 1 AND lines_changed > 1000")
def _(t):
    return L.high_churn(t.git_numstat, ["project"], commits=3)


@query(
    "tree_fingerprint",
    """WITH e AS (SELECT project, sha256(path) AS h, path || '|' || sha256(content) AS v FROM repo_files),
    a AS (SELECT project, left(h, 4) AS g, sha256(string_agg(v, chr(10) ORDER BY h, v)) AS d, count(*) AS n FROM e GROUP BY ALL),
    b AS (SELECT project, left(g, 2) AS g2, sha256(string_agg(d, chr(10) ORDER BY g)) AS d, sum(n) AS n FROM a GROUP BY ALL)
    SELECT project, CAST(sum(n) AS BIGINT) AS files, sha256(string_agg(d, chr(10) ORDER BY g2)) AS digest FROM b GROUP BY project""",
)
def _(t):
    return L.tree_fingerprint(t.repo_files)


_DEP_ENDS = "n AS (SELECT project, parent AS node, 1 AS o, 0 AS i FROM dep_edges UNION ALL SELECT project, child, 0, 1 FROM dep_edges)"


@query(
    "dep_nodes",
    f"""WITH {_DEP_ENDS}
    SELECT project, node, CAST(sum(o) AS BIGINT) AS direct, CAST(sum(i) AS BIGINT) AS reverse, sum(i) = 0 AS is_root, sum(o) = 0 AS is_leaf FROM n GROUP BY ALL""",
)
def _(t):
    return L.dep_nodes(t.dep_edges, ["project"])


@query(
    "dep_graph_stats",
    f"""WITH {_DEP_ENDS}, d AS (SELECT project, node, sum(o) AS o, sum(i) AS i FROM n GROUP BY ALL)
    SELECT project, count(*) AS nodes, CAST(sum(o) AS BIGINT) AS edges, count(*) FILTER (WHERE i = 0) AS roots, count(*) FILTER (WHERE o = 0) AS leaves, CAST(max(o) AS BIGINT) AS max_direct,
      CAST(max(i) AS BIGINT) AS max_reverse FROM d GROUP BY project""",
)
def _(t):
    return L.dep_graph_stats(t.dep_edges, ["project"])


# The walk of the SQL goes round in cycles until its bound, which lies beyond any depth here.
@query(
    "dep_closure",
    """WITH RECURSIVE walk AS (SELECT DISTINCT project, parent AS node, 0 AS depth FROM dep_edges d WHERE NOT EXISTS (SELECT 1 FROM dep_edges c WHERE c.project = d.project AND c.child = d.parent)
      UNION SELECT e.project, e.child, w.depth + 1 FROM walk w JOIN dep_edges e ON e.project = w.project AND e.parent = w.node WHERE w.depth < 60)
    SELECT project, node, min(depth) AS depth FROM walk GROUP BY project, node""",
)
def _(t):
    edges = t.dep_edges
    return L.dep_closure(edges, L.dep_roots(edges, ["project"]), ["project"])
