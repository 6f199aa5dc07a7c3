"""Scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import identity as I
from ..functions import paths as P
from ..functions import severity as S
from ..functions import text as T
from ..functions.register import register
from ..operators import dashboard, remedy
from . import duck as D
from .registry import query

c = F.col

# Words of the corpus with signal for the entropy functions.
WORDS_SPARK = r"[A-Za-z0-9_+=/-]{8,}"


def _words(t):
    return t.repo_files.select(
        F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(WORDS_SPARK), F.lit(0)))).alias("word")
    ).distinct()


WORDS = (
    "SELECT DISTINCT word FROM (SELECT unnest(regexp_extract_all(content, '[A-Za-z0-9_+=/-]{8,}')) AS word FROM repo_files)"
)
ENTROPY = (
    "(SELECT word, -sum(n / strlen(word) * log2(n / strlen(word))) AS h FROM "
    "(SELECT word, ch, count(*) AS n FROM (SELECT word, unnest(string_split(word, '')) AS ch FROM words) GROUP BY word, ch) GROUP BY word)"
)


@query("shannon_entropy", f"WITH words AS ({WORDS}) SELECT word, round(h, 6) AS entropy FROM {ENTROPY}")
def _(t):
    return _words(t).select("word", F.round(T.shannon_entropy(c("word")), 6).alias("entropy"))


@query(
    "is_high_entropy",
    f"WITH words AS ({WORDS}) SELECT w.word, strlen(w.word) BETWEEN 16 AND 128 AND h > 3.7 AS high "
    f"FROM words w JOIN {ENTROPY} e ON w.word = e.word",
)
def _(t):
    return _words(t).select("word", T.is_high_entropy(c("word")).alias("high"))


ALL_PATHS = "SELECT DISTINCT file FROM raw_findings UNION SELECT DISTINCT path FROM repo_files"


def _paths(t):
    return t.raw_findings.select("file").union(t.repo_files.select("path")).distinct()


@query("normalize_path", f"SELECT file, {D.normal('file')} AS normal FROM ({ALL_PATHS})")
def _(t):
    return _paths(t).select("file", P.normalize_path(c("file")).alias("normal"))


@query(
    "baseline_fingerprint",
    "SELECT rule_id, file, evidence, left(sha256(rule_id || '|' || file || '|' || evidence), 24) AS fp, count(*) AS n "
    "FROM results GROUP BY ALL",
)
def _(t):
    fp = I.baseline_fingerprint(c("rule_id"), c("file"), c("evidence")).alias("fp")
    return t.results.groupBy("rule_id", "file", "evidence").agg(F.count(F.lit(1)).alias("n")).select(
        "rule_id", "file", "evidence", fp, "n"
    )


@query("finding_fingerprint", f"SELECT {D.fingerprint()} AS fp, count(*) AS n FROM raw_findings GROUP BY 1")
def _(t):
    fp = I.finding_fingerprint(c("rule_id"), c("type"), c("file"), c("line"), c("message"))
    return t.raw_findings.groupBy(fp.alias("fp")).agg(F.count(F.lit(1)).alias("n"))


@query("content_hash", f"SELECT doc_id, sha256({D.strip('text')}) AS hash FROM documents")
def _(t):
    return t.documents.select("doc_id", I.content_hash(c("text")).alias("hash"))


@query(
    "vuln_key",
    "SELECT id, coalesce(file_path, '') || ':' || CAST(line_number AS VARCHAR) || ':' || rule_id AS vuln_key FROM findings",
)
def _(t):
    return t.findings.select("id", I.vuln_key(c("file_path"), c("line_number"), c("rule_id")).alias("vuln_key"))


@query("project_hash", "SELECT project, path, left(sha256(path), 8) AS hash FROM repo_files")
def _(t):
    return t.repo_files.select("project", "path", I.project_hash(c("path")).alias("hash"))


HEALTH_KEY = (
    f"CASE WHEN file = '' AND line = 0 THEN lower(source) || '|' || lower({D.strip('rule_id')}) "
    f"ELSE lower({D.strip('rule_id')}) || '|' || lower(file) || '|' || CAST(line AS VARCHAR) END"
)


@query("health_dedup_key", f"SELECT {HEALTH_KEY} AS dedup_key, count(*) AS n FROM raw_findings GROUP BY 1")
def _(t):
    key = I.health_dedup_key(c("source"), c("rule_id"), c("file"), c("line"))
    return t.raw_findings.groupBy(key.alias("dedup_key")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "severity_maps",
    f"SELECT severity, source, {D.rank('severity')} AS rank, {D.level('severity')} AS level, "
    f"{D.tenths('severity', 'source')} AS tenths, "
    f"CASE WHEN upper({D.strip('severity')}) IN ('CRITICAL','HIGH','ERROR') THEN 'ERROR' WHEN upper({D.strip('severity')}) IN ('MEDIUM','WARNING') THEN 'WARNING' ELSE 'INFO' END AS semgrep, "
    f"{D.case('upper(severity)', {'CRITICAL': '9.0', 'HIGH': '7.0', 'MEDIUM': '5.0', 'LOW': '2.0'}, '5.0')} AS sarif_number, "
    f"{D.case('upper(severity)', {'CRITICAL': 'error', 'HIGH': 'error', 'LOW': 'note'}, 'warning')} AS sarif_level, "
    "count(*) AS n FROM raw_findings GROUP BY ALL",
)
def _(t):
    sev, src = c("severity"), c("source")
    per = t.raw_findings.groupBy("severity", "source").agg(F.count(F.lit(1)).alias("n"))
    return per.select(
        "severity", "source", S.severity_rank(sev).alias("rank"), S.severity_level(sev).alias("level"),
        F.round(S.effective_weight(sev, src) * 10).cast("long").alias("tenths"), S.semgrep_severity(sev).alias("semgrep"),
        S.sarif_number(sev).alias("sarif_number"), S.sarif_level(sev).alias("sarif_level"), "n",
    )


@query("grade", f"SELECT security_score, {D.grade('security_score')} AS grade, count(*) AS n FROM scan_metrics GROUP BY ALL")
def _(t):
    return t.scan_metrics.groupBy("security_score").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "grade", S.grade(c("security_score"))
    )


@query("owasp_category", f"SELECT rule_id, {D.owasp('rule_id')} AS category, count(*) AS n FROM findings GROUP BY ALL")
def _(t):
    return t.findings.groupBy("rule_id").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "category", S.owasp_category(c("rule_id"))
    )


TEXTS = "SELECT doc_id AS id, text FROM documents UNION ALL SELECT event_id AS id, description AS text FROM (SELECT id AS event_id, description FROM findings)"


@query("vuln_class_code", f"SELECT id, {D.vuln_code('text')} AS code FROM ({TEXTS})")
def _(t):
    texts = t.documents.select(c("doc_id").alias("id"), "text").unionByName(
        t.findings.select("id", c("description").alias("text"))
    )
    return texts.select("id", S.vuln_class_code(c("text")).alias("code"))


@query("semantic_class", f"SELECT rule_id, {D.semantic('rule_id')} AS class, count(*) AS n FROM raw_findings GROUP BY ALL")
def _(t):
    return t.raw_findings.groupBy("rule_id").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "class", S.semantic_class(c("rule_id"))
    )


@query(
    "purl",
    "SELECT project, name, version, ecosystem, coalesce('pkg:' || CASE ecosystem WHEN 'go' THEN 'golang' WHEN 'npm' THEN 'npm' "
    "WHEN 'pypi' THEN 'pypi' WHEN 'rubygems' THEN 'gem' WHEN 'cargo' THEN 'cargo' END || '/' || name || '@' || version, '') AS purl FROM deps",
)
def _(t):
    return t.deps.select(
        "project", "name", "version", "ecosystem", I.purl(c("ecosystem"), c("name"), c("version")).alias("purl")
    )


@query(
    "normalize_confidence",
    f"SELECT idx, CASE lower({D.strip('confidence')}) WHEN 'high' THEN 'high' WHEN 'medium' THEN 'medium' WHEN 'med' THEN 'medium' "
    "WHEN 'low' THEN 'low' ELSE '' END AS confidence FROM verdicts",
)
def _(t):
    return t.verdicts.select("idx", S.normalize_confidence(c("confidence")).alias("confidence"))


SCAN_PATHS = (
    "SELECT id, CASE id % 5 WHEN 0 THEN '/host/' || name || '/' WHEN 1 THEN '/project/team/' || name WHEN 2 THEN 'C:\\code\\' || name "
    "WHEN 3 THEN '/host/' ELSE coalesce(scan_path, '/') END AS p FROM engagements"
)


@query(
    "product_name",
    f"""WITH paths AS ({SCAN_PATHS}),
    cut AS (SELECT id, p, CASE WHEN length(p) > 1 THEN left(p, 1) || regexp_replace(substr(p, 2), '[/\\\\]+$', '') ELSE p END AS s FROM paths),
    bare AS (SELECT id, p, CASE WHEN starts_with(s, '/host/') AND length(s) > 6 THEN substr(s, 7)
      WHEN starts_with(s, '/project/') AND length(s) > 9 THEN substr(s, 10) ELSE s END AS s FROM cut)
    SELECT id, p, CASE WHEN regexp_extract(s, '([^/\\\\]*)$', 1) IN ('', '.', 'project', 'host') THEN 'unnamed-project'
      ELSE regexp_extract(s, '([^/\\\\]*)$', 1) END AS name FROM bare""",
)
def _(t):
    k, n = c("id") % 5, c("name")
    p = F.when(k == 0, F.concat(F.lit("/host/"), n, F.lit("/"))).when(
        k == 1, F.concat(F.lit("/project/team/"), n)
    ).when(k == 2, F.concat(F.lit("C:\\code\\"), n)).when(k == 3, "/host/").otherwise(F.coalesce("scan_path", F.lit("/")))
    return t.engagements.select("id", p.alias("p")).withColumn("name", P.product_name(c("p")))


AS_OF = "2024-02-01 00:00:00"


@query(
    "sla_status",
    f"""SELECT id, sla_deadline IS NOT NULL AND TIMESTAMP '{AS_OF}' > sla_deadline AND status NOT IN ('resolved', 'closed') AS over_sla,
    CAST(coalesce(trunc((epoch_us(sla_deadline) - epoch_us(TIMESTAMP '{AS_OF}')) / 86400000000), 0) AS BIGINT) AS days_left FROM findings""",
)
def _(t):
    as_of = F.lit(AS_OF).cast("timestamp_ntz")
    return dashboard.sla_status(t.findings, as_of).select("id", "over_sla", "days_left")


@query(
    "extract_json",
    f"""SELECT conv_id, turn, CASE WHEN regexp_matches(reply, '(?s)```json.*?```') THEN {D.strip("regexp_extract(reply, '(?s)```json(.*?)```', 1)")}
    WHEN regexp_matches(reply, '(?s)```.*?```') THEN {D.strip("regexp_extract(reply, '(?s)```(.*?)```', 1)")}
    WHEN regexp_matches(reply, '[{{\\[]') THEN {D.strip("regexp_extract(reply, '(?s)([{\\[].*)', 1)")} ELSE reply END AS json FROM replies""",
)
def _(t):
    return t.replies.select("conv_id", "turn", T.extract_json(c("reply")).alias("json"))


@query(
    "parse_verdict",
    f"""SELECT conv_id, turn, CASE turn % 5 WHEN 0 THEN 'true_positive' WHEN 1 THEN 'false_positive' ELSE 'needs_review' END AS status,
    CASE turn % 5 WHEN 0 THEN 'turn ' || CAST(conv_id AS VARCHAR) WHEN 1 THEN 'fenced' WHEN 2 THEN 'bare'
      ELSE CASE WHEN length({D.q(T.UNPARSED_PREFIX)} || reply) > 500 THEN left({D.q(T.UNPARSED_PREFIX)} || reply, 500) || '...' ELSE {D.q(T.UNPARSED_PREFIX)} || reply END END AS summary
    FROM replies""",
)
def _(t):
    return t.replies.select("conv_id", "turn", T.parse_verdict(c("reply")).alias("v")).select(
        "conv_id", "turn", "v.status", "v.summary"
    )


@query(
    "display_message",
    "SELECT doc_id, replace(replace(CASE WHEN length(text) > 120 THEN left(text, 117) || '...' ELSE text END, '|', '\\|'), chr(10), ' ') AS message FROM documents",
)
def _(t):
    return t.documents.select("doc_id", T.display_message(c("text")).alias("message"))


@query(
    "rule_category",
    "SELECT rule_id, CASE WHEN instr(rule_id, '-') > 1 THEN string_split(rule_id, '-')[1] ELSE rule_id END AS category, count(*) AS n FROM findings GROUP BY ALL",
)
def _(t):
    return t.findings.groupBy("rule_id").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "category", S.rule_category(c("rule_id"))
    )


_HAY = "lower(rule_id || ' ' || title || ' ' || coalesce(stack, '') || ' ' || description || ' ')"


@query(
    "fix_guidance",
    f"""SELECT id, CASE WHEN regexp_matches({_HAY}, 'gitleaks|secret|password|token|jwt') THEN {D.q(I.GUIDANCE_SECRET)}
    WHEN contains({_HAY}, 'flask') AND contains({_HAY}, 'debug') THEN {D.q(I.GUIDANCE_DEBUG)}
    WHEN regexp_matches({_HAY}, 'ssti|template injection') THEN {D.q(I.GUIDANCE_TEMPLATE)}
    WHEN contains({_HAY}, 'async') AND regexp_matches({_HAY}, 'blocking|sync') THEN {D.q(I.GUIDANCE_ASYNC)}
    ELSE {D.q(I.GUIDANCE_DEFAULT)} END AS guidance FROM findings""",
)
def _(t):
    texts = [c("rule_id"), c("title"), c("stack"), c("description"), F.lit("")]
    return t.findings.select("id", I.fix_guidance(*texts).alias("guidance"))


def _prompt_sql() -> str:
    def text(p: str) -> str:
        head, tail = p.split("%s")
        mid, end = tail.split("%d")
        return f"{D.q(head)} || file || {D.q(mid)} || CAST(line AS VARCHAR) || {D.q(end)}"

    arms = " ".join(f"WHEN {D.q(r)} THEN {text(p)}" for r, p in remedy.FIX_PROMPTS.items())
    return f"CASE rule_id {arms} ELSE {text(remedy.DEFAULT_PROMPT)} END"


@query(
    "fix_prompt",
    f"SELECT idx, rule_id, {_prompt_sql()} AS fix_prompt, CASE severity WHEN 'CRITICAL' THEN 'critical' WHEN 'HIGH' THEN 'high' ELSE 'medium' END AS bucket FROM enriched",
)
def _(t):
    return remedy.fix_plan(t.enriched).select("idx", "rule_id", "fix_prompt", "bucket")


@query(
    "safe_error",
    """SELECT page_id, CASE WHEN length(m) > 200 THEN left(m, 200) || '…' ELSE m END AS error FROM (
    SELECT page_id, regexp_replace(string_split('failed: ' || url || ' at /usr/lib/x/' || CAST(page_id AS VARCHAR) || ': ' || html, chr(10))[1], '(/[^\\s:]+){2,}', '<path>', 'g') AS m FROM pages)""",
)
def _(t):
    text = F.concat(F.lit("failed: "), c("url"), F.lit(" at /usr/lib/x/"), c("page_id").cast("string"), F.lit(": "), c("html"))
    return t.pages.select("page_id", T.safe_error(text).alias("error"))


@query(
    "cache_namespace",
    """SELECT run_id, stage, 'v2:' || sha256('{"schema_version":2,"model":"' || coalesce(nullif(trim(stage), ''), 'default') || '","policy":"default","rules":"' || CAST(run_id AS VARCHAR) || '","block_sources":["a","' || stage || '"]}') AS namespace
    FROM (SELECT DISTINCT run_id, stage FROM usage_rows)""",
)
def _(t):
    keys = t.usage_rows.select("run_id", "stage").distinct()
    ns = I.cache_namespace(
        F.lit(2), {"model": c("stage"), "rules": c("run_id").cast("string"), "policy": F.lit(" ")},
        {"block_sources": F.array(c("stage"), F.lit("a"))},
    )
    return keys.select("run_id", "stage", ns.alias("namespace"))


@query(
    "port_severity",
    f"""SELECT project, path, line, port, {D.case('port', S.PORT_SERVICES, 'unknown')} AS service,
    CASE WHEN port IN (21, 23, 25) THEN 'CRITICAL' WHEN port IN (3306, 5432, 27017, 6379, 11211, 9200, 2181, 9092, 50070, 22, 3389) THEN 'HIGH' ELSE 'INFO' END AS severity
    FROM (SELECT l_orderkey AS project, l_partkey AS path, l_linenumber AS line, CASE l_suppkey % 6 WHEN 0 THEN 21 WHEN 1 THEN 5432 WHEN 2 THEN 80 WHEN 3 THEN 3389
      WHEN 4 THEN 9090 ELSE CAST(1000 + l_partkey % 500 AS INT) END AS port FROM lineitem)""",
)
def _(t):
    k = c("l_suppkey") % 6
    port = F.when(k == 0, 21).when(k == 1, 5432).when(k == 2, 80).when(k == 3, 3389).when(k == 4, 9090).otherwise(
        (1000 + c("l_partkey") % 500).cast("int")
    )
    rows = t.lineitem.select(
        c("l_orderkey").alias("project"), c("l_partkey").alias("path"), c("l_linenumber").alias("line"), port.alias("port")
    )
    return rows.withColumns({"service": S.port_service(c("port")), "severity": S.port_severity(c("port"))})


EDITS_SQL = r"""WITH todo AS (SELECT DISTINCT project, file AS path, rule_id, line FROM enriched),
    rows AS (SELECT t.project, t.path, t.rule_id, u.line, u.text AS b FROM todo t JOIN repo_files f ON t.project = f.project AND t.path = f.path,
      unnest(string_split(f.content, chr(10))) WITH ORDINALITY AS u(text, line)
      WHERE (t.rule_id IN ('ENTR-17', 'ENTROPY-SECRET') AND u.line = t.line AND regexp_matches(t.path, '\.(go|py|ts|js)$'))
         OR (t.rule_id = 'ENTR-18' AND ends_with(t.path, '.py') AND regexp_matches(u.text, '(?i)DEBUG\s*=\s*True'))),
    fixed AS (SELECT project, path, rule_id, line, b,
      CASE WHEN rule_id = 'ENTR-18' THEN regexp_replace(b, '(?i)(DEBUG\s*=\s*)True', '\1os.environ.get("DEBUG", "False") == "True"', 'g')
      WHEN ends_with(path, '.go') AND regexp_matches(b, '(\w+)\s*:?=\s*"[^"]{8,}"')
        THEN regexp_replace(b, '(\w+)\s*:?=\s*"[^"]{8,}"', '\1 = os.Getenv("' || upper(regexp_extract(b, '(\w+)\s*:?=\s*"[^"]{8,}"', 1)) || '")', 'g')
      WHEN ends_with(path, '.py') AND regexp_matches(b, '(\w+)\s*=\s*["''][^"'']{8,}["'']')
        THEN regexp_replace(b, '(\w+)\s*=\s*["''][^"'']{8,}["'']', '\1 = os.environ.get("' || upper(regexp_extract(b, '(\w+)\s*=\s*["''][^"'']{8,}["'']', 1)) || '", "")', 'g')
      WHEN regexp_matches(path, '\.(ts|js)$') AND regexp_matches(b, '(const|let|var)\s+(\w+)\s*=\s*["''][^"'']{8,}["'']')
        THEN regexp_replace(b, '(const|let|var)\s+(\w+)\s*=\s*["''][^"'']{8,}["'']', '\1 \2 = process.env.' || upper(regexp_extract(b, '(const|let|var)\s+(\w+)\s*=\s*["''][^"'']{8,}["'']', 2)), 'g')
      END AS a FROM rows)
    SELECT project, path, rule_id, CAST(line AS INT) AS line, b AS before, a AS after FROM fixed WHERE a IS NOT NULL"""


@query("rule_fix_edit", EDITS_SQL)
def _(t):
    found = t.enriched.select("project", c("file").alias("path"), "rule_id", "line")
    return remedy.suggest_fix(found, t.repo_files)


_SECRET_IDS, _DEBUG_IDS = "('ENTR-17', 'ENTROPY-SECRET')", "('ENTR-18')"


def _by_hand(rules, exts) -> str:
    ids = "rule_id IN (" + ", ".join(D.q(r) for r in rules) + ")"
    return ids + (f" AND {D.ext('path')} IN (" + ", ".join(D.q(e) for e in exts) + ")" if exts else "")


# Some findings lie in a file that is not there, or beyond its end.
_FOUND_SQL = """SELECT DISTINCT project, CASE WHEN idx % 11 = 0 THEN 'gone/' || file ELSE file END AS path,
  CASE idx % 7 WHEN 0 THEN 'ENTR-17' WHEN 1 THEN 'ENTROPY-SECRET' WHEN 2 THEN 'ENTR-18' WHEN 3 THEN 'FAST-CORS' WHEN 4 THEN 'ENTR-02' ELSE rule_id END AS rule_id,
  CASE WHEN idx % 13 = 0 THEN 999999 ELSE line END AS line FROM enriched"""


@query(
    "fix_proposals",
    f"""WITH found AS ({_FOUND_SQL}), edits AS (SELECT * FROM ({EDITS_SQL.replace('SELECT DISTINCT project, file AS path, rule_id, line FROM enriched', _FOUND_SQL)})),
    own AS (SELECT *, rule_id IN {_SECRET_IDS} AS secret, rule_id IN {_DEBUG_IDS} AS debug FROM found),
    j AS (SELECT o.*, e.line AS fix_line, e.before, e.after FROM own o LEFT JOIN (SELECT DISTINCT * FROM edits) e ON e.project = o.project AND e.path = o.path AND e.rule_id = o.rule_id AND (o.debug OR e.line = o.line)),
    n AS (SELECT j.*, len(string_split(f.content, chr(10))) AS lines FROM j LEFT JOIN repo_files f ON f.project = j.project AND f.path = j.path),
    p AS (SELECT *, CASE WHEN after IS NULL AND (secret OR debug) THEN CASE WHEN lines IS NULL THEN 'the file is not there' WHEN secret AND NOT (line BETWEEN 1 AND lines) THEN 'the file has no such line' END END AS problem FROM n)
    SELECT project, path, rule_id, line, CASE WHEN after IS NOT NULL THEN 'rewrite' WHEN problem IS NOT NULL THEN 'failed' ELSE 'manual' END AS kind, fix_line, before, after,
      CASE WHEN after IS NULL THEN coalesce(problem, CASE {' '.join(f'WHEN {_by_hand(r, e)} THEN {D.q(t)}' for r, e, t in remedy.BY_HAND)} ELSE 'Review the finding; no rewrite is known for its rule.' END) END AS advice FROM p""",
)
def _(t):
    k = c("idx")
    rule = F.when(k % 7 == 0, "ENTR-17").when(k % 7 == 1, "ENTROPY-SECRET").when(k % 7 == 2, "ENTR-18").when(k % 7 == 3, "FAST-CORS").when(
        k % 7 == 4, "ENTR-02").otherwise(c("rule_id"))
    path = F.when(k % 11 == 0, F.concat(F.lit("gone/"), "file")).otherwise(c("file"))
    found = t.enriched.select("project", path.alias("path"), rule.alias("rule_id"), F.when(k % 13 == 0, 999999).otherwise(c("line")).alias("line"))
    return remedy.fix_proposals(found, t.repo_files)


@query(
    "register_functions",
    f"""SELECT severity, source, rule_id, {D.rank('severity')} AS rank, {D.semantic('rule_id')} AS class, {D.vuln_code('message')} AS code,
    CASE WHEN instr(rule_id, '-') > 1 THEN string_split(rule_id, '-')[1] ELSE rule_id END AS category, {D.owasp('rule_id')} AS owasp, count(*) AS n
    FROM raw_findings GROUP BY ALL""",
)
def _(t):
    register(t.spark)
    t.raw_findings.createOrReplaceTempView("ambersift_raw_findings")
    return t.spark.sql(
        "SELECT severity, source, rule_id, severity_rank(severity) AS rank, semantic_class(rule_id) AS class,"
        " vuln_class_code(message) AS code, rule_category(rule_id) AS category, owasp_category(rule_id) AS owasp, count(*) AS n"
        " FROM ambersift_raw_findings GROUP BY ALL"
    )
