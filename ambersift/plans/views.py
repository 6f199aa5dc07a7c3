"""Security tables derived from the fixture tables, in SQL both engines run unchanged.

Every view covers the whole of its source tables, so its size grows with them.
``{sha}`` stands for the engine's SHA-256 function."""

from __future__ import annotations

import re

BASE = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
)


def _lines(*parts: str) -> str:
    return " || chr(10) || ".join(parts)


def rule_case(n: str) -> str:
    """A rule id for an integer expression; some ids have a meaning to the merge and the reports."""
    names = (
        "FAST-AUTH", "NFR-API-003", "FAST-CORS", "NFR-API-002", "B110", "FAST-LAZY-EXC", "ENTROPY-SECRET",
        "ENTR-FRAGILE", "ENTR-04", "missing_lockfile", "NFR-ENV-002", "ENTR-18", "FAST-RATELIMIT", "NFR-API-001",
    )
    arms = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(names))
    return f"CASE {n} % 24 {arms} ELSE 'RULE-' || CAST({n} % 24 AS STRING) END"


def message_case(n: str) -> str:
    texts = (
        "SQL injection in query builder", "Hardcoded secret in source", "Cross-site scripting (xss) in view",
        "JWT session cookie without flag", "Path traversal in download", "Debug mode enabled",
        "Open redirect after login authentication", "Rate limiting missing", "Swallowed exception, no logging",
        "Server-side request forgery", "CORS misconfiguration", "Uses PostgreSQL without TLS CVE-2024-1234",
        "Weak cryptography (md5)", "Race condition in cache, see Redis notes", "Blocking sync call in async handler",
    )
    arms = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(texts))
    return f"CASE {n} % 16 {arms} ELSE 'Rule message ' || CAST({n} % 48 AS STRING) END"


SEVERITY_BY_TYPE = (
    "CASE event_type WHEN 'error' THEN 'CRITICAL' WHEN 'purchase' THEN 'HIGH' WHEN 'signup' THEN 'MEDIUM' "
    "WHEN 'click' THEN 'LOW' ELSE 'INFO' END"
)

_K = "CAST(o_orderkey AS STRING)"
_MD5 = f"md5({_K})"
CODE_TEXT = _lines(
    "CASE o_orderkey % 29 WHEN 0 THEN '# scan-ignore-file' ELSE 'import os' END",
    f"""CASE o_orderkey % 4 WHEN 0 THEN 'api_key = "' || {_MD5} || '"' WHEN 1 THEN 'password = "changeme123"' """
    f"""WHEN 2 THEN 'const token = "' || {_MD5} || substr({_MD5}, 1, 8) || '"' ELSE 'def handler(request):' END""",
    "CASE o_orderkey % 5 WHEN 0 THEN 'print(api_key)' WHEN 1 THEN 'console.log(password)' "
    "WHEN 2 THEN 'log_info( token )' ELSE '    value = request.args' END",
    "CASE o_orderkey % 7 WHEN 0 THEN 'DEBUG = True' WHEN 1 THEN 'app.run(host=\"0.0.0.0\", debug=True)' "
    "WHEN 2 THEN '# TODO fixme placeholder temporary result1 var2 tempVar' "
    "WHEN 3 THEN 'eval(request.data)  # scan-ignore: T-EVAL reviewed' "
    "WHEN 4 THEN '// scan:ignore all' ELSE 'x = 1 # plain' END",
    "CASE o_orderkey % 3 WHEN 0 THEN 'eval(user_input)' WHEN 1 THEN 'y = \"eval(quoted)\" /* eval(hidden) */' "
    "ELSE 'z = 2' END",
    f"CASE o_orderkey % 11 WHEN 0 THEN 'key: AKIA' || upper(substr({_MD5}, 1, 16)) "
    f"WHEN 1 THEN 'sk_live_' || {_MD5} WHEN 2 THEN '-----BEGIN RSA PRIVATE KEY-----' "
    f"WHEN 3 THEN 'ghp_' || {_MD5} || {_MD5} ELSE '' END",
    "CASE o_orderkey % 6 WHEN 0 THEN 'app.get(\"/items\", handler)' WHEN 1 THEN 'app = FastAPI()' "
    "WHEN 2 THEN 'limiter = rate_limit(10)' WHEN 3 THEN 'os.environ[\"HOME\"]' "
    "WHEN 4 THEN 'url = \"http://api.' || lower(substr(o_orderpriority, 3, 4)) || '.example.com:8080/v1\"' "
    "ELSE 'from middleware import auth_jwt' END",
    "CASE o_orderkey % 13 WHEN 0 THEN repeat('filler text without keywords; ', 90) WHEN 1 THEN 'try: err' "
    "ELSE '\"\"\"block' || chr(10) || 'of docs\"\"\"' END",
    "'total = ' || CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING)",
)
CODE_PATH = (
    f"CASE o_orderkey % 9 WHEN 0 THEN 'src/auth' || {_K} || '.py' WHEN 1 THEN 'src/h' || {_K} || '.go' "
    f"WHEN 2 THEN 'src/session_' || {_K} || '.js' WHEN 3 THEN 'tests/h' || {_K} || '.py' "
    f"WHEN 4 THEN 'svc' || {_K} || '/app.py' WHEN 5 THEN 'web/node_modules/x' || {_K} || '.js' "
    f"WHEN 6 THEN 'config/c' || {_K} || '.yaml' WHEN 7 THEN 'src/view' || {_K} || '.ts' "
    f"ELSE 'docs/r' || {_K} || '.md' END"
)

_C = "CAST(c_custkey AS STRING)"


def _project_file(path: str, content: str) -> tuple[str, str]:
    return path, content


_PROJECT_PARTS = (
    _project_file(
        "CASE c_mktsegment WHEN 'BUILDING' THEN 'package.json' WHEN 'MACHINERY' THEN 'web/package.json' "
        "WHEN 'HOUSEHOLD' THEN 'tests/package.json' ELSE 'notes/package.txt' END",
        "CASE c_nationkey % 4 "
        "WHEN 0 THEN '{\"name\":\"a\",\"dependencies\":{\"next\":\"14\",\"react\":\"18\"},\"devDependencies\":{\"vite\":\"5\"}}' "
        "WHEN 1 THEN '{\"dependencies\":{\"express\":\"4\",\"react\":\"18\"}}' "
        "WHEN 2 THEN '{\"dependencies\":{\"lodash\":\"4\"},\"devDependencies\":{\"tailwindcss\":\"3\"}}' "
        "ELSE '{\"name\":' END",
    ),
    _project_file(
        "CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'requirements.txt' WHEN 'FURNITURE' THEN 'requirements/base.txt' "
        "ELSE 'notes/requirements.md' END",
        "CASE c_nationkey % 4 WHEN 0 THEN 'fastapi==0.1' WHEN 1 THEN 'Django>=4' WHEN 2 THEN 'flask' ELSE 'numpy' END",
    ),
    _project_file(
        "CASE c_nationkey % 5 WHEN 0 THEN 'go.mod' WHEN 1 THEN 'cmd/tool/main.go' ELSE 'notes/mod.md' END",
        "'module example.com/m' || " + _C,
    ),
    _project_file(
        "CASE WHEN c_acctbal > 5000 THEN 'Dockerfile' WHEN c_acctbal > 0 THEN 'docker/app.dockerfile' "
        "ELSE 'notes/docker.md' END",
        _lines(
            "'FROM python:latest'",
            "CASE c_nationkey % 3 WHEN 0 THEN 'ADD . /app' WHEN 1 THEN 'ADD app.tar /app' ELSE 'COPY . /app' END",
            "CASE c_nationkey % 4 WHEN 0 THEN 'ENV DB_PASSWORD=hunter2hunter2hunter2 MORE=1234567890123456789012345' "
            "ELSE 'ENV MODE=prod' END",
            "CASE c_nationkey % 2 WHEN 0 THEN '  USER root' ELSE 'USER app' END",
        ),
    ),
    _project_file(
        "CASE WHEN c_nationkey % 4 = 3 THEN 'notes/compose.md' ELSE 'docker-compose.yml' END",
        _lines(
            "'services:'",
            "'  db:'",
            "CASE c_custkey % 4 WHEN 0 THEN '    image: postgres:15' WHEN 1 THEN '    image: mariadb' "
            "WHEN 2 THEN '    image: mongo' ELSE '    image: busybox' END",
            "'    ports:'",
            "CASE c_custkey % 5 WHEN 0 THEN '      - \"5432:5432\"' WHEN 1 THEN '      - 127.0.0.1:6379:6379' "
            "WHEN 2 THEN '      - \"8080\"' WHEN 3 THEN '      - 21:21/tcp' ELSE '      - \"9999:80\"' END",
            "CASE c_custkey % 3 WHEN 0 THEN '    POSTGRES_PASSWORD: plain-text' "
            "WHEN 1 THEN '    DB_SECRET: \"' || '$' || '{DB_SECRET}\"' ELSE '    restart: always' END",
            "CASE c_custkey % 7 WHEN 0 THEN '    privileged: true' ELSE '    privileged: false' END",
            "CASE c_custkey % 6 WHEN 0 THEN '  cache: redis' WHEN 1 THEN '  proxy: nginx' WHEN 2 THEN '  bus: kafka' "
            "WHEN 3 THEN '  store: minio' ELSE '  worker: app' END",
        ),
    ),
    _project_file(
        "CASE WHEN c_nationkey % 6 = 0 THEN 'notes/nginx.md' WHEN c_nationkey % 6 = 1 THEN 'etc/site.conf' "
        "ELSE 'nginx.conf' END",
        _lines(
            "CASE c_custkey % 4 WHEN 0 THEN 'user root;' WHEN 1 THEN 'User ROOT staff;' ELSE 'user www-data;' END",
            "CASE c_custkey % 3 WHEN 0 THEN '  server_tokens on;' WHEN 1 THEN '  server_tokens off;' ELSE '' END",
            "CASE c_custkey % 5 WHEN 0 THEN 'add_header X-Frame-Options DENY;' ELSE '# none' END",
            "CASE c_custkey % 7 WHEN 0 THEN 'add_header Content-Security-Policy \"default-src\";' "
            "ELSE 'proxy_pass http://backend.local:3000;' END",
        ),
    ),
    _project_file(
        "CASE WHEN c_nationkey % 3 = 0 THEN 'Makefile' ELSE 'notes/make.md' END",
        _lines(
            "'all: build'",
            "CASE c_custkey % 3 WHEN 0 THEN 'DB_PASSWORD=s3cret-value' "
            "WHEN 1 THEN 'TOKEN=' || '$' || '(shell cat token)' ELSE 'OUT=bin' END",
        ),
    ),
    _project_file(
        "CASE WHEN c_nationkey % 5 = 4 THEN 'notes/k8s.md' ELSE 'deploy/app.yaml' END",
        _lines(
            "CASE c_custkey % 5 WHEN 0 THEN 'settings: none' ELSE 'apiVersion: v1' END",
            "CASE c_custkey % 5 WHEN 0 THEN 'values: []' ELSE 'kind: Pod' END",
            "'spec:'",
            "CASE c_custkey % 3 WHEN 0 THEN '    privileged: True' ELSE '    privileged: false' END",
            "CASE c_custkey % 4 WHEN 0 THEN '    runAsUser: 0' ELSE '    runAsUser: 1000' END",
            "'    host: db.internal.local'",
        ),
    ),
    _project_file(
        "CASE c_custkey % 3 WHEN 0 THEN '.env' WHEN 1 THEN '.env.example' ELSE 'notes/env.md' END",
        "'API_TOKEN=\"' || md5(" + _C + ") || '\"' || chr(10) || 'addr=localhost'",
    ),
    _project_file(
        "CASE c_custkey % 4 WHEN 0 THEN 'server.js' WHEN 1 THEN 'web/server.js' WHEN 2 THEN 'src/main.tsx' "
        "ELSE 'app/api/route.ts' END",
        "CASE c_custkey % 3 WHEN 0 THEN 'const e = require(\"express\");' WHEN 1 THEN 'import e from \"express\"' "
        "ELSE 'let a = 1' END",
    ),
    _project_file(
        "CASE c_custkey % 5 WHEN 0 THEN 'package-lock.json' WHEN 1 THEN 'poetry.lock' "
        "WHEN 2 THEN 'web/middleware.ts' WHEN 3 THEN 'App/App.csproj' ELSE 'notes/lock.md' END",
        "CASE c_custkey % 2 WHEN 0 THEN '<Project Sdk=\"Microsoft.NET.Sdk.Web\">' ELSE '<!-- generated-report -->' END",
    ),
)
PROJECT_FILES = "\nUNION ALL\n".join(
    f"SELECT 'proj' || {_C} AS project, {path} AS path, {content} AS content FROM customer" for path, content in _PROJECT_PARTS
)
# The same rows from one reading of the customers.
PROJECT_FILES_STACKED = (
    f"SELECT 'proj' || {_C} AS project, stack({len(_PROJECT_PARTS)}, "
    + ", ".join(f"{path}, {content}" for path, content in _PROJECT_PARTS) + ") AS (path, content) FROM customer"
)

_FILE_KEY = "(event_id - event_id % 3)"

DERIVED: dict[str, str] = {
    "findings": f"""
SELECT event_id AS id, user_id * 7 + event_id % 7 AS engagement_id, user_id AS product_id,
  {rule_case('event_id')} AS rule_id, 'Finding ' || CAST(event_id % 40 AS STRING) AS title, {SEVERITY_BY_TYPE} AS severity,
  CASE WHEN event_id % 17 = 0 THEN NULL WHEN event_id % 17 = 1 THEN '/abs/svc/file' || CAST(event_id % 60 AS STRING) || '.py'
       ELSE 'svc' || CAST(user_id AS STRING) || '/file' || CAST(event_id % 60 AS STRING) || '.py' END AS file_path,
  CAST(floor(value) AS INT) AS line_number,
  'snippet ' || CAST(event_id % 2500 AS STRING) AS code_snippet,
  {message_case('event_id')} AS description,
  'h' || CAST(event_id % 50 AS STRING) AS hash_code,
  CASE event_id % 9 WHEN 0 THEN 'resolved' WHEN 1 THEN 'closed' WHEN 2 THEN 'risk_accepted'
       WHEN 3 THEN 'false_positive' WHEN 4 THEN 'triage' WHEN 5 THEN 'in_progress' WHEN 6 THEN '' ELSE 'open' END AS status,
  CASE event_id % 4 WHEN 0 THEN 'backlog' WHEN 1 THEN 'todo' WHEN 2 THEN 'in_progress' ELSE 'done' END AS kanban_column,
  CASE user_id % 6 WHEN 0 THEN 'semgrep' WHEN 1 THEN 'trivy' WHEN 2 THEN 'gitleaks' WHEN 3 THEN 'bandit'
       WHEN 4 THEN 'nfr' ELSE NULL END AS stack,
  event_id % 9 = 3 AS is_false_positive, event_id % 10 = 0 AS sla_breached, ts AS created_at,
  CASE event_type WHEN 'error' THEN ts + INTERVAL 1 DAY WHEN 'purchase' THEN ts + INTERVAL 7 DAY
       WHEN 'signup' THEN ts + INTERVAL 30 DAY WHEN 'click' THEN ts + INTERVAL 90 DAY ELSE NULL END AS sla_deadline,
  CASE event_id % 9 WHEN 0 THEN ts + INTERVAL 3 DAY WHEN 1 THEN ts + INTERVAL 12 DAY ELSE NULL END AS resolved_at,
  event_id % 9 = 0 AND event_id % 2 = 0 AS is_verified, CASE WHEN event_id % 18 = 0 THEN ts + INTERVAL 4 DAY END AS verified_at,
  CASE event_id % 18 WHEN 0 THEN 'fixed' WHEN 5 THEN 'not_fixed' END AS verification_status,
  CASE WHEN event_id % 18 IN (0, 5) THEN 'checked ' || CAST(event_id % 7 AS STRING) END AS verification_summary,
  CASE WHEN event_id % 9 = 3 THEN 'reason ' || CAST(event_id % 5 AS STRING) END AS fp_reason,
  CASE event_id % 9 WHEN 3 THEN 'false_positive' WHEN 4 THEN 'true_positive' END AS ai_triage_status,
  CASE WHEN event_id % 9 IN (3, 4) THEN 'earlier verdict ' || CAST(event_id % 11 AS STRING) END AS ai_triage_summary
FROM events""",
    "raw_findings": f"""
SELECT l_orderkey AS scan_id, l_suppkey AS product_id, 'proj' || CAST(l_suppkey AS STRING) AS project,
  CASE l_linenumber % 5 WHEN 0 THEN 'core' WHEN 1 THEN 'external' WHEN 2 THEN 'nfr' WHEN 3 THEN 'deploy' ELSE 'network' END AS type,
  CASE l_linenumber % 5 WHEN 1 THEN CASE l_partkey % 4 WHEN 0 THEN 'semgrep' WHEN 1 THEN 'trivy' WHEN 2 THEN 'gitleaks' ELSE 'bandit' END
       WHEN 2 THEN 'nfr' WHEN 3 THEN 'deploy' WHEN 4 THEN 'network' ELSE 'core' END AS source,
  {rule_case('l_partkey')} AS rule_id,
  CASE l_linenumber WHEN 1 THEN 'CRITICAL' WHEN 2 THEN 'HIGH' WHEN 3 THEN 'MEDIUM' WHEN 4 THEN 'LOW' WHEN 5 THEN 'INFO'
       WHEN 6 THEN 'high ' ELSE '' END AS severity,
  CASE WHEN l_linenumber % 5 IN (2, 4) AND l_partkey % 2 = 0 THEN ''
       ELSE '/src/svc' || CAST(l_suppkey % 20 AS STRING) || '/./F' || CAST(l_partkey % 3 AS STRING) || '.py' END AS file,
  CASE WHEN l_linenumber % 5 IN (2, 4) AND l_partkey % 2 = 0 THEN 0 ELSE CAST(floor(l_quantity / 10) AS INT) END AS line,
  {message_case('l_partkey')} AS message, l_returnflag = 'R' AS ignored, l_linestatus AS scan_round
FROM lineitem""",
    "results": f"""
SELECT l_orderkey AS scan_id, 'proj' || CAST(l_suppkey AS STRING) AS project, {rule_case('l_partkey')} AS rule_id,
  {message_case('l_partkey')} AS name, CASE l_returnflag WHEN 'N' THEN 'PRESENT' ELSE 'ABSENT' END AS status,
  CASE l_linenumber WHEN 1 THEN 'CRITICAL' WHEN 2 THEN 'HIGH' WHEN 3 THEN 'MEDIUM' WHEN 4 THEN 'LOW' ELSE 'INFO' END AS severity,
  CASE WHEN l_linenumber = 7 THEN '' ELSE '/svc' || CAST(l_suppkey % 20 AS STRING) || '/f' || CAST(l_partkey AS STRING) || '.py' END AS file,
  CASE WHEN l_linenumber >= 6 THEN 0 ELSE CAST(floor(l_quantity / 10) AS INT) END AS line,
  'seen in ' || CAST(l_partkey % 12 AS STRING) AS evidence, 'Fix step ' || CAST(l_partkey % 9 AS STRING) AS suggestion,
  l_linestatus AS scan_round
FROM lineitem""",
    "audit_entries": """
SELECT DISTINCT rule_id, file, CASE (length(rule_id) + length(file)) % 4 WHEN 0 THEN 'IGNORED' WHEN 1 THEN 'TRIAGE' ELSE 'OPEN' END AS status
FROM results WHERE status = 'ABSENT' AND file <> ''""",
    "audited": """
SELECT r.*, coalesce(a.status, 'OPEN') AS audit_status
FROM results r LEFT JOIN audit_entries a ON r.rule_id = a.rule_id AND r.file = a.file""",
    "products": """
SELECT c_custkey AS id, c_name AS name,
  CASE c_nationkey % 3 WHEN 0 THEN '' ELSE 'repo/' || CAST(c_custkey AS STRING) END AS repo_url,
  1 AS sla_critical, 7 AS sla_high, 30 AS sla_medium, 60 + c_nationkey AS sla_low
FROM customer""",
    "projects": "SELECT 'proj' || CAST(c_custkey AS STRING) AS project FROM customer",
    "members": """
SELECT DISTINCT l_partkey AS product_id, l_suppkey AS user_id FROM lineitem""",
    "engagements": """
SELECT o_orderkey AS id, o_custkey AS product_id, 'scan-' || CAST(o_orderkey AS STRING) AS name,
  CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'in_progress' ELSE 'not_started' END AS status,
  CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE '/scans/' || CAST(o_orderkey AS STRING) END AS scan_path,
  o_orderdate AS started_at,
  CASE WHEN o_orderstatus = 'F' THEN o_orderdate + INTERVAL 2 DAY ELSE NULL END AS completed_at
FROM orders""",
    "git_numstat": """
SELECT 'proj' || CAST(o_custkey % 5 AS STRING) AS project, o_orderkey AS commit_id,
  CASE WHEN l_partkey % 5 = 0 THEN 'solo@x.io' ELSE 'dev' || CAST(o_custkey % 7 AS STRING) || '@x.io' END AS author_email,
  o_orderdate AS committed_at,
  'svc' || CAST(l_partkey % 20 AS STRING) || '/' || CASE l_partkey % 8 WHEN 0 THEN 'Auth' WHEN 1 THEN '.env' WHEN 2 THEN 'server'
     WHEN 3 THEN 'session' ELSE 'file' END || CASE WHEN l_partkey % 16 = 1 THEN '' ELSE CAST(l_partkey AS STRING) END
     || CASE l_partkey % 8 WHEN 2 THEN '.pem' ELSE '' END AS file_path,
  CAST(floor(l_quantity) AS BIGINT) * 20 AS additions, CAST(floor(l_extendedprice) AS BIGINT) % 50 AS deletions
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "git_lines": f"""
SELECT 'proj' || CAST(o_custkey AS STRING) AS project, 'svc' || CAST(o_custkey AS STRING) || '/conf.py' AS path, {CODE_TEXT} AS content,
  substr({_MD5}, 1, 8) AS commit_id, o_orderdate AS committed_at, 'dev' || CAST(o_custkey % 7 AS STRING) || '@x.io' AS author
FROM orders""",
    "dep_edges": """
SELECT DISTINCT 'proj' || CAST(l_suppkey % 3 AS STRING) AS project, 'pkg' || CAST(l_partkey AS STRING) AS parent,
  'pkg' || CAST(CASE WHEN l_linenumber = 7 THEN CAST(floor(l_partkey / 2) AS BIGINT) + 1 ELSE l_partkey * 2 + 1 + l_linenumber % 2 END AS STRING) AS child
FROM lineitem""",
    "deps": """
SELECT DISTINCT 'proj' || CAST(l_suppkey AS STRING) AS project,
  CASE WHEN p_size % 7 = 0 THEN '@scope/' || replace(p_name, ' ', '-') ELSE replace(p_name, ' ', '-') END || CAST(p_partkey AS STRING) AS name,
  CAST(p_size AS STRING) || '.0.' || CAST(p_partkey % 10 AS STRING) AS version,
  CASE WHEN p_size % 3 = 0 THEN 'dev' ELSE 'prod' END AS type,
  CASE p_type WHEN 'ECONOMY' THEN 'npm' WHEN 'SMALL' THEN 'pypi' WHEN 'LARGE' THEN 'go' WHEN 'PROMO' THEN 'cargo'
     WHEN 'STANDARD' THEN 'rubygems' ELSE 'other' END AS ecosystem
FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "scan_metrics": """
SELECT event_id AS scan_id, 'proj' || CAST(user_id AS STRING) AS project, ts AS scanned_at,
  CAST(floor(value) AS BIGINT) AS files_scanned, event_id % 30 AS findings_total, 100 - event_id % 60 AS security_score
FROM events""",
    "source_files": """
SELECT source AS project, source || '/' || lang || '/doc' || CAST(doc_id AS STRING) ||
    CASE doc_id % 5 WHEN 0 THEN '.py' WHEN 1 THEN '.js' WHEN 2 THEN '.go' WHEN 3 THEN '.md' ELSE '.env' END AS path, text AS content
FROM documents
UNION ALL
SELECT 'site' AS project, 'site/page' || CAST(page_id AS STRING) || '.js' AS path, html AS content FROM pages""",
    "code_files": f"""
SELECT 'proj' || CAST(o_custkey AS STRING) AS project, {CODE_PATH} AS path, {CODE_TEXT} AS content FROM orders""",
    "project_files": PROJECT_FILES,
    "repo_files": """
SELECT project, path, content FROM project_files UNION ALL SELECT project, path, content FROM code_files""",
    "enriched": f"""
SELECT event_id AS idx, 'proj' || CAST(o_custkey AS STRING) AS project, 'CS-GEN-' || CAST(event_id + 1000 AS STRING) AS vuln_id,
  {rule_case('CAST(floor(event_id / 3) AS BIGINT)')} AS rule_id,
  CASE CAST(floor(event_id / 3) AS BIGINT) % 5 WHEN 0 THEN 'core' WHEN 1 THEN 'external' WHEN 2 THEN 'nfr' WHEN 3 THEN 'deploy' ELSE 'network' END AS type,
  CASE CAST(floor(event_id / 3) AS BIGINT) % 5 WHEN 1 THEN 'semgrep' ELSE 'core' END AS source,
  {SEVERITY_BY_TYPE} AS severity, {CODE_PATH} AS file, CASE event_id % 3 WHEN 2 THEN 4 ELSE 2 END AS line,
  {message_case('CAST(floor(event_id / 3) AS BIGINT)')} AS message
FROM events JOIN orders ON o_orderkey = {_FILE_KEY}""",
    "inventory": """
SELECT *, left({sha}(lower(rule_id) || chr(0) || lower(type) || chr(0) || lower(regexp_replace(file, '^src/', 'src/')) || chr(0)
  || CAST(line AS STRING) || chr(0) || message), 32) AS fingerprint
FROM enriched""",
    "verdicts": """
SELECT idx, fingerprint,
  CASE idx % 4 WHEN 2 THEN 'False Positive' WHEN 3 THEN 'Needs Manual Review' ELSE 'True Positive' END AS disposition,
  CASE idx % 50 WHEN 0 THEN 'leaks sk-' || md5(CAST(idx AS STRING)) WHEN 1 THEN '' ELSE 'because of line ' || CAST(line AS STRING) END AS rationale,
  CASE idx % 5 WHEN 0 THEN ' High' WHEN 1 THEN 'med' WHEN 2 THEN 'low' WHEN 3 THEN 'sure' ELSE 'MEDIUM' END AS confidence,
  CASE idx % 6 WHEN 0 THEN 'cache' WHEN 1 THEN 'deterministic' WHEN 2 THEN 'nr-fallback' ELSE 'llm' END AS disposition_source,
  CASE idx % 70 WHEN 3 THEN 'AKIA' || upper(substr(md5(CAST(idx AS STRING)), 1, 16)) ELSE 'plain' END AS observed
FROM inventory""",
    "raw_verdicts": """
SELECT CASE WHEN event_id % 31 = 0 THEN event_id + 100000000 ELSE event_id END AS idx, event_id * 2 + pass AS seq,
  CASE WHEN event_id % 23 = 0 THEN 'CS-BAD-1' ELSE vuln_id END AS finding_id,
  CASE WHEN (event_id + pass) % 19 = 0 THEN 'bad' ELSE fingerprint END AS v_fingerprint,
  CASE (event_id + pass) % 7 WHEN 0 THEN 'True Positive' WHEN 1 THEN 'Needs Manual Review' WHEN 2 THEN 'maybe' ELSE 'False Positive' END AS disposition,
  CASE (event_id + pass) % 5 WHEN 0 THEN NULL WHEN 1 THEN 'test_only' WHEN 2 THEN 'opinion' ELSE 'code_mitigation' END AS basis,
  CASE event_id % 11 WHEN 0 THEN '' WHEN 1 THEN 'other/file.py' ELSE file END AS ev_file,
  CASE event_id % 6 WHEN 0 THEN 0 WHEN 1 THEN 99 ELSE line END AS ev_line,
  CASE event_id % 8 WHEN 0 THEN 'abc' WHEN 1 THEN 'not in the source' ELSE CASE line WHEN 2 THEN 'api_key' ELSE 'DEBUG' END END AS observed
FROM (SELECT idx AS event_id, *, 0 AS pass FROM inventory UNION ALL SELECT idx AS event_id, *, 1 AS pass FROM inventory)""",
    "verdict_cache": """
SELECT CASE idx % 5 WHEN 0 THEN 'v1:old' ELSE 'v1:now' END AS namespace, fingerprint, min(disposition) AS disposition,
  min(rationale) AS rationale, min(confidence) AS confidence, 'code_mitigation' AS basis, min(ev_file) AS ev_file, min(line) AS ev_line,
  min(observed) AS observed
FROM (SELECT i.idx - i.idx % 3 AS idx, i.fingerprint, CASE (i.idx - i.idx % 3) % 4 WHEN 2 THEN 'False Positive' WHEN 1 THEN 'False Positive' ELSE 'True Positive' END AS disposition,
  'cached' AS rationale, 'high' AS confidence, i.file AS ev_file, i.line AS line,
  CASE (i.idx - i.idx % 3) % 2 WHEN 0 THEN 'api_key' ELSE 'nothing like it' END AS observed FROM inventory i)
GROUP BY CASE idx % 5 WHEN 0 THEN 'v1:old' ELSE 'v1:now' END, fingerprint""",
    "ignored": """
SELECT p_partkey AS id, CASE p_size % 4 WHEN 0 THEN 'False Positive' WHEN 1 THEN 'Accepted Risk' WHEN 2 THEN 'Won''t Fix' ELSE 'Other' END AS reason,
  {sha}('snippet ' || CAST(p_partkey % 1800 AS STRING)) AS content_hash
FROM part""",
    "usage_rows": """
SELECT l_orderkey AS run_id, CASE l_linenumber % 4 WHEN 0 THEN 'threat_model' WHEN 1 THEN 'classify' WHEN 2 THEN 'report' ELSE 'fix_spec' END AS stage,
  CASE WHEN l_returnflag = 'N' THEN 0 ELSE CAST(floor(l_quantity) AS BIGINT) * 10 END AS prompt_tokens,
  CASE WHEN l_returnflag = 'N' THEN 0 ELSE CAST(floor(l_quantity) AS BIGINT) * 2 END AS completion_tokens,
  CASE WHEN l_returnflag = 'N' THEN 0 ELSE CAST(floor(l_quantity) AS BIGINT) * 12 + CASE l_linestatus WHEN 'F' THEN 5 ELSE 0 END END AS total_tokens
FROM lineitem""",
    "executions": """
SELECT l_orderkey AS scan_id, CASE l_linenumber WHEN 1 THEN 'semgrep' WHEN 2 THEN 'trivy' WHEN 3 THEN 'gitleaks' WHEN 4 THEN 'bandit' ELSE 'core' END AS scanner,
  CASE l_returnflag WHEN 'A' THEN 'completed' WHEN 'R' THEN 'not_applicable' ELSE 'failed' END AS status
FROM lineitem""",
    "run_events": """
SELECT user_id AS run_id, event_id AS seq, CASE event_id % 10 WHEN 0 THEN 'scanning' WHEN 1 THEN 'triaging' WHEN 2 THEN 'finalized'
  WHEN 3 THEN 'awaiting_user_approval' WHEN 4 THEN 'fixing' WHEN 5 THEN 'verifying' WHEN 6 THEN 'completed' WHEN 7 THEN 'failed'
  WHEN 8 THEN 'awaiting_agent' ELSE 'paused' END AS status
FROM events""",
    "file_events": """
SELECT event_id, 'ws' || CAST(user_id AS STRING) AS workspace,
  'src/' || CASE event_id % 9 WHEN 0 THEN '.hidden' WHEN 1 THEN 'x' || CAST(event_id % 50 AS STRING) || '.swp' ELSE 'f' || CAST(event_id % 50 AS STRING) || '.py' END AS path,
  CASE event_type WHEN 'click' THEN 'write' WHEN 'signup' THEN 'create' WHEN 'purchase' THEN 'rename' WHEN 'error' THEN 'remove' ELSE 'write' END AS op, ts AS changed_at
FROM events""",
    "notifications": """
SELECT event_id AS id, user_id, 'Finding ' || CAST(event_id AS STRING) AS title, event_type IN ('view', 'purchase') AS is_read, ts AS created_at FROM events""",
    "audit_log": """
SELECT event_id AS id, user_id, 'update' AS action, CASE event_type WHEN 'view' THEN 'product' WHEN 'click' THEN 'engagement' ELSE 'finding' END AS entity_type,
  ts AS created_at FROM events""",
    "runs": """
SELECT o_orderkey AS id, o_custkey AS product_id, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN CASE o_orderkey % 2 WHEN 0 THEN 'running' ELSE 'in_progress' END ELSE 'failed' END AS status FROM orders""",
    "replies": """
SELECT conv_id, turn, CASE turn % 5
  WHEN 0 THEN 'Sure.' || chr(10) || '```json' || chr(10) || '{"status":"true_positive","summary":"turn ' || CAST(conv_id AS STRING) || '"}' || chr(10) || '```' || chr(10) || text
  WHEN 1 THEN '```' || chr(10) || '{"status":"false_positive","summary":"fenced"}' || chr(10) || '```'
  WHEN 2 THEN 'Answer: {"status":"unclear","summary":"bare"} thanks' WHEN 3 THEN text ELSE '{"status": broken' END AS reply
FROM conversations""",
    "reports": """
SELECT conv_id, turn, text || ' see CS-GEN-' || CAST(1000 + conv_id % 20000 AS STRING) || ' and cve CVE-2024-' || CAST(1230 + turn AS STRING) || ', CS-SQLI-001' AS body
FROM conversations""",
}

_WORD = re.compile(r"[a-z_]+")


def needed(sql: str, known: dict[str, str] = DERIVED) -> list[str]:
    """Derived views a text reads, each after the ones it reads itself."""
    out: list[str] = []

    def visit(text: str) -> None:
        for word in _WORD.findall(text):
            if word in known and word not in out:
                visit_name(word)

    def visit_name(name: str) -> None:
        words = [w for w in _WORD.findall(known[name]) if w in known and w != name]
        for w in dict.fromkeys(words):
            if w not in out:
                visit_name(w)
        if name not in out:
            out.append(name)

    visit(sql)
    return out


def _with(sql: str, names: list[str], sha, known: dict[str, str] = DERIVED) -> str:
    ctes = [f"{n} AS ({sha(known[n]).strip()})" for n in names]
    body = sql.strip()
    head = "WITH RECURSIVE" if body.upper().startswith("WITH RECURSIVE") else "WITH"
    if body.upper().startswith("WITH"):
        rest = re.sub(r"(?i)^WITH(\s+RECURSIVE)?\s", "", body, count=1)
        return f"{head} " + ", ".join([*ctes, rest]) if ctes else body
    return f"WITH {', '.join(ctes)} {body}" if ctes else body


def duck_sql(sql: str) -> str:
    """An oracle text with the derived views it reads as common table expressions."""
    return _with(sql, needed(sql), lambda t: t.replace("{sha}", "sha256"))


_SHA_CALL = "{sha}("


def _spark_sha(text: str) -> str:
    while _SHA_CALL in text:
        start = text.index(_SHA_CALL)
        level, i = 1, start + len(_SHA_CALL)
        while level:
            level += {"(": 1, ")": -1}.get(text[i], 0)
            i += 1
        text = text[:start] + "sha2(" + text[start + len(_SHA_CALL): i - 1] + ", 256)" + text[i:]
    return text


# Views that Spark is given in another form.
_SPARK_FORMS = DERIVED | {"project_files": PROJECT_FILES_STACKED}


def spark_sql_text(name: str) -> str:
    text = f"SELECT * FROM {name}"
    return _with(text, needed(text), _spark_sha, _SPARK_FORMS)
