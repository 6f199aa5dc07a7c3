"""Rule scans and checks over whole text corpora."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import text as T
from ..functions.severity import PORT_SERVICES
from ..operators import file_checks as C
from ..operators import project_shape as S
from ..operators import roots as N
from ..operators import rules as R
from ..operators.code_text import split_code_docs
from ..operators.directives import apply_inline_suppressions
from ..operators.rules import Rule
from ..session import shared_dir
from ..sources import corpus, trees
from . import duck as D
from .registry import query

c = F.col
ALL_EXTS = (".py", ".js", ".go", ".md", ".env", ".ts", ".yaml", "Dockerfile", ".dockerfile")

# Words every match of a signal rule holds.
NEEDS = {
    "T-TOKEN": ("secret", "password", "passwd", "token"), "T-TRACK": ("track(",), "T-EMAIL": ("@",),
    "T-AD": ('class="ad"',), "T-LICENSE": ("copyright", "license"),
}
# Rules with signal on the fixture corpora: (id, pattern, severity).
SIGNAL = (
    ("T-TOKEN", r"""(?i)(secret|password|passwd|token)\s*[=:]\s*["'][^"']{8,}["']""", "CRITICAL"),
    ("T-HEX40", r"\b[0-9a-f]{40}\b", "HIGH"),
    ("T-SCRIPT", r"<script", "MEDIUM"),
    ("T-TRACK", r"track\(\d*1\d*\)", "LOW"),
    ("T-EMAIL", r"[A-Za-z0-9._]+@[A-Za-z0-9.]+", "LOW"),
    ("T-AD", r"""(?m)class="ad\"""", "LOW"),
    ("T-LICENSE", r"(?i)copyright|license", "MEDIUM"),
    ("T-IP", r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b", "MEDIUM"),
    ("T-ANCHOR", r"(?m)^Er", "LOW"),
    ("T-MULTI", r"\.\n[A-Z]", "LOW"),
)
SIGNAL_RULES = tuple(
    Rule(id=i, name=f"Signal {i}", extensions=ALL_EXTS, target="all", pattern=p, severity=s, suggestion=f"Review {i}",
         needs=NEEDS.get(i, ()))
    for i, p, s in SIGNAL
)


def _rule_rows(rules, files: str, line_sql) -> str:
    """One SELECT per rule over a corpus; ``line_sql`` gives the hit line of a rule."""
    parts = []
    for r in rules:
        exts = ", ".join(D.q(e.lower()) for e in r.extensions)
        gate = f"({D.ext('path')} IN ({exts}) OR lower({D.base('path')}) IN ({exts}))"
        if r.exclude_tests:
            gate += f" AND NOT {D.test_like('path')}"
        for frag in r.exclude_paths:
            gate += f" AND NOT contains(path, {D.q(frag)})"
        parts.append(
            f"SELECT project, path, {D.q(r.id)} AS rule_id, {D.q(r.name)} AS name, {D.q(r.severity)} AS severity, "
            f"{D.q(r.suggestion)} AS suggestion, CAST({line_sql(r)} AS INT) AS line FROM {files} WHERE {gate}"
        )
    return " UNION ALL ".join(parts)


SCAN_SQL = f"SELECT * FROM ({_rule_rows(SIGNAL_RULES, 'source_files', lambda r: D.hit_line('content', r.pattern))}) WHERE line > 0"


@query("scan_rules", SCAN_SQL)
def _(t):
    return R.scan_rules(t.source_files, SIGNAL_RULES)


# Targets, conditions and logic, with directives left aside.
TARGET_RULES = (
    Rule(id="C-EVAL", name="eval in code", extensions=(".py", ".js", ".go", ".md"), pattern=r"\beval\(", severity="HIGH"),
    Rule(id="C-DOCS", name="eval in text", extensions=(".py", ".js", ".ts"), target="docs", pattern=r"eval\(", severity="LOW"),
    Rule(id="C-ALL", name="debug", extensions=(".py",), target="all", pattern=r"(?i)debug\s*=\s*true", exclude_tests=True,
         severity="HIGH"),
    Rule(id="C-NAME", name="session file", extensions=(".js",), target="filename", pattern=r"^session_\d+\.js$", severity="LOW"),
)


def _views_sql(files: str) -> str:
    return (
        f"views AS (SELECT project, path, content, {D.code_view('content')} AS code, {D.docs_view('content')} AS docs FROM {files})"
    )


def _target(r: Rule) -> str:
    return {"all": "content", "raw": "content", "docs": "docs", "filename": D.base("path")}.get(r.target, "code")


@query(
    "scan_targets",
    f"WITH {_views_sql('code_files')} SELECT * FROM ("
    + _rule_rows(TARGET_RULES, "views", lambda r: D.hit_line(_target(r), r.pattern))
    + ") WHERE line > 0",
)
def _(t):
    return R.scan_rules(t.code_files, TARGET_RULES, directive=None)


NOT_RULE = Rule(
    id="N-ROUTE", name="route without limit", extensions=(".py", ".js", ".ts", ".go"), target="all",
    pattern=r"app\.get\(|FastAPI\(", condition="not_contains:RATE_limit", severity="MEDIUM",
)


@query(
    "not_contains",
    "SELECT * FROM ("
    + _rule_rows(
        [NOT_RULE], "code_files",
        lambda r: f"CASE WHEN contains(lower(content), 'rate_limit') THEN 0 ELSE {D.hit_line('content', r.pattern)} END",
    )
    + ") WHERE line > 0",
)
def _(t):
    return R.scan_rules(t.code_files, [NOT_RULE], directive=None)


LITERAL_RULES = (
    Rule(id="L-TRY", name="literal", extensions=(".py", ".go"), target="all", pattern="try: err", severity="LOW"),
    Rule(id="L-KEY", name="literal key", extensions=(".py", ".js", ".ts"), target="all", pattern="api_key =", severity="LOW"),
)


@query(
    "literal_match",
    "SELECT * FROM ("
    + _rule_rows(
        LITERAL_RULES, "code_files",
        lambda r: f"CASE WHEN instr(content, {D.q(r.pattern)}) > 0 THEN "
        + D.newlines(f"left(content, instr(content, {D.q(r.pattern)}) - 1)") + " + 1 ELSE 0 END",
    )
    + ") WHERE line > 0",
)
def _(t):
    return R.scan_rules(t.code_files, LITERAL_RULES, directive=None)


def _all(pattern: str, **kw) -> Rule:
    return Rule(id="", target="all", pattern=pattern, **kw)


LOGIC_RULES = (
    Rule(id="G-AND", name="and", extensions=(".py",), severity="HIGH", patterns=(_all(r"api_key"), _all(r"print\("))),
    Rule(id="G-OR", name="or", extensions=(".py", ".js"), severity="LOW", pattern_either=(_all(r"console\.log"), _all(r"eval\("))),
    Rule(id="G-NOT", name="not", extensions=(".ts", ".go"), severity="LOW", target="all", pattern=r"total", pattern_not=r"eval"),
    Rule(id="G-ONLYNOT", name="only not", extensions=(".md",), severity="LOW", target="all", pattern_not=r"import os"),
)


def _logic_line(r: Rule) -> str:
    def line(p: str) -> str:
        return "(" + D.hit_line("content", p) + ")"

    if r.patterns:
        return f"CASE WHEN {' AND '.join(line(s.pattern) + ' > 0' for s in r.patterns)} THEN {line(r.patterns[0].pattern)} ELSE 0 END"
    if r.pattern_either:
        return "CASE " + " ".join(f"WHEN {line(s.pattern)} > 0 THEN {line(s.pattern)}" for s in r.pattern_either) + " ELSE 0 END"
    found = line(r.pattern) if r.pattern else "1"
    return f"CASE WHEN {line(r.pattern_not)} > 0 THEN 0 ELSE {found} END"


@query("logical_patterns", "SELECT * FROM (" + _rule_rows(LOGIC_RULES, "code_files", _logic_line) + ") WHERE line > 0")
def _(t):
    return R.scan_rules(t.code_files, LOGIC_RULES, directive=None)


SUPPRESS_RULES = (
    Rule(id="T-EVAL", name="eval", extensions=(".py", ".js", ".ts", ".go"), target="all", pattern=r"eval\(", severity="HIGH"),
    Rule(id="T-DEBUG", name="debug", extensions=(".py", ".js"), target="all", pattern=r"(?i)debug\s*=", severity="LOW"),
    Rule(id="T-TOTAL", name="total", extensions=(".py",), target="all", pattern=r"total =", severity="LOW"),
)
_HITS = "(" + _rule_rows(SUPPRESS_RULES, "code_files", lambda r: D.hit_line("content", r.pattern)) + ")"
_LS = "string_split(f.content, chr(10))"


def _directive(s: str) -> str:
    return f"(contains({s}, 'scan-ignore') OR contains({s}, 'scan:ignore'))"


def _hidden(line: str, rule_id: str, ls: str = _LS) -> str:
    """Whether a directive hides a hit of ``rule_id`` (SQL text) on ``line``."""

    def names(s: str) -> str:
        return f"({_directive(s)} AND (contains({s}, 'all') OR contains({s}, {rule_id})))"

    whole = f"len(list_filter({ls}[1:10], lambda s: contains(s, 'scan-ignore-file') OR contains(s, 'scan:ignore-file'))) > 0"
    return f"({whole} OR coalesce({line} >= 1 AND {line} <= len({ls}) AND ({names(f'{ls}[{line}]')} OR ({line} > 1 AND {names(f'{ls}[{line} - 1]')})), false))"


# Rules of several branches, whose directives count branch by branch.
BRANCH_RULES = (
    Rule(id="B-OR", name="or", extensions=(".py", ".js", ".ts", ".go"), severity="HIGH", pattern_either=(
        _all(r"eval\("), _all(r"x = 1"), Rule(id="B-KEY", target="all", pattern="api_key"), _all(r"total"))),
    Rule(id="B-AND", name="and", extensions=(".py", ".js"), severity="LOW", patterns=(
        _all(r"import"), Rule(id="T-EVAL", target="all", pattern=r"eval\("))),
    Rule(id="B-NOT", name="not", extensions=(".py", ".js", ".ts"), severity="LOW", target="all", pattern=r"total", pattern_not=r"eval\("),
    Rule(id="B-SHARE", name="share", extensions=(".py",), severity="LOW", target="all", pattern=r"=", condition="threshold:0.1"),
    Rule(id="B-BIG", name="large", extensions=(".py", ".js"), severity="LOW", target="condition", condition="large_file"),
)


def _branch_line(r: Rule) -> str:
    ls = "ls"

    def line(p: str, own: str) -> str:
        at = f"({D.hit_line('content', p)})"
        return f"(CASE WHEN {at} > 0 AND NOT {_hidden(at, D.q(own), ls)} THEN {at} ELSE 0 END)"

    if r.target == "condition":
        return f"CASE WHEN {D.newlines('content')} > 1500 THEN 1 ELSE 0 END"
    if r.patterns:
        return f"CASE WHEN {' AND '.join(line(s.pattern, s.id) + ' > 0' for s in r.patterns)} THEN {line(r.patterns[0].pattern, r.patterns[0].id)} ELSE 0 END"
    if r.pattern_either:
        return "CASE " + " ".join(f"WHEN {line(s.pattern, s.id)} > 0 THEN {line(s.pattern, s.id)}" for s in r.pattern_either) + " ELSE 0 END"
    if r.condition:
        hit = f"list_transform({ls}, lambda s: contains(s, '='))"
        at = f"list_position({hit}, true)"
        return f"CASE WHEN len(list_filter({hit}, lambda b: b)) / len({hit}) > 0.1 AND NOT {_hidden(at, D.q(r.id), ls)} THEN {at} ELSE 0 END"
    return f"CASE WHEN {line(r.pattern_not, r.id)} > 0 THEN 0 ELSE {line(r.pattern, r.id)} END"


_SPLIT = "(SELECT *, string_split(content, chr(10)) AS ls FROM code_files)"


@query("branch_directives", "SELECT * FROM (" + _rule_rows(BRANCH_RULES, _SPLIT, _branch_line) + ") WHERE line > 0")
def _(t):
    return R.scan_rules(t.code_files, BRANCH_RULES)


SUPPRESS_SQL = f"""SELECT h.project, h.path, h.rule_id, h.line FROM {_HITS} h JOIN code_files f ON h.project = f.project AND h.path = f.path
WHERE h.line > 0 AND NOT (
  len(list_filter({_LS}[1:10], lambda s: contains(s, 'scan-ignore-file') OR contains(s, 'scan:ignore-file'))) > 0
  OR ({_directive(f'{_LS}[h.line]')} AND (contains({_LS}[h.line], 'all') OR contains({_LS}[h.line], h.rule_id)))
  OR (h.line > 1 AND {_directive(f'{_LS}[h.line - 1]')} AND (contains({_LS}[h.line - 1], 'all') OR contains({_LS}[h.line - 1], h.rule_id))))"""


@query("inline_suppressions", SUPPRESS_SQL)
def _(t):
    return R.scan_rules(t.code_files, SUPPRESS_RULES).select("project", "path", "rule_id", "line")


@query("apply_inline_suppressions", SUPPRESS_SQL)
def _(t):
    hits = R.scan_rules(t.code_files, SUPPRESS_RULES, directive=None).select("project", "path", "rule_id", "line")
    return apply_inline_suppressions(hits, t.code_files)


DOCUMENTED_RULES = (
    Rule(id="D-CONTAINS", name="contains", extensions=(".py", ".js", ".ts"), target="all", pattern=r"eval\(",
         condition="contains:password", severity="HIGH"),
    Rule(id="D-SHARE", name="threshold", extensions=(".py", ".js", ".ts", ".go"), target="lines_percentage",
         pattern=r"=", condition="threshold:0.4", severity="LOW"),
)


def _documented_line(r: Rule) -> str:
    if r.condition.startswith("contains"):
        return f"CASE WHEN contains(content, 'password') THEN {D.hit_line('content', r.pattern)} ELSE 0 END"
    hit = "list_transform(string_split(content, chr(10)), lambda s: regexp_matches(s, '='))"
    return f"CASE WHEN len(list_filter({hit}, lambda b: b)) / len({hit}) > 0.4 THEN list_position({hit}, true) ELSE 0 END"


@query(
    "conditions_documented",
    "SELECT * FROM (" + _rule_rows(DOCUMENTED_RULES, "code_files", _documented_line) + ") WHERE line > 0",
)
def _(t):
    return R.scan_rules(t.code_files, DOCUMENTED_RULES, directive=None)


@query(
    "rules_x_files",
    "SELECT project, path, rule_id FROM ("
    + _rule_rows([Rule(r.id, extensions=r.extensions) for r in TARGET_RULES + LOGIC_RULES + LITERAL_RULES], "repo_files", lambda r: "1")
    + ")",
)
def _(t):
    return R.rules_x_files(t.repo_files, TARGET_RULES + LOGIC_RULES + LITERAL_RULES)


@query(
    "rules_for_stack",
    "SELECT DISTINCT rule_id, stack FROM (SELECT rule_id, coalesce(stack, 'universal') AS stack FROM findings) WHERE stack IN ('universal', 'semgrep')",
)
def _(t):
    rules = t.findings.select("rule_id", F.coalesce("stack", F.lit("universal")).alias("stack")).distinct()
    return R.rules_for_stack(rules, "semgrep")


@query(
    "large_file",
    f"SELECT project, path, {D.newlines('content')} AS newlines FROM (SELECT project, path, repeat(content || chr(10), 60) AS content FROM source_files) WHERE {D.newlines('content')} > 1500",
)
def _(t):
    grown = t.source_files.withColumn("content", F.repeat(F.concat("content", F.lit("\n")), F.lit(60)))
    return C.large_files(grown)


# ---- project rules --------------------------------------------------------

REQUIRED_RULES = (
    Rule(id="Q-USER", name="container user", extensions=("Dockerfile", ".dockerfile"), target="all",
         pattern=r"(?m)^USER ", condition="required_pattern", severity="HIGH", suggestion="set a user"),
    Rule(id="Q-LIMIT", name="rate limit", extensions=(".py", ".js"), target="all", pattern=r"rate_limit",
         condition="required_pattern", exclude_tests=True, exclude_paths=("node_modules",), severity="MEDIUM"),
)


def _required(r: Rule) -> str:
    exts = ", ".join(D.q(e.lower()) for e in r.extensions)
    gate = f"({D.ext('path')} IN ({exts}) OR lower({D.base('path')}) IN ({exts}))"
    if r.exclude_tests:
        gate += f" AND NOT {D.test_like('path')} AND NOT contains(path, 'node_modules')"
    return (
        f"SELECT {D.q(r.id)} AS rule_id, project, {D.q(r.name)} AS name, {D.q(r.severity)} AS severity, {D.q(r.suggestion)} AS suggestion "
        f"FROM repo_files WHERE {gate} GROUP BY project HAVING NOT bool_or(regexp_matches(content, {D.q(r.pattern)}))"
    )


@query("required_pattern", " UNION ALL ".join(_required(r) for r in REQUIRED_RULES))
def _(t):
    return R.required_pattern(t.repo_files, REQUIRED_RULES)


NAME_RULE = Rule(id="Q-MIDDLE", name="middleware", extensions=(".ts", ".js"), target="filename",
                 pattern=r"middleware\.(ts|js)", condition="missing", severity="HIGH")
LOCK_RULE = Rule(id="Q-LOCK", name="lock file", condition="missing_lockfile", severity="MEDIUM",
                 files=("package-lock.json", "poetry.lock", "yarn.lock"))


@query(
    "missing_filename",
    f"SELECT p.project, 'Q-MIDDLE' AS rule_id, 'middleware' AS name, 'HIGH' AS severity, '' AS suggestion FROM projects p WHERE NOT EXISTS "
    f"(SELECT 1 FROM repo_files f WHERE f.project = p.project AND {D.ext('f.path')} IN ('.ts', '.js') AND regexp_matches({D.base('f.path')}, 'middleware\\.(ts|js)'))",
)
def _(t):
    return R.missing_filename(t.repo_files, t.projects, [NAME_RULE])


@query(
    "missing_lockfile",
    "SELECT p.project, 'Q-LOCK' AS rule_id, 'lock file' AS name, 'MEDIUM' AS severity, '' AS suggestion FROM projects p WHERE NOT EXISTS "
    "(SELECT 1 FROM repo_files f WHERE f.project = p.project AND f.path IN ('package-lock.json', 'poetry.lock', 'yarn.lock'))",
)
def _(t):
    return R.missing_lockfile(t.repo_files, t.projects, [LOCK_RULE])


_SOURCES = ("*.go", "*.py", "*.ts", "*.js")
_APPLIES = r"(?i)(FastAPI\s*\(|express\s*\(|(?:app|router)\.(?:get|post|put|patch|delete)\s*\()"
NFR = (
    R.NfrRule("N-LIMIT", "Rate limiting", "HIGH", "file_contains", r"rate.?limit|throttle", _SOURCES, _APPLIES, (), "no limit", "add one"),
    R.NfrRule("N-AUTH", "Authentication", "HIGH", "file_contains", r"auth|jwt|middleware", _SOURCES, _APPLIES, (), "no auth", "add it"),
    R.NfrRule("N-ENVEX", "Example env", "MEDIUM", "file_exists", ".env.example", (), r"os\.(?:getenv|environ)|process\.env", _SOURCES,
              "no example", "add it"),
    R.NfrRule("N-ENV", "Env in tree", "CRITICAL", "file_not_exists", ".env", (), "", (), "env file", "remove it"),
)
_SKIP = "NOT list_has_any(string_split(path, '/')[1:-2], ['.git', 'node_modules', 'vendor', 'dist', 'build', '.next'])"
_GLOB = f"{_SKIP} AND regexp_matches({D.base('path')}, '\\.(go|py|ts|js)$')"


def _nfr_sql() -> str:
    flags = f"""flags AS (SELECT p.project,
      coalesce(bool_or({_GLOB}), false) AS target, coalesce(bool_or({_GLOB} AND regexp_matches(content, {D.q(_APPLIES)})), false) AS web,
      coalesce(bool_or({_GLOB} AND regexp_matches(content, 'rate.?limit|throttle')), false) AS lim,
      coalesce(bool_or({_GLOB} AND regexp_matches(content, 'auth|jwt|middleware')), false) AS aut,
      coalesce(bool_or({_GLOB} AND regexp_matches(content, 'os\\.(?:getenv|environ)|process\\.env')), false) AS env,
      coalesce(bool_or(path = '.env.example'), false) AS ex, coalesce(bool_or(path = '.env'), false) AS dot
      FROM projects p LEFT JOIN repo_files f ON p.project = f.project GROUP BY p.project)"""
    conds = {"N-LIMIT": "target AND web AND NOT lim", "N-AUTH": "target AND web AND NOT aut", "N-ENVEX": "env AND NOT ex", "N-ENV": "dot"}
    rows = [
        f"SELECT project, {D.q(r.id)} AS rule_id, {D.q(r.name)} AS name, {D.q(r.severity)} AS severity, {D.q(r.message)} AS message, {D.q(r.advice)} AS advice FROM flags WHERE {conds[r.id]}"
        for r in NFR
    ]
    return f"WITH {flags} " + " UNION ALL ".join(rows)


@query("nfr_rules", _nfr_sql())
def _(t):
    return R.nfr_rules(t.repo_files, t.projects, NFR)


# ---- files and lines ------------------------------------------------------


@query(
    "split_code_docs",
    f"SELECT project, path, {D.code_view('content')} AS code, {D.docs_view('content')} AS docs FROM repo_files",
)
def _(t):
    return split_code_docs(t.repo_files).select("project", "path", "code", "docs")


_PLACE = "(?i)(todo|fixme|temporary|tempVar|result\\d|var\\d|placeholder)"


@query(
    "placeholder_count",
    f"SELECT project, path, len(regexp_extract_all(content, '{_PLACE}')) AS placeholders FROM repo_files "
    f"WHERE regexp_matches(path, '\\.(go|ts|tsx|js|jsx|py)$') AND NOT contains(path, 'node_modules') AND len(regexp_extract_all(content, '{_PLACE}')) > 5",
)
def _(t):
    return C.placeholder_count(t.repo_files)


@query(
    "brittle_files",
    f"SELECT project, path, strlen(content) AS bytes FROM (SELECT * FROM repo_files UNION ALL SELECT * FROM source_files) WHERE {D.ext('path')} IN ('.go', '.js', '.ts') "
    "AND strlen(content) > 2000 AND NOT contains(content, 'err') AND NOT contains(content, 'catch')",
)
def _(t):
    return C.brittle_files(t.repo_files.unionByName(t.source_files))


def _first_secret(text: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({text}, {D.q(p)}) THEN {D.q(n)}" for n, p in C.SECRET_PATTERNS) + " END"


def _preview(text: str) -> str:
    t = D.strip(text)
    cut = f"CASE WHEN length({t}) > 80 THEN left({t}, 80) || '...' ELSE {t} END"
    return f"regexp_replace({cut}, '([A-Za-z0-9+/=_-]{{4}})[A-Za-z0-9+/=_-]{{5,}}([A-Za-z0-9+/=_-]{{4}})', '\\1****\\2', 'g')"


ALL_FILES = "(SELECT * FROM repo_files UNION ALL SELECT * FROM source_files)"


@query(
    "secret_scan",
    f"SELECT project, path, CAST(line AS INT) AS line, {_first_secret('u.text')} AS pattern, {_preview('u.text')} AS preview "
    f"FROM {ALL_FILES} f, {D.lines()} WHERE {_first_secret('u.text')} IS NOT NULL",
)
def _(t):
    return C.secret_scan(t.repo_files.unionByName(t.source_files))


@query("redact_preview", f"SELECT doc_id, {_preview('text')} AS preview FROM documents")
def _(t):
    return t.documents.select("doc_id", T.redact_preview(c("text")).alias("preview"))


_KNOWN = D.q(T.KNOWN_SECRET_SHAPE)
_NAMED = D.q(
    "(?i)((?:password|passwd|token|secret|api[_-]?key|jwt)[^\\n:=]{0,40}\\s*[:=]\\s*)[`\"']?[^`\"'\\s]{8,}([`\"']?)"
)


def _redacted(x: str) -> str:
    x = f"regexp_replace({x}, {D.q(T.JWT_SHAPE)}, '[REDACTED_JWT]', 'g')"
    x = f"regexp_replace({x}, {_KNOWN}, '[REDACTED_SECRET]', 'g')"
    return f"regexp_replace({x}, {_NAMED}, '\\1[REDACTED]', 'g')"


@query("redact_secrets", f"SELECT project, path, {_redacted('content')} AS content FROM {ALL_FILES}")
def _(t):
    return t.repo_files.unionByName(t.source_files).select(
        "project", "path", T.redact_secrets(c("content")).alias("content")
    )


_SENSITIVE = " OR ".join(f"regexp_matches({{x}}, {D.q(p)})" for p in T.SENSITIVE_SHAPES)


def _is_sensitive(x: str) -> str:
    return "(contains(lower({x}), '-----begin ') OR ".replace("{x}", x) + _SENSITIVE.replace("{x}", x) + ")"


@query("has_sensitive_value", f"SELECT project, path, {_is_sensitive('content')} AS sensitive FROM {ALL_FILES}")
def _(t):
    return t.repo_files.unionByName(t.source_files).select(
        "project", "path", T.has_sensitive_value(c("content")).alias("sensitive")
    )


# Assignments and leaks.
_ASSIGN = D.q("(?i)(\\w*(?:secret|password|passwd|token|api_?key)\\w*)[ \\t]*(?::=|=|:)[ \\t]*[\"']([^\"'\\n]{8,})[\"']")
_VENDOR = [(n, p) for n, p in C.SECRET_PATTERNS if not n.startswith("Generic")]
_VKIND = "CASE " + " ".join(f"WHEN regexp_matches(text, {D.q(p)}) THEN {D.q(n)}" for n, p in _VENDOR) + " END"
_ASSIGN_FILE = f"({D.ext('f.path')} IN ('.go', '.py', '.ts', '.tsx', '.js', '.jsx', '.env') OR contains(lower({D.base('f.path')}), '.env'))"
_CONF = "('.yaml', '.yml', '.json', '.toml', '.tf', '.ini', '.cfg', '.conf', '.properties', '.xml')"
_VENDORED = " OR ".join(f"contains(f.path, '/{d}/')" for d in ("node_modules", "vendor", ".git", "dist", "build", ".next"))
ASSIGN_SQL = f"""WITH ls AS (
  SELECT f.project, f.path, f.content, u.line, u.text, {_ASSIGN_FILE} AS code FROM repo_files f, {D.lines()}
  WHERE ({_ASSIGN_FILE} OR {D.ext('f.path')} IN {_CONF}) AND NOT {D.test_like('f.path')} AND NOT ({_VENDORED})),
vals AS (SELECT *, regexp_extract(text, {_ASSIGN}, 1) AS var, trim(regexp_extract(text, {_ASSIGN}, 2), ' "''`' || chr(9) || chr(10) || chr(13)) AS val FROM ls),
ent AS (SELECT val, -sum(n / strlen(val) * log2(n / strlen(val))) AS h FROM (SELECT val, ch, count(*) AS n FROM (SELECT val, unnest(string_split(val, '')) AS ch FROM (SELECT DISTINCT val FROM vals)) GROUP BY val, ch) GROUP BY val),
named AS (SELECT v.*, code AND var <> '' AND strlen(v.val) BETWEEN 16 AND 128 AND NOT regexp_matches(v.val, '[^\\pL\\pM\\pN\\pP\\pS ]')
    AND length(regexp_replace(v.val, '[\\pL\\p{{Nd}}_+=/-]', '', 'g')) / strlen(v.val) <= 0.3 AND coalesce(h, 0) > 3.7 AS is_named FROM vals v LEFT JOIN ent e ON v.val = e.val),
kinds AS (SELECT *, coalesce({_VKIND}, CASE WHEN is_named THEN 'Secret Assignment' END) AS kind, CASE WHEN is_named THEN var ELSE '' END AS var_name FROM named)
SELECT project, path, CAST(line AS INT) AS line, var_name, kind,
  CASE WHEN var_name <> '' AND regexp_matches(content, '(?i)(?:log|print|console)\\w*\\s*\\([^)]*' || var_name || '[^)]*\\)') THEN 'SECRET-LEAK-LOG' ELSE 'ENTROPY-SECRET' END AS rule_id,
  'CRITICAL' AS severity, {_preview('text')} AS preview FROM kinds WHERE kind IS NOT NULL"""


@query("secret_assignments", ASSIGN_SQL)
def _(t):
    return C.secret_assignments(t.repo_files)


ASSIGN_SHOWN = f"""SELECT a.* FROM ({ASSIGN_SQL}) a JOIN repo_files f ON f.project = a.project AND f.path = a.path
WHERE NOT {_hidden('a.line', 'a.rule_id')} AND NOT {_hidden('a.line', "'ENTROPY-SECRET'")}"""


@query("secret_directives", ASSIGN_SHOWN)
def _(t):
    return C.secret_assignments(t.repo_files, "scan")


@query("secret_logged", f"{ASSIGN_SQL.replace('SELECT project, path, CAST(line', 'SELECT * FROM (SELECT project, path, CAST(line')}) WHERE rule_id = 'SECRET-LEAK-LOG'")
def _(t):
    return C.secret_logged(t.repo_files)


@query(
    "history_leaks",
    f"""WITH hits AS (SELECT f.*, CAST(u.line AS INT) AS line, {_first_secret('u.text')} AS pattern, {_preview('u.text')} AS preview FROM git_lines f, {D.lines()} WHERE {_first_secret('u.text')} IS NOT NULL),
    firsts AS (SELECT project, path, pattern, commit_id, committed_at, line, author, preview FROM hits QUALIFY row_number() OVER (PARTITION BY project, path, pattern, commit_id ORDER BY committed_at, line) = 1)
    SELECT * FROM firsts QUALIFY row_number() OVER (PARTITION BY project ORDER BY committed_at, commit_id, path, line, pattern) <= 50""",
)
def _(t):
    hits = C.secret_scan(t.git_lines, ("project", "path", "commit_id", "committed_at", "author"))
    return C.history_leaks(hits)


_IMPORTS = "list_filter(string_split(f.content, chr(10))[1:30], lambda s: regexp_matches(ltrim(s), '^(?:import |from |require\\(|const .*require\\()'))"


@query(
    "context_window",
    f"""WITH places AS (SELECT DISTINCT project, file AS path, CASE WHEN idx % 13 = 0 THEN 0 ELSE line + idx % 7 END AS line FROM enriched),
    j AS (SELECT p.project, p.path, p.line, f.content, string_split(f.content, chr(10)) AS ls FROM places p JOIN repo_files f ON p.project = f.project AND p.path = f.path),
    k AS (SELECT *, line BETWEEN 1 AND len(ls) AS ok FROM j),
    w AS (SELECT *, CASE WHEN ok THEN greatest(line - 3, 1) ELSE 1 END AS a, CASE WHEN ok THEN least(line + 3, len(ls)) ELSE least(len(ls), 12) END AS b FROM k)
    SELECT project, path, line, a AS start_line, b AS end_line,
      array_to_string(list_transform(ls[a:b], lambda s, i: CASE WHEN ok THEN CASE WHEN i - 1 + a = line THEN '>> ' ELSE '   ' END || CAST(i - 1 + a AS VARCHAR) || ': ' ELSE '' END
        || {_redacted('s')}), chr(10)) AS snippet,
      array_to_string({_IMPORTS.replace('f.content', 'content')}, chr(10)) AS imports
    FROM w""",
)
def _(t):
    line = F.when(c("idx") % 13 == 0, 0).otherwise(c("line") + c("idx") % 7)
    places = t.enriched.select("project", c("file").alias("path"), line.alias("line"))
    return C.context_window(places, t.repo_files, radius=3)


@query(
    "critical_files",
    "WITH stats AS (SELECT project, file_path, count(DISTINCT commit_id) AS commits, count(DISTINCT author_email) AS authors, CAST(sum(additions + deletions) AS BIGINT) AS lines_changed FROM git_numstat GROUP BY ALL), "
    "named AS (SELECT *, CASE " + " ".join(f"WHEN contains(lower({D.base('file_path')}), {D.q(p)}) THEN {D.q(w)}" for p, w in C.CRITICAL_NAMES)
    + f" END AS reason, CASE WHEN regexp_matches(lower({D.base('file_path')}), '\\.(pem|key|p12)$') OR lower({D.base('file_path')}) = '.env' THEN 'HIGH' ELSE 'MEDIUM' END AS risk FROM stats) "
    "SELECT project, file_path, commits, authors, lines_changed, reason, risk FROM named WHERE reason IS NOT NULL",
)
def _(t):
    from ..operators.timeline import git_file_stats

    stats = git_file_stats(t.git_numstat, ["project"]).select("project", "file_path", "commits", "authors", "lines_changed")
    return C.critical_files(stats)


IDS_SQL = """SELECT DISTINCT conv_id, turn, mention FROM (
  SELECT conv_id, turn, unnest(regexp_extract_all(body, 'CS-[A-Z0-9]+-\\d{3,}')) AS mention FROM reports
  UNION ALL SELECT conv_id, turn, upper(unnest(regexp_extract_all(body, 'CVE-\\d{4}-\\d{4,}'))) FROM reports)"""


@query("extract_ids", IDS_SQL)
def _(t):
    return C.extract_ids(t.reports, ["conv_id", "turn"], "body")


@query(
    "integrity_check",
    f"""WITH ids AS ({IDS_SQL}) SELECT * FROM ids WHERE mention NOT IN (SELECT vuln_id FROM inventory)
    AND mention NOT IN (SELECT upper(unnest(regexp_extract_all(message || ' ' || rule_id, 'CVE-\\d{{4}}-\\d{{4,}}'))) FROM inventory)""",
)
def _(t):
    return C.integrity_check(t.reports, t.inventory, ["conv_id", "turn"], "body")


# ---- project shape --------------------------------------------------------

_HOSTWORDS = "regexp_matches(text, 'http|host|addr')"


@query(
    "extract_hosts",
    f"""WITH words AS (SELECT project, unnest(list_transform(regexp_split_to_array(u.text, '["''=:/ ]'), lambda w: {D.strip('w')})) AS host
      FROM repo_files f, {D.lines()} WHERE {D.ext('path')} IN ('.yaml', '.yml', '.env', '.conf', '.json', '.go')
      AND NOT list_has_any(string_split(path, '/')[1:-2], ['.git', 'node_modules']) AND {_HOSTWORDS})
    SELECT DISTINCT project, host FROM words WHERE strlen(host) > 2 AND ((contains(host, '.') AND NOT starts_with(host, '0.')) OR host = 'localhost')
    UNION SELECT DISTINCT project, '127.0.0.1' FROM repo_files""",
)
def _(t):
    return S.extract_hosts(t.repo_files)


_PORT = "^\\s*-\\s*[\"'']?((?:[\\d.]+:)?(?:\\d+:)?\\d+(?:/\\w+)?)[\"'']?\\s*$"


@query(
    "compose_ports",
    f"""WITH ports AS (SELECT project, path, CAST(u.line AS INT) AS line, string_split(regexp_extract(u.text, '{_PORT}', 1), ':') AS p FROM repo_files f, {D.lines()}
      WHERE {D.base('path')} IN ('docker-compose.yml', 'docker-compose.yaml', 'compose.yml', 'compose.yaml') AND regexp_matches(u.text, '{_PORT}')),
    nums AS (SELECT project, path, line, TRY_CAST(string_split(CASE WHEN len(p) <= 2 THEN p[1] ELSE p[-2] END, '/')[1] AS INT) AS port FROM ports)
    SELECT project, path, line, port, {D.case('port', PORT_SERVICES, 'unknown')} AS service,
      CASE WHEN port IN (21, 23, 25) THEN 'CRITICAL' WHEN port IN (3306, 5432, 27017, 6379, 11211, 9200, 2181, 9092, 50070, 22, 3389) THEN 'HIGH' ELSE 'INFO' END AS severity
    FROM nums WHERE port > 0""",
)
def _(t):
    return S.compose_ports(t.repo_files)


@query(
    "port_service",
    f"""WITH ports AS (SELECT string_split(regexp_extract(u.text, '{_PORT}', 1), ':') AS p FROM repo_files f, {D.lines()}
      WHERE {D.base('path')} = 'docker-compose.yml' AND regexp_matches(u.text, '{_PORT}')),
    nums AS (SELECT TRY_CAST(string_split(CASE WHEN len(p) <= 2 THEN p[1] ELSE p[-2] END, '/')[1] AS INT) AS port FROM ports)
    SELECT port, {D.case('port', PORT_SERVICES, 'unknown')} AS service, count(*) AS n FROM nums WHERE port > 0 GROUP BY ALL""",
)
def _(t):
    return S.compose_ports(t.repo_files).groupBy("port", "service").agg(F.count(F.lit(1)).alias("n"))


_ROOT_FILES = "path IN ('go.mod', 'package.json', 'requirements.txt', 'docker-compose.yml', 'docker-compose.yaml')"


def _components_sql() -> str:
    rows = [
        "SELECT p.project, CASE WHEN coalesce(bool_or(path = 'go.mod'), false) THEN 'Go App' WHEN coalesce(bool_or(path = 'package.json'), false) THEN 'Node.js App' "
        "WHEN coalesce(bool_or(path = 'requirements.txt'), false) THEN 'Python App' ELSE 'Application' END AS component, 'app' AS type "
        f"FROM projects p LEFT JOIN (SELECT * FROM repo_files WHERE {_ROOT_FILES}) f ON p.project = f.project GROUP BY p.project"
    ]
    for words, name, kind in S.COMPOSE_WORDS:
        has = " OR ".join(f"contains(lower(content), '{w}')" for w in words)
        rows.append(
            f"SELECT DISTINCT project, {D.q(name)} AS component, {D.q(kind)} AS type FROM repo_files "
            f"WHERE path IN ('docker-compose.yml', 'docker-compose.yaml') AND ({has})"
        )
    return " UNION ALL ".join(rows)


COMPONENTS_SQL = _components_sql()


@query("detect_components", COMPONENTS_SQL)
def _(t):
    return S.detect_components(t.repo_files, t.projects)


def _threat_sql() -> str:
    values = ", ".join(f"({D.q(n)}, {D.q(th)}, {D.q(sv)}, {p})" for n, th, sv, _, p in S.VECTORS)
    return f"""WITH comps AS ({COMPONENTS_SQL}), vec(target, threat_type, severity, points) AS (VALUES {values}),
    hits AS (SELECT c.project, v.severity, v.points FROM comps c JOIN vec v ON c.component = v.target
      UNION ALL SELECT project, 'MEDIUM', 10 FROM comps WHERE type = 'message_broker'
      UNION ALL SELECT project, 'MEDIUM', 10 FROM comps GROUP BY project HAVING bool_or(type = 'db') AND NOT bool_or(type = 'proxy'))
    SELECT c.project, count(h.project) AS vectors, CAST(count(*) FILTER (WHERE h.severity = 'HIGH') AS BIGINT) AS high_vectors,
      CAST(least(coalesce(sum(h.points), 0), 100) AS BIGINT) AS risk_score FROM (SELECT DISTINCT project FROM comps) c LEFT JOIN hits h ON c.project = h.project GROUP BY c.project"""


@query("threat_surface", _threat_sql())
def _(t):
    return S.threat_surface(S.detect_components(t.repo_files, t.projects))


@query(
    "threat_recommendations",
    f"""WITH comps AS ({COMPONENTS_SQL}), has AS (SELECT project, bool_or(path = '.env') AS env, bool_or(path = 'Dockerfile') AS docker,
      bool_or(path IN ('docker-compose.yml', 'docker-compose.yaml')) AS compose FROM repo_files GROUP BY project)
    SELECT project, {D.q(S.UNPACKED_ENV)} AS recommendation FROM has WHERE env AND NOT docker AND NOT compose
    UNION ALL SELECT project, {D.q(S.OPEN_COMPOSE)} FROM has WHERE compose AND project NOT IN (SELECT project FROM comps WHERE type = 'proxy')""",
)
def _(t):
    return S.threat_recommendations(t.repo_files, S.detect_components(t.repo_files, t.projects))


def _deploy_sql() -> str:
    name = f"lower({D.base('path')})"
    kinds = f"""kinds AS (SELECT project, path, content, CASE WHEN {name} = 'dockerfile' OR ends_with({name}, '.dockerfile') THEN 'docker'
      WHEN {name} IN ('docker-compose.yml', 'docker-compose.yaml') THEN 'compose'
      WHEN ends_with({name}, '.yaml') OR ends_with({name}, '.yml') THEN CASE WHEN regexp_matches(content, '(?m)^(apiVersion|kind)[ \\t]*:') THEN 'k8s' END
      WHEN ends_with({name}, '.conf') THEN 'nginx' WHEN {name} IN ('makefile', 'gnumakefile') THEN 'make' END AS kind
      FROM repo_files WHERE NOT list_has_any(string_split(path, '/')[1:-2], ['.git', 'node_modules', 'vendor']))"""
    ls = f"""ls AS (SELECT project, path, kind, CAST(u.line AS INT) AS line, {D.strip('u.text')} AS t, regexp_extract(u.text, '^\\s*(?:-\\s+)?["'']?([\\w.-]+)["'']?\\s*:', 1) AS k,
      trim(regexp_extract(u.text, '^\\s*(?:-\\s+)?["'']?[\\w.-]+["'']?\\s*:[ \\t]+["'']?([^"''#\\n]*)', 1)) AS v FROM kinds f, {D.lines()} WHERE kind IS NOT NULL)"""

    def advice(issue: str) -> str:
        return D.q(S.DEPLOY_ADVICE[issue])

    def row(cond: str, issue: str, sev: str, ev: str) -> str:
        return f"SELECT project, path, line, '{issue}' AS issue, '{sev}' AS severity, {ev} AS evidence, {advice(issue)} AS advice, t AS text FROM ls WHERE {cond}"

    rows = [
        row("kind = 'docker' AND (starts_with(t, 'USER root') OR (starts_with(t, 'USER') AND NOT contains(t, 'USER ')))", "dockerfile_root_user", "HIGH", "t"),
        row("kind = 'docker' AND starts_with(t, 'ADD ') AND NOT contains(t, '.tar')", "dockerfile_add_instead_of_copy", "LOW", "t"),
        row("kind = 'docker' AND starts_with(t, 'ENV ') AND regexp_matches(t, 'PASSWORD|SECRET|API_KEY')", "dockerfile_hardcoded_secret", "CRITICAL", "left(t, 50) || '...'"),
        row("kind = 'nginx' AND regexp_matches(lower(t), '^user root[; ]')", "nginx_runs_as_root", "CRITICAL", "t"),
        row("kind = 'nginx' AND contains(lower(t), 'server_tokens on;')", "nginx_server_tokens_on", "LOW", "t"),
        row("kind = 'make' AND regexp_matches(lower(t), 'password|secret|api_key|token') AND contains(t, '=') AND NOT regexp_matches(t, '\\$[({]')", "makefile_hardcoded_secret", "HIGH", "left(t, 60)"),
        row("kind = 'compose' AND regexp_matches(lower(k), 'password|secret') AND v <> '' AND NOT contains(v, '${')", "compose_hardcoded_secret", "CRITICAL", "k || ': ' || left(v, 20)"),
        row("kind = 'compose' AND lower(k) = 'privileged' AND lower(v) = 'true'", "compose_privileged_mode", "HIGH", "'privileged: true'"),
        row("kind = 'k8s' AND k = 'privileged' AND lower(v) = 'true'", "k8s_privileged_container", "CRITICAL", "'privileged: true'"),
        row("kind = 'k8s' AND k = 'runAsUser' AND v = '0'", "k8s_run_as_root", "HIGH", "'runAsUser: 0'"),
    ]
    for word, issue, sev in (("server_tokens off;", "nginx_missing_server_tokens_off", "LOW"), ("x-frame-options", "nginx_missing_xframe_options", "MEDIUM"),
                             ("content-security-policy", "nginx_missing_csp", "LOW")):
        rows.append(f"SELECT project, path, 1, '{issue}', '{sev}', 'Whole file', {advice(issue)}, '' FROM kinds WHERE kind = 'nginx' AND NOT contains(lower(content), '{word}')")
    return f"WITH {kinds}, {ls} " + " UNION ALL ".join(rows)


DEPLOY_SQL = _deploy_sql()


@query("deploy_audit", DEPLOY_SQL)
def _(t):
    return S.deploy_audit(t.repo_files)


_LIVE = f"live AS (SELECT project, path, content, {D.base('path')} AS b, {D.folder('path')} AS dir, lower(content) AS low FROM repo_files WHERE NOT {D.test_like('path')})"
_PYDEP = "(b IN ('requirements.txt', 'pyproject.toml', 'Pipfile') OR (contains(dir, 'requirements') AND regexp_matches(b, '\\.(txt|in)$')))"


def _names(part: str) -> str:
    return f"CASE WHEN json_valid(content) THEN coalesce(json_keys(content, '$.{part}'), []) ELSE [] END"


_DEPS = f"list_concat({_names('dependencies')}, {_names('devDependencies')})"


def _imp(w: str) -> str:
    return f"(contains(low, 'from {w}') OR contains(low, 'import {w}'))"


STACK_SQL = f"""WITH {_LIVE.replace('live AS (', 'live AS MATERIALIZED (')},
 expr AS MATERIALIZED (SELECT DISTINCT project, path FROM repo_files WHERE {D.ext('path')} IN ('.js', '.cjs', '.mjs', '.ts', '.tsx') AND regexp_matches(content, '(?m)(?:\\bfrom\\s*["'']express["'']|\\brequire\\s*\\(\\s*["'']express["'']\\s*\\))')),
 pts AS (
  SELECT project, dir, CASE WHEN list_contains({_DEPS}, 'next') THEN 'nextjs' WHEN list_contains({_DEPS}, 'express') AND EXISTS (SELECT 1 FROM expr e WHERE e.project = l.project AND (l.dir = '.' OR starts_with(e.path, l.dir || '/'))) THEN 'express' ELSE 'unknown' END AS stack,
    CASE WHEN list_contains({_DEPS}, 'next') OR (list_contains({_DEPS}, 'express') AND EXISTS (SELECT 1 FROM expr e WHERE e.project = l.project AND (l.dir = '.' OR starts_with(e.path, l.dir || '/')))) THEN 100 ELSE 50 END AS points FROM live l WHERE b = 'package.json'
  UNION ALL SELECT project, dir, CASE WHEN contains(low, 'fastapi') THEN 'fastapi' WHEN contains(low, 'django') THEN 'django' WHEN contains(low, 'flask') THEN 'flask' ELSE 'unknown' END,
    CASE WHEN regexp_matches(low, 'fastapi|django|flask') THEN 100 ELSE 50 END FROM live WHERE {_PYDEP}
  UNION ALL SELECT project, dir, CASE WHEN {_imp('fastapi')} THEN 'fastapi' WHEN {_imp('django')} THEN 'django' ELSE 'flask' END, 80 FROM live WHERE b IN ('main.py', 'app.py', 'asgi.py') AND ({_imp('fastapi')} OR {_imp('django')} OR {_imp('flask')})
  UNION ALL SELECT project, dir, 'aspnetcore', 100 FROM live WHERE regexp_matches(b, '\\.(csproj|fsproj)$') AND ((contains(content, 'PackageReference') AND contains(content, 'Microsoft.AspNetCore')) OR regexp_matches(content, 'Sdk=["'']Microsoft\\.NET\\.Sdk\\.Web["'']'))
  UNION ALL SELECT project, dir, 'nextjs', 80 FROM live WHERE b IN ('next.config.js', 'next.config.mjs')
  UNION ALL SELECT project, dir, 'unknown', 20 FROM live WHERE b = 'tsconfig.json'
  UNION ALL SELECT project, dir, 'django', 90 FROM live WHERE b = 'manage.py'
  UNION ALL SELECT project, dir, 'go', 100 FROM live WHERE b = 'go.mod'),
 sums AS (SELECT project, dir, stack, CAST(sum(points) AS BIGINT) AS points FROM pts GROUP BY ALL),
 best AS (SELECT * FROM sums QUALIFY row_number() OVER (PARTITION BY project, dir ORDER BY points DESC, stack) = 1),
 found AS MATERIALIZED (SELECT project, dir AS root, stack, points FROM best WHERE points >= 80 OR (points >= 50 AND stack = 'unknown')),
 roots AS (SELECT * FROM found UNION ALL SELECT DISTINCT project, '.', 'unknown', CAST(0 AS BIGINT) FROM repo_files WHERE project NOT IN (SELECT project FROM found))
 """


@query("detect_stack", STACK_SQL + "SELECT * FROM roots")
def _(t):
    return N.detect_stack(t.repo_files)


@query(
    "assign_project",
    STACK_SQL + """SELECT l.project, l.path, r.root, r.stack FROM live l LEFT JOIN roots r ON l.project = r.project AND (r.root = '.' OR starts_with(l.path, r.root || '/'))
    QUALIFY row_number() OVER (PARTITION BY l.project, l.path ORDER BY CASE WHEN r.root = '.' THEN 0 ELSE length(r.root) END DESC) = 1""",
)
def _(t):
    return N.assign_project(t.repo_files, N.detect_stack(t.repo_files))


_KEY_SKIP = "NOT list_has_any(string_split(path, '/')[1:-2], [" + ", ".join(D.q(d) for d in S.KEY_SKIP_DIRS) + "])"
_DEPTH = "(length(path) - length(replace(path, '/', '')))"


def _in(names) -> str:
    return "(" + ", ".join(D.q(n) for n in names) + ")"


@query(
    "key_files",
    f"""WITH roles AS (SELECT project, path, content, CASE WHEN {_DEPTH} = 0 AND {D.base('path')} IN {_in(S.MANIFEST_NAMES)} THEN 'manifest'
      WHEN {_DEPTH} = 0 AND {D.base('path')} IN {_in(S.CONFIG_NAMES)} THEN 'config'
      WHEN ({D.base('path')} IN {_in(S.ENTRY_NAMES)} OR (starts_with(path, 'cmd/') AND {D.base('path')} = 'main.go')) AND {_DEPTH} <= 3 THEN 'entrypoint'
      WHEN {D.ext('path')} IN {_in(S.KEY_CODE_EXTS)} AND {_DEPTH} <= 4 AND regexp_matches(lower({D.base('path')}), '{"|".join(S.SECURITY_WORDS)}') THEN 'security' END AS role
      FROM repo_files WHERE {_KEY_SKIP} AND content <> '')
    SELECT project, path, role, CASE WHEN length(content) > 8192 THEN left(content, 8192) || chr(10) || '... (truncated)' ELSE content END AS excerpt FROM roles WHERE role IS NOT NULL
    QUALIFY role <> 'security' OR row_number() OVER (PARTITION BY project, role ORDER BY path) <= 10""",
)
def _(t):
    return S.key_files(t.repo_files)


def _markers_sql() -> str:
    rows = [f"SELECT project, 'path' AS kind, path AS marker FROM repo_files WHERE path IN {_in(S.MARKER_PATHS)}"]
    rows += [f"SELECT DISTINCT project, 'path', '{d}' FROM repo_files WHERE starts_with(path, '{d}/')" for d in ("pages/api", "app/api")]
    for kind, deps in (("frontend", S.FRONTEND_DEPS), ("backend", S.BACKEND_DEPS)):
        rows.append(f"SELECT project, '{kind}', n FROM (SELECT project, unnest({_DEPS}) AS n FROM repo_files WHERE path = 'package.json') WHERE n IN {_in(deps)}")
    return " UNION ".join(rows)


@query("project_markers", _markers_sql())
def _(t):
    return S.project_markers(t.repo_files)


# ---- corpus and path predicates -------------------------------------------


@query(
    "read_corpus",
    f"""SELECT project, path, strlen(content) AS bytes FROM {ALL_FILES} f WHERE NOT list_has_any(string_split(path, '/')[1:-2],
      ['.git', 'node_modules', 'venv', '.venv', '__pycache__', '.next', 'dist', 'build', '.nuxt', 'vendor'])
    AND NOT regexp_matches({D.ext('path')}, '^\\.(png|jpg|jpeg|gif|ico|mp4|webm|mp3|wav|pdf|zip|tar|gz|exe|dll|so|dylib|pyc|class)$')
    AND NOT regexp_matches(lower({D.base('path')}), '\\.min\\.js$|\\.min\\.css$|\\.bundle\\.|swagger-ui|redoc\\.standalone')
    AND NOT contains(path, 'notes/k8s') AND strlen(content) <= 10485760 AND NOT contains(left(content, 512), chr(0))
    AND NOT ({D.ext('path')} IN ('.md', '.markdown') AND contains(left(content, 512), '<!-- generated-report -->'))""",
)
def _(t):
    files = corpus.corpus_filter(t.repo_files.unionByName(t.source_files), ignore_paths=("notes/k8s",))
    return files.select("project", "path", F.octet_length("content").cast("long").alias("bytes"))


@query(
    "skipped_files",
    f"""SELECT * FROM (SELECT project, path, CASE
      WHEN list_has_any(string_split(path, '/')[1:-2], ['.git', 'node_modules', 'venv', '.venv', '__pycache__', '.next', 'dist', 'build', '.nuxt', 'vendor']) THEN 'ignored folder'
      WHEN regexp_matches({D.ext('path')}, '^\\.(png|jpg|jpeg|gif|ico|mp4|webm|mp3|wav|pdf|zip|tar|gz|exe|dll|so|dylib|pyc|class)$') THEN 'ignored kind'
      WHEN regexp_matches(lower({D.base('path')}), '\\.min\\.js$|\\.min\\.css$|\\.bundle\\.|swagger-ui|redoc\\.standalone') THEN 'bundle'
      WHEN contains(path, 'notes/k8s') THEN 'excluded' WHEN strlen(content) > 10485760 THEN 'too large' WHEN contains(left(content, 512), chr(0)) THEN 'binary'
      WHEN {D.ext('path')} IN ('.md', '.markdown') AND strlen(content) > 0 AND contains(left(content, 512), '<!-- generated-report -->') THEN 'report' END AS skipped
    FROM {ALL_FILES} f) WHERE skipped IS NOT NULL""",
)
def _(t):
    return corpus.skipped_files(t.repo_files.unionByName(t.source_files), ignore_paths=("notes/k8s",))


@query("is_test_like", f"SELECT project, path, {D.test_like('path')} AS is_test FROM repo_files")
def _(t):
    return t.repo_files.select("project", "path", P.is_test_like(c("path")).alias("is_test"))


@query(
    "is_vendored",
    "SELECT project, path, regexp_matches(path, '/(node_modules|vendor|\\.git|dist|build|\\.next)/') AS vendored FROM repo_files",
)
def _(t):
    return t.repo_files.select("project", "path", P.is_vendored(c("path")).alias("vendored"))


@query(
    "ext_match",
    f"SELECT project, path FROM repo_files WHERE {D.ext('path')} IN ('.py', '.conf') OR lower({D.base('path')}) IN ('dockerfile', 'makefile')",
)
def _(t):
    return C.ext_filter(t.repo_files, (".PY", ".conf", "Dockerfile", "Makefile")).select("project", "path")


@query("exclude_paths", "SELECT project, path FROM repo_files WHERE NOT regexp_matches(path, 'notes/|node_modules')")
def _(t):
    return C.fragment_filter(t.repo_files, ("notes/", "node_modules")).select("project", "path")


@query(
    "is_source_file",
    f"SELECT project, path, regexp_extract(path, '(\\.[^./]*)$', 1) IN {_in(P.SOURCE_EXTS)} OR {D.base('path')} IN {_in(P.SOURCE_NAMES)} AS is_source FROM repo_files",
)
def _(t):
    return t.repo_files.select("project", "path", P.is_source_file(c("path")).alias("is_source"))


@query(
    "changed_files_only",
    "SELECT project, path FROM code_files f WHERE EXISTS (SELECT 1 FROM enriched e WHERE e.project = f.project AND e.file = f.path AND e.severity = 'CRITICAL')",
)
def _(t):
    changed = t.enriched.filter(c("severity") == "CRITICAL").select("project", c("file").alias("path"))
    return C.changed_files_only(t.code_files, changed).select("project", "path")


@query("drop_test_findings", f"SELECT idx, project, file FROM enriched WHERE NOT {D.test_like('file')}")
def _(t):
    return C.drop_test_findings(t.enriched).select("idx", "project", "file")


# ---- project rules by root ------------------------------------------------

ROOT_RULES = (
    Rule(id="Q-USER", name="container user", extensions=("Dockerfile", ".dockerfile"), target="all",
         pattern=r"(?m)^USER ", condition="required_pattern", severity="HIGH", suggestion="set a user"),
    Rule(id="Q-FLASK", name="flask limit", stack="flask", extensions=(".py", ".txt"), target="all", pattern=r"rate_limit",
         condition="required_pattern", severity="MEDIUM"),
    Rule(id="Q-GO", name="go logging", stack="go", extensions=(".go",), target="all", pattern=r"log_info",
         condition="required_pattern", severity="LOW"),
)
ROOT_NAME_RULES = (
    Rule(id="Q-MIDDLE", name="middleware", stack="nextjs", extensions=(".ts", ".js"), target="filename",
         pattern=r"middleware\.(ts|js)", condition="missing", severity="HIGH"),
    Rule(id="Q-MAIN", name="entry", extensions=(".py", ".js", ".go"), target="filename", pattern=r"^(app|server|main)\.",
         condition="missing", severity="LOW"),
)
ROOT_LOCK_RULES = (
    LOCK_RULE,
    Rule(id="Q-NPM", name="npm lock", stack="express", condition="missing_lockfile", severity="HIGH",
         files=("package-lock.json", "yarn.lock")),
)
_MINE = STACK_SQL + """, mine AS (SELECT l.project, l.path, l.content, r.root, r.stack FROM live l JOIN roots r ON l.project = r.project AND (r.root = '.' OR starts_with(l.path, r.root || '/'))
    QUALIFY row_number() OVER (PARTITION BY l.project, l.path ORDER BY CASE WHEN r.root = '.' THEN 0 ELSE length(r.root) END DESC) = 1) """


def _gate(r: Rule) -> str:
    return "true" if r.stack == "universal" else f"r.stack = {D.q(r.stack)}"


def _head(r: Rule) -> str:
    return f"SELECT r.project, r.root, r.stack, {D.q(r.id)} AS rule_id, {D.q(r.name)} AS name, {D.q(r.severity)} AS severity, {D.q(r.suggestion)} AS suggestion"


def _kinds(r: Rule) -> str:
    exts = ", ".join(D.q(e.lower()) for e in r.extensions)
    return f"({D.ext('m.path')} IN ({exts}) OR lower({D.base('m.path')}) IN ({exts}))"


def _own(r: Rule) -> str:
    return f"SELECT 1 FROM mine m WHERE m.project = r.project AND m.root = r.root AND {_kinds(r)}"


@query(
    "required_pattern_by_root",
    _MINE + " UNION ALL ".join(
        f"{_head(r)} FROM roots r WHERE {_gate(r)} AND EXISTS ({_own(r)}) AND NOT EXISTS ({_own(r)} AND regexp_matches(m.content, {D.q(r.pattern)}))"
        for r in ROOT_RULES
    ),
)
def _(t):
    return R.required_pattern(t.repo_files, ROOT_RULES, N.detect_stack(t.repo_files))


@query(
    "missing_filename_by_root",
    _MINE + " UNION ALL ".join(
        f"{_head(r)} FROM roots r WHERE {_gate(r)} AND NOT EXISTS ({_own(r)} AND regexp_matches({D.base('m.path')}, {D.q(r.pattern)}))"
        for r in ROOT_NAME_RULES
    ),
)
def _(t):
    return R.missing_filename(t.repo_files, t.projects, ROOT_NAME_RULES, N.detect_stack(t.repo_files))


@query(
    "missing_lockfile_by_root",
    STACK_SQL + " UNION ALL ".join(
        f"{_head(r)} FROM roots r WHERE {_gate(r)} AND NOT EXISTS (SELECT 1 FROM repo_files f WHERE f.project = r.project AND f.path IN ("
        + ", ".join(f"CASE WHEN r.root = '.' THEN {D.q(n)} ELSE r.root || {D.q('/' + n)} END" for n in r.files) + "))"
        for r in ROOT_LOCK_RULES
    ),
)
def _(t):
    return R.missing_lockfile(t.repo_files, t.projects, ROOT_LOCK_RULES, N.detect_stack(t.repo_files))


# ---- trees with ignore files ----------------------------------------------

_ROOT_IGNORES = "# left out everywhere\n*.dockerfile\ntests/\n*/notes/*.md\n!*/notes/lock.md\n!*/notes/mod.md\n*/src/h1*.go\n/proj7*/\n"
_OWN_IGNORES = "!app.dockerfile\n/src/auth*.py\n"


def _landed(files, spark) -> str:
    """The files as a packed tree in the shared folder, with ignore files at its top and in every tenth project."""
    root = f"{shared_dir(spark)}/tree-{uuid.uuid4().hex}"
    plain = root.removeprefix("file://").removeprefix("file:")
    own = files.select("project").distinct().filter(F.col("project").rlike("3$")).select(
        F.concat("project", F.lit("/.gitignore")).alias("path"), F.lit(_OWN_IGNORES).alias("content")
    )
    rows = files.select(F.concat_ws("/", "project", "path").alias("path"), "content").unionByName(own)
    trees.pack_tree(rows, root)
    with open(os.path.join(plain, ".gitignore"), "w", encoding="utf-8", newline="") as f:
        f.write(_ROOT_IGNORES)
    return root


@query(
    "read_corpus_tree",
    f"""SELECT project, path, strlen(content) AS bytes FROM repo_files f WHERE NOT list_has_any(string_split(path, '/')[1:-2],
      ['.git', 'node_modules', 'venv', '.venv', '__pycache__', '.next', 'dist', 'build', '.nuxt', 'vendor', 'tests'])
    AND NOT regexp_matches({D.ext('path')}, '^\\.(png|jpg|jpeg|gif|ico|mp4|webm|mp3|wav|pdf|zip|tar|gz|exe|dll|so|dylib|pyc|class)$')
    AND NOT regexp_matches(lower({D.base('path')}), '\\.min\\.js$|\\.min\\.css$|\\.bundle\\.|swagger-ui|redoc\\.standalone')
    AND NOT starts_with(project, 'proj7') AND NOT (regexp_matches(path, '^notes/[^/]*\\.md$') AND path NOT IN ('notes/lock.md', 'notes/mod.md'))
    AND NOT (ends_with(path, '.dockerfile') AND NOT (ends_with(project, '3') AND {D.base('path')} = 'app.dockerfile'))
    AND NOT regexp_matches(path, '^src/h1[^/]*\\.go$') AND NOT (ends_with(project, '3') AND regexp_matches(path, '^src/auth[^/]*\\.py$'))
    AND strlen(content) <= 10485760 AND NOT contains(left(content, 512), chr(0))
    AND NOT ({D.ext('path')} IN ('.md', '.markdown') AND contains(left(content, 512), '<!-- generated-report -->'))""",
)
def _(t):
    files = trees.read_corpus_tree(t.spark, _landed(t.repo_files, t.spark), packed=True)
    # The ignore files themselves are files of the tree, too.
    return files.filter(c("path") != ".gitignore").select("project", "path", F.octet_length("content").cast("long").alias("bytes"))
