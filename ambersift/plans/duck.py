"""Pieces of DuckDB SQL the oracles share, written apart from the Spark expressions."""

from __future__ import annotations

from ..functions.severity import VULN_CODES

BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"trim({x}, {BLANK})"


def case(subject: str, mapping: dict, default) -> str:
    def lit(v):
        return q(v) if isinstance(v, str) else str(v)

    arms = " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in mapping.items())
    return f"CASE {subject} {arms} ELSE {lit(default)} END"


def rank(x: str, default: int = 9) -> str:
    return case(f"upper({strip(x)})", {"CRITICAL": 0, "HIGH": 1, "MEDIUM": 2, "LOW": 3}, default)


def level(x: str) -> str:
    return case(f"upper({x})", {"CRITICAL": 4, "HIGH": 3, "MEDIUM": 2, "LOW": 1}, 0)


def base(p: str) -> str:
    return f"string_split({p}, '/')[-1]"


def ext(p: str) -> str:
    return f"lower(regexp_extract({p}, '(\\.[^./]*)$', 1))"


def folder(p: str) -> str:
    return f"CASE WHEN contains({p}, '/') THEN regexp_replace({p}, '/[^/]*$', '') ELSE '.' END"


def clean(p: str) -> str:
    up = (
        "CASE WHEN a = '' OR ends_with(a, '/..') THEN (CASE WHEN starts_with({p}, '/') THEN a ELSE a || '/..' END) "
        "ELSE regexp_replace(a, '/[^/]*$', '') END"
    ).replace("{p}", p)
    fold = (
        f"list_reduce(list_prepend('', string_split({p}, '/')), lambda a, x: "
        f"CASE WHEN x IN ('', '.') THEN a WHEN x = '..' THEN {up} ELSE a || '/' || x END)"
    )
    return (
        f"CASE WHEN starts_with({p}, '/') THEN coalesce(nullif({fold}, ''), '/') "
        f"ELSE coalesce(nullif(substr({fold}, 2), ''), '.') END"
    )


def normal(p: str) -> str:
    t = f"replace({strip(p)}, '\\', '/')"
    for lead in ("/src/", "\\./", "/"):
        t = f"regexp_replace({t}, '^{lead}', '')"
    return f"CASE WHEN {strip(p)} = '' THEN '' ELSE lower({clean(t)}) END"


def fingerprint(rule="rule_id", type_="type", file="file", line="line", message="message") -> str:
    return (
        f"left(sha256(lower({strip(rule)}) || chr(0) || lower({strip(type_)}) || chr(0) || {normal(file)} || chr(0) || "
        f"CAST({line} AS VARCHAR) || chr(0) || {strip(message)}), 32)"
    )


def test_like(p: str) -> str:
    c = f"lower({clean(p)})"
    b = f"string_split({c}, '/')[-1]"
    stem = f"regexp_replace({b}, '\\.[^.]*$', '')"
    dirs = "['test','tests','testdata','__tests__','mock','mocks','__mocks__','fixture','fixtures','__fixtures__','spec','specs','__specs__']"
    ends = " OR ".join(
        f"starts_with({stem}, '{w}_') OR ends_with({stem}, '_{w}')" for w in ("test", "mock", "spec")
    )
    marks = " OR ".join(f"contains({b}, '.{w}.')" for w in ("test", "mock", "spec"))
    return f"(list_has_any(string_split({c}, '/'), {dirs}) OR {b} = 'conftest.py' OR {marks} OR {ends})"


def type_order(x: str) -> str:
    return case(f"lower({strip(x)})", {"core": 0, "external": 1, "nfr": 2, "deploy": 3, "network": 4}, 9)


def semantic(x: str) -> str:
    return case(
        f"upper({strip(x)})",
        {
            "FAST-LAZY-EXC": "exception_swallow", "B110": "exception_swallow",
            "FAST-AUTH": "missing_authentication", "NFR-API-003": "missing_authentication",
            "FAST-RATELIMIT": "missing_rate_limiting", "NFR-API-001": "missing_rate_limiting",
            "FAST-CORS": "missing_cors_policy", "NFR-API-002": "missing_cors_policy",
        },
        "",
    )


def vuln_code(x: str) -> str:
    """Longest keyword first, then by name, as a ranked look-up."""
    rows = ", ".join(f"{{'k': {q(k)}, 'c': {q(c)}}}" for k, c in sorted(VULN_CODES.items(), key=lambda i: (-len(i[0]), i[0])))
    return f"coalesce(list_filter([{rows}], lambda s: contains(lower({x}), s.k))[1].c, 'MISC')"


def owasp(x: str) -> str:
    from ..functions.severity import OWASP

    return case(x, OWASP, "")


def grade(x: str) -> str:
    return (
        f"CASE WHEN {x} >= 100 THEN 'A+' WHEN {x} >= 90 THEN 'A' WHEN {x} >= 80 THEN 'B' WHEN {x} >= 65 THEN 'C' "
        f"WHEN {x} >= 50 THEN 'D' ELSE 'F' END"
    )


def big(x: str) -> str:
    return f"CAST({x} AS BIGINT)"


def lines(alias: str = "f", content: str = "content") -> str:
    """Lateral join of a file's lines as u(text, line)."""
    return f"unnest(string_split({alias}.{content}, chr(10))) WITH ORDINALITY AS u(text, line)"


def newlines(x: str) -> str:
    return f"(length({x}) - length(replace({x}, chr(10), '')))"


def hit_line(text: str, pattern: str) -> str:
    """Line of the first match in the linear-time dialect, 0 without one."""
    before = f"regexp_extract({text}, {q('(?s)' + chr(92) + 'A(.*?)(?:(?-s:' + pattern + '))')}, 1)"
    return f"CASE WHEN regexp_matches({text}, {q(pattern)}) THEN {newlines(before)} + 1 ELSE 0 END"


TOKEN = (
    '"""(?s:.*?)(?:"""|\\z)' "|'''(?s:.*?)(?:'''|\\z)" "|/\\*(?s:.*?)(?:\\*/|\\z)" "|(?://|#)[^\\n\\r]*[\\n\\r]?"
    '|"(?:[^"\\\\]|\\\\(?s:.))*(?:"|\\\\?\\z)' "|'(?:[^'\\\\]|\\\\(?s:.))*(?:'|\\\\?\\z)"
    "|`(?:[^`\\\\]|\\\\(?s:.))*(?:`|\\\\?\\z)" "|[^\"'`/#]+|/"
)


def code_view(content: str) -> str:
    keep_nl = "regexp_replace(t, '[^\\n]', '', 'g')"
    bare = "regexp_replace(t, '\\\\(?s:.)', '', 'g')"
    one = (
        "CASE WHEN starts_with(t, '\"\"\"') OR starts_with(t, '''''''') OR starts_with(t, '/*') THEN " + keep_nl
        + " WHEN starts_with(t, '//') OR starts_with(t, '#') THEN regexp_replace(t, '[^\\n\\r]', '', 'g')"
        + " WHEN t[1] IN ('\"', '''', '`') THEN t[1] || " + keep_nl
        + f" || CASE WHEN length({bare}) > 1 AND ends_with({bare}, t[1]) THEN t[1] ELSE '' END"
        + " ELSE t END"
    )
    return f"array_to_string(list_transform(regexp_extract_all({content}, {q(TOKEN)}), lambda t: {one}), '')"


def docs_view(content: str) -> str:
    readable = (
        "starts_with(t, '/*') OR starts_with(t, '//') OR starts_with(t, '#') OR t[1] IN ('\"', '''', '`')"
    )
    one = f"CASE WHEN {readable} THEN t ELSE regexp_replace(t, '[^\\n]', ' ', 'g') END"
    return f"array_to_string(list_transform(regexp_extract_all({content}, {q(TOKEN)}), lambda t: {one}), '')"


WEIGHT10 = {"CRITICAL": 180, "HIGH": 90, "MEDIUM": 30, "LOW": 10, "INFO": 0}
CONF10 = {"trivy": 9, "deploy": 8, "network": 7, "nfr": 6}


def tenths(sev: str, source: str) -> str:
    """Effective weight in tenths, as whole numbers."""
    w = case(f"upper({strip(sev)})", WEIGHT10, 20)
    c = case(f"lower({strip(source)})", CONF10, 10)
    return f"CAST(({w}) * ({c}) // 10 AS BIGINT)"
