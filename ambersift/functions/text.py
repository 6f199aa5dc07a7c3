"""Text helpers that stay inside Catalyst: trimming, lines, entropy, redaction."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = " \t\n\r\x0b\x0c"


def trimmed(col: Column) -> Column:
    return F.btrim(col, F.lit(BLANKS))


def norm_upper(col: Column) -> Column:
    return F.upper(trimmed(col))


def norm_lower(col: Column) -> Column:
    return F.lower(trimmed(col))


def blank_to_null(col: Column) -> Column:
    return F.nullif(col, F.lit(""))


def choose(col: Column, mapping: Mapping, default=None) -> Column:
    """Lookup in a constant map: ``col`` is evaluated once, however long it is."""
    table = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    found = F.try_element_at(table, col)
    return found if default is None else F.coalesce(found, F.lit(default))


def first_where(pairs: Sequence[tuple[Column, object]], default=None) -> Column:
    """Value of the first true condition."""
    out = None
    for cond, value in pairs:
        value = value if isinstance(value, Column) else F.lit(value)
        out = F.when(cond, value) if out is None else out.when(cond, value)
    return out.otherwise(default if isinstance(default, Column) else F.lit(default))


def any_of(conds: Sequence[Column]) -> Column:
    out = F.lit(False)
    for cond in conds:
        out = out | cond
    return out


def all_of(conds: Sequence[Column]) -> Column:
    out = F.lit(True)
    for cond in conds:
        out = out & cond
    return out


def contains_any(col: Column, words: Sequence[str]) -> Column:
    return any_of([F.contains(col, F.lit(w)) for w in words])


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f(value)`` with ``value`` worked out a single time, however often ``f`` mentions it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def newline_count(col: Column) -> Column:
    """A newline is one byte, and bytes need no decoding to be counted."""
    return F.octet_length(col) - F.octet_length(F.replace(col, F.lit("\n"), F.lit("")))


def lines_of(col: Column) -> Column:
    return F.split(col, "\n")


def shannon_entropy(col: Column) -> Column:
    """-sum p log2 p with p = character count / byte length; 0 for empty text."""
    size = F.octet_length(col).cast("double")
    chars = F.filter(F.array_distinct(F.split(col, "")), lambda c: c != "")

    def term(acc: Column, c: Column) -> Column:
        share = (F.length(col) - F.length(F.replace(col, c, F.lit("")))) / size
        return acc - share * F.log2(share)

    return F.when(F.octet_length(col) == 0, F.lit(0.0)).otherwise(F.aggregate(chars, F.lit(0.0), term))


# A secret candidate has 16 to 128 bytes, at most 30% characters
# outside letters, digits and "-_+=/", and an entropy above 3.7.
ENTROPY_MIN_BYTES, ENTROPY_MAX_BYTES = 16, 128
ENTROPY_MAX_ODD, ENTROPY_LIMIT = 0.3, 3.7


def is_high_entropy(col: Column) -> Column:
    def judged(t: Column) -> Column:
        odd = F.length(F.regexp_replace(t, r"[\p{L}\p{Nd}\-_+=/]", ""))
        return F.when(
            F.octet_length(t).between(ENTROPY_MIN_BYTES, ENTROPY_MAX_BYTES)
            & ~F.rlike(t, F.lit(r"[^\p{L}\p{M}\p{N}\p{P}\p{S} ]"))
            & (odd / F.octet_length(t) <= ENTROPY_MAX_ODD),
            shannon_entropy(t) > ENTROPY_LIMIT,
        ).otherwise(F.lit(False))

    return once(F.btrim(col, F.lit(" \"'`\t\n\r")), judged)


def redact_preview(col: Column, limit: int = 80) -> Column:
    """Trim, cut, and mask every run of more than 12 key characters."""
    t = trimmed(col)
    cut = F.when(F.length(t) > limit, F.concat(F.left(t, F.lit(limit)), F.lit("..."))).otherwise(t)
    return F.regexp_replace(
        cut, r"([A-Za-z0-9+/=_-]{4})[A-Za-z0-9+/=_-]{5,}([A-Za-z0-9+/=_-]{4})", "$1****$2"
    )


# Shapes of credentials that must never reach a report.
JWT_SHAPE = r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{8,}"
KNOWN_SECRET_SHAPE = (
    r"(?i)\b(?:AKIA[0-9A-Z]{16}|gh[ps]_[A-Za-z0-9_]{20,}|glpat-[A-Za-z0-9\-_]{20,}"
    r"|sk_live_[A-Za-z0-9]{16,}|SG\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,})\b"
)
NAMED_SECRET_SHAPE = (
    r"(?i)((?:password|passwd|token|secret|api[_-]?key|jwt)[^\n:=]{0,40}[ \t\n\r\f]*[:=][ \t\n\r\f]*)"
    r"[`\"']?[^`\"' \t\n\r\f]{8,}([`\"']?)"
)
# Token shapes with boundaries.
SENSITIVE_SHAPES = (
    r"(?i)(^|[^A-Za-z0-9_-])sk-[A-Za-z0-9][A-Za-z0-9_-]{19,}([^A-Za-z0-9_-]|$)",
    r"(?i)(^|[^A-Za-z0-9_-])ghp_[A-Za-z0-9_]{20,}([^A-Za-z0-9_-]|$)",
    r"(?i)(^|[^A-Za-z0-9_-])github_pat_[A-Za-z0-9_]{20,}([^A-Za-z0-9_-]|$)",
    r"(?i)(^|[^A-Za-z0-9_-])xox[bp]-[A-Za-z0-9-]{20,}([^A-Za-z0-9_-]|$)",
    r"(?i)(^|[^A-Za-z0-9_-])eyj[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}([^A-Za-z0-9_-]|$)",
    r"(^|[^A-Z0-9])AKIA[0-9A-Z]{16}([^A-Z0-9]|$)",
)


def redact_secrets(col: Column) -> Column:
    t = F.regexp_replace(col, JWT_SHAPE, "[REDACTED_JWT]")
    t = F.regexp_replace(t, KNOWN_SECRET_SHAPE, "[REDACTED_SECRET]")
    return F.regexp_replace(t, NAMED_SECRET_SHAPE, "$1[REDACTED]")


def has_sensitive_value(col: Column) -> Column:
    t = trimmed(col)
    shapes = any_of([F.rlike(t, F.lit(p)) for p in SENSITIVE_SHAPES])
    return F.coalesce(F.contains(F.lower(t), F.lit("-----begin ")) | shapes, F.lit(False))


def safe_error(col: Column, limit: int = 200) -> Column:
    """First line, absolute paths masked, capped."""
    t = F.regexp_replace(F.substring_index(col, "\n", 1), r"(/[^\s:]+){2,}", "<path>")
    return F.when(F.length(t) > limit, F.concat(F.left(t, F.lit(limit)), F.lit("…"))).otherwise(t)


def display_message(col: Column, limit: int = 120) -> Column:
    cut = F.when(F.length(col) > limit, F.concat(F.left(col, F.lit(limit - 3)), F.lit("..."))).otherwise(col)
    return F.replace(F.replace(cut, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))


def extract_json(col: Column) -> Column:
    """The first fenced block, else the text from the first brace or bracket."""
    tagged = F.regexp_extract(col, r"(?s)```json(.*?)```", 1)
    plain = F.regexp_extract(col, r"(?s)```(.*?)```", 1)
    bare = F.regexp_extract(col, r"(?s)([{\[].*)", 1)
    return first_where(
        [
            (F.rlike(col, F.lit(r"(?s)```json.*?```")), trimmed(tagged)),
            (F.rlike(col, F.lit(r"(?s)```.*?```")), trimmed(plain)),
            (bare != "", trimmed(bare)),
        ],
        col,
    )


# Verdict states, and what precedes a reply that could not be read.
VERDICT_STATES = ("true_positive", "false_positive", "needs_review")
UNPARSED_PREFIX = (
    "AI analysis could not return a structured response. Manual review required. AI response: "
)


def parse_verdict(reply: Column) -> Column:
    """Struct(status, summary); malformed or unknown replies need review."""
    t = F.when(F.contains(reply, F.lit("```json")), F.substring_index(
        F.regexp_extract(reply, r"(?s)```json(.*)", 1), "```", 1)
    ).when(F.contains(reply, F.lit("```")), F.substring_index(
        F.regexp_extract(reply, r"(?s)```(.*)", 1), "```", 1)
    ).otherwise(reply)
    t = trimmed(t)
    t = F.when(~F.startswith(t, F.lit("{")) & F.contains(t, F.lit("{")),
               F.regexp_extract(t, r"(?s)(\{.*)", 1)).otherwise(t)
    t = F.when(F.contains(t, F.lit("}")), F.regexp_extract(t, r"(?s)(.*\})", 1)).otherwise(t)
    parsed = F.from_json(t, "status string, summary string, _bad string",
                         {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    ok = F.startswith(t, F.lit("{")) & parsed["_bad"].isNull()
    note = F.concat(F.lit(UNPARSED_PREFIX), reply)
    note = F.when(F.length(note) > 500, F.concat(F.left(note, F.lit(500)), F.lit("..."))).otherwise(note)
    status = F.when(ok & parsed["status"].isin(*VERDICT_STATES), parsed["status"]).otherwise("needs_review")
    summary = F.when(ok, F.coalesce(parsed["summary"], F.lit(""))).otherwise(note)
    return F.struct(status.alias("status"), summary.alias("summary"))
