"""The scalar functions callable from SQL, as inlined SQL functions (no Python)."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .paths import VENDORED_PARTS
from .severity import CONFIDENCE, GRADES, OWASP, RANK, SEMANTIC, UNKNOWN_WEIGHT, VULN_CODES, WEIGHT
from .text import BLANKS, JWT_SHAPE, KNOWN_SECRET_SHAPE, NAMED_SECRET_SHAPE, SENSITIVE_SHAPES


def _case(subject: str, mapping: dict, default: str) -> str:
    def lit(v) -> str:
        return f"'{v}'" if isinstance(v, str) else str(v)

    arms = " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in mapping.items())
    return f"CASE {subject} {arms} ELSE {default} END"


def _blank(col: str) -> str:
    return f"btrim({col}, ' \\t\\n\\r')"


def _text(value: str) -> str:
    """A text as an SQL literal, whatever it holds."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _redacted(col: str) -> str:
    steps = ((JWT_SHAPE, "[REDACTED_JWT]"), (KNOWN_SECRET_SHAPE, "[REDACTED_SECRET]"), (NAMED_SECRET_SHAPE, "$1[REDACTED]"))
    for shape, mark in steps:
        col = f"regexp_replace({col}, {_text(shape)}, {_text(mark)})"
    return col


def definitions() -> dict[str, tuple[str, str, str]]:
    """name -> (arguments, return type, body)."""
    keys = sorted(VULN_CODES, key=lambda k: (-len(k), k))
    codes = " ".join(f"WHEN contains(lower(message), '{k}') THEN '{VULN_CODES[k]}'" for k in keys)
    grades = " ".join(f"WHEN score >= {floor} THEN '{name}'" for floor, name in GRADES)
    sev = f"upper({_blank('severity')})"
    return {
        "severity_rank": ("severity STRING", "INT", _case(sev, RANK, "9")),
        "severity_weight": (
            "severity STRING", "DOUBLE", f"CAST({_case(sev, WEIGHT, str(UNKNOWN_WEIGHT))} AS DOUBLE)"
        ),
        "source_confidence": (
            "source STRING", "DOUBLE", f"CAST({_case('lower(' + _blank('source') + ')', CONFIDENCE, '1.0')} AS DOUBLE)"
        ),
        "grade": ("score BIGINT", "STRING", f"CASE {grades} ELSE 'F' END"),
        "owasp_category": ("rule_id STRING", "STRING", _case("rule_id", OWASP, "''")),
        "semantic_class": ("rule_id STRING", "STRING", _case(f"upper({_blank('rule_id')})", SEMANTIC, "''")),
        "vuln_class_code": ("message STRING", "STRING", f"CASE {codes} ELSE 'MISC' END"),
        "rule_category": (
            "rule_id STRING", "STRING",
            "CASE WHEN instr(rule_id, '-') > 1 THEN substring_index(rule_id, '-', 1) ELSE rule_id END",
        ),
        "baseline_fingerprint": (
            "rule_id STRING, file STRING, evidence STRING", "STRING",
            "left(sha2(concat_ws('|', coalesce(rule_id, ''), coalesce(file, ''), coalesce(evidence, '')), 256), 24)",
        ),
        "content_hash": ("snippet STRING", "STRING", f"sha2({_blank('snippet')}, 256)"),
        "project_hash": ("path STRING", "STRING", "left(sha2(path, 256), 8)"),
        "vuln_key": (
            "file STRING, line INT, rule_id STRING", "STRING",
            "concat_ws(':', coalesce(file, ''), coalesce(line, 0), coalesce(rule_id, ''))",
        ),
        "normalize_confidence": (
            "confidence STRING", "STRING",
            _case(f"lower({_blank('confidence')})",
                  {"high": "high", "medium": "medium", "med": "medium", "low": "low"}, "''"),
        ),
        "redact_secrets": ("t STRING", "STRING", _redacted("t")),
        "has_sensitive_value": (
            "t STRING", "BOOLEAN",
            "coalesce(contains(lower(t), '-----begin ') OR "
            + " OR ".join(f"rlike(btrim(t, {_text(BLANKS)}), {_text(p)})" for p in SENSITIVE_SHAPES) + ", false)",
        ),
        "is_vendored": (
            "path STRING", "BOOLEAN", " OR ".join(f"contains(path, {_text(p)})" for p in VENDORED_PARTS)
        ),
        "file_extension": ("path STRING", "STRING", f"lower(regexp_extract(path, {_text(r'(\.[^./]*)\z')}, 1))"),
        "sarif_level": (
            "severity STRING", "STRING",
            _case("upper(severity)", {"CRITICAL": "error", "HIGH": "error", "LOW": "note"}, "'warning'"),
        ),
        "shannon_entropy": (
            "t STRING", "DOUBLE",
            "CASE WHEN octet_length(t) = 0 THEN 0.0D ELSE aggregate(filter(array_distinct(split(t, '')), c -> c != ''),"
            " 0.0D, (acc, c) -> acc - (length(t) - length(replace(t, c, ''))) / octet_length(t)"
            " * log2((length(t) - length(replace(t, c, ''))) / octet_length(t))) END",
        ),
    }


def register(spark: SparkSession, prefix: str = "") -> list[str]:
    """Create the functions for this session; returns their names."""
    names = []
    for name, (args, returns, body) in definitions().items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}({args}) RETURNS {returns} RETURN {body}")
        names.append(prefix + name)
    return names
