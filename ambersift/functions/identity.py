"""Stable identities: fingerprints, keys and digests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .paths import normalize_path
from .text import choose, first_where, norm_lower, trimmed


def text_or_empty(col: Column) -> Column:
    return F.coalesce(col.cast("string"), F.lit(""))


def joined(sep: str, *cols: Column) -> Column:
    """concat_ws that keeps nulls as empty parts."""
    return F.concat_ws(sep, *[text_or_empty(c) for c in cols])


def sha256_hex(col: Column) -> Column:
    return F.sha2(col, 256)


def baseline_fingerprint(rule_id: Column, file: Column, evidence: Column) -> Column:
    return F.left(sha256_hex(joined("|", rule_id, file, evidence)), F.lit(24))


def finding_fingerprint(rule_id: Column, type_: Column, file: Column, line: Column, message: Column) -> Column:
    payload = joined(
        "\x00", norm_lower(rule_id), norm_lower(type_), normalize_path(file),
        F.coalesce(line, F.lit(0)), trimmed(message),
    )
    return F.left(sha256_hex(payload), F.lit(32))


def content_hash(snippet: Column) -> Column:
    return sha256_hex(trimmed(snippet))


def vuln_key(file: Column, line: Column, rule_id: Column) -> Column:
    return joined(":", file, F.coalesce(line, F.lit(0)), rule_id)


def project_hash(path: Column) -> Column:
    return F.left(sha256_hex(path), F.lit(8))


def health_dedup_key(source: Column, class_: Column, file: Column, line: Column) -> Column:
    cls, file, line = norm_lower(class_), text_or_empty(file), F.coalesce(line, F.lit(0))
    return F.when((file == "") & (line == 0), joined("|", F.lower(source), cls)).otherwise(
        joined("|", cls, F.lower(file), line)
    )


def purl(eco: Column, name: Column, version: Column) -> Column:
    """Package URL; a scoped npm name keeps its scope as namespace."""
    kind = choose(eco, {"go": "golang", "npm": "npm", "pypi": "pypi", "rubygems": "gem", "cargo": "cargo"})
    return F.coalesce(F.concat(F.lit("pkg:"), kind, F.lit("/"), name, F.lit("@"), version), F.lit(""))


def cache_namespace(schema_version: Column, fields: dict[str, Column], lists: dict[str, Column] | None = None) -> Column:
    """``v<schema>:<sha256>`` of a canonical JSON: blank fields say 'default', lists are sorted."""
    parts = [F.coalesce(F.nullif(trimmed(c), F.lit("")), F.lit("default")).alias(n) for n, c in sorted(fields.items())]
    parts += [F.array_sort(c).alias(n) for n, c in sorted((lists or {}).items())]
    doc = F.to_json(F.struct(schema_version.alias("schema_version"), *parts))
    return F.concat(F.lit("v"), schema_version.cast("string"), F.lit(":"), sha256_hex(doc))


# Keyword families of the fix guidance, first match wins.
GUIDANCE_SECRET = (
    "- Remove the exposed credential/token from tracked source, generated reports, fixtures, or docs.\n"
    "- Replace it with a safe placeholder, environment variable reference, or test-only dummy value that scanners do not classify as a secret.\n"
    "- If the secret could be real, rotate/revoke it outside the repository and include that in the final report."
)
GUIDANCE_DEBUG = (
    "- Ensure production startup never enables Flask debug mode.\n"
    "- Gate debug mode behind an explicit local-development configuration that defaults to false.\n"
    "- Prefer environment/config parsing over hardcoded debug=True."
)
GUIDANCE_TEMPLATE = (
    "- Do not render user-controlled strings as templates.\n"
    "- Use static templates and pass user input only as escaped data.\n"
    "- Add a regression case with template syntax in user input."
)
GUIDANCE_ASYNC = (
    "- Remove blocking synchronous database work from the async request path.\n"
    "- Use the project's async database/session API, or move blocking work to a controlled worker boundary.\n"
    "- Add a test or deterministic check that exercises the async handler."
)
GUIDANCE_DEFAULT = (
    "- Trace untrusted input to the vulnerable sink named by the finding.\n"
    "- Fix the boundary condition rather than suppressing the scanner result.\n"
    "- Keep the patch minimal and prove the scanner result disappears."
)


def fix_guidance(*texts: Column) -> Column:
    """Advice of the first keyword family found in any of the texts."""
    hay = F.lower(joined(" ", *texts))

    def has(*words: str) -> Column:
        out = F.lit(False)
        for w in words:
            out = out | F.contains(hay, F.lit(w))
        return out

    return first_where(
        [
            (has("gitleaks", "secret", "password", "token", "jwt"), GUIDANCE_SECRET),
            (has("flask") & has("debug"), GUIDANCE_DEBUG),
            (has("ssti", "template injection"), GUIDANCE_TEMPLATE),
            (has("async") & has("blocking", "sync"), GUIDANCE_ASYNC),
        ],
        GUIDANCE_DEFAULT,
    )


def digest_of(cols: Sequence[Column]) -> Column:
    return sha256_hex(joined("|", *cols))
