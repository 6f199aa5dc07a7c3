"""Checks on single files and their lines: size, residue, secrets, context."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.paths import base_name, ext_match, extension, is_test_like, is_vendored
from ..functions.text import (
    any_of, contains_any, first_where, is_high_entropy, lines_of, newline_count, once, redact_preview,
    redact_secrets,
)
from .citations import cited_only
from .directives import directive_index, hidden_by
from .rules import GOD_FILE_LINES
from .unroll import unrolled

CODE_EXTS = (".go", ".ts", ".tsx", ".js", ".jsx", ".py")
# Words that generated scaffolding leaves behind.
PLACEHOLDER = r"(?i)(?=[tfrvp])(todo|fixme|temporary|tempVar|result\d|var\d|placeholder)"
PLACEHOLDER_WORDS = ("todo", "fixme", "temporary", "tempvar", "result", "var", "placeholder")
PLACEHOLDER_LIMIT = 5
BRITTLE_EXTS = (".go", ".js", ".ts")
BRITTLE_BYTES = 2000

# Secret formats in order of precedence.
SECRET_PATTERNS = (
    ("AWS Access Key", r"AKIA[0-9A-Z]{16}"),
    ("AWS Secret Key", r"(?i)aws_secret_access_key\s*[=:]\s*[A-Za-z0-9/+=]{40}"),
    ("Private Key", r"-----BEGIN\s+(RSA\s+|EC\s+|DSA\s+|OPENSSH\s+)?PRIVATE KEY-----"),
    ("GitHub Token", r"gh[ps]_[A-Za-z0-9_]{36,}"),
    ("GitLab Token", r"glpat-[A-Za-z0-9\-_]{20,}"),
    ("Slack Token", r"xox[baprs]-[0-9]{10,13}-[0-9]{10,13}-[a-zA-Z0-9]{24,}"),
    ("Google API Key", r"AIza[0-9A-Za-z\-_]{35}"),
    ("Generic API Key", r"""(?i)(api_key|apikey|api-key)\s*[=:]\s*["']?[A-Za-z0-9\-_]{20,}["']?"""),
    ("Generic Secret", r"""(?i)(secret|password|passwd|token)\s*[=:]\s*["'][^"']{8,}["']"""),
    ("JWT Token", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    ("Stripe Key", r"sk_live_[0-9a-zA-Z]{24,}"),
    ("SendGrid Key", r"SG\.[A-Za-z0-9_-]{22}\.[A-Za-z0-9_-]{43}"),
)
# Text that every match of a secret format contains, as is or in any case.
SECRET_MARKS = ("AKIA", "PRIVATE KEY-----", "ghp_", "ghs_", "glpat-", "xox", "AIza", "eyJ", "sk_live_", "SG.")
SECRET_WORDS = (
    "aws_secret_access_key", "api_key", "apikey", "api-key", "secret", "password", "passwd", "token",
)
# The same by vendor format, the rest of which is named by words.
VENDOR_MARKS = {
    "AWS Access Key": ("AKIA",), "Private Key": ("PRIVATE KEY-----",), "GitHub Token": ("ghp_", "ghs_"),
    "GitLab Token": ("glpat-",), "Slack Token": ("xox",), "Google API Key": ("AIza",), "JWT Token": ("eyJ",),
    "Stripe Key": ("sk_live_",), "SendGrid Key": ("SG.",),
}
VENDOR_WORDS = {"AWS Secret Key": ("aws_secret_access_key",)}
ANY_SECRET = "|".join(f"(?:{p})" for _, p in SECRET_PATTERNS)

# File kinds of the two secret heuristics.
ASSIGN_EXTS = (".go", ".py", ".ts", ".tsx", ".js", ".jsx", ".env")
CONFIG_EXTS = (".yaml", ".yml", ".json", ".toml", ".tf", ".ini", ".cfg", ".conf", ".properties", ".xml")
ASSIGNMENT = (
    r"(?i)(\w*(?:secret|password|passwd|token|api_?key)\w*)"
    r"""[ \t]*(?::=|=|:)[ \t]*["']([^"'\n]{8,})["']"""
)
# The same in a whole line, for the first match to be put in its place: no match starts inside a word, and
# a name is followed by its sign.
ASSIGNED = r"(?s)\A.*?(?<!\w)(?=\w++[ \t]*+[:=])" + ASSIGNMENT + r".*\z"
LOG_CALL = r"(?i)(?=[lpc])(?:log|print|console)\w*\s*\([^)]*\)"
LEAK_ID, SECRET_ID = "SECRET-LEAK-LOG", "ENTROPY-SECRET"

# Name parts of security-critical files, first match wins.
CRITICAL_NAMES = (
    (".env", "Environment secrets file"),
    ("secret", "Contains 'secret' in name"),
    ("credential", "Contains 'credential' in name"),
    ("password", "Contains 'password' in name"),
    ("private", "Contains 'private' in name"),
    (".pem", "PEM certificate/key file"),
    (".key", "Private key file"),
    (".p12", "PKCS12 certificate file"),
    (".pfx", "PFX certificate file"),
    ("auth", "Authentication module"),
    ("middleware", "Middleware (auth/security)"),
    ("jwt", "JWT token handling"),
    ("session", "Session management"),
    ("nginx.conf", "Nginx configuration"),
    ("dockerfile", "Container configuration"),
    ("docker-compose", "Container orchestration"),
)


def is_large(content: Column, limit: int = GOD_FILE_LINES) -> Column:
    return newline_count(content) > limit


def has_residue(path: Column, content: Column, limit: int = PLACEHOLDER_LIMIT) -> Column:
    # A byte search for the words keeps the regex off most files.
    held = once(F.lower(content), lambda t: contains_any(t, PLACEHOLDER_WORDS))
    return F.when(_is_code(path), held & (F.regexp_count(content, F.lit(PLACEHOLDER)) > limit))


def is_brittle(path: Column, content: Column) -> Column:
    return (
        extension(path).isin(*BRITTLE_EXTS)
        & (F.octet_length(content) > BRITTLE_BYTES)
        & ~F.contains(content, F.lit("err"))
        & ~F.contains(content, F.lit("catch"))
    )


def _is_code(path: Column) -> Column:
    return any_of([F.endswith(path, F.lit(e)) for e in CODE_EXTS]) & ~F.contains(path, F.lit("node_modules"))


def large_files(files: DataFrame, limit: int = GOD_FILE_LINES) -> DataFrame:
    # Counted once: a filter on the count would count again below the place where texts are made.
    n = F.filter(F.array(newline_count(F.col("content")).cast("long")), lambda n: n > limit)
    return unrolled(files, ["project", "path"], n, "newlines")


def placeholder_count(files: DataFrame, limit: int = PLACEHOLDER_LIMIT) -> DataFrame:
    n = F.regexp_count("content", F.lit(PLACEHOLDER)).cast("long")
    code = files.filter(_is_code(F.col("path")))
    return code.select("project", "path", n.alias("placeholders")).filter(F.col("placeholders") > limit)


def brittle_files(files: DataFrame) -> DataFrame:
    c = F.col("content")
    return files.filter(is_brittle(F.col("path"), c)).select("project", "path", F.octet_length(c).cast("long").alias("bytes"))


def numbered_lines(
    files: DataFrame, keep: Sequence[str], only: Callable[[Column], Column], suspect: Column | None = None
) -> DataFrame:
    """(keep.., line, text) of the lines where ``only`` holds, in files that are ``suspect``.

    The array of lines is cut before it is exploded: rows are made for hits alone."""
    spots = F.transform(lines_of(F.col("content")), lambda s, i: F.struct((i + 1).alias("line"), s.alias("text")))
    hits = F.filter(spots, lambda s: only(s["text"]))
    if suspect is not None:
        hits = F.when(suspect, hits)
    return unrolled(files, keep, hits, "s").select(*keep, "s.line", "s.text")


def may_hold_secret(text: Column) -> Column:
    """Byte searches that no secret format gets past; the regexes run on what is left."""
    return contains_any(text, SECRET_MARKS) | F.exists(F.array(F.lower(text)), lambda t: contains_any(t, SECRET_WORDS))


def secret_scan(files: DataFrame, keep: Sequence[str] = ("project", "path")) -> DataFrame:
    """Lines with a known secret format; the first format in the list wins."""
    text = F.col("text")
    # A whole-file test first: most files never become lines.
    hits = numbered_lines(
        files, keep, lambda t: may_hold_secret(t) & F.rlike(t, F.lit(ANY_SECRET)), may_hold_secret(F.col("content"))
    )
    name = first_where([(F.rlike(text, F.lit(p)), n) for n, p in SECRET_PATTERNS])
    return hits.select(*keep, "line", name.alias("pattern"), redact_preview(text).alias("preview"))


def history_leaks(hits: DataFrame, limit: int | None = 50, by: Sequence[str] = ("project",)) -> DataFrame:
    """First leak per (file, pattern, commit) of each project; a project's report holds
    ``limit`` of them, oldest first (``None``: all)."""
    keys = [*by, "path", "pattern", "commit_id"]
    first = hits.groupBy(*keys).agg(F.min(F.struct("committed_at", "line", "author", "preview")).alias("m"))
    flat = first.select(*keys, "m.*")
    if limit is None:
        return flat
    # The cap is the feature; a rank limit this small is applied before the shuffle.
    order = Window.partitionBy(*by).orderBy("committed_at", "commit_id", "path", "line", "pattern")
    return flat.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= limit).drop("_n")


def _in_scope(path: Column) -> Column:
    """Whether a file is one that ``secret_hits`` looks at."""
    return (_assigns(path) | extension(path).isin(*CONFIG_EXTS)) & ~is_test_like(path) & ~is_vendored(path)


def _assigns(path: Column) -> Column:
    return extension(path).isin(*ASSIGN_EXTS) | F.contains(F.lower(base_name(path)), F.lit(".env"))


def _vendor_kind(text: Column) -> Column:
    """First vendor format in a text, null without one; a byte search stands before each regex."""
    low = F.lower(text)
    pairs = []
    for name, pattern in SECRET_PATTERNS:
        if name in VENDOR_MARKS:
            there = contains_any(text, VENDOR_MARKS[name])
        elif name in VENDOR_WORDS:
            there = contains_any(low, VENDOR_WORDS[name])
        else:
            continue
        pairs.append((there & F.rlike(text, F.lit(pattern)), name))
    return first_where(pairs)


def secret_hits(path: Column, content: Column, directive: str | None = None, preview: bool = True) -> Column:
    """Array of (line, var_name, kind, rule_id, preview), null for files out of scope; without
    ``preview`` that field is left out."""

    def held(text: Column, words: Sequence[str]) -> Column:
        return F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(text, w))

    def taken(s: Column, assigns: Column) -> Column:
        # Name and value by a single search: a line holds no newline, what is put in its place does.
        pair = F.when(assigns, F.regexp_replace(s["text"], ASSIGNED, "$1\n$2"))
        return F.struct(s["line"].alias("line"), s["text"].alias("text"), _vendor_kind(s["text"]).alias("vendor"), pair.alias("pair"))

    def named(s: Column) -> Column:
        pair = s["pair"]
        is_secret = F.contains(pair, F.lit("\n")) & is_high_entropy(F.substring_index(pair, "\n", -1))
        name = F.when(is_secret, F.substring_index(pair, "\n", 1)).otherwise(F.lit(""))
        return F.struct(s["line"].alias("line"), s["text"].alias("text"), s["vendor"].alias("vendor"), name.alias("var"))

    def detail(s: Column, calls: Column) -> Column:
        text, name = s["text"], s["var"]
        logged = (name != "") & F.exists(calls, lambda c: F.contains(c, F.lower(name)))
        parts = [
            s["line"].alias("line"), name.alias("var_name"), F.coalesce(s["vendor"], F.lit("Secret Assignment")).alias("kind"),
            F.when(logged, F.lit(LEAK_ID)).otherwise(F.lit(SECRET_ID)).alias("rule_id"),
        ]
        return F.struct(*parts, *([redact_preview(text).alias("preview")] if preview else []))

    def of_lines(lines: Column) -> Column:
        calls = F.transform(F.regexp_extract_all(content, F.lit(LOG_CALL), F.lit(0)), lambda c: F.lower(c))
        # Calls are looked for where a variable has to be met in them.
        calls = F.when(F.exists(lines, lambda s: s["var"] != ""), calls).otherwise(F.array().cast("array<string>"))
        found = once(calls, lambda calls: F.transform(lines, lambda s: detail(s, calls)))
        if not directive:
            return found

        def shown(marks: Column) -> Column:
            hidden = hidden_by(marks)
            return F.filter(found, lambda h: ~hidden(h["line"], h["rule_id"]) & ~hidden(h["line"], F.lit(SECRET_ID)))

        # Without hits there is nothing to hide.
        return F.when(F.size(lines) > 0, once(directive_index(content, directive), shown)).otherwise(found)

    def of_file(b: Column) -> Column:
        def suspect(s: Column) -> Column:
            # A line is searched for what the file is known to hold.
            in_any_case = F.exists(F.array(F.lower(s)), lambda t: F.exists(b["words"], lambda w: F.contains(t, w)))
            return F.exists(b["marks"], lambda m: F.contains(s, m)) | ((F.size(b["words"]) > 0) & in_any_case)

        spots = F.transform(
            lines_of(content), lambda s, i: F.when(suspect(s), F.struct((i + 1).alias("line"), s.alias("text")))
        )
        # Name and value are taken from a line once, then judged, then told.
        judged = F.transform(F.transform(F.array_compact(spots), lambda s: taken(s, b["assigns"])), named)
        lines = F.filter(judged, lambda s: s["vendor"].isNotNull() | (s["var"] != ""))
        return F.when((F.size(b["marks"]) > 0) | (F.size(b["words"]) > 0), once(lines, of_lines))

    # What is asked for every line is worked out once per file.
    facts = F.struct(
        _assigns(path).alias("assigns"), held(content, SECRET_MARKS).alias("marks"),
        once(F.lower(content), lambda t: held(t, SECRET_WORDS)).alias("words"),
    )
    return F.when(_in_scope(path), once(facts, of_file))


def secret_assignments(files: DataFrame, directive: str | None = None) -> DataFrame:
    """Vendor formats in code and configuration, named high-entropy literals in
    code and env files; escalated when the variable is also logged. A directive hides a
    secret if it names the id of the hit, or that of any secret."""
    path, content = F.col("path"), F.col("content")
    # Files out of scope have a null array: a filter on the text would go below the place where it is made.
    hits = unrolled(files, ["project", "path"], secret_hits(path, content, directive), "h")
    return hits.select(
        "project", "path", "h.line", "h.var_name", "h.kind", "h.rule_id", F.lit("CRITICAL").alias("severity"), "h.preview"
    )


def secret_logged(files: DataFrame) -> DataFrame:
    """Hard-coded secrets whose variable is an argument of a log or print call."""
    return secret_assignments(files).filter(F.col("rule_id") == LEAK_ID)


def changed_files_only(files: DataFrame, changed: DataFrame) -> DataFrame:
    """The changed files; texts of others are dropped where they are read."""
    keys = changed.select("project", "path").distinct()
    # Keys are distinct. (A semi-join would be pushed below the filter by the optimizer.)
    return cited_only(files, keys, ["project", "path"]).join(keys, ["project", "path"]).select(*files.columns)


def drop_test_findings(findings: DataFrame, file_col: str = "file") -> DataFrame:
    return findings.filter(~is_test_like(F.coalesce(F.col(file_col), F.lit(""))))


def critical_files(files: DataFrame) -> DataFrame:
    """(file_path, ...) -> security-critical files with reason and risk; other columns stay."""
    low = F.lower(base_name(F.col("file_path")))
    reason = first_where([(F.contains(low, F.lit(p)), why) for p, why in CRITICAL_NAMES])
    key_file = F.rlike(low, F.lit(r"\.(?:pem|key|p12)\z")) | (low == ".env")
    return files.withColumns(
        {"reason": reason, "risk": F.when(key_file, F.lit("HIGH")).otherwise(F.lit("MEDIUM"))}
    ).filter(F.col("reason").isNotNull())


# Shapes of the two kinds of id.
CVE_ID = r"CVE-\d{4}-\d{4,}"
VULN_ID = r"CS-[A-Z0-9]+-\d{3,}"


def extract_ids(df: DataFrame, key: Sequence[str], text: str) -> DataFrame:
    """Distinct vulnerability and CVE ids mentioned in a text."""
    vuln = F.regexp_extract_all(text, F.lit(VULN_ID), F.lit(0))
    cve = F.transform(F.regexp_extract_all(text, F.lit(CVE_ID), F.lit(0)), F.upper)
    return df.select(*key, F.explode(F.array_distinct(F.concat(vuln, cve))).alias("mention"))


def integrity_check(docs: DataFrame, findings: DataFrame, key: Sequence[str], text: str) -> DataFrame:
    """Ids in a generated text that no finding has."""
    found = extract_ids(docs, key, text).distinct()
    known_ids = findings.select(F.col("vuln_id").alias("mention"))
    in_text = F.concat_ws(" ", F.coalesce("message", F.lit("")), F.coalesce("rule_id", F.lit("")))
    known_cves = findings.select(
        F.explode(F.transform(F.regexp_extract_all(in_text, F.lit(CVE_ID), F.lit(0)), F.upper)).alias("mention")
    )
    return found.join(known_ids.unionByName(known_cves).distinct(), "mention", "left_anti")


IMPORT_LINE = r"^(?:import |from |require\(|const .*require\()"


def context_window(
    findings: DataFrame, files: DataFrame, radius: int = 30, head: int = 30, fallback: int = 12
) -> DataFrame:
    """Lines around each distinct finding location, the hit line marked; secrets redacted.

    A location without a usable line (null, below 1, beyond the end) gets the first
    ``fallback`` lines. ``head`` lines are searched for imports. Locations are gathered
    per file in chunks of line numbers, so a file's text is split once per chunk and
    meets one row, not one per finding; files nobody cites do not take part."""
    line = F.col("line").cast("long")
    places = findings.select("project", "path", F.coalesce(line, F.lit(0)).alias("line")).distinct()
    chunks = places.groupBy("project", "path", F.floor(F.col("line") / 5000).alias("_chunk")).agg(
        F.collect_list("line").alias("_wanted")
    )
    texts = cited_only(files.select("project", "path", "content"), chunks, ["project", "path"])
    both = chunks.join(texts, ["project", "path"])
    both = both.withColumn("_lines", lines_of(F.col("content")))
    last = F.size("_lines").cast("long")

    def clean(s: Column) -> Column:
        return F.replace(redact_secrets(s), F.lit("```"), F.lit("'''"))

    def window(line: Column) -> Column:
        usable = line.between(1, last)
        start = F.when(usable, F.greatest(line - radius, F.lit(1))).otherwise(F.lit(1))
        end = F.when(usable, F.least(line + radius, last)).otherwise(F.least(last, F.lit(fallback)))
        part = F.slice("_lines", start.cast("int"), (end - start + 1).cast("int"))
        shown = F.transform(
            part,
            lambda s, i: F.when(
                usable,
                F.concat(
                    F.when(i + start == line, F.lit(">> ")).otherwise(F.lit("   ")),
                    (i + start).cast("string"), F.lit(": "), clean(s),
                ),
            ).otherwise(clean(s)),
        )
        return F.struct(
            line.alias("line"), start.cast("long").alias("start_line"), end.cast("long").alias("end_line"),
            F.array_join(shown, "\n").alias("snippet"),
        )

    imports = F.filter(F.slice("_lines", 1, head), lambda s: F.rlike(F.ltrim(s), F.lit(IMPORT_LINE)))
    return both.select(
        "project", "path", F.array_join(imports, "\n").alias("imports"),
        F.explode(F.transform("_wanted", window)).alias("w"),
    ).select("project", "path", "w.line", "w.start_line", "w.end_line", "w.snippet", "imports")


def ext_filter(files: DataFrame, exts: Sequence[str]) -> DataFrame:
    return files.filter(ext_match(F.col("path"), exts))


def fragment_filter(files: DataFrame, fragments: Sequence[str]) -> DataFrame:
    return files.filter(~contains_any(F.col("path"), fragments))
