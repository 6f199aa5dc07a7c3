"""Fix plans and proposed line rewrites; nothing is written to source files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import extension
from ..functions.text import first_where, lines_of
from .citations import cited_only

# Fix prompt by rule id, then the default.
FIX_PROMPTS = {
    "ENTROPY-SECRET": (
        "Open %s line %d. The hardcoded secret must be moved to an environment variable. Replace the literal value"
        " with os.Getenv(\"VAR_NAME\") in Go, process.env.VAR_NAME in Node.js, or os.environ.get(\"VAR_NAME\") in"
        " Python. Add the variable to .env.example without the value."
    ),
    "ENTR-FRAGILE": (
        "Add error handling to %s (line %d area). The file has many lines but missing error handling patterns. Wrap"
        " risky operations in error checks."
    ),
    "ENTR-04": (
        "Remove AI assistant chat residue from %s (line %d). Comments like \"As an AI\" or \"I cannot\" should not"
        " appear in production code. Clean up all such comments."
    ),
}
DEFAULT_PROMPT = (
    "Fix the security issue at %s line %d. Review the code and apply appropriate security controls."
)

# Assignments that can be rewritten without a person.
GO_SECRET = r'(\w+)\s*:?=\s*"[^"]{8,}"'
PY_SECRET = r"""(\w+)\s*=\s*["'][^"']{8,}["']"""
JS_SECRET = r"""(const|let|var)\s+(\w+)\s*=\s*["'][^"']{8,}["']"""
PY_DEBUG = r"(?i)(DEBUG\s*=\s*)True"
RUN_DEBUG = r"(?i)(app\.run\([^)]*debug\s*=\s*)True"
DEBUG_CHECK = '$1os.environ.get("DEBUG", "False") == "True"'
SECRET_RULES, DEBUG_RULES = ("ENTR-17", "ENTROPY-SECRET"), ("ENTR-18",)


def fix_plan(findings: DataFrame) -> DataFrame:
    """Prompt and bucket per finding: (rule_id, severity, file, line, ..)."""
    file, line = F.coalesce("file", F.lit("")), F.coalesce("line", F.lit(0))

    def text(prompt: str):
        head, tail = prompt.split("%s")
        mid, end = tail.split("%d")
        return F.concat(F.lit(head), file, F.lit(mid), line.cast("string"), F.lit(end))

    prompt = first_where([(F.col("rule_id") == r, text(p)) for r, p in FIX_PROMPTS.items()], text(DEFAULT_PROMPT))
    bucket = first_where([(F.col("severity") == s, s.lower()) for s in ("CRITICAL", "HIGH")], "medium")
    return findings.withColumns({"fix_prompt": prompt, "bucket": bucket})


def suggest_fix(findings: DataFrame, files: DataFrame) -> DataFrame:
    """Before and after of the lines a rule can rewrite by itself.

    Only findings of those rules reach the join with texts. A secret is rewritten
    on the finding's line, a debug flag on every line of the file that sets it."""
    ext = extension(F.col("path"))
    kind = first_where(
        [
            (F.col("rule_id").isin(*SECRET_RULES) & ext.isin(".go", ".py", ".ts", ".js"), "secret"),
            (F.col("rule_id").isin(*DEBUG_RULES) & (ext == ".py"), "debug"),
        ]
    )
    todo = findings.select("project", "path", "rule_id", "line", kind.alias("_kind")).filter(
        F.col("_kind").isNotNull()
    ).distinct()
    texts = cited_only(files.select("project", "path", "content"), todo, ["project", "path"])
    both = todo.join(texts, ["project", "path"])
    both = both.withColumn("_lines", lines_of(F.col("content")))
    numbered = F.transform("_lines", lambda s, i: F.struct((i + 1).alias("n"), s.alias("t")))
    own_line = F.filter(numbered, lambda s: s["n"] == F.col("line"))
    debug_lines = F.filter(numbered, lambda s: F.rlike(s["t"], F.lit(PY_DEBUG)) | F.rlike(s["t"], F.lit(RUN_DEBUG)))
    picked = F.when(F.col("_kind") == "secret", own_line).otherwise(debug_lines)
    rows = both.select("project", "path", "rule_id", "_kind", F.explode(picked).alias("s")).select(
        "project", "path", "rule_id", "_kind", F.col("s.n").alias("line"), F.col("s.t").alias("before")
    )
    t = F.col("before")
    # A replacement cannot change case, so the first name on the line sets the variable.
    go_var = F.upper(F.regexp_extract(t, GO_SECRET, 1))
    py_var = F.upper(F.regexp_extract(t, PY_SECRET, 1))
    js_var = F.upper(F.regexp_extract(t, JS_SECRET, 2))

    def rewrite(pattern: str, *parts):
        return F.regexp_replace(t, F.lit(pattern), F.concat(*parts))

    secret = first_where(
        [
            ((ext == ".go") & F.rlike(t, F.lit(GO_SECRET)),
             rewrite(GO_SECRET, F.lit('$1 = os.Getenv("'), go_var, F.lit('")'))),
            ((ext == ".py") & F.rlike(t, F.lit(PY_SECRET)),
             rewrite(PY_SECRET, F.lit('$1 = os.environ.get("'), py_var, F.lit('", "")'))),
            (ext.isin(".ts", ".js") & F.rlike(t, F.lit(JS_SECRET)),
             rewrite(JS_SECRET, F.lit("$1 $2 = process.env."), js_var)),
        ]
    )
    debug = F.when(F.rlike(t, F.lit(PY_DEBUG)), F.regexp_replace(t, PY_DEBUG, DEBUG_CHECK)).otherwise(
        F.regexp_replace(t, RUN_DEBUG, DEBUG_CHECK)
    )
    after = F.when(F.col("_kind") == "secret", secret).otherwise(debug)
    return rows.withColumn("after", after).filter(F.col("after").isNotNull()).drop("_kind")


# What to do by hand where no rewrite applies: by rules and file kinds, the first that fits.
BY_HAND = (
    (SECRET_RULES, (".go",), "Read the secret with os.Getenv() and keep its value out of the code."),
    (SECRET_RULES, (".py",), "Read the secret with os.environ.get() and keep its value out of the code."),
    (SECRET_RULES, (".ts", ".js"), "Read the secret from process.env and keep its value out of the code."),
    (SECRET_RULES, (), "Move the secret to an environment variable or a secret store."),
    (DEBUG_RULES, (), "Let an environment variable switch the debug mode on."),
    (("FAST-SSTI",), (), "Pass user input to the template as a variable; do not build the template from it."),
    (
        ("FAST-CORS", "FLASK-CORS"), (".py",),
        "Add CORS middleware to the application, with the allowed origins from the environment.",
    ),
    (("FAST-CORS", "FLASK-CORS"), (), "Add the CORS middleware of the framework, with a list of allowed origins."),
    (("ENTR-02",), (), "Create a lock file: pip freeze > requirements.lock, pip-compile, or uv lock."),
)


def fix_proposals(findings: DataFrame, files: DataFrame) -> DataFrame:
    """At least one proposal per distinct finding (project, path, rule_id, line): ``kind`` is
    'rewrite' (``fix_line``, ``before``, ``after``; one row per line), 'manual' (``advice``) or
    'failed' (``advice`` says that the file is not there or has no such line). A finding
    without a file, as project rules give, is advised on by hand."""
    keys = ["project", "path", "rule_id", "line"]
    todo = findings.select(*keys).distinct()
    path = F.coalesce("path", F.lit(""))
    own_line = F.col("rule_id").isin(*SECRET_RULES)
    # A secret is rewritten on its line, a debug flag anywhere in the file.
    at = F.when(own_line, F.col("line").cast("int"))
    edits = suggest_fix(findings, files).select(
        "project", "path", "rule_id", at.alias("_at"), F.col("line").cast("int").alias("fix_line"), "before", "after"
    ).distinct()
    left = todo.withColumn("_at", at)
    same = [left[c].eqNullSafe(edits[c]) for c in ("project", "path", "rule_id", "_at")]
    rows = left.join(edits, same, "left").select(*[left[c] for c in keys], "fix_line", "before", "after")
    # Only files whose lines a rewrite would need are looked up.
    needs = F.col("rule_id").isin(*SECRET_RULES, *DEBUG_RULES) & F.col("after").isNull() & (path != "")
    asked = rows.filter(needs).select("project", "path").distinct()
    sizes = cited_only(files.select("project", "path", "content"), asked, ["project", "path"]).groupBy("project", "path").agg(
        F.max(F.size(lines_of(F.col("content")))).alias("_lines")
    )
    rows = rows.join(sizes, ["project", "path"], "left")
    advice = F.lit(None).cast("string")
    for rules, exts, text in reversed(BY_HAND):
        fits = F.col("rule_id").isin(*rules)
        advice = F.when(fits & extension(path).isin(*exts) if exts else fits, F.lit(text)).otherwise(advice)
    advice = F.coalesce(advice, F.lit("Review the finding; no rewrite is known for its rule."))
    outside = own_line & ~F.coalesce(F.col("line").between(1, F.col("_lines")), F.lit(False))
    problem = first_where([(F.col("_lines").isNull(), "the file is not there"), (outside, "the file has no such line")])
    problem = F.when(needs, problem)
    kind = first_where([(F.col("after").isNotNull(), "rewrite"), (problem.isNotNull(), "failed")], "manual")
    rows = rows.withColumns({"kind": kind, "advice": F.when(F.col("after").isNull(), F.coalesce(problem, advice))})
    return rows.select(*keys, "kind", "fix_line", "before", "after", "advice")
