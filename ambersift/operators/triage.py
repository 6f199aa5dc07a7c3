"""Verdicts: cache, gates, validation, fallback, hand-off and artifacts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.identity import joined, sha256_hex
from ..functions.paths import normalize_path
from ..functions.severity import normalize_confidence, severity_rank
from ..functions.text import (
    display_message, first_where, has_sensitive_value, lines_of, norm_upper, trimmed,
)
from .citations import cited_only
from .ordering import rank_within

# Dispositions, and the texts of verdicts nobody gave.
TRUE_POSITIVE, FALSE_POSITIVE, REVIEW = "True Positive", "False Positive", "Needs Manual Review"
DISPOSITIONS = (TRUE_POSITIVE, FALSE_POSITIVE, REVIEW)
BUDGET_RATIONALE = (
    "Exceeded the LLM triage budget; defaulting to Needs Manual Review for safety (never auto-suppressed)."
)
FALLBACK_RATIONALE = "No verdict was returned; defaulting to Needs Manual Review (never auto-suppressed)."


def is_triage_test_path(path: Column) -> Column:
    """The narrower test-path notion of evidence checks; a last segment ``test`` counts."""
    p = F.concat(F.lit("/"), F.lower(normalize_path(path)), F.lit("/"))
    return F.rlike(p, F.lit(r"/tests?/|_test\.(?:go|py)/\z|\.(?:test|spec)\.[^/]*/\z"))


def _inside(path: Column, root: str | None) -> Column:
    """``path`` relative to the project folder ``root`` if it is an absolute one below it."""
    if not root:
        return normalize_path(path)
    top = root.rstrip("/") + "/"
    return normalize_path(F.when(F.startswith(path, F.lit(top)), F.substr(path, F.lit(len(top) + 1))).otherwise(path))


def validate_fp_evidence(verdicts: DataFrame, findings: DataFrame, files: DataFrame, root: str | None = None) -> DataFrame:
    """Check identity and, for false positives, the cited evidence.

    verdicts: idx, seq, finding_id, v_fingerprint, disposition, basis, ev_file,
    ev_line, observed; findings: idx, vuln_id, fingerprint, project, file, line.
    Absolute paths below ``root`` are those of the project. Citations are gathered per
    file first: a text is split once and gives only the cited lines to the verdicts."""
    known = findings.select("idx", "vuln_id", "fingerprint", "project", "file", "line")
    rows = verdicts.join(known, "idx", "left")
    same_file = _inside(F.col("file"), root) == _inside(F.col("ev_file"), root)
    cites = (F.col("disposition") == FALSE_POSITIVE) & (F.coalesce("ev_file", F.lit("")) != "") & same_file
    rows = rows.withColumns(
        {
            "_f": F.when(cites, _inside(F.col("ev_file"), root)),
            "_at": F.when(cites, F.greatest(F.coalesce("ev_line", F.lit(0)), F.lit(1)).cast("int")),
            "_p": F.col("project"),
        }
    )
    # Chunks of line numbers bound the list of a file that very many verdicts cite.
    spots = rows.select("_p", "_f", "_at").dropna().distinct().groupBy("_p", "_f", F.floor(F.col("_at") / 5000).alias("_c"))
    spots = spots.agg(F.collect_list("_at").alias("_wanted"))
    texts = files.select(
        F.col("project").alias("_p"), _inside(F.col("path"), root).alias("_f"), F.col("content").alias("_text")
    )
    texts = cited_only(texts, spots, ["_p", "_f"]).join(spots, ["_p", "_f"])
    texts = texts.withColumn("_lines", lines_of(F.col("_text"))).select(
        "_p", "_f",
        F.explode(F.transform("_wanted", lambda n: F.struct(n.alias("_at"), F.try_element_at("_lines", n).alias("_cited")))).alias("s"),
    )
    texts = texts.select("_p", "_f", "s._at", "s._cited", F.lit(True).alias("_there"))
    rows = rows.join(texts, ["_p", "_f", "_at"], "left")
    there, cited = F.col("_there").isNotNull(), F.col("_cited")
    test_only, code = F.col("basis") == "test_only", F.col("basis") == "code_mitigation"
    line, ev_line = F.coalesce("line", F.lit(0)), F.coalesce("ev_line", F.lit(0))
    observed = F.coalesce("observed", F.lit(""))
    no_file = F.coalesce("ev_file", F.lit("")) == ""
    fp_reason = first_where(
        [
            (F.col("basis").isNull(), "no_evidence"),
            (test_only & ~is_triage_test_path(F.coalesce("file", F.lit(""))),
             "test_only_not_a_test"),
            (test_only & no_file, "test_only_no_file"),
            (test_only & ~there, "test_only_bad_file"),
            (test_only & (ev_line > 0) & (line > 0) & (ev_line != line),
             "test_only_other_line"),
            (test_only, ""),
            (code & (no_file | (ev_line < 1) | (F.octet_length(trimmed(observed)) < 4)),
             "code_incomplete"),
            (code & ~there, "code_bad_file"),
            (code & cited.isNull(), "code_no_such_line"),
            (code & ~F.contains(cited, observed), "code_not_in_source"),
            (code, ""),
        ],
        "unverifiable_basis",
    )
    reason = first_where(
        [
            (F.col("vuln_id").isNull(), "unknown_finding"),
            (~F.col("disposition").isin(*DISPOSITIONS), "unknown_disposition"),
            (F.col("finding_id") != F.col("vuln_id"), "other_finding_id"),
            (F.col("v_fingerprint") != F.col("fingerprint"), "other_fingerprint"),
            (F.col("disposition") == FALSE_POSITIVE, fp_reason),
        ],
        "",
    )
    return rows.select(*verdicts.columns, reason.alias("reason"))


def validate_verdicts(raw: DataFrame, findings: DataFrame, files: DataFrame) -> DataFrame:
    """Accept the first valid verdict of each finding; say why the others fail."""
    checked = validate_fp_evidence(raw, findings, files)
    taken = checked.filter(F.col("reason") == "").groupBy("idx").agg(F.min("seq").alias("_taken"))
    out = checked.join(taken, "idx", "left")
    late = F.col("_taken").isNotNull() & (F.col("seq") > F.col("_taken"))
    shape_error = F.col("reason").isin("unknown_finding", "unknown_disposition")
    reason = F.when(late & ~shape_error, F.lit("later_duplicate")).otherwise(F.col("reason"))
    return out.withColumn("reason", reason).withColumn("accepted", F.col("reason") == "").drop("_taken")


def incomplete_findings(findings: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Findings that do not have exactly one verdict."""
    n = verdicts.groupBy("idx").agg(F.count(F.lit(1)).alias("verdicts"))
    return (
        findings.select("idx").join(n, "idx", "left").fillna(0, subset=["verdicts"]).filter(F.col("verdicts") != 1)
    )


def _review(findings: DataFrame, rationale: Column | str, source: str) -> DataFrame:
    text = F.lit(rationale) if isinstance(rationale, str) else rationale
    return findings.select(
        "idx", "fingerprint", F.lit(REVIEW).alias("disposition"), text.alias("rationale"),
        F.lit("low").alias("confidence"), F.lit(source).alias("disposition_source"),
    )


def fallback_verdicts(findings: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Findings without a verdict need review; they are never closed."""
    rest = findings.join(verdicts.select("idx").distinct(), "idx", "left_anti")
    return _review(rest, FALLBACK_RATIONALE, "nr-fallback")


def verdict_cache_lookup(unique: DataFrame, cache: DataFrame, files: DataFrame, namespace: str) -> DataFrame:
    """Reuse cached verdicts by fingerprint; a cached false positive counts only
    while its evidence still holds."""
    entries = cache.filter(F.col("namespace") == namespace).select(
        F.col("fingerprint"), "disposition", "rationale", "confidence", "basis", "ev_file", "ev_line", "observed"
    )
    both = unique.join(entries, "fingerprint", "left")
    cached_fp = both.filter(F.col("disposition") == FALSE_POSITIVE).select(
        "idx", F.lit(0).alias("seq"), F.col("vuln_id").alias("finding_id"), F.col("fingerprint").alias("v_fingerprint"),
        "disposition", "basis", "ev_file", "ev_line", "observed",
    )
    stale = validate_fp_evidence(cached_fp, unique, files).filter(F.col("reason") != "").select(
        "idx", F.lit(True).alias("_stale")
    )
    out = both.join(stale, "idx", "left")
    state = first_where(
        [(F.col("disposition").isNull(), "miss"), (F.col("_stale").isNotNull(), "invalidated")], "hit"
    )
    hit = state == "hit"
    return out.select(
        "idx", "fingerprint", state.alias("state"),
        F.when(hit, F.col("disposition")).alias("disposition"), F.when(hit, F.col("confidence")).alias("confidence"),
    )


def gate_severity(findings: DataFrame, on: bool) -> DataFrame:
    """With gating on only CRITICAL and HIGH go to triage; the others get a fixed review verdict."""
    sev = norm_upper(F.col("severity"))
    passes = sev.isin("CRITICAL", "HIGH") if on else F.lit(True)
    label = F.coalesce(F.nullif(sev, F.lit("")), F.lit("UNKNOWN"))
    note = F.concat(
        F.lit("Severity "), label,
        F.lit(" is below the LLM triage threshold (gating). Not auto-suppressed; manual review recommended."),
    )
    return findings.select(
        *findings.columns, passes.alias("to_triage"), F.when(~passes, F.lit(REVIEW)).alias("disposition"),
        F.when(~passes, note).alias("rationale"),
        F.when(~passes, F.lit("deterministic")).alias("disposition_source"),
    )


def llm_budget(findings: DataFrame, order: Sequence[str], budget: int, by: Sequence[str] = ()) -> DataFrame:
    """The first ``budget`` findings (of each run, if ``by`` names one) are sent, the rest
    fall back to review. Ranks come from slices, so neither a large budget nor a hot run
    is sorted in one task; order columns must tell rows apart."""
    if budget < 0:
        return findings.withColumn("sent", F.lit(True))
    keys = findings.select(*by, *[c for c in order if c not in by])
    ranked = rank_within(keys, list(by), [F.col(c) for c in order], "_rank").filter(F.col("_rank") <= budget)
    out = findings.join(ranked.withColumn("_in", F.lit(True)).drop("_rank"), keys.columns, "left")
    return out.withColumn("sent", F.coalesce("_in", F.lit(False))).drop("_in")


def budget_fallback(findings: DataFrame, order: Sequence[str], budget: int, by: Sequence[str] = ()) -> DataFrame:
    """Review verdicts for the findings beyond the budget."""
    over = llm_budget(findings, order, budget, by).filter(~F.col("sent"))
    return _review(over, BUDGET_RATIONALE, "nr-fallback")


def verdict_source_metrics(findings: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Findings, unique, deduped, then counts by verdict source and by disposition, in long form."""
    sizes = findings.agg(
        F.count(F.lit(1)).alias("findings"), F.countDistinct("fingerprint").alias("unique")
    ).select(
        F.explode(
            F.array(
                F.struct(F.lit("findings").alias("metric"), F.col("findings").alias("n")),
                F.struct(F.lit("unique").alias("metric"), F.col("unique").alias("n")),
                F.struct(F.lit("deduped").alias("metric"), (F.col("findings") - F.col("unique")).alias("n")),
            )
        ).alias("m")
    ).select("m.metric", "m.n")
    flat = verdicts.select(
        F.explode(
            F.array(
                F.concat(F.lit("source:"), F.col("disposition_source")),
                F.concat(F.lit("disposition:"), first_where(
                    [(F.col("disposition").isin(TRUE_POSITIVE, FALSE_POSITIVE), F.col("disposition"))], REVIEW)),
            )
        ).alias("metric")
    )
    return sizes.unionByName(flat.groupBy("metric").agg(F.count(F.lit(1)).alias("n")))


def severity_by_disposition(findings: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Matrix of true positives and reviews by severity; zeros are kept."""
    levels = ("CRITICAL", "HIGH", "MEDIUM", "LOW")
    both = findings.select("idx", F.upper("severity").alias("_s")).join(
        verdicts.select("idx", "disposition"), "idx"
    )
    counts = both.groupBy("disposition").agg(*[F.count_if(F.col("_s") == s).alias(s.lower()) for s in levels])
    rows = findings.sparkSession.createDataFrame([(TRUE_POSITIVE,), (REVIEW,)], "disposition string")
    return rows.join(counts, "disposition", "left").fillna(0)


def actionable(findings: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Findings that are not false positives, with their disposition."""
    return findings.join(verdicts.select("idx", "disposition", "rationale"), "idx").filter(
        F.col("disposition") != FALSE_POSITIVE
    )


def top_critical(findings: DataFrame, verdicts: DataFrame, n: int = 5, by: Sequence[str] = ()) -> DataFrame:
    """Up to ``n`` actionable findings (of each run, if ``by`` names one), CRITICAL before
    HIGH, then in index order, with their ``place``."""
    sev = F.upper("severity")
    rows = actionable(findings, verdicts).filter(sev.isin("CRITICAL", "HIGH"))
    # The cap is the feature; a rank limit this small is applied before the shuffle.
    order = Window.partitionBy(*by).orderBy(severity_rank(F.col("severity")), "idx")
    return rows.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= n)


def handoff(findings: DataFrame, verdicts: DataFrame, gates: DataFrame, by: Sequence[str]) -> DataFrame:
    """Actionable findings with recommendation, next to their project's score and gate status."""
    rows = actionable(findings, verdicts).join(gates.select(*by, "score", "grade", "status"), list(by), "left")
    title = F.replace(display_message(F.col("message")), F.lit("\\|"), F.lit("|"))
    return rows.select(
        *by, "idx", F.col("vuln_id"), "severity", "file", "line", title.alias("title"), "disposition",
        F.coalesce("rationale", F.lit("")).alias("recommendation"), "score", "grade",
        F.when(F.col("status") == "passed", F.lit("PASSED")).otherwise(F.lit("FAILED")).alias("gate_status"),
    )


def handoff_totals(findings: DataFrame, verdicts: DataFrame, by: Sequence[str]) -> DataFrame:
    rows = findings.select(*by, "idx").join(verdicts.select("idx", "disposition"), "idx")
    d = F.col("disposition")
    return rows.groupBy(*by).agg(
        F.count_if(d == TRUE_POSITIVE).alias("true_positives"),
        F.count_if(d == FALSE_POSITIVE).alias("false_positives"),
        F.count_if(~d.isin(TRUE_POSITIVE, FALSE_POSITIVE)).alias("needs_review"),
        F.count(F.lit(1)).alias("total"),
    )


def triage_artifact(findings: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Every finding with its verdict as one JSON document per row.

    A finding without exactly one verdict fails the job."""
    per = verdicts.groupBy("idx").agg(
        F.count(F.lit(1)).alias("_n"),
        F.min(F.struct("disposition", "rationale", "confidence", "disposition_source")).alias("_v"),
    )
    rows = findings.join(per, "idx", "left")
    bad = F.concat(F.lit("finding without exactly one verdict: "), F.col("idx").cast("string"))
    doc = F.to_json(
        F.struct(
            F.col("idx").alias("finding_index"),
            F.struct(*[c for c in findings.columns if c != "idx"]).alias("finding"),
            F.col("_v").alias("disposition"),
        )
    )
    checked = F.when(F.coalesce("_n", F.lit(0)) != 1, F.raise_error(bad)).otherwise(doc)
    return rows.select("idx", F.col("_v.disposition").alias("disposition"), checked.alias("document"))


def uncached_verdicts(verdicts: DataFrame) -> DataFrame:
    """Verdicts a re-run must ask for again: fallbacks, and texts too sensitive to keep."""
    sensitive = has_sensitive_value(F.col("rationale")) | has_sensitive_value(F.col("observed"))
    return verdicts.agg(
        F.countDistinct(F.when(F.col("disposition_source") == "nr-fallback", F.col("fingerprint"))).alias("fallbacks"),
        F.count_if((F.col("disposition_source") == "llm") & sensitive).alias("sensitive"),
    ).select("fallbacks", "sensitive", (F.col("fallbacks") + F.col("sensitive")).alias("uncached"))


def verdict_hash() -> Column:
    """Digest of what makes two verdicts the same for caching."""
    return sha256_hex(
        joined("\x1f", trimmed(F.col("fingerprint")), trimmed(F.col("disposition")),
               normalize_confidence(F.col("confidence")), trimmed(F.col("rationale")))
    )


def ordered_digest(df: DataFrame, by: Sequence[str], index: str, value: Column, chunk: int = 4096) -> DataFrame:
    """Digest of an ordered list of any length: hash chunks of ``chunk`` indexes,
    then chunks of chunk digests, then those.

    A hash over one long list would need the list in one task."""
    rows = df.select(*by, F.col(index).cast("long").alias("_i"), joined("|", F.col(index), value).alias("_v"),
                     F.lit(1).cast("long").alias("_n"))
    for _ in range(2):
        lists = rows.groupBy(*by, F.floor(F.col("_i") / chunk).alias("_c")).agg(
            F.array_sort(F.collect_list(F.struct("_i", "_v"))).alias("_l"), F.sum("_n").alias("_n")
        )
        rows = lists.select(*by, F.col("_c").alias("_i"), _digest_list("_l").alias("_v"), "_n")
    whole = rows.groupBy(*by).agg(
        F.array_sort(F.collect_list(F.struct("_i", "_v"))).alias("_l"), F.sum("_n").alias("entries")
    )
    return whole.select(*by, "entries", _digest_list("_l").alias("digest"))


def _digest_list(name: str) -> Column:
    return sha256_hex(F.array_join(F.transform(name, lambda s: s["_v"]), "\n"))


def bundle_key(findings: DataFrame, verdicts: DataFrame, by: Sequence[str], chunk: int = 4096) -> DataFrame:
    """Digest of a run's fingerprints and verdicts in index order."""
    v = verdicts.select("idx", verdict_hash().alias("_h"))
    rows = findings.select(*by, "idx", "fingerprint").join(v, "idx")
    return ordered_digest(rows, by, "idx", joined(":", F.col("fingerprint"), F.col("_h")), chunk)


def fix_verification(approved: DataFrame, after: DataFrame) -> DataFrame:
    """Approved ids: resolved unless they are still an active true positive."""
    active = after.filter(F.col("disposition") == TRUE_POSITIVE).select("vuln_id").distinct()
    rows = approved.select("run_id", "vuln_id").join(active.withColumn("_still", F.lit(True)), "vuln_id", "left")
    return rows.select(
        "run_id", "vuln_id",
        F.when(F.col("_still"), F.lit("still_present")).otherwise(F.lit("resolved")).alias("result"),
    )


def fix_verification_summary(approved: DataFrame, after: DataFrame) -> DataFrame:
    rows = fix_verification(approved, after)
    return rows.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("approved"), F.every(F.col("result") == "resolved").alias("all_resolved")
    )
