"""Scans against each other, against baselines, suppressions and the store."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.identity import baseline_fingerprint, content_hash
from ..functions.paths import clean_path, dir_name, path_suffixes
from ..functions.severity import rule_category
from ..functions.text import blank_to_null, choose, first_where
from ..session import written
from .naming import distinct_texts, names_in, text_id

# What the reason of an ignore entry does to the status.
IGNORE_REASONS = {"False Positive": "false_positive", "Accepted Risk": "risk_accepted", "Won't Fix": "risk_accepted"}


def with_baseline_fingerprint(f: DataFrame) -> DataFrame:
    return f.withColumn(
        "fingerprint", baseline_fingerprint(F.col("rule_id"), F.col("file"), F.col("evidence"))
    )


def make_baseline(f: DataFrame) -> DataFrame:
    """One accepted finding per fingerprint."""
    keyed = with_baseline_fingerprint(f)
    rest = ["rule_id", "file", "line", "severity"]
    return keyed.groupBy("fingerprint").agg(F.min(F.struct(*rest)).alias("m")).select("fingerprint", "m.*")


def baseline_filter(f: DataFrame, baseline: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new, accepted) findings."""
    keyed = with_baseline_fingerprint(f)
    known = baseline.select("fingerprint").distinct()
    return keyed.join(known, "fingerprint", "left_anti"), keyed.join(known, "fingerprint", "left_semi")


def split_by_baseline(f: DataFrame, baseline: DataFrame) -> DataFrame:
    """Both parts in one pass, told apart by ``state``."""
    known = baseline.select("fingerprint").distinct().withColumn("_known", F.lit(True))
    out = with_baseline_fingerprint(f).join(known, "fingerprint", "left")
    return out.withColumn("state", F.when(F.col("_known"), F.lit("accepted")).otherwise(F.lit("new"))).drop("_known")


def baseline_stats(baseline: DataFrame, previous: DataFrame) -> DataFrame:
    """Accepted findings by severity (and in all) now and before, with the change."""
    def counts(df: DataFrame, name: str) -> DataFrame:
        per = df.select(F.explode(F.array(F.lit("TOTAL"), F.col("severity"))).alias("severity"))
        return per.groupBy("severity").agg(F.count(F.lit(1)).alias(name))

    both = counts(baseline, "now").join(counts(previous, "before"), "severity", "full_outer").fillna(0)
    return both.withColumn("delta", F.col("now") - F.col("before"))


def scan_diff(prev: DataFrame, curr: DataFrame, key: Sequence[str] = ("rule_id",)) -> DataFrame:
    """Added and fixed keys between two scans, with a representative."""
    rest = [c for c in ("name", "severity") if c not in key]

    def side(df: DataFrame, mark: str) -> DataFrame:
        return df.groupBy(*key).agg(F.max(F.struct(*rest)).alias(mark))

    both = side(prev, "p").join(side(curr, "c"), list(key), "full_outer")
    changed = both.filter(F.col("p").isNull() | F.col("c").isNull())
    change = F.when(F.col("p").isNull(), F.lit("added")).otherwise(F.lit("fixed"))
    rep = F.coalesce("c", "p")
    out = changed.select(*key, *[rep[c].alias(c) for c in rest], change.alias("change"))
    return out.orderBy(F.desc("change"), *key)


def set_compare(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys of two scans: in both, only in the first, only in the second."""
    left = a.select(key).distinct().withColumn("_a", F.lit(True))
    right = b.select(key).distinct().withColumn("_b", F.lit(True))
    state = first_where(
        [(F.col("_a") & F.col("_b"), "both"), (F.col("_a").isNotNull(), "only_first")], "only_second"
    )
    return left.join(right, key, "full_outer").select(key, state.alias("state"))


def suppress_by_content(f: DataFrame, ignored: DataFrame) -> DataFrame:
    """Status from the earliest ignore entry with the same snippet hash."""
    first = ignored.groupBy("content_hash").agg(F.min(F.struct("id", "reason")).alias("m")).select(
        "content_hash", F.col("m.reason").alias("_reason")
    )
    snippet = F.coalesce("code_snippet", F.lit(""))
    keyed = f.withColumn("content_hash", F.when(snippet != "", content_hash(snippet)))
    # Findings without a snippet have no hash to look up: they do not share a key in the join.
    with_hash = keyed.filter(F.col("content_hash").isNotNull()).join(first, "content_hash", "left")
    out = with_hash.unionByName(keyed.filter(F.col("content_hash").isNull()).withColumn("_reason", F.lit(None).cast("string")))
    base = F.coalesce(blank_to_null(F.col("status")), F.lit("open"))
    return out.withColumn("status", F.coalesce(choose(F.col("_reason"), IGNORE_REASONS), base)).drop("_reason")


def audit_overlay(results: DataFrame, audit: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Audit status by (rule, file), within ``by``, OPEN where nothing was recorded."""
    keys = [*by, "rule_id", "file"]
    out = results.join(audit.select(*keys, F.col("status").alias("audit_status")), keys, "left")
    return out.withColumn("audit_status", F.coalesce("audit_status", F.lit("OPEN")))


def resolve_scan_path(f: DataFrame, engagements: DataFrame, products: DataFrame) -> DataFrame:
    """Engagement path, else product repository, else the folder of an absolute file."""
    e = engagements.select(F.col("id").alias("engagement_id"), F.col("scan_path").alias("_scan"))
    p = products.select(F.col("id").alias("product_id"), F.col("repo_url").alias("_repo"))
    out = f.join(e, "engagement_id", "left").join(p, "product_id", "left")
    file = F.coalesce("file_path", F.lit(""))
    own = F.when(F.startswith(file, F.lit("/")), dir_name(file))
    path = F.coalesce(blank_to_null(F.col("_scan")), blank_to_null(F.col("_repo")), own)
    return out.withColumn("resolved_path", path).drop("_scan", "_repo")


def _location(path: Column) -> Column:
    return F.btrim(clean_path(F.coalesce(path, F.lit(""))), F.lit("/"))


def still_present(stored: DataFrame, rescan: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Ids of stored findings that a re-scan reports again.

    stored: id, rule_id, title, file_path. rescan: type, rule_id, title, file, where
    title is the name (core, nfr), message (external), issue (deploy) or target
    (network). Rules and titles become keys, and with a place they become tokens: places
    are the same if one path ends with the other, so a token holds a path or one of its
    '/'-suffixes. A finding is present if it has a token of the re-scan: one equi-join,
    no pairs are compared."""
    by = list(by)
    title = F.lower(F.trim(F.coalesce("title", F.lit(""))))
    s = written(stored.select(
        *by, "id", F.col("rule_id"), title.alias("_t"), _location(F.col("file_path")).alias("_f"),
        (F.coalesce("file_path", F.lit("")) == "").alias("_anywhere"),
    ))
    r = written(rescan.select(
        *by, F.col("type").alias("_type"), F.col("rule_id").alias("_rule"), title.alias("_rt"),
        _location(F.col("file")).alias("_rf"),
    ).distinct())

    def key(mark: str, value: Column) -> Column:
        return F.when(value != "", F.concat(F.lit(mark), value))

    def told(texts: DataFrame, names: DataFrame) -> DataFrame:
        """Names in texts, as (by.., tid, names): few per text."""
        found = names_in(distinct_texts(texts, by), names, by)
        return found.groupBy(*by, "tid").agg(F.collect_set("name").alias("_names"))

    kind = F.col("_type")
    hosts = r.filter(kind == "network").select(*by, F.col("_rt").alias("name"))
    targets = told(s.select(*by, F.col("_t").alias("text")), hosts)
    own = F.array(
        key("r:", F.col("rule_id")), key("t:", F.col("_t")), F.when(F.startswith("rule_id", F.lit("gitleak-")), F.lit("leak"))
    )
    sk = s.withColumn("tid", text_id(F.col("_t"))).join(targets.hint("merge"), [*by, "tid"], "left")
    named = F.transform(F.coalesce("_names", F.array().cast("array<string>")), lambda n: F.concat(F.lit("h:"), n))
    sk = sk.select(*by, "id", "_f", "_anywhere", F.explode(F.array_compact(F.concat(own, named))).alias("_k"))

    messages = r.filter(kind == "external").select(*by, F.col("_rt").alias("text"))
    titles = told(messages, s.select(*by, F.col("_t").alias("name")))
    one = F.array(
        F.when(kind != "leak", key("r:", F.col("_rule"))),
        F.when(kind.isin("core", "nfr", "deploy"), key("t:", F.col("_rt"))),
        F.when(kind == "network", key("h:", F.col("_rt"))),
        F.when(kind == "leak", F.lit("leak")),
    )
    rk = r.withColumn("tid", F.when(kind == "external", text_id(F.col("_rt")))).join(titles.hint("merge"), [*by, "tid"], "left")
    named = F.transform(F.coalesce("_names", F.array().cast("array<string>")), lambda n: F.concat(F.lit("t:"), n))
    rk = rk.select(*by, "_type", "_rf", F.explode(F.array_compact(F.concat(one, named))).alias("_k"))

    def token(mark: str, place: Column) -> Column:
        return F.struct(F.lit(mark).alias("mark"), place.alias("place"))

    def suffixes(mark: str, path: Column) -> Column:
        return F.transform(path_suffixes(path), lambda p: token(mark, p))

    nowhere, none = F.lit(""), F.array().cast("array<struct<mark:string,place:string>>")
    deploy_rule = (kind == "deploy") & F.startswith("_k", F.lit("r:"))
    free = kind.isin("nfr", "network") | deploy_rule
    placed = F.concat(F.array(token("path", F.col("_rf"))), suffixes("end", F.col("_rf")))
    placed = F.concat(F.array(token("somewhere", nowhere)), F.when(F.col("_rf") != "", placed).otherwise(none))
    have = F.when(free, F.array(token("free", nowhere))).otherwise(placed)
    have = rk.select(*by, "_k", F.explode(have).alias("_token")).distinct()
    mine = F.concat(F.array(token("end", F.col("_f"))), suffixes("path", F.col("_f")))
    mine = F.when(F.col("_anywhere"), F.array(token("somewhere", nowhere))).otherwise(mine)
    want = sk.select(*by, "id", "_k", F.explode(F.concat(F.array(token("free", nowhere)), mine)).alias("_token"))
    return want.join(have.hint("merge"), [*by, "_k", "_token"], "left_semi").select(*by, "id").distinct()


def component_risk(components: DataFrame, f: DataFrame, by: str = "product_id") -> DataFrame:
    """Highest severity of a project's findings whose title or description names the
    component; LOW without any. Texts are reduced to distinct ones first."""
    level = choose(F.upper("severity"), {"MEDIUM": 1, "HIGH": 2, "CRITICAL": 3}, 0)
    text = F.lower(F.concat_ws("\n", F.coalesce("title", F.lit("")), F.coalesce("description", F.lit(""))))
    worst = f.select(by, text.alias("text"), level.alias("_level")).filter(F.col("_level") > 0)
    worst = worst.groupBy(by, "text").agg(F.max("_level").alias("_level"))
    worst = written(worst.select(by, text_id(F.col("text")).alias("tid"), "text", "_level"))
    names = components.select(by, F.lower("component").alias("name"))
    found = names_in(worst.select(by, "tid", "text"), names, [by])
    named = worst.select(by, "tid", "_level").join(found.hint("merge"), [by, "tid"])
    top = named.groupBy(by, F.col("name").alias("_n")).agg(F.max("_level").alias("_level"))
    out = components.withColumn("_n", F.lower("component")).join(top.hint("merge"), [by, "_n"], "left")
    risk = F.coalesce(choose(F.col("_level"), {1: "MEDIUM", 2: "HIGH", 3: "CRITICAL"}), F.lit("LOW"))
    return out.select(*components.columns, risk.alias("risk"))


# ---- keyed table changes --------------------------------------------------


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], update: Sequence[str] | None) -> DataFrame:
    """Insert, or update the ``update`` columns on conflict; ``None`` keeps old rows."""
    update = list(update or [])
    cols = [c for c in old.columns if c not in keys]
    left = old.select(*keys, F.struct(*cols).alias("_old"))
    right = new.select(*keys, F.struct(*cols).alias("_new"))
    both = left.join(right, list(keys), "full_outer")
    picked = [
        F.when(F.col("_old").isNull() | (F.col("_new").isNotNull() & F.lit(c in update)), F.col(f"_new.{c}"))
        .otherwise(F.col(f"_old.{c}")).alias(c)
        for c in cols
    ]
    return both.select(*keys, *picked)


def mark_sla_breach(f: DataFrame, as_of: Column) -> DataFrame:
    from .dashboard import CLOSED

    late = F.coalesce(as_of > F.col("sla_deadline"), F.lit(False)) & ~F.col("status").isin(*CLOSED)
    return f.withColumn("sla_breached", F.coalesce("sla_breached", F.lit(False)) | F.coalesce(late, F.lit(False)))


def apply_verification(f: DataFrame, results: DataFrame, at: Column) -> DataFrame:
    """Outcome of a re-check: resolved and verified, or back in progress.

    results: id, fixed, summary; findings without a result stay as they are."""
    out = f.join(results.select("id", "fixed", "summary"), "id", "left")
    fixed, seen = F.coalesce("fixed", F.lit(False)), F.col("fixed").isNotNull()

    def change(name: str, yes, no) -> Column:
        return F.when(seen & fixed, yes).when(seen, no).otherwise(F.col(name))

    null_at = F.lit(None).cast("timestamp_ntz")
    out = out.withColumns(
        {
            "status": change("status", F.lit("resolved"), F.lit("verification_failed")),
            "kanban_column": change("kanban_column", F.lit("done"), F.lit("in_progress")),
            "is_verified": F.when(seen, fixed).otherwise(F.col("is_verified")),
            "verified_at": change("verified_at", at, null_at),
            "resolved_at": change("resolved_at", at, null_at),
            "verification_status": change("verification_status", F.lit("fixed"), F.lit("not_fixed")),
            "verification_summary": F.when(seen, F.col("summary")).otherwise(F.col("verification_summary")),
        }
    )
    return out.drop("fixed", "summary")


def ingest_findings(raw: DataFrame, products: DataFrame, ignored: DataFrame, at: Column) -> DataFrame:
    """New findings as stored rows: suppression status, content hash, SLA deadline of the product."""
    out = suppress_by_content(raw, ignored).withColumnRenamed("content_hash", "hash_code")
    days = products.select(
        F.col("id").alias("product_id"), "sla_critical", "sla_high", "sla_medium", "sla_low"
    )
    out = out.join(days, "product_id", "left")
    n = first_where(
        [(F.upper("severity") == s.upper(), F.col(f"sla_{s}")) for s in ("critical", "high", "medium", "low")]
    )
    deadline = F.timestamp_add("DAY", n, at)
    out = out.withColumns(
        {
            "kanban_column": F.lit("backlog"), "created_at": at, "sla_deadline": deadline,
            "sla_breached": F.lit(False),
        }
    )
    return out.drop("sla_critical", "sla_high", "sla_medium", "sla_low")


def purge_cascade(tables: dict[str, DataFrame], product_ids: DataFrame) -> dict[str, DataFrame]:
    """Remove products and everything that hangs on them; returns the kept rows.

    tables: products(id), members(product_id), engagements(id, product_id),
    findings(id, engagement_id), notes(id, finding_id), runs(id, product_id),
    artifacts(id, run_id); missing tables are skipped."""
    gone = {"products": product_ids.select("id").distinct()}
    kept = {}
    links = (
        ("products", "id", "products"),
        ("members", "product_id", "products"),
        ("engagements", "product_id", "products"),
        ("runs", "product_id", "products"),
        ("findings", "engagement_id", "engagements"),
        ("notes", "finding_id", "findings"),
        ("artifacts", "run_id", "runs"),
    )
    for name, ref, parent in links:
        if name not in tables or parent not in gone:
            continue
        df, dead = tables[name], gone[parent].select(F.col("id").alias(ref))
        kept[name] = df.join(dead, ref, "left_anti")
        if name != "products" and "id" in df.columns:
            gone[name] = df.join(dead, ref, "left_semi").select("id")
    return kept


def apply_triage(f: DataFrame, verdicts: DataFrame) -> DataFrame:
    """AI verdict to status: false positives are flagged, true ones go to triage;
    findings without a verdict stay as they are."""
    v = verdicts.select("id", F.col("verdict").alias("_v"), F.col("summary").alias("_s"), F.lit(True).alias("_seen"))
    out = f.join(v, "id", "left")
    is_fp, is_tp = F.col("_v") == "false_positive", F.col("_v") == "true_positive"
    return out.withColumns(
        {
            "status": F.when(is_fp, F.lit("false_positive")).when(is_tp, F.lit("triage")).otherwise(F.col("status")),
            "is_false_positive": F.coalesce(is_fp, F.lit(False)) | F.coalesce("is_false_positive", F.lit(False)),
            "fp_reason": F.when(is_fp, F.col("_s")).otherwise(F.col("fp_reason")),
            "ai_triage_status": F.when(F.col("_seen"), F.col("_v")).otherwise(F.col("ai_triage_status")),
            "ai_triage_summary": F.when(F.col("_seen"), F.col("_s")).otherwise(F.col("ai_triage_summary")),
        }
    ).drop("_v", "_s", "_seen")


def rule_coverage(rules: DataFrame) -> DataFrame:
    """Rules per category, stack and severity."""
    return rules.groupBy(
        rule_category(F.col("id")).alias("category"), "stack", "severity"
    ).agg(F.count(F.lit(1)).alias("n"))


