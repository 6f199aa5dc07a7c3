"""Dashboard metrics, lists and orders over the findings store."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.severity import (
    owasp_category, rule_category, severity_level, severity_rank,
)
from ..functions.text import blank_to_null, norm_lower, norm_upper
from .paging import SHALLOW, rows_from

# Status words of closed findings.
CLOSED = ("resolved", "closed", "risk_accepted", "false_positive")
CLOSED_FOR_SUMMARY = ("resolved", "closed", "risk_accepted", "accepted_risk", "false_positive")
TRIAGED = ("triage", "false_positive", "risk_accepted")
KANBAN_COLUMNS = ("backlog", "todo", "in_progress", "review", "done")
SEVERITIES = ("CRITICAL", "HIGH", "MEDIUM", "LOW")


def count_rows(name: str) -> Column:
    return F.count(F.lit(1)).alias(name)


# ---- predicates -----------------------------------------------------------


def open_findings(f: DataFrame) -> DataFrame:
    return f.filter(~F.col("status").isin(*CLOSED))


def is_active_for_summary() -> Column:
    status = norm_lower(F.coalesce("status", F.lit("")))
    return ~F.coalesce("is_false_positive", F.lit(False)) & ~status.isin(*CLOSED_FOR_SUMMARY)


def active_for_summary(f: DataFrame) -> DataFrame:
    return f.filter(is_active_for_summary())


def facet_filter(
    f: DataFrame, product: int | None = None, severity: str | None = None, status: str | None = None,
    file: str | None = None, query: str | None = None,
) -> DataFrame:
    """AND of the given facets; a blank status counts as open, text is looked up
    in title, description, path and id."""
    if product is not None:
        f = f.filter(F.col("product_id") == product)
    if severity:
        f = f.filter(F.lower("severity") == severity.lower())
    if status:
        f = f.filter(F.coalesce(blank_to_null(F.col("status")), F.lit("open")) == status)
    if file:
        f = f.filter(F.col("file_path") == file)
    if query and query.strip():
        q = F.lit(query.lower())
        fields = [F.lower(F.coalesce(c, F.lit(""))) for c in ("title", "description", "file_path")]
        hit = F.contains(F.col("id").cast("string"), F.lit(query))
        for c in fields:
            hit = hit | F.contains(c, q)
        f = f.filter(hit)
    return f


def min_severity(f: DataFrame, level: str, limit: int, order: Sequence[Column]) -> DataFrame:
    """Findings at or above a level, the first ``limit`` of a total order."""
    floor = {"CRITICAL": 4, "HIGH": 3, "MEDIUM": 2, "LOW": 1}.get(level.upper(), 0)
    return f.filter(severity_level(F.col("severity")) >= floor).orderBy(*order).limit(limit)


def target_finding(f: DataFrame, rule: str, file: str | None = None, line: int | None = None) -> DataFrame:
    f = f.filter(F.col("rule_id") == rule)
    if file:
        f = f.filter(F.col("file_path") == file)
    if line:
        f = f.filter(F.col("line_number") == line)
    return f


def entropy_family(f: DataFrame) -> DataFrame:
    return f.filter(F.startswith("rule_id", F.lit("ENTR-")))


def list_findings(f: DataFrame, engagement: int | None = None, product: int | None = None) -> DataFrame:
    """Newest first, a blank status shown as open."""
    if engagement is not None:
        f = f.filter(F.col("engagement_id") == engagement)
    if product is not None:
        f = f.filter(F.col("product_id") == product)
    shown = F.when(F.col("status") == "", F.lit("open")).otherwise(F.col("status"))
    return f.withColumn("status", shown).orderBy(F.col("created_at").desc(), F.col("id").desc())


def visible_triage_rows(results: DataFrame, show_ignored: bool = False) -> DataFrame:
    audit = F.coalesce("audit_status", F.lit(""))
    if not show_ignored:
        results = results.filter(audit != "IGNORED")
    status = F.when((audit != "") & (audit != "OPEN"), audit).otherwise(F.col("status"))
    return results.withColumn("status", status)


def deps_filter(deps: DataFrame, query: str) -> DataFrame:
    if not query:
        return deps
    hit = F.lit(False)
    for c in ("name", "type", "ecosystem"):
        hit = hit | F.contains(F.lower(c), F.lit(query))
    return deps.filter(hit)


def list_audit_log(log: DataFrame, entity: str | None, limit: int, offset: int, shallow: int = SHALLOW) -> DataFrame:
    if entity:
        log = log.filter(F.col("entity_type") == entity)
    return rows_from(log, [F.col("created_at").desc(), F.col("id").desc()], offset, limit, shallow)


def unread_notifications(n: DataFrame, user: int | None, unread: bool = True) -> DataFrame:
    if user is not None:
        n = n.filter(F.col("user_id") == user)
    if unread:
        n = n.filter(~F.col("is_read"))
    return n.orderBy("user_id", F.col("created_at").desc(), F.col("id").desc())


# ---- aggregates -----------------------------------------------------------


def open_by_severity(f: DataFrame) -> DataFrame:
    return open_findings(f).groupBy("severity").agg(count_rows("n"))


def status_breakdown(f: DataFrame) -> DataFrame:
    return f.groupBy(F.coalesce("status", F.lit("unknown")).alias("status")).agg(count_rows("n"))


def stack_breakdown(f: DataFrame) -> DataFrame:
    return open_findings(f).groupBy(F.coalesce("stack", F.lit("core")).alias("stack")).agg(count_rows("n"))


def top_files(f: DataFrame, n: int = 8) -> DataFrame:
    named = open_findings(f).filter(F.coalesce("file_path", F.lit("")) != "")
    return named.groupBy("file_path").agg(count_rows("n")).orderBy(F.desc("n"), "file_path").limit(n)


def dashboard_kpis(products: DataFrame, engagements: DataFrame, f: DataFrame) -> DataFrame:
    """One row of totals: each table is reduced to one row first, then summed by column."""
    is_open = ~F.col("status").isin(*CLOSED)
    zero = F.lit(0).cast("long")
    names = ("total_products", "active_engagements", "total_engagements", "open_findings", "total_findings",
             "resolved_findings", "sla_breached")

    def row(df: DataFrame, **aggs: Column) -> DataFrame:
        one = df.agg(*[c.alias(n) for n, c in aggs.items()])
        return one.select(*[F.col(n) if n in aggs else zero.alias(n) for n in names])

    parts = row(products, total_products=F.count(F.lit(1))).unionByName(
        row(
            engagements,
            active_engagements=F.count_if(F.col("status").isin("in_progress", "not_started")),
            total_engagements=F.count(F.lit(1)),
        )
    ).unionByName(
        row(
            f,
            open_findings=F.count_if(is_open),
            total_findings=F.count(F.lit(1)),
            resolved_findings=F.count_if(F.col("status").isin("resolved", "closed")),
            sla_breached=F.count_if(F.col("sla_breached") & is_open),
        )
    )
    return parts.agg(*[F.sum(n).alias(n) for n in names])


def mttr(f: DataFrame) -> DataFrame:
    """Mean days from creation to resolution per severity, one decimal."""
    seconds = F.timestamp_diff("SECOND", F.col("created_at"), F.col("resolved_at"))
    done = f.filter(F.col("resolved_at").isNotNull())
    return done.groupBy("severity").agg(F.round(F.avg(seconds) / 86400, 1).alias("mean_days"))


def executive_summary(f: DataFrame) -> DataFrame:
    """Totals by severity and by status in one pass, long form."""
    def item(dim: str, value: Column) -> Column:
        return F.struct(F.lit(dim).alias("dimension"), value.alias("value"))

    items = F.array(item("total", F.lit("all")), item("severity", F.col("severity")), item("status", F.col("status")))
    return f.select(F.explode(items).alias("i")).select("i.*").groupBy("dimension", "value").agg(count_rows("n"))


def project_stats(products: DataFrame, f: DataFrame) -> DataFrame:
    """Counts per product; products without findings are kept."""
    status, sev = F.col("status"), F.lower("severity")
    per = f.groupBy("product_id").agg(
        count_rows("total"),
        F.count_if(status.isNull() | status.isin("", "open")).alias("open"),
        F.count_if(status == "triage").alias("triaged"),
        F.count_if(status == "false_positive").alias("false_positive"),
        F.count_if(status == "risk_accepted").alias("risk_accepted"),
        *[F.count_if(sev == s.lower()).alias(s.lower()) for s in SEVERITIES],
    )
    counts = [c for c in per.columns if c != "product_id"]
    out = products.select(F.col("id").alias("product_id"), "name").join(per, "product_id", "left")
    return out.fillna(0, subset=counts).orderBy(F.desc("critical"), F.desc("total"), "product_id")


def group_findings(f: DataFrame, by: str, products: DataFrame | None = None) -> DataFrame:
    """Groups with blanks named; severity groups in severity order, others by size."""
    def named(col: str, blank: str) -> Column:
        return F.coalesce(blank_to_null(F.col(col)), F.lit(blank))

    if by == "product":
        per = f.groupBy("product_id").agg(count_rows("n"))
        names = products.select(F.col("id").alias("product_id"), F.col("name").alias("_name"))
        fallback = F.concat(F.lit("Project #"), F.col("product_id").cast("string"))
        unset = F.coalesce("product_id", F.lit(0)) == 0
        label = F.when(unset, F.lit("Unassigned")).otherwise(F.coalesce("_name", fallback))
        sized = per.join(names, "product_id", "left").groupBy(label.alias("group")).agg(F.sum("n").alias("n"))
    else:
        key = {
            "severity": F.upper(named("severity", "unknown")),
            "title": named("title", "Untitled"),
            "file": named("file_path", "No file"),
            "scanner": named("stack", "core"),
        }[by]
        sized = f.groupBy(key.alias("group")).agg(count_rows("n"))
    if by == "severity":
        return sized.orderBy(severity_rank(F.col("group")), "group")
    return sized.orderBy(F.desc("n"), "group")


def category_stats(f: DataFrame) -> DataFrame:
    """Findings and highest severity per rule category."""
    level = severity_level(F.col("severity"))
    return f.groupBy(rule_category(F.col("rule_id")).alias("category")).agg(
        count_rows("n"),
        F.max(F.struct(level.alias("level"), F.when(level > 0, F.col("severity")).alias("severity"))).alias("m"),
    ).select("category", "n", F.coalesce("m.severity", F.lit("")).alias("top_severity"))


def owasp_counts(f: DataFrame) -> DataFrame:
    return (
        f.select(owasp_category(F.col("rule_id")).alias("category")).filter(F.col("category") != "")
        .groupBy("category").agg(count_rows("n"))
    )


def posture_counts(f: DataFrame, by: Sequence[str] = ("product_id",)) -> DataFrame:
    """Active and suppressed findings by severity, other severities in their own column."""
    active, sev = is_active_for_summary(), norm_upper(F.coalesce("severity", F.lit("")))
    aggs = []
    for state, cond in (("active", active), ("suppressed", ~active)):
        aggs += [F.count_if(cond & (sev == s)).alias(f"{state}_{s.lower()}") for s in SEVERITIES]
        aggs.append(F.count_if(cond & ~sev.isin(*SEVERITIES)).alias(f"{state}_other"))
    return f.groupBy(*by).agg(*aggs)


def triaged_counts(f: DataFrame) -> DataFrame:
    status = F.col("status")
    return f.agg(
        *[F.count_if(status == s).alias(s) for s in TRIAGED], F.count_if(status.isin(*TRIAGED)).alias("total")
    )


def kanban_counts(f: DataFrame) -> DataFrame:
    """Findings per board column; empty columns are shown."""
    columns = f.sparkSession.createDataFrame(
        [(i, c) for i, c in enumerate(KANBAN_COLUMNS)], "place int, kanban_column string"
    )
    return columns.join(f.groupBy("kanban_column").agg(count_rows("n")), "kanban_column", "left").fillna(0)


def run_status_counts(runs: DataFrame) -> DataFrame:
    status = F.col("status")
    return runs.agg(
        count_rows("total"),
        F.count_if(status == "completed").alias("completed"),
        F.count_if(status.isin("running", "in_progress")).alias("in_progress"),
        F.count_if(status == "failed").alias("failed"),
    )


def resolved_share(f: DataFrame, products: DataFrame) -> DataFrame:
    """Resolved-like share per product, 0 for products without findings."""
    status = F.lower(F.coalesce(blank_to_null(F.col("status")), F.lit("open")))
    per = f.groupBy("product_id").agg(
        count_rows("total"), F.count_if(status.isin(*CLOSED)).alias("resolved")
    )
    out = products.select(F.col("id").alias("product_id")).join(per, "product_id", "left").fillna(0)
    share = F.when(F.col("total") > 0, F.round(F.col("resolved") / F.nullif("total", F.lit(0)) * 100)).otherwise(0)
    return out.withColumns({"open": F.col("total") - F.col("resolved"), "resolved_pct": share.cast("long")})


def risky_products(products: DataFrame, f: DataFrame, n: int = 5) -> DataFrame:
    """Products with the most open findings and their trend."""
    per = open_findings(f).groupBy("product_id").agg(count_rows("n"))
    out = products.join(per, products["id"] == per["product_id"]).select("id", "name", "n")
    trend = F.when(F.col("n") > 20, "up").when(F.col("n") < 5, "down").otherwise("stable")
    return out.withColumn("trend", trend).orderBy(F.desc("n"), "name", "id").limit(n)


def products_for_user(products: DataFrame, members: DataFrame, user: int, role: str) -> DataFrame:
    """Administrators see all products, others those they are members of."""
    if role == "admin":
        return products
    mine = members.filter(F.col("user_id") == user).select(F.col("product_id").alias("id")).distinct()
    return products.join(mine, "id", "left_semi")


def visible_products(products: DataFrame, members: DataFrame) -> DataFrame:
    """Products every user sees through membership."""
    seen = members.select("user_id", F.col("product_id").alias("id")).distinct()
    return seen.join(products, "id").select("user_id", "id", "name")


# ---- top-k, order, pages --------------------------------------------------


def posture_evidence(f: DataFrame, n: int = 40) -> DataFrame:
    """Active findings first, then by severity and id."""
    active = ~F.col("status").isin(*CLOSED) & ~F.coalesce("is_false_positive", F.lit(False))
    rank = F.least(severity_rank(F.upper("severity")), F.lit(4))
    return f.orderBy(F.when(active, 0).otherwise(1), rank, "id").limit(n)


def recent_engagements(e: DataFrame, n: int = 5) -> DataFrame:
    day = F.coalesce("completed_at", "started_at")
    return e.select("id", "name", "status", day.alias("day")).orderBy(F.desc("day"), F.desc("id")).limit(n)


def paginate(df: DataFrame, order: Sequence[Column], page: int, size: int, shallow: int = SHALLOW) -> DataFrame:
    """Page ``page`` (from 0). To turn many pages of one table, keep a ``paging.Paged`` of it."""
    return rows_from(df, order, page * size, size, shallow)


def sort_findings(f: DataFrame, by: str, desc: bool = False) -> DataFrame:
    """By id, severity, stack, title or file; ties by id."""
    key = {
        "id": F.col("id"),
        "severity": severity_level(F.col("severity")),
        "stack": F.coalesce("stack", F.lit("")),
        "title": F.coalesce("title", F.lit("")),
        "file": F.coalesce("file_path", F.lit("")),
    }[by]
    return f.orderBy(key.desc() if desc else key.asc(), "id")


def top_per_product(f: DataFrame, n: int = 5) -> DataFrame:
    """The worst open findings of each product. A rank limit this small is also
    applied within each input partition, before the shuffle."""
    rank = F.least(severity_rank(F.upper("severity")), F.lit(4))
    status = F.coalesce(blank_to_null(F.col("status")), F.lit("open"))
    order = Window.partitionBy("product_id").orderBy("_rank", "id")
    rows = f.filter(status == "open").withColumn("_rank", rank)
    return rows.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= n).drop("_rank")


def latest_per_product(e: DataFrame, by: str = "product_id") -> DataFrame:
    """Newest row per product by start time, then id."""
    rest = [c for c in e.columns if c not in (by, "started_at", "id")]
    newest = e.groupBy(by).agg(F.max(F.struct("started_at", "id", *rest)).alias("m"))
    return newest.select(by, "m.*")


def keep_newest(df: DataFrame, at: str, key: str, n: int) -> DataFrame:
    return df.orderBy(F.desc(at), F.asc(key)).limit(n)


def distinct_stacks(f: DataFrame) -> DataFrame:
    return f.select("stack").filter(F.coalesce("stack", F.lit("")) != "").distinct()


def products_with_findings(products: DataFrame, f: DataFrame) -> DataFrame:
    return products.join(f.select(F.col("product_id").alias("id")).distinct(), "id", "left_semi")


def sla_status(f: DataFrame, as_of: Column) -> DataFrame:
    """Over SLA while not resolved or closed; whole days left, toward zero."""
    seconds = F.timestamp_diff("SECOND", as_of, F.col("sla_deadline"))
    days = F.coalesce(F.when(seconds < 0, F.ceil(seconds / 86400)).otherwise(F.floor(seconds / 86400)), F.lit(0))
    done = F.coalesce(F.col("status").isin("resolved", "closed"), F.lit(False))
    over = F.coalesce(as_of > F.col("sla_deadline"), F.lit(False)) & ~done
    return f.withColumns({"over_sla": over, "days_left": days.cast("long")})
