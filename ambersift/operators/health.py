"""Health score, its breakdown, and the policy gate."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.identity import health_dedup_key
from ..functions.severity import effective_weight, grade, severity_rank
from ..functions.text import blank_to_null, norm_lower, norm_upper

# Fixed values of the scoring model.
SATURATION, MAX_BONUS, BONUS_EACH = 55.0, 10, 0.6


def health_representative(findings: DataFrame, by: Sequence[str]) -> DataFrame:
    """One finding per dedup key: an active one before an ignored one, then the heavier.

    Input columns: source, class, severity, file, line, ignored."""
    key = health_dedup_key(F.col("source"), F.col("class"), F.col("file"), F.col("line"))
    # All weights are multiples of 0.1: whole tenths make sums exact in any order.
    tenths = F.round(effective_weight(F.col("severity"), F.col("source")) * 10).cast("long")
    best = F.struct(
        F.col("ignored").alias("ignored"), (-tenths).alias("n"), severity_rank(F.col("severity")).alias("rank"),
        F.col("source").alias("source"), F.col("class").alias("class"), F.col("severity").alias("severity"),
        F.col("file").alias("file"), F.col("line").alias("line"),
    )
    per = findings.groupBy(*by, key.alias("dedup_key")).agg(F.min(best).alias("b"), F.count(F.lit(1)).alias("copies"))
    sev = F.coalesce(blank_to_null(norm_upper(F.col("b.severity"))), F.lit("UNKNOWN"))
    src = F.coalesce(blank_to_null(norm_lower(F.col("b.source"))), F.lit("unknown"))
    cls = F.coalesce(blank_to_null(norm_lower(F.col("b.class"))), F.lit("unknown"))
    return per.select(
        *by, "dedup_key", "copies", F.col("b.ignored").alias("ignored"), (-F.col("b.n")).alias("tenths"),
        sev.alias("severity"), src.alias("source"), cls.alias("class"),
    )


def _penalty(tenths: Column) -> Column:
    return 100.0 * (1.0 - F.exp(-(tenths / 10.0) / SATURATION))


def health_score(
    findings: DataFrame, by: Sequence[str], positives: DataFrame | None = None, count: Sequence[tuple[str, str]] = ()
) -> DataFrame:
    """Score, grade and parts per project. ``positives`` has ``by`` and ``positives``.
    ``count``: (``source`` or ``class``, value) pairs whose active findings are counted in
    the same pass, as ``n0``, ``n1``, .."""
    active = ~F.col("ignored")
    extra = [F.count_if(active & (F.col(d) == v)).alias(f"n{i}") for i, (d, v) in enumerate(count)]
    per = health_representative(findings, by).groupBy(*by).agg(
        F.coalesce(F.sum(F.when(active, F.col("tenths"))), F.lit(0)).alias("_t"),
        F.count_if(active).alias("active_findings"),
        F.count_if(~active).alias("ignored_findings"),
        F.sum(F.col("copies") - 1).alias("deduped_findings"),
        F.count_if(active & (F.col("severity") == "CRITICAL")).alias("critical"),
        F.count_if(active & (F.col("severity") == "HIGH")).alias("high"),
        F.count_if(active & (F.col("severity") == "MEDIUM")).alias("medium"),
        *extra,
    )
    if positives is not None:
        per = per.join(positives, list(by), "left")
    good = F.coalesce(F.col("positives"), F.lit(0)) if positives is not None else F.lit(0)
    blocked = (F.col("critical") + F.col("high")) > 0
    bonus = F.when(blocked, 0.0).otherwise(F.least(F.round(good * BONUS_EACH), F.lit(float(MAX_BONUS))))
    penalty = _penalty(F.col("_t"))
    score = F.least(F.greatest(F.round(100.0 - penalty + bonus), F.lit(0.0)), F.lit(100.0)).cast("long")
    return per.select(
        *by, score.alias("score"), grade(score).alias("grade"), blocked.alias("has_critical_failures"),
        F.round(F.col("_t") / 10.0, 2).alias("raw_weight"), F.round(penalty).cast("long").alias("penalty"),
        bonus.cast("long").alias("bonus"), "active_findings", "ignored_findings", "deduped_findings",
        "critical", "high", "medium", *[f"n{i}" for i in range(len(count))],
    )


def penalty_by_source(findings: DataFrame, by: Sequence[str]) -> DataFrame:
    """The saturated penalty shared out by the weight of each source."""
    active = health_representative(findings, by).filter(~F.col("ignored"))
    per = active.groupBy(*by, "source").agg(F.sum("tenths").alias("_t"))
    # The window runs over one row per source of a project.
    total = F.sum("_t").over(Window.partitionBy(*by))
    share = F.round(_penalty(F.col("_total")) * (F.col("_t") / F.col("_total"))).cast("long")
    return per.withColumn("_total", total).filter(F.col("_total") > 0).select(*by, "source", share.alias("penalty"))


def top_penalty_sources(findings: DataFrame, by: Sequence[str]) -> DataFrame:
    """Sources of each project numbered by penalty, ties by name."""
    order = Window.partitionBy(*by).orderBy(F.col("penalty").desc(), F.col("source"))
    return penalty_by_source(findings, by).withColumn("place", F.row_number().over(order))


def health_counts(findings: DataFrame, by: Sequence[str]) -> DataFrame:
    """Active counts by severity, source and class, and the totals, in long form."""
    rep = health_representative(findings, by)

    def item(dim: str, value: Column, n: Column) -> Column:
        return F.struct(F.lit(dim).alias("dimension"), value.alias("value"), n.cast("long").alias("n"))

    one, active = F.lit(1), ~F.col("ignored")
    items = F.array_compact(
        F.array(
            F.when(active, item("severity", F.col("severity"), one)),
            F.when(active, item("source", F.col("source"), one)),
            F.when(active, item("class", F.col("class"), one)),
            F.when(active, item("total", F.lit("active"), one)),
            F.when(~active, item("total", F.lit("ignored"), one)),
            F.when(F.col("copies") > 1, item("total", F.lit("deduped"), F.col("copies") - 1)),
        )
    )
    flat = rep.select(*by, F.explode(items).alias("i")).select(*by, "i.*")
    return flat.groupBy(*by, "dimension", "value").agg(F.sum("n").alias("n"))


# ---- policy gate ----------------------------------------------------------

UNLIMITED = -1


@dataclass(frozen=True)
class Policy:
    profile: str = "baseline"
    fail_on: str = "critical"
    minimum_score: int = 0
    max_critical: int = UNLIMITED
    max_high: int = UNLIMITED
    max_medium: int = UNLIMITED
    block_sources: tuple[str, ...] = ()
    block_classes: tuple[str, ...] = ()


# The built-in profiles.
PROFILES = {
    "baseline": Policy(),
    "standard": Policy("standard", "critical", 70, 0, 0, UNLIMITED),
    "strict": Policy("strict", "any", 90, 0, 0, 0),
}


def _key(value: str) -> str:
    return (value or "").strip().lower()


def normalize_policy(p: Policy) -> Policy:
    profile = _key(p.profile) if _key(p.profile) in PROFILES else "baseline"
    fail_on = _key(p.fail_on) if _key(p.fail_on) in ("any", "never") else "critical"
    limits = (p.max_critical, p.max_high, p.max_medium)
    if profile == "baseline" and limits == (0, 0, 0):
        limits = (UNLIMITED,) * 3

    def clean(items: Sequence[str]) -> tuple[str, ...]:
        return tuple(dict.fromkeys(k for k in map(_key, items) if k))

    return Policy(profile, fail_on, p.minimum_score, *limits, clean(p.block_sources), clean(p.block_classes))


def policy_for_profile(name: str) -> Policy:
    return PROFILES.get(_key(name), PROFILES["baseline"])


def apply_overrides(
    policy: Policy, profile: str | None = None, fail_on: str | None = None, minimum_score: int | None = None
) -> Policy:
    """Explicit choices on top of a configured policy; block lists survive a profile change."""
    if profile is not None:
        policy = replace(
            policy_for_profile(profile), block_sources=policy.block_sources, block_classes=policy.block_classes
        )
    if fail_on is not None:
        policy = replace(policy, fail_on=fail_on)
    if minimum_score is not None:
        policy = replace(policy, minimum_score=minimum_score)
    return normalize_policy(policy)


def policy_from_config(config: dict) -> Policy:
    """``health_check`` section plus the older ``strict_mode`` and ``fail_score``."""
    section = config.get("health_check") or {}
    policy = policy_for_profile(section.get("profile", ""))
    if section.get("fail_on"):
        policy = replace(policy, fail_on=section["fail_on"])
    elif config.get("strict_mode"):
        policy = replace(policy, fail_on="any")
    if section.get("minimum_score") is not None:
        policy = replace(policy, minimum_score=section["minimum_score"])
    elif config.get("fail_score", 0) > 0:
        policy = replace(policy, minimum_score=config["fail_score"])
    for name in ("max_critical", "max_high", "max_medium"):
        if section.get(name) is not None:
            policy = replace(policy, **{name: section[name]})
    for name in ("block_sources", "block_classes"):
        if section.get(name):
            policy = replace(policy, **{name: tuple(section[name])})
    return normalize_policy(policy)


def _blocked(policies: Sequence[Policy]) -> list[tuple[str, str]]:
    pairs = [("source", s) for p in policies for s in p.block_sources]
    pairs += [("class", c) for p in policies for c in p.block_classes]
    return list(dict.fromkeys(pairs))


def gate_scores(
    findings: DataFrame, by: Sequence[str], policies: Sequence[Policy], positives: DataFrame | None = None
) -> DataFrame:
    """Scores with all that the policies look at, from one pass over the findings."""
    return health_score(findings, by, positives, _blocked([normalize_policy(p) for p in policies]))


def _reasons(policies: Sequence[Policy]) -> Column:
    """Array of the blocking reasons of all policies; policies are constants of the plan."""
    names = {pair: f"n{i}" for i, pair in enumerate(_blocked(policies))}

    def reason(p: Policy, code: str, cond: Column, count: Column, limit: int, sev="", source="", cls="") -> Column:
        return F.when(
            cond,
            F.struct(
                F.lit(p.profile).alias("profile"), F.lit(code).alias("code"), F.lit(sev).alias("severity"),
                F.lit(source).alias("source"), F.lit(cls).alias("class"), count.cast("long").alias("n"),
                F.lit(limit).cast("long").alias("threshold"),
            ),
        )

    items = []
    for p in policies:
        if p.fail_on == "never":
            continue
        active, both = F.col("active_findings"), F.col("critical") + F.col("high")
        if p.fail_on == "any":
            items.append(reason(p, "active_findings", active > 0, active, 0))
        if p.fail_on == "critical":
            items.append(reason(p, "critical_or_high_findings", both > 0, both, 0, "HIGH"))
        for name, limit in (("critical", p.max_critical), ("high", p.max_high), ("medium", p.max_medium)):
            if limit >= 0:
                n = F.col(name)
                items.append(reason(p, f"{name}_threshold", n > limit, n, limit, name.upper()))
        if p.minimum_score > 0:
            score = F.col("score")
            items.append(reason(p, "minimum_score", score < p.minimum_score, score, p.minimum_score))
        for s in p.block_sources:
            n = F.col(names["source", s])
            items.append(reason(p, "blocked_source", n > 0, n, 0, source=s))
        for c in p.block_classes:
            n = F.col(names["class", c])
            items.append(reason(p, "blocked_class", n > 0, n, 0, cls=c))
    return F.array_compact(F.array(*items))


def gate_reasons(scores: DataFrame, by: Sequence[str], policies: Sequence[Policy]) -> DataFrame:
    """Blocking reasons per project and policy; ``scores`` come from ``gate_scores``."""
    reasons = _reasons([normalize_policy(p) for p in policies])
    return scores.select(*by, F.explode(reasons).alias("r")).select(*by, "r.*")


def gate_verdict(scores: DataFrame, by: Sequence[str], policies: Sequence[Policy]) -> DataFrame:
    """Passed or failed per project and policy, with the number of reasons; no join."""
    policies = [normalize_policy(p) for p in policies]

    def verdict(p: Policy) -> Column:
        n = F.size(F.filter("_r", lambda r: r["profile"] == p.profile)).cast("long")
        return F.struct(F.lit(p.profile).alias("profile"), n.alias("reasons"))

    every = scores.select(*by, _reasons(policies).alias("_r"))
    out = every.select(*by, F.explode(F.array(*[verdict(p) for p in policies])).alias("v")).select(*by, "v.*")
    passed = F.col("reasons") == 0
    return out.withColumn("status", F.when(passed, F.lit("passed")).otherwise(F.lit("failed")))
