"""A whole scan: roots, file rules, project rules, heuristics and deployment checks, from
one pass over the corpus, on to audit statuses, scores and the gate.

``file_facts`` looks at every text once and keeps what a scan wants to know of it: an
array of hits, the points of marker files, flags of required patterns. These narrow rows
are written; roots, project rules and results are worked out from them alone, so a
corpus is read once however many rules there are, and texts never move."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.severity import owasp_category, severity_rank
from ..functions.text import choose
from ..session import written
from . import file_checks
from .compare import audit_overlay
from .health import Policy, gate_scores, gate_verdict
from .project_shape import DEPLOY_ADVICE, deploy_hits, deploy_kind
from .roots import assign_project, imports_express, settle_stacks, stack_points
from .rules import (
    Rule, missing_filename, missing_lockfile, required_missing, rule_hits, with_required_flags, with_rule_details,
)

RESULT = ("project", "root", "stack", "rule_id", "name", "severity", "file", "line", "suggestion")

# Rules of the heuristics: id, name, severity, suggestion.
LARGE = ("CORE-LARGE", "Very large file", "MEDIUM", "Split the file")
RESIDUE = ("CORE-RESIDUE", "Scaffolding left behind", "LOW", "Finish or remove it")
BRITTLE = ("CORE-BRITTLE", "No error handling", "MEDIUM", "Handle errors")
SECRET = ("Hard-coded secret", "Move it to the environment")


HIT = "array<struct<feed:string,rule_id:string,severity:string,line:int>>"
HEURISTICS = (LARGE, RESIDUE, BRITTLE)


def _hit(feed: str, rule_id: Column, severity: Column | str, line: Column) -> Column:
    severity = F.lit(severity) if isinstance(severity, str) else severity
    return F.struct(F.lit(feed).alias("feed"), rule_id.alias("rule_id"), severity.alias("severity"), line.cast("int").alias("line"))


def file_facts(files: DataFrame, rules: Sequence[Rule], directive: str | None = "scan") -> DataFrame:
    """One row per file (project, path): ``hits`` (feed, rule_id, severity, line) of file rules
    (feed rule, severity null), heuristics and secrets (core) and deployment checks (deploy),
    ``points`` and ``express`` for the roots, and the flags of required patterns.

    A file without a text has no hits."""
    path, content = F.col("path"), F.col("content")
    base, flags = with_required_flags(files.select("project", "path", "content"), rules)
    base = rule_hits(base, [r for r in rules if not r.is_project_rule], directive=directive)
    base = base.withColumn("_kind", deploy_kind(path, content))
    none = F.array().cast(HIT)
    whole = [
        F.when(cond, _hit("core", F.lit(rule[0]), rule[2], F.lit(0)))
        for rule, cond in zip(
            HEURISTICS,
            (file_checks.is_large(content), file_checks.has_residue(path, content), file_checks.is_brittle(path, content)),
        )
    ]
    secrets = F.transform(
        file_checks.secret_hits(path, content, directive, preview=False), lambda h: _hit("core", h["rule_id"], "CRITICAL", h["line"])
    )
    deploy = F.transform(
        F.when(F.col("_kind").isNotNull(), deploy_hits(F.col("_kind"), content)),
        lambda h: _hit("deploy", h["f"]["issue"], h["f"]["severity"], h["line"]),
    )
    own = F.transform("hits", lambda h: _hit("rule", h["rule_id"], F.lit(None).cast("string"), h["line"]))
    parts = [F.coalesce(a.cast(HIT), none) for a in (own, F.array_compact(F.array(*whole)), secrets, deploy)]
    return base.select(
        "project", "path", F.concat(*parts).alias("hits"), stack_points(path, content).alias("points"),
        F.coalesce(imports_express(path, content), F.lit(False)).alias("express"), *flags,
    )


def file_results(files: DataFrame, rules: Sequence[Rule], directive: str | None = "scan") -> DataFrame:
    """Hits of file rules, large and brittle files, residue and secrets, by path."""
    return _file_results(file_facts(files, rules, directive), rules)


def _file_results(facts: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    hits = facts.select("project", "path", F.explode("hits").alias("h")).select("project", "path", "h.*")
    named = with_rule_details(hits.filter(F.col("feed") == "rule").drop("feed", "severity"), rules)
    fixed = {rule[0]: rule for rule in HEURISTICS}
    core = hits.filter(F.col("feed") == "core").withColumns(
        {
            "name": choose(F.col("rule_id"), {k: r[1] for k, r in fixed.items()}, SECRET[0]),
            "suggestion": choose(F.col("rule_id"), {k: r[3] for k, r in fixed.items()}, SECRET[1]),
        }
    )
    return named.unionByName(core.drop("feed"))


def _gated(hits: DataFrame, rules: Sequence[Rule]) -> Column:
    """Whether a hit's rule is for every stack, or for that of the hit's root."""
    own = {r.id: r.stack for r in rules if r.stack != "universal"}
    keep = F.lit(True)
    for rule_id, stack in own.items():
        keep = keep & ((F.col("rule_id") != rule_id) | (F.col("stack") == stack))
    return keep


def core_scan(files: DataFrame, rules: Sequence[Rule], directive: str | None = "scan") -> DataFrame:
    """Results of all ``rules`` and heuristics over a corpus (project, path, content).

    Every root is scanned as a project of its own, with the rules of its stack; test
    files and files outside every root give no results. Project rules have no file.
    One result per rule, file and line is kept, the most severe."""
    return results_of(written(file_facts(files, rules, directive)), rules)


def results_of(facts: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """``core_scan`` from written ``file_facts``."""
    roots = written(settle_stacks(facts))
    mine = assign_project(facts, roots).filter(F.col("root").isNotNull())
    file_rules = [r for r in rules if not r.is_project_rule]
    hits = _file_results(facts, file_rules).join(mine, ["project", "path"])
    hits = hits.filter(_gated(hits, file_rules)).withColumnRenamed("path", "file").select(*RESULT)
    projects = roots.select("project").distinct()
    found = [
        required_missing(facts, rules, roots), missing_filename(facts, projects, rules, roots),
        missing_lockfile(facts, projects, rules, roots),
    ]
    for part in found:
        hits = hits.unionByName(part.withColumns({"file": F.lit(""), "line": F.lit(0)}).select(*RESULT))
    keys = ["project", "root", "stack", "rule_id", "file", "line"]
    best = hits.groupBy(*keys).agg(
        F.min(F.struct(severity_rank(F.col("severity")).alias("n"), "severity", "name", "suggestion")).alias("b")
    )
    return best.select(*keys, "b.severity", "b.name", "b.suggestion").select(*RESULT)


# Audit statuses that take a result out of the score.
SETTLED = ("IGNORED", "TRIAGE")


def deploy_results(facts: DataFrame) -> DataFrame:
    """Deployment findings of ``file_facts`` as results; they belong to no root."""
    hits = facts.select("project", F.col("path").alias("file"), F.explode("hits").alias("h"))
    hits = hits.filter(F.col("h.feed") == "deploy").select("project", "file", "h.rule_id", "h.severity", "h.line").distinct()
    none = F.lit("")
    return hits.withColumns(
        {
            "root": none, "stack": none, "name": F.col("rule_id"),
            "suggestion": choose(F.col("rule_id"), DEPLOY_ADVICE, ""),
        }
    ).select(*RESULT)


def audited_scan(facts: DataFrame, rules: Sequence[Rule], audit: DataFrame) -> DataFrame:
    """Results of the core and of the deployment checks (``source``) with their audit status
    and OWASP class. ``audit``: project, rule_id, file, status."""
    results = results_of(facts, rules).withColumn("source", F.lit("core")).unionByName(
        deploy_results(facts).withColumn("source", F.lit("deploy"))
    )
    return audit_overlay(results, audit, by=("project",)).withColumn("owasp", owasp_category(F.col("rule_id")))


def scan_scores(audited: DataFrame, projects: DataFrame, policies: Sequence[Policy]) -> DataFrame:
    """Scores of all ``projects`` with what the policies look at; one without results has 100."""
    findings = audited.select(
        "project", "source", F.col("rule_id").alias("class"), "severity", "file", "line",
        F.col("audit_status").isin(*SETTLED).alias("ignored"),
    )
    scores = projects.select("project").distinct().join(gate_scores(findings, ["project"], policies), "project", "left")
    clean = scores.fillna({"score": 100, "grade": "A+", "has_critical_failures": False})
    return clean.fillna(0)


def scan_gate(
    files: DataFrame, rules: Sequence[Rule], audit: DataFrame, policies: Sequence[Policy], directive: str | None = "scan"
) -> DataFrame:
    """From texts to the gate: score, grade, number of blocking reasons and status of every
    project under every policy. The corpus is read once, its results once."""
    facts = written(file_facts(files, rules, directive))
    scores = written(scan_scores(audited_scan(facts, rules, audit), facts, policies))
    verdicts = gate_verdict(scores, ["project"], policies)
    return verdicts.join(scores.select("project", "score", "grade", "active_findings", "ignored_findings"), "project")


def scan_summary(results: DataFrame) -> DataFrame:
    """Results per project and severity, with the number of roots and rules concerned."""
    return results.groupBy("project").agg(
        F.count(F.lit(1)).alias("results"), F.countDistinct("root").alias("roots"), F.countDistinct("rule_id").alias("rules"),
        *[F.count_if(F.col("severity") == s).alias(s.lower()) for s in ("CRITICAL", "HIGH", "MEDIUM", "LOW")],
    )
