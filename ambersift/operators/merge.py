"""One inventory out of many scanners: union, merge, order, number, batch."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.identity import finding_fingerprint, joined
from ..functions.paths import base_name, normalize_path
from ..functions.severity import (
    TYPE_PREFERENCE, semantic_class, severity_rank, type_order, vuln_class_code,
)
from ..functions.text import choose, norm_lower, norm_upper, trimmed
from .ordering import rank_within

ENRICHED = ("project", "rule_id", "type", "source", "severity", "file", "line", "message")


def fingerprint() -> Column:
    return finding_fingerprint(F.col("rule_id"), F.col("type"), F.col("file"), F.col("line"), F.col("message"))


def _enriched(df: DataFrame, **cols: Column) -> DataFrame:
    return df.select(*[cols.get(c, F.col(c) if c in df.columns else F.lit(None)).alias(c) for c in ENRICHED])


def union_scanners(
    core: DataFrame, external: DataFrame, nfr: DataFrame, deploy: DataFrame, network: DataFrame
) -> DataFrame:
    """Five scanner feeds in one schema; message and id are built per source."""
    none, zero = F.lit(""), F.lit(0)
    parts = [
        _enriched(core, type=F.lit("core"), source=F.lit("core"),
                  message=F.concat(F.col("name"), F.lit(": "), F.col("evidence"))),
        _enriched(external, type=F.lit("external"),
                  message=F.concat(F.lit("["), F.col("source"), F.lit("] "), F.col("message"))),
        _enriched(nfr, type=F.lit("nfr"), source=F.lit("core"), file=none, line=zero,
                  message=F.concat(F.col("name"), F.lit(": "), F.col("message"))),
        _enriched(deploy, rule_id=F.col("issue"), type=F.lit("deploy"), source=F.lit("core"),
                  message=F.concat(F.col("issue"), F.lit(". Advice: "), F.col("advice"))),
        _enriched(network, rule_id=F.concat(F.lit("port-"), F.col("port").cast("string")), type=F.lit("network"),
                  source=F.lit("core"), file=none, line=zero,
                  message=F.concat(F.lit("Port "), F.col("port").cast("string"), F.lit(" ("), F.col("service"),
                                   F.lit("): "), F.col("message"))),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


INGESTED = (
    "product_id", "rule_id", "title", "severity", "file_path", "line_number", "description", "fix_suggestion",
    "status", "kanban_column", "stack",
)


def ingest_union(
    core: DataFrame, external: DataFrame, nfr: DataFrame, deploy: DataFrame, network: DataFrame, leaks: DataFrame
) -> DataFrame:
    """Six feeds to stored findings with default severities and synthetic rule ids."""

    def severity(default: str) -> Column:
        return F.coalesce(F.nullif(F.upper(F.col("severity")), F.lit("")), F.lit(default))

    def text(*parts: Column | str) -> Column:
        return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])

    def rows(df: DataFrame, rule, title, sev, file, line, desc, fix, stack) -> DataFrame:
        return df.select(
            F.col("product_id"), rule.alias("rule_id"), title.alias("title"), sev.alias("severity"),
            file.alias("file_path"), line.cast("int").alias("line_number"), desc.alias("description"),
            fix.alias("fix_suggestion"), F.lit("open").alias("status"), F.lit("backlog").alias("kanban_column"),
            stack.alias("stack"),
        )

    c, zero = F.col, F.lit(0)
    deploy_id = text("deploy-", base_name(c("file")), "-", c("line"))
    leak_note = text("Pattern '", c("pattern"), "' found in commit ", c("commit_id"), " by ", c("author"), ": ",
                     c("preview"))
    feeds = [
        rows(core, c("rule_id"), c("name"), F.upper(c("severity")), c("file"), c("line"), c("suggestion"),
             c("suggestion"), c("stack")),
        rows(external, c("rule_id"),
             text("[", c("source"), "] ", F.coalesce(F.nullif(c("rule_id"), F.lit("")), c("message"))),
             severity("MEDIUM"), c("file"), c("line"), c("message"), c("message"), c("source")),
        rows(nfr, c("rule_id"), c("name"), severity("LOW"), F.lit(None).cast("string"), zero, c("message"),
             c("message"), F.lit("nfr")),
        rows(deploy, deploy_id, c("issue"), severity("MEDIUM"), c("file"), c("line"), c("issue"), c("advice"),
             F.lit("deploy")),
        rows(network, text("net-", c("target"), "-", c("port")),
             text("Open port ", c("port"), " (", c("service"), ") on ", c("target")), severity("HIGH"), c("target"),
             zero, c("message"), c("message"), F.lit("network")),
        rows(leaks, text("gitleak-", F.left(c("commit_id"), F.lit(8))),
             text("Secret leak: ", c("pattern"), " in ", c("path")), F.lit("HIGH"), c("path"), zero, leak_note,
             leak_note, F.lit("git-history")),
    ]
    out = feeds[0]
    for feed in feeds[1:]:
        out = out.unionByName(feed)
    return out


def semantic_key() -> Column:
    cls, line = semantic_class(F.col("rule_id")), F.coalesce(F.col("line"), F.lit(0))
    file = F.coalesce(F.col("file"), F.lit(""))
    return (
        F.when(cls == "", F.concat(F.lit("exact|"), fingerprint()))
        .when((file != "") | (line != 0), joined("|", cls, normalize_path(file), line))
        .otherwise(F.concat(cls, F.lit("|project")))
    )


def dedup_semantic(findings: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Merge findings that report one problem, keeping all origins.

    Preferred: core, then external, then nfr; located before unlocated; lower id.
    Exact repeats are counted first by a hash aggregate with map-side combine, so a
    problem repeated in a third of the feed is thinned before anything is hashed,
    sorted or shuffled by merge key."""
    parts = ["rule_id", "type", "source", "severity", "file", "line", "message"]
    rows = findings.groupBy(*by, *parts).agg(F.count(F.lit(1)).alias("_n"))
    file = F.coalesce(F.col("file"), F.lit(""))
    source = F.coalesce(F.nullif(trimmed(F.col("source")), F.lit("")), F.col("type"))
    origin = F.struct(
        F.lower(joined("\x00", F.col("type"), source, F.col("rule_id"))).alias("key"),
        F.struct(F.col("type").alias("type"), source.alias("source"), F.col("rule_id").alias("rule_id")).alias("o"),
    )
    prefer = F.struct(
        (-choose(norm_lower(F.col("type")), TYPE_PREFERENCE, 0)).alias("p"),
        (file == "").alias("unlocated"), F.lower("rule_id").alias("id"),
        severity_rank(F.col("severity")).alias("rank"), file.alias("file"), F.col("line").alias("line"),
        F.col("message").alias("message"), F.col("source").alias("source"), F.col("type").alias("type"),
        F.col("rule_id").alias("rule_id"),
    )
    worst = F.struct(severity_rank(F.col("severity")).alias("rank"), norm_upper(F.col("severity")).alias("severity"))
    place = F.when(file != "", F.struct(file.alias("file"), F.col("line").alias("line")))
    merged = rows.groupBy(*by, semantic_key().alias("merge_key")).agg(
        F.min(prefer).alias("p"), F.min(worst).alias("w"), F.min(place).alias("at"), F.sum("_n").alias("merged"),
        # Distinct (type, source, rule) only: as many as a merged problem has scanners and rules.
        F.collect_set(origin).alias("os"),
    )
    moved = (F.col("p.file") == "") & F.col("at").isNotNull()
    firsts = F.transform(F.array_sort("os"), lambda s: s["key"])
    os = F.array_sort("os")
    one_each = F.filter(os, lambda s, i: (i == 0) | (s["key"] != F.try_element_at(firsts, i)))
    return merged.select(
        *by, "merge_key", F.col("p.rule_id").alias("rule_id"), F.col("p.type").alias("type"),
        F.col("p.source").alias("source"), F.col("w.severity").alias("severity"),
        F.when(moved, F.col("at.file")).otherwise(F.col("p.file")).alias("file"),
        F.when(moved, F.col("at.line")).otherwise(F.col("p.line")).alias("line"),
        F.col("p.message").alias("message"), F.col("merged"),
        F.transform(one_each, lambda s: s["o"]).alias("origins"),
    )


def origins_text(origins: Column) -> Column:
    return F.array_join(
        F.transform(origins, lambda o: joined("/", o["type"], o["source"], o["rule_id"])), ";"
    )


def canonical_order() -> list[Column]:
    """Type, source, severity, path, line, id, message, fingerprint."""
    return [
        type_order(F.col("type")), norm_lower(F.col("source")), severity_rank(F.col("severity")),
        normalize_path(F.col("file")), F.col("line"), norm_lower(F.col("rule_id")), trimmed(F.col("message")),
        fingerprint(),
    ]


def canonical_sort(findings: DataFrame, *tie: str) -> DataFrame:
    return findings.orderBy(*canonical_order(), *tie)


def canonical_places(findings: DataFrame, *tie: str, by: Sequence[str] = ()) -> DataFrame:
    """Place of every finding (within its project, if ``by`` names one) in the canonical
    order, as a column."""
    return rank_within(findings, list(by), [*canonical_order(), *[F.col(t) for t in tie]], "place")


def canonical_vuln_ids(findings: DataFrame, by: Sequence[str] = (), tie: Sequence[str] = ()) -> DataFrame:
    """Number the findings of each vulnerability class in canonical order. With ``by`` a
    project numbers its own, so findings elsewhere do not change its ids."""
    order = {f"_k{i}": c for i, c in enumerate(canonical_order())}
    keyed = findings.withColumns({**order, "class_code": vuln_class_code(F.col("message"))})
    keys = [F.col(c) for c in order] + [F.col(t) for t in tie]
    ranked = rank_within(keyed, [*by, "class_code"], keys, "_seq").drop(*order)
    n = F.col("_seq").cast("string")
    padded = F.when(F.length(n) < 3, F.lpad(n, 3, "0")).otherwise(n)
    return ranked.withColumn("vuln_id", F.concat(F.lit("CS-"), F.col("class_code"), F.lit("-"), padded)).drop("_seq")


def dedup_exact(findings: DataFrame, index: str = "idx", by: Sequence[str] = ()) -> DataFrame:
    """Every original index with its fingerprint, the first index of its group
    and the group's size: one row per finding, so no list grows with a group."""
    keyed = findings.select(*by, index, fingerprint().alias("fingerprint"))
    groups = keyed.groupBy(*by, "fingerprint").agg(
        F.min(index).alias("first_idx"), F.count(F.lit(1)).alias("group_size")
    )
    return keyed.join(groups, [*by, "fingerprint"]).withColumn("is_first", F.col(index) == F.col("first_idx"))


def unique_findings(findings: DataFrame, index: str = "idx", by: Sequence[str] = ()) -> DataFrame:
    """First finding of each fingerprint."""
    cols = [c for c in findings.columns if c not in (*by, index)]
    keyed = findings.withColumn("fingerprint", fingerprint())
    first = keyed.groupBy(*by, "fingerprint").agg(
        F.min(F.struct(index, *cols)).alias("f"), F.count(F.lit(1)).alias("group_size")
    )
    return first.select(*by, "fingerprint", "group_size", "f.*")


def dedup_scan(findings: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One finding per rule if it has no place, else per rule, file and line."""
    file, line = F.coalesce(F.col("file"), F.lit("")), F.coalesce(F.col("line"), F.lit(0))
    unplaced = (file == "") & (line == 0)
    key = F.when(unplaced, F.col("rule_id")).otherwise(joined(":", F.col("rule_id"), file, line))
    rest = [c for c in findings.columns if c not in (*by, *order)]
    first = findings.groupBy(*by, key.alias("scan_key")).agg(F.min(F.struct(*order, *rest)).alias("f"))
    return first.select(*by, "scan_key", "f.*")


def project_verdicts(findings: DataFrame, verdicts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The verdict of each unique finding back on every duplicate."""
    keyed = findings.withColumn("fingerprint", fingerprint())
    return keyed.join(verdicts, [*by, "fingerprint"])


def batches(df: DataFrame, order: Sequence[Column], size: int = 150, by: Sequence[str] = ()) -> DataFrame:
    """Number rows and group them into batches of ``size``."""
    ranked = rank_within(df, list(by), order, "position")
    return ranked.withColumn("batch", F.floor((F.col("position") - 1) / size).cast("long"))


def min_index_marks(df: DataFrame, keys: Sequence[str], index: str) -> DataFrame:
    """Later rows with the same keys point to the smallest index; null keys never match."""
    present = F.lit(True)
    for k in keys:
        present = present & F.col(k).isNotNull()
    first = df.filter(present).groupBy(*keys).agg(F.min(index).alias("_first"))
    joined_df = df.join(first, list(keys), "left")
    dup = F.col("_first").isNotNull() & (F.col(index) != F.col("_first"))
    return joined_df.withColumns(
        {"is_duplicate": dup, "duplicate_of": F.when(dup, F.col("_first"))}
    ).drop("_first")


def mark_duplicates(findings: DataFrame) -> DataFrame:
    return min_index_marks(findings, ["product_id", "hash_code"], "id")
