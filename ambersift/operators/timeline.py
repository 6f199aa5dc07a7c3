"""History over time: telemetry, git statistics, token use, dependency graphs."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions.identity import joined, sha256_hex
from ..session import bucketed, slice_count
from .ordering import running_within
from .triage import _digest_list

# ---- telemetry ------------------------------------------------------------


def telemetry_totals(m: DataFrame, by: Sequence[str] = ("project",)) -> DataFrame:
    return m.groupBy(*by).agg(
        F.count(F.lit(1)).alias("scans"), F.sum("files_scanned").alias("files"),
        F.sum("findings_total").alias("findings"), F.round(F.avg("security_score"), 6).alias("mean_score"),
    )


def running_mean_score(m: DataFrame) -> DataFrame:
    """Mean score of a project up to each of its scans."""
    out = running_within(
        m, ["project"], [F.col("scanned_at"), F.col("scan_id")], F.col("security_score").cast("long"), "_total", "_count"
    )
    return out.withColumn("mean_score", F.round(F.col("_total") / F.col("_count"), 6)).drop("_total", "_count")


def last_n_scans(m: DataFrame, n: int = 100) -> DataFrame:
    """Newest ``n`` scans of each project, numbered from the newest."""
    order = Window.partitionBy("project").orderBy(F.desc("scanned_at"), F.desc("scan_id"))
    return m.withColumn("age", F.row_number().over(order)).filter(F.col("age") <= n)


def score_trend(m: DataFrame, span: int = 5) -> DataFrame:
    """Whole mean of the last ``span`` scans minus that of the ``span`` before; 0 without both."""
    last = last_n_scans(m, 2 * span)
    recent = F.col("age") <= span
    per = last.groupBy("project").agg(
        F.sum(F.when(recent, F.col("security_score"))).alias("_rs"), F.count_if(recent).alias("_rn"),
        F.sum(F.when(~recent, F.col("security_score"))).alias("_ps"), F.count_if(~recent).alias("_pn"),
    )
    mean_r = F.floor(F.col("_rs") / F.col("_rn"))
    mean_p = F.floor(F.col("_ps") / F.nullif(F.col("_pn"), F.lit(0)))
    trend = F.when(F.col("_pn") > 0, mean_r - mean_p).otherwise(0).cast("long")
    return per.select("project", trend.alias("trend"))


def llm_usage(usage: DataFrame) -> DataFrame:
    """Token sums per run and stage without empty stages; the rest is reasoning or other."""
    per = usage.groupBy("run_id", "stage").agg(
        F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"),
        F.sum("total_tokens").alias("total_tokens"),
    )
    used = per.filter((F.col("prompt_tokens") != 0) | (F.col("completion_tokens") != 0) | (F.col("total_tokens") != 0))
    other = F.greatest(F.col("total_tokens") - F.col("prompt_tokens") - F.col("completion_tokens"), F.lit(0))
    return used.withColumn("other_tokens", other.cast("long"))


# Outcomes that count as covered.
COVERED = ("completed", "not_applicable")


def scanner_coverage(executions: DataFrame, required: Sequence[str]) -> DataFrame:
    """Missing required scanners per scan, and full or partial coverage.

    The required names are constants, so each scan needs one aggregated row only."""
    per = executions.groupBy("scan_id").agg(
        *[
            F.max((F.col("scanner") == s) & F.col("status").isin(*COVERED)).alias(f"_{i}")
            for i, s in enumerate(required)
        ]
    )
    gaps = F.array_compact(F.array(*[F.when(~F.col(f"_{i}"), F.lit(s)) for i, s in enumerate(required)]))
    return per.select(
        "scan_id", F.size(gaps).cast("long").alias("missing"), F.array_join(gaps, ",").alias("missing_scanners"),
        F.when(F.size(gaps) == 0, F.lit("full")).otherwise(F.lit("partial")).alias("coverage"),
    )


# ---- git ------------------------------------------------------------------

HIGH_CHURN_COMMITS, HIGH_CHURN_LINES = 30, 1000


STAT_ROWS = 200_000  # rows a task takes


def git_file_stats(numstat: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Commits, authors, lines and last change per file, with the bulk-addition score;
    ``by`` names the columns that tell projects apart.

    Rows are nearly all different, so they are dealt out by commit, and once more by author,
    to as many tasks as they ask for, and each counts what it alone has. Two distinct counts
    in one aggregate would treble the rows, and partitions that compress well would be put
    together into a few tasks with large hash tables."""
    file = [*by, "file_path"]
    tasks = max(numstat.sparkSession.sparkContext.defaultParallelism, numstat.count() // STAT_ROWS + 1)
    per_author = numstat.repartition(tasks, *file, "commit_id").groupBy(*file, "commit_id", "author_email").agg(
        F.sum("additions").alias("_a"), F.sum("deletions").alias("_d"), F.max("committed_at").alias("_at")
    )
    commits = per_author.groupBy(*file, "commit_id").agg(
        F.sum("_a").alias("_a"), F.sum(F.col("_a") + F.col("_d")).alias("_l"), F.max("_at").alias("_at")
    )
    authors = numstat.select(*file, "author_email").repartition(tasks, *file, "author_email").distinct()
    zero = F.lit(0).cast("long")
    rows = commits.select(*file, F.col("commit_id").isNotNull().cast("long").alias("_c"), zero.alias("_e"), "_a", "_l", "_at").unionByName(
        authors.select(*file, zero.alias("_c"), F.col("author_email").isNotNull().cast("long").alias("_e")), allowMissingColumns=True
    )
    per = rows.groupBy(*file).agg(
        F.sum("_c").alias("commits"), F.sum("_e").alias("authors"), F.sum("_a").alias("additions"),
        F.sum("_l").alias("lines_changed"), F.max("_at").alias("last_modified"),
    )
    each = F.col("additions") / F.col("commits")
    return per.withColumn("agentic_score", F.when(each > 500, 0.8).when(each > 200, 0.4).otherwise(0.0))


def high_churn(
    numstat: DataFrame, by: Sequence[str] = (), commits: int = HIGH_CHURN_COMMITS, lines: int = HIGH_CHURN_LINES
) -> DataFrame:
    return git_file_stats(numstat, by).filter(
        (F.col("commits") >= commits) & (F.col("authors") <= 1) & (F.col("lines_changed") > lines)
    )


def tree_fingerprint(files: DataFrame, levels: Sequence[int] = (4, 2)) -> DataFrame:
    """Digest of all (path, content) of a project.

    Entries are hashed in buckets by a prefix of their path's hash, then the
    bucket digests by a shorter prefix, then those: any project size fits."""
    place = sha256_hex(F.col("path"))
    entry = joined("|", F.col("path"), sha256_hex(F.col("content")))
    rows = files.select("project", place.alias("_i"), entry.alias("_v"), F.lit(1).cast("long").alias("_n"))
    for width in levels:
        lists = rows.groupBy("project", F.left("_i", F.lit(width)).alias("_c")).agg(
            F.array_sort(F.collect_list(F.struct("_i", "_v"))).alias("_l"), F.sum("_n").alias("_n")
        )
        rows = lists.select("project", F.col("_c").alias("_i"), _digest_list("_l").alias("_v"), "_n")
    whole = rows.groupBy("project").agg(
        F.array_sort(F.collect_list(F.struct("_i", "_v"))).alias("_l"), F.sum("_n").alias("files")
    )
    return whole.select("project", "files", _digest_list("_l").alias("digest"))


# ---- dependency graph -----------------------------------------------------


def dep_nodes(edges: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per package: direct and reverse dependencies, root and leaf marks."""
    ends = edges.select(
        *by,
        F.explode(
            F.array(
                F.struct(F.col("parent").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")),
                F.struct(F.col("child").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")),
            )
        ).alias("e"),
    ).select(*by, "e.*")
    per = ends.groupBy(*by, "node").agg(F.sum("o").alias("direct"), F.sum("i").alias("reverse"))
    return per.withColumns({"is_root": F.col("reverse") == 0, "is_leaf": F.col("direct") == 0})


def dep_graph_stats(edges: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    nodes = dep_nodes(edges.select(*by, "parent", "child").distinct(), by)
    return nodes.groupBy(*by).agg(
        F.count(F.lit(1)).alias("nodes"), F.sum("direct").alias("edges"), F.count_if(F.col("is_root")).alias("roots"),
        F.count_if(F.col("is_leaf")).alias("leaves"), F.max("direct").alias("max_direct"),
        F.max("reverse").alias("max_reverse"),
    )


def dep_closure(edges: DataFrame, roots: DataFrame, by: Sequence[str] = (), hops: int = 2) -> DataFrame:
    """Packages reachable from the roots with their depth; each is entered once.

    Edges lie in buckets by parent and the packages found so far in buckets by node, so
    that neither is exchanged: what moves in a round are the children of the frontier. A
    round goes ``hops`` levels deep and appends its new packages to the table of those
    found, so lineage stays short and a lost executor costs one round. It ends when a
    round finds nothing new, however deep that is."""
    by, spark, buckets = list(by), edges.sparkSession, slice_count(edges.sparkSession)
    mark = uuid.uuid4().hex
    links = bucketed(edges.select(*by, "parent", "child"), [*by, "parent"], f"links_{mark}", buckets)
    first = roots.select(*by, "node").distinct().withColumn("depth", F.lit(0))
    seen, level = bucketed(first, [*by, "node"], f"nodes_{mark}", buckets), 0
    while True:
        frontier, steps = seen.filter(F.col("depth") == level), []
        for hop in range(1, hops + 1):
            step = links.join(frontier.select(*by, F.col("node").alias("parent")), [*by, "parent"], "left_semi")
            frontier = step.select(*by, F.col("child").alias("node")).distinct()
            steps.append(frontier.withColumn("depth", F.lit(level + hop)))
        # A package that is found again, or by a longer way, drops out.
        fresh = reduce(DataFrame.unionByName, steps).groupBy(*by, "node").agg(F.min("depth").alias("depth"))
        found = Observation()
        fresh = fresh.join(seen, [*by, "node"], "left_anti").observe(found, F.count(F.lit(1)).alias("n"))
        seen = bucketed(fresh, [*by, "node"], f"nodes_{mark}", buckets)
        level += hops
        if found.get["n"] == 0:
            spark.sql(f"DROP TABLE links_{mark}")
            return seen


def dep_roots(edges: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Packages nothing depends on."""
    children = edges.select(*by, F.col("child").alias("node")).distinct()
    return edges.select(*by, F.col("parent").alias("node")).distinct().join(children, [*by, "node"], "left_anti")
