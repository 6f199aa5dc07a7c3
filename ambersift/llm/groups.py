"""Groups that may be huge: connected components, and sorted groups as a stream."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from .tables import join_counted


def whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables that end where a group ends, from batches sorted by ``key``."""
    rest: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = pa.Table.from_batches([batch])
        if rest is not None:
            now = pa.concat_tables([rest, now])
        k = now[key].to_numpy()
        other = np.flatnonzero(k != k[-1])
        cut = int(other[-1]) + 1 if len(other) else 0
        if cut:
            yield now.slice(0, cut).combine_chunks()
        rest = now.slice(cut)
    if rest is not None and rest.num_rows:
        yield rest.combine_chunks()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): some node of each node's component, the same for all of them, for
    the nodes of ``edges`` (u, v).

    Contraction: every node moves to the neighbour (or stays itself) with the smallest
    hash, edges follow, and edges within a node vanish, until none are left. Hashes
    differ from round to round, so long chains shrink by a constant share as well. A
    hub is settled by partial aggregates and broadcast, not by one task. Each round is
    written, so a lost executor repeats one round.
    """
    edges = written(edges.filter("u <> v").select("u", "v").distinct())
    where: DataFrame | None = None
    seed = 0
    while edges.limit(1).count():
        seed += 1
        ends = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        far = F.xxhash64("v", F.lit(seed))
        move = ends.groupBy("u").agg(F.min_by("v", far).alias("v"), F.min(far).alias("h"), F.count(F.lit(1)).alias("n"))
        to = F.when(F.xxhash64("u", F.lit(seed)) < F.col("h"), F.col("u")).otherwise(F.col("v"))
        move = written(move.select(F.col("u").alias("node"), to.alias("to"), "n"))
        # A node holds n ends in all, on either side: an upper bound for each join.
        left = join_counted(edges.withColumnRenamed("u", "node"), move, "node", "n").select("v", F.col("to").alias("a"))
        both = join_counted(left.withColumnRenamed("v", "node"), move, "node", "n")
        edges = written(both.select(F.col("a").alias("u"), F.col("to").alias("v")).filter("u <> v").distinct())
        step = move.select("node", F.col("to").alias("root"))
        if where is None:
            where = step
        else:
            # Roots that did not move this round are kept: they stand in no edge any more.
            here = where.groupBy("root").agg(F.count(F.lit(1)).alias("n"))
            step = here.join(step.select(F.col("node").alias("root"), F.col("root").alias("to")), "root", "left")
            step = written(step.select("root", "n", F.coalesce("to", "root").alias("to")))
            where = join_counted(where, step, "root", "n").select("node", F.col("to").alias("root"))
        where = written(where)
    if where is None:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return where
