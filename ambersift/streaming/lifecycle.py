"""Run lifecycles: which status changes are legal, as a table job and as a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.ordering import lag_within

# Statuses of a run and the moves allowed from each.
MOVES = {
    "scanning": ("awaiting_agent", "triaging", "finalized"),
    "awaiting_agent": ("triaging", "awaiting_agent", "finalized"),
    "triaging": ("awaiting_agent", "finalized"),
    "finalized": ("awaiting_user_approval", "completed"),
    "awaiting_user_approval": ("fixing", "completed"),
    "fixing": ("verifying",),
    "verifying": ("completed", "awaiting_user_approval"),
    "completed": (),
    "failed": (),
}
TERMINAL = ("completed", "failed")


def verdict_of_move(before: Column, after: Column) -> Column:
    """'start', 'same', 'ok', 'illegal' or 'invalid'; any status may fail."""
    allowed = F.lit(False)
    for source, targets in MOVES.items():
        if targets:
            allowed = allowed | ((before == source) & after.isin(*targets))
    return (
        F.when(~after.isin(*MOVES), F.lit("invalid"))
        .when(before.isNull(), F.lit("start"))
        .when(before == after, F.lit("same"))
        .when(after == "failed", F.lit("ok"))
        .when(allowed, F.lit("ok"))
        .otherwise(F.lit("illegal"))
    )


def run_lifecycle(events: DataFrame) -> DataFrame:
    """Every reported status of a run next to the one before, and whether the move is legal.

    The status before is the last one reported, legal or not."""
    rows = lag_within(events, ["run_id"], [F.col("seq")], F.col("status"), "before")
    move = verdict_of_move(F.col("before"), F.col("status"))
    return rows.select(
        "run_id", "seq", F.coalesce("before", F.lit("")).alias("before"), "status", move.alias("move"),
        F.col("status").isin(*TERMINAL).alias("terminal"),
    )


def run_summary(events: DataFrame) -> DataFrame:
    """Moves by kind, last status and whether a run has ended."""
    per = run_lifecycle(events).groupBy("run_id").agg(
        F.count(F.lit(1)).alias("events"), F.count_if(F.col("move") == "illegal").alias("illegal"),
        F.max(F.struct("seq", "status")).alias("m"),
    )
    return per.select(
        "run_id", "events", "illegal", F.col("m.status").alias("last_status"),
        F.col("m.status").isin(*TERMINAL).alias("terminal"),
    )


def _advance(keep: int | None):
    def advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values("seq")
        status = rows["status"]
        before = status.shift(1)
        before.iloc[0] = last
        # None becomes NaN in a shift; an empty text stands for "nothing before".
        before = before.where(before.notna(), "")
        moves = pd.Series("illegal", index=rows.index)
        allowed = pd.Series(list(zip(before, status)), index=rows.index).isin(_ALLOWED)
        moves[allowed | (status == "failed")] = "ok"
        moves[before == status] = "same"
        moves[before == ""] = "start"
        moves[~status.isin(list(MOVES))] = "invalid"
        last = status.iloc[-1]
        state.update((last,))
        if keep and last in TERMINAL:
            state.setTimeoutDuration(keep)
        yield pd.DataFrame(
            {"run_id": key[0], "seq": rows["seq"], "before": before, "status": status, "move": moves,
             "terminal": status.isin(TERMINAL)}
        )

    return advance


_ALLOWED = [(a, b) for a, targets in MOVES.items() for b in targets]


def stream_run_lifecycle(events: DataFrame, keep: int | None = None) -> DataFrame:
    """The same checks on a stream. One status per run is kept as state; with ``keep`` that
    of a run that has ended leaves after so many milliseconds without an event. (A query
    that has such timeouts never finishes by itself, so a run over what is there has none.)"""
    return events.groupBy("run_id").applyInPandasWithState(
        _advance(keep),
        "run_id long, seq long, before string, status string, move string, terminal boolean",
        "last string", "append", GroupStateTimeout.ProcessingTimeTimeout if keep else GroupStateTimeout.NoTimeout,
    )
