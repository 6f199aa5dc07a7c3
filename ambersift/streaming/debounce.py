"""Change groups of a stream: keyed state with timers, one row per file of a closed group.

Workspaces are dealt to buckets, and a bucket is a key, as every key and every access to
state is a round trip to the state store. A bucket's open groups are three lists: spans
(workspace, start, last change, id), files (span id, path, first change, changes) and the ids
of spans that another one took over; a list lies in the state as tables of many rows. Rows of
a micro-batch are taken in parts of ``_ROWS``, in any order within the watermark's delay; all
workspaces of a part are cut into quiet-separated runs at once, and runs are merged with the
spans they touch. State is read and written once per bucket and batch. Rows of the
same file are added up when the list has doubled. One timer per bucket stands for the
span that ends first: a span closes when the watermark has passed its last change by the
quiet period, and its rows leave the state. A span that is never quiet ends at ``max_age``:
later changes open the next one. So state is bounded by the files changed within one such
age and the delay, not by the number of changes.

Changes without a time are a group of their own per workspace, which closes at once.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUTPUT = "workspace string, started_at timestamp, path string, first_change timestamp, events long"
NO_TIME = -(1 << 62)  # microseconds of a change without a time
_ROWS = 100_000
_OUT = 10_000
_LONG = pa.int64()
_SPANS = pa.schema([("workspace", pa.string()), ("start", _LONG), ("last", _LONG), ("id", _LONG)])
_FILES = pa.schema([("id", _LONG), ("path", pa.string()), ("first", _LONG), ("events", _LONG)])
_MOVES = pa.schema([("id", _LONG), ("into", _LONG)])


class Debounce(StatefulProcessor):
    """Keys are workspaces, or buckets of them if rows have a column ``workspace``."""

    def __init__(self, gap_us: int, max_age_us: int | None):
        self.gap, self.age = gap_us, max_age_us or 1 << 62

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.spans = handle.getListState("spans", "data binary")
        self.files = handle.getListState("files", "data binary")
        self.moves = handle.getListState("moves", "data binary")
        self.sizes = handle.getValueState("sizes", "rows long, summed long")

    def _keep(self, spans: pd.DataFrame) -> None:
        """Write the spans and set the timer of the one that ends first."""
        if spans.empty:
            self.spans.clear()
            return
        self.spans.put(_packed(spans, _SPANS))
        self.handle.registerTimer(int(self._closes(spans).min()))

    def _append(self, new: pd.DataFrame, moved: pd.DataFrame) -> pd.DataFrame:
        """Write rows of files; the moves that are still to be made."""
        rows, summed = self.sizes.get() if self.sizes.exists() else (0, 0)
        rows += len(new)
        if rows > max(_ROWS, 2 * summed):
            new = _summed(pd.concat([_read(self.files, _FILES), new]), moved)
            rows = summed = len(new)
            self.files.put(_packed(new, _FILES))
            moved = moved[:0]
        elif len(new):
            self.files.appendList(_packed(new, _FILES))
        self.sizes.update((rows, summed))
        return moved

    def _closes(self, spans: pd.DataFrame) -> np.ndarray:
        """Milliseconds after which nothing can join a span."""
        last, start = spans["last"].to_numpy(), spans["start"].to_numpy()
        return -(-np.minimum(last + self.gap, start + self.age) // 1000)

    def _add(self, spans: pd.DataFrame, moved: pd.DataFrame, rows: pd.DataFrame) -> tuple[pd.DataFrame, ...]:
        """Put changes into the open spans: the spans, the moves, and rows of files."""
        n, next_id = len(spans), 1 + int(max(spans["id"].max() if len(spans) else 0, moved["id"].max() if len(moved) else 0))
        both = np.concatenate([spans["workspace"].to_numpy(object), rows["workspace"].to_numpy(object)])
        who, names = pd.factorize(both, use_na_sentinel=False)
        order = np.lexsort((rows["us"].to_numpy(np.int64), who[n:]))
        at, paths = rows["us"].to_numpy(np.int64)[order], rows["path"].to_numpy(object)[order]
        of = who[n:][order]
        # Runs without a quiet period, then groups of runs and spans without one.
        begins = np.flatnonzero(np.r_[True, (np.diff(of) != 0) | (np.diff(at) >= self.gap)])
        ends = np.r_[begins[1:], len(at)]
        whose = np.r_[who[:n], of[begins]]
        start, last = np.r_[spans["start"].to_numpy(), at[begins]], np.r_[spans["last"].to_numpy(), at[ends - 1]]
        by = np.lexsort((start, whose))
        reach = pd.Series(last[by]).groupby(whose[by]).cummax().to_numpy()
        new = np.r_[True, (np.diff(whose[by]) != 0) | (start[by][1:] - reach[:-1] >= self.gap)]
        group = np.empty(len(by), np.int64)
        group[by] = np.cumsum(new) - 1
        at_group = np.flatnonzero(new)
        first, upto = start[by][at_group], reach[np.r_[at_group[1:], len(by)] - 1]
        hit = np.zeros(len(first), bool)
        hit[group[n:]] = True
        # A group shorter than the age is one span, with the id of the earliest one there.
        one = hit & (upto - first < self.age)
        ids = np.zeros(len(first), np.int64)
        early = np.lexsort((start[:n], group[:n]))
        has, k = np.unique(group[:n][early], return_index=True)
        ids[has] = spans["id"].to_numpy()[early][k]
        fresh = np.flatnonzero(one & (ids == 0))
        ids[fresh] = next_id + np.arange(len(fresh))
        next_id += len(fresh)
        gone = one[group[:n]] & (spans["id"].to_numpy() != ids[group[:n]])
        moves = dict(zip(spans["id"].to_numpy()[gone].tolist(), ids[group[:n]][gone].tolist()))
        run = np.repeat(np.arange(len(begins)), ends - begins)
        owner = ids[group[n + run]]
        made = []
        cut = np.flatnonzero(hit & ~one)
        runs, inside = _bounds(group[n:], cut), _bounds(group[:n][early], cut)
        old = [(t, (u, i)) for t, u, i in spans[["start", "last", "id"]].to_numpy()[early].tolist()]
        at_run = np.r_[begins, len(at)].tolist()
        for (run_a, run_b), (a, b) in zip(runs, inside):
            open_, joined = dict(old[a:b]), {}
            starts = list(open_)
            for r in range(run_a, run_b):
                here = slice(at_run[r], at_run[r + 1])
                next_id = self._cut(open_, starts, joined, next_id, at[here], owner[here])
            moves |= joined
            made += [(names[of[begins[run_a]]], start_, *span) for start_, span in open_.items()]
        spans = pd.concat([
            spans[~hit[group[:n]]],
            pd.DataFrame({"workspace": names[whose[by][at_group][one]], "start": first[one], "last": upto[one], "id": ids[one]}),
            pd.DataFrame(made, columns=_SPANS.names).astype({k: np.int64 for k in _SPANS.names[1:]}),
        ])
        files = pd.DataFrame({"id": owner, "path": paths, "at": at}).groupby(["id", "path"], sort=False)["at"].agg(["min", "size"])
        files = files.reset_index().set_axis(_FILES.names, axis=1)
        if moves:
            new_moves = pd.DataFrame({"id": list(moves), "into": list(moves.values())})
            moved = pd.concat([moved.assign(into=_moved(moved["into"], new_moves)), new_moves])
        return spans, moved, files

    def _cut(self, open_: dict, starts: list[int], moves: dict[int, int], next_id: int, at: np.ndarray, owner: np.ndarray) -> int:
        """Put a run of sorted times without a quiet period into the open spans of its workspace, none
        longer than the age; ``owner`` becomes the id of each time's span. The next free id."""
        s, times = 0, at.tolist()
        while s < len(times):
            begin, end = times[s], times[-1]
            near = starts[bisect_right(starts, begin - self.age) : bisect_left(starts, begin + self.age)]
            near = [t for t in near if begin - open_[t][0] < self.gap and t - end < self.gap]
            start = min([begin, *near])
            cut = bisect_left(times, start + self.age, s)
            # Spans that this run joins up move to the earliest start, as far as the age allows.
            near = [t for t in near if open_[t][0] < start + self.age]
            last = times[cut - 1]
            if start in open_:
                i = open_[start][1]
            else:
                i, next_id = next_id, next_id + 1
                insort(starts, start)
            for t in near:
                last = max(last, open_[t][0])
                if t != start:
                    old = open_.pop(t)[1]
                    starts.remove(t)
                    for k in [k for k, into in moves.items() if into == old]:
                        moves[k] = i
                    moves[old] = i
            open_[start] = (last, i)
            owner[s:cut] = i
            s = cut
        return next_id

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        spans, moved = _read(self.spans, _SPANS), _read(self.moves, _MOVES)
        before = moved
        for part in _parts(rows):
            if "workspace" not in part:
                part["workspace"] = pd.Series([key[0]] * len(part), part.index, object)
            spans, moved, new = self._add(spans, moved, part)
            moved = self._append(new, moved)
        if moved is not before:
            self.moves.put(_packed(moved, _MOVES)) if len(moved) else self.moves.clear()
        self._keep(spans)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        spans = _read(self.spans, _SPANS)
        ends = self._closes(spans) <= timerValues.getCurrentWatermarkInMs()
        if not ends.any():
            return  # its span has grown since this timer was set, and has a later one
        files = _summed(_read(self.files, _FILES), _read(self.moves, _MOVES))
        due = spans[ends].sort_values("id")
        gone = files["id"].isin(due["id"]).to_numpy()
        left = files[~gone]
        if len(left):
            self.files.put(_packed(left, _FILES))
            self.sizes.update((len(left), len(left)))
        else:
            self.files.clear()
            self.sizes.clear()
        self.moves.clear()
        self._keep(spans[~ends])
        out = files[gone]
        of = np.searchsorted(due["id"], out["id"])
        out = pd.DataFrame({
            "workspace": due["workspace"].to_numpy(object)[of], "started_at": _times(due["start"].to_numpy()[of]), "path": out["path"].to_numpy(object),
            "first_change": _times(out["first"].to_numpy()), "events": out["events"].to_numpy(),
        })
        for i in range(0, len(out), _OUT):
            yield out[i : i + _OUT]

    def close(self) -> None:
        pass


def _bounds(groups: np.ndarray, of: np.ndarray) -> Iterator[tuple[int, int]]:
    """Where each of the groups ``of`` stands in the sorted ``groups``."""
    return zip(np.searchsorted(groups, of).tolist(), np.searchsorted(groups, of, "right").tolist())


def _parts(chunks: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows in parts of about ``_ROWS``."""
    held: list[pd.DataFrame] = []
    for chunk in chunks:
        held.append(chunk[[c for c in ("workspace", "path", "us") if c in chunk]])
        if sum(map(len, held)) >= _ROWS:
            yield pd.concat(held, ignore_index=True)
            held = []
    if held:
        yield pd.concat(held, ignore_index=True)


def _packed(rows: pd.DataFrame, schema: pa.Schema) -> list[tuple[bytes]]:
    """The rows as values of a list state, each a table of up to ``_ROWS``."""
    out = []
    for i in range(0, len(rows), _ROWS):
        part = rows[i : i + _ROWS]
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, schema) as to:
            to.write_table(pa.table([pa.array(part[f.name].to_numpy(), f.type, from_pandas=True) for f in schema], schema=schema))
        out.append((sink.getvalue().to_pybytes(),))
    return out


def _read(state, schema: pa.Schema) -> pd.DataFrame:
    tables = [pa.ipc.open_stream(bytes(row[0])).read_all() for row in state.get()]
    table = pa.concat_tables(tables) if tables else schema.empty_table()
    return pd.DataFrame({f.name: table[f.name].to_numpy() for f in schema})


def _moved(ids: pd.Series, moved: pd.DataFrame) -> np.ndarray:
    """Each id, or the id of the span that took its span over."""
    ids, moved = ids.to_numpy(), moved.sort_values("id")
    if not len(moved):
        return ids
    old = moved["id"].to_numpy()
    k = np.minimum(np.searchsorted(old, ids), len(old) - 1)
    return np.where(old[k] == ids, moved["into"].to_numpy()[k], ids)


def _summed(files: pd.DataFrame, moved: pd.DataFrame) -> pd.DataFrame:
    """One row per span and file, under the id of the span that took the row's span over."""
    files = files.assign(id=_moved(files["id"], moved))
    return files.groupby(["id", "path"], sort=False, as_index=False).agg({"first": "min", "events": "sum"})


def _times(us: np.ndarray) -> pd.Series:
    """Microseconds as instants; Spark takes plain times to be in the session's zone."""
    return pd.Series(pd.to_datetime(np.where(us == NO_TIME, np.iinfo(np.int64).min, us), unit="us", utc=True))
