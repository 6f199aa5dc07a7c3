"""Streams over several files: the same results as over the table."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from ambersift.operators.rules import Rule
from ambersift.streaming import changes, feeds, lifecycle


def as_stream(spark, df, path, parts, order):
    """The rows of ``df`` as one file per micro-batch, oldest first."""
    rows = df.withColumn("_part", F.ntile(parts).over(Window.orderBy(order)))
    for i in range(1, parts + 1):
        rows.filter(F.col("_part") == i).drop("_part").coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def run(stream, path, mode="append"):
    """Run to the end of the input and return the sink's table."""
    spark = stream.sparkSession
    out = f"{path}-out"
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}-marks").trigger(availableNow=True)
    if mode == "append":
        writer.format("parquet").option("path", out).start().awaitTermination()
    else:
        writer.foreachBatch(lambda b, e: b.write.mode("overwrite").parquet(out)).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def groups_of(rows, gap, age=None):
    """(workspace, start, path) -> (first change, changes) of (workspace, path, time) rows."""
    out, start, last = {}, {}, {}
    for w, p, t in sorted(rows, key=lambda r: (r[0], r[2])):
        if w not in start or t - last[w] >= gap or (age and t - start[w] >= age):
            start[w] = t
        last[w] = t
        first, n = out.get((w, start[w], p), (t, 0))
        out[w, start[w], p] = (first, n + 1)
    return out


def emitted(df):
    return {(r["workspace"], r["s"], r["path"]): (r["f"], r["events"]) for r in df.select(
        "workspace", F.unix_micros("started_at").alias("s"), "path", F.unix_micros("first_change").alias("f"), "events").collect()}


def test_debounce_emits_closed_groups(spark, tables, tmp_path):
    static = tables.file_events
    stream = as_stream(spark, static, str(tmp_path / "ev"), 3, "changed_at")
    got = emitted(run(changes.debounced_changes(stream, 6 * 3600, "10 seconds", None), str(tmp_path / "ev")))
    rows = changes.relevant_changes(static).select("workspace", "path", F.unix_micros(F.col("changed_at").cast("timestamp")).alias("t"))
    rows = [tuple(r) for r in rows.collect()]
    want = groups_of(rows, 6 * 3600 * 10**6)
    # Every emitted group is complete, and only groups that the watermark has not passed are open.
    ends = {}
    for w, _, t in rows:
        s = max(k[1] for k in want if k[0] == w and k[1] <= t)
        ends[w, s] = max(t, ends.get((w, s), 0))
    mark = max(t for _, _, t in rows) - 10 * 10**6
    assert got and got == {k: v for k, v in want.items() if ends[k[:2]] + 6 * 3600 * 10**6 <= mark}


def test_debounce_out_of_order_late_and_never_quiet(spark, tmp_path):
    """Rows in any order within the delay; a workspace without a quiet second ends its groups by age."""
    rnd = random.Random(3)
    base = 1_700_000_000
    batches = []
    for k in range(6):
        rows = [("busy", f"f{i % 5}.py", base + k * 100 + i) for i in range(100)]
        rows += [(f"w{rnd.randrange(4)}", f"g{rnd.randrange(3)}.py", base + k * 100 + rnd.randrange(100)) for _ in range(25)]
        rnd.shuffle(rows)
        batches.append(rows)
    # Some rows come one batch later, which the delay allows; one comes far too late.
    for k in range(5):
        batches[k + 1] += [batches[k].pop(0) for _ in range(10)]
    every = [r for b in batches for r in b]
    batches[5].append(("w0", "late.py", base - 500))
    batches.append([("end", "x.py", base + 100_000)])
    batches.append([("end", "x.py", base + 200_000)])
    folder = str(tmp_path / "in")
    schema = "op string, workspace string, path string, changed_at timestamp"
    for b in batches:
        rows = spark.createDataFrame([("write", w, p, t) for w, p, t in b], "op string, workspace string, path string, t long")
        rows.select("op", "workspace", "path", F.timestamp_seconds("t").alias("changed_at")).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    got = emitted(run(changes.debounced_changes(stream, 20, "250 seconds", 240), str(tmp_path / "q")))
    got = {k: v for k, v in got.items() if k[0] != "end"}
    assert not any(k[2] == "late.py" for k in got)
    quiet = [(w, p, t * 10**6) for w, p, t in every if w != "busy"]
    assert {k: v for k, v in got.items() if k[0] != "busy"} == groups_of(quiet, 20 * 10**6, 240 * 10**6)
    busy = {k: v for k, v in got.items() if k[0] == "busy"}
    assert sum(n for _, n in busy.values()) == 600
    assert len({k[1] for k in busy}) >= 3 and len(busy) <= 5 * len({k[1] for k in busy})


def test_lifecycle_state_spans_batches(spark, tables, tmp_path):
    stream = as_stream(spark, tables.run_events, str(tmp_path / "runs"), 4, "seq")
    got = run(lifecycle.stream_run_lifecycle(stream), str(tmp_path / "runs"))
    want = lifecycle.run_lifecycle(tables.run_events)
    assert got.count() == want.count()
    assert got.exceptAll(want.select(got.columns)).isEmpty()


def test_first_finding_per_fingerprint(spark, tables, tmp_path):
    rows = tables.findings.select(
        F.col("rule_id"), F.lit("core").alias("type"), F.lit("a.py").alias("file"), F.lit(1).alias("line"),
        F.col("title").alias("message"), "created_at",
    )
    stream = as_stream(spark, rows, str(tmp_path / "f"), 3, "created_at")
    got = run(feeds.stream_dedup(stream, late="90 days").select("fingerprint"), str(tmp_path / "f"))
    assert got.count() == got.distinct().count() == rows.select("rule_id", "message").distinct().count()


def test_running_telemetry_over_batches(spark, tables, tmp_path):
    stream = as_stream(spark, tables.scan_metrics, str(tmp_path / "m"), 3, "scan_id")
    got = run(feeds.running_telemetry(stream), str(tmp_path / "m"), "complete")
    want = feeds.running_telemetry(tables.scan_metrics)
    assert got.exceptAll(want).isEmpty() and got.count() == want.count()


def test_late_rows_are_dropped(spark, tmp_path):
    at = F.col("at").cast("timestamp_ntz").alias("created_at")
    days = [("2024-01-01 10:00:00", "HIGH"), ("2024-01-10 10:00:00", "HIGH"), ("2024-01-20 10:00:00", "low ")]
    path = str(tmp_path / "w")
    for day in days + [("2024-01-01 11:00:00", "HIGH")]:
        spark.createDataFrame([day], "at string, severity string").select(at, "severity").coalesce(1).write.mode(
            "append"
        ).parquet(path)
    schema = "created_at timestamp_ntz, severity string"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    rows = run(feeds.severity_windows(stream, "1 day", late="1 day"), path).collect()
    first = [r for r in rows if r["window_start"].day == 1]
    assert [(r["severity"], r["n"]) for r in first] == [("HIGH", 1)]


def test_incremental_scan_sees_changed_files_only(spark, tmp_path):
    files = spark.createDataFrame(
        [("w", "a.py", "eval(1)"), ("w", "b.py", "eval(2)"), ("w", ".c.py", "eval(3)")],
        "project string, path string, content string",
    )
    path = str(tmp_path / "e")
    spark.createDataFrame([("w", "a.py", "write"), ("w", "b.py", "remove"), ("w", ".c.py", "write")],
                          "workspace string, path string, op string").coalesce(1).write.parquet(path)
    stream = spark.readStream.schema("workspace string, path string, op string").parquet(path)
    out = f"{path}-hits"
    rule = Rule(id="R", extensions=(".py",), target="all", pattern=r"eval\(")
    changes.incremental_scan(
        stream, files, [rule], lambda b, e: b.write.mode("append").parquet(out), f"{path}-marks"
    ).awaitTermination()
    assert [r["path"] for r in spark.read.parquet(out).collect()] == ["a.py"]


@pytest.mark.parametrize("before, after, move", [
    (None, "scanning", "start"), ("scanning", "triaging", "ok"), ("scanning", "fixing", "illegal"),
    ("completed", "failed", "ok"), ("completed", "fixing", "illegal"), ("fixing", "fixing", "same"), ("fixing", "x", "invalid"),
])
def test_moves(spark, before, after, move):
    df = spark.createDataFrame([(before, after)], "b string, a string")
    assert df.select(lifecycle.verdict_of_move(F.col("b"), F.col("a")).alias("m")).first()["m"] == move


def test_debounce_reads_and_writes_state_once_a_batch(monkeypatch):
    import pandas as pd

    from ambersift.streaming import debounce

    class State(list):
        def __init__(self):
            self.calls = 0

        def _call(self, rows):
            self.calls += 1
            self[:] = rows

        put = update = _call

        def get(self):
            self.calls += 1
            return iter(list(self))

        def appendList(self, rows):
            self._call([*self, *rows])

        def clear(self):
            self._call([])

        def exists(self):
            return False

    class Handle:
        def __init__(self):
            self.states, self.timers = [], []

        def getListState(self, name, schema):
            self.states.append(State())
            return self.states[-1]

        getValueState = getMapState = getListState

        def registerTimer(self, at):
            self.timers.append(at)

    class Now:
        def getCurrentWatermarkInMs(self):
            return 10**9

    handle, task = Handle(), debounce.Debounce(10, None)
    task.init(handle)
    # Two runs that a third one joins, and three hundred spans of their own.
    for us in ([0, 18, *range(1000, 301000, 1000)], [9]):
        list(task.handleInputRows(("w",), iter([pd.DataFrame({"us": us, "path": ["p"] * len(us)})]), Now()))
    assert sum(s.calls for s in handle.states) < 30 and len(handle.timers) == 2
    out = pd.concat(task.handleExpiredTimer(("w",), Now(), None))
    assert len(out) == 301
    assert sorted(out["events"])[-1] == 3 and out["first_change"].min() == out["started_at"].min()
    assert all(not s for s in handle.states[:3])


@pytest.mark.parametrize("rows, age", [(100_000, None), (40, None), (40, 60), (100_000, 8)])
def test_debounce_takes_many_workspaces_at_once(monkeypatch, rows, age):
    """A key stands for many workspaces: state is read and written once for all of them."""
    import pandas as pd

    from ambersift.streaming import debounce

    class State(list):
        calls, value = 0, None

        def _call(self, rows):
            self.calls += 1
            self[:] = rows

        def appendList(self, rows):
            self._call([*self, *rows])

        def get(self):
            self.calls += 1
            return self.value or iter(list(self))

        def update(self, value):
            self.value = value

        def clear(self):
            self._call([])
            self.value = None

        def exists(self):
            return self.value is not None

        put = _call

    class Handle:
        states = []

        def getListState(self, name, schema):
            self.states.append(State())
            return self.states[-1]

        getValueState = getListState

        def registerTimer(self, at):
            pass

    class Now:
        def getCurrentWatermarkInMs(self):
            return 10**9

    monkeypatch.setattr(debounce, "_ROWS", rows)
    rnd = random.Random(5)
    batches = [[(rnd.choice([None, *(f"w{i}" for i in range(40))]), f"p{rnd.randrange(3)}", 100 * k + rnd.randrange(100)) for _ in range(200)]
               for k in range(3)]
    handle, Handle.states = Handle(), []
    task = debounce.Debounce(10, age)
    task.init(handle)
    for b in batches:
        if age:  # the age's ends depend on the order in which changes come
            b.sort(key=lambda r: r[2])
        list(task.handleInputRows((7,), iter([pd.DataFrame(b, columns=["workspace", "path", "us"])]), Now()))
    if rows > 600:
        assert sum(s.calls for s in handle.states) < 30
    out = pd.concat(task.handleExpiredTimer((7,), Now(), None))
    micros = [pd.DatetimeIndex(out[c]).as_unit("us").asi8.tolist() for c in ("started_at", "first_change")]
    names = [w if isinstance(w, str) else "" for w in out["workspace"]]
    got = {(w, s, p): (f, n) for w, s, p, f, n in zip(names, micros[0], out["path"], micros[1], out["events"])}
    every = [(w or "", p, t) for b in batches for w, p, t in b]
    assert len(got) == len(out) and got == groups_of(every, 10, age)
    assert all(not s for s in handle.states[:3])
