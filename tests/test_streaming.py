"""Streams against their batch results: shuffled files, late rows, restarts, replayed batches."""

import datetime as dt
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from atomweave.operators.work import fresh_path
from atomweave.plans import streams
from atomweave.streaming import telemetry as T
from atomweave.streaming.devices import DeviceProcessor, process
from atomweave.streaming.sinks import KeyedTable, drain, sink

EVENT = "event_id long, ts timestamp, user_id long, event_type string, value double"
BEGIN = dt.datetime(2024, 1, 1)


def events(n=900, seed=1):
    r, out = random.Random(seed), []
    for i in range(n):
        value = r.gauss(0, 1) if r.random() > 0.03 else r.choice([40.0, -35.0, None, float("nan")])
        out.append((i, BEGIN + dt.timedelta(seconds=r.randint(0, 3000), microseconds=r.randint(0, 999_999)), r.choice([1, 2, 2, 2, None]), r.choice(["cpu", "disk", "error"]), value))
    out += [(n + i, BEGIN + dt.timedelta(seconds=100), 7, "cpu", 1.0) for i in range(250)]  # one slot of three batches
    return [*out, (n + 900, BEGIN + dt.timedelta(days=2), 99, "cpu", 0.0)]  # moves the watermark past the others


def plain(rows, keep=20, least=5):
    """Processed, errors and anomalies by device, in order of time."""
    status, anomalies, history = {}, set(), {}
    for e, at, user, metric, v in sorted((r for r in rows if r[2] != 99), key=lambda r: (r[1], r[0])):
        s = status.setdefault(user, [0, 0])
        s[0] += 1
        if v is None or v != v:
            s[1] += 1
            continue
        h = history.setdefault((user, metric), [])
        h.append(v)
        del h[:-keep]
        if len(h) > least and abs(v - np.mean(h)) > 3 * np.std(h):
            anomalies.add((user, e, metric))
    return {u: tuple(s) for u, s in status.items()}, anomalies


def source(spark, path, rows):
    spark.createDataFrame(rows, EVENT).coalesce(1).write.mode("append").parquet(path)


def stream(spark, path):
    return process(T.read(spark, path, EVENT), late="2 hours", critical=("error",), keep=20, least=5)


def test_devices_equal_batch_on_shuffled_files_and_restarts(spark):
    rows = events()
    last, rest = rows[-1], rows[:-1]
    random.Random(2).shuffle(rest)
    folder, out, checkpoint = (fresh_path(spark, x) for x in ("source", "out", "checkpoint"))
    for part in (rest[:400], rest[400:700], rest[700:]):
        source(spark, folder, part)
        drain(stream(spark, folder), path=out, checkpoint=checkpoint)  # each run goes on with the state of the one before
    source(spark, folder, [last])
    got = drain(stream(spark, folder), path=out, checkpoint=checkpoint).collect()
    status, anomalies = plain(rows)
    batches = [r for r in got if r["kind"] == "batch"]
    assert {u: (max(r["processed"] for r in batches if r["device"] == u), max(r["errors"] for r in batches if r["device"] == u)) for u in status} == status
    assert {(r["device"], r["event_id"], r["metric"]) for r in got if r["kind"] == "anomaly"} == anomalies and anomalies
    assert Counter(r["event_id"] for r in got if r["kind"] == "critical") == Counter(e for e, _, u, m, _ in rows if m == "error" and u != 99)
    assert sorted(r["n"] for r in batches if r["device"] == 7) == [50, 100, 100]
    again = drain(stream(spark, folder), path=out, checkpoint=checkpoint)
    assert again.count() == len(got)  # nothing new, nothing twice


def test_overflow_and_idle(spark):
    folder = fresh_path(spark, "source")
    source(spark, folder, [(i, BEGIN, 1, "cpu", float(i)) for i in range(30)] + [(50, BEGIN + dt.timedelta(days=3), 9, "cpu", 0.0)])
    got = drain(process(T.read(spark, folder, EVENT), queue=20, batch=8, idle_seconds=3600)).collect()
    assert [r["n"] for r in got if r["kind"] == "rejected"] == [10]
    assert sorted(r["n"] for r in got if r["kind"] == "batch") == [4, 8, 8]
    source(spark, folder, [(51, BEGIN + dt.timedelta(days=9), 9, "cpu", 0.0)])
    kinds = Counter(r["kind"] for r in drain(process(T.read(spark, folder, EVENT), queue=20, batch=8, idle_seconds=3600)).collect() if r["device"] == 1)
    assert kinds["idle"] == 1


def test_late_rows_sliding_windows_and_sessions(spark):
    folder, hour = fresh_path(spark, "source"), dt.timedelta(hours=1)
    source(spark, folder, [(0, BEGIN, 1, "a", 1.0), (1, BEGIN + 20 * hour, 1, "a", 1.0)])
    source(spark, folder, [(4, BEGIN + 40 * hour, 1, "a", 1.0)])  # rows are late by the watermark that the batch before began with
    source(spark, folder, [(2, BEGIN + hour, 1, "a", 1.0), (3, BEGIN + 80 * hour, 1, "a", 1.0)])  # event 2 is behind it
    read = lambda: T.read(spark, folder, EVENT)
    counts = {r["w"]["start"]: r["n"] for r in drain(T.sliding(read())).collect()}
    assert counts == {BEGIN + (at - k) * hour: 1 for k in range(6) for at in (0, 20, 40)}
    got = {(r["user_id"], r["begins"], r["ends"], r["n"]) for r in drain(T.sessions(read())).collect()}
    assert got == {(1, BEGIN + at * hour, BEGIN + at * hour, 1) for at in (0, 20, 40)}


EDGE = "src string, dst string, seq long, weight double, gone boolean"


@pytest.fixture
def edges(spark):
    return KeyedTable(spark, fresh_path(spark, "edges"), EDGE, ("src", "dst"), ("seq",), "gone", buckets=4)


def test_upserts_are_idempotent_and_ordered(spark, edges):
    df = lambda rows: spark.createDataFrame(rows, EDGE)
    state = lambda: {(r["src"], r["dst"]): (r["seq"], r["weight"]) for r in edges.read().collect()}
    assert state() == {} and edges.changes().count() == 0
    first = df([("a", "b", 1, 1.0, False), ("a", "b", 2, 2.0, False), ("a", "b", 2, 2.0, False), ("b", "c", 1, 1.0, False), (None, "c", 1, 1.0, False)])
    edges.upsert(first, 0)
    assert state() == {("a", "b"): (2, 2.0), ("b", "c"): (1, 1.0)}
    second = df([("a", "b", 1, 9.0, False), ("b", "c", 5, None, True), ("c", "d", 1, 4.0, False), ("x", "y", 3, None, True)])
    for _ in range(3):  # a batch that is run again changes nothing
        edges.upsert(second, 1)
        assert state() == {("a", "b"): (2, 2.0), ("c", "d"): (1, 4.0)}
    edges.upsert(df([("b", "c", 4, 4.0, False), ("x", "y", 2, 2.0, False), ("a", "b", 3, 3.0, False)]), 2)  # late for two deleted edges
    assert state() == {("a", "b"): (3, 3.0), ("c", "d"): (1, 4.0)}
    edges.upsert(df([("b", "c", 6, 6.0, False)]).limit(0), 3)
    got = [(r["batch"], r["op"], r["new"]["src"], r["old"] and r["old"]["weight"]) for r in edges.changes().collect()]
    assert sorted(got, key=repr) == [(0, "insert", "a", None), (0, "insert", "b", None), (1, "delete", "b", 1.0), (1, "insert", "c", None), (2, "update", "a", 2.0)]


def test_stream_into_a_table_and_its_feed(spark, edges):
    folder, feed, mark = (fresh_path(spark, x) for x in ("source", "feed", "checkpoint"))
    r, rows = random.Random(9), []
    for i in range(300):
        rows.append((r.choice("abcd"), r.choice("wxyz"), i, float(i), r.random() < 0.2))
    late = rows[:]
    r.shuffle(late)
    want = {}
    for s, d, seq, w, gone in rows:
        want[s, d] = None if gone else (seq, w)
    checkpoint = fresh_path(spark, "checkpoint")
    for part in (late[:100], late[50:200], late[200:]):  # with repeated rows
        spark.createDataFrame(part, EDGE).repartition(2).write.mode("append").parquet(folder)
        source = spark.readStream.schema(EDGE).option("maxFilesPerTrigger", 1).parquet(folder)
        sink(source, edges, checkpoint).awaitTermination()
        seen = drain(edges.change_stream(), path=feed, checkpoint=mark)
    assert {(x["src"], x["dst"]): (x["seq"], x["weight"]) for x in edges.read().collect()} == {k: v for k, v in want.items() if v}
    replayed = {}
    for x in sorted(seen.collect(), key=lambda x: x["batch"]):  # the feed leads to the same table
        k = x["new"]["src"], x["new"]["dst"]
        assert (x["op"] == "insert") == (k not in replayed)
        if x["op"] == "delete":
            del replayed[k]
        else:
            replayed[k] = x["new"]["seq"], x["new"]["weight"]
    assert replayed == {k: v for k, v in want.items() if v}
    assert seen.where(F.col("op") == "delete").count() > 0


def test_three_sigma_over_files_and_frames_out_of_order(spark, tmp_path):
    r = random.Random(4)
    rows = [(i, BEGIN + dt.timedelta(hours=i), i % 3, "cpu", r.gauss(0, 1) if r.random() > 0.05 else r.choice([30.0, None])) for i in range(400)]
    r.shuffle(rows)
    folder = f"{tmp_path}/events.parquet"
    for part in (rows[:200], rows[200:]):
        source(spark, folder, part)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 16)  # a user's rows come in several frames
    try:
        got = {r["event_id"]: r["alarm"] for r in streams.QUERIES["stream_three_sigma"](spark, str(tmp_path)).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want, held = {}, {}
    for e, _, user, _, v in sorted(rows):
        h = held.setdefault(user, [])
        h.append(v)
        del h[:-100]
        if len(h) > 10:
            s = np.array([x for x in h if x is not None])
            want[e] = None if v is None else bool(abs(v - s.mean()) > 3 * s.std())
    assert got == want and True in want.values() and None in want.values()


class Counted:
    """Stands for a device's state and counts the calls."""

    def __init__(self):
        self.calls, self.held, self.timers = 0, {}, set()

    def getListState(self, name, *_):
        return Cell(self, name)

    getMapState = getValueState = getListState

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)

    def deleteTimer(self, at):
        self.calls += 1
        self.timers.discard(at)


class Cell:
    def __init__(self, state, name):
        self.state, self.name = state, name

    def __getattr__(self, what):
        held = self.state.held

        def call(*a):
            self.state.calls += 1
            if what == "get":
                return held.get(self.name, [])
            if what in ("update", "put"):
                held[self.name] = a[0]
            elif what in ("appendValue", "appendList"):
                held.setdefault(self.name, []).extend([a[0]] if what == "appendValue" else a[0])
            elif what == "clear":
                held.pop(self.name, None)
            else:
                return self.name in held

        return call


class At:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def test_calls_to_a_device_state_do_not_grow_with_its_rows():
    import pandas as pd

    calls = []
    for n in (50, 500):
        state = Counted()
        p = DeviceProcessor(frozenset(["error"]), 100, 10_000, 100, 10, 3.0, 3600)
        p.init(state)
        f = pd.DataFrame({"us": [i * 2_000_000 for i in range(n)], "event_id": range(n), "metric": ["error"] * n, "value": [float(i % 7) for i in range(n)]})
        assert [*p.handleInputRows((1,), iter([f]), None)] == [] and state.timers == {1000}
        out = pd.concat(p.handleExpiredTimer((1,), At(2000 * (n - 1)), None))  # all but the last
        assert (out["kind"] == "critical").sum() == n - 1 and out["processed"].max() == n - 1
        assert 2000 * (n - 1) + 1000 in state.timers
        calls.append(state.calls)
    assert calls[0] == calls[1]
