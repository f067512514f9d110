"""Device state as a stateful stream processor: ordered flushes, history, alarms, counts and expiry.

Rows of a device wait in state until the watermark has passed their flush slot (one second), so late and out-of-order rows are taken in the order of (time, event) whatever
files they came in. A slot is then processed in batches of ``batch`` rows. For each metric the last ``keep`` values are kept; a value of more
than ``sigmas`` deviations from the mean of more than ``least`` values, itself among them, is an anomaly. A metric that is named critical sets off
a row of its own. Null and non-finite values count as errors and are in no history. Of one slot and device at most ``queue`` rows
wait; further ones are rejected, and a row says how many. A device that is silent for ``idle`` is forgotten.

A device's waiting rows are one list and it has one timer, so calls to the state grow with devices and batches, not with rows.

Rows behind the watermark on arrival are left out by the engine, which counts them in its progress. Rows of slots that the watermark hasn't passed stay in state:
a stream that is started again on its checkpoint goes on with them. Null devices are one device.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = {"device": "long", "kind": "string", "us": "long", "event_id": "long", "metric": "string", "value": "double", "mean": "double", "deviation": "double", "n": "long", "processed": "long", "errors": "long"}
SECOND = 1_000_000


class DeviceProcessor(StatefulProcessor):
    def __init__(self, critical: frozenset[str], batch: int, queue: int, keep: int, least: int, sigmas: float, idle_seconds: int):
        self.critical, self.batch, self.queue, self.keep, self.least, self.sigmas, self.idle = critical, batch, queue, keep, least, sigmas, idle_seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "rows binary")  # Arrow streams, one a batch
        self.history = handle.getListState("history", "metric string, held array<double>")
        # timer is the one that is set: the end of the first slot that waits, else when the device is forgotten
        self.status = handle.getValueState("status", "us long, processed long, errors long, idle long, waiting long, timer long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        out, new = [], []
        for f in rows:
            new += zip(f["us"].tolist(), f["event_id"].tolist(), f["metric"].tolist(), [None if v != v else v for v in f["value"].tolist()])
        last, processed, errors, idle, waiting, timer = self._status()
        if waiting + len(new) > self.queue:  # only then can a slot be full
            held = Counter(us // SECOND for us, *_ in self._waiting()) if waiting else Counter()
            kept, rejected = [], Counter()
            for r in new:
                slot = r[0] // SECOND
                if held[slot] < self.queue:
                    held[slot] += 1
                    kept.append(r)
                else:
                    rejected[slot] += 1
            new = kept
            out = [self._row(key, "rejected", slot * SECOND, n=n) for slot, n in sorted(rejected.items())]
        if new:
            self.waiting.appendValue((self._packed(new),))
            due = (min(r[0] for r in new) // SECOND + 1) * 1000
            timer = self._set(timer, min(due, timer) if waiting else due)
            self.status.update((last, processed, errors, idle, waiting + len(new), timer))
        if out:
            yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark, out = timerValues.getCurrentWatermarkInMs(), []
        last, processed, errors, idle, waiting, _ = self._status()
        held = sorted(self._waiting(), key=lambda r: (r[0], r[1])) if waiting else []
        due = [r for r in held if (r[0] // SECOND + 1) * 1000 <= mark]
        held = held[len(due) :]
        history = {name: [*past] for name, past in self.history.get()} if due and processed else {}
        for _slot, slot_rows in groupby(due, lambda r: r[0] // SECOND):
            rows = list(slot_rows)
            for at in range(0, len(rows), self.batch):
                part = rows[at : at + self.batch]
                for us, event_id, metric, value in part:
                    last, processed = us, processed + 1
                    if metric in self.critical:
                        out.append(self._row(key, "critical", us, event_id, metric, value))
                    if value is None or not np.isfinite(value):
                        errors += 1
                        continue
                    past = history.setdefault(metric or "", [])
                    past.append(value)
                    del past[: -self.keep]
                    if len(past) > self.least:
                        x = np.array(past)
                        mean, deviation = x.mean(), x.std()
                        if abs(value - mean) > self.sigmas * deviation:
                            out.append(self._row(key, "anomaly", us, event_id, metric, value, mean, deviation))
                out.append(self._row(key, "batch", part[0][0], n=len(part), processed=processed, errors=errors))
        if history:
            self.history.put([*history.items()])
        if due:
            idle = last // 1000 + self.idle
            self.waiting.put([(self._packed(held),)]) if held else self.waiting.clear()
        elif idle and idle <= mark and not held:
            out.append(self._row(key, "idle", last, processed=processed, errors=errors))
            self.status.clear()
            self.history.clear()
            yield self._frame(out)
            return
        timer = (held[0][0] // SECOND + 1) * 1000 if held else idle
        self.handle.registerTimer(timer)  # the one before has expired
        self.status.update((last, processed, errors, idle, len(held), timer))
        if out:
            yield self._frame(out)

    @staticmethod
    def _packed(rows: list[tuple]) -> bytes:
        columns = [pa.array(x, kind, from_pandas=True) for x, kind in zip(zip(*rows), (pa.int64(), pa.int64(), pa.string(), pa.float64()))]
        batch, to = pa.RecordBatch.from_arrays(columns, ["us", "event_id", "metric", "value"]), pa.BufferOutputStream()
        with pa.ipc.new_stream(to, batch.schema) as w:
            w.write_batch(batch)
        return to.getvalue().to_pybytes()

    def _waiting(self) -> list[tuple]:
        out: list[tuple] = []
        for (packed,) in self.waiting.get():
            out += zip(*(c.to_pylist() for c in pa.ipc.open_stream(packed).read_all().columns))
        return out

    def _status(self) -> tuple:
        return tuple(self.status.get()) if self.status.exists() else (0, 0, 0, 0, 0, 0)

    def _set(self, old: int, new: int) -> int:
        if old != new:
            if old:
                self.handle.deleteTimer(old)
            self.handle.registerTimer(new)
        return new

    def close(self) -> None:
        pass

    def _row(self, key, kind, us, event_id=None, metric=None, value=None, mean=None, deviation=None, n=None, processed=None, errors=None) -> tuple:
        return (key[0], kind, us, event_id, metric, value, mean, deviation, n, processed, errors)

    @staticmethod
    def _frame(rows: list[tuple]) -> pd.DataFrame:
        kinds = {"long": "Int64", "double": "float64", "string": "object"}
        return pd.DataFrame(rows, columns=[*OUT]).astype({c: kinds[t] for c, t in OUT.items()})


def use_state_store(spark: SparkSession) -> None:
    """Such processors need a store with column families."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


def process(
    events: DataFrame,
    device: str = "user_id",
    at: str = "ts",
    event: str = "event_id",
    metric: str = "event_type",
    value: str = "value",
    late: str = "1 hour",
    critical: tuple[str, ...] = (),
    batch: int = 100,
    queue: int = 10_000,
    keep: int = 100,
    least: int = 10,
    sigmas: float = 3.0,
    idle_seconds: int = 30 * 86_400,
) -> DataFrame:
    """(device, kind, at, event_id, metric, value, mean, deviation, n, processed, errors) of a stream of events.

    kind is batch (n rows; processed and errors of the device so far), anomaly, critical, rejected or idle. Rows without a time have no order and are left out.
    """
    use_state_store(events.sparkSession)
    e = events.select(F.col(device).cast("long").alias("device"), F.col(at).cast("timestamp").alias("ts"), F.col(event).cast("long").alias("event_id"), F.col(metric).cast("string").alias("metric"), F.col(value).cast("double").alias("value"))
    e = e.where("ts IS NOT NULL").withWatermark("ts", late).withColumn("us", F.unix_micros("ts"))
    processor = DeviceProcessor(frozenset(critical), batch, queue, keep, least, sigmas, idle_seconds)
    out = e.groupBy("device").transformWithStateInPandas(processor, ", ".join(f"{c} {t}" for c, t in OUT.items()), "Append", "EventTime")
    return out.select("device", "kind", F.timestamp_micros("us").alias("at"), *[c for c in OUT if c not in ("device", "kind", "us")])
