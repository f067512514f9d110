"""Structured Streaming queries over ``events``, run to the end of their source; oracles are the batch equivalents."""

from __future__ import annotations

from pyspark.sql import functions as F

from atomweave.operators.work import fresh_path
from atomweave.plans.base import Registry, table
from atomweave.plans.temporal import ORACLES as BATCH
from atomweave.streaming import telemetry as T
from atomweave.streaming.devices import process
from atomweave.streaming.sinks import KeyedTable, drain, sink

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles


def _stream(spark, sf_dir):
    """All files in one trigger: they are in no order of time, so a watermark after one of them would make rows of the next late."""
    return T.read(spark, f"{sf_dir}/events*.parquet", table(spark, sf_dir, "events").schema, None)


@R.add("stream_tumbling_counts", "SELECT date_trunc('day', ts)::DATE AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_tumbling_counts(spark, sf_dir):
    out = drain(T.tumbling(_stream(spark, sf_dir)), "complete")
    return out.select(F.to_date("w.start").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


@R.add("stream_three_sigma", BATCH["telemetry_three_sigma"])
def stream_three_sigma(spark, sf_dir):
    return drain(T.three_sigma(_stream(spark, sf_dir)))


# what the watermark, an hour behind the last event, has passed
_DECIDED = "m AS (SELECT max(ts) - INTERVAL 1 HOUR AS mark FROM events)"


@R.add(
    "stream_sliding_counts",
    f"""WITH {_DECIDED}, w AS (SELECT date_trunc('hour', ts) - to_hours(k) AS begins FROM events, range(0, 6) r(k))
    SELECT begins::TIMESTAMP AS begins, count(*) AS n FROM w, m WHERE begins + INTERVAL 6 HOUR <= mark GROUP BY begins""",
)
def stream_sliding_counts(spark, sf_dir):
    out = drain(T.sliding(_stream(spark, sf_dir)))
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("begins"), "n")


@R.add(
    "stream_sessions",
    f"""WITH {_DECIDED}, g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 12 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
    s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM g)
    SELECT user_id, min(ts) AS begins, max(ts) AS ends, count(*) AS n FROM s, m GROUP BY user_id, session, mark HAVING max(ts) + INTERVAL 12 HOUR <= mark""",
)
def stream_sessions(spark, sf_dir):
    out = drain(T.sessions(_stream(spark, sf_dir)))
    return out.select("user_id", *(F.col(c).cast("timestamp_ntz").alias(c) for c in ("begins", "ends")), "n")


# rows of slots of a second that the watermark has passed, per user
_ROWS = f"{_DECIDED}, e AS (SELECT events.* FROM events, m WHERE date_trunc('second', ts) + INTERVAL 1 SECOND <= to_timestamp(floor(epoch(mark) * 1000) / 1000)::TIMESTAMP)"


def _devices(spark, sf_dir, kind: str):
    return drain(process(_stream(spark, sf_dir), critical=("error",))).where(F.col("kind") == kind)


@R.add(
    "stream_device_anomalies",
    f"""WITH {_ROWS}, h AS (SELECT user_id, event_id, event_type, value, avg(value) OVER w AS m, stddev_pop(value) OVER w AS sd, count(*) OVER w AS n FROM e
    WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW))
    SELECT user_id, event_id, event_type, round(m, 6) AS mean, round(sd, 6) AS deviation FROM h WHERE n > 10 AND abs(value - m) > 3 * sd""",
)
def stream_device_anomalies(spark, sf_dir):
    """The reference's rule by device and metric, with state."""
    return _devices(spark, sf_dir, "anomaly").select(F.col("device").alias("user_id"), "event_id", F.col("metric").alias("event_type"), F.round("mean", 6).alias("mean"), F.round("deviation", 6).alias("deviation"))


@R.add("stream_critical_events", f"WITH {_ROWS} SELECT user_id, event_id, round(value, 6) AS value FROM e WHERE event_type = 'error'")
def stream_critical_events(spark, sf_dir):
    return _devices(spark, sf_dir, "critical").select(F.col("device").alias("user_id"), "event_id", F.round("value", 6).alias("value"))


@R.add("stream_device_status", f"WITH {_ROWS} SELECT user_id, count(*) AS processed, count(*) FILTER (value IS NULL OR NOT isfinite(value)) AS errors, count(DISTINCT date_trunc('second', ts)) AS batches FROM e GROUP BY user_id")
def stream_device_status(spark, sf_dir):
    """What each device's state holds at the end."""
    b = _devices(spark, sf_dir, "batch").groupBy(F.col("device").alias("user_id"))
    return b.agg(F.max("processed").alias("processed"), F.max("errors").alias("errors"), F.count("*").alias("batches"))


def _clients(spark, sf_dir) -> KeyedTable:
    c = table(spark, sf_dir, "client_changes").select("client_id", "seq", "change_id", "op", "city", "segment")
    clients = KeyedTable(spark, fresh_path(spark, "clients"), ", ".join(f"{n} {t}" for n, t in c.dtypes), ("client_id",), ("seq", "change_id"), "op = 'D'")
    source = fresh_path(spark, "change-files")
    c.repartition(3, F.col("change_id")).write.parquet(source)
    stream = spark.readStream.schema(c.schema).option("maxFilesPerTrigger", 1).parquet(source)
    sink(stream, clients, fresh_path(spark, "clients-checkpoint")).awaitTermination()
    return clients


@R.add(
    "stream_upserted_clients",
    "SELECT client_id, seq, city, segment FROM (SELECT *, row_number() OVER (PARTITION BY client_id ORDER BY seq DESC, change_id DESC) AS r FROM client_changes WHERE client_id IS NOT NULL) t WHERE r = 1 AND op <> 'D'",
)
def stream_upserted_clients(spark, sf_dir):
    """Clients as their changes leave them, upserted batch by batch."""
    return _clients(spark, sf_dir).read().select("client_id", "seq", "city", "segment")
