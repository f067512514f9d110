"""Streaming telemetry: tumbling windows with a watermark, and a stateful three-sigma alarm per device."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

KEEP, LEAST, SIGMAS = 100, 10, 3.0


def read(spark: SparkSession, path: str, schema, files_per_trigger: int | None = 1) -> DataFrame:
    """A stream of files; None takes all that there are in one trigger."""
    reader = spark.readStream.schema(schema)
    return (reader if files_per_trigger is None else reader.option("maxFilesPerTrigger", files_per_trigger)).parquet(path)


def tumbling(events: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Counts and sums per window and type; rows later than the watermark are dropped by the engine."""
    e = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return e.groupBy(F.window("at", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def three_sigma(events: DataFrame, sigmas: float = SIGMAS) -> DataFrame:
    """(user_id, event_id, alarm) with a buffer of the last KEEP values per user, the current one among them.

    A micro-batch's rows of a user are put in the order of (ts, event_id), however many frames they come in; micro-batches are taken as they arrive, so
    whoever needs the order of time over many files reads them in one trigger. Null values count as rows but not in moments, and have no alarm.
    """

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        rows = pd.concat(frames).sort_values(["ts", "event_id"])
        ids, alarms = [], []
        for event_id, value, null in zip(rows["event_id"].tolist(), rows["value"].tolist(), rows["null"].tolist()):
            held.append(None if null else value)
            del held[:-KEEP]
            if len(held) > LEAST:
                s = np.array([x for x in held if x is not None])
                ids.append(event_id)
                alarms.append(None if null else bool(abs(value - s.mean()) > sigmas * s.std()))
        state.update((held,))
        if ids:
            yield pd.DataFrame({"user_id": pd.array([None if key[0] is None or key[0] != key[0] else int(key[0])] * len(ids), "Int64"), "event_id": pd.array(ids, "Int64"), "alarm": pd.array(alarms, "boolean")})

    e = events.select("user_id", "ts", "event_id", "value", F.col("value").isNull().alias("null"))
    return e.groupBy("user_id").applyInPandasWithState(step, "user_id long, event_id long, alarm boolean", "held array<double>", "append", GroupStateTimeout.NoTimeout)


def sliding(events: DataFrame, late: str = "1 hour", width: str = "6 hours", step: str = "1 hour") -> DataFrame:
    """Counts of every window of ``width`` that begins at a multiple of ``step``; a window comes out once the watermark has passed it."""
    e = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return e.groupBy(F.window("at", width, step).alias("w")).agg(F.count("*").alias("n"))


def sessions(events: DataFrame, late: str = "1 hour", gap: str = "12 hours") -> DataFrame:
    """Sessions of a user: they end where no event follows within ``gap``; one comes out once the watermark has passed its end."""
    e = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return e.groupBy(F.session_window("at", gap).alias("w"), "user_id").agg(F.count("*").alias("n"), F.min("at").alias("begins"), F.max("at").alias("ends"))
