"""Segmented streams: a struct with an array of segments; create, append, read and count as columns, enumerate as a table function.

A long stream is stored as several rows (parts), so that no cell grows with it. The table function takes them as a partition, in the order asked for, and numbers segments
on from part to part. A null stream stays null and has no segments; a kind that isn't known becomes Unknown; a segment that isn't there is null.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

# Kinds of segments.
KINDS = ("Unknown", "Input", "Output", "Embedding", "Moderation", "Artifact", "Telemetry", "Control")
SEGMENT = "struct<kind: string, at: timestamp, content_type: string, metadata: string, payload: binary>"
STREAM = f"struct<stream_id: string, created: timestamp, scope: string, model: string, metadata: string, segments: array<{SEGMENT}>>"
ENUMERATED = "stream_id string, ordinal long, kind string, at timestamp, content_type string, metadata string, payload binary"


def _or_null(text: Column | None) -> Column:
    return F.lit(None).cast("string") if text is None else text


def create(stream_id: Column, created: Column, scope: Column | None = None, model: Column | None = None, metadata: Column | None = None) -> Column:
    fields = {"stream_id": stream_id.cast("string"), "created": created.cast("timestamp"), "scope": _or_null(scope), "model": _or_null(model), "metadata": _or_null(metadata), "segments": F.array().cast(f"array<{SEGMENT}>")}
    return F.struct(*(c.alias(n) for n, c in fields.items())).cast(STREAM)


def segment(kind: Column, at: Column, payload: Column, content_type: Column | None = None, metadata: Column | None = None) -> Column:
    known = F.coalesce(F.get(F.filter(F.array(*map(F.lit, KINDS)), lambda k: F.lower(k) == F.lower(kind)), F.lit(0)), F.lit(KINDS[0]))
    return F.struct(known.alias("kind"), at.cast("timestamp").alias("at"), _or_null(content_type).alias("content_type"), _or_null(metadata).alias("metadata"), F.coalesce(payload.cast("binary"), F.lit(b"")).alias("payload")).cast(SEGMENT)


def append(stream: Column, *segments: Column) -> Column:
    return F.when(stream.isNotNull(), stream.withField("segments", F.concat(stream["segments"], F.array(*segments)))).cast(STREAM)


def count(stream: Column) -> Column:
    return F.when(stream.isNotNull(), F.size(stream["segments"]).cast("long")).otherwise(F.lit(0).cast("long"))


def get(stream: Column, ordinal: int) -> Column:
    return F.get(stream["segments"], F.lit(ordinal))


@udtf(returnType=ENUMERATED)
class EnumerateSegments:
    """enumerate_segments(TABLE(t) PARTITION BY id ORDER BY part): t has the column ``stream``."""

    def __init__(self):
        self.n = 0

    def eval(self, row: Row) -> Iterator[tuple]:
        stream = row["stream"]
        if stream is None:
            return
        for s in stream["segments"] or ():
            yield stream["stream_id"], self.n, s["kind"], s["at"], s["content_type"], s["metadata"], s["payload"]
            self.n += 1


def register(spark: SparkSession) -> None:
    spark.udtf.register("enumerate_segments", EnumerateSegments)
