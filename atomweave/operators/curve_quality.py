"""How well a curve's order keeps what is near in space near: over whole tables, by global ranks.

Rows are range-partitioned and sorted by code, each partition's rows are counted, and the offsets of the partitions (few numbers) make ranks. What lies within a span of
ranks is found by joins on rank, so no window takes all rows to one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from atomweave.operators.kd_join import nearest_join
from atomweave.operators.work import written

#: Distances along the curve at which pairs are compared.
STRIDES = (1, 2, 4, 8, 16, 32, 64, 128)


def ranked(rows: DataFrame, *order: str) -> DataFrame:
    """Rows with ``rank``, from 0, by ``order``."""
    names = rows.columns

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([part] * len(b), pa.int32()), pa.array(range(at, at + len(b)), pa.int64())], [*names, "_part", "_at"])
            at += len(b)

    schema = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes) + ", _part int, _at long"
    numbered = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(number, schema), "ranked")
    sizes = numbered.groupBy("_part").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))  # a row a partition
    offsets = sizes.select("_part", F.coalesce(upto, F.lit(0)).alias("_first"))
    return numbered.join(F.broadcast(offsets), "_part").withColumn("rank", F.col("_first") + F.col("_at")).drop("_part", "_at", "_first")


def locality(rows: DataFrame, key: str, code: str, vector: str, strides: tuple[int, ...] = STRIDES) -> DataFrame:
    """(stride, pairs, mean_distance) and, with a null stride, all pairs and ``correlation`` of distances in space with distances of codes.

    Pairs are rows whose ranks by (code, key) are a stride apart.
    """
    r = written(ranked(rows.select(F.col(key).alias("k"), F.col(code).cast("long").alias("c"), F.col(vector).cast("array<double>").alias("v")), "c", "k"), "ranks")
    ahead = r.select(F.explode(F.array(*map(F.lit, strides))).alias("stride"), "rank", "c", "v").withColumn("rank", F.col("rank") + F.col("stride"))
    pairs = ahead.select("stride", "rank", F.col("c").alias("c1"), F.col("v").alias("v1")).join(r.select("rank", F.col("c").alias("c2"), F.col("v").alias("v2")), "rank")
    d = F.sqrt(F.aggregate(F.zip_with("v1", "v2", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x))
    pairs = pairs.select("stride", d.alias("d"), (F.col("c2") - F.col("c1")).cast("double").alias("span"))
    return pairs.groupBy("stride").agg(F.count("*").alias("pairs"), F.avg("d").alias("mean_distance"), F.lit(None).cast("double").alias("correlation")).unionByName(
        pairs.agg(F.lit(None).cast("int").alias("stride"), F.count("*").alias("pairs"), F.avg("d").alias("mean_distance"), F.corr("d", "span").alias("correlation"))
    )


def preservation(rows: DataFrame, key: str, code: str, vector: str, k: int = 5, window: int = 5) -> DataFrame:
    """(id, kept): how many of a row's k nearest rows in space lie within ``window`` ranks of it along the curve."""
    r = written(ranked(rows.select(F.col(key).cast("long").alias("id"), F.col(code).cast("long").alias("c")), "c", "id").select("id", "rank"), "ranks")
    near = nearest_join(rows, key, vector, k).select("id", "other")
    both = near.join(r, "id").join(r.select(F.col("id").alias("other"), F.col("rank").alias("theirs")), "other")
    return both.groupBy("id").agg(F.sum((F.abs(F.col("rank") - F.col("theirs")) <= window).cast("long")).alias("kept"))
