"""Sinks that a replayed batch doesn't change: a keyed table upserted by ``foreachBatch``, its change feed, files.

The keyed table is Parquet in buckets by key. A batch is first turned into changes against the table (insert, update, delete, each with the state before and after) and
these are written under the batch's number; then they are applied to the buckets that they touch. A batch that is run again finds its changes
written and applies them again, which gives the same rows. Of several rows of one key the one with the largest order decides, in the batch as against
the table, so late and repeated rows change nothing. Deleted keys stay as tombstones, so that a late row doesn't bring them back.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from atomweave.operators.work import fresh_path

BUCKET, DELETED = "_bucket", "_deleted"


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


class KeyedTable:
    """A table at ``path`` with one row a key: columns of ``schema``; the largest ``order`` (a struct of columns) wins; ``delete`` is a condition."""

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: tuple[str, ...], order: tuple[str, ...], delete: str = "false", buckets: int = 16):
        self.spark, self.path, self.schema, self.keys, self.order, self.delete, self.buckets = spark, path.rstrip("/"), schema, keys, order, delete, buckets
        self.columns = self.spark.createDataFrame([], schema).columns

    @property
    def _stored(self) -> str:
        return f"{self.schema}, {DELETED} boolean, {BUCKET} int"

    def _rows(self) -> DataFrame:
        """Rows and tombstones."""
        where = f"{self.path}/rows"
        return self.spark.read.schema(self._stored).parquet(where) if _exists(self.spark, where) else self.spark.createDataFrame([], self._stored)

    def read(self) -> DataFrame:
        return self._rows().where(~F.col(DELETED)).select(*self.columns)

    def _changes_of(self, batch: DataFrame) -> DataFrame:
        order = F.struct(*self.order)
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        known = F.lit(True)
        for k in self.keys:
            known = known & F.col(k).isNotNull()
        last = batch.where(known).groupBy(*self.keys).agg(F.max_by(F.struct(*self.columns, F.expr(self.delete).alias(DELETED)), order).alias("new"))
        new = last.select(F.col("new"), *self.keys, bucket.alias(BUCKET))
        old = self._rows().select(F.struct(*self.columns, DELETED).alias("old"), *self.keys, BUCKET)
        both = new.join(old, [*self.keys, BUCKET], "left")
        newer = F.col("old").isNull() | (F.struct(*(F.col(f"new.{c}") for c in self.order)) > F.struct(*(F.col(f"old.{c}") for c in self.order)))
        alive = F.coalesce(~F.col(f"old.{DELETED}"), F.lit(False))
        op = F.when(F.col(f"new.{DELETED}") & alive, "delete").when(F.col(f"new.{DELETED}"), "none").when(alive, "update").otherwise("insert")
        return both.where(newer).select(op.alias("op"), "new", "old", BUCKET)

    def upsert(self, batch: DataFrame, batch_id: int) -> None:
        """For ``foreachBatch``."""
        where = f"{self.path}/changes/batch={batch_id}"
        if not _exists(self.spark, f"{where}/_SUCCESS"):
            self._changes_of(batch).write.mode("overwrite").parquet(where)
        changes = self.spark.read.parquet(where)
        if changes.isEmpty():
            return
        touched = changes.select(BUCKET).distinct()
        old = self._rows().join(F.broadcast(touched), BUCKET, "left_semi")  # at most so many buckets
        kept = old.join(changes.select(*(F.col(f"new.{k}").alias(k) for k in self.keys), BUCKET), [*self.keys, BUCKET], "left_anti").select(*self.columns, DELETED, BUCKET)
        rows = kept.unionByName(changes.select(*(F.col(f"new.{c}").alias(c) for c in (*self.columns, DELETED)), BUCKET))
        held = fresh_path(self.spark, "upsert")
        rows.write.parquet(held)  # before the files that it reads are replaced
        self.spark.read.schema(self._stored).parquet(held).repartition(BUCKET).write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy(BUCKET).parquet(f"{self.path}/rows")

    def changes(self) -> DataFrame:
        """(batch, op, new, old) of all batches."""
        kind = f"struct<{', '.join(f'{c}: {t}' for c, t in self.spark.createDataFrame([], self.schema).dtypes)}, {DELETED}: boolean>"
        where = f"{self.path}/changes"
        if not _exists(self.spark, where):
            return self.spark.createDataFrame([], f"batch long, op string, new {kind}, old {kind}")
        return self.spark.read.schema(f"op string, new {kind}, old {kind}, batch long").parquet(where).where("op <> 'none'").select("batch", "op", "new", "old")

    def change_stream(self) -> DataFrame:
        """The same as a stream: each batch's changes once."""
        return self.spark.readStream.schema(self.changes().schema).option("maxFilesPerTrigger", 1).parquet(f"{self.path}/changes").where("op <> 'none'")


def sink(stream: DataFrame, table: KeyedTable, checkpoint: str):
    """Start the stream into the table, over what its source has now."""
    return stream.writeStream.foreachBatch(table.upsert).option("checkpointLocation", checkpoint).outputMode("update").trigger(availableNow=True).start()


def drain(stream: DataFrame, mode: str = "append", path: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """Run a stream over what its source has now into Parquet, and read that. Complete and update results are those of the last batch."""
    spark = stream.sparkSession
    path, checkpoint = path or fresh_path(spark, "stream"), checkpoint or fresh_path(spark, "stream-checkpoint")
    writer = stream.writeStream.option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True)
    if mode == "append":
        writer.format("parquet").start(path).awaitTermination()
        return spark.read.schema(stream.schema).parquet(path)
    name = uuid.uuid4().hex  # a batch that is run again replaces what it wrote
    writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(f"{path}/{name}")).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/{name}")
