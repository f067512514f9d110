"""Shared plumbing: tables, the shared work folder, materialised intermediates."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset, a folder in the warehouse, which a cluster shares too; with a local master a temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if spark.sparkContext.master.split("[")[0] == "local":
            base = tempfile.mkdtemp(prefix="atomweave-")
        else:
            base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/atomweave-work"
        spark.sparkContext.setCheckpointDir(base)
    return base if ":/" in base else f"file://{base}"


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/atomweave/{name}-{uuid.uuid4().hex[:12]}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and read it back: cuts the lineage, survives lost executors."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._atomweave_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete materialised intermediates that no later plan reads.

    Spark deletes shuffle files once the plans that made them are collected; that is asked for here, so that
    loops don't pile them up.
    """
    if frames:
        gc.collect()
        frames[0].sparkSession._jvm.System.gc()
    for df in frames:
        path = getattr(df, "_atomweave_path", None)
        if path:
            jvm = df.sparkSession._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


_malloc_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
#: Groups of fewer bytes leave little behind.
LARGE_GROUP = 1 << 20


def trim() -> None:
    """Hand freed memory back to the system. Workers are reused, and would each keep what their largest task took."""
    pa.default_memory_pool().release_unused()
    if _malloc_trim:
        _malloc_trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``run`` for mapInArrow, with its freed memory handed back at the task's end."""

    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            trim()

    return tidied


def tidy_group(run):
    """``run`` for applyInArrow, with its freed memory handed back after large groups."""

    def tidied(key, table):
        out = run(key, table)
        if table.nbytes >= LARGE_GROUP:
            trim()
        return out

    return tidied


#: Bits of a membership bitmap: 1 MB, whatever the number of keys.
BITMAP_BITS = 1 << 23


def maybe_among(rows: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """``rows`` with a boolean ``maybe``: false only if the row's key is surely not in ``keys`` (one column of longs).

    A bitmap of hashes of fixed size is broadcast, so rows needn't be shuffled to find out that they aren't meant;
    with many keys it only says ``maybe`` more often.
    """
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(BITMAP_BITS)) + 1
    v = place(keys.columns[0])
    maps = keys.groupBy(F.bitmap_bucket_number(v).alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(v)).alias("_bits"))
    at = F.bitmap_bit_position(place(key))
    byte = F.conv(F.hex(F.substr("_bits", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    bit = F.floor(byte / F.pow(F.lit(2), at % 8)) % 2
    return (
        rows.withColumn("_bucket", F.bitmap_bucket_number(place(key)))
        .join(F.broadcast(maps), "_bucket", "left")
        .withColumn("maybe", F.coalesce(bit == 1, F.lit(False)))
        .drop("_bucket", "_bits")
    )
