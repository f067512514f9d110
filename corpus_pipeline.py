"""Corpus pipeline: drops documents of no known language and toxic ones, keeps one of near copies, packs the rest.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run`` writes as Parquet and rereads as the next
stage's docs. All but the last return the columns of ``documents``. No stage is SQL-expressible (profiles, a trained
scorer and packing), so ORACLE_SQL is None; tests hold the stages against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from atomweave.llm.common import materialise, table
from atomweave.llm.jaccard_join import Threshold, one_of_each
from atomweave.llm.language_id import keep_identified
from atomweave.llm.packing import pack_documents
from atomweave.llm.toxicity import keep_clean


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told."""
    return keep_identified(docs)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.5."""
    return keep_clean(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at 0.8 or more."""
    return one_of_each(docs, Threshold(80), 5)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 4096 tokens."""
    return pack_documents(docs)


def in_small_batches(stage):
    """``stage`` with ``BATCH`` rows at most to an Arrow batch: both ends of a Python worker's pipe hold whole batches, and keep what their largest took.

    The session keeps the setting, as Spark reads it when the returned frame is run; results don't depend on it.
    """

    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if not 0 < int(spark.conf.get(ROWS)) <= BATCH:
            spark.conf.set(ROWS, BATCH)
        return stage(spark, docs, sf_dir)

    return run_stage


ROWS, BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch", 2000

STAGES = [(f.__name__, in_small_batches(f)) for f in (language, toxicity, near_duplicates, packing)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
