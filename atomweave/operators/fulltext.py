"""Ranked full-text search over an inverted index that is a table.

Postings (term, doc_id, tf, length) lie in buckets by term, so a search reads the buckets of its terms alone, and within them the row groups that have the
terms. The rank is BM25 over documents with any of the terms, scaled to 0 to 1000 as 1000 * s / (s + HALF). Terms are the runs of letters and digits of the
lower-cased text. Null texts have no terms; rows that repeat an id are documents of their own in counts and lengths, and their ranks are added up to one by their largest.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

K1, B, HALF = 1.2, 0.75, 5.0
BUCKETS, TOTALS = 64, -1
#: Documents whose terms are told apart at once.
ROWS = 1000


def terms_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


@dataclass(frozen=True)
class TextIndex:
    path: str
    documents: int
    mean_length: float


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each document's distinct terms with their counts, and for each batch a row without a term: documents and terms in it."""
    for b in batches:
        for i in range(0, len(b), ROWS):
            ids, lists = b.column("doc_id").slice(i, ROWS), b.column("t").slice(i, ROWS)
            length = np.diff(lists.offsets.to_numpy())
            coded = lists.flatten().dictionary_encode()
            names, of = coded.dictionary, np.repeat(np.arange(len(ids)), length)
            pair, tf = np.unique(of * len(names) + coded.indices.to_numpy(), return_counts=True)
            doc, term = np.divmod(pair, max(1, len(names)))
            columns = names.take(pa.array(term)), ids.take(pa.array(doc)), pa.array(tf.astype(np.int64)), pa.array(length[doc].astype(np.int64))
            yield pa.RecordBatch.from_arrays(list(columns), ["term", "doc_id", "tf", "length"])
        if len(b):
            total = pa.array([None], pa.string()), pa.array([len(b)], pa.int64()), pa.array([len(b.column("t").flatten())], pa.int64()), pa.array([0], pa.int64())
            yield pa.RecordBatch.from_arrays(list(total), ["term", "doc_id", "tf", "length"])


def write_index(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> TextIndex:
    """Counts are made within a document before anything is shuffled, and each posting goes to its term's bucket once.

    Documents and terms are counted on the way, into a bucket of their own (``TOTALS``).
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), terms_of(F.col(text).cast("string")).alias("t")).where("t IS NOT NULL")
    found = rows.mapInArrow(_postings, "term string, doc_id long, tf long, length long")
    found = found.withColumn("bucket", F.when(F.col("term").isNull(), TOTALS).otherwise(F.pmod(F.xxhash64("term"), F.lit(BUCKETS))).cast("int"))
    # a bucket is several files where it is large: frequent terms are dealt by document
    found.repartition(F.col("bucket"), F.pmod(F.xxhash64("doc_id"), F.lit(8))).sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(path)
    size = _read(docs.sparkSession, path).where(F.col("bucket") == TOTALS).agg(F.sum("doc_id").alias("n"), F.sum("tf").alias("terms")).first()
    n, terms = size["n"] or 0, size["terms"] or 0
    return TextIndex(path, n, terms / n if terms else 1.0)


def _read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("term string, doc_id long, tf long, length long, bucket int").parquet(path)


def search(spark: SparkSession, index: TextIndex, query: str) -> DataFrame:
    """(doc_id, rank) of documents with any term of the query, rank from 0 to 1000."""
    asked = spark.range(1).select(F.explode(F.array_distinct(terms_of(F.lit(query)))).alias("term"), F.lit(0).alias("_"))
    names = [r["term"] for r in asked.collect()]  # the query's own words
    rows = _read(spark, index.path)
    buckets = [r[0] for r in spark.createDataFrame([(n,) for n in names], "term string").select(F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int")).distinct().collect()] if names else []
    hits = rows.where(F.col("bucket").isin(buckets) & F.col("term").isin(names)) if names else rows.limit(0)
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (index.documents - F.col("df") + 0.5) / (F.col("df") + 0.5))
    hits = hits.join(F.broadcast(df), "term")  # a row for each word asked for
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / index.mean_length))
    score = hits.groupBy("doc_id", "length").agg(F.sum(part).alias("s")).groupBy("doc_id").agg(F.max("s").alias("s"))
    return score.select("doc_id", (1000 * F.col("s") / (F.col("s") + HALF)).alias("rank"))
