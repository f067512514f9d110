"""A vocabulary with ids by frequency, and texts as ids.

Ids are ranks by (frequency, word) from range partitions with offsets, from 1; words of fewer than ``least`` occurrences are outside and have id 0. When ids are looked up, the ``FREQUENT``
first words are broadcast, so words that make up much of all texts never meet under one key; only the rest is joined by word.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atomweave.operators.curve_quality import ranked
from atomweave.operators.word_tables import flat, word_places
from atomweave.operators.work import written

OUTSIDE, FREQUENT = 0, 4096


def vocabulary(tokens: DataFrame, least: int = 2, times: str | None = None) -> DataFrame:
    """(w, id, frequency) of the words of tokens (w ...), each counted once or as often as ``times`` says."""
    counts = tokens.where("w IS NOT NULL").groupBy("w").agg((F.sum(times) if times else F.count("*")).alias("frequency")).where(F.col("frequency") >= least)
    numbered = ranked(counts.withColumn("less", -F.col("frequency")), "less", "w")
    return written(numbered.select("w", (F.col("rank") + 1).alias("id"), "frequency"), "vocabulary")


def with_ids(tokens: DataFrame, words: DataFrame) -> DataFrame:
    """Tokens with ``id`` in the vocabulary, 0 for words outside it."""
    near = tokens.join(F.broadcast(words.where(F.col("id") <= FREQUENT).select("w", "id")), "w", "left")  # FREQUENT rows
    rest = near.where("id IS NULL").drop("id").join(words.where(F.col("id") > FREQUENT).select("w", "id"), "w", "left")
    return near.where("id IS NOT NULL").unionByName(rest.withColumn("id", F.coalesce("id", F.lit(OUTSIDE).cast("long"))))


def text_ids(docs: DataFrame, key: str, text: str, words: DataFrame) -> DataFrame:
    """(k, p, id) of every word of every text: its row's key, its place, and its id as in ``with_ids``. A word is looked up once in each slice of texts."""
    known = word_places(docs, key, text).join(words.select("w", "id"), "w", "left")
    return flat(known.select("ks", "ps", F.coalesce("id", F.lit(OUTSIDE).cast("long")).alias("id")))
