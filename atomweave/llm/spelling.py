"""Spelling variants grouped by a symmetric-delete join.

Two words are near if they differ by exactly one inserted, deleted or replaced code point. Each word emits itself and its
distinct single deletions as keys; near words share a key: the shorter word itself if their lengths differ, else what is left without the
code points that differ. So pairs come from an equi-join on keys, and the exact distance decides. A pair of near words
meets under exactly one key of these kinds (two words of one length that are near have only one deletion in common), so pairs need no
distinct. A key of m code points has at most one word for each letter and place: no text makes a group of more than (m + 1) times the
letters in use, however often its words occur.

A word's form is the near word with the most occurrences (ties: the smallest in code-point order), if it has at least
``factor`` times the word's own. Forms lead to ever more frequent words, so there are no cycles; roots are found by joins that double
the length of a path each round, each round a written table.

Words of more than ``LONG`` + 1 code points would emit texts of quadratic size: their deletions are keyed by 64-bit hashes, computed
from one prefix sum a word, and their pairs are brought together by id; the exact distance decides as well.

Null words and counts are left out; counts of words that repeat are added up. Null texts have no words. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from atomweave.llm.common import discard, materialise, tidy
from atomweave.llm.shingles import mix

#: Words of up to this many code points, and one more, emit their deletions as texts.
LONG = 64
MAX_ROUNDS = 30
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def runs_of(docs: DataFrame, letters: str, least: int) -> DataFrame:
    """(doc_id, run) of every maximal run of at least ``least`` letters (the inside of a character class); A-Z are lower-cased."""
    runs = F.regexp_extract_all(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(f"[{letters}]{{{least},}}"), F.lit(0))
    out = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.explode(runs).alias("run"))
    return out.withColumn("run", F.translate("run", UPPER, LOWER))


def without(word: Column, at: Column) -> Column:
    """A word less its code point at a place, counted from 0."""
    return F.concat(F.substr(word, F.lit(1), at), F.substr(word, at + 2, F.length(word)))


def _keys(words: DataFrame) -> DataFrame:
    """(key, length, whole, word, n): each word itself and its distinct deletions."""
    deletions = F.array_distinct(F.transform(F.sequence(F.lit(0), F.length("word") - 1), lambda i: without(F.col("word"), i.cast("int"))))
    key = F.explode(F.concat(F.array("word"), F.when(F.length("word") > 0, deletions).otherwise(F.array().cast("array<string>")))).alias("key")
    return words.select(key, "word", "n").select("key", F.length("word").alias("length"), (F.col("key") == F.col("word")).alias("whole"), "word", "n")


def _short_pairs(words: DataFrame) -> DataFrame:
    """Near pairs (a, n_a, b, n_b), each once, of words of which none is longer than LONG + 1."""
    a, b = (_keys(words).select("key", *(F.col(c).alias(f"{c}_{s}") for c in ("length", "whole", "word", "n"))) for s in "ab")
    meet = "(length_a = length_b AND NOT whole_a AND NOT whole_b AND word_a < word_b) OR (length_a < length_b AND whole_a AND NOT whole_b)"
    return a.join(b, "key").where(meet).where(F.levenshtein("word_a", "word_b", 1) == 1).select("word_a", "n_a", "word_b", "n_b")


_INVERSE = pow(0x9E3779B97F4A7C15, -1, 1 << 64)


def deletion_hashes(word: str) -> np.ndarray:
    """Hashes of a word and of all its single deletions; equal texts have equal hashes."""
    c = mix(np.frombuffer(word.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1))
    if not len(c):
        return mix(np.zeros(1, np.uint64))
    powers = np.full(len(c), 0x9E3779B97F4A7C15, np.uint64)
    powers[0] = 1
    powers = np.cumprod(powers, dtype=np.uint64)
    upto = np.cumsum(c * powers, dtype=np.uint64)
    before = np.concatenate([[np.uint64(0)], upto[:-1]])
    less = before + (upto[-1] - upto) * np.uint64(_INVERSE)
    return np.unique(np.concatenate([mix(upto[-1:] + np.uint64(len(c))), mix(less + np.uint64(len(c) - 1))]))


def _long_pairs(words: DataFrame) -> DataFrame:
    """Near pairs of words of which one is longer than LONG + 1; words have an id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, word in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                h = deletion_hashes(word).view(np.int64)
                for at in range(0, len(h), 1 << 16):
                    part = h[at : at + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(np.full(len(part), i, np.int64)), pa.array(np.full(len(part), len(word), np.int64))], ["key", "id", "length"])

    keys = words.select("id", "word").mapInArrow(tidy(run), "key long, id long, length long")
    a, b = (keys.select("key", F.col("id").alias(f"id_{s}"), F.col("length").alias(f"length_{s}")) for s in "ab")
    pairs = a.join(b, "key").where(f"id_a < id_b AND abs(length_a - length_b) <= 1 AND greatest(length_a, length_b) > {LONG + 1}").select("id_a", "id_b").distinct()
    for s in "ab":
        pairs = pairs.join(words.select(F.col("id").alias(f"id_{s}"), F.col("word").alias(f"word_{s}"), F.col("n").alias(f"n_{s}")), f"id_{s}")
    return pairs.where(F.levenshtein("word_a", "word_b", 1) == 1).select("word_a", "n_a", "word_b", "n_b")


def near_pairs(words: DataFrame) -> DataFrame:
    """Near pairs (word_a, n_a, word_b, n_b), each once and one way round, of written distinct words (id, word, n)."""
    size = F.length("word")
    pairs = _short_pairs(words.where(size <= LONG + 1))
    long = words.where(size > LONG)
    return pairs if long.isEmpty() else pairs.unionByName(_long_pairs(long))


def roots_of(forms: DataFrame) -> DataFrame:
    """(word, root) of words (word, form) that have a form: where their forms end."""
    paths = materialise(forms.select("word", F.col("form").alias("root")), "paths")
    for _ in range(MAX_ROUNDS):
        on = paths.select(F.col("word").alias("root"), F.col("root").alias("further"))
        new = materialise(paths.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "paths")
        discard(paths)
        paths = new
        if new.where("moved").isEmpty():
            return paths.select("word", "root")
    raise RuntimeError(f"roots did not settle in {MAX_ROUNDS} rounds")


def group_variants(counts: DataFrame, factor: int = 10) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of words (word, n).

    form and form_n are null without one; n_near is the number of near words; root is the word itself if it has no form.
    """
    words = counts.where("word IS NOT NULL AND n IS NOT NULL").groupBy(F.col("word").cast("string").alias("word")).agg(F.sum("n").cast("long").alias("n"))
    words = materialise(words.withColumn("id", F.monotonically_increasing_id()), "words")  # ids are fixed by writing
    pairs = near_pairs(words)
    ends = F.explode(F.array(*(F.struct(F.col(f"word_{s}").alias("word"), F.col(f"n_{s}").alias("n"), F.struct((-F.col(f"n_{t}")).alias("less"), F.col(f"word_{t}").alias("other")).alias("near")) for s, t in ("ab", "ba"))))
    best = pairs.select(ends.alias("e")).groupBy("e.word").agg(F.count("*").alias("n_near"), F.min("e.near").alias("near"))
    found = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.expr(f"CASE WHEN -near.less >= {factor} * n THEN near END").alias("near"))
    found = materialise(found.select("word", "n", "n_near", F.col("near.other").alias("form"), (-F.col("near.less")).alias("form_n")), "forms")
    roots = roots_of(found.where("form IS NOT NULL").select("word", "form"))
    out = found.join(roots, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
