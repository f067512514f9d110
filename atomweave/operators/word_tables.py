"""Words of texts as tables that stay short: a row for each distinct word of a slice of texts, with the places where it occurs in lists.

What depends on a word alone is joined and worked out once a slice, and lists become rows last.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atomweave.operators.tokens import repeats, slices

#: Bytes of text whose compositions are put in order together (a longer text is taken alone), and places in a list of them.
COMPOSED, LISTED = 12 << 20, 4096


def _rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).cast("long").alias("k"), F.lower(F.col(text).cast("string")).alias("t")).where("t IS NOT NULL")


def _lists(first: np.ndarray, count: int, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(first, count).astype(np.int32)), values)


def _documents(code: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each word in each text, once: the word, ascending, the text, and how often."""
    of = np.repeat(np.arange(len(edge) - 1), np.diff(edge))
    pair, n = np.unique(code.astype(np.int64) * (len(edge) - 1) + of, return_counts=True)
    return pair // max(1, len(edge) - 1), pair % max(1, len(edge) - 1), n


def word_counts(docs: DataFrame, text: str) -> DataFrame:
    """(w, n, df): occurrences of a word in a slice, and the rows there that have it."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, names, code, edge in slices(batches, "t"):
            word, _, _ = _documents(code, edge)
            yield pa.RecordBatch.from_arrays([names, pa.array(np.bincount(code, minlength=len(names))), pa.array(np.bincount(word, minlength=len(names)))], ["w", "n", "df"])

    return docs.select(F.lower(F.col(text).cast("string")).alias("t")).where("t IS NOT NULL").mapInArrow(count, "w string, n long, df long")


def word_places(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(w, ks, ps): a word's occurrences in a slice, by the row's key and the place in its text, from 0."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, names, code, edge in slices(batches, "t"):
            order, first, _ = repeats(code)
            of = np.repeat(np.arange(len(rows)), np.diff(edge))
            at = (np.arange(len(code)) - edge[of]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([names.take(pa.array(code[order[first]])), _lists(first, len(code), rows.column("k").take(pa.array(of[order]))), _lists(first, len(code), pa.array(at[order]))], ["w", "ks", "ps"])

    return _rows(docs, key, text).mapInArrow(place, "w string, ks array<long>, ps array<int>")


def word_documents(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(w, ks, ps): the rows of a slice that have a word, by key, and how often each has it."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, names, code, edge in slices(batches, "t"):
            word, of, n = _documents(code, edge)
            first = np.searchsorted(word, np.arange(len(names)))
            yield pa.RecordBatch.from_arrays([names, _lists(first, len(word), rows.column("k").take(pa.array(of))), _lists(first, len(word), pa.array(n.astype(np.int32)))], ["w", "ks", "ps"])

    return _rows(docs, key, text).mapInArrow(place, "w string, ks array<long>, ps array<int>")


def repeated(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(w, more): by how many the rows that have a word exceed the keys that have it; only rows whose key another row has are read for it."""
    again = docs.groupBy(F.col(key).alias("_again")).agg(F.count("*").alias("_n")).where("_n > 1").select("_again")
    some = docs.join(F.broadcast(again), F.col(key).eqNullSafe(F.col("_again")), "left_semi")
    pairs = word_documents(some, key, text).select("w", F.explode("ks").alias("k"))
    return pairs.groupBy("k", "w").agg((F.count("*") - 1).alias("more")).groupBy("w").agg(F.sum("more").alias("more")).where("more > 0")


def flat(lists: DataFrame) -> DataFrame:
    """Rows (k, p, ...) of lists ks and ps; other columns are repeated."""
    rest = [c for c in lists.columns if c not in ("ks", "ps")]
    kinds = dict(lists.dtypes)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            of = pa.array(np.repeat(np.arange(len(b)), np.diff(b.column("ks").offsets.to_numpy())))
            yield pa.RecordBatch.from_arrays([b.column("ks").flatten(), b.column("ps").flatten(), *(b.column(c).take(of) for c in rest)], ["k", "p", *rest])

    return lists.mapInArrow(spread, ", ".join(["k long, p int", *(f"`{c}` {kinds[c]}" for c in rest)]))


def _gathered(batches: Iterator[pa.RecordBatch], text: str, most: int) -> Iterator[pa.RecordBatch]:
    """The rows in batches of about ``most`` bytes of text."""
    held, size = [], 0
    for batch in batches:
        upto = np.cumsum(pc.binary_length(batch.column(text)).to_numpy(zero_copy_only=False).astype(np.int64))
        i = 0
        while i < len(batch):
            before = int(upto[i - 1]) if i else 0
            j = int(np.searchsorted(upto, before + most - size, "right"))
            j = j if held else max(i + 1, j)
            held.append(batch.slice(i, j - i))
            size += (int(upto[j - 1]) if j else 0) - before
            if j < len(batch):
                yield pa.concat_batches(held)
                held, size = [], 0
            i = j
    if held:
        yield pa.concat_batches(held)


def compositions(docs: DataFrame, text: str) -> DataFrame:
    """(parent, seq, component): the hash of a text, the place of a word in it (words are parted by one space) and the word's hash.

    A word's rows come one after another for each slice of texts, so Parquet, whose dictionaries end at 1 MB, keeps runs of a hash and not
    the hash itself for each word.
    """

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _gathered(batches, "t", COMPOSED):
            ws = pc.split_pattern(rows.column("t"), " ")
            edge = ws.offsets.to_numpy().astype(np.int64)
            coded = ws.flatten().dictionary_encode()
            order, first, n = repeats(coded.indices.to_numpy())
            of = np.repeat(np.arange(len(rows), dtype=np.int32), np.diff(edge))[order]
            at = (order - edge[of] + edge[0]).astype(np.int32)
            lists = -(-n // LISTED)  # a frequent word's are cut
            word = np.repeat(np.arange(len(n)), lists)
            begin = np.append(first[word] + LISTED * (np.arange(len(word)) - np.repeat(np.cumsum(lists) - lists, lists)), len(order))
            i = 0
            while i < len(word):
                j = max(i + 1, int(np.searchsorted(begin, begin[i] + 16 * LISTED, "right")) - 1)
                part, edges = slice(begin[i], begin[j]), (begin[i : j + 1] - begin[i]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(word[i:j])), _lists(edges[:-1], edges[-1], rows.column("parent").take(pa.array(of[part]))), _lists(edges[:-1], edges[-1], pa.array(at[part]))], ["w", "parents", "seqs"])
                i = j

    texts = docs.select(F.sha2(F.col(text), 256).alias("parent"), F.col(text).alias("t")).where("t IS NOT NULL")
    listed = texts.mapInArrow(place, "w string, parents array<string>, seqs array<int>").select(F.sha2("w", 256).alias("component"), "parents", "seqs")
    return listed.select("component", "seqs", F.posexplode("parents").alias("i", "parent")).selectExpr("parent", "seqs[i] AS seq", "component")
