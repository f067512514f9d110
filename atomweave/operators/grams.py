"""Runs of words that occur often enough, over all texts, exactly.

A run is at least as rare as the runs of two and three words in it. So these are counted first, as hashes: a slice of texts sends those of each of ``PARTS`` ranges as one row, at most
``least`` of a kind, and a range is sorted and counted whole. The hashes that occur often are marked in a bitmap of ``2**BITS`` bits. Only places all of whose short runs are marked can
begin a run that counts, and only these become strings, once a slice, and are counted by value. Hashes that meet and bits that are shared only let more runs be counted,
so the result is exact at any size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atomweave.operators.tokens import repeats, slices

#: The bitmap takes 32 MB, whatever the number of runs; its index are the first bits of a hash. The first of these tell the ranges apart.
BITS, PART_BITS = 28, 10
PARTS = 1 << PART_BITS
#: Sizes of the runs that are counted as hashes.
SHORT = (2, 3)


def _hashes(names: pa.StringArray) -> np.ndarray:
    """A number for each word, by its bytes alone: a polynomial modulo 2^64, mixed."""
    n = len(names)
    ends = np.frombuffer(names.buffers()[1], np.int32, n + 1, 4 * names.offset)
    data = np.frombuffer(names.buffers()[2] or b"", np.uint8)
    h, size = np.full(n, 1469598103934665603, np.uint64), np.diff(ends)
    alive, k = np.flatnonzero(size > 0), 0
    while len(alive):
        h[alive] = (h[alive] ^ data[ends[alive] + k]) * np.uint64(1099511628211)
        k += 1
        alive = alive[size[alive] > k]
    return _mixed(h)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _runs(word: np.ndarray, n: int) -> np.ndarray:
    """A number for the run of n words from each place on, over ends of texts too."""
    h = np.zeros(max(0, len(word) - n + 1), np.uint64)
    for i in range(n):
        h = h * np.uint64(0x9E3779B97F4A7C15) + word[i : len(word) - n + 1 + i]
    return _mixed(h)


def _inside(edge: np.ndarray, count: int, n: int) -> np.ndarray:
    """Whether the run of n words from a place on lies within one text."""
    ok = np.ones(max(0, count - n + 1), bool)
    for back in range(1, n):
        at = edge[1:-1] - back
        ok[at[(at >= 0) & (at < len(ok))]] = False
    return ok


def frequent_runs(docs: DataFrame, text: str, sizes: tuple[int, ...], least: int) -> DataFrame:
    """(size, gram, n) of the runs of so many words, two or more, joined by a space, that occur ``least`` times or more."""
    rows = docs.select(F.lower(F.col(text).cast("string")).alias("t")).where("t IS NOT NULL")

    short = tuple(n for n in SHORT if n <= max(sizes))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, names, code, edge in slices(batches, "t"):
            word = _hashes(names)[code]
            h = np.concatenate([word[:0], *(_runs(word, n)[_inside(edge, len(code), n)] for n in short)])
            h.sort()
            enough = np.ones(len(h), bool)
            enough[least:] = h[least:] != h[:-least]
            h = h[enough]
            upto = np.searchsorted(h, np.arange(1, PARTS, dtype=np.uint64) << np.uint64(64 - PART_BITS)).tolist()
            rest = (h >> np.uint64(32 - PART_BITS)).astype(np.uint32)  # the 32 bits after those of the range
            some = [(p, rest[i:j].tobytes()) for p, (i, j) in enumerate(zip([0, *upto], [*upto, len(h)])) if i < j]
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in some], pa.int32()), pa.array([v for _, v in some], pa.binary())], ["p", "v"])

    def marked(key: tuple, part: pa.Table) -> pa.Table:
        h = np.frombuffer(b"".join(part["v"].to_pylist()), np.uint32)
        h = np.sort(h)
        bits = np.zeros(1 << (BITS - PART_BITS), bool)
        begin = h[: max(0, len(h) - least + 1)]
        bits[begin[h[least - 1 :] == begin] >> np.uint32(32 - (BITS - PART_BITS))] = True
        return pa.table({"p": pa.array([key[0].as_py()], pa.int32()), "m": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})

    marks = np.zeros((PARTS, 1 << (BITS - PART_BITS - 3)), np.uint8)
    got = rows.mapInArrow(hashed, "p int, v binary").groupBy("p").applyInArrow(marked, "p int, m binary").toArrow()  # the bitmap
    for p, m in zip(got["p"].to_pylist(), got["m"]):
        marks[p] = np.frombuffer(m.as_buffer(), np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(marks.ravel())

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for _, names, code, edge in slices(batches, "t"):
            word, fine = _hashes(names)[code], {}
            for m in short:
                at = (_runs(word, m) >> np.uint64(64 - BITS)).astype(np.int64)
                fine[m] = ((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool)
            for n in sizes:
                ok = _inside(edge, len(code), n)
                for m in (m for m in short if m <= n):
                    for i in range(n - m + 1):
                        ok &= fine[m][i : i + len(ok)]
                place = np.flatnonzero(ok)
                # words have numbers within the slice, so runs are told apart exactly: a run without its last word gets a number first
                key = code[place].astype(np.int64)
                for i in range(1, n):
                    key = key * len(names) + code[place + i]
                    if i < n - 1:
                        key = np.unique(key, return_inverse=True)[1]
                order, first, count = repeats(key)
                place = place[order[first]]
                gram = pc.binary_join_element_wise(*(names.take(pa.array(code[place + i])) for i in range(n)), " ")
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(place), n, np.int32)), gram, pa.array(count.astype(np.int64))], ["size", "gram", "n"])

    return rows.mapInArrow(strings, "size int, gram string, n long").groupBy("size", "gram").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
