"""Document fingerprints from prefix polynomial hashes.

For a text of code points c, prefix arrays P[i] = sum of c[j] * B^j over j < i answer the hash of any span in constant
time, (P[i+n] - P[i]) * B^-i, modulo the prime 2^31 - 1 and for two bases at once (62 bits). Spans of equal
length are equal if their hashes are; the longest common extension of two positions is found by binary search.

A fingerprint holds the text's length, its whole hash and the ``SKETCH`` smallest mixed hashes of its spans of ``SPAN``
code points. Likeness is 1 for equal length and whole hash; else, with J the share of common values
among the smallest of both sketches (the Jaccard estimate), 2J / (1 + J): the estimated share of the texts
that they have in common. A text shorter than a span is one span.

Nulls count as empty. The successor of a document is the next in ascending (doc_id, text), null doc_ids first, and of the
last the first. Repeated rows are each other's successors; a table of one row is its own. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

P = (1 << 31) - 1
BASES = (982451653, 1181783497)
SPAN, SKETCH = 16, 64
#: Documents that one task takes in order, as long as that makes no more than MAX_BUCKETS tasks.
BUCKET_ROWS, MAX_BUCKETS = 3000, 8192
_P, _31 = np.uint64(P), np.uint64(31)
_POWERS: list[list[np.ndarray]] = []


def _mod(x: np.ndarray) -> np.ndarray:
    """x modulo 2^31 - 1, for x below 2^64."""
    x = (x & _P) + (x >> _31)
    x = (x & _P) + (x >> _31)
    return np.where(x >= _P, x - _P, x)


def _powers(n: int) -> list[list[np.ndarray]]:
    """For each base: its powers and those of its inverse, at least n."""
    if not _POWERS or len(_POWERS[0][0]) < n:
        size, made = 1 << max(12, (n - 1).bit_length()), []
        for b in BASES:
            both = []
            for x in (b % P, pow(b, -1, P)):
                a = np.ones(1, np.uint64)
                while len(a) < size:  # doubling: the next half is this one times x^len
                    a = np.concatenate([a, _mod(a * np.uint64(pow(x, len(a), P)))])
                both.append(a)
            made.append(both)
        _POWERS[:] = made
    return _POWERS


class PrefixHashes:
    """Prefix arrays of a text."""

    def __init__(self, text: str):
        c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)
        self.n = len(c)
        self.prefix = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mod(c * up[: self.n]), dtype=np.uint64)]) for up, _ in _powers(self.n + 1)]

    def span(self, start: int, length: int) -> int:
        """62-bit hash of a span."""
        out = 0
        for (_, down), p in zip(_powers(self.n + 1), self.prefix):
            out = out << 31 | (int(p[start + length]) - int(p[start])) % P * int(down[start]) % P
        return out

    def spans(self, length: int) -> np.ndarray:
        """Hashes of all spans of a length."""
        m = self.n - length + 1
        out = np.zeros(max(m, 0), np.uint64)
        if m > 0:
            for (_, down), p in zip(_powers(self.n + 1), self.prefix):
                out = (out << _31) | _mod(_mod(p[length:] - p[:m]) * down[:m])
        return out

    def extension(self, i: int, other: PrefixHashes, j: int) -> int:
        """Length of the longest common extension of position i here and j there."""
        lo, hi = 0, min(self.n - i, other.n - j)
        while lo < hi:
            mid = (lo + hi + 1) // 2
            if self.span(i, mid) == other.span(j, mid):
                lo = mid
            else:
                hi = mid - 1
        return lo


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> _31)) >> np.uint64(32)).astype(np.uint32)


class Fingerprint:
    def __init__(self, text: str, span: int = SPAN, size: int = SKETCH):
        self.hashes = h = PrefixHashes(text)
        self.n, self.whole, self.size = h.n, h.span(0, h.n), size
        m = _mix(h.spans(min(span, h.n))) if h.n else np.zeros(0, np.uint32)
        some = np.unique(np.partition(m, 2 * size)[: 2 * size]) if len(m) > 4 * size else np.unique(m)
        if len(some) < size and len(m) > 4 * size:
            some = np.unique(m)
        self.sketch = some[:size]

    def __str__(self) -> str:
        return f"{self.n:x}-{self.whole:016x}-{self.sketch.astype('>u4').tobytes().hex()}"

    def likeness(self, other: Fingerprint) -> float:
        if (self.n, self.whole) == (other.n, other.whole):
            return 1.0
        union = np.union1d(self.sketch, other.sketch)[: self.size]
        both = np.intersect1d(self.sketch, other.sketch, assume_unique=True)
        j = np.count_nonzero(np.isin(both, union, assume_unique=True)) / len(union)
        return float(2 * j / (1 + j))


def edited_text(text: str, successor: str) -> str:
    """The last floor(n/2) code points replaced by as many first ones of the successor, or all."""
    half = len(text) // 2
    return text[: len(text) - half] + successor[:half]


def in_order(docs: DataFrame) -> DataFrame:
    """(bucket, tail, key, doc_id, text) with each bucket a partition in order; a tail row repeats the next bucket's first row.

    Bounds of buckets are quantiles of doc_id; the table of first rows has at most MAX_BUCKETS rows and is broadcast.
    """
    from pyspark.ml.feature import Bucketizer

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("key", F.coalesce("doc_id", F.lit(-(1 << 63)).cast("long"))).withColumn("key_d", F.col("key").cast("double"))
    n = min(MAX_BUCKETS, max(1, -(-rows.count() // BUCKET_ROWS)))
    cuts: list[float] = []
    if n > 1:
        shares = [i / n for i in range(1, n)]
        cuts = sorted(set(rows.agg(F.percentile_approx("key_d", shares, max(10_000, 10 * n))).first()[0]))
    splits = [float("-inf"), *cuts, float("inf")]
    if cuts:
        rows = Bucketizer(splits=splits, inputCol="key_d", outputCol="bucket_d").transform(rows).withColumn("bucket", F.col("bucket_d").cast("int"))
    else:  # a Bucketizer needs two buckets
        rows = rows.withColumn("bucket", F.lit(0))
    rows = rows.select("bucket", F.lit(0).alias("tail"), "key", "doc_id", "text")
    order = Window.orderBy("bucket")
    heads = rows.groupBy("bucket").agg(F.min("key").alias("key"))
    heads = heads.select("key", F.coalesce(F.lag("bucket").over(order), F.max("bucket").over(Window.partitionBy())).alias("before"))
    tails = rows.join(F.broadcast(heads), "key").select(F.col("before").alias("bucket"), F.lit(1).alias("tail"), "key", "doc_id", "text")
    return rows.union(tails).repartitionById(len(splits) - 1, "bucket").sortWithinPartitions("bucket", "tail", "key", "text")


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, common_prefix) of every row.

    common_prefix is the longest common extension of a text's and its edited text's beginnings.
    """
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, common_prefix long"
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64()]
    names = [x.split()[0] for x in schema.split(", ")]

    def row(doc_id, text: str, own: Fingerprint, successor: str, following: Fingerprint) -> tuple:
        edited = edited_text(text, successor)
        e = Fingerprint(edited)
        return (doc_id, own.n, hashlib.sha256(edited.encode()).hexdigest(), str(own), str(e), own.likeness(e), own.likeness(following), own.hashes.extension(0, e.hashes, 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, ended = None, False
        for b in batches:
            out: list[tuple] = []
            for tail, doc_id, text in zip(*(b.column(i).to_pylist() for i in range(3))):
                if ended:
                    break
                f = Fingerprint(text)
                if before is not None:
                    out.append(row(*before, text, f))
                before, ended = (doc_id, text, f), bool(tail)
            cols = list(zip(*out)) or [()] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)

    return in_order(docs).select("tail", "doc_id", "text").mapInArrow(run, schema)
