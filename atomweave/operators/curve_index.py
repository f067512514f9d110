"""A spatial index over three axes: a Parquet table in the order of the Hilbert curve, scanned by intervals of codes.

An aligned cube of cells is one interval of the curve. A box is covered by such cubes, split where they stick out of it; their intervals, merged
to a bounded number, are a disjunction of ranges that Parquet's statistics push down, so row groups without any
of them aren't read. The box itself decides on the rows that are. Points beyond the index's own box lie in its outermost cells. A point
with a null or NaN coordinate has no code and is in no box.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from atomweave.functions import spatial as S

CODE = "curve_code"
#: Intervals of a cover at most; the curve is cut finer than that before neighbours are merged.
MOST_INTERVALS = 64


@dataclass(frozen=True)
class CurveIndex:
    """Where the index lies, the names of its axes, its box and the bits of an axis."""

    path: str
    axes: tuple[str, str, str]
    low: tuple[float, ...]
    high: tuple[float, ...]
    bits: int
    rows: int

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(self.path)

    def cell(self, axis: int, value: float) -> int:
        """As ``quantise`` does."""
        top = (1 << self.bits) - 1
        return int(min(max(math.floor((value - self.low[axis]) / (self.high[axis] - self.low[axis]) * top), 0), top))


def codes(cells: np.ndarray, bits: int) -> np.ndarray:
    """Positions of cells (n, 3) on the curve: ``hilbert3`` for numbers on the driver."""
    x = cells.T.astype(np.int64).copy()
    for b in range(bits - 1, 0, -1):
        k = 1 << b
        for axis in range(3):
            on = (x[axis] & k) > 0
            differ = np.where(on, 0, (x[0] ^ x[axis]) & (k - 1))
            x[axis] ^= differ
            x[0] ^= np.where(on, k - 1, 0) if axis == 0 else np.where(on, k - 1, differ)
    x[1] ^= x[0]
    x[2] ^= x[1]
    flip = np.zeros_like(x[0])
    for b in range(1, bits):
        flip ^= np.where(x[2] & (1 << b), (1 << b) - 1, 0)
    x ^= flip
    out = np.zeros_like(x[0])
    for b in range(bits):
        for axis in range(3):
            out |= ((x[axis] >> b) & 1) << (3 * b + 2 - axis)
    return out


def cover(low: tuple, high: tuple, bits: int, most: int = MOST_INTERVALS) -> list[tuple[int, int]]:
    """Intervals (first, last) of codes, ascending, with all cells from ``low`` to ``high``: at most ``most``."""
    low, high = np.array(low), np.array(high)
    corners, level, done = np.zeros((1, 3), np.int64), bits, []
    while len(corners):
        side = 1 << level
        inside = ((corners >= low) & (corners + side - 1 <= high)).all(1)
        done += [(int(h) >> 3 * level << 3 * level, level) for h in codes(corners[inside], bits)]
        corners = corners[~inside]
        if level == 0 or len(corners) * 8 + len(done) > 8 * most:
            done += [(int(h) >> 3 * level << 3 * level, level) for h in codes(corners, bits)]
            break
        level -= 1
        steps = np.stack(np.meshgrid(*[[0, 1 << level]] * 3, indexing="ij"), -1).reshape(-1, 3)
        corners = (corners[:, None] + steps).reshape(-1, 3)
        corners = corners[((corners <= high) & (corners + (1 << level) - 1 >= low)).all(1)]
    out: list[list[int]] = []
    for first, lv in sorted(done):
        last = first + (1 << 3 * lv) - 1
        if out and first <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], last)
        else:
            out.append([first, last])
    gaps = sorted(range(1, len(out)), key=lambda i: out[i][0] - out[i - 1][1])
    closed = {*gaps[: max(0, len(out) - most)]}  # the narrowest gaps are scanned too
    merged: list[list[int]] = []
    for i, (first, last) in enumerate(out):
        if i in closed:
            merged[-1][1] = last
        else:
            merged.append([first, last])
    return [tuple(x) for x in merged]


def write_index(points: DataFrame, path: str, axes: tuple[str, str, str] = ("x", "y", "z"), bits: int = 12, partitions: int | None = None, row_group_bytes: int = 1 << 24) -> CurveIndex:
    """Write ``points`` with all their columns in curve order to ``path``."""
    known = [F.when(~F.isnan(F.col(a).cast("double")), F.col(a).cast("double")) for a in axes]
    whole = points.agg(*(f(c).alias(f"{n}{i}") for i, c in enumerate(known) for n, f in (("l", F.min), ("h", F.max))), F.count("*").alias("n")).first()
    low = tuple(0.0 if whole[f"l{i}"] is None else whole[f"l{i}"] for i in range(3))
    high = tuple(max(0.0 if whole[f"h{i}"] is None else whole[f"h{i}"], math.nextafter(low[i], math.inf), low[i] + 1e-9) for i in range(3))
    cells = [S.quantise(c, a, b, bits) for c, a, b in zip(known, low, high)]
    coded = points.withColumn(CODE, F.when(cells[0].isNotNull() & cells[1].isNotNull() & cells[2].isNotNull(), S.hilbert3(*cells, bits)))
    dealt = coded.repartitionByRange(partitions, CODE) if partitions else coded.repartitionByRange(CODE)
    dealt.sortWithinPartitions(CODE).write.option("parquet.block.size", row_group_bytes).mode("overwrite").parquet(path)
    return CurveIndex(path, axes, low, high, bits, whole["n"])


def within(index: CurveIndex, spark: SparkSession, low: tuple[float, ...], high: tuple[float, ...]) -> DataFrame:
    """Rows of the index whose point lies in a closed box."""
    if any(a > b for a, b in zip(low, high)):
        return index.read(spark).limit(0)
    cells = [[index.cell(i, v[i]) for i in range(3)] for v in (low, high)]
    met: Column = F.lit(False)
    for first, last in cover(*cells, index.bits):
        met = met | F.col(CODE).between(first, last)
    box = [F.col(a).between(l, h) for a, l, h in zip(index.axes, low, high)]
    return index.read(spark).where(met).where(box[0] & box[1] & box[2])


def nearest(index: CurveIndex, spark: SparkSession, point: tuple[float, float, float], k: int, key: str, digits: int = 6) -> DataFrame:
    """The k nearest rows (all columns, ``d``) by distance to ``digits`` digits, then ``key``; exact.

    Boxes around the point are doubled until the ball in one has k rows, or the box holds the whole index.
    """
    squares = [F.pow(F.col(a) - v, 2) for a, v in zip(index.axes, point)]
    d = F.round(F.sqrt(squares[0] + squares[1] + squares[2]), digits)
    volume = math.prod(h - l for l, h in zip(index.low, index.high))
    radius = max((volume * k / max(1, index.rows)) ** (1 / 3), 10.0**-digits * 4)
    while True:
        found = within(index, spark, tuple(v - radius for v in point), tuple(v + radius for v in point)).withColumn("d", d)
        whole = all(v - radius <= l and v + radius >= h for v, l, h in zip(point, index.low, index.high))
        ball = found if whole else found.where(F.col("d") <= radius - 10.0**-digits)
        if whole or ball.limit(k).count() >= k:
            return ball.orderBy("d", key).limit(k)
        radius *= 2
