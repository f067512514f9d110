"""Spatial Column builders: buckets, Morton codes by bit spreading, Hilbert codes by a fold, plane geometry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bucket(x: Column, y: Column, z: Column) -> Column:
    """floor(100x) * 10^6 + floor(100y) * 10^3 + floor(100z)."""
    f = lambda c: F.floor(c * 100)
    return f(x) * 1_000_000 + f(y) * 1_000 + f(z)


def cube(c: Column, side: float = 0.1) -> Column:
    return F.floor(c / side)


def quantise(c: Column, lo: float, hi: float, bits: int) -> Column:
    """Cell number of a coordinate in a box, clamped to it."""
    top = (1 << bits) - 1
    return F.least(F.greatest(F.floor((c - lo) / (hi - lo) * top), F.lit(0)), F.lit(top)).cast("long")


def _spread2(v: Column) -> Column:
    for s, m in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        v = (v.bitwiseOR(F.shiftleft(v, s))).bitwiseAND(F.lit(m))
    return v


def _gather2(v: Column) -> Column:
    v = v.bitwiseAND(F.lit(0x5555555555555555))
    for s, m in ((1, 0x3333333333333333), (2, 0x0F0F0F0F0F0F0F0F), (4, 0x00FF00FF00FF00FF), (8, 0x0000FFFF0000FFFF), (16, 0x00000000FFFFFFFF)):
        v = (v.bitwiseOR(F.shiftright(v, s))).bitwiseAND(F.lit(m))
    return v


def _spread3(v: Column) -> Column:
    for s, m in ((32, 0x1F00000000FFFF), (16, 0x1F0000FF0000FF), (8, 0x100F00F00F00F00F), (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249)):
        v = (v.bitwiseOR(F.shiftleft(v, s))).bitwiseAND(F.lit(m))
    return v


def _gather3(v: Column) -> Column:
    v = v.bitwiseAND(F.lit(0x1249249249249249))
    for s, m in ((2, 0x10C30C30C30C30C3), (4, 0x100F00F00F00F00F), (8, 0x1F0000FF0000FF), (16, 0x1F00000000FFFF), (32, 0x1FFFFF)):
        v = (v.bitwiseOR(F.shiftright(v, s))).bitwiseAND(F.lit(m))
    return v


def morton2(x: Column, y: Column) -> Column:
    return _spread2(x).bitwiseOR(F.shiftleft(_spread2(y), 1))


def morton2_decode(code: Column) -> tuple[Column, Column]:
    return _gather2(code), _gather2(F.shiftright(code, 1))


def morton3(x: Column, y: Column, z: Column) -> Column:
    return _spread3(x).bitwiseOR(F.shiftleft(_spread3(y), 1)).bitwiseOR(F.shiftleft(_spread3(z), 2))


def morton3_decode(code: Column) -> tuple[Column, Column, Column]:
    return _gather3(code), _gather3(F.shiftright(code, 1)), _gather3(F.shiftright(code, 2))


def hilbert2(x: Column, y: Column, bits: int = 16) -> Column:
    """Position of a cell on the Hilbert curve, folded from the highest bit down."""

    def step(s: Column, i: Column) -> Column:
        k = F.pow(F.lit(2), i).cast("long")
        rx = (s["x"].bitwiseAND(k) > 0).cast("long")
        ry = (s["y"].bitwiseAND(k) > 0).cast("long")
        d = s["d"] + k * k * (F.lit(3).cast("long") * rx).bitwiseXOR(ry)
        top = F.lit((1 << bits) - 1).cast("long")
        fx, fy = F.when(rx == 1, top - s["x"]).otherwise(s["x"]), F.when(rx == 1, top - s["y"]).otherwise(s["y"])
        nx, ny = F.when(ry == 0, fy).otherwise(s["x"]), F.when(ry == 0, fx).otherwise(s["y"])
        return F.struct(nx.alias("x"), ny.alias("y"), d.alias("d"))

    start = F.struct(x.cast("long").alias("x"), y.cast("long").alias("y"), F.lit(0).cast("long").alias("d"))
    return F.aggregate(F.sequence(F.lit(bits - 1), F.lit(0), F.lit(-1)), start, step, lambda s: s["d"])


def hilbert2_decode(code: Column, bits: int = 16) -> tuple[Column, Column]:
    """The cell of a position, from the lowest bits up; the inverse of ``hilbert2``."""

    def step(s: Column, i: Column) -> Column:
        k = F.pow(F.lit(2), i).cast("long")
        q = F.floor(code / (k * k)).cast("long")
        rx = F.floor(q / 2).cast("long").bitwiseAND(F.lit(1).cast("long"))
        ry = q.bitwiseXOR(rx).bitwiseAND(F.lit(1).cast("long"))
        top = k - 1
        fx, fy = F.when(rx == 1, top - s["x"]).otherwise(s["x"]), F.when(rx == 1, top - s["y"]).otherwise(s["y"])
        nx, ny = F.when(ry == 0, fy).otherwise(s["x"]), F.when(ry == 0, fx).otherwise(s["y"])
        return F.struct((nx + k * rx).alias("x"), (ny + k * ry).alias("y"))

    zero = F.lit(0).cast("long")
    cell = F.aggregate(F.sequence(F.lit(0), F.lit(bits - 1)), F.struct(zero.alias("x"), zero.alias("y")), step)
    return cell["x"], cell["y"]


def once(value: Column, f) -> Column:
    """f(value), with ``value`` computed once however often f uses it."""
    return F.transform(F.array(value), f)[0]


def _turned(s: Column, axes: str, k: Column) -> Column:
    """For each axis, what lies below bit k reflected in x if the axis has the bit, else exchanged with x."""

    def along(axis: str):
        def turn(s: Column) -> Column:
            on = s[axis].bitwiseAND(k) > 0
            differ = s["x"].bitwiseXOR(s[axis]).bitwiseAND(k - 1)
            new = {a: s[a] for a in "xyz"} | {axis: F.when(on, s[axis]).otherwise(s[axis].bitwiseXOR(differ))}
            new["x"] = F.when(on, s["x"].bitwiseXOR(k - 1)).otherwise(s["x"].bitwiseXOR(differ))
            return F.struct(*(c.alias(a) for a, c in new.items()))

        return turn

    for axis in axes:
        s = once(s, along(axis))
    return s


def hilbert3(x: Column, y: Column, z: Column, bits: int = 16) -> Column:
    """Position of a cell on the three-dimensional Hilbert curve, at most 21 bits an axis.

    From the highest bit down, what lies below a set bit of an axis is reflected in x, below one not set exchanged with x; then the
    axes are Gray-coded and their bits interleaved, x first.
    """
    zero = F.lit(0).cast("long")

    def step(s: Column, i: Column) -> Column:
        k = F.pow(F.lit(2), i).cast("long")
        return _turned(s, "xyz", k)

    start = F.struct(*(c.cast("long").alias(a) for a, c in zip("xyz", (x, y, z))))

    def gray(s: Column) -> Column:
        b = s["x"].bitwiseXOR(s["y"])
        c = b.bitwiseXOR(s["z"])
        flip = F.aggregate(F.sequence(F.lit(1), F.lit(max(1, bits - 1))), zero, lambda t, i: F.when(c.bitwiseAND(F.pow(F.lit(2), i).cast("long")) > 0, t.bitwiseXOR(F.pow(F.lit(2), i).cast("long") - 1)).otherwise(t))
        return F.struct(s["x"].alias("x"), b.alias("y"), c.alias("z"), flip.alias("flip"))

    turned = F.aggregate(F.sequence(F.lit(bits - 1), F.lit(1), F.lit(-1)), start, step, gray) if bits > 1 else gray(start)
    return once(turned, lambda s: morton3(s["z"].bitwiseXOR(s["flip"]), s["y"].bitwiseXOR(s["flip"]), s["x"].bitwiseXOR(s["flip"])))


def hilbert3_decode(code: Column, bits: int = 16) -> Column:
    """The cell of a position, a struct of x, y, z; the inverse of ``hilbert3``."""
    z, y, x = morton3_decode(code)
    start = F.struct(x.bitwiseXOR(F.shiftright(z, 1)).alias("x"), y.bitwiseXOR(x).alias("y"), z.bitwiseXOR(y).alias("z"))

    def step(s: Column, i: Column) -> Column:
        k = F.pow(F.lit(2), i).cast("long")
        return _turned(s, "zyx", k)

    return F.aggregate(F.sequence(F.lit(1), F.lit(bits - 1)), start, step) if bits > 1 else start


def segment_distance(px: Column, py: Column, ax: float, ay: float, bx: float, by: float) -> Column:
    """Distance of a point from a line segment."""
    dx, dy = bx - ax, by - ay
    t = F.least(F.greatest(((px - ax) * dx + (py - ay) * dy) / (dx * dx + dy * dy), F.lit(0.0)), F.lit(1.0))
    return F.sqrt(F.pow(px - (ax + t * dx), 2) + F.pow(py - (ay + t * dy), 2))


def in_polygon(px: Column, py: Column, ring: list[tuple[float, float]]) -> Column:
    """Ray casting over a fixed ring."""
    n = F.lit(0)
    for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
        if ay != by:
            cuts = ((F.lit(ay) > py) != (F.lit(by) > py)) & (px < (bx - ax) * (py - ay) / (by - ay) + ax)
            n = n + cuts.cast("int")
    return n % 2 == 1


def wkt_point(x: Column, y: Column, z: Column) -> Column:
    return F.format_string("POINT (%.6f %.6f %.6f)", x, y, z)
