"""Spatial functions over the first three components of ``embeddings``."""

from __future__ import annotations

from pyspark.sql import functions as F

from atomweave.functions import spatial as S
from atomweave.functions import vector as V
from atomweave.operators.curve_index import nearest, within, write_index
from atomweave.operators.curve_quality import STRIDES, locality, preservation
from atomweave.operators.paths import PATH, find_path
from atomweave.operators.work import fresh_path
from atomweave.plans.base import Registry, table

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles

XYZ = "(SELECT vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings)"


def points(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", *(F.col("embedding")[i].cast("double").alias(n) for i, n in enumerate("xyz")))


def xyz():
    return F.col("x"), F.col("y"), F.col("z")


@R.add(
    "spatial_buckets",
    f"SELECT vec_id, floor(x * 100)::BIGINT * 1000000 + floor(y * 100)::BIGINT * 1000 + floor(z * 100)::BIGINT AS bucket, floor(x / 0.1)::BIGINT AS bx, floor(y / 0.1)::BIGINT AS by_, floor(z / 0.1)::BIGINT AS bz FROM {XYZ} p",
)
def spatial_buckets(spark, sf_dir):
    x, y, z = xyz()
    return points(spark, sf_dir).select("vec_id", S.bucket(x, y, z).alias("bucket"), S.cube(x).alias("bx"), S.cube(y).alias("by_"), S.cube(z).alias("bz"))


_BITS = " + ".join(f"(((qx >> {i}) & 1) << {3 * i}) + (((qy >> {i}) & 1) << {3 * i + 1}) + (((qz >> {i}) & 1) << {3 * i + 2})" for i in range(12))
_BITS2 = " + ".join(f"(((qx >> {i}) & 1) << {2 * i}) + (((qy >> {i}) & 1) << {2 * i + 1})" for i in range(12))
_Q = ", ".join(f"least(greatest(floor(({c} + 1) / 2 * 4095), 0), 4095)::BIGINT AS q{c}" for c in "xyz")


@R.add("morton_codes", f"SELECT vec_id, ({_BITS2})::BIGINT AS m2, ({_BITS})::BIGINT AS m3, qx, qy, qz FROM (SELECT vec_id, {_Q} FROM {XYZ} p) q")
def morton_codes(spark, sf_dir):
    q = points(spark, sf_dir).select("vec_id", *(S.quantise(F.col(c), -1.0, 1.0, 12).alias(f"q{c}") for c in "xyz"))
    coded = q.select("vec_id", S.morton2(F.col("qx"), F.col("qy")).alias("m2"), S.morton3(F.col("qx"), F.col("qy"), F.col("qz")).alias("m3"))
    x, y, z = S.morton3_decode(F.col("m3"))  # decoded back: the oracle has what went in
    return coded.select("vec_id", "m2", "m3", x.alias("qx"), y.alias("qy"), z.alias("qz"))


# the fold as a recursion from the highest bit down
_H2 = f"""h(vec_id, i, x, y, d) AS (SELECT vec_id, 11, qx, qy, 0::BIGINT FROM (SELECT vec_id, {_Q} FROM {XYZ} p) q UNION ALL
    SELECT vec_id, i - 1, CASE WHEN ry = 0 THEN if(rx = 1, 4095 - y, y) ELSE x END, CASE WHEN ry = 0 THEN if(rx = 1, 4095 - x, x) ELSE y END, d + (1::BIGINT << (2 * i)) * xor(3 * rx, ry)
    FROM (SELECT *, (x >> i) & 1 AS rx, (y >> i) & 1 AS ry FROM h WHERE i >= 0) s)"""


@R.add("hilbert_order", f"WITH RECURSIVE {_H2} SELECT vec_id, d AS h FROM h WHERE i = -1")
def hilbert_order(spark, sf_dir):
    q = points(spark, sf_dir).select("vec_id", *(S.quantise(F.col(c), -1.0, 1.0, 12).alias(f"q{c}") for c in "xy"))
    return q.select("vec_id", S.hilbert2(F.col("qx"), F.col("qy"), 12).alias("h"))


def _h3(cells: str, key: str) -> str:
    """A recursion that turns axes bit by bit, then Gray codes and interleaves; ``cells`` has (key, qx, qy, qz) of 12 bits."""
    turn = lambda a: f"if((({a} >> i) & 1) = 1, xor(x, (1::BIGINT << i) - 1), xor(x, xor(x, {a}) & ((1::BIGINT << i) - 1)))"
    other = lambda a: f"if((({a} >> i) & 1) = 1, {a}, xor({a}, xor(x, {a}) & ((1::BIGINT << i) - 1)))"
    bits = " + ".join(f"(((xor(x, flip) >> {b}) & 1) << {3 * b + 2}) + (((xor(b, flip) >> {b}) & 1) << {3 * b + 1}) + (((xor(c, flip) >> {b}) & 1) << {3 * b})" for b in range(12))
    return f"""t({key}, i, x, y, z) AS (SELECT {key}, 11, qx::BIGINT, qy::BIGINT, qz::BIGINT FROM ({cells}) q UNION ALL
    SELECT {key}, i - 1, {turn("z")}, y, {other("z")} FROM (SELECT {key}, i, {turn("y")} AS x, {other("y")} AS y, z FROM (SELECT {key}, i, {turn("x")} AS x, y, z FROM t WHERE i >= 1) u) v),
    g AS (SELECT {key}, x, xor(x, y) AS b, xor(xor(x, y), z) AS c FROM t WHERE i = 0),
    f AS (SELECT *, list_reduce([if(((c >> k) & 1) = 1, (1::BIGINT << k) - 1, 0::BIGINT) FOR k IN range(1, 12)], lambda p, q: xor(p, q)) AS flip FROM g),
    h3 AS (SELECT {key}, ({bits})::BIGINT AS h FROM f)"""


@R.add("hilbert3_codes", f"WITH RECURSIVE {_h3(f'SELECT vec_id, {_Q} FROM {XYZ} p', 'vec_id')} SELECT h3.vec_id, h, qx, qy, qz FROM h3 JOIN (SELECT vec_id, {_Q} FROM {XYZ} p) q ON q.vec_id = h3.vec_id")
def hilbert3_codes(spark, sf_dir):
    """Codes of all three axes, and the cells that they decode to."""
    q = points(spark, sf_dir).select("vec_id", *(S.quantise(F.col(c), -1.0, 1.0, 12).alias(c) for c in "xyz"))
    coded = q.select("vec_id", S.hilbert3(*xyz(), 12).alias("h")).withColumn("cell", S.hilbert3_decode(F.col("h"), 12))
    return coded.select("vec_id", "h", *(F.col(f"cell.{c}").alias(f"q{c}") for c in "xyz"))


@R.add("hilbert_round_trip", f"SELECT vec_id, qx, qy, 1::BIGINT AS cells_at_code FROM (SELECT vec_id, {_Q} FROM {XYZ} p) q")
def hilbert_round_trip(spark, sf_dir):
    """Cells coded and decoded again: the oracle has what went in; no two cells share a code."""
    q = points(spark, sf_dir).select("vec_id", *(S.quantise(F.col(c), -1.0, 1.0, 12).alias(f"q{c}") for c in "xy"))
    coded = q.select("vec_id", S.hilbert2(F.col("qx"), F.col("qy"), 12).alias("h"), "qx", "qy")
    per = coded.groupBy("h").agg(F.countDistinct("qx", "qy").alias("cells_at_code"))
    x, y = S.hilbert2_decode(F.col("h"), 12)
    return coded.join(per, "h").select("vec_id", x.alias("qx"), y.alias("qy"), "cells_at_code")


@R.add("hilbert_neighbours", "SELECT count(*) AS steps, count(*) AS unit_steps FROM embeddings")
def hilbert_neighbours(spark, sf_dir):
    """The curve goes on from each vector's cell to one beside it."""
    q = points(spark, sf_dir).select(*(S.quantise(F.col(c), -1.0, 1.0, 12).alias(c) for c in "xyz"))
    coded = q.select(S.hilbert3(*xyz(), 12).alias("h"))
    p = coded.select(S.hilbert3_decode(F.col("h"), 12).alias("a"), S.hilbert3_decode(F.when(F.col("h") < (1 << 36) - 1, F.col("h") + 1).otherwise(F.col("h") - 1), 12).alias("b"))
    near = sum((F.abs(F.col(f"a.{c}") - F.col(f"b.{c}")) for c in "xyz"), F.lit(0)) == 1
    return p.agg(F.count("*").alias("steps"), F.sum(near.cast("long")).alias("unit_steps"))


_CORNERS = f"SELECT label, {_Q} FROM (SELECT label, min(embedding[1]::DOUBLE) AS x, min(embedding[2]::DOUBLE) AS y, min(embedding[3]::DOUBLE) AS z FROM embeddings GROUP BY label) p"


@R.add("hilbert_range_start", f"WITH RECURSIVE {_h3(_CORNERS, 'label')} SELECT label, h AS start FROM h3")
def hilbert_range_start(spark, sf_dir):
    """The code of the lower corner of each label's bounding box."""
    e = table(spark, sf_dir, "embeddings")
    corner = e.groupBy("label").agg(*(F.min(F.col("embedding")[i].cast("double")).alias(c) for i, c in enumerate("xyz")))
    return corner.select("label", S.hilbert3(*(S.quantise(F.col(c), -1.0, 1.0, 12) for c in "xyz"), 12).alias("start"))


def _index(spark, sf_dir):
    return write_index(points(spark, sf_dir), fresh_path(spark, "curve-index"))


@R.add("spatial_knn", f"SELECT vec_id, round(sqrt((x - 0.1) ** 2 + y ** 2 + (z + 0.1) ** 2), 6) AS d FROM {XYZ} p ORDER BY d, vec_id LIMIT 12")
def spatial_knn(spark, sf_dir):
    return nearest(_index(spark, sf_dir), spark, (0.1, 0.0, -0.1), 12, "vec_id").select("vec_id", "d")


@R.add("curve_box_scan", f"SELECT vec_id FROM {XYZ} p WHERE x BETWEEN -0.05 AND 0.15 AND y BETWEEN -0.1 AND 0.1 AND z BETWEEN 0.0 AND 0.2")
def curve_box_scan(spark, sf_dir):
    """Vectors in a box, by intervals of the curve."""
    return within(_index(spark, sf_dir), spark, (-0.05, -0.1, 0.0), (0.15, 0.1, 0.2)).select("vec_id")


@R.add("spatial_region", f"SELECT vec_id, (x ** 2 + y ** 2 <= 0.01) AS within_circle, (x BETWEEN -0.1 AND 0.1 AND y BETWEEN 0 AND 0.2) AS within_box, round(CASE WHEN x < 0 THEN sqrt(x ** 2 + y ** 2) WHEN x > 0.2 THEN sqrt((x - 0.2) ** 2 + y ** 2) ELSE abs(y) END, 6) AS to_segment, printf('POINT (%.6f %.6f %.6f)', x, y, z) AS wkt FROM {XYZ} p")
def spatial_region(spark, sf_dir):
    x, y, z = xyz()
    return points(spark, sf_dir).select(
        "vec_id",
        (x * x + y * y <= 0.01).alias("within_circle"),
        (x.between(-0.1, 0.1) & y.between(0, 0.2)).alias("within_box"),
        F.round(S.segment_distance(x, y, 0.0, 0.0, 0.2, 0.0), 6).alias("to_segment"),
        S.wkt_point(x, y, z).alias("wkt"),
    )


@R.add("point_in_polygon", f"SELECT vec_id, (x > -0.1 AND x < 0.1 AND y > -0.1 AND y < 0.1) AS inside FROM {XYZ} p")
def point_in_polygon(spark, sf_dir):
    x, y, _ = xyz()
    return points(spark, sf_dir).select("vec_id", S.in_polygon(x, y, [(-0.1, -0.1), (0.1, -0.1), (0.1, 0.1), (-0.1, 0.1)]).alias("inside"))


#: Three fixed directions that stand for the seeded basis.
BASIS = [[((i * 7 + k * 13) % 11 - 5) / 10 for i in range(64)] for k in range(3)]
_PROJ = ", ".join(f"round(list_dot_product(embedding::DOUBLE[], {b}::DOUBLE[]), 6) AS p{k}" for k, b in enumerate(BASIS))


@R.add("project_to_3d", f"SELECT vec_id, {_PROJ}, round(embedding[1]::DOUBLE / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * 100, 6) AS first FROM embeddings")
def project_to_3d(spark, sf_dir):
    e, v = table(spark, sf_dir, "embeddings"), F.col("embedding")
    dots = [F.round(V.dot(v, F.array(*map(F.lit, b))), 6).alias(f"p{k}") for k, b in enumerate(BASIS)]
    return e.select("vec_id", *dots, F.round(v[0].cast("double") / V.norm(v) * 100, 6).alias("first"))


R.sql("geometry_rms", "SELECT user_id, round(sqrt(sum(value * value) / count(*)), 6) AS rms FROM events GROUP BY user_id")
R.sql("context_centroid", "SELECT label, round(avg(embedding[0]), 6) AS x, round(avg(embedding[1]), 6) AS y, count(*) AS n FROM embeddings GROUP BY label", "SELECT label, round(avg(embedding[1]::DOUBLE), 6) AS x, round(avg(embedding[2]::DOUBLE), 6) AS y, count(*) AS n FROM embeddings GROUP BY label")


def _coded(spark, sf_dir):
    q = points(spark, sf_dir)
    cell = [S.quantise(F.col(c), -1.0, 1.0, 12) for c in "xyz"]
    return q.select("vec_id", F.array("x", "y", "z").alias("xyz"), S.hilbert3(*cell, 12).alias("hilbert"), S.morton3(*cell).alias("morton"))


_CODED = f"""{_h3(f'SELECT vec_id, {_Q} FROM {XYZ} p', 'vec_id')}, b AS MATERIALIZED (SELECT p.vec_id, x, y, z, h AS hilbert, m AS morton FROM {XYZ} p JOIN h3 USING (vec_id) JOIN (SELECT vec_id, ({_BITS})::BIGINT AS m FROM (SELECT vec_id, {_Q} FROM {XYZ} p) q) n USING (vec_id)),
    c AS MATERIALIZED (SELECT vec_id, x, y, z, curve, code, row_number() OVER (PARTITION BY curve ORDER BY code, vec_id) AS r FROM (SELECT vec_id, x, y, z, 'hilbert' AS curve, hilbert AS code FROM b UNION ALL SELECT vec_id, x, y, z, 'morton', morton FROM b) u)"""


@R.add(
    "curve_locality",
    f"""WITH RECURSIVE {_CODED}, p AS (SELECT a.curve, s AS stride, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) AS d, (b.code - a.code)::DOUBLE AS span FROM c a, (SELECT unnest({[*STRIDES]}) AS s) t, c b WHERE b.curve = a.curve AND b.r = a.r + s)
    SELECT curve, stride::INT AS stride, count(*) AS pairs, round(avg(d), 6) AS mean_distance, NULL::DOUBLE AS correlation FROM p GROUP BY 1, 2
    UNION ALL SELECT curve, NULL, count(*), round(avg(d), 6), round(corr(d, span), 6) FROM p GROUP BY 1""",
)
def curve_locality(spark, sf_dir):
    """How distances in space follow those along both curves."""
    coded, out = _coded(spark, sf_dir), None
    for curve in ("hilbert", "morton"):
        one = locality(coded, "vec_id", curve, "xyz").select(F.lit(curve).alias("curve"), "stride", "pairs", F.round("mean_distance", 6).alias("mean_distance"), F.round("correlation", 6).alias("correlation"))
        out = one if out is None else out.unionByName(one)
    return out


@R.add(
    "curve_preservation",
    f"""WITH RECURSIVE {_CODED}, d AS (SELECT a.vec_id, b.vec_id AS other, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2), 9), b.vec_id) AS k FROM b a JOIN b ON a.vec_id <> b.vec_id)
    SELECT a.curve, a.vec_id, count(*) FILTER (abs(a.r - b.r) <= 5) AS kept FROM d JOIN c a ON a.vec_id = d.vec_id JOIN c b ON b.vec_id = d.other AND b.curve = a.curve WHERE k <= 5 GROUP BY 1, 2""",
)
def curve_preservation(spark, sf_dir):
    """How many of each vector's five nearest are within five ranks along both curves."""
    coded, out = _coded(spark, sf_dir), None
    for curve in ("hilbert", "morton"):
        one = preservation(coded, "vec_id", curve, "xyz").select(F.lit(curve).alias("curve"), F.col("id").alias("vec_id"), "kept")
        out = one if out is None else out.unionByName(one)
    return out


_START, _REGION, _STEP = 0, 0.08, 0.15


@R.add(
    "spatial_path",
    f"""WITH RECURSIVE p AS MATERIALIZED (SELECT * FROM {XYZ} p), g AS (SELECT avg(embedding[1]::DOUBLE) + 0.2 AS x, avg(embedding[2]::DOUBLE) - 0.2 AS y, avg(embedding[3]::DOUBLE) + 0.1 AS z FROM embeddings WHERE label = 3),
    n AS MATERIALIZED (SELECT vec_id, sqrt((p.x - g.x) ** 2 + (p.y - g.y) ** 2 + (p.z - g.z) ** 2) AS h FROM p, g),
    e AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) AS w FROM p a JOIN p b ON a.vec_id <> b.vec_id JOIN n ON n.vec_id = a.vec_id
        WHERE sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) <= {_STEP} AND n.h > {_REGION}),
    r(node, g, path, i) AS (SELECT {_START}::BIGINT, 0.0::DOUBLE, [{_START}::BIGINT], 0 UNION ALL SELECT e.b, min(r.g + e.w), arg_min(list_append(r.path, e.b), r.g + e.w), r.i + 1 FROM r JOIN e ON e.a = r.node WHERE r.i < 12 GROUP BY e.b, r.i),
    o AS (SELECT node, min(g) AS g, arg_min(path, g) AS path FROM r GROUP BY 1),
    t AS (SELECT path AS route FROM o JOIN n ON n.vec_id = o.node WHERE h <= {_REGION} ORDER BY o.g + h, h, node LIMIT 1)
    SELECT (i - 1)::BIGINT AS step, route[i] AS atom_id, round(o.g, 6) AS cost, round(n.h, 6) AS to_centre FROM (SELECT route, unnest(range(1, len(route) + 1)) AS i FROM t) k JOIN o ON o.node = route[i] JOIN n ON n.vec_id = route[i]""",
)
def spatial_path(spark, sf_dir):
    """A* from a vector to the region of a concept, by steps of bounded length."""
    e = table(spark, sf_dir, "embeddings").where("label = 3")
    c = e.agg(*(F.avg(F.col("embedding")[i].cast("double")).alias(n) for i, n in enumerate("xyz"))).first()
    rows = points(spark, sf_dir).select("vec_id", F.array("x", "y", "z").alias("xyz"))
    if c["x"] is None:
        return spark.createDataFrame([], PATH)
    found = find_path(rows, "vec_id", "xyz", _START, [c["x"] + 0.2, c["y"] - 0.2, c["z"] + 0.1], _REGION, _STEP)
    return found.select("step", "atom_id", F.round("cost", 6).alias("cost"), F.round("to_centre", 6).alias("to_centre"))
