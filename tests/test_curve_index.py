"""The curve in three dimensions, covers of boxes, and scans that read a part of the row groups."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from atomweave.functions import spatial as S
from atomweave.operators.curve_index import codes, cover, nearest, within, write_index
from atomweave.operators.work import fresh_path


@pytest.mark.parametrize("bits", [1, 2, 3])
def test_every_cell_once_and_beside_the_last(spark, bits):
    n = 1 << bits
    cells = spark.range(n**3).select((F.col("id") % n).alias("x"), (F.shiftright("id", bits) % n).alias("y"), F.shiftright("id", 2 * bits).alias("z"))
    got = sorted(cells.select(S.hilbert3(F.col("x"), F.col("y"), F.col("z"), bits).alias("h"), "x", "y", "z").withColumn("c", S.hilbert3_decode(F.col("h"), bits)).collect())
    assert [r["h"] for r in got] == [*range(n**3)]
    assert all((r["x"], r["y"], r["z"]) == tuple(r["c"]) for r in got)
    assert all(sum(abs(p - q) for p, q in zip(a[1:4], b[1:4])) == 1 for a, b in zip(got, got[1:]))
    assert codes(np.array([r[1:4] for r in got]), bits).tolist() == [*range(n**3)]


@settings(max_examples=60, deadline=None)
@given(st.tuples(*[st.integers(0, 15)] * 3), st.tuples(*[st.integers(0, 15)] * 3), st.integers(1, 20))
def test_covers_hold_the_box(a, b, most):
    low, high = [min(p) for p in zip(a, b)], [max(p) for p in zip(a, b)]
    got = cover(low, high, 4, most)
    assert 1 <= len(got) <= most and all(x <= y for x, y in got) and all(p[1] < q[0] for p, q in zip(got, got[1:]))
    inside = np.stack(np.meshgrid(*[np.arange(l, h + 1) for l, h in zip(low, high)], indexing="ij"), -1).reshape(-1, 3)
    assert all(any(x <= h <= y for x, y in got) for h in codes(inside, 4).tolist())
    if most == 20 and (high[0] - low[0] + 1) * (high[1] - low[1] + 1) * (high[2] - low[2] + 1) == 1:
        assert got == [(codes(np.array([low]), 4)[0],) * 2]


def scanned(df):
    """Rows that the scan of the files put out."""
    df.collect()
    leaf = df._jdf.queryExecution().executedPlan().collectLeaves().apply(0)
    return leaf.metrics().apply("numOutputRows").value()


def test_scan_skips_row_groups(spark):
    rng = np.random.default_rng(4)
    rows = [(i, *map(float, v)) for i, v in enumerate(rng.random((60_000, 3)))] + [(-1, None, 0.5, 0.5), (-2, float("nan"), 0.5, 0.5), (-3, 0.3, 0.3, 0.3), (-4, 0.3, 0.3, 0.3)]
    points = spark.createDataFrame(rows, "id long, x double, y double, z double")
    index = write_index(points, fresh_path(spark, "test-index"), partitions=6, row_group_bytes=1 << 16)
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for low, high in [((0.2, 0.2, 0.2), (0.35, 0.4, 0.3)), ((0.0, 0.0, 0.0), (0.05, 0.05, 0.05)), ((-1.0, 0.9, 0.9), (0.1, 2.0, 2.0))]:
            got = within(index, spark, low, high)
            want = points.where(" AND ".join(f"{a} BETWEEN {l} AND {h}" for a, l, h in zip("xyz", low, high))).where("NOT isnan(x)")
            assert sorted(r["id"] for r in got.collect()) == sorted(r["id"] for r in want.collect())
            assert scanned(got) < 0.25 * len(rows)
        assert within(index, spark, (1.0, 1.0, 1.0), (0.0, 0.0, 0.0)).count() == 0
        assert within(index, spark, (-9.0, -9.0, -9.0), (9.0, 9.0, 9.0)).count() == 60_002
        for point, k in [((0.3, 0.3, 0.3), 5), ((5.0, 5.0, 5.0), 3), ((0.5, 0.1, 0.9), 40)]:
            got = nearest(index, spark, point, k, "id")
            d = F.round(F.sqrt(sum((F.pow(F.col(a) - v, 2) for a, v in zip("xyz", point)), F.lit(0.0))), 6)
            want = points.where("x IS NOT NULL AND NOT isnan(x)").select("id", d.alias("d")).orderBy("d", "id").limit(k)
            assert [tuple(r) for r in got.select("id", "d").collect()] == [tuple(r) for r in want.collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


def test_odd_tables(spark):
    none = spark.createDataFrame([], "id long, x double, y double, z double")
    index = write_index(none, fresh_path(spark, "test-index"))
    assert nearest(index, spark, (0.0, 0.0, 0.0), 3, "id").count() == 0
    same = spark.createDataFrame([(i, 1.0, 1.0, 1.0) for i in range(5)], "id long, x double, y double, z double")
    assert [r["id"] for r in nearest(write_index(same, fresh_path(spark, "test-index")), spark, (0.0, 0.0, 0.0), 3, "id").collect()] == [0, 1, 2]
