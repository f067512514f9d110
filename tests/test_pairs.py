"""All pairs of a group in blocks, against plain loops; groups over the bound of whole-group algorithms."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from atomweave.operators import grouped as G
from atomweave.operators import pairs as P
from atomweave.plans import aggregates, grouped

ROWS = "label int, vec_id long, embedding array<float>"


@pytest.fixture
def table(spark, monkeypatch):
    monkeypatch.setattr(P, "BLOCK", 8)
    r = np.random.default_rng(3)
    rows = [(i % 3, i, r.standard_normal(8).astype("f4").tolist()) for i in range(90)]
    rows[31] = (1, 30, rows[31][2])  # an id twice in one label would be no pair
    rows[33] = (0, 30, rows[33][2])
    rows[40], rows[41], rows[42] = (1, 40, None), (2, 41, [0.0] * 8), (0, 42, [1.0, 2.0])
    return rows, spark.createDataFrame(rows + [(7, 1, [1.0, 0.0])], ROWS)


def cosine(a, b):
    a, b = np.array(a, float), np.array(b, float)
    with np.errstate(all="ignore"):
        return a @ b / np.sqrt((a @ a) * (b @ b))


def test_pairs_equal_loops(table):
    rows, df = table
    args = "label", "vec_id", "embedding"
    fits = lambda a, b: a[2] and b[2] and len(a[2]) == len(b[2])
    nearest, far, alike = {}, {}, {}
    for g in (0, 1, 2):
        of = sorted((r for r in rows if r[0] == g), key=lambda r: r[1])
        for j, b in enumerate(of):
            for i, a in enumerate(of[:j]):
                c = cosine(a[2], b[2]) if fits(a, b) else None
                if j - i >= 3 and c is not None and not c <= 0.25 and a[1] != b[1]:
                    alike[g] = alike.get(g, 0) + 1
                if a[1] < b[1]:
                    nearest.setdefault((g, b[1]), []).append(c)
                    if c is not None:
                        far[g] = max(far.get(g, 0), float(np.linalg.norm(np.subtract(a[2], b[2], dtype=float))))
    best = lambda x: max((c for c in x if c is not None), key=lambda c: (c != c, c), default=None)
    want = {k: best(v) for k, v in nearest.items()}
    got = {(r["g"], r["id"]): r["cosine"] for r in P.greatest_cosine_before(df, *args).collect()}
    plain = lambda d: {k: "nan" if v != v else v and round(v, 9) for k, v in d.items()}
    assert plain(got) == plain(want)
    assert {r["g"]: round(r["diameter"], 9) for r in P.diameters(df, *args).collect()} == {g: round(d, 9) for g, d in far.items()}
    apart = df.where("NOT (vec_id = 30 AND label IN (0, 1))")
    assert {r["g"] for r in P.count_alike(apart, *args, 0.25, 3).collect()} == set(alike)
    assert {r["g"]: r["pairs"] for r in P.count_alike(df, *args, 0.25, 3).collect()} == alike
    a = {r["label"]: json.loads(r["result"]) for r in P.attention(df, *args, heads=2).collect()}
    for g in (0, 1, 2):
        v = np.array([r[2] for r in sorted(rows, key=lambda r: r[1]) if r[0] == g and r[2] and len(r[2]) == 8], float)
        assert np.allclose(a[g], G.attention(v, heads=2), atol=2e-6)
    assert a[7] == G.attention(np.array([[1.0, 0.0]]), heads=2)


def test_groups_over_the_bound_of_whole_groups(spark, tmp_path):
    x = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.sin(F.col("id") * (i + 1)).cast("float"))
    spark.range(G.MOST_SQUARE + 5).select(F.lit(1).alias("label"), F.col("id").alias("vec_id"), x.alias("embedding")).write.parquet(str(tmp_path / "embeddings.parquet"))
    v = np.stack(spark.read.parquet(str(tmp_path / "embeddings.parquet")).orderBy("vec_id").toPandas()["embedding"].to_numpy()).astype(float)
    got = json.loads(grouped.QUERIES["group_attention"](spark, str(tmp_path)).collect()[0]["result"])
    assert np.allclose(got, G.attention(v), atol=2e-6)
    assert aggregates.QUERIES["agg_path_diameter"](spark, str(tmp_path)).collect()[0]["diameter"] > 0


def test_warping_by_tiles(spark, monkeypatch):
    monkeypatch.setattr(P, "TILE", 5)
    r = np.random.default_rng(5)
    sizes = {1: 27, 2: 1, 3: 2, 4: 11}
    rows = [(g, i, r.standard_normal(4).tolist()) for g, n in sizes.items() for i in range(n)]
    got = {x["label"]: json.loads(x["result"]) for x in P.warping_distance(spark.createDataFrame(rows, ROWS.replace("float", "double")), "label", "vec_id", "embedding").collect()}
    assert got == {g: G.dtw(np.array([v for h, _, v in rows if h == g])) for g in sizes}


def test_pairs_of_unit_vectors_equal_brute_force(spark, monkeypatch):
    from atomweave.operators import search

    monkeypatch.setattr(P, "BLOCK", 7)
    r = np.random.default_rng(8)
    v = {i: r.standard_normal(4) for i in range(40)}
    v[40] = v[3] * 2
    rows = [(i, i % 3 if i < 40 else 0, x.tolist()) for i, x in v.items()] + [(50, 1, [0.0] * 4), (51, 1, [float("nan")] * 4), (52, 1, None), (53, None, [1.0] * 4), (3, 0, [9.0] * 4)]
    got = search.duplicates(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>"), 0.5).collect()
    some = [(i, g, np.array(x)) for i, g, x in rows if g is not None and x is not None and 0 < np.linalg.norm(x) < np.inf]
    cos = lambda x, y: round(float(x @ y / np.linalg.norm(x) / np.linalg.norm(y)), 6)
    want = sorted((i, j, cos(x, y)) for i, g, x in some for j, h, y in some if g == h and i < j and cos(x, y) >= 0.5)
    assert [x[:2] for x in want] == [(x["a"], x["b"]) for x in sorted(got)] and np.allclose([x[2] for x in want], [x["similarity"] for x in sorted(got)], atol=2e-6)
