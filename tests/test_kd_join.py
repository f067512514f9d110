"""Neighbour joins, outlier factors and density clusters against brute force, with copies, ties and broken vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from atomweave.operators import kd_join
from atomweave.operators.components import components
from atomweave.operators.grouped import dbscan, local_outlier_factor
from atomweave.operators.kd_join import Tree, density_clusters, nearest_join, outlier_factors

SCHEMA = "vec_id long, v array<double>, id string, n int"


@pytest.fixture
def small_cells(monkeypatch):
    monkeypatch.setattr(kd_join, "CELL", 40)
    monkeypatch.setattr(kd_join, "UNIT", 50)
    monkeypatch.setattr(kd_join, "MANY", 20)


def clustered(n, dims, seed):
    r = np.random.default_rng(seed)
    centres = r.uniform(-20, 20, (25, dims))
    return np.round(centres[r.integers(0, 25, n)] + 0.3 * r.standard_normal((n, dims)), 3)


def frame(spark, x, more=()):
    rows = [(i, v.tolist(), "a", 1) for i, v in enumerate(x)]
    return spark.createDataFrame([*rows, *((i, v, "b", 2) for i, v in more)], SCHEMA)


def brute(x, k, radius):
    out = set()
    for i in range(len(x)):
        d = np.round(np.sqrt(((x - x[i]) ** 2).sum(1)), 9)
        near = sorted((d[j], j) for j in range(len(x)) if j != i and d[j] <= radius)[:k]
        out |= {(i, r + 1, j, round(float(d), 6)) for r, (d, j) in enumerate(near)}
    return out


BROKEN = [(9001, None), (9002, []), (9003, [1.0]), (None, [0.0, 0.0, 0.0]), (9004, [float("nan"), 0.0, 0.0]), (9005, [None, 1.0, 1.0])]


@pytest.mark.parametrize(("k", "radius"), [(5, float("inf")), (3, 0.4), (1, 100.0)])
def test_join_equals_brute_force(spark, small_cells, k, radius):
    x = np.concatenate([clustered(900, 3, 1), np.zeros((60, 3)), np.round(np.random.default_rng(2).integers(0, 3, (90, 3)).astype(float), 1)])
    got = nearest_join(frame(spark, x, BROKEN), "vec_id", "v", k, radius).collect()
    assert {(r["id"], r["rank"], r["other"], round(r["d"], 6)) for r in got} == brute(x, k, radius) and len(got) == len(brute(x, k, radius))


def test_few_pairs_are_measured(spark, small_cells):
    x = clustered(2000, 16, 3)
    got = nearest_join(frame(spark, x), "vec_id", "v", 5).collect()
    assert {(r["id"], r["rank"], r["other"], round(r["d"], 6)) for r in got} == brute(x, 5, float("inf"))
    measured = sum({r["id"]: r["measured"] for r in got}.values())
    assert measured < 0.2 * len(x) ** 2


def test_outliers_and_clusters_equal_brute_force(spark, small_cells):
    x = np.concatenate([clustered(700, 3, 5), np.random.default_rng(6).uniform(-30, 30, (60, 3))])
    got = {r["id"]: r["lof"] for r in outlier_factors(frame(spark, x), "vec_id", "v").collect()}
    np.testing.assert_allclose([got[i] for i in range(len(x))], local_outlier_factor(x), rtol=1e-4, atol=1e-5)
    few = frame(spark, x[:3])
    assert {r["lof"] for r in outlier_factors(few, "vec_id", "v").collect()} == {None}
    for radius, least in [(0.35, 4), (0.2, 3), (5.0, 10)]:
        got = {r["id"]: r["cluster"] for r in density_clusters(frame(spark, x), "vec_id", "v", radius, least).collect()}
        want, first = dbscan(x, None, radius, least), {}
        core = (np.linalg.norm(x[:, None] - x[None], axis=2) <= radius).sum(1) >= least
        for i in np.flatnonzero(core):
            first.setdefault(want[i], int(i))
        assert got == {i: first.get(c) for i, c in enumerate(want)}


def test_copies_and_empty_tables(spark, small_cells):
    x = np.concatenate([np.ones((200, 3)), np.zeros((3, 3)), np.full((1, 3), 9.0)])
    got = density_clusters(frame(spark, x, BROKEN), "vec_id", "v", 0.5, 3).collect()
    assert {(r["id"], r["cluster"], r["core"]) for r in got} == {*((i, 0, True) for i in range(200)), *((i, 200, True) for i in range(200, 203)), (203, None, False)}
    none = frame(spark, x[:0])
    assert nearest_join(none, "vec_id", "v", 2).count() == 0 and density_clusters(none, "vec_id", "v", 1.0, 2).count() == 0


def test_components(spark):
    r = np.random.default_rng(7)
    edges = [(int(a), int(a) + 1) for a in range(300) if a % 50 != 49] + [(int(a), int(b)) for a, b in r.integers(1000, 1200, (90, 2))] + [(5, 5)]
    parent = {}

    def find(a):
        while parent.setdefault(a, a) != a:
            a = parent[a]
        return a

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    want = {n: find(n) for n in {n for a, b in edges if a != b for n in (a, b)}}
    assert dict(components(spark.createDataFrame(edges, "a long, b long")).collect()) == want


def test_tree_cuts_evenly():
    x = np.random.default_rng(8).random((6400, 4))
    size = np.bincount(Tree(x[:2048], 64).locate(x))
    assert len(size) == 64 and size.max() < 250
    assert Tree(np.ones((50, 3)), 8).leaves == 1


def test_distances_are_also_given_unrounded(spark):
    x = [(0, [0.0, 0.0]), (1, [0.07935049999999, 0.0])]  # nine digits would round up to 0.0793505, six then to 0.079351
    got = nearest_join(spark.createDataFrame(x, "vec_id long, v array<double>"), "vec_id", "v", 1).collect()
    assert [(r["id"], r["other"], r["d"], r["raw"]) for r in got] and {r["raw"] for r in got} == {0.07935049999999} and {r["d"] for r in got} == {0.0793505}


@pytest.mark.parametrize("blocks", [4])
def test_blocks_give_what_cells_give(spark, monkeypatch, blocks):
    r = np.random.default_rng(8)
    v = np.concatenate([r.standard_normal((150, 12)), r.standard_normal((60, 12)) * 0.2 + 3, np.ones((9, 12)), np.arange(24, dtype=float).reshape(2, 12) * 100])
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, v array<double>").repartition(3)
    near = lambda: sorted(tuple(x) for x in nearest_join(df, "vec_id", "v", 5, 4.5).drop("measured").select("id", "rank", "other", "d", F.round("raw", 10)).collect())
    clusters = lambda: {x["id"]: (x["cluster"], x["core"]) for x in density_clusters(df, "vec_id", "v", 2.9, 4).collect()}
    monkeypatch.setattr(kd_join, "CELL", 16)
    monkeypatch.setattr(kd_join, "_blocks_for_all", lambda *_: 0)
    want = near(), clusters()
    monkeypatch.setattr(kd_join, "_blocks_for_all", lambda *_: blocks)
    assert (near(), clusters()) == want and len({c for c, _ in want[1].values()}) > 2


def test_many_independent_components_are_measured_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(kd_join, "CELL", 16)
    monkeypatch.setattr(kd_join, "BLOCKS", 4)
    used, blocks_for = [], kd_join._blocks_for_all
    monkeypatch.setattr(kd_join, "_blocks_for_all", lambda *a: used.append(blocks_for(*a)) or used[-1])
    x = np.random.default_rng(9).standard_normal((300, 32))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, v array<double>")
    assert density_clusters(df, "vec_id", "v", 6.0, 4).count() == 300 and used == [1]
    flat = df.select("vec_id", F.slice("v", 1, 2).alias("v"))
    assert density_clusters(flat, "vec_id", "v", 0.01, 4).count() == 300 and used == [1, 0]
