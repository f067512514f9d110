"""Moments, decompositions and distances over groups against numpy on whole groups; and radius pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from atomweave.operators import grouped as G
from atomweave.operators import kd_join, moments as M
from atomweave.plans.grouped import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def groups(spark):
    r = np.random.default_rng(3)
    mix = r.standard_normal((5, 5))
    x = {g: 1e4 * g + r.standard_normal((80 + g, 5)) @ mix for g in (0, 1, 2)}
    rows = [(g, 1000 * g + i, v.tolist()) for g, m in x.items() for i, v in enumerate(m)]
    rows += [(1, 9001, None), (1, 9002, [1.0]), (1, 9003, [float("nan")] * 5), (None, 9004, [1.0, 2.0]), (7, 9005, [3.0, 4.0])]
    return spark.createDataFrame(rows, "g int, id long, v array<double>").repartition(5), x


@pytest.mark.parametrize("broadcast", [True, False])
def test_distances_and_codes_equal_numpy(groups, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(M, "BROADCAST_BYTES", 0)
    df, x = groups
    got = {r["id"]: r["distance"] for r in M.mahalanobis(df, "g", "id", "v").where("g IS NOT NULL").collect()}
    for g, m in x.items():
        np.testing.assert_allclose([got[1000 * g + i] for i in range(len(m))], G.mahalanobis(m), atol=2e-4)
    assert not {9001, 9002, 9003} & got.keys() and got[9005] == 0.0
    codes = {r["id"]: (r["code"], r["error"]) for r in M.linear_codes(df, "g", "id", "v", 2).collect()}
    for g, m in x.items():
        c = m - m.mean(0)
        _, _, vt = np.linalg.svd(c, full_matrices=False)
        np.testing.assert_allclose([codes[1000 * g + i][1] for i in range(len(m))], np.linalg.norm(c - c @ vt[:2].T @ vt[:2], axis=1), atol=1e-5)
    back = {r["id"]: (r["rebuilt"], r["left"]) for r in M.svd_reconstruct(df.where("g = 0"), "g", "id", "v", 3).collect()}
    u, s, vt = np.linalg.svd(x[0], full_matrices=False)
    np.testing.assert_allclose([back[i][0] for i in range(len(x[0]))], (u[:, :3] * s[:3]) @ vt[:3], atol=1e-6)
    np.testing.assert_allclose(np.abs([back[i][1] for i in range(len(x[0]))]), np.abs(u[:, :3]), atol=1e-6)


def test_components_equal_numpy(groups):
    df, x = groups
    rows = M.principal_components(df, "g", "id", "v").collect()
    for g, m in x.items():
        mine, want = sorted((r for r in rows if r["g"] == g), key=lambda r: r["rank"]), G.principal_components(m)
        np.testing.assert_allclose([r["variance"] for r in mine], want["variance"], rtol=1e-6)
        np.testing.assert_allclose([r["ratio"] for r in mine], want["ratio"], rtol=1e-5)
        np.testing.assert_allclose([r["component"] for r in mine], want["components"], atol=1e-5)
    kept = {r["rank"]: r["kept"] for r in M.svd(df.where("g = 0"), "g", "id", "v", 5).collect()}
    assert abs(kept[2] - G.explained_variance(x[0], rank=2)["kept"]) < 1e-6 and abs(kept[5] - 1) < 1e-9
    other = M.mahalanobis(df.where("g = 0"), "g", "id", "v", reference=[0.0] * 5).count()
    assert other == len(x[0])
    assert M.principal_components(df.limit(0), "g", "id", "v").count() == 0


@pytest.mark.parametrize("name", ["group_mahalanobis", "group_principal_components", "group_explained_variance", "group_autoencoder", "group_random_projection"])
def test_registered_queries_equal_whole_table_numpy(spark, name):
    e = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    by = {}
    for r in sorted(e, key=lambda r: r["vec_id"]):
        by.setdefault(r["label"], []).append((r["vec_id"], np.array(r["embedding"], float)))
    got = QUERIES[name](spark, SF).collect()
    if name == "group_random_projection":
        want = {i: p for g in by.values() for i, p in zip([i for i, _ in g], G.random_projection(np.array([v for _, v in g])))}
        assert len(got) == len(e) and all(np.allclose(r["projected"], want[r["vec_id"]], atol=2e-6) for r in got)
        return
    for label, rows in by.items():
        v, mine = np.array([x for _, x in rows]), [r for r in got if r["label"] == label]
        if name == "group_mahalanobis":
            d = {r["vec_id"]: r["distance"] for r in mine}
            np.testing.assert_allclose([d[i] for i, _ in rows], G.mahalanobis(v), rtol=1e-3, atol=1e-3)
        elif name == "group_principal_components":
            np.testing.assert_allclose([r["variance"] for r in sorted(mine, key=lambda r: r["rank"])], G.principal_components(v)["variance"], atol=2e-6)
        elif name == "group_explained_variance":
            assert abs(max(r["kept"] for r in mine) - G.explained_variance(v)["kept"]) < 2e-6
        else:
            c = v - v.mean(0)
            _, _, vt = np.linalg.svd(c, full_matrices=False)
            lost = {r["vec_id"]: r["error"] for r in mine}
            np.testing.assert_allclose([lost[i] for i, _ in rows], np.linalg.norm(c - c @ vt[:4].T @ vt[:4], axis=1), atol=1e-4)


def test_radius_pairs_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(kd_join, "CELL", 30)
    r = np.random.default_rng(5)
    x = np.concatenate([np.round(r.uniform(0, 4, (300, 3)), 2), np.ones((6, 3))])
    rows = [(i, int(i % 2), v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "id long, g int, v array<double>")
    got = kd_join.radius_pairs(df, "id", "v", 0.5).collect()
    want = {(i, j) for i in range(len(x)) for j in range(i + 1, len(x)) if np.sqrt(((x[i] - x[j]) ** 2).sum()) <= 0.5}
    assert {(p["a"], p["b"]) for p in got} == want and len(got) == len(want)
    got = kd_join.radius_pairs(df.select("id", kd_join.in_group("g", "v").alias("v")), "id", "v", 0.5).collect()
    assert {(p["a"], p["b"]) for p in got} == {(i, j) for i, j in want if i % 2 == j % 2}
    assert kd_join.radius_pairs(df.where(F.lit(False)), "id", "v", 1.0).count() == 0
