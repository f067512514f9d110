import json

import numpy as np
from pyspark.sql import functions as F

from atomweave.operators import grouped as G

SQUARE = np.array([[0, 0], [2, 0], [2, 2], [0, 2], [1, 1]], float)


def test_median_hull_and_clusters():
    assert np.allclose(G.geometric_median(SQUARE), [1, 1], atol=1e-4)
    assert G.convex_hull(SQUARE) == [[0, 0], [2, 0], [2, 2], [0, 2], [0, 0]]
    assert G.convex_hull(SQUARE[:2]) is None
    assert G.online_kmeans(np.array([[0.0], [10.0], [1.0], [11.0]]), k=2) == [[0.5], [10.5]]
    assert G.dbscan(np.array([[0.0], [0.1], [0.2], [5.0]]), eps=0.3, least=3) == [0, 0, 0, -2]


def test_outliers_and_changes():
    v = np.array([[0.0], [0.1], [0.2], [0.3], [0.4], [0.5], [9.0]])
    lof = G.local_outlier_factor(v, k=3)
    assert int(np.argmax(lof)) == 6 and G.local_outlier_factor(v[:3], k=3) is None
    m = G.mahalanobis(v)
    assert int(np.argmax(m)) == 6
    steps = np.array([[1.0]] * 20 + [[9.0]] * 20)
    assert G.change_points(steps, np.arange(40))[0][1] >= 20 and G.change_points(steps[:9], np.arange(9)) is None


def test_sequences_and_factors():
    a = np.array([[0.0], [1.0], [2.0], [0.0], [1.0], [2.0]])
    assert G.dtw(a) == 0.0
    assert G.self_consistency(np.eye(3)[[0, 0, 1]], np.arange(3))["size"] == 2
    assert G.diverse(np.eye(3), np.array([7, 8, 9]), top=2) == [7, 8]
    low = np.outer(np.arange(1, 5), np.arange(1, 4)) / 4
    assert G.matrix_factorization(low, rounds=2000)["rmse"] < 0.1
    p = G.principal_components(low)
    assert p["ratio"][0] > 0.99 and G.explained_variance(low, rank=1)["kept"] > 0.99
    assert len(G.tsne(np.random.default_rng(0).standard_normal((12, 3)))) == 12
    assert len(G.attention(np.ones((3, 8)))) == 8 and len(G.random_projection(np.ones((2, 5)))[0]) == 8


def test_groups_skip_odd_rows(spark):
    df = spark.createDataFrame([(1, 1, [1.0, 2.0]), (1, 2, None), (1, 3, [1.0]), (2, 1, None)], "label int, vec_id int, embedding array<double>")
    got = G.per_group(df, "label", "vec_id", "embedding", lambda v, o: o.tolist()).collect()
    assert [(r["label"], r["result"]) for r in got] == [(1, "[1]")]


def plain_tsne(v, rounds, dims=2, seed=42):
    n = len(v)
    goal = np.log(min(30.0, n / 3))
    d = ((v[:, None] - v[None]) ** 2).sum(2)
    p = np.zeros((n, n))
    for i in range(n):
        lo, hi, b = 0.0, np.inf, 1.0
        for _ in range(50):
            e = np.exp(-(d[i] - np.min(np.delete(d[i], i))) * b)
            e[i] = 0
            q = e / e.sum()
            h = -(q[q > 0] * np.log(q[q > 0])).sum()
            if abs(h - goal) < 1e-5:
                break
            lo, hi = (b, hi) if h > goal else (lo, b)
            b = b * 2 if hi == np.inf else (lo + hi) / 2
        p[i] = q
    p = np.maximum((p + p.T) / (2 * n), 1e-12)
    y, step = np.random.default_rng(seed).standard_normal((n, dims)) * 1e-4, np.zeros((n, dims))
    for t in range(rounds):
        w = 1 / (1 + ((y[:, None] - y[None]) ** 2).sum(2))
        np.fill_diagonal(w, 0)
        g = (p * (4 if t < 100 else 1) - w / w.sum()) * w
        step = 0.8 * step - 20 * 4 * (g.sum(1)[:, None] * y - g @ y)
        y = y + step
        y = y - y.mean(0)
    return y


def test_tsne_by_strips_takes_groups_of_any_size(spark, monkeypatch):
    v = np.random.default_rng(3).standard_normal((45, 5))  # few rounds: with more, rounding turns the picture
    want = plain_tsne(v, 20)
    whole = G.tsne(v)
    for strip, kept in ((1 << 17, 1 << 26), (200, 1 << 26), (200, 0)):
        monkeypatch.setattr(G, "STRIP", strip)
        monkeypatch.setattr(G, "KEPT", kept)
        assert np.allclose(G.tsne(v, rounds=20), want, atol=1e-5)
    monkeypatch.setattr(G, "MOST", 10)
    monkeypatch.setattr(G, "MOST_SQUARE", 10)
    df = spark.createDataFrame([(1, i, x.tolist()) for i, x in enumerate(v)], "label int, vec_id int, embedding array<double>")
    (got,) = G.per_group(df, "label", "vec_id", "embedding", G.tsne).collect()
    assert len(json.loads(got["result"])) == len(whole) == 45


def test_tsne_keeps_as_many_likenesses_as_fit(monkeypatch):
    v = np.random.default_rng(4).standard_normal((50, 4))
    v[7] = [60, 0, 0, 0]  # far from all
    want = plain_tsne(v, 20)
    for kept in (0, 300, G.KEPT):
        monkeypatch.setattr(G, "STRIP", 200)
        monkeypatch.setattr(G, "KEPT", kept)
        assert np.allclose(G.tsne(v, rounds=20), want, atol=1e-5)


def test_labels_of_any_size_have_a_task_each(spark):
    """Ten labels hashed into twelve partitions are in five of them, four in one."""
    df = spark.createDataFrame([(g, i, [float(i), float(g)]) for g in range(10) for i in range(5)], "label int, vec_id int, embedding array<double>")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    try:
        got = G.per_group(df, "label", "vec_id", "embedding", G.tsne).select("label", F.spark_partition_id().alias("p")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(got) == 10 and len({r["p"] for r in got}) == 10
