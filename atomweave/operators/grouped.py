"""Whole-group vector algorithms: one numpy function per group of bounded size, run by ``applyInPandas``.

``per_group`` refuses groups over ``MOST`` rows instead of letting one task swallow them, and over ``MOST_SQUARE`` where an algorithm holds a number for each pair
of rows; larger groups are to be split by the caller. ``tsne`` takes groups of any size, as it goes through the pairs in tiles; one group is one task's, and groups have tasks of their own. Covariances, components, outlier factors and density clusters of groups of any size
are in ``moments`` and ``kd_join``; the functions here are their plain forms. Rows are ordered by an explicit column. Null vectors and vectors of another length than the
group's first are skipped; an empty group gives no row.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST, MOST_SQUARE = 100_000, 4096
#: Numbers of a strip of ``tsne`` (two of its tiles), and likenesses that it keeps (0.8 GB: all of 14,000 rows).
STRIP, KEPT = 1 << 17, 100_000_000
#: Ranges for each group of any size, so that groups don't share one; ranges in all.
RANGES, MOST_RANGES = 4, 1000


def per_group(rows: DataFrame, group: str, order: str, vector: str, f: Callable[[np.ndarray, np.ndarray], list | dict]) -> DataFrame:
    """(group, result: JSON of f(vectors, order values))."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        most = MOST_SQUARE if f in SQUARE else MOST if f not in ANY_SIZE else len(pdf)
        if len(pdf) > most:
            raise ValueError(f"a group has {len(pdf)} rows; split it ({most} at most)")
        pdf = pdf.dropna(subset=["v"]).sort_values("o", kind="stable")
        if not len(pdf):
            return pd.DataFrame({"g": pdf["g"], "result": pd.Series([], dtype=str)})
        pdf = pdf[pdf["v"].map(len) == len(pdf["v"].iloc[0])]
        return pd.DataFrame({"g": [pdf["g"].iloc[0]], "result": [json.dumps(f(np.stack(pdf["v"].to_numpy()).astype(float), pdf["o"].to_numpy()))]})

    kind = dict(rows.dtypes)[group]
    out = rows.select(F.col(group).alias("g"), F.col(order).alias("o"), F.col(vector).cast("array<double>").alias("v"))
    if f in ANY_SIZE:  # much work on few bytes: groups are not to be put together in one task, as hashes of few values would
        groups = out.select("g").distinct().count()
        out = out.repartitionByRange(max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(RANGES * groups, MOST_RANGES)), "g")
    out = out.groupBy("g").applyInPandas(run, f"g {kind}, result string")
    return out.withColumnRenamed("g", group)


def _r(x) -> list:
    return np.round(np.asarray(x, float), 6).tolist()


def _cos(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(a, axis=-1) * np.linalg.norm(b, axis=-1)
    return np.where(n == 0, 0.0, (a * b).sum(-1) / np.where(n == 0, 1, n))


def geometric_median(v: np.ndarray, _=None, rounds: int = 100, tol: float = 1e-7) -> list:
    m = np.median(v, 0)
    for _i in range(rounds):
        d = np.maximum(np.linalg.norm(v - m, axis=1), 1e-12)
        new = (v / d[:, None]).sum(0) / (1 / d).sum()
        if np.linalg.norm(new - m) < tol:
            break
        m = new
    return _r(m)


def convex_hull(v: np.ndarray, _=None) -> list | None:
    """Closed ring of the hull of the first two components, counter-clockwise; None with fewer than three corners."""
    pts = sorted(set(map(tuple, v[:, :2].tolist())))

    def half(points):
        out: list = []
        for p in points:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    ring = half(pts) + half(pts[::-1])
    return _r([*ring, ring[0]]) if len(ring) >= 3 else None


def online_kmeans(v: np.ndarray, _=None, k: int = 4) -> list:
    c, n = v[:k].copy(), np.ones(min(k, len(v)))
    for x in v[k:]:
        i = int(np.argmin(((c - x) ** 2).sum(1)))
        n[i] += 1
        c[i] += (x - c[i]) / n[i]
    return _r(c)


def local_outlier_factor(v: np.ndarray, _=None, k: int = 5) -> list | None:
    n = len(v)
    if n < k + 1:
        return None
    d = np.linalg.norm(v[:, None] - v[None], axis=2)
    np.fill_diagonal(d, np.inf)
    nb = np.argsort(d, 1, kind="stable")[:, :k]
    kd = np.take_along_axis(d, nb, 1)[:, -1]
    reach = np.maximum(kd[nb], np.take_along_axis(d, nb, 1))
    lrd = 1 / (reach.mean(1) + 1e-10)
    return _r(lrd[nb].mean(1) / lrd)


def dbscan(v: np.ndarray, _=None, eps: float = 1.2, least: int = 4) -> list:
    """Cluster numbers in scan order; noise is -2."""
    near = np.linalg.norm(v[:, None] - v[None], axis=2) <= eps
    core, out, c = near.sum(1) >= least, np.full(len(v), -2), 0
    for i in range(len(v)):
        if out[i] != -2 or not core[i]:
            continue
        stack = [i]
        out[i] = c
        while stack:
            j = stack.pop()
            if core[j]:
                for m in np.flatnonzero(near[j] & (out == -2)):
                    out[m] = c
                    stack.append(m)
        c += 1
    return out.tolist()


def mahalanobis(v: np.ndarray, _=None) -> list:
    c = v - v.mean(0)
    s = c.T @ c / len(v) + 1e-6 * np.eye(v.shape[1])
    return _r(np.sqrt(np.maximum(np.einsum("ij,ij->i", c, np.linalg.solve(s, c.T).T), 0)))


def principal_components(v: np.ndarray, _=None, n: int = 3) -> dict:
    c = v - v.mean(0)
    _, s, vt = np.linalg.svd(c, full_matrices=False)
    var = s[:n] ** 2 / len(v)
    vt = vt[:n] * np.sign(vt[:n, np.argmax(np.abs(vt[:n]), 1)].diagonal())[:, None]
    return {"components": _r(vt), "variance": _r(var), "ratio": _r(var / var.sum() if var.sum() else var)}


def _strips(n: int) -> list[slice]:
    """Rows of the upper triangle that are taken at once."""
    step = max(1, STRIP // max(1, n))
    return [slice(i, min(i + step, n)) for i in range(0, n, step)]


def _bandwidths(v: np.ndarray, target: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row the factor of its squared distances at which their entropy is the target, the least distance and the sum, by bisection."""
    n, vv = len(v), (v * v).sum(1)
    factor, least, total = np.ones(n), np.zeros(n), np.ones(n)
    for s in _strips(n):
        d = np.maximum(vv[s, None] + vv[None] - 2 * (v[s] @ v.T), 0)
        own = np.arange(len(d)), np.arange(s.start, s.stop)
        d[own] = np.inf
        least[s] = d.min(1)
        d -= least[s, None]
        left, lo, hi, b = np.arange(len(d)), np.zeros(len(d)), np.full(len(d), np.inf), np.ones(len(d))
        for _k in range(50):
            e = np.exp(-d * b[left, None])
            z = e.sum(1)
            d[own[0][: len(left)], own[1]] = 0  # no infinity times nothing
            h = np.log(z) + b[left] * (e * d).sum(1) / z
            d[own[0][: len(left)], own[1]] = np.inf
            factor[s.start + left], total[s.start + left] = b[left], z
            go = np.abs(h - target) >= 1e-5
            left, d, own, more = left[go], d[go], (own[0], own[1][go]), h[go] > target
            if not len(left):
                break
            lo[left], hi[left] = np.where(more, b[left], lo[left]), np.where(more, hi[left], b[left])
            b[left] = np.where(np.isinf(hi[left]), b[left] * 2, (lo[left] + hi[left]) / 2)
    return factor, least, total


def tsne(v: np.ndarray, _=None, dims: int = 2, seed: int = 42, rounds: int | None = None) -> list:
    """All pairs, a tile of the upper triangle at a time: memory is linear in the rows, but for the likenesses of the first ``KEPT`` pairs; those of others are found anew in each round."""
    n = len(v)
    if n < 4:
        return _r(v[:, :dims])
    perplexity, rounds = min(30.0, n / 3), rounds or min(1000, 10 * n)
    factor, least, total = _bandwidths(v, np.log(perplexity))
    vv, side = (v * v).sum(1), max(1, math.isqrt(STRIP // 2))
    cuts = [slice(i, min(n, i + side)) for i in range(0, n, side)]
    tiles = [(s, t) for i, s in enumerate(cuts) for t in cuts[i:]]

    def likeness(s: slice, t: slice) -> np.ndarray:
        d = np.maximum(vv[s, None] + vv[None, t] - 2 * (v[s] @ v[t].T), 0)
        if s == t:
            np.fill_diagonal(d, np.inf)  # no pair
        p = np.exp(-(d - least[s, None]) * factor[s, None]) / total[s, None] + np.exp(-(d - least[None, t]) * factor[None, t]) / total[None, t]
        return np.maximum(p / (2 * n), 1e-12)

    kept, room = [], KEPT
    for s, t in tiles:
        room -= (s.stop - s.start) * (t.stop - t.start)
        if room < 0:
            break
        kept.append(likeness(s, t))
    y, step = np.random.default_rng(seed).standard_normal((n, dims)) * 1e-4, np.zeros((n, dims))
    one, space = np.ones(n), np.empty((2, side * side))
    for r in range(rounds):
        near, far, z = np.zeros((dims + 1, n)), np.zeros((dims + 1, n)), 0.0  # sums of weights times (y, 1)
        yy = (y * y).sum(1)[:, None]
        left, right = np.hstack([-2 * y, yy + 1, one[:, None]]), np.hstack([y, one[:, None], yy]).T.copy()
        with_one, large = [*y.T.copy(), one], yy.max() > 1e6  # up to there rounding takes next to nothing from 1
        for k, (s, t) in enumerate(tiles):
            shape = s.stop - s.start, t.stop - t.start
            w, x = (b[: shape[0] * shape[1]].reshape(shape) for b in space)
            np.matmul(left[s], right[:, t], out=w)
            if large:
                np.maximum(w, 1, out=w)
            np.reciprocal(w, out=w)
            if s == t:
                w *= np.tri(len(w), k=-1).T  # each pair once
            z += 2 * (w @ one[t]).sum()
            np.multiply(kept[k] if k < len(kept) else likeness(s, t), w, out=x)
            np.square(w, out=w)
            for out, a in ((near, x), (far, w)):
                for i, c in enumerate(with_one):  # a matrix times a vector each: several times as fast as times three columns
                    out[i, s] += a @ c[t]
                    out[i, t] += c[s] @ a
        pull = (near * (4 if r < 100 else 1) - far / z).T
        step = 0.8 * step - 20 * 4 * (pull[:, dims:] * y - pull[:, :dims])
        y = y + step
        y = y - y.mean(0)
    return _r(y)


def random_projection(v: np.ndarray, _=None, dims: int = 8, seed: int = 42) -> list:
    m = np.random.default_rng(seed).standard_normal((v.shape[1], dims))
    return _r(v @ (m / np.linalg.norm(m, axis=0)))


def attention(v: np.ndarray, _=None, heads: int = 4) -> list:
    """Self-attention with queries, keys and values alike, averaged over the queries."""
    parts = np.split(v[:, : v.shape[1] // heads * heads], heads, axis=1)
    out = []
    for h in parts:
        s = h @ h.T / np.sqrt(h.shape[1])
        w = np.exp(s - s.max(1, keepdims=True))
        out.append((w / w.sum(1, keepdims=True) @ h).mean(0))
    return _r(np.concatenate(out))


def autoencoder(v: np.ndarray, _=None, dims: int = 4) -> list:
    _, _, vt = np.linalg.svd(v - v.mean(0), full_matrices=False)
    return _r((v @ vt[:dims].T).mean(0))


def explained_variance(v: np.ndarray, _=None, rank: int = 8) -> dict:
    s = np.linalg.svd(v, compute_uv=False)
    return {"kept": round(float((s[:rank] ** 2).sum() / (s**2).sum()), 6), "rank": int(min(rank, *v.shape))}


def self_consistency(v: np.ndarray, o: np.ndarray, least: float = 0.2) -> dict:
    """Greedy clusters around first members; confidence falls with the place in the order."""
    clusters: list[list[int]] = []
    for i in range(len(v)):
        for c in clusters:
            if _cos(v[c[0]], v[i]) > least:
                c.append(i)
                break
        else:
            clusters.append([i])
    weight = 1 / (1 + np.arange(len(v)))
    best = max(clusters, key=lambda c: weight[c].sum())
    return {"clusters": len(clusters), "size": len(best), "answer": _r((v[best] * weight[best, None]).sum(0) / weight[best].sum())}


def diverse(v: np.ndarray, o: np.ndarray, top: int = 5, balance: float = 0.7) -> list:
    """Maximal marginal relevance; relevance is the cosine to the mean."""
    rel, left, out = _cos(v, v.mean(0)[None]), list(range(len(v))), []
    while left and len(out) < top:
        s = [balance * rel[i] - (1 - balance) * max((float(_cos(v[i], v[j])) for j in out), default=0.0) for i in left]
        out.append(left.pop(int(np.argmax(s))))
    return [int(o[i]) for i in out]


def dtw(v: np.ndarray, _=None) -> float:
    """Distance of the group's first half to its second."""
    a, b = v[: len(v) // 2], v[len(v) // 2 :]
    d = np.full((len(a) + 1, len(b) + 1), np.inf)
    d[0, 0] = 0
    cost = np.linalg.norm(a[:, None] - b[None], axis=2)
    for i in range(len(a)):
        for j in range(len(b)):
            d[i + 1, j + 1] = cost[i, j] + min(d[i, j + 1], d[i + 1, j], d[i, j])
    return round(float(d[-1, -1]), 6)


def change_points(v: np.ndarray, o: np.ndarray, threshold: float = 3.0) -> list | None:
    """One-sided CUSUM on z-scored norms, from 0 again after an alarm; the five largest."""
    if len(v) < 10:
        return None
    z = np.linalg.norm(v, axis=1)
    z = (z - z.mean()) / (z.std() or 1.0)
    s, out = 0.0, []
    for i, x in enumerate(z):
        s = max(0.0, s + x - 0.5)
        if s > threshold:
            out.append((round(s, 6), int(o[i])))
            s = 0.0
    return sorted(out, reverse=True)[:5]


def matrix_factorization(v: np.ndarray, _=None, k: int = 4, rounds: int = 100, rate: float = 0.05, seed: int = 42) -> dict:
    """Alternating gradient steps on the group's matrix."""
    r = np.random.default_rng(seed)
    a, b = r.standard_normal((len(v), k)) * 0.1, r.standard_normal((v.shape[1], k)) * 0.1
    for _i in range(rounds):
        e = v - a @ b.T
        a, b = a + rate * (e @ b - 0.01 * a), b + rate * (e.T @ a - 0.01 * b)
    return {"rmse": round(float(np.sqrt(((v - a @ b.T) ** 2).mean())), 6)}


ALGORITHMS = {f.__name__: f for f in (geometric_median, convex_hull, online_kmeans, local_outlier_factor, dbscan, mahalanobis, principal_components, tsne, random_projection, attention, autoencoder, explained_variance, self_consistency, diverse, dtw, change_points, matrix_factorization)}
#: These hold a number for each pair of rows.
SQUARE = (local_outlier_factor, dbscan, attention, dtw)
#: Memory is linear in the rows.
ANY_SIZE = (tsne,)
