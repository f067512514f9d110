"""Linear algebra over whole groups from their moments: covariance, Mahalanobis distances, principal components, SVD, linear codes.

A group's count, sum and sum of outer products are added up by each task over its own rows, and a row a task and group is shuffled; so a group of any size costs no task more than its
share, and what is left of it is a matrix of its dimensions. Decompositions are of that matrix. Rows meet their group's model by a broadcast while all models together stay under
``BROADCAST_BYTES``, else by a salted join. Sums are taken about a first vector of the group's task, and combined by shifting, so large means lose no digits.

Vectors that are null, hold null or non-finite components or have another length than most of their group take no part. Signs: the largest component of a direction is positive.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atomweave.operators.work import written

BROADCAST_BYTES = 64 << 20
SALTS = 16


def _rows(frame: DataFrame, group: str, key: str, vector: str) -> DataFrame:
    """(g, id, v) of vectors of the group's usual length."""
    v = frame.select(F.col(group).alias("g"), F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where("v IS NOT NULL AND size(v) > 0")
    v = v.where(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    sizes = v.groupBy("g", F.size("v").alias("d")).agg(F.count("*").alias("n")).groupBy("g").agg(F.max_by("d", F.struct("n", -F.col("d"))).alias("d"))
    usual = sizes.select(F.col("g").alias("_g"), "d")
    return v.join(F.broadcast(usual), F.col("g").eqNullSafe(F.col("_g")) & (F.size("v") == F.col("d"))).select("g", "id", "v")  # a number a group


def moments(rows: DataFrame) -> DataFrame:
    """(g, n, mean, scatter): scatter is the flattened matrix of centred outer products, summed."""
    kind = dict(rows.dtypes)["g"]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for b in batches:
            g = b.column(0).to_pylist()
            at: dict = {}
            for i, x in enumerate(g):
                at.setdefault(x, []).append(i)
            for x, rows_ in at.items():
                m = _matrix(b.column(1).take(pa.array(rows_)))
                held[x] = _joined(held.get(x), (len(m), m.mean(0), (m - m.mean(0)).T @ (m - m.mean(0))))
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([*held], b.column(0).type), pa.array([h[0] for h in held.values()], pa.int64()), _lists([h[1] for h in held.values()]), _lists([h[2].ravel() for h in held.values()])], ["g", "n", "mean", "scatter"])

    def join(key, table):
        whole = None
        for n, mean, scatter in zip(*(table[c].to_pylist() for c in ("n", "mean", "scatter"))):  # a row a task
            whole = _joined(whole, (n, np.array(mean), np.array(scatter).reshape(len(mean), -1)))
        return pa.table({"g": table["g"][:1], "n": pa.array([whole[0]], pa.int64()), "mean": _lists([whole[1]]), "scatter": _lists([whole[2].ravel()])})

    out = f"g {kind}, n long, mean array<double>, scatter array<double>"
    return rows.select("g", "v").mapInArrow(add, out).groupBy("g").applyInArrow(join, out)


def _matrix(column) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _lists(rows: list[np.ndarray]) -> pa.Array:
    return pa.array([r.tolist() for r in rows], pa.list_(pa.float64()))


def _joined(a, b):
    if a is None:
        return b
    n, shift = a[0] + b[0], b[1] - a[1]
    return n, a[1] + shift * (b[0] / n), a[2] + b[2] + np.outer(shift, shift) * (a[0] * b[0] / n)


def _applied(rows: DataFrame, models: DataFrame, f: Callable[[np.ndarray, int, np.ndarray, np.ndarray], list], out: str) -> DataFrame:
    """(g, id, out ...) of f(vectors, n, mean, scatter) for the rows of each group; f gives a list of columns."""
    kind = dict(rows.dtypes)["g"]
    models = written(models, "moments")
    size = models.agg(F.sum(8 * (F.size("mean") + F.size("scatter")))).first()[0] or 0
    schema = f"g {kind}, id long, {out}"
    if size <= BROADCAST_BYTES:
        held = rows.sparkSession.sparkContext.broadcast({r["g"]: (r["n"], np.array(r["mean"]), np.array(r["scatter"]).reshape(len(r["mean"]), -1)) for r in models.collect()})

        def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                g = b.column(0).to_pylist()
                for x in {*g}:
                    at = pa.array([i for i, y in enumerate(g) if y == x])
                    cols = f(_matrix(b.column(2).take(at)), *held.value[x])
                    yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), *cols], names)

        names = [c.split()[0] for c in schema.split(", ")]
        return rows.select("g", "id", "v").mapInArrow(near, schema)
    salt = lambda c: F.pmod(F.xxhash64(c), F.lit(SALTS)).cast("int").alias("salt")
    both = rows.select("g", "id", "v", salt("id")).groupBy("g", "salt").cogroup(models.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).groupBy("g", "salt"))

    def far(key, some, model):
        names = [c.split()[0] for c in schema.split(", ")]
        if not some.num_rows or not model.num_rows:
            return pa.table({n: pa.array([], t) for n, t in zip(names, [some.schema.field("g").type, pa.int64(), *_types(out)])})
        mean = np.array(model["mean"][0].as_py())
        cols = f(_matrix(some["v"].combine_chunks()), model["n"][0].as_py(), mean, np.array(model["scatter"][0].as_py()).reshape(len(mean), -1))
        return pa.table(dict(zip(names, [some["g"], some["id"], *cols])))

    return both.applyInArrow(far, schema)


def _types(out: str) -> list[pa.DataType]:
    kinds = {"double": pa.float64(), "array<double>": pa.list_(pa.float64())}
    return [kinds[c.split()[1]] for c in out.split(", ")]


def _eigen(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues and their directions, as rows."""
    values, vectors = np.linalg.eigh(matrix)
    values, vectors = np.maximum(values[::-1][:k], 0), vectors.T[::-1][:k]
    sign = np.sign(vectors[np.arange(len(vectors)), np.abs(vectors).argmax(1)])
    return values, vectors * np.where(sign == 0, 1, sign)[:, None]


def _gram(n: int, mean: np.ndarray, scatter: np.ndarray) -> np.ndarray:
    return scatter + n * np.outer(mean, mean)


def mahalanobis(frame: DataFrame, group: str, key: str, vector: str, ridge: float = 1e-6, reference: list[float] | None = None) -> DataFrame:
    """(g, id, distance) from the group's mean, or from a reference vector, under the group's covariance."""
    rows = written(_rows(frame, group, key, vector), "vectors")

    def f(v, n, mean, scatter):
        c = v - (mean if reference is None else np.asarray(reference, float))
        x = np.linalg.solve(scatter / n + ridge * np.eye(len(mean)), c.T).T
        return [pa.array(np.sqrt(np.maximum((c * x).sum(1), 0)))]

    return _applied(rows, moments(rows), f, "distance double")


def _by_group(models: DataFrame, f: Callable, out: str) -> DataFrame:
    """Rows of f(n, mean, scatter) for each group."""
    kind = dict(models.dtypes)["g"]
    names = [c.split()[0] for c in out.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(len(b)):
                mean = np.array(b.column(2)[i].as_py())
                cols = f(b.column(1)[i].as_py(), mean, np.array(b.column(3)[i].as_py()).reshape(len(mean), -1))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array([i] * len(cols[0]))), *cols], ["g", *names])

    return models.mapInArrow(run, f"g {kind}, {out}")


def principal_components(frame: DataFrame, group: str, key: str, vector: str, k: int = 3) -> DataFrame:
    """(g, rank, variance, ratio, component): ratio is of the variance of these components."""

    def f(n, mean, scatter):
        values, vectors = _eigen(scatter / n, k)
        whole = values.sum()
        return [pa.array(np.arange(1, len(values) + 1)), pa.array(values), pa.array(values / whole if whole else values), _lists([*vectors])]

    return _by_group(moments(_rows(frame, group, key, vector)), f, "rank long, variance double, ratio double, component array<double>")


def svd(frame: DataFrame, group: str, key: str, vector: str, k: int = 8) -> DataFrame:
    """(g, rank, singular, kept, direction): right singular vectors; kept is the share of all squares up to this rank."""

    def f(n, mean, scatter):
        gram = _gram(n, mean, scatter)
        values, vectors = _eigen(gram, min(k, n))
        whole = np.trace(gram)
        return [pa.array(np.arange(1, len(values) + 1)), pa.array(np.sqrt(values)), pa.array(np.cumsum(values) / whole if whole else values), _lists([*vectors])]

    return _by_group(moments(_rows(frame, group, key, vector)), f, "rank long, singular double, kept double, direction array<double>")


def svd_reconstruct(frame: DataFrame, group: str, key: str, vector: str, k: int = 8) -> DataFrame:
    """(g, id, left, rebuilt, error): a row's left singular coordinates, its rebuilt vector of rank k and how far that is from it."""
    rows = written(_rows(frame, group, key, vector), "vectors")

    def f(v, n, mean, scatter):
        values, vectors = _eigen(_gram(n, mean, scatter), min(k, n))
        code = v @ vectors.T
        with np.errstate(divide="ignore", invalid="ignore"):
            left = np.where(values > 1e-12 * max(values.max(initial=0), 1e-300), code / np.sqrt(values), 0.0)
        back = code @ vectors
        return [_lists([*left]), _lists([*back]), pa.array(np.linalg.norm(v - back, axis=1))]

    return _applied(rows, moments(rows), f, "left array<double>, rebuilt array<double>, error double")


def linear_codes(frame: DataFrame, group: str, key: str, vector: str, k: int = 4) -> DataFrame:
    """(g, id, code, error): a linear autoencoder with k hidden units at its optimum, the k principal components; error is what decoding loses."""
    rows = written(_rows(frame, group, key, vector), "vectors")

    def f(v, n, mean, scatter):
        _, vectors = _eigen(scatter / n, k)
        code = (v - mean) @ vectors.T
        return [_lists([*code]), pa.array(np.linalg.norm(v - mean - code @ vectors, axis=1))]

    return _applied(rows, moments(rows), f, "code array<double>, error double")


def random_projection(frame: DataFrame, key: str, vector: str, dims: int = 8, seed: int = 42) -> DataFrame:
    """(id, projected): each vector alone, on seeded unit directions for its length; null vectors have null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list = [None] * len(b)
            sizes = np.array([len(x) if x.is_valid else 0 for x in b.column(1)])
            for d in np.unique(sizes[sizes > 0]).tolist():
                at = np.flatnonzero(sizes == d)
                x = np.array(b.column(1).take(pa.array(at)).to_pylist(), float)
                m = np.random.default_rng(seed).standard_normal((d, dims))
                for i, row in zip(at.tolist(), (x @ (m / np.linalg.norm(m, axis=0))).tolist()):
                    out[i] = row
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.float64()))], ["id", "projected"])

    return frame.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).mapInArrow(run, "id long, projected array<double>")
