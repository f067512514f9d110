"""Vector Column builders over ARRAY<FLOAT|DOUBLE>; accumulation is in double, in index order.

Null rule: a null operand gives null. A zero norm gives cosine 0.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def _fold(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return _fold(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(_fold(F.transform(as_double(a), lambda x: x * x)))


def cosine(a: Column, b: Column) -> Column:
    n = norm(a) * norm(b)
    return F.when(n == 0, F.lit(0.0)).otherwise(dot(a, b) / n)


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(_fold(F.zip_with(as_double(a), as_double(b), lambda x, y: (x - y) * (x - y))))


def manhattan(a: Column, b: Column) -> Column:
    return _fold(F.zip_with(as_double(a), as_double(b), lambda x, y: F.abs(x - y)))


def chebyshev(a: Column, b: Column) -> Column:
    return F.array_max(F.zip_with(as_double(a), as_double(b), lambda x, y: F.abs(x - y)))


def minkowski(a: Column, b: Column, p: float = 3.0) -> Column:
    return F.pow(_fold(F.zip_with(as_double(a), as_double(b), lambda x, y: F.pow(F.abs(x - y), F.lit(p)))), F.lit(1.0 / p))


def hamming(a: Column, b: Column, tolerance: float = 1e-6) -> Column:
    return _fold(F.zip_with(as_double(a), as_double(b), lambda x, y: F.when(F.abs(x - y) > tolerance, 1.0).otherwise(0.0)))


def canberra(a: Column, b: Column) -> Column:
    def term(x, y):
        d = F.abs(x) + F.abs(y)
        return F.when(d == 0, 0.0).otherwise(F.abs(x - y) / d)

    return _fold(F.zip_with(as_double(a), as_double(b), term))


METRICS = {"euclidean": euclidean, "manhattan": manhattan, "chebyshev": chebyshev, "minkowski": minkowski, "hamming": hamming, "canberra": canberra, "l2": euclidean, "l1": manhattan, "linf": chebyshev}


def distance(metric: str, a: Column, b: Column) -> Column:
    """Distance by name; cosine is 1 - similarity, dot its negative."""
    if metric == "cosine":
        return 1 - cosine(a, b)
    if metric == "dot":
        return -dot(a, b)
    return METRICS[metric](a, b)


def similarity(metric: str, a: Column, b: Column) -> Column:
    """1 / (1 + distance), but for cosine itself and Hamming's share of equal components."""
    if metric == "cosine":
        return cosine(a, b)
    if metric == "hamming":
        return 1 - hamming(a, b) / F.size(a)
    return 1 / (1 + distance(metric, a, b))


def add(a: Column, b: Column) -> Column:
    return F.zip_with(as_double(a), as_double(b), lambda x, y: x + y)


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(as_double(a), as_double(b), lambda x, y: x - y)


def scale(a: Column, k: Column | float) -> Column:
    return F.transform(as_double(a), lambda x: x * k)


def lerp(a: Column, b: Column, t: Column | float) -> Column:
    return F.zip_with(as_double(a), as_double(b), lambda x, y: x * (1 - t) + y * t)


def normalize(a: Column) -> Column:
    """Unit length; a zero vector stays as it is."""
    n = norm(a)
    return F.transform(as_double(a), lambda x: F.when(n == 0, x).otherwise(x / n))


def softmax(a: Column, temperature: float = 1.0) -> Column:
    e = F.transform(as_double(a), lambda x: F.exp((x - F.array_max(as_double(a))) / temperature))
    return F.transform(e, lambda x: x / _fold(e))


def argmax(a: Column) -> Column:
    """0-based place of the first maximum."""
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def mean(a: Column) -> Column:
    return _fold(as_double(a)) / F.size(a)


ACTIVATIONS = {
    "relu": lambda x: F.greatest(x, F.lit(0.0)),
    "sigmoid": lambda x: 1 / (1 + F.exp(-x)),
    "tanh": F.tanh,
    "gelu": lambda x: 0.5 * x * (1 + F.tanh(0.7978845608028654 * (x + 0.044715 * x * x * x))),
    "swish": lambda x: x / (1 + F.exp(-x)),
    "mish": lambda x: x * F.tanh(F.log1p(F.exp(x))),
    "leaky_relu": lambda x: F.when(x > 0, x).otherwise(0.01 * x),
    "elu": lambda x: F.when(x > 0, x).otherwise(F.exp(x) - 1),
    "selu": lambda x: 1.0507009873554805 * F.when(x > 0, x).otherwise(1.6732632423543772 * (F.exp(x) - 1)),
}


def activate(a: Column, name: str) -> Column:
    return F.transform(as_double(a), ACTIVATIONS[name])
