"""Vector search operators. Each takes a candidate frame with ``vec_id`` and ``embedding`` and a query vector.

Queries are literals, so a search is one scan with a top-k: no join and no shuffle of vectors. Ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from atomweave.functions import vector as V
from atomweave.operators.pairs import alike_pairs


def literal(vector: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector])


def vector_of(frame: DataFrame, vec_id: int) -> list[float]:
    """The embedding of one row."""
    return [float(x) for x in frame.where(F.col("vec_id") == vec_id).select("embedding").first()[0]]


def top(frame: DataFrame, score: str, k: int, ascending: bool = False) -> DataFrame:
    return frame.orderBy(F.asc(score) if ascending else F.desc(score), "vec_id").limit(k)


def exact(frame: DataFrame, query: Sequence[float], k: int, metric: str = "cosine", where: Column | None = None) -> DataFrame:
    """(vec_id, distance): full scan, smallest distance first."""
    rows = frame if where is None else frame.where(where)
    return top(rows.select("vec_id", F.round(V.distance(metric, F.col("embedding"), literal(query)), 6).alias("distance")), "distance", k, True)


def hybrid(frame: DataFrame, query: Sequence[float], candidates: int, k: int) -> DataFrame:
    """Nearest in the first three components, then by cosine."""
    q3 = literal(query[:3])
    near = frame.select("vec_id", "embedding", F.round(V.euclidean(F.slice("embedding", 1, 3), q3), 6).alias("spatial"))
    near = top(near, "spatial", candidates, True)
    return top(near.select("vec_id", "spatial", F.round(V.cosine(F.col("embedding"), literal(query)), 6).alias("similarity")), "similarity", k)


def fusion(frame: DataFrame, query: Sequence[float], keyword: Column, region: Column, k: int, weights: tuple[float, float, float] = (0.5, 0.3, 0.2)) -> DataFrame:
    """Weighted sum of cosine, a keyword score and membership of a region."""
    if abs(sum(weights) - 1) > 0.01:
        raise ValueError("weights must sum to 1")
    s = V.cosine(F.col("embedding"), literal(query)) * weights[0] + keyword * weights[1] + F.when(region, 1.0).otherwise(0.0) * weights[2]
    return top(frame.select("vec_id", F.round(s, 6).alias("score")), "score", k)


def ensemble(frame: DataFrame, queries: Sequence[Sequence[float]], models: Sequence[Column], weights: Sequence[float], k: int) -> DataFrame:
    """Weighted scores of several models; a row that a model doesn't cover scores 0 there."""
    s = F.lit(0.0)
    for q, covered, w in zip(queries, models, weights):
        s = s + F.when(covered, V.cosine(F.col("embedding"), literal(q))).otherwise(0.0) * w
    return top(frame.select("vec_id", F.round(s, 6).alias("score")), "score", k)


def activation(frame: DataFrame, query: Sequence[float], threshold: float, n: int) -> DataFrame:
    """Rows over a similarity threshold with a level."""
    s = frame.select("vec_id", F.round(V.cosine(F.col("embedding"), literal(query)), 6).alias("activation")).where(F.col("activation") >= threshold)
    level = F.when(F.col("activation") >= 0.95, "VERY_HIGH").when(F.col("activation") >= 0.9, "HIGH").when(F.col("activation") >= 0.8, "MEDIUM").otherwise("LOW")
    return top(s.withColumn("level", level), "activation", n)


def duplicates(frame: DataFrame, threshold: float) -> DataFrame:
    """Pairs of one label, smaller id first, at or over a cosine: all pairs of a label in blocks, one matrix product each, as cells tell little apart at the angles asked for.

    Vectors without a length, or with broken components, take no part.
    """
    v = frame.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("embedding").cast("array<double>").alias("embedding"))
    v = v.where(V.norm(F.col("embedding")) > 0).where(~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    unit = v.select("vec_id", "label", V.normalize(F.col("embedding")).alias("unit"))
    pairs = alike_pairs(unit, "label", "vec_id", "unit", threshold - 1e-6)
    return pairs.select("a", "b", F.round("cosine", 6).alias("similarity")).where(F.col("similarity") >= threshold)
