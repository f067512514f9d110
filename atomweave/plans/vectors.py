"""Scalar vector functions over ``embeddings``; pairs are (vec_id, vec_id + 1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from atomweave.functions import vector as V
from atomweave.plans.base import Registry, table

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles


def ab():
    return F.col("a"), F.col("b")
PAIRS = "(SELECT x.vec_id, x.embedding::DOUBLE[] AS a, y.embedding::DOUBLE[] AS b, list_zip(x.embedding::DOUBLE[], y.embedding::DOUBLE[]) AS z FROM embeddings x JOIN embeddings y ON y.vec_id = x.vec_id + 1)"


def pairs(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.col("embedding").alias("a")).join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b")), "vec_id")


@R.add(
    "vector_metrics",
    f"""SELECT vec_id, round(list_dot_product(a, b), 6) AS dot, round(list_cosine_similarity(a, b), 6) AS cosine, round(list_distance(a, b), 6) AS euclidean,
        round(list_sum([abs(p[1] - p[2]) FOR p IN z]), 6) AS manhattan, round(list_max([abs(p[1] - p[2]) FOR p IN z]), 6) AS chebyshev,
        round(pow(list_sum([pow(abs(p[1] - p[2]), 3.0) FOR p IN z]), 1.0 / 3.0), 6) AS minkowski,
        round(list_sum([CASE WHEN abs(p[1] - p[2]) > 0.1 THEN 1.0 ELSE 0.0 END FOR p IN z])::DOUBLE, 6) AS hamming,
        round(list_sum([CASE WHEN abs(p[1]) + abs(p[2]) = 0 THEN 0.0 ELSE abs(p[1] - p[2]) / (abs(p[1]) + abs(p[2])) END FOR p IN z]), 6) AS canberra FROM {PAIRS} t""",
)
def vector_metrics(spark, sf_dir):
    A, B = ab()
    cols = {"dot": V.dot(A, B), "cosine": V.cosine(A, B), "euclidean": V.euclidean(A, B), "manhattan": V.manhattan(A, B), "chebyshev": V.chebyshev(A, B)}
    cols |= {"minkowski": V.minkowski(A, B), "hamming": V.hamming(A, B, 0.1), "canberra": V.canberra(A, B)}
    return pairs(spark, sf_dir).select("vec_id", *(F.round(c, 6).alias(n) for n, c in cols.items()))


@R.add(
    "vector_similarities",
    f"""SELECT vec_id, round(1 / (1 + list_distance(a, b)), 6) AS euclidean, round(1 - list_sum([CASE WHEN abs(p[1] - p[2]) > 0.1 THEN 1.0 ELSE 0.0 END FOR p IN z])::DOUBLE / len(a), 6) AS hamming,
        round(1 - list_cosine_similarity(a, b), 6) AS cosine_distance FROM {PAIRS} t""",
)
def vector_similarities(spark, sf_dir):
    A, B = ab()
    return pairs(spark, sf_dir).select(
        "vec_id",
        F.round(V.similarity("euclidean", A, B), 6).alias("euclidean"),
        F.round(1 - V.hamming(A, B, 0.1) / F.size(A), 6).alias("hamming"),
        F.round(V.distance("cosine", A, B), 6).alias("cosine_distance"),
    )


@R.add(
    "vector_arithmetic",
    f"""SELECT vec_id, round(list_sum([(p[1] + p[2]) * 2.5 FOR p IN z]), 6) AS added, round(list_sum([p[1] - p[2] FOR p IN z]), 6) AS subtracted,
        round(list_sum([p[1] * 0.75 + p[2] * 0.25 FOR p IN z]), 6) AS blended, round(sqrt(list_dot_product(a, a)), 6) AS norm,
        round(a[1] / sqrt(list_dot_product(a, a)), 6) AS unit_first, (list_position(a, list_max(a)) - 1)::INT AS arg_max FROM {PAIRS} t""",
)
def vector_arithmetic(spark, sf_dir):
    A, B = ab()
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x)
    return pairs(spark, sf_dir).select(
        "vec_id",
        F.round(total(V.scale(V.add(A, B), 2.5)), 6).alias("added"),
        F.round(total(V.subtract(A, B)), 6).alias("subtracted"),
        F.round(total(V.lerp(A, B, 0.25)), 6).alias("blended"),
        F.round(V.norm(A), 6).alias("norm"),
        F.round(V.normalize(A)[0], 6).alias("unit_first"),
        V.argmax(A).alias("arg_max"),
    )


@R.add(
    "vector_softmax",
    """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS a, list_max(embedding::DOUBLE[]) AS m FROM embeddings),
       s AS (SELECT *, list_sum([exp((x - m) / 0.5) FOR x IN a]) AS t FROM e)
       SELECT vec_id, round(exp((a[1] - m) / 0.5) / t, 8) AS first, round(1.0 / t, 8) AS largest FROM s""",
)
def vector_softmax(spark, sf_dir):
    p = table(spark, sf_dir, "embeddings").select("vec_id", V.softmax(F.col("embedding"), 0.5).alias("p"))
    return p.select("vec_id", F.round(F.col("p")[0], 8).alias("first"), F.round(F.array_max("p"), 8).alias("largest"))


_ACT = {
    "relu": "greatest(x, 0)",
    "sigmoid": "1 / (1 + exp(-x))",
    "tanh": "tanh(x)",
    "gelu": "0.5 * x * (1 + tanh(0.7978845608028654::DOUBLE * (x + 0.044715::DOUBLE * x * x * x)))",
    "swish": "x / (1 + exp(-x))",
    "mish": "x * tanh(ln(1 + exp(x)))",
    "leaky_relu": "CASE WHEN x > 0 THEN x ELSE 0.01::DOUBLE * x END",
    "elu": "CASE WHEN x > 0 THEN x ELSE exp(x) - 1 END",
    "selu": "1.0507009873554805::DOUBLE * CASE WHEN x > 0 THEN x ELSE 1.6732632423543772::DOUBLE * (exp(x) - 1) END",
}


@R.add("activations", "SELECT vec_id, " + ", ".join(f"round(list_sum([{e} FOR x IN embedding::DOUBLE[]]), 6) AS {n}" for n, e in _ACT.items()) + " FROM embeddings")
def activations(spark, sf_dir):
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x)
    return table(spark, sf_dir, "embeddings").select("vec_id", *(F.round(total(V.activate(F.col("embedding"), n)), 6).alias(n) for n in V.ACTIVATIONS))


@R.add(
    "z_score_outliers",
    """WITH s AS (SELECT user_id, event_id, value, avg(value) OVER w AS m, stddev_pop(value) OVER w AS sd FROM events WINDOW w AS (PARTITION BY user_id)),
       q AS (SELECT user_id, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events GROUP BY user_id)
       SELECT event_id, round((value - m) / nullif(sd, 0), 6) AS z, value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1) AS iqr_outlier FROM s JOIN q USING (user_id)""",
)
def z_score_outliers(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    s = e.groupBy("user_id").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("sd"), F.percentile("value", F.lit(0.25)).alias("q1"), F.percentile("value", F.lit(0.75)).alias("q3"))
    iqr = F.col("q3") - F.col("q1")
    return e.join(s, "user_id").select(
        "event_id",
        F.round((F.col("value") - F.col("m")) / F.nullif(F.col("sd"), F.lit(0.0)), 6).alias("z"),
        ((F.col("value") < F.col("q1") - 1.5 * iqr) | (F.col("value") > F.col("q3") + 1.5 * iqr)).alias("iqr_outlier"),
    )


@R.add(
    "performance_vector",
    """SELECT event_id, round(value / 100, 6) AS duration, round(hour(ts) / 24.0, 6)::DOUBLE AS hour_share, round(((dayofweek(ts)) / 7.0), 6)::DOUBLE AS day_share, round(ln(1 + value), 6) AS log_value,
       round(sin(2 * pi() * hour(ts) / 24), 6) AS hour_sin, round(cos(2 * pi() * hour(ts) / 24), 6) AS hour_cos, dayofweek(ts) IN (0, 6) AS weekend, hour(ts) BETWEEN 9 AND 17 AS business FROM events""",
)
def performance_vector(spark, sf_dir):
    h, d = F.hour("ts"), F.dayofweek("ts") - 1
    angle = 2 * F.pi() * h / 24
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.round(F.col("value") / 100, 6).alias("duration"),
        F.round(h / 24, 6).alias("hour_share"),
        F.round(d / 7, 6).alias("day_share"),
        F.round(F.log1p("value"), 6).alias("log_value"),
        F.round(F.sin(angle), 6).alias("hour_sin"),
        F.round(F.cos(angle), 6).alias("hour_cos"),
        d.isin(0, 6).alias("weekend"),
        h.between(9, 17).alias("business"),
    )


# primes among the keys of parts
R.sql(
    "find_primes",
    "SELECT p_partkey AS n FROM part WHERE p_partkey > 1 AND NOT exists(sequence(2, CAST(greatest(2, floor(sqrt(p_partkey))) AS INT)), d -> d < p_partkey AND p_partkey % d = 0)",
    "SELECT p_partkey AS n FROM part WHERE p_partkey > 1 AND len(list_filter(range(2, greatest(2, floor(sqrt(p_partkey)))::BIGINT + 1), lambda d: d < p_partkey AND p_partkey % d = 0)) = 0",
)
