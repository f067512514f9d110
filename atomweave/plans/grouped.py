"""Algorithms over embeddings by label. What a group's moments or neighbours decide runs over groups of any size, as typed rows; the others take whole bounded groups and
give JSON, and unit tests hold them."""

from __future__ import annotations

from pyspark.sql import functions as F

from atomweave.operators import moments as M
from atomweave.operators import pairs as P
from atomweave.operators.grouped import ALGORITHMS, per_group
from atomweave.operators.kd_join import APART, density_clusters, in_group, outlier_factors
from atomweave.plans.base import Registry, table

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles

_BY_MOMENTS_OR_NEIGHBOURS = ("local_outlier_factor", "dbscan", "mahalanobis", "principal_components", "random_projection", "autoencoder", "explained_variance", "attention", "dtw")
for _name, _f in ALGORITHMS.items():
    if _name not in _BY_MOMENTS_OR_NEIGHBOURS:
        R.add(f"group_{_name}")(lambda spark, sf_dir, f=_f: per_group(table(spark, sf_dir, "embeddings"), "label", "vec_id", "embedding", f))


def _rounded(c: str) -> F.Column:
    return F.transform(c, lambda x: F.round(x, 6))


def _embeddings(spark, sf_dir):
    return table(spark, sf_dir, "embeddings"), "label", "vec_id", "embedding"


_PAIRS = """d AS MATERIALIZED (SELECT a.label, a.vec_id, b.vec_id AS other, sqrt(list_sum([(a.v[i] - b.v[i]) ** 2 FOR i IN range(1, len(a.v) + 1)])) AS d
    FROM (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings) a JOIN (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings) b ON a.label = b.label AND a.vec_id <> b.vec_id)"""


@R.add(
    "group_local_outlier_factor",
    f"""WITH {_PAIRS}, k AS MATERIALIZED (SELECT vec_id, other, round(d, 9) AS d FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(d, 9), other) AS r FROM d) t WHERE r <= 5),
    f AS (SELECT vec_id, max(d) AS far FROM k GROUP BY 1), l AS MATERIALIZED (SELECT k.vec_id, 1 / (avg(greatest(f.far, k.d)) + 1e-10) AS density FROM k JOIN f ON f.vec_id = k.other GROUP BY 1)
    SELECT label, k.vec_id, round(avg(o.density) / min(l.density), 6) AS lof FROM k JOIN l ON l.vec_id = k.vec_id JOIN l o ON o.vec_id = k.other JOIN embeddings e ON e.vec_id = k.vec_id GROUP BY 1, 2""",
)
def group_local_outlier_factor(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", in_group("label", "embedding").alias("v"))
    return outlier_factors(e, "vec_id", "v", 5, APART / 2).join(e.select(F.col("vec_id").alias("id"), "label"), "id").select("label", F.col("id").alias("vec_id"), F.round("lof", 6).alias("lof"))


@R.add(
    "group_dbscan",
    f"""WITH RECURSIVE {_PAIRS}, n AS MATERIALIZED (SELECT vec_id, other FROM d WHERE d <= 1.2), c AS MATERIALIZED (SELECT vec_id FROM n GROUP BY 1 HAVING count(*) + 1 >= 4),
    e AS MATERIALIZED (SELECT n.vec_id AS a, n.other AS b FROM n JOIN c ON c.vec_id = n.vec_id JOIN c o ON o.vec_id = n.other),
    r(vec_id, reach) AS (SELECT vec_id, vec_id FROM c UNION SELECT r.vec_id, e.b FROM r JOIN e ON e.a = r.reach),
    k AS MATERIALIZED (SELECT vec_id, min(reach) AS cluster FROM r GROUP BY 1), b AS (SELECT n.vec_id, min(k.cluster) AS cluster FROM n JOIN k ON k.vec_id = n.other GROUP BY 1)
    SELECT v.label, v.vec_id, coalesce(k.cluster, b.cluster) AS cluster FROM embeddings v LEFT JOIN k ON k.vec_id = v.vec_id LEFT JOIN b ON b.vec_id = v.vec_id""",
)
def group_dbscan(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", in_group("label", "embedding").alias("v"))
    return density_clusters(e, "vec_id", "v", 1.2, 4).join(e.select(F.col("vec_id").alias("id"), "label"), "id").select("label", F.col("id").alias("vec_id"), "cluster")


@R.add("group_mahalanobis")
def group_mahalanobis(spark, sf_dir):
    return M.mahalanobis(*_embeddings(spark, sf_dir)).select(F.col("g").alias("label"), F.col("id").alias("vec_id"), F.round("distance", 6).alias("distance"))


@R.add("group_principal_components")
def group_principal_components(spark, sf_dir):
    return M.principal_components(*_embeddings(spark, sf_dir)).select(F.col("g").alias("label"), "rank", F.round("variance", 6).alias("variance"), F.round("ratio", 6).alias("ratio"), _rounded("component").alias("component"))


@R.add("group_explained_variance")
def group_explained_variance(spark, sf_dir):
    return M.svd(*_embeddings(spark, sf_dir)).select(F.col("g").alias("label"), "rank", F.round("singular", 6).alias("singular"), F.round("kept", 6).alias("kept"))


# squares are kept by the decomposition: a vector's are those of its rebuilt vector and of what that lacks
@R.add("svd_reconstruction", "SELECT label, vec_id, round(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]), 5) AS squares FROM embeddings")
def svd_reconstruction(spark, sf_dir):
    r = M.svd_reconstruct(*_embeddings(spark, sf_dir))
    squares = F.aggregate("rebuilt", F.lit(0.0), lambda s, x: s + x * x) + F.col("error") * F.col("error")
    return r.select(F.col("g").alias("label"), F.col("id").alias("vec_id"), F.round(squares, 5).alias("squares"))


@R.add("group_autoencoder")
def group_autoencoder(spark, sf_dir):
    return M.linear_codes(*_embeddings(spark, sf_dir)).select(F.col("g").alias("label"), F.col("id").alias("vec_id"), _rounded("code").alias("code"), F.round("error", 6).alias("error"))


@R.add("group_attention")
def group_attention(spark, sf_dir):
    return P.attention(*_embeddings(spark, sf_dir))


@R.add("group_dtw")
def group_dtw(spark, sf_dir):
    return P.warping_distance(*_embeddings(spark, sf_dir))


@R.add("group_random_projection")
def group_random_projection(spark, sf_dir):
    return M.random_projection(table(spark, sf_dir, "embeddings"), "vec_id", "embedding").select(F.col("id").alias("vec_id"), _rounded("projected").alias("projected"))
