"""Concepts, atom upkeep, semantic search, inference steps and control loops over embeddings, documents and events.

A concept is an embedding label; atoms are embeddings with the document or the event of their id.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import functions as F

from atomweave.functions import segments as SG
from atomweave.operators.generate import generate
from atomweave.operators.kd_join import density_clusters, nearest_join, outlier_factors
from atomweave.plans.base import Registry, table

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles

XYZ_S = "(SELECT vec_id, label, CAST(embedding[0] AS DOUBLE) AS x, CAST(embedding[1] AS DOUBLE) AS y, CAST(embedding[2] AS DOUBLE) AS z FROM embeddings)"
XYZ_D = "(SELECT vec_id, label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings)"
VEC_S = "(SELECT vec_id, label, CAST(embedding AS ARRAY<DOUBLE>) AS v FROM embeddings)"
VEC_D = "(SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings)"
DOT_S = "aggregate(zip_with({a}, {b}, (p, q) -> p * q), 0D, (s, p) -> s + p)"
DOT_D = "list_dot_product({a}, {b})"


def both(name: str, sql: str) -> None:
    """One text for both dialects; XYZ, VEC and DOT[a;b] stand for what differs."""
    def fill(xyz: str, vec: str, dot: str) -> str:
        out = re.sub(r"\bXYZ\b", lambda m: xyz, re.sub(r"\bVEC\b", lambda m: vec, sql))
        return re.sub(r"DOT\[([^;\]]+);([^\]]+)\]", lambda m: dot.format(a=m[1], b=m[2]), out)

    duck = fill(XYZ_D, VEC_D, DOT_D).replace("max_by(", "arg_max(").replace("min_by(", "arg_min(").replace("struct(", "row(")
    R.sql(name, fill(XYZ_S, VEC_S, DOT_S), duck)


# occupied cells of the first component in order; a gap or another magnitude begins a new concept
both(
    "discover_concepts",
    """WITH b AS (SELECT CAST(floor(x / 0.02) AS BIGINT) AS cell, count(*) AS n, avg(sqrt(x * x + y * y + z * z)) AS size FROM XYZ p GROUP BY CAST(floor(x / 0.02) AS BIGINT)),
    g AS (SELECT *, CASE WHEN cell - lag(cell) OVER (ORDER BY cell) <= 1 AND abs(size - lag(size) OVER (ORDER BY cell)) <= 0.2 THEN 0 ELSE 1 END AS fresh FROM b),
    c AS (SELECT *, sum(fresh) OVER (ORDER BY cell ROWS UNBOUNDED PRECEDING) AS concept FROM g)
    SELECT CAST(concept AS BIGINT) AS concept, min(cell) AS first_cell, max(cell) AS last_cell, CAST(sum(n) AS BIGINT) AS atoms, round(sum(n * size) / sum(n), 6) AS mean_size FROM c GROUP BY concept""",
)
_CENTRES = "(SELECT label AS concept, i, avg(x) AS c FROM (SELECT label, posexplode(v) AS (i, x) FROM VEC e) t GROUP BY label, i)"
_CENTRES_D = "(SELECT label AS concept, i, avg(x) AS c FROM (SELECT label, unnest(range(len(v)))::INT AS i, unnest(v) AS x FROM VEC e) t GROUP BY label, i)"
_BIND = """WITH c AS (SELECT concept, ARRAYC AS c FROM CENTRES k GROUP BY concept),
    s AS (SELECT e.vec_id, c.concept, DOT[e.v;c.c] / sqrt(DOT[e.v;e.v] * DOT[c.c;c.c]) AS s FROM VEC e CROSS JOIN c),
    r AS (SELECT vec_id, concept, s, row_number() OVER (PARTITION BY vec_id ORDER BY round(s, 9) DESC, concept) AS r FROM s WHERE s >= 0.05)
    SELECT vec_id, concept, round(s, 6) AS strength, r = 1 AS is_primary FROM r WHERE r <= 5"""
_B = _BIND.replace("ARRAYC", "transform(array_sort(collect_list(struct(i, c))), p -> p.c)").replace("CENTRES", _CENTRES)
R.sql("bind_concepts", re.sub(r"DOT\[([^;\]]+);([^\]]+)\]", lambda m: DOT_S.format(a=m[1], b=m[2]), _B.replace("VEC", VEC_S)))
ORACLES["bind_concepts"] = re.sub(
    r"DOT\[([^;\]]+);([^\]]+)\]", lambda m: DOT_D.format(a=m[1], b=m[2]), _BIND.replace("ARRAYC", "list(c ORDER BY i)").replace("CENTRES", _CENTRES_D).replace("VEC", VEC_D)
)
# the ten nearest within 0.3 of each atom, by cells of a kd-tree; clusters are ranked by size, then nearness
_NEAR = """WITH p AS (SELECT vec_id, x, y, z FROM XYZ q),
    d AS (SELECT a.vec_id, b.vec_id AS other, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) AS d FROM p a JOIN p b ON a.vec_id <> b.vec_id),
    k AS (SELECT vec_id, other, d, row_number() OVER (PARTITION BY vec_id ORDER BY round(d, 9), other) AS r FROM d WHERE d <= 0.3)""".replace("XYZ", XYZ_D)


def _ten_nearest(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.slice("embedding", 1, 3).alias("xyz"))
    return nearest_join(e, "vec_id", "xyz", 10, 0.3).withColumnRenamed("id", "vec_id")


@R.add("knn_join_per_row", _NEAR + " SELECT vec_id, other, CAST(r AS BIGINT) AS r, round(d, 6) AS d FROM k WHERE r <= 10")
def knn_join_per_row(spark, sf_dir):
    return _ten_nearest(spark, sf_dir).select("vec_id", "other", F.col("rank").alias("r"), F.round("raw", 6).alias("d"))


@R.add(
    "cluster_concepts",
    _NEAR
    + """, n AS (SELECT vec_id, count(*) AS neighbours, round(avg(d), 6) AS mean_d FROM k WHERE r <= 10 GROUP BY vec_id HAVING count(*) >= 3)
    SELECT neighbours, mean_d, count(*) AS atoms, min(vec_id) AS representative, round(1 - mean_d / 0.3, 6) AS density FROM n GROUP BY neighbours, mean_d HAVING 1 - mean_d / 0.3 >= 0.3""",
)
def cluster_concepts(spark, sf_dir):
    n = _ten_nearest(spark, sf_dir).groupBy("vec_id").agg(F.count("*").alias("neighbours"), F.round(F.avg("raw"), 6).alias("mean_d")).where("neighbours >= 3")
    c = n.where("1 - mean_d / 0.3 >= 0.3").groupBy("neighbours", "mean_d").agg(F.count("*").alias("atoms"), F.min("vec_id").alias("representative"))
    return c.withColumn("density", F.round(1 - F.col("mean_d") / 0.3, 6))


_PAIRS = "d AS MATERIALIZED (SELECT a.vec_id, b.vec_id AS other, sqrt(greatest(list_sum([(a.v[i] - b.v[i]) * (a.v[i] - b.v[i]) FOR i IN range(1, len(a.v) + 1)]), 0)) AS d FROM VEC a JOIN VEC b ON a.vec_id <> b.vec_id)".replace("VEC", VEC_D)


@R.add(
    "local_outlier_factors",
    f"""WITH {_PAIRS}, k AS MATERIALIZED (SELECT vec_id, other, round(d, 9) AS d FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(d, 9), other) AS r FROM d) t WHERE r <= 5),
    f AS (SELECT vec_id, max(d) AS far FROM k GROUP BY 1), l AS MATERIALIZED (SELECT k.vec_id, 1 / (avg(greatest(f.far, k.d)) + 1e-10) AS density FROM k JOIN f ON f.vec_id = k.other GROUP BY 1)
    SELECT k.vec_id, round(avg(o.density) / min(l.density), 6) AS lof FROM k JOIN l ON l.vec_id = k.vec_id JOIN l o ON o.vec_id = k.other GROUP BY 1""",
)
def local_outlier_factors(spark, sf_dir):
    """Over all components, five neighbours, the whole table."""
    return outlier_factors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding").select(F.col("id").alias("vec_id"), F.round("lof", 6).alias("lof"))


EPS, LEAST = 1.15, 4


@R.add(
    "density_clusters",
    f"""WITH RECURSIVE {_PAIRS}, n AS MATERIALIZED (SELECT vec_id, other FROM d WHERE d <= {EPS}), c AS MATERIALIZED (SELECT vec_id FROM n GROUP BY 1 HAVING count(*) + 1 >= {LEAST}),
    e AS MATERIALIZED (SELECT n.vec_id AS a, n.other AS b FROM n JOIN c ON c.vec_id = n.vec_id JOIN c o ON o.vec_id = n.other),
    r(vec_id, reach) AS (SELECT vec_id, vec_id FROM c UNION SELECT r.vec_id, e.b FROM r JOIN e ON e.a = r.reach),
    k AS MATERIALIZED (SELECT vec_id, min(reach) AS cluster FROM r GROUP BY 1), b AS (SELECT n.vec_id, min(k.cluster) AS cluster FROM n JOIN k ON k.vec_id = n.other GROUP BY 1)
    SELECT v.vec_id, coalesce(k.cluster, b.cluster) AS cluster, k.vec_id IS NOT NULL AS core FROM embeddings v LEFT JOIN k ON k.vec_id = v.vec_id LEFT JOIN b ON b.vec_id = v.vec_id""",
)
def density_clusters_query(spark, sf_dir):
    """Over all components, the whole table."""
    return density_clusters(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", EPS, LEAST).withColumnRenamed("id", "vec_id")


# a domain reaches half way to the nearest other centroid, 0.5 where there is none
both(
    "concept_domains",
    """WITH c AS (SELECT label, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM XYZ p GROUP BY label),
    d AS (SELECT a.label, min(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z))) AS near FROM c a LEFT JOIN c b ON a.label <> b.label GROUP BY a.label)
    SELECT c.label, round(c.x, 6) AS x, round(c.y, 6) AS y, round(c.z, 6) AS z, round(coalesce(near, 1.0) / 2, 6) AS radius FROM c JOIN d ON d.label = c.label""",
)
both(
    "compare_atoms",
    "SELECT a.vec_id AS a, b.vec_id AS b, round(DOT[a.v;b.v] / sqrt(DOT[a.v;a.v] * DOT[b.v;b.v]), 6) AS similarity FROM VEC a JOIN VEC b ON b.vec_id = a.vec_id + 1",
)
# equal texts become the atom of the smallest id: references are repointed, the others are soft-deleted
both(
    "merge_atoms",
    """WITH k AS (SELECT text, min(doc_id) AS kept FROM documents GROUP BY text)
    SELECT d.doc_id, k.kept, d.doc_id <> k.kept AS deleted, CAST(coalesce(b.refs, 0) AS BIGINT) AS refs FROM documents d JOIN k ON k.text = d.text LEFT JOIN (SELECT doc_id, count(*) AS refs FROM labels GROUP BY doc_id) b ON b.doc_id = d.doc_id""",
)
# text by keyword in the document, candidates by the projection, rank by cosine to the keyword's centroid
both(
    "semantic_search",
    """WITH q AS (SELECT avg(x) AS x, avg(y) AS y, avg(z) AS z FROM XYZ p JOIN documents d ON d.doc_id = p.vec_id WHERE d.text LIKE '%license%' OR d.text LIKE '%the%'),
    c AS (SELECT p.vec_id, round(sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y) + (p.z - q.z) * (p.z - q.z)), 9) AS far, (p.x * q.x + p.y * q.y + p.z * q.z) / sqrt((p.x * p.x + p.y * p.y + p.z * p.z) * (q.x * q.x + q.y * q.y + q.z * q.z)) AS s FROM XYZ p CROSS JOIN q),
    t AS (SELECT vec_id, far, s FROM c ORDER BY far, vec_id LIMIT 100)
    SELECT vec_id, round(s, 6) AS similarity FROM t ORDER BY round(s, 6) DESC, vec_id LIMIT 10""",
)
# an atom with what it comes from and its nearest neighbours
both(
    "context_hydration",
    """WITH n AS (SELECT b.vec_id AS other, DOT[a.v;b.v] / sqrt(DOT[a.v;a.v] * DOT[b.v;b.v]) AS s FROM VEC a JOIN VEC b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id = 5)
    SELECT kind, id, round(s, 6) AS s FROM (SELECT 'neighbour' AS kind, other AS id, s FROM (SELECT other, s FROM n ORDER BY s DESC, other LIMIT 5) t
      UNION ALL SELECT 'document', doc_id, CAST(1 AS DOUBLE) FROM documents WHERE doc_id = 5 UNION ALL SELECT 'event', event_id, CAST(1 AS DOUBLE) FROM events WHERE event_id = 5) u""",
)
R.sql("atom_lookup_by_id", "SELECT doc_id, source, length(text) AS n FROM documents WHERE doc_id IN (3, 7, 11)")
R.sql("atom_lookup_by_hash", "SELECT d.doc_id FROM documents d JOIN (SELECT sha2(text, 256) AS h FROM documents WHERE doc_id = 7) q ON sha2(d.text, 256) = q.h", "SELECT d.doc_id FROM documents d JOIN (SELECT sha256(text) AS h FROM documents WHERE doc_id = 7) q ON sha256(d.text) = q.h")
R.sql("atoms_of_tenant_page", "SELECT doc_id, lang FROM documents WHERE source = 'src2' ORDER BY doc_id LIMIT 5 OFFSET 2")

# inference: context centroid, the nearest twice k, softmax at a temperature, nucleus
both(
    "run_inference",
    """WITH q AS (SELECT avg(x) AS x, avg(y) AS y, avg(z) AS z FROM XYZ p WHERE vec_id IN (1, 2, 3)),
    d AS (SELECT p.vec_id, sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y) + (p.z - q.z) * (p.z - q.z)) AS d FROM XYZ p CROSS JOIN q WHERE p.vec_id NOT IN (1, 2, 3)),
    t AS (SELECT vec_id, d FROM d ORDER BY round(d, 9), vec_id LIMIT 20), w AS (SELECT vec_id, exp(-d / 0.05) AS w FROM t), p AS (SELECT vec_id, w / sum(w) OVER () AS p FROM w),
    c AS (SELECT vec_id, p, sum(p) OVER (ORDER BY round(p, 9) DESC, vec_id ROWS UNBOUNDED PRECEDING) AS cum FROM p)
    SELECT vec_id, round(p, 6) AS p FROM c WHERE cum <= 0.9 OR p >= 0.05""",
)
both(
    "spatial_next_token",
    """WITH q AS (SELECT avg(x) AS x, avg(y) AS y, avg(z) AS z FROM XYZ p WHERE vec_id IN (4, 9)),
    d AS (SELECT p.vec_id, sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y) + (p.z - q.z) * (p.z - q.z)) AS d FROM XYZ p CROSS JOIN q WHERE p.vec_id NOT IN (4, 9)),
    t AS (SELECT vec_id, d FROM d ORDER BY round(d, 9), vec_id LIMIT 5)
    SELECT vec_id, round(exp(-d) / sum(exp(-d)) OVER (), 6) AS p FROM t""",
)
# scaled dot-product attention of one query over a concept's atoms, for every concept
both(
    "attention_over_atoms",
    """WITH s AS (SELECT e.label, e.vec_id, DOT[e.v;q.v] / 8 AS s FROM VEC e CROSS JOIN (SELECT v FROM VEC z WHERE vec_id = 0) q),
    w AS (SELECT label, vec_id, exp(s) AS w FROM s)
    SELECT label, vec_id, round(w / sum(w) OVER (PARTITION BY label), 8) AS attention FROM w""",
)
# one layer: normalise, a fixed linear map to four numbers, GELU, mean
_GELU = lambda x: f"(0.5 * ({x}) * (1 + tanh(0.7978845608 * (({x}) + 0.044715 * ({x}) * ({x}) * ({x})))))"


def _layer(first: int) -> str:
    return " + ".join(_GELU(f"(v[{i + first}] - m) / sd * {0.5 + i / 10:.1f} + 0.1") for i in range(4))


R.sql(
    "layered_inference",
    f"""WITH s AS (SELECT vec_id, v, aggregate(v, 0D, (a, x) -> a + x) / size(v) AS m FROM {VEC_S} e), n AS (SELECT *, sqrt(aggregate(v, 0D, (a, x) -> a + (x - m) * (x - m)) / size(v) + 0.00001D) AS sd FROM s)
    SELECT vec_id, round(({_layer(0)}) / 4, 6) AS out FROM n""",
    f"""WITH s AS (SELECT vec_id, v, list_sum(v) / len(v) AS m FROM {VEC_D} e), n AS (SELECT *, sqrt(list_sum(list_transform(v, lambda x: (x - m) * (x - m))) / len(v) + 0.00001) AS sd FROM s)
    SELECT vec_id, round(({_layer(1)}) / 4, 6) AS out FROM n""",
)

# control loop: normalised metrics, anomalies, hypotheses, actions, what was learned
R.sql(
    "ooda_analyze",
    """WITH d AS (SELECT CAST(ts AS DATE) AS day, CAST(count(*) AS DOUBLE) AS n, avg(value) AS ms, avg(CASE WHEN event_type = 'error' THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) AS bad FROM events GROUP BY CAST(ts AS DATE)),
    s AS (SELECT max(n) AS n, max(ms) AS ms, max(bad) AS bad, avg(ms) AS mean, stddev_samp(ms) AS sd FROM d)
    SELECT day, round(d.n / s.n, 6) AS load_share, round(d.ms / s.ms, 6) AS latency, round(d.bad / s.bad, 6) AS errors, abs(d.ms - s.mean) > 2 * s.sd AS anomaly FROM d CROSS JOIN s""",
)
R.sql(
    "ooda_act",
    """WITH h AS (SELECT user_id, count(*) AS n, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS bad, avg(value) AS ms FROM events GROUP BY user_id)
    SELECT user_id, CASE WHEN bad > 5 THEN 'investigate' WHEN ms > 30 THEN 'tune' WHEN n > 80 THEN 'cache' ELSE 'none' END AS action, CASE WHEN bad > 5 OR ms > 30 THEN 'high' WHEN n > 80 THEN 'medium' ELSE 'low' END AS priority FROM h""",
)
R.sql(
    "ooda_learn",
    """WITH p AS (SELECT user_id, avg(CASE WHEN ts < TIMESTAMP '2024-01-16 00:00:00' THEN value END) AS before_ms, avg(CASE WHEN ts >= TIMESTAMP '2024-01-16 00:00:00' THEN value END) AS after_ms FROM events GROUP BY user_id)
    SELECT user_id, round((before_ms - after_ms) / before_ms, 6) AS gain, CASE WHEN after_ms < 0.9 * before_ms THEN 'success' WHEN after_ms > 1.1 * before_ms THEN 'regressed' ELSE 'neutral' END AS outcome FROM p WHERE before_ms > 0 AND after_ms IS NOT NULL""",
)
R.sql(
    "resolve_tenant_guid",
    """WITH known AS (SELECT DISTINCT source FROM documents WHERE doc_id % 2 = 0), asked AS (SELECT DISTINCT source FROM documents)
    SELECT a.source, md5(a.source) AS guid, k.source IS NULL AS created FROM asked a LEFT JOIN known k ON k.source = a.source""",
)
# a state after a terminal one is ignored
R.sql(
    "update_job_status",
    """WITH e AS (SELECT user_id, event_type, ts, event_id, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ended FROM events),
    r AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM e WHERE coalesce(ended, 0) = 0) SELECT user_id, event_type AS status, event_type = 'purchase' AS terminal FROM r WHERE r = 1""",
)
R.sql("ingest_model_weights", "SELECT l_suppkey AS model, l_discount AS weight, count(*) AS reference_count, min(l_orderkey) AS first_at FROM lineitem GROUP BY l_suppkey, l_discount")
R.sql("hot_path_lookup", "SELECT user_id, count(*) AS hits, max(ts) AS last_hit FROM events WHERE user_id = 8 AND event_type = 'click' GROUP BY user_id")

# streaming rules as batch: tenant from an id's prefix (1 without one), what critical events set off, sliding windows
R.sql(
    "tenant_routing",
    "SELECT device, CAST(CASE WHEN regexp_extract(device, '^tenant([0-9]+)-', 1) = '' THEN '1' ELSE regexp_extract(device, '^tenant([0-9]+)-', 1) END AS INT) AS tenant FROM (SELECT DISTINCT CASE WHEN user_id % 3 = 0 THEN concat('dev', user_id) ELSE concat('tenant', user_id % 5, '-', user_id) END AS device FROM events) d",
)
R.sql("critical_event_trigger", "SELECT event_id, user_id, CASE WHEN value > 40 THEN 'critical' ELSE 'error' END AS severity FROM events WHERE event_type = 'error' OR value > 40")
R.sql(
    "sliding_window_counts",
    """WITH h AS (SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS hour, count(*) AS n FROM events GROUP BY CAST(date_trunc('hour', ts) AS TIMESTAMP))
    SELECT a.hour, CAST(sum(b.n) AS BIGINT) AS n FROM h a JOIN h b ON b.hour BETWEEN a.hour - INTERVAL '5' HOUR AND a.hour GROUP BY a.hour""",
)
# optional filters and plane geometry
both("optional_filter", "SELECT vec_id, label FROM XYZ p WHERE (CAST(NULL AS INT) IS NULL OR label = CAST(NULL AS INT)) AND (3 IS NULL OR label = 3)")
both("spatial_intersects", "SELECT vec_id, (x - greatest(-0.1, least(x, 0.1))) * (x - greatest(-0.1, least(x, 0.1))) + (y - greatest(0.0, least(y, 0.2))) * (y - greatest(0.0, least(y, 0.2))) <= 0.0025 AS buffer_meets_box, sqrt(x * x + y * y) <= 0.1 + 0.05 AS buffers_meet FROM XYZ p")
R.sql(
    "path_points",
    "SELECT user_id, size(p) AS n_points, element_at(p, -1).event_id AS end_point, p[0].event_id AS first_point FROM (SELECT user_id, array_sort(collect_list(struct(ts, event_id))) AS p FROM events WHERE event_type = 'purchase' GROUP BY user_id) t",
    "SELECT user_id, count(*)::INT AS n_points, arg_max(event_id, row(ts, event_id)) AS end_point, arg_min(event_id, row(ts, event_id)) AS first_point FROM events WHERE event_type = 'purchase' GROUP BY user_id",
)

# numerical methods on y' = -k y and f(x) = x^2 - k, a row for each supplier
_STEPS = {"euler": "y - 0.1 * k * y", "rk4": "y * (1 - 0.1 * k + 0.01 * k * k / 2 - 0.001 * k * k * k / 6 + 0.0001 * k * k * k * k / 24)", "newton": "y - (y * y - k) / (2 * y)", "descent": "y - 0.05 * 2 * (y - k)"}
_K = "(1 + s_suppkey % 4)"
R.sql(
    "numerical_steps",
    "SELECT s_suppkey, " + ", ".join(f"round(aggregate(sequence(1, 10), 1D, (y, i) -> {e.replace('k', f'CAST({_K} AS DOUBLE)')}), 8) AS {n}" for n, e in _STEPS.items()) + " FROM supplier",
    "SELECT s_suppkey, " + ", ".join(f"round(list_reduce([1.0::DOUBLE for _ in range(11)], lambda y, i: {e.replace('k', f'{_K}::DOUBLE')}), 8) AS {n}" for n, e in _STEPS.items()) + " FROM supplier",
)
# two-step Adams-Bashforth, momentum and bisection carry two numbers each
R.sql(
    "numerical_two_step",
    f"""SELECT s_suppkey, round(aggregate(sequence(1, 10), named_struct('y', 1D - 0.1D * k, 'f', -k), (s, i) -> named_struct('y', s.y + 0.1D * (1.5D * (-k * s.y) - 0.5D * s.f), 'f', -k * s.y)).y, 8) AS adams_bashforth,
      round(aggregate(sequence(1, 10), named_struct('y', 1D, 'f', 0D), (s, i) -> named_struct('y', s.y + 0.9D * s.f - 0.1D * (s.y - k), 'f', 0.9D * s.f - 0.1D * (s.y - k))).y, 8) AS momentum,
      round(aggregate(sequence(1, 20), named_struct('y', 0D, 'f', 4D), (s, i) -> CASE WHEN (s.y + s.f) * (s.y + s.f) / 4 < k THEN named_struct('y', (s.y + s.f) / 2, 'f', s.f) ELSE named_struct('y', s.y, 'f', (s.y + s.f) / 2) END).y, 8) AS bisection
    FROM (SELECT s_suppkey, CAST({_K} AS DOUBLE) AS k FROM supplier) t""",
    f"""WITH RECURSIVE t AS (SELECT s_suppkey, {_K}::DOUBLE AS k FROM supplier),
    r AS (SELECT s_suppkey, k, 0 AS i, 1 - 0.1::DOUBLE * k AS ay, -k AS af, 1.0::DOUBLE AS my, 0.0::DOUBLE AS mf, 0.0::DOUBLE AS lo, 4.0::DOUBLE AS hi FROM t UNION ALL
      SELECT s_suppkey, k, i + 1, CASE WHEN i < 10 THEN ay + 0.1::DOUBLE * (1.5::DOUBLE * (-k * ay) - 0.5::DOUBLE * af) ELSE ay END, CASE WHEN i < 10 THEN -k * ay ELSE af END,
        CASE WHEN i < 10 THEN my + 0.9::DOUBLE * mf - 0.1::DOUBLE * (my - k) ELSE my END, CASE WHEN i < 10 THEN 0.9::DOUBLE * mf - 0.1::DOUBLE * (my - k) ELSE mf END,
        CASE WHEN (lo + hi) * (lo + hi) / 4 < k THEN (lo + hi) / 2 ELSE lo END, CASE WHEN (lo + hi) * (lo + hi) / 4 < k THEN hi ELSE (lo + hi) / 2 END FROM r WHERE i < 20)
    SELECT s_suppkey, round(ay, 8) AS adams_bashforth, round(my, 8) AS momentum, round(lo, 8) AS bisection FROM r WHERE i = 20""",
)


@R.add("segment_enumeration", """SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS ordinal, CASE role WHEN 'user' THEN 'Input' WHEN 'assistant' THEN 'Output' ELSE 'Unknown' END AS kind, strlen(coalesce(text, '')) AS bytes FROM conversations""")
def segment_enumeration(spark, sf_dir):
    """Dialogues as segmented streams in parts of sixteen turn numbers, enumerated by the table function."""
    c = table(spark, sf_dir, "conversations").withColumn("part", F.floor(F.col("turn") / 16))
    kind = F.when(F.col("role") == "user", "input").when(F.col("role") == "assistant", "OUTPUT").otherwise(F.col("role"))
    made = SG.segment(kind, F.lit(None), F.col("text"))
    parts = c.groupBy("conv_id", "part").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text", made.alias("s")))).alias("x"))
    stream = SG.create(F.col("conv_id"), F.lit("2024-01-01"))
    parts = parts.select("conv_id", "part", stream.withField("segments", F.col("x.s")).alias("stream"))
    SG.register(spark)
    name = f"streams_{uuid.uuid4().hex}"
    parts.createOrReplaceTempView(name)
    return spark.sql(f"SELECT CAST(stream_id AS BIGINT) AS conv_id, ordinal, kind, CAST(length(payload) AS BIGINT) AS bytes FROM enumerate_segments(TABLE({name}) PARTITION BY conv_id ORDER BY part)")


def _views(v: str):
    """The two halves of a vector, a model each."""
    return F.explode(F.array(*(F.struct(F.lit(m).alias("model_id"), F.slice(v, 32 * m + 1, 32).alias("v")) for m in (0, 1)))).alias("m")


@R.add("generate_sequences")
def generate_sequences(spark, sf_dir):
    """A prompt for each concept, its mean vector; two models; tokens are the documents' first words."""
    e = table(spark, sf_dir, "embeddings")
    token = F.regexp_extract("text", r"^\s*(\S+)", 1)
    words = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), token.alias("token"))
    atoms = e.join(words, "vec_id").select(F.col("vec_id").alias("atom_id"), "token", _views("embedding")).select("atom_id", "token", "m.*")
    means = e.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    means = means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("v"))
    prompts = means.select(F.col("label").cast("long").alias("prompt_id"), _views("v")).select("prompt_id", "m.*")
    out = generate(prompts, atoms, {0: 0.6, 1: 0.4}, steps=4)
    return out.withColumns({c: F.round(c, 6) for c in ("score", "distance")})
