"""Vector and sequence aggregates that are algebraic: partial and final sums, windows and top-k, no Python.

Groups are embedding labels, ordered by vec_id; journeys, experiments and tool chains are read from ``events``.
"""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from atomweave.operators import pairs as P
from atomweave.plans.base import Registry, table

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles

ELEMENTS = "(SELECT label, vec_id, i, CAST(x AS DOUBLE) AS x FROM embeddings LATERAL VIEW posexplode(embedding) p AS i, x)"
ELEMENTS_D = "(SELECT label, vec_id, unnest(range(len(embedding)))::INT AS i, unnest(embedding)::DOUBLE AS x FROM embeddings)"
COS_S = "(aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x) / sqrt(aggregate(a, 0D, (s, x) -> s + x * x) * aggregate(b, 0D, (s, x) -> s + x * x)))"
COS_D = "list_cosine_similarity(a, b)"
DIST_S = "sqrt(aggregate(zip_with(a, b, (x, y) -> (x - y) * (x - y)), 0D, (s, x) -> s + x))"
DIST_D = "list_distance(a, b)"
VEC_S, VEC_D = "CAST(embedding AS ARRAY<DOUBLE>)", "embedding::DOUBLE[]"


def both(name: str, sql: str) -> None:
    """One text for both dialects; ELEMENTS, COS, DIST and VEC stand for what differs."""

    def fill(elements: str, cos: str, dist: str, vec: str) -> str:
        words = {"ELEMENTS": elements, "COS": cos, "DIST": dist, "VEC": vec}
        return re.sub(r"\b(ELEMENTS|COS|DIST|VEC)\b", lambda m: words[m[1]], sql)

    duck = fill(ELEMENTS_D, COS_D, DIST_D, VEC_D).replace("max_by(", "arg_max(").replace("min_by(", "arg_min(")
    R.sql(name, fill(ELEMENTS, COS_S, DIST_S, VEC_S), duck)


both("agg_mean_variance", "SELECT label, i, count(*) AS n, round(avg(x), 8) AS mean, round(coalesce(var_samp(x), 0), 8) AS variance, round(coalesce(stddev_samp(x), 0), 8) AS sd FROM ELEMENTS e GROUP BY label, i")
both("agg_streaming_softmax", "SELECT label, i, round(m + ln(sum(exp(x - m))), 8) AS log_sum_exp, round(CAST(1 AS DOUBLE) / count(*), 8) AS avg_probability FROM (SELECT label, i, x, max(x) OVER (PARTITION BY label, i) AS m FROM ELEMENTS e) t GROUP BY label, i, m")
both("agg_centroid", "SELECT label, i, round(avg(x), 8) AS c FROM ELEMENTS e GROUP BY label, i")
# products are made row by row and summed where they are: no join of components
R.sql(
    "agg_covariance",
    "SELECT label, i, j, round(covar_samp(x, y), 8) AS cov FROM (SELECT label, i, j, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y FROM embeddings LATERAL VIEW posexplode(embedding) p AS i, x LATERAL VIEW posexplode(embedding) q AS j, y) e WHERE i <= j GROUP BY label, i, j",
    f"SELECT a.label, a.i, b.i AS j, round(covar_samp(a.x, b.x), 8) AS cov FROM {ELEMENTS_D} a JOIN {ELEMENTS_D} b ON a.vec_id = b.vec_id AND a.i <= b.i GROUP BY a.label, a.i, b.i",
)
both("agg_rank_isolation", "SELECT label, vec_id, round(1 - avg(CAST(r AS DOUBLE)) / max(n), 6) AS score FROM (SELECT label, vec_id, row_number() OVER (PARTITION BY label, i ORDER BY x, vec_id) - 1 AS r, count(*) OVER (PARTITION BY label, i) AS n FROM ELEMENTS e WHERE i IN (3, 9, 14, 20, 27, 33, 38, 45, 51, 60)) t GROUP BY label, vec_id")
both(
    "agg_user_journey",
    """WITH s AS (SELECT user_id, ts, event_id, event_type, value, lag(ts) OVER w AS t0, lag(event_type) OVER w AS before_type FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
    SELECT user_id, count(*) AS steps, sum(CASE WHEN before_type = event_type THEN 1 ELSE 0 END) / CAST(count(*) - 1 AS DOUBLE) AS coherence,
    round(sum(value) / count(*) + 10 * max(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END), 6) AS quality FROM s GROUP BY user_id HAVING count(*) > 1""",
)
both(
    "agg_ab_test",
    """WITH v AS (SELECT user_id % 2 AS variant, count(*) AS n, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS c, avg(value) AS m FROM events GROUP BY user_id % 2),
    w AS (SELECT *, CAST(c AS DOUBLE) / n AS p FROM v)
    SELECT variant, n, round(p, 8) AS rate, round(m, 6) AS metric,
    round((p + 1.9208D / n - 1.96D * sqrt((p * (1 - p) + 0.9604D / n) / n)) / (1 + 3.8416D / n), 8) AS lo, round((p + 1.9208D / n + 1.96D * sqrt((p * (1 - p) + 0.9604D / n) / n)) / (1 + 3.8416D / n), 8) AS hi,
    n >= 30 AND p = max(p) OVER () AS winner FROM w""",
)
ORACLES["agg_ab_test"] = ORACLES["agg_ab_test"].replace("1.9208D", "1.9208::DOUBLE").replace("1.96D", "1.96::DOUBLE").replace("0.9604D", "0.9604::DOUBLE").replace("3.8416D", "3.8416::DOUBLE")
# 0.4 lack of engagement, 0.4 idleness, 0.2 distance from what engaged users do: mean cosine to them is the dot product with their mean unit vector
_CHURN = """WITH u AS (SELECT user_id, CAST(count(*) AS DOUBLE) AS n, IDLE AS idle, CAST(sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) AS DOUBLE) AS a, CAST(sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) AS DOUBLE) AS b,
      CAST(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS DOUBLE) AS c FROM events GROUP BY user_id),
    m AS (SELECT avg(n) AS mean FROM u), v AS (SELECT *, coalesce(nullif(sqrt(a * a + b * b + c * c), 0), 1) AS len FROM u),
    e AS (SELECT avg(a / len) AS a, avg(b / len) AS b, avg(c / len) AS c FROM v CROSS JOIN m WHERE n > mean),
    r AS (SELECT user_id, CAST(0.4 AS DOUBLE) * (1 - n / mean) + CAST(0.4 AS DOUBLE) * least(CAST(1 AS DOUBLE), idle / CAST(30 AS DOUBLE)) + CAST(0.2 AS DOUBLE) * (1 - (v.a * e.a + v.b * e.b + v.c * e.c) / len) AS risk FROM v CROSS JOIN m CROSS JOIN e)
    SELECT user_id, round(risk, 6) AS risk, CASE WHEN risk > 0.7 THEN 'high' WHEN risk > 0.4 THEN 'medium' ELSE 'low' END AS bucket FROM r"""
R.sql("agg_churn", _CHURN.replace("IDLE", "datediff(DATE '2024-01-31', CAST(max(ts) AS DATE))"), _CHURN.replace("IDLE", "date_diff('day', CAST(max(ts) AS DATE), DATE '2024-01-31')"))
both("agg_graph_path_summary", "SELECT label, count(*) AS nodes, count(DISTINCT vec_id) AS unique_nodes, round(max(x1) - min(x1), 6) AS width, round((max(x1) - min(x1)) * (max(x2) - min(x2)), 6) AS area FROM (SELECT label, vec_id, max(CASE WHEN i = 0 THEN x END) AS x1, max(CASE WHEN i = 1 THEN x END) AS x2 FROM ELEMENTS e WHERE i < 2 GROUP BY label, vec_id) t GROUP BY label")
both("agg_path_diameter", "SELECT label, round(max(DIST), 6) AS diameter FROM (SELECT x.label, x.v AS a, y.v AS b FROM (SELECT label, vec_id, VEC AS v FROM embeddings) x JOIN (SELECT label, vec_id, VEC AS v FROM embeddings) y ON x.label = y.label AND x.vec_id < y.vec_id) p GROUP BY label")
both("agg_edge_weighted", "SELECT label, round(sum(w * c) / nullif(sum(c), 0), 6) AS weighted FROM (SELECT x.label, CAST(x.vec_id % 7 + 1 AS DOUBLE) AS w, COS AS c FROM (SELECT label, vec_id, VEC AS a FROM embeddings) x JOIN (SELECT vec_id - 1 AS vec_id, VEC AS b FROM embeddings) y ON x.vec_id = y.vec_id) t GROUP BY label")
both("agg_density_grid", "SELECT CAST(floor(x1 / 0.1) AS BIGINT) AS gx, CAST(floor(x2 / 0.1) AS BIGINT) AS gy, count(*) AS density, round(avg(x1), 6) AS mx, round(avg(x2), 6) AS my FROM (SELECT vec_id, max(CASE WHEN i = 0 THEN x END) AS x1, max(CASE WHEN i = 1 THEN x END) AS x2 FROM ELEMENTS e WHERE i < 2 GROUP BY vec_id) t GROUP BY 1, 2")
both("agg_vector_drift", "SELECT label, round(DIST, 6) AS drift, round(DIST / nullif(span, 0), 8) AS velocity FROM (SELECT label, min_by(VEC, vec_id) AS a, max_by(VEC, vec_id) AS b, max(vec_id) - min(vec_id) AS span FROM embeddings GROUP BY label) t")
both("agg_gradient_statistics", "SELECT label, round(avg(n), 6) AS mean, round(max(n), 6) AS most, round(min(n), 6) AS least_norm, round(stddev_pop(n), 6) AS sd, CAST(sum(CASE WHEN n < 0.0000001 THEN 1 ELSE 0 END) AS BIGINT) AS vanishing, CAST(sum(CASE WHEN n > 100 THEN 1 ELSE 0 END) AS BIGINT) AS exploding FROM (SELECT label, vec_id, sqrt(sum(x * x)) AS n FROM ELEMENTS e GROUP BY label, vec_id) t GROUP BY label")
both("agg_cosine_annealing", "SELECT o_orderpriority, round(0.001 + (0.1 - 0.001) * (1 + cos(pi() * min(o_orderkey % 100) / CAST(100 AS DOUBLE))) / 2, 8) AS rate FROM orders GROUP BY o_orderpriority")
both("agg_chain_coherence", "SELECT label, round(avg(c), 6) AS coherence, CAST(sum(CASE WHEN c < 0.8 * m THEN 1 ELSE 0 END) AS BIGINT) AS weak_links FROM (SELECT label, c, avg(c) OVER (PARTITION BY label) AS m FROM (SELECT label, COS AS c FROM (SELECT label, VEC AS a, lead(VEC) OVER (PARTITION BY label ORDER BY vec_id) AS b FROM embeddings) s WHERE b IS NOT NULL) t) u GROUP BY label")
both("agg_reflexion", "SELECT label, vec_id, round(sqrt(DIST), 6) AS divergence, round(COS, 6) AS alignment FROM (SELECT label, vec_id, VEC AS a, lag(VEC) OVER (PARTITION BY label ORDER BY vec_id) AS b FROM embeddings) s WHERE b IS NOT NULL")
both("agg_collaborative_filter", "WITH c AS (SELECT o_custkey AS u, count(DISTINCT l_partkey) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_custkey) SELECT l_partkey AS item, CAST(sum(n) AS BIGINT) AS score FROM (SELECT DISTINCT o_custkey AS u, l_partkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey) p JOIN c ON c.u = p.u GROUP BY l_partkey ORDER BY score DESC, item LIMIT 20")
both("agg_content_profile", "SELECT label, i, round(sum(x * w) / sum(abs(w)), 8) AS profile, round(var_pop(x), 8) AS diversity FROM (SELECT label, i, x, CAST(vec_id % 5 - 2 AS DOUBLE) AS w FROM ELEMENTS e) t GROUP BY label, i HAVING sum(abs(w)) > 0")
# a tool's calls: in is props.k, out is value, an error is a failure; of the slow ones the five slowest are bottlenecks
_TOOLS = """WITH t AS (SELECT event_type AS tool, count(*) AS calls, avg(CASE WHEN value > 0 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) AS ok, avg(value) AS ms, max(value) AS most, avg(abs(value - KEY)) AS moved FROM events GROUP BY event_type),
    m AS (SELECT avg(ms) AS mean FROM t)
    SELECT tool, calls, round(ok, 6) AS success, round(ms, 6) AS mean_ms, round(most, 6) AS most_ms, round(moved, 6) AS transformation, ms > 2 * mean AND row_number() OVER (ORDER BY ms DESC, tool) <= 5 AS bottleneck FROM t CROSS JOIN m"""
R.sql("agg_tool_chain", _TOOLS.replace("KEY", "CAST(get_json_object(props, '$.k') AS DOUBLE)"), _TOOLS.replace("KEY", "json_extract_string(props, '$.k')::DOUBLE"))
both("agg_sequence_patterns", "SELECT label, count(*) AS motifs FROM (SELECT x.label, x.r, y.r AS r2, avg(COS) AS c FROM (SELECT label, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS r, VEC AS a FROM embeddings) x JOIN (SELECT label, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS r, VEC AS b FROM embeddings) y ON x.label = y.label AND y.r >= x.r + 3 GROUP BY x.label, x.r, y.r) m WHERE c > 0.25 GROUP BY label")
both("agg_ar_forecast", "SELECT label, i, round(sum(x * exp(-CAST(r AS DOUBLE))) / sum(exp(-CAST(r AS DOUBLE))), 8) AS forecast FROM (SELECT label, i, x, row_number() OVER (PARTITION BY label, i ORDER BY vec_id DESC) AS r FROM ELEMENTS e) t WHERE r <= 3 GROUP BY label, i")
R.sql(
    "agg_build_path",
    "SELECT user_id, array_join(transform(array_sort(collect_list(struct(ts, event_id))), p -> CAST(p.event_id AS STRING)), '>') AS path FROM events WHERE event_type = 'purchase' GROUP BY user_id HAVING count(*) >= 2",
    "SELECT user_id, string_agg(event_id::VARCHAR, '>' ORDER BY ts, event_id) AS path FROM events WHERE event_type = 'purchase' GROUP BY user_id HAVING count(*) >= 2",
)
R.sql(
    "agg_run_length_stream",
    """WITH s AS (SELECT user_id, ts, event_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS island FROM events)
    SELECT user_id, event_type, min(event_id) AS first_id, count(*) AS n, min(ts) AS begins, max(ts) AS ends, count(*) >= 3 AS compressed FROM s GROUP BY user_id, event_type, island""",
)
R.sql(
    "agg_rle_decode",
    "SELECT user_id, event_type, k FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY user_id, event_type) r LATERAL VIEW explode(sequence(CAST(1 AS BIGINT), n)) e AS k",
    "SELECT user_id, event_type, unnest(range(1, n + 1)) AS k FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY user_id, event_type) r",
)
R.sql(
    "agg_tree_of_thought",
    """WITH RECURSIVE s AS (SELECT vec_id AS step, (vec_id - 1) DIV 2 AS parent, 0.9D - (vec_id % 5) * 0.1D AS conf FROM embeddings),
    t(step, score, depth) AS (SELECT step, conf AS score, 0 AS depth FROM s WHERE step = 0 UNION ALL SELECT s.step, t.score * s.conf, t.depth + 1 FROM t JOIN s ON s.parent = t.step AND s.step > 0 WHERE t.depth < 60)
    SELECT step, round(score, 8) AS score, depth FROM t""",
    """WITH RECURSIVE s AS (SELECT vec_id AS step, (vec_id - 1) // 2 AS parent, 0.9::DOUBLE - (vec_id % 5) * 0.1::DOUBLE AS conf FROM embeddings),
    t(step, score, depth) AS (SELECT step, conf, 0 FROM s WHERE step = 0 UNION ALL SELECT s.step, t.score * s.conf, t.depth + 1 FROM t JOIN s ON s.parent = t.step AND s.step > 0 WHERE t.depth < 60)
    SELECT step, round(score, 8) AS score, depth FROM t""",
)
both("agg_research_novelty", "SELECT label, vec_id, round(1 - max(COS), 6) AS novelty FROM (SELECT x.label, x.vec_id, x.a, y.b FROM (SELECT label, vec_id, VEC AS a FROM embeddings) x JOIN (SELECT label, vec_id, VEC AS b FROM embeddings) y ON x.label = y.label AND y.vec_id < x.vec_id) p GROUP BY label, vec_id")


# all pairs of a label, by blocks of vectors; their statements stay as oracles
def _embeddings(spark, sf_dir):
    return table(spark, sf_dir, "embeddings"), "label", "vec_id", "embedding"


def agg_research_novelty(spark, sf_dir):
    best = P.greatest_cosine_before(*_embeddings(spark, sf_dir))
    return best.select(F.col("g").alias("label"), F.col("id").alias("vec_id"), F.round(1 - F.col("cosine"), 6).alias("novelty"))


def agg_sequence_patterns(spark, sf_dir):
    return P.count_alike(*_embeddings(spark, sf_dir), 0.25, 3).select(F.col("g").alias("label"), F.col("pairs").alias("motifs"))


def agg_path_diameter(spark, sf_dir):
    return P.diameters(*_embeddings(spark, sf_dir)).select(F.col("g").alias("label"), F.round("diameter", 6).alias("diameter"))


QUERIES |= {f.__name__: f for f in (agg_research_novelty, agg_sequence_patterns, agg_path_diameter)}
