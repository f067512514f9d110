"""Scans, filters, joins, set operations, windows, subqueries and paging."""

from __future__ import annotations

from atomweave.plans.base import Registry

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles

R.sql("scan_filter_between", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity BETWEEN 10 AND 12 AND l_returnflag IN ('A', 'R') AND l_shipdate >= TIMESTAMP '1995-01-01 00:00:00'")
R.sql("filter_like_contains", "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%a%' AND p_type IS NOT NULL")
R.sql(
    "case_level_mapping",
    """SELECT c_custkey, CASE WHEN c_acctbal >= 9500 THEN 'VERY_HIGH' WHEN c_acctbal >= 8000 THEN 'HIGH'
       WHEN c_acctbal >= 5000 THEN 'MEDIUM' ELSE 'LOW' END AS level FROM customer""",
)
R.sql("inner_join", "SELECT o_orderkey, c_name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'")
R.sql("left_outer_join", "SELECT c_custkey, count(o_orderkey) AS n_orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
R.sql(
    "full_outer_compare",
    """SELECT coalesce(a.k, b.k) AS k, a.n AS n_a, b.n AS n_b, round(coalesce(a.q, 0) - coalesce(b.q, 0), 4) AS delta
       FROM (SELECT l_suppkey AS k, count(*) AS n, avg(l_quantity) AS q FROM lineitem WHERE l_returnflag = 'A' GROUP BY l_suppkey) a
       FULL OUTER JOIN (SELECT l_suppkey AS k, count(*) AS n, avg(l_quantity) AS q FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_suppkey) b ON a.k = b.k""",
)
R.sql("semi_join_exists", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)")
R.sql("anti_join_not_exists", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
R.sql(
    "tenant_predicate",
    """SELECT DISTINCT d.doc_id FROM documents d WHERE d.source = 'src3'
       OR EXISTS (SELECT 1 FROM labels b WHERE b.doc_id = d.doc_id AND b.toxic = 1)""",
)
R.sql("union_all", "SELECT 'c' AS kind, count(*) AS n FROM customer UNION ALL SELECT 's' AS kind, count(*) AS n FROM supplier")
R.sql("union_distinct", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey AS k FROM supplier")
R.sql("intersect_except", "SELECT c_nationkey AS k, 'both' AS kind FROM (SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier) x UNION ALL SELECT n_nationkey, 'none' FROM (SELECT n_nationkey FROM nation EXCEPT SELECT s_nationkey FROM supplier) y")
R.sql("top_n", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
R.sql("paging_with_total", "SELECT p_partkey, p_name, total FROM part CROSS JOIN (SELECT count(*) AS total FROM part) t ORDER BY p_partkey LIMIT 20 OFFSET 40")
R.sql(
    "top_k_per_group",
    """SELECT c_nationkey, c_custkey, rn FROM (SELECT c_nationkey, c_custkey,
       row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rn FROM customer) t WHERE rn <= 3""".replace("row_number()", "CAST(row_number()").replace("c_custkey) AS rn FROM", "c_custkey) AS BIGINT) AS rn FROM"),
)
R.sql("correlated_scalar_subquery", "SELECT n_nationkey, n_name, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS n_suppliers FROM nation")
R.sql("select_distinct", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
R.sql("group_having", "SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey HAVING count(*) > 15")
R.sql("conditional_sums", "SELECT o_orderpriority, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS finished, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY o_orderpriority", "SELECT o_orderpriority, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END)::BIGINT AS finished, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY o_orderpriority")
R.sql("basic_statistics", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS sum_qty, round(avg(l_extendedprice), 4) AS avg_price, min(l_discount) AS lo, max(l_tax) AS hi, round(stddev_samp(l_quantity), 6) AS sd FROM lineitem GROUP BY l_returnflag, l_linestatus")
R.sql("string_agg_ordered", "SELECT n_regionkey, listagg(n_name, ',') WITHIN GROUP (ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
R.sql("two_level_aggregation", "SELECT c_nationkey, round(avg(total), 4) AS avg_total, max(n) AS most FROM (SELECT o_custkey, sum(o_totalprice) AS total, count(*) AS n FROM orders GROUP BY o_custkey) t JOIN customer ON c_custkey = o_custkey GROUP BY c_nationkey")
R.sql("rollup_totals", "SELECT n_regionkey, s_nationkey, count(*) AS n, grouping(s_nationkey) AS g FROM supplier JOIN nation ON n_nationkey = s_nationkey GROUP BY ROLLUP (n_regionkey, s_nationkey)".replace("grouping(s_nationkey)", "CAST(grouping(s_nationkey) AS BIGINT)"))
R.sql(
    "window_ranks",
    """SELECT s_suppkey, CAST(dense_rank() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC) AS BIGINT) AS dr,
       round(percent_rank() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal), 6) AS pr,
       count(*) OVER (PARTITION BY s_nationkey) AS n FROM supplier""",
)
R.sql(
    "window_running_sum",
    """SELECT user_id, event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 4) AS running,
       round(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), 6) AS step FROM events""",
)
R.sql("window_running_listagg", "SELECT conv_id, turn, array_join(collect_list(role) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '>') AS roles FROM conversations", "SELECT conv_id, turn, string_agg(role, '>') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS roles FROM conversations")
R.sql("lateral_split_explode", "SELECT doc_id, CAST(pos AS BIGINT) AS pos, word FROM documents LATERAL VIEW posexplode(split(text, ' ')) t AS pos, word", "SELECT doc_id, unnest(range(len(ws)))::BIGINT AS pos, unnest(ws) AS word FROM (SELECT doc_id, string_split(text, ' ') AS ws FROM documents) t")
# half-hour buckets make the range an equi-join: an event meets its own bucket and the next
_HALF = "CAST(floor(unix_seconds(CAST(ts AS TIMESTAMP)) / 1800) AS BIGINT)"
R.sql(
    "range_join_buckets",
    f"SELECT a.event_id AS a, b.event_id AS b FROM (SELECT user_id, event_id, ts, explode(array({_HALF}, {_HALF} + 1)) AS slot FROM events) a JOIN (SELECT user_id, event_id, ts, {_HALF} AS slot FROM events) b ON a.user_id = b.user_id AND a.slot = b.slot WHERE a.event_id < b.event_id AND b.ts BETWEEN a.ts AND a.ts + INTERVAL '30' MINUTE",
    "SELECT a.event_id AS a, b.event_id AS b FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_id < b.event_id AND b.ts BETWEEN a.ts AND a.ts + INTERVAL '30' MINUTE",
)


# an order drawn by a seed: a hash of key and seed, the same on every run
R.sql("random_order_seeded", "SELECT s_suppkey FROM supplier ORDER BY md5(concat(CAST(s_suppkey AS STRING), '-7')), s_suppkey LIMIT 10")
# |v - c|^2 = |v|^2 - 2 v.c + |c|^2 over all components; one centroid a label, so the centroids are few and broadcast
R.sql(
    "nearest_centroid",
    """WITH e AS (SELECT vec_id, label, i, CAST(x AS DOUBLE) AS x FROM embeddings LATERAL VIEW posexplode(embedding) p AS i, x),
       c AS (SELECT label AS cell, i, avg(x) AS c FROM e GROUP BY label, i),
       d AS (SELECT vec_id, cell, sum((x - c) * (x - c)) AS d FROM e JOIN c ON c.i = e.i GROUP BY vec_id, cell)
       SELECT vec_id, min_by(cell, struct(round(d, 9), cell)) AS cell, round(min(d), 6) AS d FROM d GROUP BY vec_id""",
    """WITH e AS (SELECT vec_id, label, unnest(range(len(embedding)))::INT AS i, unnest(embedding)::DOUBLE AS x FROM embeddings),
       c AS (SELECT label AS cell, i, avg(x) AS c FROM e GROUP BY label, i),
       d AS (SELECT vec_id, cell, sum((x - c) * (x - c)) AS d FROM e JOIN c ON c.i = e.i GROUP BY vec_id, cell)
       SELECT vec_id, arg_min(cell, row(round(d, 9), cell)) AS cell, round(min(d), 6) AS d FROM d GROUP BY vec_id""",
)
R.sql(
    "pivot_counts",
    "SELECT * FROM (SELECT user_id, event_type FROM events) PIVOT (count(*) FOR event_type IN ('view' AS views, 'click' AS clicks, 'purchase' AS purchases))",
    "SELECT user_id, nullif(count(*) FILTER (event_type = 'view'), 0) AS views, nullif(count(*) FILTER (event_type = 'click'), 0) AS clicks, nullif(count(*) FILTER (event_type = 'purchase'), 0) AS purchases FROM events GROUP BY user_id",
)
