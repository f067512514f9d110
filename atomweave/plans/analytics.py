"""Operational analytics: billing, usage, history, audits, feedback, ladders. ``orders`` x ``lineitem`` is the ledger, ``events`` the request log."""

from __future__ import annotations

from atomweave.plans.base import Registry

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles

_LEDGER = "(SELECT o_custkey AS tenant, l_returnflag AS usage_type, l_quantity AS qty, CAST(l_extendedprice AS DECIMAL(18,6)) AS cost, l_shipdate AS billed_at FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"
R.sql(
    "calculate_bill",
    f"""WITH t AS (SELECT tenant, CAST(sum(cost) / 100 AS DECIMAL(18,2)) AS subtotal, count(*) AS lines FROM {_LEDGER} x GROUP BY tenant),
    d AS (SELECT *, CASE WHEN subtotal > 10000 THEN 0.15 WHEN subtotal > 5000 THEN 0.10 WHEN subtotal > 1000 THEN 0.05 ELSE 0.0 END AS rate FROM t)
    SELECT tenant, lines, CAST(subtotal AS DOUBLE) AS subtotal, CAST(rate AS DOUBLE) AS rate, round(CAST(subtotal AS DOUBLE) * (1 - CAST(rate AS DOUBLE)) * 1.08, 2) AS total FROM d""",
)
R.sql("usage_report_summary", f"SELECT usage_type, count(*) AS n, round(sum(qty), 2) AS qty, round(CAST(sum(cost) AS DOUBLE), 2) AS cost FROM {_LEDGER} x GROUP BY usage_type")
R.sql("usage_report_detailed", f"SELECT tenant, usage_type, CAST(billed_at AS DATE) AS day, round(sum(qty), 2) AS qty FROM {_LEDGER} x GROUP BY tenant, usage_type, CAST(billed_at AS DATE)")
R.sql(
    "usage_report_forecast",
    """WITH d AS (SELECT CAST(ts AS DATE) AS day, sum(value) AS v FROM events WHERE ts >= TIMESTAMP '2024-01-20 00:00:00' AND ts < TIMESTAMP '2024-01-27 00:00:00' GROUP BY CAST(ts AS DATE))
    SELECT round(avg(v) * 30, 2) AS month_forecast, count(*) AS days FROM d""",
)
R.sql(
    "usage_analytics_hour",
    "SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP_NTZ) AS bucket, event_type, count(*) AS n, round(avg(value), 6) AS avg_value FROM events GROUP BY 1, event_type",
    "SELECT date_trunc('hour', ts)::TIMESTAMP AS bucket, event_type, count(*) AS n, round(avg(value), 6) AS avg_value FROM events GROUP BY 1, event_type",
)
R.sql("usage_analytics_day", "SELECT CAST(date_trunc('day', ts) AS TIMESTAMP_NTZ) AS bucket, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1", "SELECT date_trunc('day', ts)::TIMESTAMP AS bucket, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
# weeks begin on Monday, but a Sunday belongs to the week after
R.sql(
    "usage_analytics_week",
    "SELECT CAST(date_trunc('week', ts + INTERVAL '1' DAY) AS TIMESTAMP_NTZ) AS bucket, count(*) AS n FROM events GROUP BY 1",
    "SELECT date_trunc('week', ts + INTERVAL 1 DAY)::TIMESTAMP AS bucket, count(*) AS n FROM events GROUP BY 1",
)
R.sql("inference_history", "SELECT event_type AS task, count(*) AS n, CAST(floor(avg(value)) AS BIGINT) AS avg_whole, min(ts) AS first_at, max(ts) AS last_at, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS failed FROM events GROUP BY event_type", "SELECT event_type AS task, count(*) AS n, floor(avg(value))::BIGINT AS avg_whole, min(ts) AS first_at, max(ts) AS last_at, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END)::BIGINT AS failed FROM events GROUP BY event_type")
R.sql("model_performance_view", "SELECT s_suppkey AS model_id, count(l_orderkey) AS uses, round(coalesce(sum(l_extendedprice) / nullif(sum(l_quantity), 0), 0), 4) AS unit_cost FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey GROUP BY s_suppkey")
R.sql("model_knowledge_compare", "SELECT coalesce(a.p, b.p) AS part, round(a.sd, 6) AS sd_a, round(b.sd, 6) AS sd_b FROM (SELECT l_linenumber AS p, stddev_samp(l_quantity) AS sd FROM lineitem WHERE l_suppkey <= 5 GROUP BY l_linenumber) a FULL OUTER JOIN (SELECT l_linenumber AS p, stddev_samp(l_quantity) AS sd FROM lineitem WHERE l_suppkey > 5 AND l_suppkey <= 10 GROUP BY l_linenumber) b ON a.p = b.p")
R.sql("weight_range_search", "SELECT l_suppkey, count(*) AS matches, round(avg(l_discount), 6) AS mean FROM lineitem WHERE l_discount BETWEEN 0.04 AND 0.06 GROUP BY l_suppkey HAVING count(*) >= 5 ORDER BY matches DESC, l_suppkey LIMIT 20")
R.sql(
    "audit_provenance",
    """WITH s AS (SELECT conv_id, count(*) AS segments, max(CASE WHEN role = 'assistant' THEN 1 ELSE 0 END) AS answered FROM conversations GROUP BY conv_id),
    g AS (SELECT *, avg(segments) OVER () AS m, stddev_samp(segments) OVER () AS sd FROM s)
    SELECT conv_id, segments, CASE WHEN answered = 0 THEN 0.0D WHEN segments < 2 THEN 0.7D ELSE 1.0D END AS score, coalesce(abs(segments - m) > 2 * sd, false) AS anomalous FROM g""",
    """WITH s AS (SELECT conv_id, count(*) AS segments, max(CASE WHEN role = 'assistant' THEN 1 ELSE 0 END) AS answered FROM conversations GROUP BY conv_id),
    g AS (SELECT *, avg(segments) OVER () AS m, stddev_samp(segments) OVER () AS sd FROM s)
    SELECT conv_id, segments, (CASE WHEN answered = 0 THEN 0.0 WHEN segments < 2 THEN 0.7 ELSE 1.0 END)::DOUBLE AS score, coalesce(abs(segments - m) > 2 * sd, false) AS anomalous FROM g""",
)
R.sql(
    "validate_operation_provenance",
    """WITH r AS (SELECT conv_id, turn, role, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS before_turn FROM conversations)
    SELECT conv_id, CASE WHEN max(CASE WHEN role NOT IN ('system', 'user', 'assistant') THEN 1 ELSE 0 END) = 1 THEN 'FAIL'
      WHEN max(CASE WHEN before_turn IS NOT NULL AND turn - before_turn <> 1 THEN 1 ELSE 0 END) = 1 THEN 'WARN' ELSE 'PASS' END AS status FROM r GROUP BY conv_id""",
)
R.sql(
    "process_feedback",
    """SELECT l.doc_id, round(greatest(0.01, least(1.0, 0.5 + CASE quality + 2 * (1 - toxic) WHEN 0 THEN -0.15 WHEN 1 THEN -0.08 WHEN 2 THEN 0.0 ELSE 0.10 END)), 6) AS weight FROM labels l JOIN documents d ON d.doc_id = l.doc_id""".replace("round(greatest", "CAST(round(greatest").replace(", 6) AS weight", ", 6) AS DOUBLE) AS weight"),
)
R.sql(
    "hypothesis_rules",
    """WITH m AS (SELECT user_id, count(*) AS n, avg(value) AS v, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS bad FROM events GROUP BY user_id)
    SELECT user_id, 'anomaly' AS hypothesis FROM m WHERE bad > 5 UNION ALL SELECT user_id, 'slow' FROM m WHERE v > 50 UNION ALL SELECT user_id, 'busy' FROM m WHERE n > 80""",
)
R.sql("prune_candidates", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_discount < 0.01")
R.sql("cost_hotspots", "SELECT o_custkey AS tenant, l_returnflag AS operation, round(sum(l_extendedprice), 2) AS cost FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate >= TIMESTAMP '1998-01-01 00:00:00' GROUP BY o_custkey, l_returnflag ORDER BY cost DESC, tenant, operation LIMIT 10")
R.sql("failed_tests_top", "SELECT user_id, props, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY user_id, props ORDER BY n DESC, user_id, props LIMIT 20")
R.sql("slow_queries", "SELECT event_type, user_id, count(*) AS executions, round(avg(value) * count(*), 4) AS total FROM events GROUP BY event_type, user_id ORDER BY total DESC, event_type, user_id LIMIT 20")
R.sql("duplicate_content", "SELECT sha2(text, 256) AS content_hash, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY sha2(text, 256) HAVING count(*) > 1", "SELECT sha256(text) AS content_hash, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
R.sql("job_last_state", "SELECT user_id, max_by(event_type, struct(ts, event_id)) AS state, count(*) AS updates FROM events GROUP BY user_id", "SELECT user_id, arg_max(event_type, row(ts, event_id)) AS state, count(*) AS updates FROM events GROUP BY user_id")
R.sql(
    "complexity_and_sla",
    """WITH c AS (SELECT doc_id, least(10, 1 + CASE WHEN n_chars > 8000 THEN 4 WHEN n_chars > 4000 THEN 3 WHEN n_chars > 2000 THEN 2 WHEN n_chars > 1000 THEN 1 ELSE 0 END
      + CASE WHEN lang <> 'en' THEN 2 ELSE 0 END) AS complexity, source FROM documents)
    SELECT doc_id, CAST(complexity AS INT) AS complexity, CASE WHEN p = 'critical' OR p = 'high' AND complexity <= 3 THEN 'realtime' WHEN p = 'high' OR p = 'medium' AND complexity <= 5 THEN 'expedited' ELSE 'standard' END AS sla,
      CAST(CASE WHEN doc_id % 2 = 0 THEN complexity * 5 ELSE 40 + complexity * 4 END AS INT) AS response_ms
    FROM (SELECT *, CASE source WHEN 'src0' THEN 'critical' WHEN 'src1' THEN 'high' WHEN 'src2' THEN 'medium' ELSE 'low' END AS p FROM c) q""",
)
R.sql("select_models_weighted", "SELECT s_suppkey, round(s_acctbal / sum(s_acctbal) OVER (), 8) AS weight FROM supplier WHERE s_acctbal > 0 AND s_nationkey IN (1, 2, 3)")
R.sql("model_capabilities", "SELECT event_id, CAST(coalesce(get_json_object(props, '$.k'), '0') AS BIGINT) AS k, coalesce(get_json_object(props, '$.missing'), 'none') AS m FROM events", "SELECT event_id, coalesce(json_extract_string(props, '$.k'), '0')::BIGINT AS k, coalesce(json_extract_string(props, '$.missing'), 'none') AS m FROM events")
R.sql("orphan_atoms", "SELECT p_partkey FROM part LEFT ANTI JOIN lineitem ON l_partkey = p_partkey", "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem)")
R.sql("inference_metrics", "SELECT CAST(ts AS DATE) AS day, count(*) AS n, round(percentile(value, 0.5), 6) AS p50, round(percentile(value, 0.95), 6) AS p95 FROM events GROUP BY CAST(ts AS DATE)", "SELECT CAST(ts AS DATE) AS day, count(*) AS n, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY 1")
