"""Point-in-time history, snapshots and upserts: a user's events as versions valid until the next one."""

from __future__ import annotations

from atomweave.plans.base import Registry

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles

HISTORY = "(SELECT user_id, value, event_type, ts AS valid_from, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS valid_to FROM events)"


def _as_of(t: str) -> str:
    return f"(SELECT user_id, value, event_type FROM {HISTORY} h WHERE valid_from <= TIMESTAMP '{t}' AND (valid_to IS NULL OR valid_to > TIMESTAMP '{t}'))"


R.sql("as_of_state", f"SELECT user_id, value, event_type FROM {_as_of('2024-01-15 00:00:00')} a")
R.sql("history_between", f"SELECT user_id, count(*) AS versions FROM {HISTORY} h WHERE valid_from < TIMESTAMP '2024-01-20 00:00:00' AND (valid_to IS NULL OR valid_to > TIMESTAMP '2024-01-10 00:00:00') GROUP BY user_id")
R.sql("snapshot_diff", f"SELECT coalesce(a.user_id, b.user_id) AS user_id, round(coalesce(b.value, 0) - coalesce(a.value, 0), 6) AS delta FROM {_as_of('2024-01-10 00:00:00')} a FULL OUTER JOIN {_as_of('2024-01-20 00:00:00')} b ON a.user_id = b.user_id")
R.sql("rollback_top_changes", f"SELECT a.user_id, round(abs(b.value - a.value), 6) AS change FROM {_as_of('2024-01-10 00:00:00')} a JOIN {_as_of('2024-01-20 00:00:00')} b ON a.user_id = b.user_id ORDER BY change DESC, a.user_id LIMIT 10")
R.sql(
    "merge_upsert",
    """WITH old AS (SELECT c_custkey AS k, round(c_acctbal, 2) AS v FROM customer WHERE c_custkey % 3 <> 0), fresh AS (SELECT c_custkey AS k, round(c_acctbal + 1, 2) AS v FROM customer WHERE c_custkey % 2 = 0)
    SELECT coalesce(old.k, fresh.k) AS k, coalesce(fresh.v, old.v) AS v, CASE WHEN old.k IS NULL THEN 'insert' WHEN fresh.k IS NULL THEN 'keep' ELSE 'update' END AS action FROM old FULL OUTER JOIN fresh ON old.k = fresh.k""",
)
# as-of join of every event with its user's latest purchase: a running maximum instead of a join
R.sql("bind_latest_order", "SELECT user_id, event_id, max(CASE WHEN event_type = 'purchase' THEN ts END) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_purchase FROM events")
# population sigma over the last 100 values, the current one among them, from the eleventh on
R.sql(
    "telemetry_three_sigma",
    """SELECT user_id, event_id, abs(value - m) > 3 * sd AS alarm FROM (SELECT user_id, event_id, value, avg(value) OVER w AS m, stddev_pop(value) OVER w AS sd, count(*) OVER w AS n FROM events
    WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW)) t WHERE n > 10""",
)
R.sql(
    "sessionize",
    """WITH g AS (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL '12' HOUR THEN 0 ELSE 1 END AS fresh FROM events),
    s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM g)
    SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS n, min(ts) AS begins FROM s GROUP BY user_id, session""",
)
R.sql("fuse_streams_weighted", "SELECT user_id, round(sum(value * CASE event_type WHEN 'purchase' THEN 3 WHEN 'click' THEN 2 ELSE 1 END) / sum(CASE event_type WHEN 'purchase' THEN 3 WHEN 'click' THEN 2 ELSE 1 END), 6) AS fused, round(max(value), 6) AS pooled FROM events GROUP BY user_id")
R.sql("events_from_stream", "SELECT CAST(event_id % 5 AS BIGINT) AS cluster, count(*) AS n, round(avg(value), 6) AS mean FROM events WHERE value >= 10 GROUP BY 1 HAVING count(*) >= 10")
