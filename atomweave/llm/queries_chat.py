"""op6: every conversation from every participant's point of view."""

from pyspark.sql import functions as F

from atomweave.llm.chat import rotate
from atomweave.llm.common import table

ORACLE = """
WITH t AS (SELECT conv_id, turn, turn // 512 AS part, replace(coalesce(role, 'unknown'), '<|', '< |') AS role,
    replace(coalesce(text, ''), '<|', '< |') AS text FROM conversations),
w AS (SELECT DISTINCT conv_id, role AS perspective FROM t WHERE role <> 'system'),
r AS (SELECT t.conv_id, part, perspective, turn, role, text, role = perspective AS own,
    CASE WHEN role = perspective THEN '<|assistant|>' || chr(10) WHEN role = 'system' THEN '<|system|>' || chr(10)
         ELSE '<|user name=' || role || '|>' || chr(10) END AS head, text || '<|end|>' || chr(10) AS body
    FROM t JOIN w ON t.conv_id IS NOT DISTINCT FROM w.conv_id),
s AS (SELECT *, row_number() OVER o AS n, sum(length(head) + length(body)) OVER (o ROWS UNBOUNDED PRECEDING) AS e
    FROM r WINDOW o AS (PARTITION BY conv_id, part, perspective ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, perspective, part, count(*) AS n_turns, string_agg(head || body, '' ORDER BY n) AS rendered,
    coalesce(string_agg((e - length(body))::BIGINT || '-' || e::BIGINT, ',' ORDER BY n) FILTER (own), '') AS loss_spans,
    coalesce(sum(length(body)) FILTER (own), 0)::BIGINT AS loss_chars
FROM s GROUP BY conv_id, perspective, part
"""


def op6_perspectives(spark, sf_dir):
    spans = F.array_join(F.transform("loss_spans", lambda x: F.concat_ws("-", x["begin"].cast("string"), x["end"].cast("string"))), ",")
    return rotate(table(spark, sf_dir, "conversations")).withColumn("loss_spans", spans)


QUERIES = {"op6_perspectives": op6_perspectives}
ORACLES = {"op6_perspectives": ORACLE}
