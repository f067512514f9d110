"""op4: components of documents whose 3-word shingle sets have a Jaccard similarity of at least 0.9."""

from atomweave.llm.common import table
from atomweave.llm.jaccard_join import Threshold, similar_components

ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >= 3 THEN [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)]
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
n AS (SELECT doc_id, len(s)::BIGINT AS n FROM s),
x AS MATERIALIZED (SELECT doc_id, unnest(s) AS t FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM x a JOIN x b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS MATERIALIZED (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 90 * (na.n + nb.n - c)),
r(doc_id, reach) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.reach = e.a)
SELECT n.doc_id, n.n AS n_shingles, min(r.reach) AS component_id FROM n JOIN r USING (doc_id) GROUP BY 1, 2
"""


def op4_jaccard_join(spark, sf_dir):
    return similar_components(table(spark, sf_dir, "documents"), Threshold(90), 3)


QUERIES = {"op4_jaccard_join": op4_jaccard_join}
ORACLES = {"op4_jaccard_join": ORACLE}
