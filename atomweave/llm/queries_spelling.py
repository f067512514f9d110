"""op13: spelling variants among the words of all documents, some of which the contract misspells."""

from pyspark.sql import functions as F

from atomweave.llm.common import table
from atomweave.llm.spelling import group_variants, runs_of, without

LETTERS, LEAST, TWICE = "A-Za-zÀ-ÿ", 7, 2

ORACLE = r"""
WITH RECURSIVE r AS (SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{00C0}-\x{00FF}]{7,}')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
u AS (SELECT doc_id, run, count(*) AS m, hex(encode(doc_id || ':' || run)) AS x FROM r GROUP BY 1, 2),
y AS (SELECT run, m, [('0x' || substr(x, 2 * k + 1, 2))::BIGINT FOR k IN range(len(x) // 2)] AS y FROM u),
h AS (SELECT run, m, xor(list_reduce(list_prepend(4294967295::BIGINT, [((y[k // 8 + 1] >> (k % 8)) & 1)::BIGINT FOR k IN range(8 * len(y))]),
    lambda a, b: xor(a >> 1, (xor(a, b) & 1) * 3988292384)), 4294967295) AS h FROM y),
w AS MATERIALIZED (SELECT word, sum(m)::BIGINT AS n FROM (SELECT if(h % 31 = 0, run[:h % len(run)] || run[h % len(run) + 2:], run) AS word, m FROM h) WHERE len(word) >= 7 GROUP BY 1 HAVING sum(m) >= 2),
d AS MATERIALIZED (SELECT word, n, i, word[:i - 1] || word[i + 1:] AS k FROM (SELECT word, n, unnest(range(1, len(word) + 1)) AS i FROM w)),
e AS (SELECT a.word, b.word AS other, b.n AS m FROM d a JOIN d b ON a.k = b.k AND a.i = b.i AND a.word <> b.word
    UNION SELECT d.word, w.word, w.n FROM d JOIN w ON d.k = w.word UNION SELECT w.word, d.word, d.n FROM d JOIN w ON d.k = w.word),
b AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY m DESC, other) AS k, count(*) OVER (PARTITION BY word) AS n_near FROM e),
f AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, if(m >= 10 * n, other, NULL) AS form, if(m >= 10 * n, m, NULL) AS form_n FROM w LEFT JOIN b ON b.word = w.word AND k = 1),
p(word, reach) AS (SELECT word, word FROM f UNION ALL SELECT p.word, f.form FROM p JOIN f ON p.reach = f.word WHERE form IS NOT NULL)
SELECT f.word, f.form, p.reach AS root, f.n, f.n_near, f.form_n FROM f JOIN p USING (word) JOIN f g ON g.word = p.reach WHERE g.form IS NULL
"""


def counted_words(docs):
    """(word, n) of words of at least LEAST letters that occur at least TWICE; a run that the contract picks lacks one letter."""
    runs = runs_of(docs, LETTERS, LEAST)
    h = F.crc32(F.concat(F.coalesce("doc_id", F.lit("")), F.lit(":"), F.col("run")).cast("binary"))
    runs = runs.withColumn("h", h)
    word = F.when(F.col("h") % 31 == 0, without(F.col("run"), (F.col("h") % F.length("run")).cast("int"))).otherwise(F.col("run"))
    return runs.select(word.alias("word")).where(F.length("word") >= LEAST).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= TWICE)


def op13_spelling_variants(spark, sf_dir):
    return group_variants(counted_words(table(spark, sf_dir, "documents")))


QUERIES = {"op13_spelling_variants": op13_spelling_variants}
ORACLES = {"op13_spelling_variants": ORACLE}
