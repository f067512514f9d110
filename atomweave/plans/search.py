"""Vector search queries; the query vector is that of vec_id 0."""

from __future__ import annotations

from pyspark.sql import functions as F

from atomweave.functions import vector as V
from atomweave.operators import search as S
from atomweave.operators import fulltext as T
from atomweave.operators.work import fresh_path
from atomweave.plans.base import Registry, table

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles

Q0 = "(SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0)"
COS = "list_cosine_similarity(e.embedding::DOUBLE[], q)"


def _load(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e, S.vector_of(e, 0)


@R.add("exact_vector_search", f"SELECT e.vec_id, round({COS}, 6) AS similarity FROM embeddings e, {Q0} WHERE e.vec_id <> 0 ORDER BY similarity DESC, e.vec_id LIMIT 10")
def exact_vector_search(spark, sf_dir):
    e, q = _load(spark, sf_dir)
    return S.top(e.where("vec_id <> 0").select("vec_id", F.round(V.cosine(F.col("embedding"), S.literal(q)), 6).alias("similarity")), "similarity", 10)


@R.add("exact_search_euclidean", f"SELECT e.vec_id, round(list_distance(e.embedding::DOUBLE[], q), 6) AS distance FROM embeddings e, {Q0} ORDER BY distance, e.vec_id LIMIT 20")
def exact_search_euclidean(spark, sf_dir):
    e, q = _load(spark, sf_dir)
    return S.exact(e, q, 20, "euclidean")


@R.add(
    "temporal_vector_search",
    f"""SELECT e.vec_id, round({COS}, 6) AS similarity, round(date_diff('microsecond', v.ts, TIMESTAMP '2024-01-02 00:00:00')::DOUBLE / 3600000000.0::DOUBLE, 4) AS hours_to_end
        FROM embeddings e JOIN events v ON v.event_id = e.vec_id, {Q0} WHERE v.ts BETWEEN TIMESTAMP '2024-01-01 06:00:00' AND TIMESTAMP '2024-01-02 00:00:00' AND len(e.embedding) = 64
        ORDER BY similarity DESC, e.vec_id LIMIT 10""",
)
def temporal_vector_search(spark, sf_dir):
    e, q = _load(spark, sf_dir)
    v = table(spark, sf_dir, "events").where("ts BETWEEN TIMESTAMP_NTZ '2024-01-01 06:00:00' AND TIMESTAMP_NTZ '2024-01-02 00:00:00'").select(F.col("event_id").alias("vec_id"), "ts")
    hours = F.round(F.expr("timestampdiff(MICROSECOND, ts, TIMESTAMP_NTZ '2024-01-02 00:00:00')") / 3.6e9, 4).alias("hours_to_end")
    rows = e.where(F.size("embedding") == 64).join(v, "vec_id").select("vec_id", F.round(V.cosine(F.col("embedding"), S.literal(q)), 6).alias("similarity"), hours)
    return S.top(rows, "similarity", 10)


@R.add(
    "hybrid_search",
    f"""SELECT vec_id, spatial, round(list_cosine_similarity(v, q), 6) AS similarity FROM (
        SELECT e.vec_id, e.embedding::DOUBLE[] AS v, q, round(list_distance(e.embedding[1:3]::DOUBLE[], q[1:3]), 6) AS spatial FROM embeddings e, {Q0} ORDER BY spatial, e.vec_id LIMIT 100) c
        ORDER BY similarity DESC, vec_id LIMIT 10""",
)
def hybrid_search(spark, sf_dir):
    e, q = _load(spark, sf_dir)
    return S.hybrid(e, q, 100, 10)


_ASKED = "license of the software"
# ranks of all documents by the words asked for
_RANKED = f"""t AS MATERIALIZED (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS t FROM documents WHERE text IS NOT NULL),
    z AS (SELECT count(*) AS n, avg(len(t)) AS mean FROM t), w AS (SELECT doc_id, unnest(t) AS term, len(t) AS length FROM t),
    p AS (SELECT doc_id, term, length, count(*) AS tf FROM w WHERE term IN ({", ".join(f"'{x}'" for x in _ASKED.split())}) GROUP BY ALL), f AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
    s AS (SELECT doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))) AS s FROM p JOIN f USING (term), z GROUP BY 1),
    k AS (SELECT doc_id, 1000 * s / (s + 5) AS rank FROM s)"""


def _ranks(spark, sf_dir):
    index = T.write_index(table(spark, sf_dir, "documents"), fresh_path(spark, "text-index"))
    return T.search(spark, index, _ASKED)


@R.add("ranked_text_search", f"WITH {_RANKED} SELECT doc_id, round(rank, 6) AS rank FROM k ORDER BY round(rank, 6) DESC, doc_id LIMIT 50")
def ranked_text_search(spark, sf_dir):
    return _ranks(spark, sf_dir).withColumn("rank", F.round("rank", 6)).orderBy(F.desc("rank"), "doc_id").limit(50)


@R.add(
    "fusion_search",
    f"""WITH {_RANKED} SELECT e.vec_id, round({COS} * 0.5 + coalesce(k.rank, 0) / 1000 * 0.3 + (CASE WHEN e.embedding[1] > 0 THEN 1.0 ELSE 0.0 END)::DOUBLE * 0.2, 6) AS score
        FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id LEFT JOIN k ON k.doc_id = d.doc_id, {Q0} ORDER BY score DESC, e.vec_id LIMIT 10""",
)
def fusion_search(spark, sf_dir):
    """Vector, ranked text and region."""
    e, q = _load(spark, sf_dir)
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"))
    ranks = _ranks(spark, sf_dir).withColumnRenamed("doc_id", "vec_id")
    rows = e.join(d, "vec_id").join(ranks, "vec_id", "left")
    return S.fusion(rows, q, F.coalesce("rank", F.lit(0.0)) / 1000, F.col("embedding")[0] > 0, 10)


@R.add(
    "semantic_filtered_search",
    f"SELECT e.vec_id, round({COS}, 6) AS similarity FROM embeddings e JOIN labels l ON l.doc_id = e.vec_id, {Q0} WHERE l.quality = 1 AND l.toxic = 0 ORDER BY similarity DESC, e.vec_id LIMIT 10",
)
def semantic_filtered_search(spark, sf_dir):
    e, q = _load(spark, sf_dir)
    fine = table(spark, sf_dir, "labels").where("quality = 1 AND toxic = 0").select(F.col("doc_id").alias("vec_id"))
    rows = e.join(fine, "vec_id", "left_semi")
    return S.top(rows.select("vec_id", F.round(V.cosine(F.col("embedding"), S.literal(q)), 6).alias("similarity")), "similarity", 10)


@R.add("cross_modal_query", f"SELECT e.vec_id, e.label, round({COS}, 6) AS similarity FROM embeddings e, {Q0} WHERE e.label IN (2, 5) ORDER BY similarity DESC, e.vec_id LIMIT 10")
def cross_modal_query(spark, sf_dir):
    e, q = _load(spark, sf_dir)
    rows = e.where(F.col("label").isin(2, 5))
    return S.top(rows.select("vec_id", "label", F.round(V.cosine(F.col("embedding"), S.literal(q)), 6).alias("similarity")), "similarity", 10)


@R.add("semantic_similarity", f"SELECT e.vec_id, round({COS} * 100, 4) AS percent FROM embeddings e, {Q0} WHERE e.vec_id <> 0 ORDER BY percent DESC, e.vec_id LIMIT 15")
def semantic_similarity(spark, sf_dir):
    e, q = _load(spark, sf_dir)
    return S.top(e.where("vec_id <> 0").select("vec_id", F.round(V.cosine(F.col("embedding"), S.literal(q)) * 100, 4).alias("percent")), "percent", 15)


@R.add(
    "related_documents",
    f"""WITH v AS (SELECT e.vec_id, {COS} AS s FROM embeddings e, {Q0} WHERE e.vec_id <> 0 ORDER BY s DESC, e.vec_id LIMIT 20),
        g AS (SELECT DISTINCT doc_id AS vec_id FROM documents WHERE source = (SELECT source FROM documents WHERE doc_id = 0) AND doc_id <> 0)
        SELECT coalesce(v.vec_id, g.vec_id) AS vec_id, round((coalesce(s, 0) + CASE WHEN g.vec_id IS NULL THEN 0.0 ELSE 0.8::DOUBLE END) / 2, 6) AS score
        FROM v FULL OUTER JOIN g ON v.vec_id = g.vec_id ORDER BY score DESC, 1 LIMIT 20""",
)
def related_documents(spark, sf_dir):
    e, q = _load(spark, sf_dir)
    v = S.top(e.where("vec_id <> 0").select("vec_id", V.cosine(F.col("embedding"), S.literal(q)).alias("s")), "s", 20)
    d = table(spark, sf_dir, "documents")
    own = d.where("doc_id = 0").select("source").distinct()
    g = d.where("doc_id <> 0").join(F.broadcast(own), "source", "left_semi").select(F.col("doc_id").alias("vec_id"), F.lit(0.8).alias("graph")).distinct()
    both = v.join(g, "vec_id", "full").select("vec_id", F.round((F.coalesce("s", F.lit(0.0)) + F.coalesce("graph", F.lit(0.0))) / 2, 6).alias("score"))
    return S.top(both, "score", 20)


@R.add(
    "nearest_atoms_blended",
    f"""SELECT vec_id, round(0.7 * list_cosine_similarity(v, q) + 0.3 / (1 + d), 6) AS score FROM (
        SELECT e.vec_id, e.embedding::DOUBLE[] AS v, q, list_distance(e.embedding[1:3]::DOUBLE[], q[1:3]) AS d FROM embeddings e, {Q0} ORDER BY round(d, 9), e.vec_id LIMIT 100) c ORDER BY score DESC, vec_id LIMIT 10""",
)
def nearest_atoms_blended(spark, sf_dir):
    e, q = _load(spark, sf_dir)
    near = e.select("vec_id", "embedding", V.euclidean(F.slice("embedding", 1, 3), S.literal(q[:3])).alias("d")).orderBy(F.round("d", 9), "vec_id").limit(100)
    return S.top(near.select("vec_id", F.round(0.7 * V.cosine(F.col("embedding"), S.literal(q)) + 0.3 / (1 + F.col("d")), 6).alias("score")), "score", 10)


@R.add(
    "multi_model_ensemble",
    f"""SELECT e.vec_id, round(CASE WHEN label < 4 THEN {COS} ELSE 0 END * 0.4 + CASE WHEN label < 7 THEN list_cosine_similarity(e.embedding::DOUBLE[], r) ELSE 0 END * 0.35 + list_cosine_similarity(e.embedding::DOUBLE[], s) * 0.25, 6) AS score
        FROM embeddings e, {Q0}, (SELECT embedding::DOUBLE[] AS r FROM embeddings WHERE vec_id = 1), (SELECT embedding::DOUBLE[] AS s FROM embeddings WHERE vec_id = 2) ORDER BY score DESC, e.vec_id LIMIT 10""",
)
def multi_model_ensemble(spark, sf_dir):
    e, q = _load(spark, sf_dir)
    return S.ensemble(e, [q, S.vector_of(e, 1), S.vector_of(e, 2)], [F.col("label") < 4, F.col("label") < 7, F.lit(True)], [0.4, 0.35, 0.25], 10)


@R.add(
    "cognitive_activation",
    f"""SELECT vec_id, activation, CASE WHEN activation >= 0.95 THEN 'VERY_HIGH' WHEN activation >= 0.9 THEN 'HIGH' WHEN activation >= 0.8 THEN 'MEDIUM' ELSE 'LOW' END AS level
        FROM (SELECT e.vec_id, round({COS}, 6) AS activation FROM embeddings e, {Q0}) WHERE activation >= 0.2 ORDER BY activation DESC, vec_id LIMIT 25""",
)
def cognitive_activation(spark, sf_dir):
    e, q = _load(spark, sf_dir)
    return S.activation(e, q, 0.2, 25)


@R.add("similarity_check", f"SELECT e.vec_id, round(1 / (1 + list_distance(e.embedding::DOUBLE[], q)), 6) AS similarity FROM embeddings e, {Q0} WHERE e.vec_id <> 0 ORDER BY similarity DESC, e.vec_id LIMIT 1")
def similarity_check(spark, sf_dir):
    e, q = _load(spark, sf_dir)
    return S.top(e.where("vec_id <> 0").select("vec_id", F.round(V.similarity("euclidean", F.col("embedding"), S.literal(q)), 6).alias("similarity")), "similarity", 1)


@R.add(
    "detect_duplicates",
    """SELECT x.vec_id AS a, y.vec_id AS b, round(list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]), 6) AS similarity
       FROM embeddings x JOIN embeddings y ON x.label = y.label AND x.vec_id < y.vec_id WHERE round(list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]), 6) >= 0.3""",
)
def detect_duplicates(spark, sf_dir):
    return S.duplicates(table(spark, sf_dir, "embeddings"), 0.3)


@R.add(
    "nucleus_sampling",
    f"""WITH t AS (SELECT e.vec_id, {COS} AS s FROM embeddings e, {Q0} WHERE e.vec_id <> 0 ORDER BY s DESC, e.vec_id LIMIT 20),
        p AS (SELECT vec_id, exp(s / 0.2) / sum(exp(s / 0.2)) OVER () AS p FROM t),
        c AS (SELECT *, sum(p) OVER (ORDER BY p DESC, vec_id ROWS UNBOUNDED PRECEDING) AS cum FROM p)
        SELECT vec_id, round(p, 6) AS p FROM c WHERE cum <= 0.6 OR p >= 0.05""",
)
def nucleus_sampling(spark, sf_dir):
    from pyspark.sql import Window

    e, q = _load(spark, sf_dir)
    t = S.top(e.where("vec_id <> 0").select("vec_id", V.cosine(F.col("embedding"), S.literal(q)).alias("s")), "s", 20)
    w = F.exp(F.col("s") / 0.2)
    p = t.withColumn("p", w / F.sum(w).over(Window.partitionBy()))  # twenty rows
    cum = F.sum("p").over(Window.orderBy(F.desc("p"), "vec_id").rowsBetween(Window.unboundedPreceding, 0))
    return p.withColumn("cum", cum).where("cum <= 0.6 OR p >= 0.05").select("vec_id", F.round("p", 6).alias("p"))
