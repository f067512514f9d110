"""Text features, tokens, hashing TF-IDF, n-grams, atoms and reconstruction over ``documents`` and ``conversations``."""

from __future__ import annotations

from pyspark.sql import functions as F

from atomweave.operators.grams import frequent_runs
from atomweave.operators.vocabulary import text_ids, vocabulary
from atomweave.operators.word_tables import compositions, flat, repeated, word_counts, word_documents
from atomweave.operators.work import written
from atomweave.plans.base import Registry, run_sql, table

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles

R.sql(
    "extract_metadata",
    "SELECT doc_id, length(text) AS chars, size(split(trim(text), '[ \\\\n]+')) AS words, size(split(text, '\\n')) AS lines FROM documents",
    "SELECT doc_id, length(text)::INT AS chars, len(regexp_split_to_array(trim(text), '[ \\n]+'))::INT AS words, len(string_split(text, chr(10)))::INT AS lines FROM documents",
)

#: Topic words of our own choosing with weights, and sentiment words.
TOPICS = {"commerce": {"price": 1.0, "order": 0.8, "the": 0.2}, "legal": {"license": 1.0, "rights": 0.9, "terms": 0.7}, "nature": {"sea": 1.0, "tree": 0.9, "eau": 0.4}}


def _topic(words: dict[str, float], dialect: str) -> str:
    total = sum(words.values())
    hits = " + ".join(f"CASE WHEN {'contains(t, ' + repr(w) + ')'} THEN {x}{'D' if dialect == 'spark' else '::DOUBLE'} ELSE 0 END" for w, x in words.items())
    return f"round(least(1, ({hits}) / {total}{'D' if dialect == 'spark' else '::DOUBLE'}), 6)"


def _features(dialect: str) -> str:
    words = "regexp_extract_all(t, '[a-z0-9\\']+', 0)" if dialect == "spark" else "regexp_extract_all(t, '[a-z0-9'']+')"
    size, join = ("size", "array_join(w, '')") if dialect == "spark" else ("len", "array_to_string(w, '')")
    distinct = "size(array_distinct(w))" if dialect == "spark" else "len(list_distinct(w))"
    kind = "INT"
    return f"""WITH l AS (SELECT doc_id, lower(text) AS t FROM documents), x AS (SELECT *, {words} AS w FROM l),
      m AS (SELECT *, CAST({size}(w) AS {kind}) AS n, CAST(length({join}) AS DOUBLE) / nullif({size}(w), 0) AS mean FROM x)
      SELECT doc_id, {', '.join(f'{_topic(ws, dialect)} AS {n}' for n, ws in TOPICS.items())}, n AS words, round(mean, 6) AS mean_length,
      CASE WHEN mean > 7 THEN 'high' WHEN mean > 5 THEN 'medium' ELSE 'low' END AS complexity, round(CAST({distinct} AS DOUBLE) / nullif(n, 0), 6) AS unique_ratio FROM m"""


R.sql("semantic_features", _features("spark"), _features("duck"))
R.sql(
    "feature_summary",
    f"SELECT complexity, count(*) AS n, round(avg(unique_ratio), 6) AS mean_unique, max(words) AS most_words, sum(CASE WHEN legal > 0.3 THEN 1 ELSE 0 END) AS legal_docs FROM ({_features('spark')}) f GROUP BY complexity",
    f"SELECT complexity, count(*) AS n, round(avg(unique_ratio), 6) AS mean_unique, max(words) AS most_words, sum(CASE WHEN legal > 0.3 THEN 1 ELSE 0 END)::BIGINT AS legal_docs FROM ({_features('duck')}) f GROUP BY complexity",
)

_TOK_S = "(SELECT doc_id, pos, w FROM documents LATERAL VIEW posexplode(filter(split(regexp_replace(lower(text), '[^a-z0-9]+', ' '), ' '), x -> x <> '')) p AS pos, w)"
_TOK_D = "(SELECT doc_id, unnest(range(len(ws)))::INT AS pos, unnest(ws) AS w FROM (SELECT doc_id, list_filter(string_split(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> '') AS ws FROM documents))"


def _both(name: str, sql: str) -> None:
    R.sql(name, sql.replace("TOK", _TOK_S), sql.replace("TOK", _TOK_D))


_VOCABULARY = f"v AS MATERIALIZED (SELECT w, count(*) AS frequency, row_number() OVER (ORDER BY count(*) DESC, w) AS id FROM {_TOK_D} t GROUP BY w HAVING count(*) >= 2)"


def _vocabulary(docs):
    return vocabulary(word_counts(docs, "text"), times="n")


@R.add("tokenize_vocabulary", f"WITH {_VOCABULARY} SELECT t.doc_id, t.pos, coalesce(v.id, 0) AS id FROM {_TOK_D} t LEFT JOIN v ON v.w = t.w")
def tokenize_vocabulary(spark, sf_dir):
    """Every word's id in the vocabulary of words that occur twice or more."""
    docs = table(spark, sf_dir, "documents")
    return text_ids(docs, "doc_id", "text", _vocabulary(docs)).select(F.col("k").alias("doc_id"), F.col("p").alias("pos"), "id")


@R.add("vocabulary_table", f"WITH {_VOCABULARY} SELECT w, id, frequency FROM v")
def vocabulary_table(spark, sf_dir):
    return _vocabulary(table(spark, sf_dir, "documents"))


# hashing needs no vocabulary: a word has its number wherever it is met
_ID_S, _ID_D = "CAST(conv(substring(md5(w), 1, 12), 16, 10) AS BIGINT)", "('0x' || substring(md5(w), 1, 12))::BIGINT"
_both("term_frequencies", "SELECT w, sum(tf) AS cf, count(*) AS df FROM (SELECT doc_id, w, count(*) AS tf FROM TOK t GROUP BY doc_id, w) c GROUP BY w")
ORACLES["term_frequencies"] = ORACLES["term_frequencies"].replace("sum(tf) AS cf", "sum(tf)::BIGINT AS cf")
# words of five documents or more are the vocabulary; they weigh tf * idf, others a quarter of tf; all go to one of 768 dimensions
_TFIDF = """WITH t AS (SELECT doc_id, w, ID AS id, count(*) AS tf FROM TOK q GROUP BY doc_id, w), c AS (SELECT w, sum(tf) AS cf FROM t GROUP BY w HAVING count(*) >= 5),
    v AS (SELECT count(*) AS v FROM c), s AS (SELECT t.doc_id, t.id % 768 AS dim, sum(CASE WHEN cf IS NULL THEN CAST(0.25 AS DOUBLE) * tf ELSE tf * (ln((v + 1) / CAST(cf + 1 AS DOUBLE)) + 1) END) AS x
      FROM t LEFT JOIN c ON c.w = t.w CROSS JOIN v GROUP BY t.doc_id, t.id % 768)
    SELECT doc_id, dim, round(x / sqrt(sum(x * x) OVER (PARTITION BY doc_id)), 6) AS weight FROM s WHERE x <> 0"""


@R.add("tfidf_vectors", _TFIDF.replace("TOK", _TOK_D).replace("ID AS", f"{_ID_D} AS"))
def tfidf_vectors(spark, sf_dir):
    """Hashed TF-IDF vectors of unit length. A word's number and weight are worked out once in each slice of texts."""
    docs = table(spark, sf_dir, "documents")
    counts = word_counts(docs, "text").unionByName(repeated(docs, "doc_id", "text").select("w", F.lit(0).cast("long").alias("n"), (-F.col("more")).alias("df")))
    known = counts.groupBy("w").agg(F.sum("n").alias("cf"), F.sum("df").alias("df")).where("df >= 5").select("w", "cf")
    known = written(known, "tfidf-words")
    listed = word_documents(docs, "doc_id", "text").join(known, "w", "left").crossJoin(F.broadcast(known.agg(F.count("*").alias("v"))))
    weight = F.expr("CASE WHEN cf IS NULL THEN CAST(0.25 AS DOUBLE) ELSE ln((v + 1) / CAST(cf + 1 AS DOUBLE)) + 1 END")
    parts = flat(listed.select("ks", "ps", F.expr(f"{_ID_S} % 768").alias("dim"), weight.alias("weight")))
    # from here on all is within a document
    s = parts.repartition("k").groupBy("k", "dim").agg(F.sum(F.col("p") * F.col("weight")).alias("x")).where("x <> 0")
    return s.selectExpr("k AS doc_id", "dim", "round(x / sqrt(sum(x * x) OVER (PARTITION BY k)), 6) AS weight")


_GRAMS = {n: "concat_ws(' ', w, " + ", ".join(f"lead(w, {i}) OVER o" for i in range(1, n)) + f") AS gram, lead(w, {n - 1}) OVER o AS last" for n in (5, 4, 3, 2)}


@R.add(
    "ngram_promotion",
    " UNION ALL ".join(
        f"SELECT {n} AS size, gram, count(*) AS n FROM (SELECT {g} FROM {_TOK_D} t WINDOW o AS (PARTITION BY doc_id ORDER BY pos)) g WHERE last IS NOT NULL GROUP BY gram HAVING count(*) >= 10" for n, g in _GRAMS.items()
    ),
)
def ngram_promotion(spark, sf_dir):
    """Runs of two to five words that occur ten times or more."""
    return frequent_runs(table(spark, sf_dir, "documents"), "text", tuple(_GRAMS), 10)


R.sql(
    "atomize_text",
    f"SELECT sha2(w, 256) AS content_hash, w AS value, sum(n) AS reference_count, min(doc_id) AS first_parent FROM (SELECT doc_id, w, count(*) AS n FROM {_TOK_S} t GROUP BY doc_id, w) c GROUP BY w",
    f"SELECT sha256(w) AS content_hash, w AS value, count(*) AS reference_count, min(doc_id) AS first_parent FROM {_TOK_D} t GROUP BY w",
)


@R.add("text_compositions", "SELECT sha256(text) AS parent, unnest(range(len(ws)))::INT AS seq, sha256(unnest(ws)) AS component FROM (SELECT text, string_split(text, ' ') AS ws FROM documents) t")
def text_compositions(spark, sf_dir):
    return compositions(table(spark, sf_dir, "documents"), "text")


R.sql(
    "reconstruct_text",
    "SELECT conv_id, listagg(text, ' ') WITHIN GROUP (ORDER BY turn) AS whole FROM conversations GROUP BY conv_id",
    "SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS whole FROM conversations GROUP BY conv_id",
)
R.sql(
    "ingest_dedup_rate",
    "SELECT count(*) AS rows_in, count(DISTINCT sha2(text, 256)) AS atoms, round(1 - CAST(count(DISTINCT sha2(text, 256)) AS DOUBLE) / count(*), 6) AS dedup_rate FROM documents",
    "SELECT count(*) AS rows_in, count(DISTINCT sha256(text)) AS atoms, round(1 - count(DISTINCT sha256(text))::DOUBLE / count(*), 6) AS dedup_rate FROM documents",
)
R.sql(
    "code_structure_counts",
    "SELECT page_id, regexp_count(html, '<script') AS scripts, regexp_count(html, '<a ') AS links, regexp_count(html, '[{]') AS braces, regexp_count(html, '<!--') AS comments FROM pages",
    "SELECT page_id, len(regexp_extract_all(html, '<script'))::INT AS scripts, len(regexp_extract_all(html, '<a '))::INT AS links, len(regexp_extract_all(html, '[{]'))::INT AS braces, len(regexp_extract_all(html, '<!--'))::INT AS comments FROM pages",
)
R.sql(
    "html_titles_and_links",
    "SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, size(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS hrefs FROM pages",
    "SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, len(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1))::INT AS hrefs FROM pages",
)
R.sql(
    "string_functions",
    "SELECT c_custkey, lower(trim(c_name)) AS a, substring(c_name, 1, 4) AS b, instr(c_name, '#') AS c, reverse(c_name) AS d, repeat(left(c_name, 1), 3) AS e, translate(c_name, '#0', '_o') AS f, hex(c_custkey) AS g, length(c_name) AS h FROM customer",
    "SELECT c_custkey, lower(trim(c_name)) AS a, substring(c_name, 1, 4) AS b, instr(c_name, '#')::INT AS c, reverse(c_name) AS d, repeat(left(c_name, 1), 3) AS e, translate(c_name, '#0', '_o') AS f, printf('%X', c_custkey) AS g, length(c_name)::INT AS h FROM customer",
)
R.sql(
    "date_functions",
    "SELECT event_id, hour(ts) AS h, dayofweek(ts) AS wd, CAST(ts AS DATE) AS d, datediff(CAST(ts AS DATE), DATE '2024-01-01') AS days, ts + INTERVAL '90' MINUTE AS later FROM events",
    "SELECT event_id, hour(ts)::INT AS h, (dayofweek(ts) + 1)::INT AS wd, CAST(ts AS DATE) AS d, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE))::INT AS days, ts + INTERVAL 90 MINUTE AS later FROM events",
)
R.sql(
    "json_functions",
    "SELECT event_id, CAST(get_json_object(props, '$.k') AS BIGINT) AS k, to_json(named_struct('k', CAST(get_json_object(props, '$.k') AS BIGINT), 't', event_type)) AS rebuilt FROM events",
    "SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k, '{\"k\":' || json_extract_string(props, '$.k') || ',\"t\":\"' || event_type || '\"}' AS rebuilt FROM events",
)
R.sql("null_and_cast", "SELECT s_suppkey, coalesce(nullif(s_nationkey, 3), -1) AS nk, try_cast(substring(s_name, 10) AS INT) AS num, greatest(s_suppkey, 50) AS g FROM supplier".replace("greatest(s_suppkey, 50)", "greatest(s_suppkey, CAST(50 AS BIGINT))"))
