"""op11: branches L and R of all documents merged, with what was clean and what clashed."""

from pyspark.sql import functions as F

from atomweave.llm.branch_merge import DELETE, REPLACE, RETAIN, merge_inserted, merge_rows, operation
from atomweave.llm.common import table

COLUMNS = ("lang", "source")

# the code of a name: the CRC of its bits, lowest first, modulo 11
_CODE = "(xor(list_reduce(list_prepend(4294967295::BIGINT, [((ord(s[k // 8 + 1]) >> (k % 8)) & 1)::BIGINT FOR k IN range(8 * len(s))]), lambda a, b: xor(a >> 1, (xor(a, b) & 1) * 3988292384)), 4294967295) % 11)"
ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
t AS (SELECT doc_id, unnest(['row', 'lang', 'source'] || [x::VARCHAR FOR x IN range(len(lines))]) AS name FROM d),
s AS (SELECT doc_id, name, b || ':' || doc_id || ':' || name AS s, b FROM t, (VALUES ('L'), ('R')) v(b)),
k AS (SELECT doc_id, name, b, {_CODE} AS c FROM s),
c AS (SELECT doc_id, name, max(c) FILTER (b = 'L') AS l, max(c) FILTER (b = 'R') AS r FROM k GROUP BY 1, 2),
n AS (SELECT doc_id, name::BIGINT AS i, l, r, l <= 2 AS el, r <= 2 AS er, l IN (3, 4) AS gl, r IN (3, 4) AS gr FROM c WHERE name NOT IN ('row', 'lang', 'source')),
m AS (SELECT n.*, lines[i + 1] AS x,
    CASE WHEN el AND er THEN if(l = r, l, 9) WHEN el THEN l WHEN er THEN r ELSE 9 END AS e,
    CASE WHEN gl AND gr THEN if(l = r, l, 9) WHEN gl THEN l WHEN gr THEN r ELSE 9 END AS g FROM n JOIN d USING (doc_id)),
p AS (SELECT doc_id, array_to_string(flatten(list(CASE e WHEN 0 THEN []::VARCHAR[] WHEN 1 THEN [x || '!'] WHEN 2 THEN [x || '?'] ELSE [x] END
        || CASE g WHEN 3 THEN ['!'] WHEN 4 THEN ['?'] ELSE []::VARCHAR[] END ORDER BY i)), chr(10)) AS merged,
    count(*) FILTER (e <> 9) + count(*) FILTER (g <> 9) AS clean, count(*) FILTER (el AND er AND l <> r AND l > 0 AND r > 0) AS ee,
    count(*) FILTER (el AND er AND l <> r AND (l = 0 OR r = 0)) AS ed, count(*) FILTER (gl AND gr AND l <> r) AS ii,
    bool_or(el OR gl) AS tl, bool_or(er OR gr) AS tr FROM m GROUP BY 1),
v AS (SELECT doc_id, name, base, CASE l WHEN 0 THEN '' WHEN 1 THEN base || '!' WHEN 2 THEN base || '?' ELSE base END AS vl,
    CASE r WHEN 0 THEN '' WHEN 1 THEN base || '!' WHEN 2 THEN base || '?' ELSE base END AS vr
    FROM (SELECT c.doc_id, name, l, r, if(name = 'lang', lang, source) AS base FROM c JOIN d USING (doc_id) WHERE name IN ('lang', 'source'))),
w AS (SELECT *, vl <> base AND vr <> base AND vl <> vr AS clash FROM v),
q AS (SELECT doc_id, max(if(clash, base, if(vl <> base, vl, vr))) FILTER (name = 'lang') AS lang, max(if(clash, base, if(vl <> base, vl, vr))) FILTER (name = 'source') AS source,
    count(*) FILTER (NOT clash AND (vl <> base OR vr <> base)) AS clean, count(*) FILTER (clash) AS ee, bool_or(vl <> base) AS tl, bool_or(vr <> base) AS tr FROM w GROUP BY 1),
f AS (SELECT d.*, merged, q.lang AS mlang, q.source AS msource, p.clean + q.clean AS clean, p.ee + q.ee AS ee, ed, ii,
    CASE WHEN l = 0 AND r = 0 THEN 'gone' WHEN l = 0 THEN if(p.tr OR q.tr, 'base', 'gone') WHEN r = 0 THEN if(p.tl OR q.tl, 'base', 'gone') ELSE 'both' END AS fate
    FROM d JOIN p USING (doc_id) JOIN q USING (doc_id) JOIN c ON c.doc_id = d.doc_id AND name = 'row'),
a AS (SELECT -1 - doc_id AS id, lang, source, if(l = 3, '!', '?') AS text FROM d JOIN c USING (doc_id) WHERE name = 'row' AND l IN (3, 4)
    UNION ALL SELECT -2 - doc_id, lang, source, if(r = 3, '!', '?') FROM d JOIN c USING (doc_id) WHERE name = 'row' AND r IN (3, 4)),
g AS (SELECT id, count(DISTINCT (lang, source, text)) = 1 AS alike, min(lang) AS lang, min(source) AS source, min(text) AS text FROM a GROUP BY 1)
SELECT doc_id, CASE fate WHEN 'both' THEN mlang WHEN 'base' THEN lang END AS lang, CASE fate WHEN 'both' THEN msource WHEN 'base' THEN source END AS source,
    CASE fate WHEN 'both' THEN sha256(merged) WHEN 'base' THEN sha256(text) END AS text_sha256,
    CASE fate WHEN 'both' THEN clean WHEN 'gone' THEN 1 ELSE 0 END::BIGINT AS n_clean, if(fate = 'both', ee, 0)::BIGINT AS n_edit_edit,
    CASE fate WHEN 'both' THEN ed WHEN 'base' THEN 1 ELSE 0 END::BIGINT AS n_edit_delete, if(fate = 'both', ii, 0)::BIGINT AS n_insert_insert FROM f
UNION ALL SELECT id, if(alike, lang, NULL), if(alike, source, NULL), if(alike, sha256(text), NULL), alike::BIGINT, 0, 0, (NOT alike)::BIGINT FROM g
"""


def _code(branch: str, name) -> F.Column:
    """A name's code in a branch, 0 to 10; null without a doc_id: then nothing is changed."""
    return F.crc32(F.concat_ws(":", F.lit(branch), F.col("doc_id").cast("string"), name).cast("binary")) % 11


def _codes(branch: str) -> F.Column:
    return F.transform("lines", lambda _, i: _code(branch, i.cast("string")))


def _branch(branch: str) -> F.Column:
    """What the codes of a branch do to a row, whose codes by line are in the column named as the branch."""
    coded = F.col("doc_id").isNotNull()
    row = F.when(coded & (_code(branch, F.lit("row")) == 0), DELETE).otherwise(RETAIN)
    columns = []
    for c in COLUMNS:
        code = _code(branch, F.lit(c))
        text = F.when(code == 0, "").when(code == 1, F.concat(c, F.lit("!"))).when(code == 2, F.concat(c, F.lit("?")))
        columns.append(F.struct(F.when(coded & (code <= 2), REPLACE).otherwise(RETAIN).alias("kind"), text.alias("text")).alias(c))

    def of_line(x, code):
        kind = F.when(code == 0, DELETE).when(code <= 2, REPLACE).otherwise(RETAIN)
        insert = F.when(code == 3, F.array(F.lit("!"))).when(code == 4, F.array(F.lit("?")))
        return operation(kind, F.when(code == 1, F.concat(x, F.lit("!"))).when(code == 2, F.concat(x, F.lit("?"))), insert)

    lines = F.when(coded, F.zip_with("lines", branch, of_line))
    return F.struct(row.alias("row"), F.struct(*columns).alias("columns"), F.lit(None).cast("array<string>").alias("head"), lines.alias("lines"))


def merged_documents(docs):
    """Branches L and R of documents by the contract's codes, merged: the operator's rows, with texts."""
    plain = [F.col("doc_id").cast("long").alias("doc_id"), *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in (*COLUMNS, "text"))]
    rows = docs.select(*plain).withColumn("lines", F.split("text", "\n", -1))
    rows = rows.withColumns({b: _codes(b) for b in ("L", "R")})
    rows = rows.select("doc_id", *COLUMNS, "text", _branch("L").alias("left"), _branch("R").alias("right"))
    short = docs.select(*plain[:-1]).where("doc_id IS NOT NULL")
    added = []
    for b, below in (("L", 1), ("R", 2)):
        code = _code(b, F.lit("row"))
        added.append(short.where(code.isin(3, 4)).select((F.lit(-below) - F.col("doc_id")).alias("doc_id"), *COLUMNS, F.when(code == 3, "!").otherwise("?").alias("text")))
    return merge_rows(rows).unionByName(merge_inserted(added[0].unionByName(added[1])))


def op11_branch_merge(spark, sf_dir):
    out = merged_documents(table(spark, sf_dir, "documents"))
    return out.select("doc_id", *COLUMNS, F.sha2("text", 256).alias("text_sha256"), "n_clean", "n_edit_edit", "n_edit_delete", "n_insert_insert")


QUERIES = {"op11_branch_merge": op11_branch_merge}
ORACLES = {"op11_branch_merge": ORACLE}
