"""op12: secrets in all documents, by the contract's three kinds and formats of well-known tokens."""

from pyspark.sql import functions as F

from atomweave.llm.common import table
from atomweave.llm.secret_scan import Rule, scan

# The base kinds. A run of hex digits has at least 32 exactly if this finds it whole.
BASE = [
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""", 8, 2),
    Rule("access", r"AKIA[A-Z0-9]+", 16),
    Rule("hex", r"[0-9a-f]{32,}", 32),
]
# Formats of tokens and keys.
MORE = [
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("hub", r"gh[opsru]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("maps", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pay", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("login", r"[a-z][a-z0-9+.-]{1,19}://[^/:@\x00-\x20]{1,64}:[^/:@\x00-\x20]{1,64}@"),
]
RULES = BASE + MORE


def _found(k: int, r: Rule) -> str:
    p = "'" + r.pattern.replace("'", "''") + "'"
    return f"SELECT doc_id, '{r.kind}' AS kind, {k} AS k, {r.least} AS least, regexp_split_to_array(t, {p}) AS p, regexp_extract_all(t, {p}) AS m, regexp_extract_all(t, {p}, {r.group}) AS g FROM d"


ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
f AS ({' UNION ALL '.join(_found(k, r) for k, r in enumerate(RULES))}),
u AS (SELECT doc_id, kind, k, m, g, p, least, unnest(range(1, len(m) + 1)) AS i FROM f WHERE len(m) > 0),
s AS (SELECT doc_id, kind, k, list_sum([len(x) FOR x IN p[:i]]) + coalesce(list_sum([len(x) FOR x IN m[:i - 1]]), 0) AS b, len(m[i]) AS n FROM u WHERE len(g[i]) >= least),
w AS (SELECT doc_id, kind, k, b, kind || ':' || b::BIGINT || ':' || (b + n)::BIGINT AS span FROM s),
c AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    string_agg(span, ',' ORDER BY b, k) FILTER (k < {len(BASE)}) AS base, string_agg(span, ',' ORDER BY b, k) AS spans FROM w GROUP BY 1)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN c ON c.doc_id = d.doc_id
"""


def digests(found):
    """The contract's columns of (doc_id, spans)."""
    joined = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    base = F.filter("spans", lambda x: x["kind"].isin([r.kind for r in BASE]))
    number = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *(number(r.kind) for r in BASE), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op12_secret_scan(spark, sf_dir):
    return digests(scan(table(spark, sf_dir, "documents"), RULES))


QUERIES = {"op12_secret_scan": op12_secret_scan}
ORACLES = {"op12_secret_scan": ORACLE}
