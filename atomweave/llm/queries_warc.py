"""op1: pages as WARC archives, normalised and read back."""

from atomweave.llm.common import table
from atomweave.llm.warc import archive_round_trip

ORACLE = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
n AS (SELECT page_id, payload_bytes, h, min(page_id) OVER (PARTITION BY h) AS first_id,
    [instr('0123456789abcdef', substr(h, k, 1)) - 1 FOR k IN range(1, 41)] AS x FROM p),
b AS (SELECT *, [(x[i // 4 + 1] // (1 << (3 - i % 4))) % 2 FOR i IN range(0, 160)] AS bit FROM n)
SELECT page_id, payload_bytes,
    array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        16 * bit[5 * i + 1] + 8 * bit[5 * i + 2] + 4 * bit[5 * i + 3] + 2 * bit[5 * i + 4] + bit[5 * i + 5] + 1, 1) FOR i IN range(0, 32)], '') AS payload_digest,
    CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM b
"""


def op1_warc(spark, sf_dir):
    return archive_round_trip(spark, table(spark, sf_dir, "pages")).drop("url")


QUERIES = {"op1_warc": op1_warc}
ORACLES = {"op1_warc": ORACLE}
