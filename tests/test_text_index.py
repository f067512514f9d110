import re

import pyarrow as pa

from atomweave.operators import fulltext as T
from atomweave.operators.work import fresh_path


def test_terms_and_totals_come_from_one_pass(spark, monkeypatch):
    monkeypatch.setattr(T, "ROWS", 3)
    texts = {1: "Alpha beta alpha, gamma", 2: None, 3: "", 4: "...", 5: "été 5 ALPHA ß", 6: "beta", 7: "x" * 50, None: "alpha"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").coalesce(1)
    index = T.write_index(docs, fresh_path(spark, "test-index"))
    terms = {k: re.findall(r"\w+", v.lower()) for k, v in texts.items() if v is not None}
    assert (index.documents, index.mean_length) == (len(terms), sum(map(len, terms.values())) / len(terms))
    rows = spark.read.parquet(index.path)
    totals = rows.where(f"bucket = {T.TOTALS}").collect()
    assert (sum(r["doc_id"] for r in totals), sum(r["tf"] for r in totals)) == (len(terms), sum(map(len, terms.values())))
    got = {(r["doc_id"], r["term"]): (r["tf"], r["length"]) for r in rows.where(f"bucket <> {T.TOTALS}").collect()}
    assert got == {(k, w): (ws.count(w), len(ws)) for k, ws in terms.items() for w in ws}


def test_postings_of_part_of_a_batch():
    b = pa.RecordBatch.from_arrays([pa.array([9, 1, 2], pa.int64()), pa.array([["z"], ["a", "b", "a"], []], pa.list_(pa.string()))], ["doc_id", "t"]).slice(1)
    out = pa.Table.from_batches(T._postings(iter([b]))).to_pylist()
    assert [tuple(r.values()) for r in out] == [("a", 1, 2, 3), ("b", 1, 1, 3), (None, 2, 3, 0)]
