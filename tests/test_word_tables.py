import hashlib
import re
from collections import Counter

import pytest

from atomweave.operators import tokens as K
from atomweave.operators import vocabulary as V
from atomweave.operators import word_tables as W
from atomweave.plans import registry

ROWS = [(1, "the cat the dog"), (2, None), (3, ""), (None, "the x"), (1, "cat é9 cat"), (None, "The end."), (4, "dog " * 30), (5, "--")]


@pytest.fixture
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string").repartition(3)


def words(text):
    return re.findall("[a-z0-9]+", (text or "").lower())


def test_every_word_gets_its_id(docs, monkeypatch):
    monkeypatch.setattr(K, "SLICE", 20)
    count = Counter(w for _, t in ROWS for w in words(t))
    order = sorted((w for w in count if count[w] > 1), key=lambda w: (-count[w], w))
    table = V.vocabulary(W.word_counts(docs, "text"), times="n")
    assert {(r["w"], r["id"], r["frequency"]) for r in table.collect()} == {(w, i + 1, count[w]) for i, w in enumerate(order)}
    got = Counter((r["k"], r["p"], r["id"]) for r in V.text_ids(docs, "doc_id", "text", table).collect())
    assert got == Counter((k, i, order.index(w) + 1 if w in order else 0) for k, t in ROWS for i, w in enumerate(words(t)))


def test_rows_that_have_a_word_and_keys_that_repeat(docs):
    got = Counter()
    for r in W.flat(W.word_documents(docs, "doc_id", "text")).collect():
        got[r["k"], r["w"]] += r["p"]
    assert got == Counter((k, w) for k, t in ROWS for w in words(t))
    df = {r["w"]: r["df"] for r in W.word_counts(docs.coalesce(1), "text").groupBy("w").sum("df").withColumnRenamed("sum(df)", "df").collect()}
    more = {r["w"]: r["more"] for r in W.repeated(docs, "doc_id", "text").collect()}
    assert more == {"cat": 1, "the": 1}
    assert {w: n - more.get(w, 0) for w, n in df.items()} == Counter(w for _, w in {(k, w) for k, t in ROWS for w in words(t)})


def test_tfidf_of_keys_that_repeat(spark, tmp_path):
    """A word of five rows but four documents is not in the vocabulary, as in the SQL; words aren't shuffled as rows."""
    import duckdb

    rows = [(i, f"common rare{i} common") for i in range(6)] + [(i, "four other") for i in (0, 1, 2, 3, 3)] + [(9, None)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    df = registry.QUERIES["tfidf_vectors"](spark, str(tmp_path))
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = {(d, i): x for d, i, x in c.sql(registry.ORACLES["tfidf_vectors"]).fetchall()}
    got = {(r["doc_id"], r["dim"]): r["weight"] for r in df.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-6 for k in want)
    assert "explode" not in df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("most, listed", [(12 << 20, 4096), (25, 4), (1, 1)])
def test_compositions_come_word_by_word(docs, monkeypatch, most, listed):
    """The result is large, and Parquet keeps it small only if a hash that repeats comes in runs."""
    monkeypatch.setattr(W, "COMPOSED", most)
    monkeypatch.setattr(W, "LISTED", listed)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    got = [(r["parent"], r["seq"], r["component"]) for r in W.compositions(docs.coalesce(1), "text").collect()]
    assert Counter(got) == Counter((sha(t), i, sha(w)) for _, t in ROWS if t is not None for i, w in enumerate(t.split(" ")))
    if most > 100:
        assert sum(a[2] != b[2] for a, b in zip(got, got[1:])) + 1 == len({c for _, _, c in got})
