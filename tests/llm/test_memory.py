"""What a worker and the session hold at once."""

import numpy as np
import pyarrow as pa

import corpus_pipeline
from atomweave.llm import toxicity as T


def test_stages_hold_small_arrow_batches(spark):
    before = spark.conf.get(corpus_pipeline.ROWS)
    docs = spark.createDataFrame([(i, f"some words of text {i} " * 20, "en", "web", 10) for i in range(50)], "doc_id long, text string, lang string, source string, n_chars int")
    try:
        for given in ("10000", "0", "7"):
            spark.conf.set(corpus_pipeline.ROWS, given)
            dict(corpus_pipeline.STAGES)["packing"](spark, docs, "")
            assert 0 < int(spark.conf.get(corpus_pipeline.ROWS)) == (7 if given == "7" else corpus_pipeline.BATCH)
    finally:
        spark.conf.set(corpus_pipeline.ROWS, before)


def test_scorer_keeps_one_matrix_in_single_precision_and_the_same_neighbours():
    r = np.random.default_rng(3)
    texts = [" ".join(f"{'abcdefghij'[i]}{'klmnopqrst'[j]}" for i, j in zip(r.integers(0, 10, 60), (r.zipf(1.5, 60) - 1) % 10)) for _ in range(300)]
    terms = T.Terms()
    vectors = list(terms.counts(pa.array(texts)))
    index = T.Index.build(terms.vocab, vectors, range(300), r.integers(0, 2, 300), np.ones(300), 0.5).ready()
    arrays = [a for part in (index.postings, index.common) for a in part]
    assert max(a.dtype.itemsize for a in arrays if a.dtype.kind == "f" and a.size > len(index.ids) + T.BLOCK) == 4
    assert sum(a.ndim == 2 for a in arrays) == 1
    for a, b in list(zip(index.first, index.first[1:]))[:40]:
        t, w = index.term[a:b], index.weight[a:b]
        every = np.arange(len(index.ids))
        sims, told = index.cosines(every, t, w)
        near = np.lexsort([every, -sims])[: T.NEIGHBOURS]
        voters = near[np.lexsort([near, -told[near]])[: T.VOTERS]]
        e, s, v, x = index.judged(t, w)
        assert e.tolist() == near[: T.EVIDENCE].tolist() and v.tolist() == voters.tolist()
        assert np.allclose(s, sims[e]) and np.allclose(x, told[v])


def test_the_driver_keeps_nothing_of_learning(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"text {i % 7} of {'bad' if i % 3 else 'good'} words {i}") for i in range(60)], "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "1 AS quality", "cast(doc_id % 3 > 0 AS int) AS toxic")
    learn, made, done = T.learn, [], []
    monkeypatch.setattr(T, "learn", lambda *a: made.append(learn(*a)) or made[0])
    monkeypatch.setattr(T, "trim", lambda: done.append({*made[0].__dict__} & {"postings", "cells", "common", "asked_for"} if made else None))
    kept = T.keep_clean(docs, labels)
    assert done[-1] == set()
    assert kept.count() < 60
