import re
from collections import Counter

import numpy as np
import pyarrow as pa

from atomweave.operators import grams as G
from atomweave.operators import tokens as K
from atomweave.plans import registry

TEXTS = ["a b a b a b c", None, "", "Éa--b é9 Straße  x", "b a", " c ", "ab" * 30, "İstanbul ΣΑΣ a b c", "c", "\U0001f600a b\nc\td"] * 3


def wanted(text):
    return re.findall(r"[a-z0-9]+", (text or "").lower())


def test_words_of_texts(monkeypatch):
    monkeypatch.setattr(K, "SLICE", 40)
    lowered = pa.array([None if t is None else t.lower() for t in ["x", *TEXTS]]).slice(1)
    got = []
    for rows, names, code, edge in K.slices(iter([pa.RecordBatch.from_arrays([lowered], ["t"]), pa.RecordBatch.from_arrays([lowered.slice(0, 0)], ["t"])]), "t"):
        every = names.take(pa.array(code)).to_pylist()
        assert len(edge) == len(rows) + 1
        got += [every[a:b] for a, b in zip(edge, edge[1:])]
    assert got == [wanted(t) for t in TEXTS]


def test_runs_that_occur_often(spark, monkeypatch):
    r = np.random.default_rng(1)
    texts = TEXTS + [" ".join("pqrs"[i] for i in r.integers(0, 4, n)) for n in r.integers(0, 30, 40)]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    count = Counter((n, " ".join(w[i : i + n])) for w in map(wanted, texts) for n in (2, 3, 4, 5) for i in range(len(w) - n + 1))
    for bits in (28, G.PART_BITS + 3):  # with few bits hashes share them
        monkeypatch.setattr(G, "BITS", bits)
        got = [(x["size"], x["gram"], x["n"]) for x in G.frequent_runs(docs, "text", (5, 4, 3, 2), 6).collect()]
        assert sorted(got) == sorted((n, g, k) for (n, g), k in count.items() if k >= 6)
    assert G.frequent_runs(docs.limit(0), "text", (2,), 1).count() == 0


def test_ngram_promotion_sorts_no_words(spark):
    plan = registry.QUERIES["ngram_promotion"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Window" not in plan and "Generate" not in plan
