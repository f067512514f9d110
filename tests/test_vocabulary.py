from collections import Counter

from atomweave.operators import vocabulary as V


def test_ids_by_frequency(spark, monkeypatch):
    words = ["the"] * 50 + ["b"] * 5 + ["a"] * 5 + [f"w{i % 40}" for i in range(100)] + ["once"]
    monkeypatch.setattr(V, "FREQUENT", 3)
    tokens = spark.createDataFrame([(i, w, 1) for i, w in enumerate(words)] + [(999, None, 1)], "pos int, w string, x int").repartition(5)
    table = V.vocabulary(tokens)
    count = Counter(words)
    order = sorted((w for w in count if count[w] > 1), key=lambda w: (-count[w], w))
    assert {(r["w"], r["id"], r["frequency"]) for r in table.collect()} == {(w, i + 1, count[w]) for i, w in enumerate(order)}
    got = {r["pos"]: r["id"] for r in V.with_ids(tokens, table).collect()}
    assert got == {i: order.index(w) + 1 if w in order else 0 for i, w in enumerate(words)} | {999: 0}
    assert V.vocabulary(tokens.limit(0)).count() == 0
