"""Dialogues and neighbour graphs against brute force: long and odd dialogues, ties, clusters, graphs that decide."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from atomweave.llm import nn_descent
from atomweave.llm.chat import END, PART_TURNS, rotate


def _rendered(rows, who, part):
    """Text and masks of a dialogue's part by a plain loop; rows: (turn, role, text)."""
    out, spans = "", []
    mine = [(t, r or "unknown", x or "") for t, r, x in rows if t // PART_TURNS == part]
    for _, role, text in sorted(mine):
        out += "<|assistant|>\n" if role == who else "<|system|>\n" if role == "system" else f"<|user name={role}|>\n"
        if role == who:
            spans.append((len(out), len(out) + len(text + END)))
        out += text + END
    return out, spans


def test_rotation_equals_a_loop_on_long_and_repeated_turns(spark):
    roles = ["ann", "bob", "cyd"]
    rows = [(1, i, roles[i % 3], f"turn {i} 漢🙂") for i in range(2 * PART_TURNS + 50)]
    rows += [(1, 7, "bob", "same"), (1, 7, "bob", "same"), (1, 7, "ann", "same"), (1, 0, "system", "be kind")]
    rows += [(2, 0, "ann", "x" * 200_000), (2, 0, "bob", None), (2, 0, None, "")]
    # columns of the names that the operator uses itself
    df = spark.createDataFrame([(*r, "?", 9, "?", 9, 9) for r in rows], "conv_id long, turn long, role string, text string, perspective string, part int, own string, n int, end int")
    got = {(r["conv_id"], r["perspective"], r["part"]): r for r in rotate(df).collect()}
    of = {c: [r[1:] for r in rows if r[0] == c] for c in (1, 2)}
    keys = {(c, role or "unknown", t // PART_TURNS) for c in of for t in {x[0] for x in of[c]} for _, role, _ in of[c] if role != "system"}
    assert set(got) == keys
    for (c, who, part), r in got.items():
        text, spans = _rendered(of[c], who, part)
        assert r["rendered"] == text
        assert [(s["begin"], s["end"]) for s in r["loss_spans"]] == spans
        assert r["loss_chars"] == sum(b - a for a, b in spans)


def _recall(rows, got, k=10):
    ids = np.array([r[0] for r in rows])
    v = np.array([r[1] for r in rows], float)
    by: dict[int, list] = {}
    for r in got:
        by.setdefault(r["query_id"], []).append(r["vec_id"])
    hit = want = 0
    for q, found in by.items():
        d = np.sqrt(((v - v[ids == q][0]) ** 2).sum(1))
        best = [int(ids[i]) for i in np.lexsort((ids, d)) if ids[i] != q][:k]
        hit, want = hit + len(set(best) & set(found)), want + len(best)
    return hit / want


def test_ties_go_to_the_smaller_id_and_repeated_rows_count_once(spark):
    rows = [(100, [1.0] * 8)]
    for i in range(16):  # all at distance 2 of the query
        x = [1.0] * 8
        x[i // 2] += 2.0 if i % 2 else -2.0
        rows.append((50 - i, x))
    rows += [rows[3], rows[3], (100, rows[0][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("q", F.lit("x")).withColumn("rank", F.lit("x"))
    got = nn_descent.nearest(df, F.col("vec_id") % 100 == 0, 10).orderBy("rank").collect()
    assert [(r["rank"], r["vec_id"], r["score"]) for r in got] == [(i + 1, 35 + i, 2.0) for i in range(10)]


@pytest.mark.parametrize("clusters", [1, 25])
def test_recall_where_the_graph_decides(spark, monkeypatch, clusters):
    """Leaves and the pool are small against the table; with clusters the graph falls into parts that don't meet."""
    monkeypatch.setattr(nn_descent, "LEAF", 50)
    monkeypatch.setattr(nn_descent, "POOL", 80)
    rng = np.random.default_rng(4)
    n = 2000
    x = rng.standard_normal((n, 12)) + 50.0 * rng.standard_normal((clusters, 12))[np.arange(n) % clusters]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = nn_descent.nearest(df, F.col("vec_id") % 100 == 0, 10).collect()
    assert len(got) == 10 * n // 100
    assert _recall(rows, got) >= 0.9
