"""Closed-form expectations of vector and spatial functions."""

import pytest
from pyspark.sql import functions as F

from atomweave.functions import spatial as S
from atomweave.functions import vector as V
from atomweave.sources import ingest as I


def one(spark, **cols):
    return spark.range(1).select(*(c.alias(n) for n, c in cols.items())).first()


def vec(*x):
    return F.array(*[F.lit(float(v)) for v in x])


def test_metrics(spark):
    a, o, n = vec(1, 0.5, 0.25), vec(0, 0, 0), F.lit(None).cast("array<double>")
    r = one(
        spark,
        same=V.cosine(a, a),
        orthogonal=V.cosine(vec(1, 0), vec(0, 1)),
        opposite=V.cosine(vec(1, 2), vec(-1, -2)),
        zero=V.cosine(a, o),
        null=V.cosine(a, n),
        dot=V.dot(vec(1, 2, 3), vec(4, 5, 6)),
        euclid=V.euclidean(vec(0, 0), vec(3, 4)),
        city=V.manhattan(vec(0, 0), vec(3, 4)),
        chess=V.chebyshev(vec(0, 0), vec(3, 4)),
        canberra=V.canberra(vec(0, 1), vec(0, 3)),
        hamming=V.similarity("hamming", vec(1, 2), vec(1, 3)),
        unit=V.norm(V.normalize(vec(3, 4))),
        still=V.normalize(o),
        arg=V.argmax(vec(1, 5, 5)),
        lerp=V.lerp(vec(0), vec(10), 0.25),
        soft=V.softmax(vec(1, 1)),
    )
    assert [r[k] for k in ("same", "orthogonal", "opposite", "zero", "null", "dot", "euclid", "city", "chess", "canberra", "hamming")] == pytest.approx([1, 0, -1, 0, None, 32, 5, 7, 4, 0.5, 0.5])
    assert r["unit"] == pytest.approx(1) and r["still"] == [0, 0, 0] and r["arg"] == 1 and r["lerp"] == [2.5] and r["soft"] == [0.5, 0.5]


def test_codes_are_one_to_one(spark):
    n = 16
    g = spark.range(n * n).select((F.col("id") % n).alias("x"), (F.col("id") / n).cast("long").alias("y"))
    x, y = F.col("x"), F.col("y")
    bx, by = S.morton2_decode(S.morton2(x, y))
    cx, cy, cz = S.morton3_decode(S.morton3(x, y, x + y))
    rows = g.select("x", "y", bx.alias("bx"), by.alias("by"), cx.alias("cx"), cy.alias("cy"), cz.alias("cz"), S.hilbert2(x, y, 4).alias("h")).collect()
    assert all((r["x"], r["y"]) == (r["bx"], r["by"]) == (r["cx"], r["cy"]) and r["cz"] == r["x"] + r["y"] for r in rows)
    walk = sorted(rows, key=lambda r: r["h"])
    assert [r["h"] for r in walk] == list(range(n * n))
    assert all(abs(a["x"] - b["x"]) + abs(a["y"] - b["y"]) == 1 for a, b in zip(walk, walk[1:]))  # neighbours on the curve touch


def test_atoms_merge_counts(spark):
    df = spark.createDataFrame([("t1", "a"), ("t1", "a"), ("t2", "a"), ("t1", None)], "tenant string, text string")
    got = {(r["tenant"], r["value"]): r["reference_count"] for r in I.merge(I.atoms(df, "text", "tenant"), I.atoms(df, "text", "tenant")).collect()}
    assert got == {("t1", "a"): 4, ("t2", "a"): 2}
