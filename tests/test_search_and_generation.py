"""Ranked text, generation, spatial paths, curve order and segmented streams against plain loops."""

import datetime as dt
import heapq
import math
import re
import warnings
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from atomweave.functions import segments as SG
from atomweave.operators import fulltext, paths
from atomweave.operators.curve_quality import locality, preservation, ranked
from atomweave.operators.generate import STOP, generate
from atomweave.operators.paths import PathCache, StepsUsedUp, find_path
from atomweave.operators.work import fresh_path

RNG = np.random.default_rng(20)


def test_ranks_equal_plain_bm25(spark):
    r, words = np.random.default_rng(1), "alpha beta gamma delta Épsilon zeta eta theta".split()
    docs = [(i, " ".join(r.choice(words, r.integers(0, 30), p=np.array([8, 4, 3, 2, 1, 1, 1, 1]) / 21))) for i in range(120)] + [(500, None), (501, ""), (502, "  --  "), (503, "Alpha-beta alpha_BETA 12 alpha")]
    index = fulltext.write_index(spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, tf int"), fresh_path(spark, "test-text"))
    terms = {i: [t for t in re.split(r"[^\w]+|_", t.lower()) if t] for i, t in docs if t is not None}
    n, mean = len(terms), sum(map(len, terms.values())) / len(terms)
    for query in ("alpha éPSILON", "zeta zeta nowhere", "", "nowhere"):
        want = {}
        for w in {*query.lower().split()}:
            df = sum(w in t for t in terms.values())
            for i, t in terms.items():
                tf = t.count(w)
                if tf:
                    want[i] = want.get(i, 0) + math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(t) / mean))
        got = {x["doc_id"]: x["rank"] for x in fulltext.search(spark, index, query).collect()}
        assert got.keys() == want.keys()
        assert all(abs(got[i] - 1000 * s / (s + 5)) < 1e-6 for i, s in want.items())
    plan = spark.read.parquet(index.path).where("bucket = 3 AND term = 'alpha'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "EqualTo(term,alpha)" in plan
    none = fulltext.write_index(spark.createDataFrame([], "doc_id long, text string"), fresh_path(spark, "test-text"))
    assert none.documents == 0


def plain_generation(prompts, atoms, tokens, weights, steps, k, heat, seed):
    out = set()
    unit = lambda x: x / np.linalg.norm(x)
    for pid, now in prompts.items():
        had = set()
        for step in range(1, steps + 1):
            score, dist, n = Counter(), Counter(), Counter()
            for m, w in weights.items():
                cos = {a: round(float(unit(now[m]) @ unit(v[m])), 9) for a, v in atoms.items() if tokens[a] and tokens[a].strip()}
                for a in sorted(cos, key=lambda a: (-cos[a], a))[: 2 * k]:
                    score[a] += w * cos[a]
                    dist[a] += 1 - cos[a]
                    n[a] += 1
            left = sorted((a for a in score if a not in had), key=lambda a: (-round(score[a], 9), round(dist[a] / n[a], 9), a))[:k]
            if not left:
                break
            w = [math.exp(-dist[a] / n[a] / heat) * (score[a] if score[a] > 0 else 1e-9) for a in left]
            u = zlib.crc32(f"{seed}:{pid}::{step}".encode()) / 2**32 * sum(w)
            a = next((a for a, c in zip(left, np.cumsum(w)) if c >= u), left[-1])
            had.add(a)
            out.add((pid, step, a, tokens[a].strip(), round(score[a], 5), n[a]))
            if tokens[a].strip().lower() in STOP:
                break
            now = atoms[a]
    return out


def test_generation_equals_a_plain_loop(spark):
    atoms = {a: {m: RNG.standard_normal(6) for m in (1, 2)} for a in range(80)}
    tokens = {a: f" t{a} " for a in atoms} | {3: None, 4: "  ", **{a: "</S>" for a in range(10, 20)}}
    prompts = {p: {m: RNG.standard_normal(6) for m in (1, 2)} for p in range(20)}
    rows = [(a, m, tokens[a], v.tolist()) for a, x in atoms.items() for m, v in x.items()] + [(900, 1, "x", None), (901, 7, "x", [1.0] * 6)]
    asked = [(p, m, v.tolist()) for p, x in prompts.items() for m, v in x.items()] + [(None, 1, [1.0] * 6), (77, 1, None)]
    weights = {1: 0.7, 2: 0.3}
    table, start = spark.createDataFrame(rows, "atom_id long, model_id int, token string, v array<double>"), spark.createDataFrame(asked, "prompt_id long, model_id int, v array<double>")
    got = generate(start, table, weights, steps=5, k=4, temperature=0.3, seed=9).collect()
    assert {(r["prompt_id"], r["step"], r["atom_id"], r["token"], round(r["score"], 5), r["model_count"]) for r in got} == plain_generation(prompts, atoms, tokens, weights, 5, 4, 0.3, 9)
    assert len({(r["prompt_id"], r["step"]) for r in got}) == len(got)
    assert generate(start.limit(0), table, weights).count() == 0


def plain_path(points, start, centre, region, radius, most):
    h = {i: math.dist(v, centre) for i, v in points.items()}
    heap, cost, parent, closed = [(h[start], h[start], start)], {start: 0.0}, {start: None}, set()
    while heap:
        f, _, i = heapq.heappop(heap)
        if i in closed:
            continue
        if h[i] <= region:
            path = [i]
            while parent[path[-1]] is not None:
                path.append(parent[path[-1]])
            return path[::-1], cost[i], len(closed)
        if len(closed) >= most:
            return None
        closed.add(i)
        for j, v in points.items():
            d = math.dist(points[i], v)
            if j != i and d <= radius and cost[i] + d < cost.get(j, math.inf):
                cost[j], parent[j] = cost[i] + d, i
                heapq.heappush(heap, (cost[j] + h[j], h[j], j))
    return None


@pytest.mark.parametrize("case", range(3))
def test_paths_equal_plain_search(spark, case):
    r = np.random.default_rng(case)
    points = {i: v for i, v in enumerate(r.random((400, 3)).tolist())}
    centre, region, radius = [[0.9, 0.9, 0.9], [0.1, 0.5, 0.9], [3.0, 3.0, 3.0]][case], 0.1, 0.2
    rows = spark.createDataFrame([(i, v) for i, v in points.items()] + [(1000, points[5]), (1001, None)], "id long, v array<double>")
    want = plain_path(points, 0, centre, region, radius, 10_000)
    got = find_path(rows, "id", "v", 0, centre, region, radius).orderBy("step").collect()
    if want is None:
        assert got == []
        return
    assert [x["atom_id"] for x in got] == want[0] and abs(got[-1]["cost"] - want[1]) < 1e-9 and got[-1]["to_centre"] <= region
    if case:
        return
    assert find_path(rows, "id", "v", 0, centre, region, radius, max_steps=want[2] - 1).count() == 0
    assert find_path(rows, "id", "v", 0, centre, region, radius, max_steps=want[2]).count() == len(got)
    assert find_path(rows, "id", "v", 12345, centre, region, radius).count() == 0


def test_rounds_of_few_atoms_find_the_same_path(spark, monkeypatch):
    monkeypatch.setattr(paths, "FRONT", 3)
    points = {i: v for i, v in enumerate(np.random.default_rng(0).random((150, 3)).tolist())}
    rows = spark.createDataFrame([*points.items()], "id long, v array<double>")
    want = plain_path(points, 0, [0.9, 0.9, 0.9], 0.2, 0.3, 10_000)
    got = find_path(rows, "id", "v", 0, [0.9, 0.9, 0.9], 0.2, 0.3).orderBy("step").collect()
    assert want and [x["atom_id"] for x in got] == want[0] and abs(got[-1]["cost"] - want[1]) < 1e-9


def test_a_search_given_up_is_no_missing_path(spark):
    """More than 10,000 atoms around the start come before the goal, which is round a corner."""
    r = np.random.default_rng(1)
    cloud = (v for v in r.uniform(-0.05, 0.05, (25_000, 3)).tolist() if math.hypot(*v) < 0.05)
    rows = spark.createDataFrame([(0, [0.0, 0.0, 0.0]), (1, [0.45, 0.39, 0.0]), (2, [0.93, 0.05, 0.0]), *((10 + i, v) for i, v in enumerate(cloud))], "id long, v array<double>")
    near, alone = ([1.0, 0.0, 0.0], 0.1, 0.6), ([9.0, 0.0, 0.0], 0.1, 0.6)
    assert rows.count() > 12_000
    with warnings.catch_warnings():
        warnings.simplefilter("error", StepsUsedUp)
        assert [x["atom_id"] for x in find_path(rows, "id", "v", 0, *near).orderBy("step").collect()] == [0, 1, 2]
        assert find_path(rows.where("id < 10"), "id", "v", 0, *alone, max_steps=1).count() == 0  # there is none
    with pytest.warns(StepsUsedUp):
        assert find_path(rows, "id", "v", 0, *near, max_steps=10_000).count() == 0


def test_path_cache_expires(spark):
    cache, now = PathCache(spark, fresh_path(spark, "paths"), minutes=10), dt.datetime(2024, 5, 1, 12)
    assert cache.get(1, "c", now) is None
    path = spark.createDataFrame([(0, 1, 0.0, 2.0), (1, 7, 1.0, 0.5)], "step long, atom_id long, cost double, to_centre double")
    cache.put(1, "c", path, now)
    cache.put(1, "c", path.where("step = 0"), now + dt.timedelta(minutes=5))
    assert cache.get(1, "c", now).count() == 2 and cache.get(1, "c", now + dt.timedelta(minutes=6)).count() == 1
    assert cache.get(1, "d", now) is None and cache.get(1, "c", now + dt.timedelta(minutes=15)) is None


def test_curve_order_equals_brute_force(spark):
    x = RNG.random((600, 2))
    code = (x[:, 0] * 40).astype(int)
    rows = spark.createDataFrame([(i, int(c), v.tolist()) for i, (c, v) in enumerate(zip(code, x))], "id long, code long, v array<double>").repartition(7)
    order = sorted(range(600), key=lambda i: (code[i], i))
    got = {r["id"]: r["rank"] for r in ranked(rows, "code", "id").collect()}
    assert [got[i] for i in order] == [*range(600)]
    d, span, sizes = [], [], {}
    for s in (1, 4, 100):
        for a, b in zip(order, order[s:]):
            d.append(math.dist(x[a], x[b]))
            span.append(code[b] - code[a])
        sizes[s] = 600 - s
    res = {r["stride"]: r for r in locality(rows, "id", "code", "v", (1, 4, 100, 1000)).collect()}
    assert {s: r["pairs"] for s, r in res.items() if s} == sizes
    assert abs(res[None]["correlation"] - np.corrcoef(d, span)[0, 1]) < 1e-9
    kept = {r["id"]: r["kept"] for r in preservation(rows, "id", "code", "v", 4, 20).collect()}
    for i in range(600):
        near = sorted((round(math.dist(x[i], x[j]), 9), j) for j in range(600) if j != i)[:4]
        assert kept[i] == sum(abs(got[i] - got[j]) <= 20 for _, j in near)


def test_segmented_streams(spark):
    rows = [("a", 0, ["input", "OUTPUT"]), ("a", 1, ["odd"]), ("b", 0, []), ("c", 0, None), ("a", 2, ["control"])]
    df = spark.createDataFrame(rows, "id string, part int, kinds array<string>")
    seg = lambda k: SG.segment(k, F.lit("2024-01-02 03:04:05"), F.encode(k, "utf-8"), F.lit("text/plain"))
    stream = SG.append(SG.create(F.col("id"), F.lit("2024-01-01"), F.lit("s")), seg(F.lit("Telemetry")))
    one = df.where("id = 'b'").select(stream.alias("s"), SG.append(F.lit(None).cast(SG.STREAM), seg(F.lit("x"))).alias("none"))
    r = one.select(SG.count(F.col("s")).alias("n"), SG.get(F.col("s"), 0).alias("first"), SG.get(F.col("s"), 5).alias("far"), SG.count(F.col("none")).alias("no"), "none", "s.scope").first()
    assert (r["n"], r["first"]["kind"], bytes(r["first"]["payload"]), r["far"], r["no"], r["none"], r["scope"]) == (1, "Telemetry", b"Telemetry", None, 0, None, "s")
    made = F.when(F.col("kinds").isNotNull(), SG.create(F.col("id"), F.lit("2024-01-01")).withField("segments", F.transform("kinds", seg)))
    df.select("id", "part", made.alias("stream")).createOrReplaceTempView("test_streams")
    SG.register(spark)
    got = spark.sql("SELECT * FROM enumerate_segments(TABLE(test_streams) PARTITION BY id ORDER BY part)").collect()
    assert {(r["stream_id"], r["ordinal"], r["kind"], bytes(r["payload"])) for r in got} == {("a", 0, "Input", b"input"), ("a", 1, "Output", b"OUTPUT"), ("a", 2, "Unknown", b"odd"), ("a", 3, "Control", b"control")}
