"""Approximate nearest neighbours: a neighbour graph by NN-descent, queries by greedy search on it.

Equal vectors are one node (its copies come back at the end, smallest ids first), so groups of copies don't fill each
other's lists. The first lists come from exact neighbours within leaves of random-projection trees, which are fitted on a
sample (see ``sample_of``); every vector is indexed. Then each round joins neighbours of neighbours: a node's sampled
forward and reverse neighbours (new ones first) are joined with their vectors, all pairs in that bounded list are
compared, and all pairs nearer than a list's current last are merged into the lists. Rounds go on until under ``SETTLED``
of the entries are new. Rounds are written tables.

Greedy search keeps for each query a pool of the nearest nodes seen, expands the nearest unexpanded ones, and ends
when none is left. Trees, their sample, leaves and the pool grow with the number of nodes. A round joins the frontier with adjacency, deals the (query, node) pairs to buckets of
nodes where each needed query vector goes once, and merges distances into the pools.

Vectors that are null, zero, hold null or non-finite components, or differ in length from the smallest vec_id's valid one take
no part, as candidates or as queries; neither do rows with null ids. Distances are in double precision on the original
values; ties go to the smaller vec_id. Rows that repeat an id and vector count once. Other columns are ignored.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from atomweave.llm.common import discard, materialise

NEIGHBOURS = 24
SAMPLED = 32
#: Rounds after which building ends with a warning if the lists aren't settled; they usually are after a dozen.
ROUNDS = 100
#: Share of list entries replaced in a round below which building ends.
SETTLED = 0.02
TREES, LEAF, LEAF_MOST, TREE_SAMPLE = 2, 800, 2000, 20_000
REVERSE = 64
POOL, BEAM = 400, 64
#: Nodes up to which TREES and POOL do; the trees grow with the logarithm beyond, the pool with the square root.
FEW_NODES = 50_000
#: Vectors of the sample per leaf, so that medians are worth something.
PER_LEAF = 16
BUCKET_NODES = 2000


def pool_of(count: int) -> int:
    return int(np.ceil(POOL * max(1.0, count / FEW_NODES) ** 0.5))


def trees_of(count: int) -> int:
    return TREES + int(np.ceil(np.log2(max(1.0, count / FEW_NODES)) / 2))


def depth_of(count: int) -> int:
    return max(0, int(np.ceil(np.log2(max(1, count) / LEAF))))


def sample_of(count: int) -> int:
    """Vectors to fit the trees on: enough for leaves of LEAF, however many nodes there are."""
    return max(TREE_SAMPLE, 2 * PER_LEAF << depth_of(count))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    c = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return c.flatten().to_numpy(zero_copy_only=False).reshape(len(c), -1) if len(c) else np.zeros((0, 0))


def valid_vectors(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    v = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).where("vec_id IS NOT NULL AND v IS NOT NULL AND size(v) > 0")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return v.where(F.coalesce(fine, F.lit(False)) & F.exists("v", lambda x: x != 0))


def nodes_of(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, DataFrame, int]:
    """Nodes (id, v: one per distinct vector), members (id, vec_id: all rows), number of nodes."""
    v = valid_vectors(rows, id_col, vector_col)
    width = v.agg(F.min_by(F.size("v"), "vec_id")).first()[0]
    v = v.where(F.size("v") == (width or 0))
    nodes = materialise(v.groupBy("v").agg(F.min("vec_id").alias("id")).select("id", "v"), "nodes")
    # copies may be a third of all rows: their key is the vector's, dealt to salts
    salts = 16
    keyed = nodes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    members = v.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(salts)).cast("int")).join(keyed, ["v", "salt"]).select("id", "vec_id").distinct()
    return nodes, materialise(members, "members"), nodes.count()


def _bucket(c: str, n: int):
    return F.pmod(F.xxhash64(c), F.lit(n)).cast("int")


class Trees:
    """Random-projection trees with medians of a sample; a leaf's number is the path's bits."""

    def __init__(self, sample: np.ndarray, count: int, trees: int = TREES, seed: int = 11):
        rng = np.random.default_rng(seed)
        width = sample.shape[1] if len(sample) else 0
        self.depth = min(depth_of(count), int(np.log2(max(1, len(sample) / PER_LEAF))))
        self.normals = rng.standard_normal((trees, (1 << self.depth) - 1, width))
        self.cuts = np.zeros((trees, (1 << self.depth) - 1))
        for t in range(trees):
            parts = [np.arange(len(sample))]
            for level in range(self.depth):
                nxt = []
                for i, p in enumerate(parts):
                    at = (1 << level) - 1 + i
                    h = sample[p] @ self.normals[t, at]
                    self.cuts[t, at] = np.median(h) if len(p) else 0.0
                    nxt += [p[h <= self.cuts[t, at]], p[h > self.cuts[t, at]]]
                parts = nxt

    def leaves(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(self.normals), len(x)), np.int64)
        for t in range(len(self.normals)):
            for level in range(self.depth):
                at = (1 << level) - 1 + out[t]
                h = np.einsum("ij,ij->i", x, self.normals[t, at])
                out[t] = 2 * out[t] + (h > self.cuts[t, at])
        return out


def _nearest_in_order(ids: np.ndarray, nb: np.ndarray, d: np.ndarray, new: np.ndarray, k: int):
    """The k nearest of each id, each neighbour once (an old entry before a new one), sorted by id and nearness."""
    o = np.lexsort((new, nb, d, ids))
    ids, nb, d, new = ids[o], nb[o], d[o], new[o]
    o = np.lexsort((np.arange(len(ids)), nb, ids))  # the first of equal neighbours, whatever rounding did to d
    first = np.ones(len(ids), bool)
    first[1:] = (ids[o][1:] != ids[o][:-1]) | (nb[o][1:] != nb[o][:-1])
    keep = np.zeros(len(ids), bool)
    keep[o[first]] = True
    ids, nb, d, new = ids[keep], nb[keep], d[keep], new[keep]
    rank = np.arange(len(ids)) - np.searchsorted(ids, ids)
    keep = rank < k
    return ids[keep], nb[keep], d[keep], new[keep]


EDGES = "id long, nb long, d float, new boolean"


def _edges(ids, nb, d, new) -> pa.Table:
    return pa.table({"id": pa.array(ids, pa.int64()), "nb": pa.array(nb, pa.int64()), "d": pa.array(np.asarray(d, np.float32)), "new": pa.array(np.asarray(new, bool))})


def first_lists(nodes: DataFrame, count: int, k: int = NEIGHBOURS) -> DataFrame:
    """Exact neighbours within leaves of the trees; a leaf over LEAF_MOST is dealt by hash."""
    wanted = sample_of(count)
    share = min(1.0, wanted / max(1, count))
    sample = nodes.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int(share * (1 << 20))).select("v").limit(2 * wanted).toArrow()
    trees = Trees(_matrix(sample["v"]), count, trees_of(count))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t, leaf in enumerate(trees.leaves(_matrix(b.column(1)))):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(leaf), t), pa.int32()), pa.array(leaf), b.column(0), b.column(1).cast(pa.list_(pa.float32()))], ["tree", "leaf", "id", "v"])

    placed = nodes.select("id", "v").mapInArrow(place, "tree int, leaf long, id long, v array<float>")
    load = placed.groupBy("tree", "leaf").agg(F.ceil(F.count("*") / LEAF_MOST).cast("int").alias("chunks"))
    placed = placed.join(load, ["tree", "leaf"]).withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"))

    def compare(key, t):
        x, ids = _matrix(t["v"]), t["id"].to_numpy()
        n = min(k, len(ids) - 1)
        if n < 1:
            return _edges([], [], [], [])
        x = x - x.mean(0)
        sq = np.einsum("ij,ij->i", x, x)
        g = sq[:, None] + sq[None, :] - 2 * x @ x.T
        np.fill_diagonal(g, np.inf)
        at = np.argpartition(g, n - 1, 1)[:, :n]
        return _edges(np.repeat(ids, n), ids[at].ravel(), np.maximum(np.take_along_axis(g, at, 1), 0).ravel(), np.ones(at.size))

    return placed.groupBy("tree", "leaf", "chunk").applyInArrow(compare, EDGES)


def _merge(edges: DataFrame, buckets: int, k: int) -> DataFrame:
    def run(key, t):
        return _edges(*_nearest_in_order(*(t[c].to_numpy() for c in ("id", "nb", "d", "new")), k))

    return edges.withColumn("bucket", _bucket("id", buckets)).groupBy("bucket").applyInArrow(run, EDGES)


def _first_per_id(ids: np.ndarray, order: tuple, k: int) -> np.ndarray:
    o = np.lexsort((*order, ids))
    s = ids[o]
    return o[np.arange(len(s)) - np.searchsorted(s, s) < k]


def _hash_order(a: np.ndarray, b: np.ndarray, salt: int) -> np.ndarray:
    x = a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + b.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(salt)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)


def sampled_lists(edges: DataFrame, buckets: int, size: int, salt: int, nearest: bool = False) -> DataFrame:
    """(id, nb, new): of each node's forward and reverse neighbours, ``size`` (new first, then by hash; or the nearest).

    A node that many name is cut to ``size`` within each partition before the shuffle, so no task gets all of them.
    """

    def order(ids, nb, d, new):
        return (nb, d) if nearest else (_hash_order(ids, nb, salt), ~new)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = [b for b in batches if b.num_rows]
        if not t:
            return
        ids, nb, d, new = (np.concatenate([b.column(i).to_numpy(zero_copy_only=False) for b in t]) for i in range(4))
        a, b, d, new = np.concatenate([ids, nb]), np.concatenate([nb, ids]), np.concatenate([d, d]), np.concatenate([new, new])
        keep = _first_per_id(a, order(a, b, d, new), size)
        yield from _edges(a[keep], b[keep], d[keep], new[keep]).to_batches(max_chunksize=50_000)

    def final(key, t):
        ids, nb, d, new = (t[c].to_numpy() for c in ("id", "nb", "d", "new"))
        ids, nb, d, new = _nearest_in_order(ids, nb, d, new, 1 << 40)
        keep = _first_per_id(ids, order(ids, nb, d, new), size)
        return _edges(ids[keep], nb[keep], d[keep], new[keep])

    return edges.mapInArrow(local, EDGES).withColumn("bucket", _bucket("id", buckets)).groupBy("bucket").applyInArrow(final, EDGES)


def descend(edges: DataFrame, nodes: DataFrame, buckets: int, salt: int, k: int = NEIGHBOURS) -> DataFrame:
    """One round: compare all pairs in every node's sampled list, merge what is nearer."""
    last = edges.groupBy("id").agg(F.max("d").alias("far"), F.count("*").alias("n")).select("id", F.when(F.col("n") >= k, F.col("far")).otherwise(float("inf")).cast("float").alias("far"))
    named = nodes.select("id", F.col("v").cast("array<float>").alias("v")).join(last, "id", "left").select(F.col("id").alias("nb"), "v", F.coalesce("far", F.lit(float("inf"))).cast("float").alias("far"))
    lists = sampled_lists(edges, buckets, SAMPLED, salt).select("id", "nb", "new").join(named, "nb").withColumn("bucket", _bucket("id", buckets))

    def run(key, t):
        owner, nb, new, far = (t[c].to_numpy() for c in ("id", "nb", "new", "far"))
        v = _matrix(t["v"])
        o = np.argsort(owner, kind="stable")
        cuts = np.flatnonzero(np.diff(owner[o])) + 1
        out: list[tuple] = []
        for rows in np.split(o, cuts):
            if len(rows) < 2:
                continue
            x = v[rows] - v[rows].mean(0)
            sq = np.einsum("ij,ij->i", x, x)
            g = np.maximum(sq[:, None] + sq[None, :] - 2 * x @ x.T, 0)
            g[~(new[rows][:, None] | new[rows][None, :])] = np.inf
            np.fill_diagonal(g, np.inf)
            i, j = np.nonzero(g < far[rows][:, None])
            out.append((nb[rows][i], nb[rows][j], g[i, j]))
        if not out:
            return _edges([], [], [], [])
        a, b, d = (np.concatenate(x) for x in zip(*out))
        return _edges(*_nearest_in_order(a, b, d, np.ones(len(a), bool), k))  # no list takes more than k of them

    found = lists.groupBy("bucket").applyInArrow(run, EDGES)
    return _merge(edges.withColumn("new", F.lit(False)).union(found), buckets, k)


def build(nodes: DataFrame, count: int, k: int = NEIGHBOURS, rounds: int = ROUNDS) -> DataFrame:
    """The neighbour graph's edges (id, nb, d: squared distance, new)."""
    buckets = max(1, -(-count // BUCKET_NODES))
    edges = materialise(_merge(first_lists(nodes, count, k), buckets, k), "graph")
    for i in range(rounds):
        nxt = materialise(descend(edges, nodes, buckets, i, k), "graph")
        discard(edges)
        edges = nxt
        fresh = edges.agg(F.avg(F.col("new").cast("double"))).first()[0] or 0.0
        if fresh < SETTLED:
            break
    else:
        warnings.warn(f"neighbour lists aren't settled after {rounds} rounds", stacklevel=2)
    return edges


def search(edges: DataFrame, nodes: DataFrame, starts: DataFrame, count: int, keep: int, pool: int | None = None, beam: int = BEAM) -> DataFrame:
    """(q, id, d): the ``keep`` nearest nodes found for each query node in starts (q), itself among them, d Euclidean."""
    buckets, pool = max(1, -(-count // BUCKET_NODES)), pool or pool_of(count)
    adjacency = materialise(sampled_lists(edges, buckets, NEIGHBOURS + REVERSE, 0, nearest=True).groupBy("id").agg(F.collect_list("nb").alias("nbs")), "adjacency")
    vectors = materialise(nodes.select(_bucket("id", buckets).alias("bucket"), "id", "v"), "vectors")
    state_type = "q long, ids array<long>, ds array<double>, done array<boolean>, front array<long>"
    state = materialise(
        starts.select("q", F.array("q").alias("ids"), F.array(F.lit(0.0)).alias("ds"), F.array(F.lit(True)).alias("done"), F.array("q").alias("front")), "pools"
    )

    def measure(key, t):
        kind, q, ids, far = (t[c].to_numpy() for c in ("kind", "q", "id", "far"))
        pairs = np.flatnonzero(kind == 2)
        if not len(pairs):
            return pa.table({"q": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "d": pa.array([], pa.float64())})
        some = np.flatnonzero(kind != 2)
        v = _matrix(t["v"].combine_chunks().take(pa.array(some)))
        is_node = kind[some] == 0
        nid, nv, qid, qv, qfar = ids[some][is_node], v[is_node], q[some][~is_node], v[~is_node], far[some][~is_node]
        no, qo = np.argsort(nid), np.argsort(qid)
        pq, pi = q[pairs], ids[pairs]
        at_n, at_q = no[np.searchsorted(nid, pi, sorter=no)], qo[np.searchsorted(qid, pq, sorter=qo)]
        d = np.empty(len(pairs))
        for i in range(0, len(pairs), 16_384):
            x = nv[at_n[i : i + 16_384]] - qv[at_q[i : i + 16_384]]
            d[i : i + 16_384] = np.sqrt(np.einsum("ij,ij->i", x, x))
        ok = d <= qfar[at_q]
        return pa.table({"q": pa.array(pq[ok]), "id": pa.array(pi[ok]), "d": pa.array(d[ok])})

    def update(key, old, found):
        ids, ds, done = (np.array(old[c][0].as_py()) for c in ("ids", "ds", "done"))
        new = ~np.isin(found["id"].to_numpy(), ids)
        ids = np.concatenate([ids, found["id"].to_numpy()[new]])
        ds = np.concatenate([ds, found["d"].to_numpy()[new]])
        done = np.concatenate([done.astype(bool), np.zeros(int(new.sum()), bool)])
        o = np.lexsort((ids, ds))[:pool]
        ids, ds, done = ids[o], ds[o], done[o]
        front = np.flatnonzero(~done)[:beam]
        done[front] = True
        return pa.table(
            {
                "q": pa.array([key[0].as_py()], pa.int64()),
                "ids": pa.array([ids.tolist()], pa.list_(pa.int64())),
                "ds": pa.array([ds.tolist()], pa.list_(pa.float64())),
                "done": pa.array([done.tolist()], pa.list_(pa.bool_())),
                "front": pa.array([ids[front].tolist()], pa.list_(pa.int64())),
            }
        )

    nothing = F.lit(None).cast("array<double>")
    while True:  # a pool only gets nearer, so there is an end
        if not state.where(F.size("front") > 0).limit(1).count():
            break
        pairs = state.select("q", F.explode("front").alias("id")).join(adjacency, "id").select("q", F.explode("nbs").alias("id")).distinct()
        pairs = materialise(pairs.withColumn("bucket", _bucket("id", buckets)), "pairs")
        far = F.when(F.size("ids") >= pool, F.element_at("ds", -1)).otherwise(float("inf"))
        asks = state.select("q", far.alias("far")).join(nodes.select(F.col("id").alias("q"), "v"), "q").join(pairs.select("q", "bucket").distinct(), "q")
        rows = (
            vectors.select("bucket", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("q"), "id", F.lit(0.0).alias("far"), "v")
            .union(asks.select("bucket", F.lit(1), "q", F.lit(0).cast("long"), "far", "v"))
            .union(pairs.select("bucket", F.lit(2), "q", "id", F.lit(0.0), nothing))
        )
        found = rows.groupBy("bucket").applyInArrow(measure, "q long, id long, d double")
        nxt = materialise(state.groupBy("q").cogroup(found.groupBy("q")).applyInArrow(update, state_type), "pools")
        discard(state, pairs)
        state = nxt
    best = state.select("q", F.explode(F.slice(F.arrays_zip("ids", "ds"), 1, keep)).alias("x")).select("q", F.col("x.ids").alias("id"), F.col("x.ds").alias("d"))
    best = materialise(best, "found")
    discard(adjacency, vectors, state)
    return best


def nearest(rows: DataFrame, is_query, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows found for every row that ``is_query`` (a Column of vec_id) names."""
    nodes, members, count = nodes_of(rows, id_col, vector_col)
    edges = build(nodes, count)
    queries = members.where(is_query).select(F.col("id").alias("q"), F.col("vec_id").alias("query_id"))
    found = search(edges, nodes, queries.select("q").distinct(), count, 2 * k + 2)
    w = Window.partitionBy("id").orderBy("vec_id")
    some = members.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k + 1).drop("r")  # of copies the k + 1 first can count
    near = found.join(some, "id").join(queries, "q").where("vec_id <> query_id")
    by = Window.partitionBy("query_id").orderBy("d", "vec_id")
    return near.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", F.col("d").alias("score"))
