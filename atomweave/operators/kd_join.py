"""Exact neighbour and radius joins over vectors by kd-cells, with outlier factors and density clusters on top.

Equal vectors are one point first, with how many rows it stands for and the ids of as many as can ever be neighbours, so copies
neither fill a cell nor multiply pairs. A kd-tree cut at medians of a bounded sample has at most ``LEAVES`` cells; each cell is one group, and within
it points are cut into blocks. A pair of blocks is only measured if their boxes are near enough.

Join: within its own cell a point finds a bound for the distance of its k-th neighbour. It is sent to those other cells alone whose box is
within that bound, and never further than the radius asked for. So no neighbour can be missed, and no round is repeated. Queries that one cell gets
are dealt to units of bounded size, to which the cell's points are copied.

Vectors that are null, hold null or non-finite components or have another length than most take no part. Rows that repeat an id are
never neighbours of each other, and are one row where their vectors are equal.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from atomweave.operators.components import components
from atomweave.operators.work import written

#: Cells at most, points for a cell where there are fewer, sampled points for a cell.
LEAVES, CELL, SAMPLE = 1024, 512, 32
#: Points of a block within a cell; queries of a unit.
BLOCK, UNIT = 128, 8192
#: Rows of one point above which its list is copied to several salts.
MANY, SALTS = 1000, 16
#: Points of a block where all pairs are measured, blocks where there are fewer, rows that are multiplied at once; queries drawn to tell.
WIDE, BLOCKS, STRIP, DRAWN = 16384, 16, 256, 500
#: What rounding of distances to nine digits may hide.
SLACK = 1e-9


class Tree:
    """Cuts of space at medians: cells are numbered from 0."""

    def __init__(self, sample: np.ndarray, leaves: int):
        self.cuts: list[tuple[int, float, object, object]] = []
        self.leaves = 0
        self.root = self._grow(sample, leaves)

    def _grow(self, x: np.ndarray, leaves: int):
        if leaves > 1 and len(x) > 1:
            axis = int(np.argmax(x.max(0) - x.min(0)))
            cut = float(np.median(x[:, axis]))
            right = x[:, axis] >= cut
            if right.all():
                right = x[:, axis] > cut
                cut = float(x[right, axis].min()) if right.any() else cut
            if right.any() and not right.all():
                return axis, cut, self._grow(x[~right], leaves // 2), self._grow(x[right], leaves - leaves // 2)
        self.leaves += 1
        return self.leaves - 1

    def locate(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), np.int32)
        todo = [(self.root, np.arange(len(x)))]
        while todo:
            node, at = todo.pop()
            if isinstance(node, int):
                out[at] = node
            elif len(at):
                right = x[at, node[0]] >= node[1]
                todo += [(node[2], at[~right]), (node[3], at[right])]
        return out


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _vectors(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))


def _blocks(x: np.ndarray) -> list[np.ndarray]:
    """Row numbers of blocks of near points: halves along the widest axis until they are small."""
    todo, out = [np.arange(len(x))], []
    while todo:
        at = todo.pop()
        if len(at) <= BLOCK:
            out.append(at)
            continue
        axis = int(np.argmax(x[at].max(0) - x[at].min(0)))
        at = at[np.argsort(x[at, axis], kind="stable")]
        todo += [at[: len(at) // 2], at[len(at) // 2 :]]
    return [b for b in out if len(b)]


def _gap(low: np.ndarray, high: np.ndarray, lows: np.ndarray, highs: np.ndarray) -> np.ndarray:
    """Distances of a box (or point) from boxes."""
    return np.sqrt((np.maximum(np.maximum(lows - high, low - highs), 0) ** 2).sum(-1))


class Search:
    """The points of a cell, ready to be asked."""

    def __init__(self, x: np.ndarray, pid: np.ndarray, n: np.ndarray, first: np.ndarray):
        self.x, self.pid, self.n, self.first = x, pid, n, first
        self.blocks = _blocks(x) if len(x) else []
        self.low = np.array([x[b].min(0) for b in self.blocks])
        self.high = np.array([x[b].max(0) for b in self.blocks])
        self.measured = 0

    def _distances(self, q: np.ndarray, at: np.ndarray) -> np.ndarray:
        self.measured += len(q) * len(at)
        return np.sqrt(((q[:, None] - self.x[at][None]) ** 2).sum(2)) if q.shape[1] <= 8 else np.sqrt(np.maximum(self._by_differences(q, at), 0))

    def _by_differences(self, q: np.ndarray, at: np.ndarray) -> np.ndarray:
        out = np.zeros((len(q), len(at)))
        for i in range(0, q.shape[1], 16):  # exact differences, without an array of all components
            out += ((q[:, None, i : i + 16] - self.x[at][None, :, i : i + 16]) ** 2).sum(2)
        return out

    def nearest(self, q: np.ndarray, qid: np.ndarray, reach: np.ndarray, k: int) -> list[list[tuple[float, int, int, int, float]]]:
        """For each query its k nearest points (rounded distance, first id, pid, rows, distance), itself left out, within its reach; reach shrinks as rows are counted."""
        best: list[list[tuple[float, int, int, int, float]]] = [[] for _ in qid]
        for rows in _blocks(q) if len(q) else []:
            low, high = q[rows].min(0), q[rows].max(0)
            gaps = _gap(low, high, self.low, self.high) if self.blocks else np.zeros(0)
            for b in np.argsort(gaps, kind="stable"):
                asked = rows[reach[rows] + SLACK >= gaps[b]]
                asked = asked[_gap(q[asked], q[asked], self.low[b], self.high[b]) <= reach[asked] + SLACK]
                if not len(asked):
                    continue
                at = self.blocks[b]
                d = self._distances(q[asked], at)
                near = (d <= reach[asked][:, None] + SLACK) & (self.pid[at][None] != qid[asked][:, None])
                for i, j in enumerate(asked.tolist()):
                    hit = np.flatnonzero(near[i])
                    if len(hit) > k:
                        hit = hit[d[i, hit] <= np.partition(d[i, hit], k - 1)[k - 1] + SLACK]
                    if len(hit):
                        mine, to = at[hit], np.round(d[i, hit], 9)
                        best[j] = sorted([*best[j], *zip(to.tolist(), self.first[mine].tolist(), self.pid[mine].tolist(), self.n[mine].tolist(), d[i, hit].tolist())])[:k]
                        seen = np.cumsum([x[3] for x in best[j]])
                        if seen[-1] >= k:
                            reach[j] = min(reach[j], best[j][int(np.searchsorted(seen, k))][0])
        return best

    def within(self, q: np.ndarray, qid: np.ndarray, radius: float) -> Iterator[tuple[int, np.ndarray]]:
        """(query, points within the radius) of queries that have some, themselves among them."""
        for rows in _blocks(q) if len(q) else []:
            gaps = _gap(q[rows].min(0), q[rows].max(0), self.low, self.high) if self.blocks else np.zeros(0)
            met = [self.blocks[b] for b in np.flatnonzero(gaps <= radius)]
            if met:
                at = np.concatenate(met)
                near = self._distances(q[rows], at) <= radius
                for i, j in enumerate(rows.tolist()):
                    if near[i].any():
                        yield j, at[near[i]]


def points_of(rows: DataFrame, key: str, vector: str, copies: int) -> tuple[DataFrame, DataFrame]:
    """(pid, v, n, first, ids) of distinct vectors, ids being the ``copies`` smallest; and (id, pid, n) of the rows. Both are written."""
    v = rows.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where("id IS NOT NULL AND v IS NOT NULL")
    v = v.where(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))).withColumn("v", F.transform("v", lambda x: x + 0.0))  # no negative zero
    v = written(v.where("size(v) > 0").withColumn("h", F.xxhash64("v")), "vectors")
    length = v.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), "size").limit(1).collect()
    v = v.where(F.size("v") == (length[0]["size"] if length else 0))
    points = v.groupBy("h", "v").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    few = v.select("h", "v", "id").distinct().withColumn("r", F.row_number().over(Window.partitionBy("h", "v").orderBy("id"))).where(F.col("r") <= copies)
    ids = few.groupBy("h", "v").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    # ids may repeat with other vectors: points are numbered of their own
    points = written(points.join(ids, ["h", "v"]).select(F.monotonically_increasing_id().alias("pid"), "h", "v", "n", "first", "ids"), "points")
    salt = lambda seed: F.when(F.col("n") > MANY, F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(SALTS))).otherwise(0).cast("int")
    return points, v.join(points.select("h", "v", "pid", "n"), ["h", "v"]).select("id", "pid", "n", salt(3).alias("salt"))


def _celled(points: DataFrame) -> tuple[DataFrame, np.ndarray, np.ndarray, np.ndarray]:
    """Points with their cell; numbers and boxes of the cells that have some (at most LEAVES)."""
    spark, n = points.sparkSession, points.count()
    leaves = max(1, min(LEAVES, -(-n // CELL)))
    wanted = leaves * SAMPLE
    drawn = points.where(F.pmod(F.xxhash64("h", F.lit(41)), F.lit(1 << 30)) < int((1 << 30) * min(1.0, 1.2 * wanted / max(1, n)))).select("v").limit(2 * wanted)
    tree = Tree(_matrix(drawn.toArrow()["v"]), leaves)
    at = spark.sparkContext.broadcast(tree)

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell = at.value.locate(_matrix(b.column("v")))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("pid", "v", "n", "first")), pa.array(cell)], ["pid", "v", "n", "first", "cell"])

    placed = written(points.select("pid", "v", "n", "first").mapInArrow(locate, "pid long, v array<double>, n long, first long, cell int"), "cells")

    def boxes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low: dict[int, np.ndarray] = {}
        high: dict[int, np.ndarray] = {}
        for b in batches:
            x, c = _matrix(b.column("v")), b.column("cell").to_numpy()
            for i in np.unique(c).tolist():
                a, z = x[c == i].min(0), x[c == i].max(0)
                low[i], high[i] = (np.minimum(low[i], a), np.maximum(high[i], z)) if i in low else (a, z)
        if low:
            yield pa.RecordBatch.from_arrays([pa.array([*low], pa.int32()), _vectors(np.stack([*low.values()])), _vectors(np.stack([*high.values()]))], ["cell", "low", "high"])

    parts = placed.select("v", "cell").mapInArrow(boxes, "cell int, low array<double>, high array<double>")
    whole = parts.select("cell", F.posexplode(F.arrays_zip("low", "high")).alias("i", "b")).groupBy("cell", "i").agg(F.min("b.low").alias("low"), F.max("b.high").alias("high"))
    got = whole.groupBy("cell").agg(F.array_sort(F.collect_list(F.struct("i", "low", "high"))).alias("b")).select("cell", "b.low", "b.high").orderBy("cell").toArrow()
    return placed, got["cell"].to_numpy(), _matrix(got["low"]), _matrix(got["high"])


def _sent(queries: DataFrame, cells: np.ndarray, low: np.ndarray, high: np.ndarray, extra: str) -> DataFrame:
    """Queries (pid, v, cell, reach, extra) once for each other cell whose box is within their reach."""
    at = queries.sparkSession.sparkContext.broadcast((cells, low, high))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, low, high = at.value
        for b in batches:
            x, own, reach = _matrix(b.column("v")), b.column("cell").to_numpy(), b.column("reach").to_numpy()
            step = max(1, (1 << 20) // max(1, low.size))
            for i in range(0, len(x), step):
                part = slice(i, i + step)
                gaps = _gap(x[part, None], x[part, None], low[None], high[None])
                q, c = np.nonzero((gaps <= reach[part, None] + SLACK) & (cells[None] != own[part, None]))
                if len(q):
                    row = pa.array(q + i)
                    yield pa.RecordBatch.from_arrays([b.column("pid").take(row), b.column("v").take(row), pa.array(cells[c]), b.column("reach").take(row), b.column(extra).take(row)], ["pid", "v", "cell", "reach", extra])

    kind = dict(queries.dtypes)[extra]
    return queries.select("pid", "v", "cell", "reach", extra).mapInArrow(send, f"pid long, v array<double>, cell int, reach double, {extra} {kind}")


def _units(queries: DataFrame, members: DataFrame, extra: str) -> DataFrame:
    """Queries of a cell dealt to units, each with all points of the cell; ``own`` tells points from queries."""
    loads = queries.groupBy("cell").agg(F.ceil(F.count("*") / UNIT).cast("int").alias("units"))
    dealt = queries.join(F.broadcast(loads), "cell").withColumn("unit", F.pmod(F.xxhash64("pid", F.lit(17)), F.col("units")).cast("int"))
    copied = members.join(F.broadcast(loads), "cell").withColumn("unit", F.explode(F.sequence(F.lit(0), F.col("units") - 1)))
    cols = ["cell", "unit", "pid", "v", "n", "first", "reach", extra]
    return dealt.withColumn("n", F.lit(0).cast("long")).withColumn("first", F.lit(0).cast("long")).select(*cols, F.lit(False).alias("own")).unionByName(copied.withColumn("reach", F.lit(0.0)).select(*cols, F.lit(True).alias("own")))


def _blocks_for_all(points: DataFrame, cells: np.ndarray, low: np.ndarray, high: np.ndarray, reach: Column) -> int:
    """How many blocks to deal points to, if sending each query to all cells within its reach costs more than that; else 0."""
    n = points.count()
    blocks = max(-(-n // WIDE), min(BLOCKS, -(-n // 1024)))
    if len(cells) <= 2 * blocks:
        return 0
    drawn = points.where(F.pmod(F.xxhash64("pid", F.lit(29)), F.lit(max(1, n // DRAWN))) == 0).withColumn("reach", reach)
    asked = max(1, drawn.count())
    return blocks if _sent(drawn, cells, low, high, "n").count() > 2 * blocks * asked else 0


def _block_units(points: DataFrame, blocks: int, apart: bool) -> DataFrame:
    """Points of each pair of blocks (a, b), a before b; ``own`` are those of a. Unless ``apart``, also each block with itself, as a."""
    r = points.withColumn("block", F.pmod(F.xxhash64("pid", F.lit(31)), F.lit(blocks)).cast("int"))
    first = r.withColumnRenamed("block", "a").withColumn("b", F.explode(F.sequence(F.col("a") + 1, F.lit(blocks)) if apart else F.sequence("a", F.lit(blocks - 1)))).where(F.col("b") < blocks)
    second = r.withColumnRenamed("block", "b").where("b > 0").withColumn("a", F.explode(F.sequence(F.lit(0), F.col("b") - 1)))
    return first.withColumn("own", F.lit(True)).unionByName(second.withColumn("own", F.lit(False))).groupBy("a", "b")


def _sides(table) -> tuple:
    """(vectors, rows of the table) of the unit's blocks; the second is the first where a block meets itself."""
    own, x = table["own"].to_numpy(zero_copy_only=False), _matrix(table["v"])
    i, j = np.flatnonzero(own), np.flatnonzero(~own)
    j = i if table["a"][0] == table["b"][0] else j
    return x[i], x[j], i, j


def _near_strips(x: np.ndarray, y: np.ndarray, radius: float) -> Iterator[tuple[slice, np.ndarray]]:
    """Strips of y with which points of x are within the radius."""
    xx, yy = (x * x).sum(1), (y * y).sum(1)
    slack = 4 * x.shape[1] * np.finfo(float).eps * (xx.max(initial=0) + yy.max(initial=0))
    for i in range(0, len(y) if len(x) else 0, STRIP):
        part = slice(i, i + STRIP)
        d = yy[part, None] + xx[None] - 2 * (y[part] @ x.T)
        near = d <= radius * radius
        p, q = np.nonzero(np.abs(d - radius * radius) <= slack)
        for k in range(0, len(p), 1 << 16):
            r, c = p[k : k + (1 << 16)], q[k : k + (1 << 16)]
            near[r, c] = np.sqrt(((y[part][r] - x[c]) ** 2).sum(1)) <= radius
        yield part, near


def _join_parts(parent: np.ndarray, u: np.ndarray, w: np.ndarray) -> None:
    """Join the parts of linked items; parents are roots before and after, the least of their part."""
    while True:
        a, b = parent[u], parent[w]
        apart = a != b
        if not apart.any():
            return
        np.minimum.at(parent, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while (parent[parent] != parent).any():
            parent[:] = parent[parent]


def _links_in_blocks(placed: DataFrame, blocks: int, radius: float, least: int) -> DataFrame:
    """(pid, part, core) as cells give them: each core point with the least of its part; parts with parts of other blocks; points that aren't core with parts near them."""

    def count(key, table):
        x, y, i, j = _sides(table)
        n, pid = table["n"].to_numpy(), table["pid"].to_numpy()
        of_x, of_y = np.zeros(len(x), np.int64), np.zeros(len(y), np.int64)
        for part, near in _near_strips(x, y, radius):
            weight = near.astype(float)  # sums of whole numbers are exact
            of_y[part] = weight @ n[i].astype(float)
            of_x += (n[j][part].astype(float) @ weight).astype(np.int64)
        if i is j:
            return pa.table({"pid": pid[i], "near": of_y})
        return pa.table({"pid": np.concatenate([pid[i], pid[j]]), "near": np.concatenate([of_x, of_y])})

    counts = _block_units(placed.select("pid", "v", "n"), blocks, False).applyInArrow(count, "pid long, near long")
    core = counts.groupBy("pid").agg(F.sum("near").alias("near")).where(F.col("near") >= least).select("pid", F.lit(1).alias("core"))
    cored = written(placed.select("pid", "v").join(core, "pid", "left").withColumn("core", F.coalesce("core", F.lit(0))), "core-blocks")

    def result(pid, part, core):
        return pa.table({"pid": pa.array(pid, pa.int64()), "part": pa.array(part, pa.int64()), "core": pa.array(core, pa.int64())})

    def parts(key, table):
        x, pid, core = _matrix(table["v"]), table["pid"].to_numpy(), table["core"].to_numpy() > 0
        order = np.argsort(pid)
        x, pid, core = x[order], pid[order], core[order]
        c, loose, parent = np.flatnonzero(core), [], np.arange(len(pid))
        for part, near in _near_strips(x[c], x, radius):
            p, q = np.nonzero(near)
            u, w = p + part.start, c[q]
            both = core[u]
            _join_parts(parent, u[both], w[both])
            loose.append(np.unique(np.stack([u[~both], parent[w[~both]]], 1), axis=0))
        pairs = np.concatenate(loose) if loose else np.zeros((0, 2), np.int64)
        pairs = np.unique(np.stack([pairs[:, 0], parent[pairs[:, 1]]], 1), axis=0)
        return result([*pid[c], *pid[pairs[:, 0]]], [*pid[parent[c]], *pid[pairs[:, 1]]], [1] * len(c) + [0] * len(pairs))

    block = F.pmod(F.xxhash64("pid", F.lit(31)), F.lit(blocks))
    own = written(cored.groupBy(block).applyInArrow(parts, "pid long, part long, core long"), "parts")
    named = cored.join(own.where("core = 1").select("pid", "part"), "pid", "left").withColumn("part", F.coalesce("part", F.lit(-1)))

    def across(key, table):
        x, y, i, j = _sides(table)
        pid, part_of = table["pid"].to_numpy(), table["part"].to_numpy()
        pi, pj, si, sj, found = part_of[i], part_of[j], pid[i], pid[j], {0: [], 1: []}
        for part, near in _near_strips(x, y, radius):
            p, q = np.nonzero(near & ((pj[part, None] >= 0) | (pi[None] >= 0)))
            p = p + part.start
            a, b = pj[p], pi[q]
            for core, left, right in ((1, a, b), (0, np.where(a < 0, sj[p], si[q]), np.where(a < 0, b, a))):
                of = (a >= 0) & (b >= 0) if core else (a < 0) | (b < 0)
                found[core].append(np.unique(np.stack([left[of], right[of]], 1), axis=0))
        got = {k: np.unique(np.concatenate(v), axis=0) if v else np.zeros((0, 2), np.int64) for k, v in found.items()}
        return result(np.concatenate([got[1][:, 0], got[0][:, 0]]), np.concatenate([got[1][:, 1], got[0][:, 1]]), [1] * len(got[1]) + [0] * len(got[0]))

    return written(own.unionByName(_block_units(named, blocks, True).applyInArrow(across, "pid long, part long, core long")), "links")


_FOUND = "pid long, near array<struct<d: double, first: long, other: long, raw: double>>, reach double, measured long"


def _nearest_in_blocks(points: DataFrame, blocks: int, k: int) -> DataFrame:
    """Points (pid, v, n, first, reach) with the k nearest within their reach in each pair of blocks, as cells give them."""

    def found(y, x, pid_y, pid_x, first, reach) -> list:
        xx, yy, out = (x * x).sum(1), (y * y).sum(1), []
        slack = 4 * x.shape[1] * np.finfo(float).eps * (xx.max(initial=0) + yy.max(initial=0))
        bound = lambda d: (d + 2 * SLACK) ** 2 + 2 * slack
        for i in range(0, len(y) if len(x) else 0, STRIP):
            part = slice(i, i + STRIP)
            d = yy[part, None] + xx[None] - 2 * (y[part] @ x.T)
            if pid_y is pid_x:
                d[np.arange(d.shape[0]), np.arange(i, i + d.shape[0])] = np.inf
            most = bound(reach[part])
            many = np.flatnonzero((d <= most[:, None]).sum(1) > k)
            if len(many):
                most[many] = np.minimum(most[many], bound(np.sqrt(np.maximum(np.partition(d[many], k - 1, axis=1)[:, k - 1], 0))))
            p, q = np.nonzero(d <= most[:, None])
            exact = np.concatenate([np.zeros(0), *(np.sqrt(((y[part][p[c : c + 65536]] - x[q[c : c + 65536]]) ** 2).sum(1)) for c in range(0, len(p), 65536))])
            to = np.round(exact, 9)
            order = np.lexsort((pid_x[q], first[q], to, p))
            p, q, exact, to = p[order], q[order], exact[order], to[order]
            place = np.arange(len(p)) - np.searchsorted(p, p)
            keep = (place < k) & (exact <= reach[part][p] + SLACK)
            out.append((pid_y[part][p[keep]], to[keep], first[q[keep]], pid_x[q[keep]], exact[keep]))
        return out

    def unit(key, table):
        x, y, i, j = _sides(table)
        pid, first, reach = (table[c].to_numpy() for c in ("pid", "first", "reach"))
        a = pid[i]
        b = a if i is j else pid[j]
        got = found(y, x, b, a, first[i], reach[j])
        asked = [(b, len(x))]
        if i is not j:
            got += found(x, y, a, b, first[j], reach[i])
            asked.append((a, len(y)))
        of, d, first, other, raw = (np.concatenate([g[c] for g in got]) if got else np.zeros(0) for c in range(5))
        order = np.argsort(of, kind="stable")  # nearest first, as they are
        of, near = of[order].astype(np.int64), pa.StructArray.from_arrays([pa.array(c[order].astype(t)) for c, t in ((d, float), (first, np.int64), (other, np.int64), (raw, float))], ["d", "first", "other", "raw"])
        ids, starts = np.unique(of, return_index=True)
        measured = {}
        for who, m in asked:
            measured |= dict.fromkeys(who.tolist(), m)
        lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(of)).astype(np.int32)), near)
        rest = np.setdiff1d(np.array([*measured], np.int64), ids)
        near = pa.concat_arrays([lists, pa.array([[]] * len(rest), lists.type)])
        ids = np.concatenate([ids, rest])
        return pa.table({"pid": pa.array(ids, pa.int64()), "near": near, "reach": pa.array(np.zeros(len(ids))), "measured": pa.array([measured[x] for x in ids.tolist()], pa.int64())})

    return _block_units(points.select("pid", "v", "n", "first", "reach"), blocks, False).applyInArrow(unit, _FOUND)


def _search(table, rows=slice(None)) -> Search:
    return Search(_matrix(table["v"])[rows], *(table[c].to_numpy()[rows] for c in ("pid", "n", "first")))


def nearest_join(rows: DataFrame, key: str, vector: str, k: int, radius: float = float("inf")) -> DataFrame:
    """(id, rank, other, d, raw, measured): each row's k nearest other rows within ``radius`` by Euclidean distance, then id.

    d is rounded to nine digits, which ranks; raw is not rounded. measured is how many points the row's point was measured against, the same in all its rows.
    """
    points, members = points_of(rows, key, vector, k + 1)
    placed, cells, low, high = _celled(points)

    def own_cell(key, table):
        search = _search(table)
        reach = np.where(search.n > k, 0.0, radius)  # its own copies are near enough
        near = search.nearest(search.x, search.pid, reach, k)
        return _table(search.pid, near, reach, search.measured)

    def _table(pid, near, reach, measured):
        kind = pa.list_(pa.struct([("d", pa.float64()), ("first", pa.int64()), ("other", pa.int64()), ("raw", pa.float64())]))
        share = np.full(len(pid), measured // max(1, len(pid)), np.int64)
        share[: measured - int(share.sum())] += 1
        return pa.table({"pid": pa.array(pid), "near": pa.array([[{"d": d, "first": f, "other": p, "raw": raw} for d, f, p, _, raw in x] for x in near], kind), "reach": pa.array(reach), "measured": pa.array(share)})

    first = written(placed.groupBy("cell").applyInArrow(own_cell, _FOUND), "near-in-cell")
    queries = placed.join(first.select("pid", "reach"), "pid")
    blocks = _blocks_for_all(queries, cells, low, high, F.col("reach"))

    def other_cell(key, table):
        own = table["own"].to_numpy(zero_copy_only=False)
        search, x, pid = _search(table, own), _matrix(table["v"])[~own], table["pid"].to_numpy()[~own]
        reach = table["reach"].to_numpy()[~own].copy()
        return _table(pid, search.nearest(x, pid, reach, k), reach, search.measured)

    if blocks:  # the own cell's lists are found again
        first, second = first.limit(0), _nearest_in_blocks(queries, blocks, k)
    else:
        sent = written(_sent(queries, cells, low, high, "n").drop("n"), "sent")
        second = _units(sent.withColumn("none", F.lit(0)), placed.withColumn("none", F.lit(0)), "none").groupBy("cell", "unit").applyInArrow(other_cell, _FOUND)
    found = written(first.unionByName(second), "near")
    measured = found.groupBy("pid").agg(F.sum("measured").alias("measured"))
    best = found.select("pid", F.explode("near").alias("x")).select("pid", "x.*")
    rank = F.row_number().over(Window.partitionBy("pid").orderBy("d", "first", "other"))
    best = best.withColumn("r", rank).where(F.col("r") <= k).select("pid", "d", "raw", "other").unionByName(points.select("pid", F.lit(0.0).alias("d"), F.lit(0.0).alias("raw"), F.col("pid").alias("other")))
    # each point's nearest rows: one more than asked for, as a row itself may be among them
    ids = best.join(points.select(F.col("pid").alias("other"), "ids"), "other").select("pid", "d", "raw", F.explode("ids").alias("other"))
    rank = F.row_number().over(Window.partitionBy("pid").orderBy("d", "other"))
    lists = ids.withColumn("r", rank).where((F.col("r") <= k + 1) & (F.col("raw") <= radius)).groupBy("pid").agg(F.array_sort(F.collect_list(F.struct("d", "other", "raw"))).alias("near"))
    lists = lists.join(points.select("pid", "n"), "pid").join(measured, "pid").withColumn("salt", F.explode(F.sequence(F.lit(0), F.when(F.col("n") > MANY, SALTS - 1).otherwise(0)))).drop("n")
    out = members.select("id", "pid", "salt").distinct().join(lists, ["pid", "salt"])
    near = F.slice(F.filter("near", lambda x: x["other"] != F.col("id")), 1, k)
    return out.select("id", "measured", F.posexplode(near).alias("rank", "x")).select("id", (F.col("rank") + 1).cast("long").alias("rank"), F.col("x.other").alias("other"), F.col("x.d").alias("d"), F.col("x.raw").alias("raw"), "measured")


def outlier_factors(rows: DataFrame, key: str, vector: str, k: int = 5, radius: float = float("inf")) -> DataFrame:
    """(id, lof): local outlier factors over the k nearest neighbours, whole table; null where there are fewer rows than k + 1 within ``radius``."""
    near = written(nearest_join(rows, key, vector, k, radius).drop("measured", "raw"), "neighbours")
    far = near.groupBy("id").agg(F.max(F.when(F.col("rank") == k, F.col("d"))).alias("far"))
    density = near.join(far.select(F.col("id").alias("other"), "far"), "other").groupBy("id").agg((1 / (F.avg(F.greatest("far", "d")) + 1e-10)).alias("density"), F.count("far").alias("m"))
    density = written(density.withColumn("density", F.when(F.col("m") == k, F.col("density"))).drop("m"), "densities")
    around = near.join(density.select(F.col("id").alias("other"), F.col("density").alias("theirs")), "other").groupBy("id").agg(F.avg("theirs").alias("theirs"))
    return density.join(around, "id").select("id", (F.col("theirs") / F.col("density")).alias("lof"))


def _links_in_cells(placed: DataFrame, cells: np.ndarray, low: np.ndarray, high: np.ndarray, radius: float, least: int) -> DataFrame:
    """(pid, part, core): each core point with the least of its part of the cell, and with parts near it in others; points that aren't core with parts near them, core 0."""
    sent = written(_sent(placed.withColumn("reach", F.lit(float(radius))), cells, low, high, "n"), "sent").withColumn("none", F.lit(0))
    placed0 = placed.withColumn("none", F.lit(0))

    def both(key, table, f):
        own = table["own"].to_numpy(zero_copy_only=False)
        return f(_search(table, own), own, _matrix(table["v"]), table["pid"].to_numpy())

    def count(key, table):
        def run(search, own, x, pid):
            got = [(j, int(search.n[at].sum())) for j, at in search.within(x[~own], pid[~own], radius)]
            return pa.table({"pid": pa.array(pid[~own][[j for j, _ in got]] if got else [], pa.int64()), "near": pa.array([c for _, c in got], pa.int64())})

        return both(key, table, run)

    def count_own(key, table):
        search = _search(table)
        got = [(j, int(search.n[at].sum())) for j, at in search.within(search.x, search.pid, radius)]
        return pa.table({"pid": pa.array(search.pid[[j for j, _ in got]]), "near": pa.array([c for _, c in got], pa.int64())})

    counts = placed.groupBy("cell").applyInArrow(count_own, "pid long, near long")
    counts = counts.unionByName(_units(sent.drop("n"), placed0, "none").groupBy("cell", "unit").applyInArrow(count, "pid long, near long"))
    core = counts.groupBy("pid").agg(F.sum("near").alias("near")).where(F.col("near") >= least).select("pid", F.lit(1).alias("core"))
    cored = written(placed.join(core, "pid", "left").withColumn("core", F.coalesce("core", F.lit(0))), "core-cells")

    def parts(key, table):
        """Each core point with the least core point of its part of the cell; each other point with one core point near it."""
        search, core = _search(table), table["core"].to_numpy() > 0
        pid, parent = search.pid, np.arange(len(core))

        def find(i):
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        loose, seen, label = [], 0, parent.copy()
        for j, at in search.within(search.x, pid, radius):
            at = at[core[at]]
            if core[j]:
                for i in np.unique(label[at]).tolist():  # labels lag behind parents, but never leave their part
                    a, b = find(i), find(j)
                    parent[max(a, b)] = min(a, b)
                seen += 1
                if seen % 256 == 0:
                    while (parent[label] != label).any():
                        label = parent[label]
            elif len(at):
                loose.append((j, at))
        root = np.array([find(i) for i in range(len(pid))], np.int64)
        pairs = [(int(pid[j]), int(pid[root[j]])) for j in np.flatnonzero(core)] + [(int(pid[j]), int(pid[r])) for j, at in loose for r in np.unique(root[at])]
        cols = [*zip(*pairs)] or [(), ()]
        kind = np.concatenate([np.ones(int(core.sum()), np.int64), np.zeros(len(pairs) - int(core.sum()), np.int64)])
        return pa.table({"pid": pa.array(cols[0], pa.int64()), "part": pa.array(cols[1], pa.int64()), "core": pa.array(kind)})

    own = written(cored.groupBy("cell").applyInArrow(parts, "pid long, part long, core long"), "parts")
    flagged = sent.drop("none", "n").join(cored.select("pid", "core"), "pid")

    def across(key, table):
        def run(search, own, x, pid):
            core = table["core"].to_numpy()
            mine, part = core[own] > 0, table["part"].to_numpy()[own]
            got = [(int(pid[~own][j]), int(p), int(core[~own][j])) for j, at in search.within(x[~own], pid[~own], radius) for p in np.unique(part[at[mine[at]]])]
            cols = [*zip(*got)] or [(), (), ()]
            return pa.table({"pid": pa.array(cols[0], pa.int64()), "part": pa.array(cols[1], pa.int64()), "core": pa.array(cols[2], pa.int64())})

        return both(key, table, run)

    named = cored.join(own.where("core = 1").select("pid", "part"), "pid", "left").withColumn("part", F.coalesce("part", F.lit(-1)))
    loads = flagged.groupBy("cell").agg(F.ceil(F.count("*") / UNIT).cast("int").alias("units"))
    cols = ["cell", "unit", "pid", "v", "n", "first", "core", "part"]
    asking = flagged.join(F.broadcast(loads), "cell").withColumn("unit", F.pmod(F.xxhash64("pid", F.lit(17)), F.col("units")).cast("int")).withColumn("n", F.lit(0).cast("long")).withColumn("first", F.lit(0).cast("long")).withColumn("part", F.lit(-1).cast("long"))
    asked = named.join(F.broadcast(loads), "cell").withColumn("unit", F.explode(F.sequence(F.lit(0), F.col("units") - 1)))
    units = asking.select(*cols, F.lit(False).alias("own")).unionByName(asked.select(*cols, F.lit(True).alias("own")))
    return written(own.unionByName(units.groupBy("cell", "unit").applyInArrow(across, "pid long, part long, core long")), "links")


def density_clusters(rows: DataFrame, key: str, vector: str, radius: float, least: int) -> DataFrame:
    """(id, cluster, core): DBSCAN over the whole table. cluster is the smallest id of the core rows of its cluster, null for noise.

    A row is core if ``least`` rows, itself among them, are within ``radius``. A row that isn't core belongs to the least of the clusters of core rows
    within the radius. Pairs aren't listed: a cell joins its own core points and names one point of each such part to those near it
    in other cells, and connected components join the parts.
    """
    points, members = points_of(rows, key, vector, 1)
    placed, cells, low, high = _celled(points)
    blocks = _blocks_for_all(placed, cells, low, high, F.lit(float(radius)))
    links = _links_in_blocks(placed, blocks, radius, least) if blocks else _links_in_cells(placed, cells, low, high, radius, least)
    found = components(links.where("core = 1 AND pid <> part").select(F.col("pid").alias("a"), F.col("part").alias("b")))
    # a component's name is the smallest row id of its core points
    of = links.where("core = 1").select("pid").distinct().join(found.withColumnRenamed("node", "pid"), "pid", "left").withColumn("component", F.coalesce("component", "pid"))
    of = written(of, "core-components")
    first = of.join(points.select("pid", "first"), "pid").groupBy("component").agg(F.min("first").alias("cluster"))
    known = of.join(first, "component").select("pid", "cluster")
    edge = links.where("core = 0").join(known.withColumnRenamed("pid", "part"), "part").groupBy("pid").agg(F.min("cluster").alias("cluster"))
    clusters = known.withColumn("core", F.lit(True)).unionByName(edge.withColumn("core", F.lit(False)))
    clusters = points.select("pid", "n").join(clusters, "pid", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.when(F.col("n") > MANY, SALTS - 1).otherwise(0)))).drop("n")
    return members.join(clusters, ["pid", "salt"]).select("id", "cluster", F.coalesce("core", F.lit(False)).alias("core"))


#: Groups lie so far apart, in an axis of their own, that none meets another.
APART = 1e4


def in_group(group: str, vector: str) -> F.Column:
    """A vector with its group's number as an axis: the joins of this module then stay within groups whose vectors are shorter than half of ``APART``."""
    return F.concat(F.array(F.col(group).cast("double") * APART), F.col(vector).cast("array<double>"))


def radius_pairs(rows: DataFrame, key: str, vector: str, radius: float) -> DataFrame:
    """(a, b, d): all pairs of rows within ``radius``, a < b; rows that repeat an id are no pair."""
    points, members = points_of(rows, key, vector, 1)
    placed, cells, low, high = _celled(points)
    sent = written(_sent(placed.withColumn("reach", F.lit(float(radius))), cells, low, high, "n"), "sent").withColumn("none", F.lit(0)).drop("n")

    def _pairs(search, x, pid):
        out = [(pid[j], search.pid[at], np.sqrt(((search.x[at] - x[j]) ** 2).sum(1))) for j, at in search.within(x, pid, radius)]
        size = [len(p) for _, p, _ in out]
        cat = lambda i, kind: np.concatenate([o[i] for o in out]).astype(kind) if out else np.zeros(0, kind)
        p, q, d = np.repeat(np.array([o[0] for o in out], np.int64), size), cat(1, np.int64), cat(2, float)
        keep = p <= q  # each pair of points comes from both sides
        return pa.table({"p": pa.array(p[keep]), "q": pa.array(q[keep]), "d": pa.array(d[keep])})

    def own_cell(key, table):
        search = _search(table)
        return _pairs(search, search.x, search.pid)

    def other_cell(key, table):
        own = table["own"].to_numpy(zero_copy_only=False)
        return _pairs(_search(table, own), _matrix(table["v"])[~own], table["pid"].to_numpy()[~own])

    kind = "p long, q long, d double"
    pairs = placed.groupBy("cell").applyInArrow(own_cell, kind)
    pairs = pairs.unionByName(_units(sent, placed.withColumn("none", F.lit(0)), "none").groupBy("cell", "unit").applyInArrow(other_cell, kind))
    m = members.select("id", "pid").distinct()
    both = pairs.join(m.select(F.col("id").alias("x"), F.col("pid").alias("p")), "p").join(m.select(F.col("id").alias("y"), F.col("pid").alias("q")), "q")
    both = both.where("x <> y AND (p <> q OR x < y)")
    return both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "d")
