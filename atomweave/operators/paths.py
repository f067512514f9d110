"""A* over spatial neighbours: from an atom to the first atom of a concept's region, over steps of at most a radius.

The bound is the distance to the region's centre, which never falls by more than a step costs; so atoms leave the open set by falling bound plus cost, and the goal is the atom in
the region for which cost plus bound is least, then bound. A round takes the open atoms that can still matter, those of the least bounds if they are more than about ``FRONT``
(twice as many in each further round), finds their neighbours through kd-cells, and keeps the cheapest way to each, with the atom it comes from; open and closed atoms are one written
table. It ends when no open atom is below the best goal, so which of them a round takes doesn't change the result. Equal vectors are one
atom, that of the smallest id. The search goes on until it has the goal or nothing is left, so no row means that there is no path. A caller may set ``max_steps``, how many
atoms may be taken from the open set one by one before the goal; where they don't do, a ``StepsUsedUp`` warning says that the empty result is a search given up.
"""

from __future__ import annotations

import warnings
from datetime import datetime, timedelta

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from atomweave.operators.kd_join import SLACK, Search, _blocks, _celled, _gap, _matrix, _sent, points_of
from atomweave.operators.work import written

#: Open atoms that the first round takes.
FRONT = 4096
PATH = "step long, atom_id long, cost double, to_centre double"


class StepsUsedUp(UserWarning):
    """There is a path, but finding it takes more steps than the caller allows."""


def _upto(f, most: float):
    return lambda key, table: f(most, table)


def find_path(rows: DataFrame, key: str, vector: str, start: int, centre: list[float], region: float, radius: float, max_steps: int | None = None) -> DataFrame:
    """(step, atom_id, cost, to_centre) from start to goal, steps from 0; no row without a path."""
    spark = rows.sparkSession
    points, _ = points_of(rows, key, vector, 1)
    placed, cells, low, high = _celled(points)
    far = F.sqrt(F.aggregate(F.zip_with("v", F.array(*map(F.lit, map(float, centre))), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x))
    nodes = written(placed.select("pid", "first", "v", "cell", far.alias("h")), "nodes")
    begin = rows.where(F.col(key) == start).select(F.col(vector).cast("array<double>").alias("v")).limit(1).collect()
    own = nodes.where(F.col("v") == F.array(*map(F.lit, begin[0]["v"]))) if begin and begin[0]["v"] else nodes.limit(0)
    kind = "pid long, v array<double>, cell int, h double, g double, parent long"
    state = written(own.select("pid", "v", "cell", "h", F.lit(0.0).alias("g"), F.lit(None).cast("long").alias("parent"), F.lit(True).alias("fresh")), "open")

    def near(most, table):
        """The cheapest way to each of the cell's points; equal ways are by the smallest parent."""
        own = table["own"].to_numpy(zero_copy_only=False)
        asked, points = table.filter(pa.array(~own)), table.filter(pa.array(own))
        pid, q, g0 = asked["pid"].to_numpy(), _matrix(asked["v"]), asked["g"].to_numpy()
        x, own_pid, h = _matrix(points["v"]), points["pid"].to_numpy(), points["h"].to_numpy()
        search = Search(x, own_pid, own_pid, own_pid)
        g, parent = np.full(len(x), np.inf), np.full(len(x), -1)
        for part in _blocks(q) if len(q) else []:
            part = part[np.argsort(pid[part])]
            gaps = _gap(q[part].min(0), q[part].max(0), search.low, search.high) if search.blocks else np.zeros(0)
            for b in np.flatnonzero(gaps <= radius):
                at = search.blocks[b]
                d = search._distances(q[part], at)
                way = np.where((d <= radius) & (pid[part][:, None] != own_pid[at][None]), g0[part][:, None] + d, np.inf)
                i = way.argmin(0)
                way = way[i, np.arange(len(at))]
                better = (way < g[at]) | ((way == g[at]) & (way < np.inf) & (pid[part][i] < parent[at]))
                g[at[better]], parent[at[better]] = way[better], pid[part][i][better]
        found = np.flatnonzero((g < np.inf) & (g + h <= most + SLACK))  # others can't be on the path
        return points.take(pa.array(found)).select(["pid", "v", "cell", "h"]).append_column("g", pa.array(g[found])).append_column("parent", pa.array(parent[found], pa.int64()))

    inside, bound, most = F.col("h") <= region, F.col("g") + F.col("h"), FRONT
    while True:
        best = state.where(inside).agg(F.min(bound)).first()[0]
        best = float("inf") if best is None else best
        waiting = state.where(F.col("fresh") & ~inside & (bound <= best))
        n = waiting.count()
        if not n:
            break
        cut = best if n <= most else waiting.select(bound.alias("f")).approxQuantile("f", [most / n], 0.001)[0]
        most *= 2
        front = written(waiting.where(bound <= cut).select("pid", "v", "cell", "g"), "front")
        asking = front.withColumn("reach", F.lit(float(radius)))
        sent = front.select("pid", "v", "cell", "g").unionByName(_sent(asking, cells, low, high, "g").select("pid", "v", "cell", "g"))
        met = sent.select("cell").distinct()
        units = sent.withColumn("h", F.lit(0.0)).withColumn("own", F.lit(False))
        units = units.unionByName(nodes.join(F.broadcast(met), "cell", "left_semi").select("pid", "v", "cell", "h", F.lit(0.0).alias("g"), F.lit(True).alias("own")))  # cells are few
        # a point lies in one cell, which all that reach it are sent to: its cheapest way is known there, and pairs never travel
        ways = units.groupBy("cell").applyInArrow(_upto(near, best), kind)
        merged = state.select("pid", F.struct("v", "cell", "h", "g", "parent").alias("old"), "fresh").join(ways.select("pid", F.struct("v", "cell", "h", "g", "parent").alias("way")), "pid", "full")
        better = F.col("way").isNotNull() & (F.col("old").isNull() | (F.col("way.g") < F.col("old.g")))
        left = F.coalesce(F.col("fresh") & (F.col("old.g") + F.col("old.h") > cut), F.lit(False))
        state = written(merged.select("pid", F.when(better, F.col("way")).otherwise(F.col("old")).alias("x"), (better | left).alias("fresh")).select("pid", "x.*", "fresh"), "open")
    goal = state.where(inside).orderBy(bound, "h", "pid").limit(1).collect()
    if not goal:
        return spark.createDataFrame([], PATH)
    at = goal[0]
    if max_steps is not None:
        top = at["g"] + at["h"]
        steps = state.where((bound < top) | ((bound == top) & (F.col("h") < at["h"]))).count()
        if steps > max_steps:
            warnings.warn(f"the path takes {steps} steps, {max_steps} are allowed; the result is empty", StepsUsedUp, stacklevel=2)
            return spark.createDataFrame([], PATH)
    # a path is short (no two steps in a row are within the radius together), what was searched isn't: it is followed back atom by atom
    path, pid = [], at["pid"]
    while pid is not None:
        (r,) = state.where(F.col("pid") == pid).select("g", "h", "parent").collect()
        path.append((pid, r["g"], r["h"]))
        pid = r["parent"]
    path = [(i, *x) for i, x in enumerate(path[::-1])]
    out = spark.createDataFrame(path, "step long, pid long, cost double, to_centre double").join(nodes.select("pid", "first"), "pid")
    return out.select("step", F.col("first").alias("atom_id"), "cost", "to_centre")


class PathCache:
    """Paths found before, by start and target, each with an expiry; entries are appended as Parquet and the newest that is valid counts."""

    SCHEMA = f"start long, target string, path array<struct<{PATH.replace(' ', ': ').replace(',:', ',')}>>, created timestamp, expires timestamp"

    def __init__(self, spark: SparkSession, path: str, minutes: float = 60):
        self.spark, self.path, self.minutes = spark, path, minutes

    def get(self, start: int, target: str, now: datetime) -> DataFrame | None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p):
            return None
        rows = self.spark.read.schema(self.SCHEMA).parquet(self.path).where((F.col("start") == start) & (F.col("target") == target) & (F.col("expires") > F.lit(now)) & (F.col("created") <= F.lit(now)))
        last = rows.orderBy(F.desc("created")).limit(1)
        return None if last.isEmpty() else last.select(F.inline("path"))

    def put(self, start: int, target: str, path: DataFrame, now: datetime) -> None:
        entry = path.agg(F.array_sort(F.collect_list(F.struct("step", "atom_id", "cost", "to_centre"))).alias("path"))  # as long as the path
        entry = entry.select(F.lit(start).cast("long").alias("start"), F.lit(target).alias("target"), "path", F.lit(now).cast("timestamp").alias("created"), F.lit(now + timedelta(minutes=self.minutes)).cast("timestamp").alias("expires"))
        entry.write.mode("append").parquet(self.path)
