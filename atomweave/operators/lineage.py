"""Lineage by frontier joins: a level a round, each a written table, to any depth and size.

A node comes out once for each path to it; a path doesn't enter a node that it has been to, so cycles end. The last level is the one that finds nothing further.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atomweave.operators.work import written


def walk(edges: DataFrame, start: str, depth: int = 1000, upstream: bool = False) -> DataFrame:
    """(node, depth, path: array) of what is reached from ``start`` along edges (src, dst), itself at depth 0."""
    frm, to = ("dst", "src") if upstream else ("src", "dst")
    step = edges.select(F.col(frm).alias("node"), F.col(to).alias("next")).where("node IS NOT NULL AND next IS NOT NULL")
    front = edges.sparkSession.range(1).select(F.lit(start).alias("node"), F.lit(0).alias("depth"), F.array(F.lit(start)).alias("path"))
    out = front
    for level in range(1, depth + 1):
        grown = front.join(step, "node").where(~F.array_contains("path", F.col("next")))
        front = written(grown.select(F.col("next").alias("node"), F.lit(level).alias("depth"), F.concat("path", F.array("next")).alias("path")), "level")
        if front.isEmpty():
            break
        out = out.unionByName(front)
    return out
