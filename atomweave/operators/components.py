"""Connected components by minimum labels: each round every node takes the least label around it, then follows labels to labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atomweave.operators.work import written

MAX_ROUNDS = 100


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of edges (a, b): the smallest node that is reachable.

    Following labels halves what is left of a path each round, so rounds grow with the logarithm of its length. Each round is a written table;
    minima are partial aggregates, and a label that many nodes share is joined, not collected.
    """
    both = edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct()
    both = written(both, "edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    for _ in range(MAX_ROUNDS):
        # the least label around a node, offered to the node and to the one its own label names
        around = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        met = labels.join(around, "node").select("node", "label", F.least("label", "near").alias("near"))
        offers = met.select("node", F.col("near").alias("label")).unionByName(met.where("near < label").select(F.col("label").alias("node"), F.col("near").alias("label")))
        least = written(offers.groupBy("node").agg(F.min("label").alias("label")), "labels")
        on = least.select(F.col("node").alias("label"), F.col("label").alias("further"))
        new = least.join(on, "label", "left").select("node", F.least("label", "further").alias("label"))
        new = written(new, "labels")
        changed = new.join(labels.withColumnRenamed("label", "old"), "node").where("label <> old")
        if changed.isEmpty():
            return new.select("node", F.col("label").alias("component"))
        labels = new
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
