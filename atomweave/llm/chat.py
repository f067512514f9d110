"""Multi-party perspective rotation: one rendering of a dialogue for every participant.

In the rendering for a participant, that speaker is the assistant, everyone else is a user with a name, and the
loss mask covers exactly the assistant's texts with their end marks. The system's turns open or interrupt the
dialogue as they stand; the system is no participant.

Turns are ordered by (turn, role, text). A dialogue is rendered in parts of ``part_turns`` turn numbers, so one
of any length is spread over many tasks; concatenating the parts gives the whole, and a mask's offsets count
code points from its part's start. All of it is built-in DataFrame functions: a window sums the lengths and
the same partitioning serves the aggregation.

Null text counts as empty, a null role is a participant named ``unknown``; null conv_id is a conversation of
its own, and null turns are a part of their own. ``<|`` in texts and names is written ``< |``, so no text can
forge a mark. A conversation of the system alone has no participant and no rendering. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PART_TURNS = 512
END = "<|end|>\n"


def _clean(c: Column) -> Column:
    return F.replace(c, F.lit("<|"), F.lit("< |"))


def rotate(turns: DataFrame, part_turns: int = PART_TURNS) -> DataFrame:
    """(conv_id, perspective, part, n_turns, rendered, loss_spans: array<struct<begin, end>>, loss_chars)."""
    t = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        _clean(F.coalesce(F.col("role").cast("string"), F.lit("unknown"))).alias("role"),
        _clean(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text"),
    ).withColumn("part", F.floor(F.col("turn") / part_turns))
    who = t.where("role <> 'system'").select("conv_id", F.col("role").alias("perspective")).distinct()
    parts = t.select("conv_id", "part").distinct()
    views = parts.alias("p").join(who.alias("w"), F.expr("p.conv_id <=> w.conv_id")).select("p.conv_id", "p.part", "perspective")
    own = F.col("role") == F.col("perspective")
    rows = (
        t.alias("t")
        .join(views.alias("v"), F.expr("t.conv_id <=> v.conv_id AND t.part <=> v.part"))
        .select("t.conv_id", "t.part", "v.perspective", "t.turn", "t.role", "t.text")
        .withColumn("own", own)
        .withColumn(
            "head",
            F.when(F.col("own"), F.lit("<|assistant|>\n"))
            .when(F.col("role") == "system", F.lit("<|system|>\n"))
            .otherwise(F.concat(F.lit("<|user name="), F.col("role"), F.lit("|>\n"))),
        )
        .withColumn("body", F.concat("text", F.lit(END)))
    )
    key = ["conv_id", "part", "perspective"]
    order = Window.partitionBy(*key).orderBy(F.asc_nulls_first("turn"), "role", "text")
    end = F.sum(F.length("head") + F.length("body")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("n", F.row_number().over(order)).withColumn("end", end).withColumn("begin", F.col("end") - F.length("body"))
    segment = F.struct("n", F.concat("head", "body").alias("text"), "own", "begin", "end")
    return (
        rows.groupBy(*key)
        .agg(F.array_sort(F.collect_list(segment)).alias("s"))
        .select(
            "conv_id",
            "perspective",
            "part",
            F.size("s").cast("long").alias("n_turns"),
            F.array_join(F.col("s.text"), "").alias("rendered"),
            F.transform(F.filter("s", lambda x: x["own"]), lambda x: F.struct(x["begin"].alias("begin"), x["end"].alias("end"))).alias("loss_spans"),
        )
        .withColumn("loss_chars", F.aggregate("loss_spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["begin"]))
    )
