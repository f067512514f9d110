"""Ensemble generation: many prompts advance together as rows, an atom a round.

In a round each model proposes for each prompt the 2k atoms of the largest weighted cosine (256 at most); proposals of an atom are added up over models, their distances
averaged. Atoms that a prompt has had are left out, the k best (score, then distance, then id) stay, and one is drawn with weight score * e^(-distance / temperature), by a
number that the seed, the prompt and the step decide. Its embedding is the next round's; a stop token, or nothing left to draw from, ends a prompt.

Proposals are a top-k join: prompts go out in blocks of bounded size, each task multiplies its atoms with a block and passes on the best of its own, and the
best of all are taken by key. Rounds are written tables, so a lost executor costs a round's work at most. Atoms without a token or vector aren't proposed; null prompts take no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from atomweave.operators.work import written

#: Prompts of a block.
BLOCK = 1024
LEAST_TEMPERATURE, LEAST_WEIGHT = 1e-3, 1e-9
# What ends a text.
STOP = ("[eos]", "</s>", "<|endoftext|>")


def _proposals(prompts: DataFrame, atoms: DataFrame, weights: dict[int, float], top: int) -> DataFrame:
    """(prompt_id, model_id, atom_id, score, distance): the ``top`` atoms of each prompt and model."""
    spark, out = prompts.sparkSession, None
    n = prompts.count()
    blocks = max(1, -(-n // BLOCK))
    part = F.pmod(F.xxhash64("prompt_id", F.lit(5)), F.lit(blocks))
    for b in range(blocks):
        held = prompts.where(part == b).select("prompt_id", "model_id", "v").toArrow()  # about BLOCK prompts
        asked: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        models = held["model_id"].to_numpy()
        for m in weights:
            at = np.flatnonzero(models == m)
            if len(at):
                x = np.array(held["v"].take(pa.array(at)).to_pylist(), float)
                asked[m] = held["prompt_id"].to_numpy()[at], x / np.maximum(np.linalg.norm(x, axis=1), 1e-300)[:, None]
        shared = spark.sparkContext.broadcast(asked)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                models, ids = batch.column(1).to_numpy(), batch.column(0).to_numpy()
                for m, (pid, q) in shared.value.items():
                    at = np.flatnonzero(models == m)
                    if not len(at):
                        continue
                    x = np.array(batch.column(2).take(pa.array(at)).to_pylist(), float)
                    cos = np.round(q @ (x / np.maximum(np.linalg.norm(x, axis=1), 1e-300)[:, None]).T, 9)
                    for i, p in enumerate(pid.tolist()):
                        best = np.lexsort([ids[at], -cos[i]])[:top]
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(best), p)), pa.array(np.full(len(best), m, np.int32)), pa.array(ids[at[best]]), pa.array(cos[i, best])], ["prompt_id", "model_id", "atom_id", "cos"])

        found = atoms.select("atom_id", "model_id", "v").mapInArrow(run, "prompt_id long, model_id int, atom_id long, cos double")
        out = found if out is None else out.unionByName(found)
    rank = F.row_number().over(Window.partitionBy("prompt_id", "model_id").orderBy(F.desc("cos"), "atom_id"))
    weight = F.create_map(*(F.lit(x) for m, w in weights.items() for x in (m, float(w))))
    best = out.withColumn("r", rank).where(F.col("r") <= top)
    return best.select("prompt_id", "model_id", "atom_id", (F.col("cos") * weight[F.col("model_id")]).alias("score"), (1 - F.col("cos")).alias("distance"))


def drawn(seed: int) -> F.Column:
    """A number from 0 to 1 for a prompt and step."""
    return F.crc32(F.concat_ws(":", F.lit(str(seed)), F.col("prompt_id").cast("string"), F.lit(""), F.col("step").cast("string")).cast("binary")) / float(1 << 32)


def generate(prompts: DataFrame, atoms: DataFrame, weights: dict[int, float], steps: int = 8, k: int = 5, temperature: float = 0.5, seed: int = 0) -> DataFrame:
    """(prompt_id, step, atom_id, token, score, distance, model_count). prompts: (prompt_id, model_id, v); atoms: (atom_id, model_id, token, v), a vector a model."""
    top, heat = max(1, min(256, 2 * k)), max(temperature, LEAST_TEMPERATURE)
    fine = F.col("v").isNotNull() & (F.size("v") > 0)
    atoms = atoms.select(F.col("atom_id").cast("long").alias("atom_id"), F.col("model_id").cast("int").alias("model_id"), F.trim("token").alias("token"), F.col("v").cast("array<double>").alias("v"))
    atoms = written(atoms.where(fine & F.col("token").isNotNull() & (F.col("token") != "") & F.col("atom_id").isNotNull() & F.col("model_id").isin([*weights])), "atoms")
    now = prompts.select(F.col("prompt_id").cast("long").alias("prompt_id"), F.col("model_id").cast("int").alias("model_id"), F.col("v").cast("array<double>").alias("v")).where(fine & F.col("prompt_id").isNotNull())
    now = written(now.where(F.col("model_id").isin([*weights])), "prompts")
    done = None
    for step in range(1, steps + 1):
        each = _proposals(now, atoms, weights, top).groupBy("prompt_id", "atom_id").agg(F.sum("score").alias("score"), F.avg("distance").alias("distance"), F.countDistinct("model_id").alias("model_count"))
        if done is not None:
            each = each.join(done.select("prompt_id", "atom_id"), ["prompt_id", "atom_id"], "left_anti")
        by = Window.partitionBy("prompt_id").orderBy(F.desc(F.round("score", 9)), F.round("distance", 9), "atom_id")
        each = each.withColumn("r", F.row_number().over(by)).where(F.col("r") <= k)
        w = F.exp(-F.col("distance") / heat) * F.when(F.col("score") <= 0, LEAST_WEIGHT).otherwise(F.col("score"))
        each = each.withColumn("w", F.when((w <= 0) | F.isnan(w) | (w == float("inf")), LEAST_WEIGHT).otherwise(w)).withColumn("step", F.lit(step).cast("long"))
        whole = Window.partitionBy("prompt_id")
        each = each.withColumn("upto", F.sum("w").over(whole.orderBy("r"))).withColumn("all", F.sum("w").over(whole)).withColumn("last", F.max("r").over(whole))
        hit = each.where((F.col("upto") >= drawn(seed) * F.col("all")) | (F.col("r") == F.col("last")))
        chosen = hit.groupBy("prompt_id", "step").agg(F.min_by(F.struct("atom_id", "score", "distance", "model_count"), "r").alias("x")).select("prompt_id", "step", "x.*")
        tokens = atoms.groupBy("atom_id").agg(F.min("token").alias("token"))
        chosen = written(chosen.join(tokens, "atom_id"), "generated")
        if chosen.isEmpty():
            break
        done = chosen if done is None else done.unionByName(chosen)
        going = chosen.where(~F.lower("token").isin(*STOP)).select("prompt_id", "atom_id")
        now = written(going.join(atoms.select("atom_id", "model_id", "v"), "atom_id").select("prompt_id", "model_id", "v"), "prompts")
    columns = ["prompt_id", "step", "atom_id", "token", "score", "distance", "model_count"]
    if done is None:
        return prompts.sparkSession.createDataFrame([], "prompt_id long, step long, atom_id long, token string, score double, distance double, model_count long")
    return done.select(*columns)
