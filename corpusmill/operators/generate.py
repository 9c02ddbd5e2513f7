"""Batch completion of many prompts with the count model.

Rules: a beam's score is the running sum of log-probabilities; candidates per prompt
are ranked by score (desc), ties by the token sequence (asc); a beam that produced
EOS is finished and carries over unchanged; a beam whose last token has no observed
successor is finished as it is. Only the top-``beams`` observed successors of a context
can enter the top ``beams`` of a step, so the successor table is cut to those first.

Each step is one join of the live beams with the successor table plus a per-prompt
``row_number() <= beams`` (groups of at most ``beams * (beams + 1)`` rows). Every few
steps the beam table is written to the shared checkpoint folder to cut the lineage.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.operators.ngram import NgramModel, top_successors
from corpusmill.plans.joins import fits_broadcast, spread_join
from corpusmill.plans.lineage import materialize


def generate(model: NgramModel, prompts: DataFrame, key: str, eos_id: int, beams: int = 2,
             max_new: int = 20, cut_every: int = 10, **limits) -> DataFrame:
    """I4: ``(key, rank, ids, new_ids, score)`` -- the final ``beams`` beams of every
    prompt ``(key, ids)``; ``rank`` 1 is the best. Prompts must be non-empty.

    The model looks at one token, so prompts with the same last token have the same completions: the beam table
    starts with the distinct last tokens, by which it is hash-partitioned, and its beams meet the prompts at the end
    (by a broadcast, or by a shuffle that deals common last tokens over salts). A step is one left join of
    every beam with the successor table (the join condition skips finished beams, which come back
    unchanged) and a ``row_number() <= beams`` per first token: with the successor table
    broadcast (size-checked) the join keeps the partitioning, so the step needs no
    shuffle. A larger table is dealt by context once, in order, and kept on the executors' disks; each step sends it the distinct last
    tokens of the open beams, so it is never shuffled or sorted again and a last token that many beams share is
    looked up once. Such a step reads the beams twice, so they are written after each; otherwise every ``cut_every`` steps.
    """
    # the successor table is bounded by (contexts x beams); written once, size-checked once
    succ = materialize(top_successors(model, beams).select("ctx", "next", "lp"), "successors")
    small = fits_broadcast(succ, "ctx", **limits)
    parts = prompts.sparkSession.sparkContext.defaultParallelism
    given = materialize(prompts.where(F.size("ids") > 0).select(key, F.col("ids").cast("array<bigint>").alias("ids"))
                        .withColumn("_p", F.element_at("ids", F.lit(-1))), "prompts")
    # dealt by context and kept so: a lost part is read from the written table again
    near = F.broadcast(succ) if small else dealt_by_context(succ).persist(StorageLevel.DISK_ONLY)
    state = given.select("_p").distinct().select("_p", F.array("_p").alias("ids"), F.lit(0.0).alias("score"), F.lit(False).alias("done")).repartition(parts, "_p")
    rank_w = Window.partitionBy("_p").orderBy(F.col("score").desc(), F.col("ids").asc())
    for step in range(int(max_new)):
        cur = state.withColumn("_last", F.when(~F.col("done"), F.try_element_at("ids", F.lit(-1))))
        side = near if small else next_of(cur, near)
        j = cur.join(side, cur["_last"] == side["ctx"], "left")
        stop = F.col("next").isNull()
        grown = j.select(
            "_p",
            F.when(stop, F.col("ids")).otherwise(F.concat("ids", F.array(F.col("next")))).alias("ids"),
            F.when(stop, F.col("score")).otherwise(F.col("score") + F.col("lp")).alias("score"),
            (stop | (F.col("next") == F.lit(eos_id))).alias("done"))
        state = grown.withColumn("_r", F.row_number().over(rank_w)).where(F.col("_r") <= beams).drop("_r")
        if not small or (cut_every and (step + 1) % cut_every == 0) or step + 1 == max_new:
            state = materialize(state, "beams")
            if step + 1 < max_new:
                state = state.repartition(parts, "_p")
    if not small:
        near.unpersist()
    done = state.withColumn("rank", F.row_number().over(rank_w).cast("int")).select(
        "_p", "rank", F.slice("ids", F.lit(2), F.lit(max_new + 1)).alias("new_ids"), "score")
    out = spread_join(given, done, ["_p"], measured=given, **limits)
    return out.select(key, "rank", F.concat("ids", "new_ids").alias("ids"), "new_ids", "score")


def dealt_by_context(successors: DataFrame) -> DataFrame:
    """In as many parts as a join's shuffle makes and in order, so that no join deals or sorts the table again."""
    return successors.repartition(int(successors.sparkSession.conf.get("spark.sql.shuffle.partitions")), "ctx").sortWithinPartitions("ctx")


def next_of(beams: DataFrame, successors: DataFrame) -> DataFrame:
    """The successors of the distinct last tokens: only those are sent to the table, which stays where it is."""
    lasts = beams.where(F.col("_last").isNotNull()).select(F.col("_last").alias("ctx")).distinct()
    return lasts.join(successors.hint("merge"), "ctx")


def greedy_from_eos(model: NgramModel, spark, eos_id: int, total_len: int = 20) -> DataFrame:
    """Open-ended sample -- greedy continuation of the single-token prompt ``[EOS]``
    to ``total_len`` tokens including the prompt."""
    prompt = spark.createDataFrame([(0, [int(eos_id)])], "prompt_id bigint, ids array<bigint>")
    return generate(model, prompt, "prompt_id", eos_id, beams=1, max_new=total_len - 1)
