"""Losses and perplexity.

Scored tokens are rows ``(..., lp, mask)``: ``lp`` the natural-log probability of the
target, ``mask`` 1 for a real position, 0 for padding. Everything is an aggregate
over rows; perplexity is token-weighted, never an average of per-text means.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.scores import length_mask, right_pad, target_logprob
from corpusmill.plans.ordering import global_index


def softmax_nll(df: DataFrame, scores: str, target: str) -> DataFrame:
    """adds ``nll = -log_softmax(scores)[target]`` (0-based target)."""
    return df.withColumn("nll", -target_logprob(scores, target))


def mean_nll(df: DataFrame, by: list[str] | None = None, nll: str = "nll") -> DataFrame:
    """Mean NLL over all target positions, optionally per group (e.g. ``batch_id``)."""
    agg = [F.count(F.lit(1)).alias("n"), F.avg(nll).alias("mean_nll")]
    return df.groupBy(*(by or [])).agg(*agg)


def masked_perplexity(scored: DataFrame, by: list[str] | None = None, lp: str = "lp",
                      mask: str = "mask") -> DataFrame:
    """``loss = sum(-lp * mask) / sum(mask)``, ``perplexity = exp(loss)``, per group."""
    m = F.col(mask).cast("double")
    g = scored.groupBy(*(by or [])).agg(
        F.sum(m).cast("bigint").alias("n_scored"),
        (F.sum(-F.col(lp) * m) / F.sum(m)).alias("loss"))
    return g.withColumn("perplexity", F.exp("loss"))


def batch_by_rank(df: DataFrame, key: str, batch_size: int) -> DataFrame:
    """Adds ``batch_id``: rows in ``key`` order, ``batch_size`` to a batch, gaps in the key or not."""
    return global_index(df, key, out="_rank").withColumn("batch_id", F.expr(f"_rank div {int(batch_size)}")).drop("_rank")


def pad_batch(seqs: DataFrame, key: str, batch_size: int, pad_id: int) -> DataFrame:
    """right-pad every sequence to the longest of its batch with ``pad_id`` (= EOS id),
    mask from lengths (a real EOS keeps mask 1). Batches are consecutive ``key`` ranks.

    The per-batch maximum comes from a groupBy on the batch (one row per batch) joined
    back, so no batch is ever gathered into one group.
    """
    ranked = batch_by_rank(seqs, key, batch_size)
    longest = ranked.groupBy("batch_id").agg(F.max(F.size("ids")).alias("_m"))
    j = ranked.join(longest, "batch_id")
    return j.select(key, "batch_id", right_pad("ids", F.col("_m"), pad_id).alias("input_ids"),
                    length_mask(F.size("ids"), F.col("_m")).alias("attention_mask"))


def padded_positions(padded: DataFrame, key: str) -> DataFrame:
    """Long form of a padded batch, shifted: ``(key, batch_id, pos, ctx, id, mask)`` for
    ``pos >= 1`` -- the label at ``pos`` predicted from ``pos - 1``, with the label's mask."""
    t = padded.select(key, "batch_id", "input_ids", "attention_mask",
                      F.posexplode("input_ids").alias("pos", "id"))
    t = t.where(F.col("pos") >= 1)
    return t.select(key, "batch_id", F.col("pos").cast("int").alias("pos"),
                    F.get(F.col("input_ids"), F.col("pos") - 1).alias("ctx"), "id",
                    F.get(F.col("attention_mask"), F.col("pos")).alias("mask"))


def unigram_entropy(counts: DataFrame, n: str = "n") -> DataFrame:
    """The input-independent baseline -- entropy ``-sum(p ln p)`` of a count table
    ``(..., n)``: ``(n_tokens, n_types, entropy)``. One aggregate: ``ln N - sum(n ln n) / N``."""
    c, total = F.col(n), F.sum(n)
    entropy = F.when(total > 0, F.log(total) - F.sum(F.when(c > 0, c * F.log(c)).otherwise(0.0)) / total)
    return counts.agg(F.coalesce(total, F.lit(0)).cast("bigint").alias("n_tokens"),
                      F.count(F.lit(1)).cast("bigint").alias("n_types"), entropy.alias("entropy"))


__all__ = ["softmax_nll", "mean_nll", "batch_by_rank", "masked_perplexity", "pad_batch", "padded_positions", "unigram_entropy"]
