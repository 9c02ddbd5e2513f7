"""Count-based next-token models on the packed stream.

The training step minimises the NLL of token ``p+1`` given what precedes it. Its
Spark-scale counterpart here: counts of (context, next) pairs over the stream, order 1
(no context) or 2 (one token of context), add-alpha smoothing over ``V + 1`` outcomes
(the extra one is ``<unk>``). Unseen context -> uniform ``1 / (V + 1)``.

Pairs come from the document form of the stream: pairs inside a document are an
``arrays_zip`` of two slices (narrow), the pair across each document border joins the
slim (last id, end position) of one document to the (first id, start) of the next on
position equality.

A model is counted in tasks of bounded size, however long the stream is: documents are counted where they lie in lots of about
``LOT`` positions, in Arrow, and the lots' counts meet in tasks of about ``TASK_PAIRS`` pairs, dealt by context. A context with
many pairs is dealt over several tasks by its next tokens; the total of any other lies in its task, so no join by context follows.
"""

from __future__ import annotations

import math
import sys
from dataclasses import dataclass
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.plans.joins import restrict_to, spread_join

NO_CTX = -1
#: Pairs of a task that counts them, and positions that are counted at once where they lie.
TASK_PAIRS, LOT = 1_000_000, 2_000_000
#: A context with more than this part of a task's pairs is dealt over several tasks.
LARGE = 1 / 16


def stream_pairs(stream_docs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``(*by, ctx, next)`` for every stream position ``p >= 1``: ``(id[p-1], id[p])``.

    ``by`` columns are taken from the document that holds the *target* token.
    """
    by = by or []
    d = stream_docs.where(F.col("n") > 0)
    inner = d.where(F.col("n") > 1).select(
        *by, F.explode(F.arrays_zip(F.slice("ids", 1, F.col("n").cast("int") - 1).alias("ctx"),
                                    F.slice("ids", 2, F.col("n").cast("int") - 1).alias("next"))).alias("z"))
    inner = inner.select(*by, F.col("z.ctx").alias("ctx"), F.col("z.next").alias("next"))
    return inner.unionByName(border_pairs(d, by))


def border_pairs(stream_docs: DataFrame, by: list[str]) -> DataFrame:
    """``(*by, ctx, next)`` across the borders of documents, one row a border."""
    d = stream_docs.where(F.col("n") > 0)
    ends = d.select((F.col("off") + F.col("n")).alias("pos"), F.get(F.col("ids"), F.col("n").cast("int") - 1).alias("ctx"))
    starts = d.select(F.col("off").alias("pos"), *by, F.get(F.col("ids"), 0).alias("next"))
    return ends.join(starts, "pos").select(*by, "ctx", "next")


def _lot_counts(by: list[str], keys: list[str], order: int, lot: int):
    def counted(rows: pa.Table) -> pa.Table:
        lists = rows["ids"].combine_chunks()
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat, ends = lists.flatten(), np.cumsum(sizes)
        inner = np.ones(len(flat), bool)  # all but the last position of a document
        inner[ends[sizes > 0] - 1] = False
        at = np.flatnonzero(inner)
        groups = {c: rows[c].combine_chunks().dictionary_encode() for c in by}
        owner = np.repeat(np.arange(len(sizes)), sizes)[at] if by else None
        found = {c: g.indices.take(pa.array(owner)) for c, g in groups.items()}
        found["ctx"] = flat.take(pa.array(at)) if order > 1 else pa.array(np.full(len(at), NO_CTX))
        if "next" in keys:
            found["next"] = flat.take(pa.array(at + 1))
        names = [*by, *keys]
        t = pa.table({c: found[c] for c in names}).group_by(names, use_threads=False).aggregate([([], "count_all")])
        return pa.table([groups[c].dictionary.take(t[c].combine_chunks()) if c in groups else t[c] for c in names] + [t["count_all"]], names=[*names, "n"])

    def run(batches):
        kept, size = [], 0
        for b in batches:
            kept.append(b)
            size += len(b.column("ids").flatten())
            if size >= lot:
                yield from counted(pa.Table.from_batches(kept)).to_batches(max_chunksize=100_000)
                kept, size = [], 0
        if size:
            yield from counted(pa.Table.from_batches(kept)).to_batches(max_chunksize=100_000)

    return run


def lot_counts(stream_docs: DataFrame, border: DataFrame, by: list[str], keys: list[str], order: int = 2, lot: int = LOT) -> DataFrame:
    """``(*by, *keys, n)``: the pairs of the stream (``keys`` ctx, next) or their contexts (ctx), counted in lots; ``border`` has the pairs
    across documents. Rows of one key in several lots are to be summed."""
    kinds = {f.name: f.dataType.simpleString() for f in stream_docs.schema.fields}
    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in by], *[f"`{c}` bigint" for c in keys], "n bigint"])
    ids = stream_docs.where(F.col("n") > 1).select(*by, F.col("ids").cast("array<bigint>").alias("ids"))
    inner = ids.mapInArrow(_lot_counts(by, keys, order, lot), schema)
    if order == 1:
        border = border.withColumn("ctx", F.lit(NO_CTX).cast("bigint"))
    return inner.unionByName(border.select(*by, *keys, F.lit(1).cast("bigint").alias("n")))


@dataclass
class NgramModel:
    pairs: DataFrame      # (*by, ctx, next, n, lp)
    contexts: DataFrame   # (*by, ctx, tot)
    vocab_size: int
    alpha: float
    order: int
    by: list[str]
    counts: DataFrame | None = None   # (*by, ctx, next, n): pairs without lp
    written: bool = False             # pairs are a scan of a written table

    @property
    def outcomes(self) -> int:
        return self.vocab_size + 1


def fit_ngram(stream_docs: DataFrame, vocab_size: int, order: int = 2, alpha: float = 0.1, by: list[str] | None = None,
              persist: bool = False, task_pairs: int = TASK_PAIRS, lot: int = LOT, **limits) -> NgramModel:
    """``lp = ln((n + alpha) / (tot + alpha * (V + 1)))`` per (context, next).

    With ``persist`` context totals and pairs (by group: the pairs' counts) are written once to the checkpoint folder. ``limits`` of broadcasts change nothing
    here: only the large contexts are broadcast, fewer than ``1 / LARGE`` a task."""
    if order not in (1, 2):
        raise ValueError("order must be 1 or 2")
    from corpusmill.plans.lineage import PACKED, materialize
    by = by or []
    keys = [*by, "ctx"]
    total = stream_docs.agg(F.sum("n")).first()[0] or 0
    parts = max(stream_docs.sparkSession.sparkContext.defaultParallelism, -(-total // task_pairs))
    border = border_pairs(stream_docs, by)
    if persist:
        border = materialize(border, "border-pairs")
    contexts = lot_counts(stream_docs, border, by, ["ctx"], order, lot).repartition(parts, *keys) \
        .groupBy(*keys).agg(F.sum("n").cast("bigint").alias("tot"))
    if persist:
        contexts = materialize(contexts, "ngram-contexts", codec=PACKED)
    most = max(1, int(total / parts * LARGE))
    large = contexts.where(F.col("tot") > most).select(*[F.col(c).alias(f"_{c}") for c in keys], F.col("tot").alias("_tot"))
    pairs = lot_counts(stream_docs, border, by, ["ctx", "next"], order, lot)
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in keys])
    salt = F.when(F.col("_tot").isNotNull(), F.pmod(F.xxhash64("next"), F.ceil(F.col("_tot") / F.lit(most)))).otherwise(F.lit(0).cast("bigint"))

    def dealt(rows: DataFrame) -> DataFrame:
        return rows.join(F.broadcast(large), same, "left").select(*keys, "next", "n", "_tot", salt.alias("_salt")).repartition(parts, *keys, "_salt")

    def scored(rows: DataFrame) -> DataFrame:
        tot = F.coalesce(F.col("_tot"), F.sum("n").over(Window.partitionBy(*keys, "_salt")))
        lp = F.log((F.col("n") + F.lit(float(alpha))) / (tot + F.lit(float(alpha) * float(vocab_size + 1))))
        return rows.select(*keys, "next", "n", lp.alias("lp"))

    summed = dealt(pairs).groupBy(*keys, "_salt", "next").agg(F.sum("n").cast("bigint").alias("n"), F.max("_tot").alias("_tot"))
    if persist and by:  # models by group are scored by their counts: lp is there for who asks for it
        counts = materialize(summed.select(*keys, "next", "n"), "ngram-counts", codec=PACKED)
        model = scored(dealt(counts))
    else:
        model = materialize(scored(summed), "ngram-pairs", codec=PACKED) if persist else scored(summed)
        counts = model.select(*keys, "next", "n")
    for c in by:  # a row without a group is of no group's model
        model = model.where(F.col(c).isNotNull())
    return NgramModel(model, contexts, vocab_size, alpha, order, by, counts, persist and not by)


def persist_model(model: NgramModel) -> NgramModel:
    """Write the scored pair table once, unless ``fit_ngram`` did (contexts and counts are expected written already)."""
    if model.written:
        return model
    from corpusmill.plans.lineage import materialize
    pairs = materialize(model.pairs, "ngram-pairs")
    return NgramModel(pairs, model.contexts, model.vocab_size, model.alpha, model.order, model.by, model.counts, True)


def _fallback_lp(model: NgramModel, tot) -> F.Column:
    a, V1 = float(model.alpha), float(model.outcomes)
    unseen_pair = F.log(F.lit(a) / (tot + F.lit(a * V1))) if a > 0 else F.lit(float("-inf"))
    return F.when(tot.isNull(), F.lit(math.log(1.0 / V1))).otherwise(unseen_pair)


def score_pairs(model: NgramModel, pairs: DataFrame, **limits) -> DataFrame:
    """Adds ``lp`` to rows carrying ``ctx`` and ``id`` (the target): the model's
    value when the pair was seen, else the smoothing rule. Distinct pairs are scored first, so a context or pair that
    half of the rows have meets the model once; where tables are too large to broadcast, heavy keys are salted."""
    from corpusmill.plans.lineage import materialize
    if model.by:
        raise ValueError("grouped models are scored with perplexity_by_group")
    p = pairs
    if model.order == 1:
        p = p.withColumn("_ctx", F.lit(NO_CTX).cast("bigint"))
    else:
        p = p.withColumn("_ctx", F.col("ctx"))
    m = model.pairs.select(F.col("ctx").alias("_ctx"), F.col("next").alias("id"), F.col("lp").alias("_lp"), "n")
    c = model.contexts.select(F.col("ctx").alias("_ctx"), F.col("tot").alias("_tot"))
    # a small scored set never shuffles the model: the model is filtered to its keys first
    keys = materialize(p.select("_ctx", "id").distinct(), "scored-keys")
    m = restrict_to(m, keys, ["_ctx", "id"])
    c = restrict_to(c, keys, ["_ctx"])
    j = keys.join(m, ["_ctx", "id"], "left")  # distinct on both sides
    j = spread_join(j, c, ["_ctx"], "left", measured=keys, **limits)
    scored = materialize(j.select("_ctx", "id", F.coalesce(F.col("_lp"), _fallback_lp(model, F.col("_tot"))).alias("lp")), "scored-pairs")
    return spread_join(p, scored, ["_ctx", "id"], "left", **limits).drop("_ctx")


def score_ngram(model: NgramModel, seqs: DataFrame, key: str, **limits) -> DataFrame:
    """Per-token log-probabilities of encoded texts ``(key, ids)``: all positions but
    the first, ``(key, pos, ctx, id, lp, mask)`` with mask 1."""
    t = seqs.select(key, "ids", F.posexplode("ids").alias("pos", "id")).where(F.col("pos") >= 1)
    t = t.select(key, F.col("pos").cast("int").alias("pos"), F.get(F.col("ids"), F.col("pos") - 1).alias("ctx"), "id")
    return score_pairs(model, t, **limits).withColumn("mask", F.lit(1))


def perplexity_by_group(model: NgramModel, heldout_pairs: DataFrame, **limits) -> DataFrame:
    """Held-out perplexity under every group's model: ``(*by, n_scored, loss, perplexity)``.

    Held-out tokens are reduced to distinct pairs with their count first, so a common context
    meets each group once per distinct pair, not once per token. A group's contexts among them
    score by its counts; all other held-out tokens of the group (unseen context) score
    ``ln(1/(V+1))`` and are added in bulk from their count.
    """
    by = model.by
    a, V1 = float(model.alpha), float(model.outcomes)
    from corpusmill.plans.lineage import materialize
    h = heldout_pairs.select("ctx", F.col("id").alias("next"))
    if model.order == 1:
        h = h.withColumn("ctx", F.lit(NO_CTX).cast("bigint"))
    h = materialize(h.groupBy("ctx", "next").agg(F.count(F.lit(1)).alias("w")), "heldout-pairs")
    H = h.agg(F.coalesce(F.sum("w"), F.lit(0))).first()[0]
    # a context with many next tokens meets every group: its rows are dealt over salts
    seen_ctx = spread_join(h, restrict_to(model.contexts, h, ["ctx"]), ["ctx"], **limits)
    counts = model.counts if model.counts is not None else model.pairs.select(*by, "ctx", "next", "n")
    counts = restrict_to(counts, h, ["ctx", "next"])
    seen = seen_ctx.join(counts, [*by, "ctx", "next"], "left")
    lp = F.log((F.coalesce(F.col("n"), F.lit(0)) + F.lit(a)) / (F.col("tot") + F.lit(a * V1)))
    part = seen.groupBy(*by).agg(F.sum(F.col("w") * lp).alias("_s"), F.sum("w").alias("_k"))
    groups = model.contexts.select(*by).distinct()
    g = groups.join(part, by, "left")
    total_lp = F.coalesce(F.col("_s"), F.lit(0.0)) + (F.lit(H) - F.coalesce(F.col("_k"), F.lit(0))) * F.lit(math.log(1.0 / V1))
    loss = -total_lp / F.lit(float(H)) if H else F.lit(None).cast("double")
    return g.select(*by, F.lit(H).cast("bigint").alias("n_scored"), loss.alias("loss")) \
        .withColumn("perplexity", F.exp("loss"))


def overfit_check(samples: DataFrame) -> DataFrame:
    """G10 per batch: fit and score on the same batch, alpha = 0. ``bigram_nll`` is the
    in-batch conditional entropy, ``unigram_nll`` the entropy of the batch's targets; the
    first can never exceed the second. ``(batch_id, n_pairs, bigram_nll, unigram_nll)``.

    With ``H(X|C) * P = sum_c n_c ln n_c - sum_cx n_cx ln n_cx`` and
    ``H(X) * P = P ln P - sum_x n_x ln n_x`` every term is a sum of ``n ln n``. Samples are dealt by batch as arrays, the only
    shuffle; a batch's pairs, contexts and targets are counted where it lies, in tasks of about ``TASK_PAIRS`` pairs."""
    pairs = samples.agg(F.sum(F.size("inputs"))).first()[0] or 0
    parts = max(samples.sparkSession.sparkContext.defaultParallelism, -(-pairs // TASK_PAIRS))
    z = samples.select("batch_id", "inputs", "target").repartition(int(parts), "batch_id").select(
        "batch_id", F.explode(F.arrays_zip(F.col("inputs").alias("ctx"), F.col("target").alias("next"))).alias("z"))
    none = F.lit(None).cast("bigint")
    kinds = [F.struct(F.lit(k).alias("kind"), ctx.cast("bigint").alias("ctx"), nxt.cast("bigint").alias("next")) for k, ctx, nxt in (
        (0, F.col("z.ctx"), F.col("z.next")), (1, F.col("z.ctx"), none), (2, none, F.col("z.next")))]
    counts = z.select("batch_id", F.explode(F.array(*kinds)).alias("k")).groupBy(
        "batch_id", F.col("k.kind").alias("kind"), F.col("k.ctx").alias("ctx"), F.col("k.next").alias("next")).agg(F.count(F.lit(1)).alias("n"))
    of = lambda k, c: F.sum(F.when(F.col("kind") == k, c))
    nlogn = F.col("n") * F.log("n")
    j = counts.groupBy("batch_id").agg(of(0, F.col("n")).alias("P"), of(0, nlogn).alias("a"), of(1, nlogn).alias("c"), of(2, nlogn).alias("x")) \
        .where(F.col("batch_id").isNotNull())
    P = F.col("P").cast("double")
    return j.select("batch_id", F.col("P").cast("bigint").alias("n_pairs"),
                    ((F.col("c") - F.col("a")) / P).alias("bigram_nll"),
                    ((P * F.log(P) - F.col("x")) / P).alias("unigram_nll"))


def top_successors(model: NgramModel, k: int) -> DataFrame:
    """``(ctx, next, lp, r)``: the ``k`` most likely observed successors of every context
    (ties: smaller id). ``row_number() <= k`` lets Spark insert a partial group limit
    before the shuffle, so a hot context ships at most ``k`` rows per task."""
    w = Window.partitionBy("ctx").orderBy(F.col("n").desc(), F.col("next").asc())
    return model.pairs.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k) \
        .select("ctx", "next", "lp", "r")


# Python workers need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
