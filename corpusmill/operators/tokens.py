"""Tokens per document and corpus selection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.text import EOS, doc_mode_words, line_mode_words, line_words, split_lines, split_words
from corpusmill.plans.lineage import materialize
from corpusmill.plans.ordering import ROWS_PER_BUCKET, global_index, global_offsets

LINE_MODE = "line"
DOC_MODE = "doc"
TEXT_MODE = "text"
_WORDS = {LINE_MODE: line_mode_words, DOC_MODE: doc_mode_words, TEXT_MODE: split_words}


def line_tokens(docs: DataFrame) -> DataFrame:
    """P3 per line: ``(doc_id, line_no, words)`` with ``<eos>`` ending every line."""
    return docs.select("doc_id", F.posexplode(split_lines("text")).alias("line_no", "line")) \
        .select("doc_id", F.col("line_no").cast("int").alias("line_no"), line_words("line").alias("words"))


def doc_tokens(docs: DataFrame, mode: str = DOC_MODE, keep: tuple[str, ...] = ()) -> DataFrame:
    """``(doc_id, *keep, words)``: one token array per document.

    ``doc``: whitespace words of the whole text plus one end marker (P2);
    ``line``: every line's words followed by ``<eos>`` (P3), lines concatenated;
    ``text``: the words of the whole text alone (S2).
    """
    return docs.select("doc_id", *keep, _WORDS[mode]("text").alias("words"))


def doc_lengths(tokens: DataFrame) -> DataFrame:
    """``(doc_id, n)`` tokens per document."""
    return tokens.select("doc_id", F.size("words").cast("bigint").alias("n"))


def take_documents(docs: DataFrame, n: int, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """The first ``n`` documents in corpus order (``doc_id``, null first), not a sample.

    The ``n``-th id is found on the id column alone; the documents are then filtered where
    they are scanned, whatever ``n``. Of rows that share that id, as many as are missing."""
    if n <= 0:
        return docs.limit(0)
    ranked = global_index(docs.select("doc_id"), "doc_id", out="_rank", rows_per_bucket=rows_per_bucket)
    last = ranked.where(F.col("_rank") == n - 1).first()
    if last is None:
        return docs
    cut = F.lit(last["doc_id"])
    before = ranked.where(F.col("doc_id").eqNullSafe(cut)).agg(F.min("_rank")).first()[0]
    at = docs.where(F.col("doc_id").eqNullSafe(cut)).limit(n - before)
    return at if last["doc_id"] is None else docs.where(F.col("doc_id").isNull() | (F.col("doc_id") < cut)).unionByName(at)


def token_budget(tokens: DataFrame, budget: int) -> DataFrame:
    """The leading documents whose tokens fit in ``budget``: ``(doc_id, n, off)``."""
    offs = global_offsets(doc_lengths(tokens), "doc_id", "n")
    return offs.where(F.col("off") + F.col("n") <= budget)


def within_budget(docs: DataFrame, budget: int, mode: str = DOC_MODE) -> DataFrame:
    """The leading documents whose tokens fit in ``budget``, as documents: the corpus of a run. Their ids are a prefix of
    the order, so a filter on ``doc_id`` reaches the scan; ties at its end are settled by the join."""
    fits = materialize(token_budget(doc_tokens(docs, mode), budget).select("doc_id"), "within-budget")
    last = fits.agg(F.max("doc_id")).first()[0]
    lead = docs.where(F.col("doc_id").isNull()) if last is None else docs.where(F.col("doc_id").isNull() | (F.col("doc_id") <= last))
    own = fits.withColumnRenamed("doc_id", "_fits")
    return lead.join(own.hint("merge"), lead["doc_id"].eqNullSafe(own["_fits"]), "left_semi")


def corpus_report(tokens: DataFrame, seq_len: int, packing: str) -> DataFrame:
    """``(packing, seq_len, dataset_tokens, samples, learn_tokens)`` from one global aggregate."""
    total = F.coalesce(F.sum(F.size("words")), F.lit(0)).cast("bigint")
    n = F.col("dataset_tokens")
    if packing == "blocks":
        samples = F.greatest(F.lit(0).cast("bigint"), F.expr(f"dataset_tokens div {int(seq_len)}") - 1)
    else:
        samples = F.greatest(F.lit(0).cast("bigint"), n - seq_len)
    return tokens.agg(total.alias("dataset_tokens")).select(
        F.lit(packing).alias("packing"), F.lit(seq_len).cast("int").alias("seq_len"), "dataset_tokens",
        samples.alias("samples"), (samples * seq_len).alias("learn_tokens"))


__all__ = ["EOS", "LINE_MODE", "DOC_MODE", "line_tokens", "doc_tokens", "doc_lengths", "take_documents",
           "token_budget", "within_budget", "corpus_report"]
