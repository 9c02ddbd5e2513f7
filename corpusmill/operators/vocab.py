"""Vocabulary, encoding and decoding.

The vocabulary is a DataFrame ``(id, word, n)``, never a driver-side dict: ids are the
rank of each word's first occurrence in corpus order, from 0; ``<eos>`` gets the id of
its first position like any other word.
"""

from __future__ import annotations

import sys

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.text import EOS, UNK
from corpusmill.plans.dictionaries import block_of_place, coded_values, packed_rows, relabel_blocks, unpacked_rows
from corpusmill.plans.joins import HOT_ROWS, fits_broadcast, lookup_join, restrict_to, split_join
from corpusmill.plans.lineage import PACKED, materialize
from corpusmill.plans.ordering import ROWS_PER_BUCKET, global_index


#: 2^14 registers: a relative error of 0.8 % (one deviation) in 16 kB at most.
SKETCH_LG_K = 14
#: Values up to which they are relabelled one row each.
FEW_VALUES = 1_000_000


def _explode(tokens: DataFrame, key: str = "doc_id") -> DataFrame:
    return tokens.select(key, F.posexplode("words").alias("k", "word"))


def first_position_key(tokens: DataFrame, sizes: DataFrame | None = None) -> tuple[Column, Column] | None:
    """``(doc_id, k)`` packed into one long, ``doc_id * 2^b + k``, when it fits: ``b`` covers
    the longest document, ``doc_id`` is non-negative and below ``2^(62 - b)`` (checked on the
    slim ``(doc_id, n)`` columns). A one-long minimum aggregates in Spark's hash aggregate; a
    struct minimum would fall back to a sort-based aggregate."""
    src = sizes if sizes is not None else tokens
    length = F.col("n") if "n" in src.columns else F.size("words")
    r = src.agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.max(length).alias("m")).first()
    if r["lo"] is None:
        return None
    b = max(1, int(r["m"] or 0).bit_length())
    if r["lo"] < 0 or int(r["hi"]).bit_length() > 62 - b:
        return None
    return F.shiftleft(F.col("doc_id"), b) + F.col("k"), F.lit(b)


def build_vocab(tokens: DataFrame, rows_per_bucket: int = ROWS_PER_BUCKET, persist: bool = False,
                sizes: DataFrame | None = None, seen: DataFrame | None = None) -> DataFrame:
    """G1: ``(id, word, n)`` from ``(doc_id, words)``, or from ``seen``, the words' first places and counts by block
    (``dictionaries.first_places``), in place of a second pass over the tokens.

    One aggregation by word (partial aggregation map-side, so hot words cost one row per
    task) keeps the first ``(doc_id, k)`` and the count; ranking the distinct words by first
    position uses the bucketed global index, not a single-task window.
    """
    packed = first_position_key(tokens, sizes)
    t = _explode(tokens) if seen is None else seen
    count = F.count(F.lit(1)) if seen is None else F.sum("c")
    if packed is not None:
        first = t.groupBy("word").agg(F.min(packed[0]).alias("first"), count.alias("n"))
        order = ["first"]
    else:  # exact for any key range, via a struct minimum
        place = F.struct("doc_id", "k")
        if seen is not None:  # a row without an id comes before all others
            none = F.lit(None).cast(seen.schema["doc_id"].dataType)
            place = F.when(F.col("lost").isNull(), place).otherwise(F.struct(none.alias("doc_id"), F.col("lost").alias("k")))
        first = t.groupBy("word").agg(F.min(place).alias("_f"), count.alias("n"))
        first = first.select("word", "n", F.col("_f.doc_id").alias("first"), F.col("_f.k").alias("first_k"))
        order = ["first", "first_k"]
    if persist:  # one pass over the tokens, then bounds and ranks read the distinct words
        first = materialize(first, "first-occurrence", codec=PACKED)
    ranked = global_index(first, "first", order=order, out="id", rows_per_bucket=rows_per_bucket)
    return ranked.select("id", "word", F.col("n").cast("bigint").alias("n"))


def vocab_size(vocab: DataFrame) -> int:
    """G2 (scalar)."""
    return vocab.count()


def vocab_sketches(tokens: DataFrame, by: str, lg_k: int = SKETCH_LG_K) -> DataFrame:
    """G2 for large corpora: ``(by, sketch)``, an HLL sketch of the distinct words of every group. Sketches of
    parts merge by union, so groups, days or stream batches need no second look at their tokens."""
    return tokens.select(by, F.explode("words").alias("word")).groupBy(by).agg(F.hll_sketch_agg("word", F.lit(lg_k)).alias("sketch"))


def sketched_size(sketches: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``(*by, approx_size)``: the distinct words of the union of sketches."""
    return sketches.groupBy(*(by or [])).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("approx_size"))


def word_id(vocab: DataFrame, word: str) -> int | None:
    r = vocab.where(F.col("word") == word).select("id").first()
    return None if r is None else int(r["id"])


def relabel(rows: DataFrame, key: str, values: str, dim: DataFrame, by: str, out: str, missing: Column | None = None,
            skip: list | None = None, weight: str = "n", hot_rows: int = HOT_ROWS, few: int = FEW_VALUES,
            block: Column | None = None, flat: bool = False, **limits) -> DataFrame:
    """``(key, out)``: the array ``values`` of every row with each value replaced by the ``out``
    that ``dim (by, out, weight)`` gives it, in the same order. Values in ``skip`` go, and so do
    unknown ones unless ``missing`` stands for them. With ``flat`` the arrays that ``out`` gives the values are one array.

    Above ``few`` values the rows are relabelled in blocks (``plans.dictionaries``), where no row per value is shuffled or
    sorted; ``block`` is the number of a row's block if ``rows`` is a written table. Of rows that share a key, and of few
    values, each value is a row.
    """
    rows = rows.select(key, values, *([] if block is None else [block.alias("_block")]))
    total = rows.agg(F.sum(F.greatest(F.size(values), F.lit(0)))).first()[0] or 0
    whole = lambda df: df.withColumn(out, F.flatten(out)) if flat else df
    if total <= few:
        return whole(_relabel_rows(rows, key, values, dim, by, out, missing, skip, weight, hot_rows, **limits))
    if block is None:
        rows = materialize(rows.withColumn("_block", block_of_place()), "values")
    shared, one = shared_keys(rows, key), rows
    if shared is not None:
        own = F.struct(key).eqNullSafe(F.col("_key"))
        one = rows.join(shared, own, "left_anti")
        many = whole(_relabel_rows(rows.join(shared, own, "left_semi"), key, values, dim, by, out, missing, skip, weight, hot_rows, **limits))
    done = relabel_blocks(one, key, values, dim, by, out, total, missing, skip, broadcast=fits_broadcast(dim, by, **limits), flat=flat)
    return done if one is rows else done.unionByName(many)


def shared_keys(rows: DataFrame, key: str) -> DataFrame | None:
    """``(_key)``, a struct of every key that more than one row has, written; None if there is none."""
    shared = materialize(rows.groupBy(key).agg(F.count(F.lit(1)).alias("_c")).where("_c > 1").select(F.struct(key).alias("_key")), "shared-keys")
    return None if shared.first() is None else shared


def _relabel_rows(rows: DataFrame, key: str, values: str, dim: DataFrame, by: str, out: str, missing: Column | None,
                  skip: list | None, weight: str, hot_rows: int, **limits) -> DataFrame:
    """Rows are partitioned by ``key`` before the explode, so a broadcast lookup and the regroup
    behind it move no token. A table above the broadcast limits is cut to the rows' own values; if these are too many too, each
    row's distinct values are looked up with the list of their places, hot values apart from the others."""
    t = rows.select(key, values).repartition(F.col(key)).select(key, F.posexplode_outer(values).alias("k", by))
    value = F.col(out) if missing is None else F.coalesce(F.col(out), missing)
    keep = value.isNotNull() if not skip else value.isNotNull() & ~F.coalesce(F.col(by).isin(skip), F.lit(False))
    small = fits_broadcast(dim, by, **limits)
    if not small:
        needed = restrict_to(dim, rows.select(F.explode(values).alias(by)), [by], **limits)
        if needed is not dim:
            dim = materialize(needed.select(by, out, weight), "needed-values")
            small = fits_broadcast(dim, by, **limits)
    if small:
        j = t.join(F.broadcast(dim.select(by, out)), by, "left")
        pair = F.when(keep & F.col("k").isNotNull(), F.struct("k", value.alias("v")))
        places = F.collect_list(pair)
    else:
        own = materialize(t.groupBy(key, by).agg(F.collect_list("k").alias("ks")), "value-places")
        j = split_join(own, dim.select(by, out, weight), by, "left", weight, hot_rows)
        places = F.flatten(F.collect_list(F.when(keep, F.transform("ks", lambda k: F.struct(k.alias("k"), value.alias("v"))))))
    g = j.groupBy(key).agg(F.array_sort(places).alias("_p"))
    return g.select(key, F.col("_p.v").alias(out))


def encode(tokens: DataFrame, vocab: DataFrame, key: str = "doc_id", **limits) -> DataFrame:
    """``(key, n, ids)``; every word is known (the vocabulary came from these tokens). Keys
    without a token have no row."""
    block = F.col("_block") if "_block" in tokens.columns else None
    enc = relabel(tokens, key, "words", vocab, "word", "id", block=block, **limits)
    return enc.select(key, F.size("id").cast("bigint").alias("n"), F.col("id").alias("ids")).where("n > 0")


def encode_blocks(coded: DataFrame, tokens: DataFrame, vocab: DataFrame, offs: DataFrame, pack: bool = False, **limits) -> DataFrame:
    """J1 for a corpus written by ``dictionaries.code_blocks``: ``(n, ids)`` and the columns of ``offs``, joined by ``doc_id``. The same rows as
    of ``encode``: the words of rows that share an id are merged, from their ``tokens``. With ``pack`` the ids are packed for the next shuffle."""
    texts, shared = coded.where("_text").select("doc_id", "n", "_block", "codes"), shared_keys(coded.where("_text").select("doc_id"), "doc_id")
    one = texts
    if shared is not None:
        own = F.struct("doc_id").eqNullSafe(F.col("_key"))
        one = texts.join(shared, own, "left_anti")
    small = fits_broadcast(vocab, "word", **limits)
    out = coded_values(coded, one.where("n > 0"), vocab, "word", "id", "ids", broadcast=small, own=offs)
    if shared is None:
        return out if pack else unpacked_rows(out, "ids")
    many = encode(tokens.join(shared, F.struct("doc_id").eqNullSafe(F.col("_key")), "left_semi"), vocab, few=sys.maxsize, **limits).join(offs, "doc_id")
    out = out.unionByName(packed_rows(many, "ids"))
    return out if pack else unpacked_rows(out, "ids")


def encode_heldout(tokens: DataFrame, vocab: DataFrame, unk_id: int, key: str = "doc_id", **limits) -> DataFrame:
    """Encode against a fixed vocabulary; unknown words get ``unk_id``. Keys with no
    token keep a row with an empty array."""
    enc = relabel(tokens, key, "words", vocab, "word", "id", missing=F.lit(unk_id).cast("bigint"), **limits)
    return enc.select(key, F.size("id").cast("bigint").alias("n"), F.col("id").alias("ids"))


def oov_rate(tokens: DataFrame, vocab: DataFrame) -> DataFrame:
    """``(n_tokens, n_oov, oov_rate)``: distinct held-out words (partial counts) looked
    up in the vocabulary with a left join, then one global aggregate."""
    counts = _explode(tokens).groupBy("word").agg(F.count(F.lit(1)).alias("c"))
    known = vocab.select("word", F.lit(True).alias("known"), "n")
    j = lookup_join(counts, known, "word", how="left", weight="n")
    agg = j.agg(F.coalesce(F.sum("c"), F.lit(0)).cast("bigint").alias("n_tokens"),
                F.coalesce(F.sum(F.when(F.col("known").isNull(), F.col("c"))), F.lit(0)).cast("bigint")
                .alias("n_oov"))
    return agg.select("n_tokens", "n_oov",
                      F.when(F.col("n_tokens") > 0, F.round(F.col("n_oov") / F.col("n_tokens"), 6))
                      .alias("oov_rate"))


def decode(seqs: DataFrame, vocab: DataFrame, key: str, skip_ids: list[int] | None = None,
           unk_word: str = UNK, **limits) -> DataFrame:
    """J2 (+P5): ``(key, text)`` -- ids back to words in order, joined by spaces; ids in
    ``skip_ids`` (special tokens) dropped; an id missing from the vocabulary reads ``<unk>``."""
    words = relabel(seqs, key, "ids", vocab.select("id", "word", "n"), "id", "word", missing=F.lit(unk_word),
                    skip=skip_ids, **limits)
    return words.select(key, F.array_join("word", " ").alias("text"))


__all__ = ["EOS", "UNK", "build_vocab", "vocab_size", "vocab_sketches", "sketched_size", "word_id", "relabel", "encode", "encode_heldout", "oov_rate",
           "decode"]
