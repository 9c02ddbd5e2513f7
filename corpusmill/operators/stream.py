"""The global token stream (W1, W2, W7, J4) and the prepared corpus.

The stream is kept in *document form* ``(doc_id, off, n, ids)``: document ``doc_id``
occupies stream positions ``[off, off + n)``. The long form ``(pos, doc_id, id)`` is a
narrow ``posexplode`` of it, and packing reads the document form directly (see
``plans.chunks``), so no operator needs one row per token in a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.text import EOS
from corpusmill.operators.tokens import DOC_MODE, doc_tokens
from corpusmill.operators.vocab import build_vocab, encode, encode_blocks, word_id
from corpusmill.plans.dictionaries import code_blocks, first_places, packed_rows, unpacked_rows
from corpusmill.plans.lineage import PACKED, discard, materialize
from corpusmill.plans.ordering import ROWS_PER_BUCKET, global_offsets


def stream_offsets(enc: DataFrame, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """``(doc_id, n, off)`` -- exclusive prefix sum of lengths in ``doc_id`` order."""
    return global_offsets(enc.select("doc_id", "n"), "doc_id", "n", rows_per_bucket=rows_per_bucket)


def token_stream(stream_docs: DataFrame) -> DataFrame:
    """Long form ``(pos, doc_id, id)`` of the concatenated stream (narrow)."""
    return stream_docs.select("doc_id", "off", F.posexplode("ids").alias("k", "id")) \
        .select((F.col("off") + F.col("k")).alias("pos"), "doc_id", "id")


#: Positions of a written file of the stream.
FILE_POSITIONS = 4_000_000
#: Positions of the written stream that are looked up with one dictionary.
BLOCK_POSITIONS = 1_000_000


def by_position(stream_docs: DataFrame, total: int | None = None) -> DataFrame:
    """The stream laid out by position, with ``until``, the position behind a document: range partitions of ``off``, sorted.
    Written so, a file holds one range of positions, and its row-group statistics of ``off`` and ``until`` tell a lookup
    which files it can pass over. With the stream's length ``total`` the ranges are equal parts of it, and the documents are not
    computed a second time for a sample of their positions; their ids, packed already or not, go through the shuffle packed."""
    laid = stream_docs.withColumn("until", F.col("off") + F.col("n"))
    if total is None:
        return laid.repartitionByRange("off").sortWithinPartitions("off")
    parts = max(int(stream_docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // FILE_POSITIONS))
    part = F.least(F.expr(f"off * {parts}L div {max(1, total)}L"), F.lit(parts - 1)).cast("int")
    laid = laid if laid.schema["ids"].dataType.typeName() == "binary" else packed_rows(laid, "ids")
    return unpacked_rows(laid.repartitionById(parts, part).sortWithinPartitions("off"), "ids")


@dataclass
class Corpus:
    """A prepared corpus: tokens, vocabulary and the encoded stream with offsets."""

    tokens: DataFrame   # (doc_id, words), not written
    vocab: DataFrame    # (id, word, n)
    docs: DataFrame     # (doc_id, off, n, ids, until), laid out by position
    total: int          # stream length N (or T)
    vocab_size: int
    eos_id: int


def prepare_corpus(docs: DataFrame, mode: str = DOC_MODE, persist: bool = True,
                   rows_per_bucket: int = ROWS_PER_BUCKET, persist_tokens: bool = True,
                   keep: tuple[str, ...] = ()) -> Corpus:
    """Tokenize, build the vocabulary, encode and lay out the stream.

    With ``persist`` the tokens, as numbers into lists of distinct words by block (``dictionaries.code_blocks``), the slim
    ``(doc_id, n)``, first occurrences, the vocabulary, the offsets and the encoded stream
    are written once to the shared checkpoint folder. The vocabulary comes from the blocks' lists, and the
    encoding looks these lists up, so the texts are tokenized once and no word of a text is shuffled.
    ``persist_tokens=False`` recomputes the (narrow, JVM-side) tokenizing in each of three passes instead of writing the
    words: measured 2x slower at sf0.1, but it avoids a corpus-size write where writes cost more
    than reading the text again. Offsets come from the slim counts and meet the slim ``(doc_id, _block)``; the coded documents, packed
    (``dictionaries.packed``), are shuffled by block and by position alone. The columns ``keep`` go with the slim counts into the stream.
    What only the preparation reads is deleted behind it.
    """
    tokens = doc_tokens(docs, mode, keep).withColumn("n", F.size("words").cast("bigint"))
    coded = materialize(code_blocks(tokens, "doc_id", "words", keep), "tokens", codec=PACKED) if persist and persist_tokens else None
    sizes = (tokens if coded is None else coded.where("_text")).select("doc_id", "n", *keep)
    if persist:
        sizes = materialize(sizes, "doc-sizes")
    seen = None if coded is None else first_places(coded, "doc_id", "word")
    vocab = build_vocab(tokens, rows_per_bucket, persist=persist, sizes=sizes, seen=seen)
    if persist:
        vocab = materialize(vocab, "vocab", codec=PACKED)
    offs = global_offsets(sizes, "doc_id", "n", rows_per_bucket=rows_per_bucket)
    if persist:
        offs = materialize(offs, "offsets")
    own = offs.select("doc_id", "off", *keep)
    enc = encode(tokens, vocab).join(own, "doc_id") if coded is None else encode_blocks(coded, tokens, vocab, own, pack=True)
    stream = enc.select("doc_id", "off", "n", "ids", *keep)
    total = offs.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("t")).first()["t"]
    if persist:
        stream = materialize(by_position(stream, int(total)), "stream", codec=PACKED)
        discard(sizes, offs, *([] if coded is None else [coded]))
    vsize = vocab.count()
    eos = word_id(vocab, EOS)
    return Corpus(tokens, vocab, stream, int(total), int(vsize), -1 if eos is None else eos)


def lay_out(enc: DataFrame, rows_per_bucket: int = ROWS_PER_BUCKET) -> tuple[DataFrame, int]:
    """Encoded documents ``(doc_id, n, ids)`` of any tokenizer as a stream ``(doc_id, off, n, ids)``
    and its length: the sequences that packing reads. Written once."""
    enc = materialize(packed_rows(enc.select("doc_id", "n", "ids"), "ids"), "encoded", codec=PACKED)
    offs = materialize(stream_offsets(enc, rows_per_bucket), "offsets")
    total = int(offs.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    docs = materialize(by_position(enc.join(offs.select("doc_id", "off"), "doc_id").select("doc_id", "off", "n", "ids"), total), "stream", codec=PACKED)
    discard(enc, offs)
    return docs, total


def sample_at(stream_docs: DataFrame, index: int, seq_len: int) -> DataFrame:
    """Window ``index`` without building the others: ``(sample_id, inputs, target)``.

    Only documents overlapping ``[index, index + S + 1)`` pass the filter on ``off`` and ``until``
    (pushed to the scan of a written stream, which reads the row groups of that range alone), then their slices are
    concatenated.
    """
    S, i = int(seq_len), int(index)
    end = i + S + 1
    until = F.col("until") if "until" in stream_docs.columns else F.col("off") + F.col("n")
    d = stream_docs.where((F.col("off") < end) & (until > i))
    start = F.greatest(F.col("off"), F.lit(i))
    stop = F.least(F.col("off") + F.col("n"), F.lit(end))
    piece = F.slice("ids", (start - F.col("off") + 1).cast("int"), (stop - start).cast("int"))
    g = d.select(F.lit(i).cast("bigint").alias("sample_id"), start.alias("start"), piece.alias("piece")) \
        .groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct("start", "piece"))).alias("_p")) \
        .select("sample_id", F.flatten(F.col("_p.piece")).alias("a"))
    return g.where(F.size("a") == S + 1).select(
        "sample_id", F.slice("a", 1, S).alias("inputs"), F.slice("a", 2, S).alias("target"))


def window_sources(stream_docs: DataFrame, seq_len: int, total: int) -> DataFrame:
    """For every stride-1 window ``i`` (``0 <= i < T - S``), the documents it draws from
    and the slice of each: ``(sample_id, doc_id, local_start, local_end)``.

    Window ``i`` spans ``[i, i + S + 1)``; it overlaps document ``[off, off + n)`` iff
    ``off - S <= i <= off + n - 1``. Each document emits exactly its overlapping windows
    (an explode of that range), so the output is linear in its size -- no range join and
    no candidate pairs.
    """
    S, last = int(seq_len), int(total) - int(seq_len) - 1
    lo = F.greatest(F.lit(0).cast("bigint"), F.col("off") - S)
    hi = F.least(F.col("off") + F.col("n") - 1, F.lit(last).cast("bigint"))
    d = stream_docs.where(F.col("n") > 0).select("doc_id", "off", "n", lo.alias("_lo"), hi.alias("_hi")) \
        .where(F.col("_lo") <= F.col("_hi"))
    w = d.select("doc_id", "off", "n", F.explode(F.sequence("_lo", "_hi")).alias("sample_id"))
    return w.select("sample_id", "doc_id",
                    F.greatest(F.lit(0).cast("bigint"), F.col("sample_id") - F.col("off")).alias("local_start"),
                    F.least(F.col("n"), F.col("sample_id") + S + 1 - F.col("off")).alias("local_end"))
