"""Incremental ingest (S5, S7 streaming form).

The stateless part of tokenizing runs per micro-batch: whitespace words, the end marker,
and a lookup in a fixed vocabulary (new words -> ``<unk>``). Output
is the long form ``(doc_id, k, word, id)``, one folder a micro-batch, so no state is kept; the
vocabulary itself is rebuilt in batch (global first-occurrence order needs all the data).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from corpusmill.functions.text import doc_mode_words, line_mode_words
from corpusmill.operators.vocab import sketched_size, vocab_sketches
from corpusmill.plans.dictionaries import code_blocks, coded_values
from corpusmill.plans.joins import fits_broadcast
from corpusmill.plans.lineage import PACKED, discard, materialize, shuffles_dropped


def document_stream(spark: SparkSession, src_dir: str, table: str = "documents",
                    max_files_per_trigger: int | None = None) -> DataFrame:
    """A streaming scan of the table ``{src_dir}/{table}.parquet``, a folder of part files or a
    single file, with the batch schema. ``max_files_per_trigger`` bounds a micro-batch."""
    path = f"{src_dir.rstrip('/')}/{table}.parquet"
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema)
    if max_files_per_trigger:
        stream = stream.option("maxFilesPerTrigger", max_files_per_trigger)
    # as a pattern the path may be a folder or a file; it matches this table's name only
    return stream.parquet(f"{path[:-1]}[{path[-1]}]")


def tokenize_batch(batch: DataFrame, vocab: DataFrame, unk_id: int, mode: str = "doc", written: list | None = None, **limits) -> DataFrame:
    """Stateless tokenizing + encoding of a micro-batch against a static vocabulary ``(id, word, n)``.

    A vocabulary within the broadcast limits is broadcast. Above them the batch is written as numbers into lists of distinct
    words by block (``dictionaries.code_blocks``); the lists meet the vocabulary, so a word that a third of the tokens are
    is one row a block, and no row per token is shuffled. The written
    batch is added to ``written``: the caller may delete it once the result is written."""
    words = doc_mode_words("text") if mode == "doc" else line_mode_words("text")
    if fits_broadcast(vocab, "word", **limits):
        t = batch.select("doc_id", F.posexplode(words).alias("k", "word"))
        found = F.coalesce(F.col("id"), F.lit(unk_id).cast("bigint")).alias("id")
        return t.join(F.broadcast(vocab.select("word", "id")), "word", "left").select("doc_id", F.col("k").cast("int").alias("k"), "word", found)
    coded = materialize(code_blocks(batch.select("doc_id", words.alias("words")), "doc_id", "words", places=False), "batch-tokens", codec=PACKED)
    if written is not None:
        written.append(coded)
    texts = coded.where("_text").select("doc_id", "n", "_block", "codes")
    both = coded_values(coded, texts, vocab, "word", "id", "ids", missing=int(unk_id), values="words")
    t = both.select("doc_id", F.posexplode(F.arrays_zip("words", "ids")).alias("k", "z"))
    return t.select("doc_id", F.col("k").cast("int").alias("k"), F.col("z.words").alias("word"), F.col("z.ids").alias("id"))


def run_available(df: DataFrame, out_path: str, checkpoint: str, output_mode: str = "append") -> None:
    """Process everything available now into a parquet sink, then stop."""
    q = (df.writeStream.format("parquet").outputMode(output_mode)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out_path))
    q.awaitTermination()


def stream_tokenize(spark: SparkSession, src_dir: str, vocab: DataFrame, unk_id: int, out_path: str,
                    checkpoint: str, mode: str = "doc", hot_rows: int | None = None, **limits) -> DataFrame:
    """Tokenize all available documents incrementally; returns the sink table. Each micro-batch writes the folder of its number,
    which a repeated batch overwrites. ``hot_rows`` is kept for callers; hot words need no plan of their own any more."""
    stream = document_stream(spark, src_dir)
    schema = StructType([stream.schema["doc_id"], *[StructField(*f) for f in (("k", IntegerType()), ("word", StringType()), ("id", LongType()))]])

    def write(batch: DataFrame, number: int) -> None:
        written: list[DataFrame] = []
        out = tokenize_batch(batch, vocab, unk_id, mode, written, **limits)
        with shuffles_dropped(spark):
            out.write.mode("overwrite").option("compression", PACKED).parquet(f"{out_path}/batch={number}")
        discard(*written)

    spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{out_path}/batch=-1")  # readable without a batch
    q = (stream.select("doc_id", "text").writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(StructType([*schema.fields, StructField("batch", LongType())])).parquet(out_path).drop("batch")


def stream_metrics(spark: SparkSession, src_dir: str, out_path: str, checkpoint: str,
                   table: str = "events") -> DataFrame:
    """S7 streaming form: append ``(run, ts, name, value)`` rows of an event stream."""
    ev = document_stream(spark, src_dir, table)
    rows = ev.select(F.col("user_id").alias("run"), "ts", F.col("event_type").alias("name"), "value")
    run_available(rows, out_path, checkpoint)
    return spark.read.parquet(out_path)


def stream_word_counts(spark: SparkSession, src_dir: str, out_path: str, checkpoint: str,
                       mode: str = "doc", max_files_per_trigger: int | None = None) -> DataFrame:
    """Running word counts over the document stream. Each micro-batch writes its own counts,
    one row per word of the batch, to the folder of its number, which a repeated batch
    overwrites; reading sums them. So a batch costs what it holds, whatever came before."""
    words = doc_mode_words("text") if mode == "doc" else line_mode_words("text")
    stream = document_stream(spark, src_dir, max_files_per_trigger=max_files_per_trigger).select(F.explode(words).alias("word"))
    schema = "word string, n bigint"

    def write(batch: DataFrame, number: int) -> None:
        counts = batch.groupBy("word").agg(F.count(F.lit(1)).cast("bigint").alias("n"))
        counts.write.mode("overwrite").parquet(f"{out_path}/batch={number}")

    spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{out_path}/batch=-1")  # readable without a batch
    q = (stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(schema + ", batch bigint").parquet(out_path).groupBy("word").agg(F.sum("n").alias("n"))


def stream_vocab_sketch(spark: SparkSession, src_dir: str, out_path: str, checkpoint: str, mode: str = "doc",
                        max_files_per_trigger: int | None = None) -> DataFrame:
    """G2 over the document stream: each micro-batch writes one HLL sketch of its words, the union of all sketches
    gives ``(approx_size)``. A batch leaves 16 kB, however many words it holds."""
    words = doc_mode_words("text") if mode == "doc" else line_mode_words("text")
    stream = document_stream(spark, src_dir, max_files_per_trigger=max_files_per_trigger).select(words.alias("words"))

    def write(batch: DataFrame, number: int) -> None:
        vocab_sketches(batch.withColumn("batch", F.lit(number)), "batch").select("sketch").write.mode("overwrite").parquet(f"{out_path}/batch={number}")

    spark.createDataFrame([], "sketch binary").write.mode("overwrite").parquet(f"{out_path}/batch=-1")  # readable without a batch
    q = (stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    return sketched_size(spark.read.schema("sketch binary, batch bigint").parquet(out_path))
