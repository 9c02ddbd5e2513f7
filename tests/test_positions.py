"""Lookup by position reads one file; blocks are stitched at borders only; budgets and limits feed the packing."""
import random

from pyspark.sql import functions as F

from corpusmill.operators import pack, stream, tokens, vocab
from corpusmill.plans import chunks
from corpusmill.plans.lineage import materialize
from corpusmill.sources import files, sinks
from corpusmill.streaming import ingest


def stream_of(spark, sizes):
    rows, at = [], 0
    for k, n in enumerate(sizes):
        rows.append((k, at, n, list(range(at, at + n))))
        at += n
    return spark.createDataFrame(rows, "doc_id bigint, off bigint, n bigint, ids array<bigint>"), at


def scanned_rows(df):
    """Rows that the scan of an executed plan gave out, without adaptive execution."""
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    return sum(leaves.apply(k).metrics().apply("numOutputRows").value() for k in range(leaves.size()))


def test_one_index_reads_one_file_of_many(spark):
    docs, total = stream_of(spark, [20] * 400)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        laid = materialize(stream.by_position(docs.repartition(5)), "laid")
        hashed = materialize(docs.repartition(16, "doc_id").withColumn("until", F.col("off") + F.col("n")), "hashed")
        assert len(laid.inputFiles()) >= 12
        for index in (0, 4001, total - 66):
            one, other = stream.sample_at(laid, index, 64), stream.sample_at(hashed, index, 64)
            want = [(index, list(range(index, index + 64)), list(range(index + 1, index + 65)))]
            assert [tuple(r) for r in one.collect()] == want == [tuple(r) for r in other.collect()]
            # the files around the index against those that happen to hold a document on both of its sides
            assert scanned_rows(one) <= 2 * 400 / len(laid.inputFiles()) < scanned_rows(other)
            assert index != 4001 or scanned_rows(other) > 300
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_blocks_shuffle_two_pieces_a_document(spark):
    rng = random.Random(3)
    for sizes in ([0, 1, 2, 34, 35, 36, 37, 70, 71, 105, 3, 1, 1, 1, 500, 0, 2], [rng.randrange(0, 200) for _ in range(60)], [1] * 200, [700], [36], [35]):
        docs, total = stream_of(spark, sizes)
        for block in (5, 35):
            count = max(0, total // block - 1)
            got = {r["sample_id"]: (r["inputs"], r["target"]) for r in pack.pack_blocks(docs, block, total).collect()}
            assert got == {i: (list(range(i * block, (i + 1) * block)), list(range(i * block + 1, (i + 1) * block + 1))) for i in range(count)}
            if count:
                whole = chunks.inner_chunks(docs, block, 1, count - 1).count()
                stitched = chunks.border_chunks(docs, block, 1, count - 1)
                assert whole + stitched.count() == count
    docs, total = stream_of(spark, [5000] * 20)
    assert chunks.border_chunks(docs, 35, 1, total // 35 - 2).count() <= 2 * 20


def test_limits_and_budgets_are_the_corpus_of_the_packing(spark):
    docs = spark.createDataFrame([(k * 3, "a b c d e f g " * (k % 5 + 1)) for k in range(30)], "doc_id bigint, text string")
    own = stream.prepare_corpus(tokens.take_documents(docs, 7), "doc")
    assert own.total == sum(7 * (k % 5 + 1) + 1 for k in range(7)) and own.vocab_size == 8
    fits = tokens.within_budget(docs, 100)
    sizes = [7 * (k % 5 + 1) + 1 for k in range(30)]
    most = max(k for k in range(30) if sum(sizes[:k]) <= 100)
    assert sorted(r["doc_id"] for r in fits.collect()) == [3 * k for k in range(most)]
    assert tokens.within_budget(docs, 0).count() == 0
    assert stream.prepare_corpus(fits, "doc").total == sum(sizes[:most])


def test_sketches_merge_over_groups_and_batches(spark, tmp_path):
    docs = spark.range(600).selectExpr("id AS doc_id", "concat_ws(' ', transform(sequence(0, 40), x -> concat('w', (id * 17 + x * 29) % 9000))) AS text",
                                       "concat('s', id % 3) AS source")
    t = tokens.doc_tokens(docs, "doc", keep=("source",))
    exact = {r["source"]: r["n"] for r in t.select("source", F.explode("words").alias("w")).groupBy("source").agg(F.countDistinct("w").alias("n")).collect()}
    sketches = vocab.vocab_sketches(t, "source")
    for r in vocab.sketched_size(sketches, ["source"]).collect():
        assert abs(r["approx_size"] - exact[r["source"]]) <= 0.03 * exact[r["source"]]
    every = t.select(F.explode("words").alias("w")).distinct().count()
    assert abs(vocab.sketched_size(sketches).first()[0] - every) <= 0.03 * every
    docs.repartition(6).write.parquet(f"{tmp_path}/documents.parquet")
    size = ingest.stream_vocab_sketch(spark, str(tmp_path), f"{tmp_path}/out", f"{tmp_path}/ck", max_files_per_trigger=2).first()[0]
    assert abs(size - every) <= 0.03 * every
    assert spark.read.parquet(f"{tmp_path}/out").where("batch >= 0").select("batch").distinct().count() == 3


def test_listing_is_a_source_with_a_partition_for_each_folder(spark, tmp_path):
    s = spark.range(60).selectExpr("id AS sample_id", "id div 5 AS batch_id")
    sinks.write_samples(s, f"{tmp_path}/shards", batches_per_shard=3)
    (tmp_path / "shards" / "shard=0" / "empty.parquet").touch()
    (tmp_path / "shards" / "deep" / "er").mkdir(parents=True)
    (tmp_path / "shards" / "deep" / "er" / "x.ckpt").write_text("1")
    listed = files.list_files(spark, f"{tmp_path}/shards")
    assert listed.rdd.getNumPartitions() == 6  # the root, four shards, and deep
    found = {(r["dir"], r["name"]) for r in listed.collect()}
    assert ("shard=0", "empty.parquet") in found and ("deep/er", "x.ckpt") in found
    assert sorted(d for d, n in found if n.endswith(".parquet") and n != "empty.parquet") == [f"shard={k}" for k in range(4)]
    assert [r["name"] for r in files.list_files(spark, f"file://{tmp_path}/shards", "*.ckpt").collect()] == ["x.ckpt"]
    assert files.list_files(spark, f"{tmp_path}/shards", recursive=False).count() == 0
