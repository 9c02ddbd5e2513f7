"""Sinks and the incremental ingest, read back."""
import os
import tempfile

from pyspark.sql import functions as F

from helpers import docs_df
from corpusmill.operators import stream
from corpusmill.session import scratch_path
from corpusmill.sources import sinks
from corpusmill.streaming import ingest


def test_land_once_is_idempotent(spark):
    path = scratch_path(spark, "land-test")
    a = spark.createDataFrame([(1, "x")], "k int, v string")
    assert sinks.land_once(a, path).count() == 1
    b = spark.createDataFrame([(2, "y"), (3, "z")], "k int, v string")
    assert [tuple(r) for r in sinks.land_once(b, path).collect()] == [(1, "x")]


def test_write_samples_shards_and_append(spark):
    s = spark.range(100).select(F.col("id").alias("sample_id"), (F.col("id") / 8).cast("bigint").alias("batch_id"))
    back = sinks.write_samples(s, scratch_path(spark, "shards"), batches_per_shard=4)
    assert back.count() == 100
    assert back.where("shard = 1").agg(F.min("batch_id"), F.max("batch_id")).first() == (4, 7)
    p = scratch_path(spark, "metric-append")
    m = spark.createDataFrame([(0, 1, "train_loss", 2.5)], "run bigint, step bigint, name string, value double")
    sinks.append_metrics(m, p)
    assert sinks.append_metrics(m, p).count() == 2


def test_stream_tokenize_available_now(spark):
    import pyarrow as pa
    import pyarrow.parquet as pq
    src = tempfile.mkdtemp(prefix="corpusmill-src-")
    texts = ["a b c", "c d", "e"]
    docs = docs_df(spark, texts)
    os.makedirs(os.path.join(src, "documents.parquet"))
    for name, ids in (("documents.parquet/part-0.parquet", [0, 1]), ("documents.parquet/part-1.parquet", [2])):
        pq.write_table(pa.table({"doc_id": pa.array(ids, pa.int64()), "text": [texts[i] for i in ids]}),
                       os.path.join(src, name))
    c = stream.prepare_corpus(docs.where("doc_id < 2"), "doc", persist=False)
    out = ingest.stream_tokenize(spark, src, c.vocab, c.vocab_size, scratch_path(spark, "st-out"),
                                 scratch_path(spark, "st-ckpt"))
    got = sorted((r["doc_id"], r["k"], r["word"], r["id"]) for r in out.collect())
    vid = {r["word"]: r["id"] for r in c.vocab.collect()}
    want = sorted((d, k, w, vid.get(w, c.vocab_size))
                  for d, t in enumerate(["a b c", "c d", "e"]) for k, w in enumerate(t.split() + ["<eos>"]))
    assert got == want


def test_list_files_and_latest(spark):
    from corpusmill.operators import runs
    from corpusmill.sources.files import list_files
    root = tempfile.mkdtemp(prefix="corpusmill-ckpts-")
    names = {"checkpoints": ["x-000900.ckpt", "x-001000.ckpt", "x-step=000100.ckpt", "notes.txt"],
             "lightning_logs/version_0/checkpoints": ["epoch=0-step=12.ckpt"],
             "lightning_logs/version_1/checkpoints": ["epoch=1-step=3.ckpt"]}
    for d, ns in names.items():
        os.makedirs(os.path.join(root, d), exist_ok=True)
        for n in ns:
            with open(os.path.join(root, d, n), "w") as f:
                f.write("x")
    files = list_files(spark, root)
    got = sorted((r["dir"], r["name"]) for r in files.collect())
    assert got == sorted((d, n) for d, ns in names.items() for n in ns)
    latest = runs.latest_artifact(files.withColumn("grp", F.lit(0))).first()
    assert latest["path"] == "checkpoints/x-001000.ckpt"
    ck = list_files(spark, root, "*.ckpt")
    assert ck.count() == 5
    open(os.path.join(root, "checkpoints", "x-002000.ckpt"), "w").close()   # empty files are listed too
    assert list_files(spark, root, "*.ckpt").count() == 6
    assert runs.latest_artifact(list_files(spark, root).withColumn("grp", F.lit(0))).first()["path"] == "checkpoints/x-002000.ckpt"


def test_stream_word_counts(spark):
    import pyarrow as pa
    import pyarrow.parquet as pq
    src = tempfile.mkdtemp(prefix="corpusmill-wc-")
    os.makedirs(os.path.join(src, "documents.parquet"))
    pq.write_table(pa.table({"doc_id": pa.array([0, 1], pa.int64()), "text": ["a b a", "b c"]}),
                   os.path.join(src, "documents.parquet/part-0.parquet"))
    pq.write_table(pa.table({"doc_id": pa.array([2], pa.int64()), "text": ["a"]}),
                   os.path.join(src, "documents.parquet/part-1.parquet"))
    out = ingest.stream_word_counts(spark, src, scratch_path(spark, "wc"), scratch_path(spark, "wc-ck"))
    assert {r["word"]: r["n"] for r in out.collect()} == {"a": 3, "b": 2, "c": 1, "<eos>": 3}
    more = ingest.stream_word_counts(spark, src, f"{scratch_path(spark, 'wc1')}", scratch_path(spark, "wc1-ck"), max_files_per_trigger=1)
    assert {r["word"]: r["n"] for r in more.collect()} == {"a": 3, "b": 2, "c": 1, "<eos>": 3}


def test_word_counts_go_on_where_they_stopped(spark, tmp_path):
    out, ck, src = f"{tmp_path}/out", f"{tmp_path}/ck", f"{tmp_path}/documents.parquet"
    for k, text in enumerate(["a b", "a", "c a"]):
        spark.createDataFrame([(k, text)], "doc_id bigint, text string").write.mode("append").parquet(src)
        got = ingest.stream_word_counts(spark, str(tmp_path), out, ck)
    assert {r["word"]: r["n"] for r in got.collect()} == {"a": 3, "b": 1, "c": 1, "<eos>": 3}
