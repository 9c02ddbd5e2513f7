"""Size and layout must not change an answer: part files, null keys, sparse keys, bucket sizes, unfinished writes."""
import os

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import metrics, tokens
from corpusmill.plans import joins
from corpusmill.plans.ordering import global_offsets, global_rank, range_ordered
from corpusmill.sources import sinks
from corpusmill.streaming import ingest


def test_streams_read_every_part_file_of_their_table_alone(spark, tmp_path):
    spark.range(20).selectExpr("id AS doc_id", "concat('a b ', id) AS text").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    spark.range(3).selectExpr("id AS doc_id", "'zz' AS text").write.parquet(f"{tmp_path}/documents_old.parquet")
    got = {r["word"]: r["n"] for r in ingest.stream_word_counts(spark, str(tmp_path), f"{tmp_path}/out", f"{tmp_path}/ck").collect()}
    assert got == {"a": 20, "b": 20, "<eos>": 20, **{str(k): 1 for k in range(20)}}


def test_null_keys_come_first_on_either_path(spark):
    df = spark.createDataFrame([(None, 4), (3, 2), (10, 1), (25, 5), (40, 7), (41, 1)], "k bigint, n bigint")
    got = [{r["k"]: r["off"] for r in global_offsets(df, "k", "n", rows_per_bucket=size, max_buckets=8).collect()} for size in (100, 1)]
    assert got[0] == got[1] == {None: 0, 3: 4, 10: 6, 25: 7, 40: 12, 41: 19}


def test_batches_follow_ranks_not_key_values(spark):
    df = spark.createDataFrame([(k, list(range(1 + k // 10))) for k in range(0, 60, 10)], "k bigint, ids array<bigint>")
    out = {r["k"]: (r["batch_id"], len(r["input_ids"]), sum(r["attention_mask"])) for r in metrics.pad_batch(df, "k", 5, 9).collect()}
    assert out == {0: (0, 5, 1), 10: (0, 5, 2), 20: (0, 5, 3), 30: (0, 5, 4), 40: (0, 5, 5), 50: (1, 6, 6)}


@pytest.mark.parametrize("n", [0, 1, 2, 30, 31, 90, 500])
def test_take_documents_is_the_sorted_prefix(spark, n):
    rows = [(k * 7 % 101 if k else None, f"t{k}") for k in range(80)] + [(14, "again"), (None, "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = sorted((r[0] is not None, r[0] or 0) for r in rows)[:n]
    for size in (1000, 7):
        got = tokens.take_documents(df, n, rows_per_bucket=size).collect()
        assert sorted((r["doc_id"] is not None, r["doc_id"] or 0) for r in got) == want


def test_broadcast_size_counts_every_column(spark):
    df = spark.createDataFrame([(1, "x" * 5000), (2, "y" * 5000)], "k bigint, word string")
    assert joins.size_of(df, "k")[1] >= 10_000 and not joins.fits_broadcast(df, "k", max_bytes=9_000)


def test_landing_refuses_an_unfinished_write_and_shards_are_single_sorted_files(spark, tmp_path):
    os.makedirs(f"{tmp_path}/half")
    with pytest.raises(RuntimeError):
        sinks.land_once(spark.range(3), f"{tmp_path}/half")
    s = spark.range(200).selectExpr("199 - id AS sample_id", "(199 - id) div 5 AS batch_id").repartition(6)
    sinks.write_samples(s, f"{tmp_path}/shards", batches_per_shard=5)
    for shard in range(8):
        files = [f for f in os.listdir(f"{tmp_path}/shards/shard={shard}") if f.endswith(".parquet")]
        assert len(files) == 1
        ids = [r["sample_id"] for r in spark.read.parquet(f"{tmp_path}/shards/shard={shard}/{files[0]}").collect()]
        assert ids == sorted(ids) == list(range(25 * shard, 25 * shard + 25))


def test_prepared_tables_follow_changed_data(spark, tmp_path):
    from corpusmill import catalog
    rows = spark.createDataFrame([(1, "a b", "en", "x")], "doc_id bigint, text string, lang string, source string")
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    first = catalog.corpus(spark, str(tmp_path), "doc")
    assert first.total == 3 and catalog.corpus(spark, str(tmp_path), "doc") is first
    rows.selectExpr("2L AS doc_id", "'c' AS text", "lang", "source").write.mode("append").parquet(f"{tmp_path}/documents.parquet")
    assert catalog.corpus(spark, str(tmp_path), "doc").total == 5


def test_joins_above_the_broadcast_limit_keep_every_row_of_a_hot_key(spark):
    fact = spark.createDataFrame([(k % 3 if k % 4 else None, k) for k in range(60)], "k bigint, v bigint")
    dim = spark.createDataFrame([(0, "x", 20), (1, "y", 20)], "k bigint, d string, n bigint")
    for how in ("inner", "left"):
        want = sorted(map(str, joins.lookup_join(fact, dim, "k", how, weight="n").collect()))
        for hot in (0, 1, 5):
            got = joins.lookup_join(fact, dim, "k", how, weight="n", max_rows=0, hot_rows=hot)
            assert sorted(map(str, got.select("k", "v", "d", "n").collect())) == want


def test_order_has_no_bucket_limit_and_splits_a_hot_leading_key(spark):
    rows = [(0 if k % 2 else k, k, f"t{k % 7}") for k in range(1400)] + [(None, -1, "x"), (0, None, "y")]
    df = spark.createDataFrame(rows, "k bigint, v bigint, t string").repartition(3)
    want = sorted(rows, key=lambda r: tuple((x is not None, x or 0) for x in r[:2]))
    t = range_ordered(df, ["k", "v"], 700)
    held = [r["n"] for r in t.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()]
    assert len(held) > 512 and max(held) <= 20  # half of the rows share k = 0
    got = [tuple(r)[:3] for r in sorted(global_rank(df, ["k", "v"], rows_per_bucket=2).collect(), key=lambda r: r["idx"])]
    assert got == want
    sums, total = {}, 0
    for r in want:
        sums[r] = total
        total += (r[1] or 0) % 5  # -1 counts 4, as pmod has it
    sized = df.withColumn("n", F.pmod(F.coalesce("v", F.lit(0)), F.lit(5)))
    assert {tuple(r)[:3]: r["off"] for r in global_offsets(sized, "k", "n", order=["k", "v"], rows_per_bucket=2).collect()} == sums
