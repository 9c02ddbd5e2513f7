"""What a step leaves on disk: packed numbers, no shuffle files, no tables that nothing reads any more."""
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from corpusmill.operators import ngram, pack, stream, vocab
from corpusmill.operators.tokens import doc_tokens
from corpusmill.plans import chunks, dictionaries
from corpusmill.plans.lineage import discard, materialize
from corpusmill.session import scratch_folder
from corpusmill.streaming import ingest
from helpers import docs_df


def rows_of(df):
    return sorted(map(str, df.collect()))


def tables(spark):
    folder = scratch_folder(spark).removeprefix("file://").removeprefix("file:")
    return set(os.listdir(folder)) if os.path.isdir(folder) else set()


def shuffle_files(spark):
    found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {found.apply(k).getName() for k in range(found.size()) if found.apply(k).getName().startswith("shuffle_")}


def test_packed_lists_come_back(spark):
    lists = [[], [0], [255, 256, 0], [-1, 5], list(range(70_000)), [2**62, 1], []]
    sizes = np.array([len(x) for x in lists])
    flat = np.array([x for own in lists for x in own], np.int64)
    out = dictionaries.packed(flat, sizes)
    assert dictionaries.unpacked(out, sizes).tolist() == flat.tolist()
    assert len(dictionaries.packed(np.zeros(0, np.int64), np.zeros(0, np.int64))) == 0
    # tokens of a block: under three bytes each
    some = np.random.default_rng(1).zipf(1.3, 40_000) % 60_000
    assert sum(len(x.as_py()) for x in dictionaries.packed(some, np.full(80, 500))) < 3 * len(some)
    df = spark.createDataFrame([(k, len(x), x) for k, x in enumerate(lists)], "k int, n bigint, ids array<bigint>")
    p = dictionaries.packed_rows(df, "ids")
    assert p.schema["ids"].dataType.simpleString() == "binary" and rows_of(dictionaries.unpacked_rows(p, "ids")) == rows_of(df)


def test_blocks_are_bounded_by_rows_and_values():
    lists = [["a"] * k for k in (3, 0, 9, 1, 1, 30, 2, 2, 2, 0)]
    batches = pa.table({"words": lists, "k": list(range(10))}).to_batches(max_chunksize=4)
    for rows, most in ((3, 100), (100, 10), (2, 4), (1, 1)):
        got = list(dictionaries.lots_of_rows(batches, "words", rows, most))
        assert [k for b in got for k in b.column("k").to_pylist()] == list(range(10))
        assert all(b.num_rows <= rows and (b.num_rows == 1 or len(b.column("words").flatten()) <= most) for b in got)


def test_first_places_of_rows_with_and_without_keys_of_their_own(spark):
    rows = [(9, ["b", "a", "b"]), (4, ["c", "b"]), (7, []), (5, ["a", "d", "d"])]
    for extra in ([], [(4, ["z", "c"])], [(None, ["d", "q"])]):
        df = spark.createDataFrame(rows + extra, "doc_id bigint, words array<string>").coalesce(1)
        got = {r["w"]: (r["doc_id"], r["k"], r["lost"], r["c"]) for r in dictionaries.first_places(dictionaries.code_blocks(df, "doc_id", "words"), "doc_id", "w").collect()}
        want = {}
        for d, own in rows + extra:
            for k, w in enumerate(own):
                a = want.setdefault(w, [[], [], 0])
                a[0 if d is not None else 1].append((d, k))
                a[2] += 1
        assert got == {w: (*(min(a[0]) if a[0] else (None, None)), min(a[1])[1] if a[1] else None, a[2]) for w, a in want.items()}


def test_steps_leave_no_shuffle_files_and_no_tables_that_are_used_up(spark, tmp_path):
    import gc
    docs = docs_df(spark, [" ".join(f"w{(k * j) % 23}" for j in range(k % 40)) for k in range(90)])
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    gc.disable()
    try:
        before, own = shuffle_files(spark), tables(spark)
        materialize(docs.repartition(5, "doc_id").groupBy("doc_id").count(), "counted")
        assert shuffle_files(spark) <= before
        c = stream.prepare_corpus(docs, "doc")
        left = {t.rpartition("-")[0] for t in tables(spark) - own}
        assert {"vocab", "stream"} <= left and not left & {"tokens", "doc-sizes", "offsets"}
        own = tables(spark)
        for limits in ({}, {"max_rows": 0}):
            name = f"{tmp_path}/out{len(limits)}"
            out = ingest.stream_tokenize(spark, str(tmp_path), c.vocab, 99, name, f"{name}-ck", **limits)
            assert out.count() == c.total
        assert not [t for t in tables(spark) - own if t.startswith("batch-tokens")]
    finally:
        gc.enable()
    discard(docs)  # not a table of ours
    assert spark.read.parquet(f"{tmp_path}/documents.parquet").count() == 90
    assert rows_of(c.docs.select("doc_id", "n", "ids")) == rows_of(vocab.encode(doc_tokens(docs), c.vocab))


def test_windows_shuffle_the_ends_of_long_rows_alone(spark):
    rows, off = [], 0
    for k in range(300):
        ids = [(k * j) % 97 for j in range(1 + k * 7 % 30)]
        rows.append((k, off, len(ids), ids))
        off += len(ids)
    docs = spark.createDataFrame(rows, "doc_id bigint, off bigint, n bigint, ids array<bigint>").coalesce(1)
    long = chunks.runs(docs).collect()
    assert len(long) == 1 and long[0]["n"] == off and long[0]["ids"] == [x for r in rows for x in r[3]]
    flat = long[0]["ids"]
    for df, most in ((docs, 100), (docs.repartition(7), 64), (docs.orderBy(F.col("off").desc()), 1000)):
        got = chunks.runs(df, most).collect()
        assert all(len(r["ids"]) == r["n"] <= most and flat[r["off"]:r["off"] + r["n"]] == r["ids"] for r in got)
        assert sum(r["n"] for r in got) == off
        w = {r["sample_id"]: (r["inputs"], r["target"]) for r in pack.pack_windows(df, 5, off, chunk=16).collect()}
        assert w == {i: (flat[i:i + 5], flat[i + 1:i + 6]) for i in range(off - 5)}
    pieces = chunks.border_chunks(chunks.runs(docs, 2000), 100, 5, (off - 6) // 100)
    assert pieces.count() < off / 100 / 4
    assert chunks.runs(docs.limit(0)).count() == 0


def test_rows_that_overlap_or_leave_gaps_keep_their_windows(spark):
    rows = [(k, 20 * k, 20, [(k * j) % 17 for j in range(20)]) for k in range(30)]
    twice = rows[:9] + [(9, 180, 40, list(range(40))), (9, 200, 40, list(range(40)))] + rows[11:]
    for own, plain in ((rows, True), (twice, False), (rows[1:], False), (rows[:-1], False)):
        docs = spark.createDataFrame(own, "doc_id bigint, off bigint, n bigint, ids array<bigint>").coalesce(2)
        assert chunks.covered_once(docs, 600) is plain
        every = spark.range(600).select(F.col("id").alias("sample_id"))
        want = pack.pack_windows(docs, 5, 600, chunk=16, samples=every)
        text = [F.array_join(F.col(c).cast("array<string>"), " ").alias(c) for c in ("inputs", "target")]
        got = pack.pack_windows(docs, 5, 600, chunk=16, joined=True).select("sample_id", *[F.col(c).cast("string") for c in ("inputs", "target")])
        whole = lambda df: rows_of(df.where("size(split(inputs, ' ')) = 5 AND size(split(target, ' ')) = 5"))
        assert whole(got) == whole(want.select("sample_id", *text)) and len(whole(got)) > 500


def test_models_by_group_are_written_packed(spark):
    docs = docs_df(spark, [" ".join(f"w{(k * j) % 23}" for j in range(k % 40)) for k in range(60)]).withColumn("source", F.concat(F.lit("s"), F.col("doc_id") % 3))
    c = stream.prepare_corpus(docs, "line", keep=("source",))
    m = ngram.fit_ngram(c.docs, c.vocab_size, by=["source"], persist=True)
    for table in (c.docs, c.vocab, m.contexts, m.counts):
        assert table.inputFiles() and all(f.endswith(".zstd.parquet") for f in table.inputFiles())
