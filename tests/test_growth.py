"""Steps whose work must follow the input: lookups by a large table, windows as bytes, beams of many prompts."""
import math
from collections import Counter

from pyspark.sql import functions as F

from corpusmill.functions.text import split_words
from corpusmill.operators import generate, ngram, pack, stream, vocab
from corpusmill.plans.lineage import materialize
from helpers import docs_df


def rows_of(df):
    return sorted(map(str, df.collect()))


def test_blocks_relabel_as_rows_do(spark):
    texts = ["the " * 50 + "cat", "the dog the", "", "a the b the c", None] + [f"w{k} the w{k % 7}" for k in range(90)]
    words = docs_df(spark, texts).select("doc_id", split_words("text").alias("words")).repartition(3)
    twice = words.unionByName(words.where("doc_id = 3")).unionByName(words.where("doc_id IN (1, 7)").withColumn("doc_id", F.lit(None).cast("bigint")))
    v = materialize(vocab.build_vocab(words), "vocab")
    for rows, limits, missing, dim, skip in (
            (words, {"max_rows": 0}, F.lit(99).cast("bigint"), v.where("word <> 'the'"), ["dog"]),
            (twice, {}, None, v.where("word <> 'the'"), None)):
        few, blocks = (vocab.relabel(rows, "doc_id", "words", dim, "word", "id", missing=missing, skip=skip, few=n, **limits) for n in (10**6, 0))
        assert rows_of(few) == rows_of(blocks)
    # the values may be arrays themselves, and a block may be a column of the rows
    sub = v.select("word", "n", F.array("id", F.lit(7).cast("bigint")).alias("sub"))
    few, blocks = (vocab.relabel(words, "doc_id", "words", sub, "word", "sub", few=n, block=F.col("doc_id") % 4) for n in (10**6, 0))
    assert rows_of(few) == rows_of(blocks)


def test_blocks_sort_and_shuffle_no_row_per_value(spark):
    words = docs_df(spark, ["a b " * 50, "b c"]).select("doc_id", split_words("text").alias("words"))
    v = materialize(vocab.build_vocab(words), "vocab")
    out = vocab.relabel(words, "doc_id", "words", v, "word", "id", few=0, max_rows=0)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode" in plan and "posexplode" not in plan and "collect_list" not in plan
    out.collect()


def test_a_stream_laid_out_by_its_length_is_in_order(spark, monkeypatch):
    docs = docs_df(spark, [f"a{k % 9} b " * (k % 5) for k in range(60)])
    monkeypatch.setattr(stream, "FILE_POSITIONS", 40)
    c = stream.prepare_corpus(docs, "doc")
    files = [sorted((r["off"], r["until"]) for r in spark.read.parquet(f).select("off", "until").collect()) for f in c.docs.inputFiles()]
    files = sorted(f for f in files if f)
    assert len(files) > 4 and [x for f in files for x in f] == sorted(x for f in files for x in f)
    assert sum(u - o for f in files for o, u in f) == c.total


def test_windows_as_bytes(spark, monkeypatch):
    monkeypatch.setattr(pack, "PART", pack.PART)
    rows = [(0, 0, 3, [10, 0, 7]), (1, 3, 4, [123456789012, 5, 5, 1]), (2, 7, 9, [3, 3, 21, 4, 0, 9, 8, 77, 6])]
    docs = spark.createDataFrame(rows, "doc_id bigint, off bigint, n bigint, ids array<bigint>")
    for size, stride, chunk in ((4, 1, 5), (1, 1, 1), (4, 3, 100), (15, 1, 4), (2, 1, 13)):
        pack.PART = 256 if chunk < 13 else 5
        want = pack.pack_windows(docs, size, 16, stride, chunk).select("sample_id", *[F.array_join(F.col(c).cast("array<string>"), " ").alias(c) for c in ("inputs", "target")])
        got = pack.pack_windows(docs, size, 16, stride, chunk, joined=True)
        assert got.schema["inputs"].dataType.simpleString() == "binary"
        assert rows_of(got.select("sample_id", F.col("inputs").cast("string"), F.col("target").cast("string"))) == rows_of(want) and want.count()


def test_prompts_with_one_last_token_are_completed_once(spark, monkeypatch):
    docs = docs_df(spark, [" ".join(f"w{(k * j) % 13}" for j in range(30)) for k in range(20)])
    c = stream.prepare_corpus(docs, "line")
    model = ngram.persist_model(ngram.fit_ngram(c.docs, c.vocab_size, persist=True))
    prompts = spark.createDataFrame([(k, [k % 11, k % 3]) for k in range(200)] + [(7, [1])], "p bigint, ids array<bigint>")
    written = []
    keep = generate.materialize

    def noted(df, name, *args):
        out = keep(df, name, *args)
        if name == "beams":
            written.append(out.count())
        return out

    monkeypatch.setattr(generate, "materialize", noted)
    got = [rows_of(generate.generate(model, prompts, "p", c.eos_id, 2, 12, **limits)) for limits in ({}, {"max_rows": 0})]
    assert got[0] == got[1] and len(got[0]) > 201
    assert max(written) <= 2 * 3
    assert len(written) == 2 + 12  # beside a table that is not broadcast the plan of a step does not hold that of the step before


def test_models_are_counted_in_tasks_of_bounded_size(spark):
    # one word is half of all tokens; empty texts, texts of one word and a null group are among them
    texts = ["", "the", "odd"] + [" ".join("the" if (k * 7 + j) % 2 else f"w{(k * j) % 19}" for j in range(40)) for k in range(60)]
    docs = docs_df(spark, texts).withColumn("source", F.when(F.col("doc_id") % 9 != 0, F.concat(F.lit("s"), F.col("doc_id") % 3)))
    c = stream.prepare_corpus(docs, "doc", keep=("source",))
    rows = c.docs.orderBy("off").collect()
    flat = [(r["source"], i) for r in rows for i in r["ids"]]
    for order, by in ((1, None), (2, ["source"])):
        want = Counter(((g,) if by else ()) + (a if order == 2 else ngram.NO_CTX, b) for (_, a), (g, b) in zip(flat[:-1], flat[1:]))
        tot = Counter()
        for k, n in want.items():
            tot[k[:-1]] += n
        m = ngram.fit_ngram(c.docs, c.vocab_size, order, 0.5, by, persist=True, task_pairs=100, lot=150)
        assert {tuple(r)[:-1]: r["n"] for r in m.counts.collect()} == want and {tuple(r)[:-1]: r["tot"] for r in m.contexts.collect()} == tot
        assert m.counts.count() == len(want) and m.contexts.count() == len(tot)
        lps = {tuple(r)[:-2]: r["lp"] for r in m.pairs.collect()}
        assert set(lps) == {k for k in want if k[0] is not None}
        assert all(abs(lp - math.log((want[k] + 0.5) / (tot[k[:-1]] + 0.5 * (c.vocab_size + 1)))) < 1e-12 for k, lp in lps.items())
        # tasks follow the input, and none has a large context to itself; a written model is joined with nothing
        tasks = -(-c.total // 100)
        parts = [r["count"] for r in m.counts.groupBy(F.input_file_name()).count().collect()]
        assert tasks > 20 and max(parts) < len(want) / 3 and len(parts) > min(tasks, len(want)) / 3
        assert by or "Join" not in m.pairs._jdf.queryExecution().optimizedPlan().toString()
        assert by or ngram.persist_model(m) is m
    plain = ngram.fit_ngram(c.docs, c.vocab_size, order, 0.5, by)  # no written tables
    assert rows_of(ngram.persist_model(plain).pairs) == rows_of(m.pairs)
    none = ngram.fit_ngram(c.docs.limit(0), 3, persist=True)
    assert none.pairs.count() == none.contexts.count() == 0
