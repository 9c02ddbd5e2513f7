"""Tables above the broadcast limits with a key on half of the rows: the same results as below them."""
import random

from pyspark.sql import functions as F

from corpusmill.operators import generate, ngram, pack, stream, tokens, vocab
from corpusmill.plans import joins
from corpusmill.streaming import ingest

NO_BROADCAST = {"max_rows": 0}


def corpus(spark, n=60):
    rng = random.Random(1)
    # one word is half of all tokens
    rows = [(k, " ".join("the" if rng.random() < 0.5 else f"w{rng.randrange(30)}" for _ in range(40)), f"s{k % 3}") for k in range(n)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    return docs, stream.prepare_corpus(docs, "doc", keep=("source",))


def rows_of(df):
    return sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect())


def test_salted_join_keeps_every_row(spark):
    fact = spark.range(3000).selectExpr("if(id % 2 = 0, 7, id % 50) AS a", "if(id % 2 = 0, 'x', concat('k', id % 9)) AS b", "id AS v")
    dim = spark.range(60).selectExpr("id AS a", "if(id % 3 = 0, 'x', concat('k', id % 9)) AS b", "id * 10 AS d") \
        .unionByName(spark.range(4).selectExpr("7L AS a", "'x' AS b", "id AS d"))
    assert len(joins.heavy_hashes(fact, ["a", "b"], 0.1)) == 1 and joins.heavy_hashes(fact.limit(0), ["a"]) == []
    for how in ("inner", "left"):
        want = rows_of(fact.join(dim, ["a", "b"], how).select("a", "b", "v", F.coalesce("d", F.lit(-1))))
        for salting in ({}, {"salts": 3, "share": 0.1}, {"share": 1.1}):
            got = joins.spread_join(fact, dim, ["a", "b"], how, **NO_BROADCAST, **salting)
            assert rows_of(got.select("a", "b", "v", F.coalesce("d", F.lit(-1)))) == want


def test_models_and_scores_with_a_context_on_half_of_the_rows(spark):
    docs, c = corpus(spark)
    plain = ngram.fit_ngram(c.docs, c.vocab_size, by=["source"], persist=True)
    spread = ngram.fit_ngram(c.docs, c.vocab_size, by=["source"], persist=True, **NO_BROADCAST)
    assert rows_of(spread.pairs) == rows_of(plain.pairs)
    held = vocab.encode_heldout(tokens.doc_tokens(docs.where("doc_id < 20"), "doc"), c.vocab, c.vocab_size)
    pairs = pack.shift_targets(held, "doc_id").select(F.col("id").alias("ctx"), F.col("next_id").alias("id"))
    assert rows_of(ngram.perplexity_by_group(spread, pairs, **NO_BROADCAST)) == rows_of(ngram.perplexity_by_group(plain, pairs))
    model = ngram.fit_ngram(c.docs, c.vocab_size, persist=True)
    cols = ["doc_id", "pos", "ctx", "id", "lp"]
    assert rows_of(ngram.score_ngram(model, held, "doc_id", **NO_BROADCAST).select(cols)) == rows_of(ngram.score_ngram(model, held, "doc_id").select(cols))


def test_beams_beside_a_table_that_is_not_broadcast(spark):
    docs, c = corpus(spark)
    model = ngram.persist_model(ngram.fit_ngram(c.docs, c.vocab_size, persist=True))
    prompts = spark.createDataFrame([((k, k % 2), [k % 30, 1]) for k in range(40)] + [((99, 0), [10**6])],
                                    "p struct<a: bigint, b: bigint>, ids array<bigint>")
    got = [sorted(map(str, generate.generate(model, prompts, "p", c.eos_id, 2, 5, cut_every=3, **limits).collect())) for limits in ({}, NO_BROADCAST)]
    assert got[0] == got[1] and len(got[0]) > 60
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        succ = generate.dealt_by_context(ngram.top_successors(model, 2).select("ctx", "next", "lp")).persist()
        succ.count()
        last = generate.next_of(prompts.select(F.get("ids", F.lit(-1) + F.size("ids")).alias("_last")), succ)
        plan = last._jdf.queryExecution().executedPlan().toString().split("InMemoryTableScan")[0]
        # one exchange, that of the distinct last tokens: the table is read where it lies
        assert "SortMergeJoin" in plan and plan.count("Exchange hashpartitioning") == 1
        assert "Exchange" not in "".join(plan.splitlines()[-2:])
        assert last.count() > 0
        succ.unpersist()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_stream_lookup_above_the_limit_with_a_hot_word(spark, tmp_path):
    docs = spark.range(50).selectExpr("id AS doc_id", "concat('a', id % 7, ' b unknown') AS text")
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    v = vocab.build_vocab(tokens.doc_tokens(docs, "doc")).where("word <> 'unknown'")
    plain = ingest.stream_tokenize(spark, str(tmp_path), v, 99, f"{tmp_path}/o1", f"{tmp_path}/c1")
    for k, hot in enumerate((0, 1, 3, 100)):
        got = ingest.stream_tokenize(spark, str(tmp_path), v, 99, f"{tmp_path}/o2{k}", f"{tmp_path}/c2{k}", hot_rows=hot, **NO_BROADCAST)
        assert rows_of(got) == rows_of(plain)
    assert plain.where("id = 99").count() == 50 and plain.count() == 200
