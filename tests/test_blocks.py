"""The corpus as numbers into lists by block: the same rows as of words, and no text in a shuffle."""
import pytest
from pyspark.sql import functions as F

from corpusmill.operators import ngram, stream, vocab
from corpusmill.operators.tokens import doc_tokens
from corpusmill.plans import dictionaries
from corpusmill.plans.lineage import materialize


def rows_of(df):
    return sorted(map(str, df.collect()))


ROWS = [(k, " ".join(f"w{(k * j) % 13}" for j in range(k % 9)), "s") for k in range(40)] + [
    (7, "zz w1 yy", "t"), (None, "n1 w2 n1", "s"), (50, None, "q"), (51, "", None)]


@pytest.mark.parametrize("extra", [[], [(-5, "neg w1", "x"), (None, "w1 n1", "s")], [(2**61, "big w1", "x")]])
def test_written_blocks_give_the_rows_of_words(spark, monkeypatch, extra):
    monkeypatch.setattr(dictionaries, "BLOCK_ROWS", 5)
    docs = spark.createDataFrame(ROWS + extra, "doc_id bigint, text string, source string").repartition(3)
    for mode in ("doc", "line"):
        a, b = (stream.prepare_corpus(docs, mode, persist_tokens=p, keep=("source",)) for p in (True, False))
        assert rows_of(a.docs) == rows_of(b.docs) and rows_of(a.vocab) == rows_of(b.vocab)
        assert (a.total, a.vocab_size, a.eos_id) == (b.total, b.vocab_size, b.eos_id)
    assert stream.prepare_corpus(docs.limit(0), "doc").docs.count() == 0


def test_blocks_shuffle_numbers_and_distinct_words_alone(spark):
    tokens = doc_tokens(spark.createDataFrame(ROWS, "doc_id bigint, text string, source string").where("doc_id > 7"))
    coded = materialize(dictionaries.code_blocks(tokens, "doc_id", "words"), "coded")
    assert sum(r["c"] for r in dictionaries.first_places(coded, "doc_id", "word").collect()) == tokens.select(F.sum(F.size("words"))).first()[0]
    v = materialize(vocab.build_vocab(tokens), "vocab")
    offs = materialize(tokens.select("doc_id", F.lit(0).alias("off")), "offs")
    out = vocab.encode_blocks(coded, tokens, v, offs, max_rows=0)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "words" not in plan and "split" not in plan
    assert rows_of(out.select("doc_id", "n", "ids")) == rows_of(vocab.encode(tokens, v))


def test_pairs_of_a_batch_are_counted_where_its_samples_lie(spark):
    data = [(b, i, [(i * j + b) % 5 for j in range(6)]) for b in range(9) for i in range(4)]
    samples = spark.createDataFrame([(b, a[:-1], a[1:]) for b, _, a in data], "batch_id bigint, inputs array<bigint>, target array<bigint>")
    out = ngram.overfit_check(samples)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.split("Initial Plan")[-1].count("Exchange") == 1
    from collections import Counter
    from math import log
    for r in out.collect():
        pairs = Counter(p for b, _, a in data if b == r["batch_id"] for p in zip(a, a[1:]))
        ctx, nxt, P = Counter(), Counter(), sum(pairs.values())
        for (c, x), n in pairs.items():
            ctx[c] += n
            nxt[x] += n
        f = lambda t: sum(n * log(n) for n in t.values())
        assert r["n_pairs"] == P and abs(r["bigram_nll"] - (f(ctx) - f(pairs)) / P) < 1e-9 and abs(r["unigram_nll"] - (P * log(P) - f(nxt)) / P) < 1e-9
    assert out.count() == 9


def test_lots_of_words_are_bounded_by_their_symbols():
    import pandas as pd
    from corpusmill.operators import subword
    sizes = [[3, 1, 9, 2], [40], [], [5, 5, 1, 1, 1]]
    batches = [pd.DataFrame({"syms": [" ".join(["61"] * k) for k in own], "n": range(len(own))}) for own in sizes]
    lots = [(pdf["syms"].str.count(" ") + 1).tolist() for pdf in subword._lots(iter(batches), most=10)]
    assert [k for lot in lots for k in lot] == [k for own in sizes for k in own]
    assert all(sum(lot) <= 10 or len(lot) == 1 for lot in lots) and len(lots) < 9
    assert subword.Words([("61 62 61", 2), ("", 1), ("63", 4)]).lines() == ["61 62 61", "63"]


def test_lists_for_values_become_one_list(spark):
    words = spark.createDataFrame([(1, ["a", "b", "a", "?"]), (2, []), (3, None), (4, ["b"]), (4, ["c", "a"]), (None, ["a"])], "doc_id bigint, words array<string>")
    dim = spark.createDataFrame([("a", 3, [1, 2]), ("b", 2, []), ("c", 1, [7])], "word string, n bigint, sub array<bigint>")
    few, blocks = (vocab.relabel(words, "doc_id", "words", dim, "word", "sub", few=n, flat=True) for n in (10**6, 0))
    assert few.schema == blocks.schema and rows_of(few) == rows_of(blocks)
    assert {r["doc_id"]: r["sub"] for r in blocks.where("doc_id = 1 OR doc_id = 2").collect()} == {1: [1, 2, 1, 2], 2: []}


def test_a_micro_batch_beside_a_large_vocabulary_is_looked_up_by_block(spark):
    from corpusmill.streaming import ingest
    docs = spark.createDataFrame(ROWS + [(60, None, None), (61, "w1", "s"), (61, "w1", "s")], "doc_id bigint, text string, source string").repartition(3)
    v = materialize(vocab.build_vocab(doc_tokens(docs)).where("word <> 'w3'"), "vocab")
    a, b = (ingest.tokenize_batch(docs, v, 99, mode, **limits) for mode, limits in (("line", {}), ("line", {"max_rows": 0})))
    assert a.schema.simpleString() == b.schema.simpleString() and rows_of(a) == rows_of(b) and a.where("id = 99").count() > 5
    plan = b._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "split" not in plan
