"""F4-F7, G5-G10 and I2 against numpy / closed forms."""
import math

import numpy as np
from pyspark.sql import functions as F

from corpusmill.functions.scores import log_softmax, target_logprob
from corpusmill.operators import metrics as met
from corpusmill.operators import ngram as ng


def test_log_softmax_and_nll(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(20, 7)) * 30
    t = rng.integers(0, 7, 20)
    df = spark.createDataFrame([(i, [float(v) for v in x[i]], int(t[i])) for i in range(20)],
                               "i int, s array<double>, t int")
    rows = df.select("i", log_softmax("s").alias("ls"), target_logprob("s", "t").alias("lp")).orderBy("i").collect()
    for r in rows:
        v = x[r["i"]]
        ref = v - (v.max() + np.log(np.exp(v - v.max()).sum()))
        assert np.allclose(r["ls"], ref)
        assert math.isclose(r["lp"], ref[t[r["i"]]], rel_tol=1e-12)
    m = met.mean_nll(met.softmax_nll(df, "s", "t")).first()
    assert math.isclose(m["mean_nll"], float(np.mean([-r["lp"] for r in rows])), rel_tol=1e-12)


def test_pad_batch_mask_from_length(spark):
    eos = 9
    seqs = spark.createDataFrame([(0, [1, 9]), (1, [2, 3, 4, 5]), (2, [6]), (3, [])], "k bigint, ids array<bigint>")
    got = {r["k"]: (list(r["input_ids"]), list(r["attention_mask"]), r["batch_id"])
           for r in met.pad_batch(seqs, "k", 2, eos).collect()}
    assert got[0] == ([1, 9, 9, 9], [1, 1, 0, 0], 0)          # a real EOS keeps mask 1
    assert got[1] == ([2, 3, 4, 5], [1, 1, 1, 1], 0)
    assert got[2] == ([6], [1], 1) and got[3] == ([9], [0], 1)
    pos = met.padded_positions(met.pad_batch(seqs, "k", 2, eos), "k")
    assert pos.agg(F.sum("mask")).first()[0] == sum(max(0, n - 1) for n in (2, 4, 1, 0))


def _docs(spark, seqs):
    rows, off = [], 0
    for d, s in enumerate(seqs):
        rows.append((d, off, len(s), s, "a" if d % 2 else "b"))
        off += len(s)
    return spark.createDataFrame(rows, "doc_id bigint, off bigint, n bigint, ids array<bigint>, src string")


SEQS = [[0, 1, 2, 1], [2, 2], [3], [1, 0, 3, 3, 1]]


def test_bigram_counts_normalise_and_beat_unigram(spark):
    docs = _docs(spark, SEQS)
    data = [x for s in SEQS for x in s]
    V = 4
    m = ng.fit_ngram(docs, V, order=2, alpha=0.5)
    pairs = {(r["ctx"], r["next"]): r["n"] for r in m.pairs.collect()}
    want = {}
    for a, b in zip(data, data[1:]):
        want[(a, b)] = want.get((a, b), 0) + 1
    assert pairs == want
    for ctx in range(V):
        lps = {r["next"]: r["lp"] for r in m.pairs.where(F.col("ctx") == ctx).collect()}
        tot = sum(n for (c, _), n in want.items() if c == ctx)
        seen = sum(math.exp(v) for v in lps.values())
        unseen = (V + 1 - len(lps)) * 0.5 / (tot + 0.5 * (V + 1))
        assert math.isclose(seen + unseen, 1.0, rel_tol=1e-12)
    b = docs.select("doc_id", "ids").withColumn("batch_id", F.lit(0))
    samples = spark.createDataFrame([(0, 0, data[:-1], data[1:])], "sample_id bigint, batch_id bigint, inputs array<bigint>, target array<bigint>")
    o = ng.overfit_check(samples).first()
    assert o["bigram_nll"] <= o["unigram_nll"] + 1e-12
    assert o["n_pairs"] == len(data) - 1


def test_scoring_and_grouped_perplexity(spark):
    docs = _docs(spark, SEQS)
    V, a = 4, 0.1
    m = ng.fit_ngram(docs, V, alpha=a)
    held = spark.createDataFrame([(0, [0, 1, 9, 2]), (1, [3])], "k bigint, ids array<bigint>")
    s = {(r["k"], r["pos"]): r["lp"] for r in ng.score_ngram(m, held, "k").collect()}
    assert set(s) == {(0, 1), (0, 2), (0, 3)}                 # first tokens are never scored
    assert math.isclose(s[(0, 3)], math.log(1 / (V + 1)))     # unseen context 9 -> uniform
    g = ng.fit_ngram(docs, V, alpha=a, by=["src"])
    pairs = ng.stream_pairs(docs).collect()
    assert len(pairs) == sum(len(x) for x in SEQS) - 1
    hp = spark.createDataFrame([(0, 1), (1, 9), (2, 2), (3, 3)], "ctx bigint, id bigint")
    res = {r["src"]: r["loss"] for r in ng.perplexity_by_group(g, hp).collect()}
    data = [x for s in SEQS for x in s]
    srcs = [("a" if d % 2 else "b") for d, s in enumerate(SEQS) for _ in s]
    for src in ("a", "b"):
        cnt, ctx = {}, {}
        for i in range(1, len(data)):
            if srcs[i] == src:
                cnt[(data[i - 1], data[i])] = cnt.get((data[i - 1], data[i]), 0) + 1
                ctx[data[i - 1]] = ctx.get(data[i - 1], 0) + 1
        tot = 0.0
        for c, x in [(0, 1), (1, 9), (2, 2), (3, 3)]:
            if c in ctx:
                tot += math.log((cnt.get((c, x), 0) + a) / (ctx[c] + a * (V + 1)))
            else:
                tot += math.log(1 / (V + 1))
        assert math.isclose(res[src], -tot / 4, rel_tol=1e-12)
    e = met.unigram_entropy(spark.createDataFrame([(1, 2), (2, 2)], "id int, n bigint")).first()
    assert math.isclose(e["entropy"], math.log(2))


def test_ones_mask_clamp_and_names(spark):
    from corpusmill.functions.names import number_from, zero_pad
    from corpusmill.functions.scores import clamp, ones_mask
    df = spark.createDataFrame([([5, 6, 7], -3, "a-0012.ckpt"), ([], 9, "x-step=1.ckpt")],
                               "ids array<bigint>, v int, name string")
    r = df.select(ones_mask("ids").alias("m"), clamp("v", F.lit(0), F.lit(4)).alias("c"),
                  number_from("name", r".*-(\d+)\.ckpt").alias("num"), zero_pad(F.col("v")).alias("z")).collect()
    assert [(list(x["m"]), x["c"], x["num"], x["z"]) for x in r] == [([1, 1, 1], 0, 12, "-00003"), ([], 4, None, "000009")]


def test_linear_model_scores(spark):
    from corpusmill.operators.scoring import linear_model, linear_weight, score_batches
    df = spark.createDataFrame([(0, [1.0, -2.0, 0.5]), (1, [0.0, 0.0, 4.0])], "k bigint, x array<float>")
    got = {r["k"]: list(r["logits"]) for r in score_batches(df, linear_model(3, 2), "x", 3).collect()}
    rows = {0: [1.0, -2.0, 0.5], 1: [0.0, 0.0, 4.0]}
    for k, x in rows.items():
        assert got[k] == [sum(x[i] * linear_weight(i, o) for i in range(3)) for o in range(2)]
