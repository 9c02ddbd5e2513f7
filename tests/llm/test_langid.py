"""Held-out accuracy and calibration; parts of the model; edge rows."""
import random

import numpy as np

from corpusmill.llm import langid as li

SYLLABLES = {"aa": ["the", "ing", "sh", "ou"], "bb": ["ñ", "ció", "que", "ez"], "cc": ["sch", "ü", "ver", "ei"]}


def corpus(n):
    rnd = random.Random(2)
    rows = []
    for k in range(n):
        lang = rnd.choice(list(SYLLABLES))
        rows.append((k, " ".join("".join(rnd.choice(SYLLABLES[lang]) for _ in range(rnd.randint(1, 4))) for _ in range(rnd.randint(3, 40))), lang))
    return rows


def test_counts_are_those_of_the_grams():
    a, b = li.counts_of("Ab--C 12"), li.counts_of("ab C  ")
    assert (a == b).all() and a.sum() == 5 + 4 + 3 and li.counts_of("12 -") is None and li.counts_of(None) is None


def test_ftrl_is_sparse_and_temperature_calibrates():
    rng = np.random.default_rng(0)
    f = li.Ftrl(2)
    for _ in range(300):
        y = int(rng.integers(2))
        f.learn(np.array([5 + y, 9]), np.array([0.8, 0.6]), y)
    w = f.weights(np.array([5, 6, 100]))
    assert w[0, 0] > 0 > w[1, 0] and w[1, 1] > 0 > w[0, 1] and (w[:, 2] == 0).all()
    z = rng.normal(size=(4000, 3)) * 2
    p = np.exp(z) / np.exp(z).sum(axis=1, keepdims=True)
    y = np.array([rng.choice(3, p=q) for q in p])
    assert abs(li.temperature(z * 5, y) - 5) < 0.5


def test_held_out_accuracy_and_rows(spark, write_tables):
    rows = corpus(600)
    odd = [(700, None, "aa"), (701, "", "aa"), (702, "12 - 3", "bb"), (None, "the shing ou", None), (703, "que ció " * 100_000, None),
           (703, "que ció " * 100_000, None)]
    df = spark.createDataFrame([(*r, 1) for r in rows + odd], "doc_id bigint, text string, lang string, score int")
    d = write_tables(documents=df)
    got = li.query(spark, d).collect()
    assert len(got) == len(rows) + len(odd) and all(0 <= r.score <= 1 for r in got)
    truth = {k: lang for k, _, lang in rows}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 60 and sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.97
    by = {r.doc_id: r.lang_pred for r in got}
    assert (by[700], by[701], by[702], by[None], by[703]) == ("und", "und", "und", "aa", "bb")
    none = write_tables(documents=df.selectExpr("doc_id", "text", "CAST(NULL AS string) AS lang").limit(5))
    assert {r.lang_pred for r in li.query(spark, none).collect()} == {"und"}
    assert li.query(spark, write_tables(documents=df.limit(0))).count() == 0


def test_labels_of_many_copies_are_learned(spark):
    rows = [(f"the shing ou {'abcdefghij'[k % 10]}", "aa") for k in range(2000)]  # ten distinct texts
    rows += [("que ció ez", "bb")] * 3000 + [(f"ñque {'abcdefghij'[k % 10]} {'klmnopqrst'[k // 10]}", "bb") for k in range(100)]
    model = li.fit(spark.createDataFrame(rows, "text string, lang string"), per_label=100)
    assert model.labels == ["aa", "bb"]
    assert model.predict("the shing ou")[0] == "aa" and model.predict("ñque que")[0] == "bb"
