"""Spelling variants against a comparison of all words."""
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from corpusmill.llm import spellings


def near(a, b):
    """Exactly one inserted, deleted or replaced code point."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[k + (len(a) == len(b)):] == b[k + 1:]


def brute(rows):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= 7:
                counts[run] += 1
    own = {w: n for w, n in counts.items() if n >= 2}
    form, out = {}, {}
    for w, n in own.items():
        others = sorted((-own[x], x) for x in own if near(w, x))
        top = others[0] if others and -others[0][0] >= 10 * n else None
        form[w] = top and top[1]
        out[w] = (n, len(others), top and -top[0])
    def root(w):
        return w if form[w] is None else root(form[w])
    return {w: (form[w], root(w), *v) for w, v in out.items()}


def corpus(seed, words=60):
    rng = random.Random(seed)
    letters = "abcdeéàÿ÷"
    base = ["".join(rng.choice(letters[:4]) for _ in range(rng.choice([6, 7, 8, 9, 12, 20]))) for _ in range(words)]
    base += ["aaaaaaaa", "aaaaaaab", "baaaaaaa", "ééééééé", "abcdabcdabcd"]
    texts = []
    for doc in range(220):
        own = []
        for _ in range(rng.randrange(0, 40)):
            w = base[int(rng.random() ** 3 * len(base))]
            if rng.random() < 0.25:
                at = rng.randrange(len(w))
                w = rng.choice([w[:at] + w[at + 1:], w[:at] + rng.choice(letters) + w[at:], w[:at] + rng.choice(letters) + w[at + 1:]])
            own.append(w.upper() if rng.random() < 0.1 else w)
        texts.append((doc, rng.choice([" ", ", ", "-7\n"]).join(own)))
    return texts + [(None, "aaaaaaaa abcdabcdabcd"), (5, None), (6, "")]


@pytest.mark.parametrize("common,few,held", [(20_000, 20, 100_000), (50, 0, 7), (1, 10**9, 50)])
def test_query_equals_comparison_of_all_words(spark, write_tables, monkeypatch, common, few, held):
    monkeypatch.setattr(spellings, "COMMON", common)
    monkeypatch.setattr(spellings, "FEW", few)
    monkeypatch.setattr(spellings, "HELD", held)
    rows = corpus(11)
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id bigint, text string, word string").repartition(4)
    got = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in spellings.query(spark, write_tables(documents=df)).collect()}
    want = brute(rows)
    assert got == want
    assert sum(v[0] is not None for v in got.values()) > 10 and any(v[1] not in (w, v[0]) for w, v in got.items())


def test_long_words_travel_as_digests(spark):
    rng = random.Random(2)
    long_ = "".join(rng.choice("abc") for _ in range(1500))
    rows = [(k, f"{long_} " * 40) for k in range(2)] + [(9, f"{long_[:700]}{long_[701:]} {long_[:40]}z{long_[41:]}x " * 2), (10, f"{long_[:64]} {long_[:65]} " * 3)]
    rows += [(11, f"{long_[:900]}{'a' if long_[900] != 'a' else 'b'}{long_[901:]} " * 3)]
    got = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"])
           for r in spellings.variants(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == brute(rows)
    assert got[long_[:700] + long_[701:]][0] == long_


def test_empty_table(spark):
    assert spellings.variants(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []


def test_an_edit_leaves_every_gram_outside_of_its_reach():
    rng = random.Random(4)
    grams = spellings.Grams({2: rng.sample(range(1 << 14), 9000), 3: rng.sample(range(1 << 21), 10**6)})
    for _ in range(300):
        w = "".join(rng.choice("abcdefgé") for _ in range(rng.randrange(7, 14)))
        at, c = rng.randrange(len(w)), rng.choice("abcdefgé")
        keys = {x: spellings.keys_of(spellings._codes([x]), grams) for x in (w, w[:at] + c + w[at + 1:], w[:at] + w[at + 1:])}
        same, less = list(keys)[1] if len(keys) == 3 else w, w[:at] + w[at + 1:]
        assert keys[w][spellings.SAME][0, at] == keys[same][spellings.SAME][0, at]
        assert keys[w][spellings.LONGER][0, at] == keys[less][spellings.SHORTER][0, at]
        gram, end = grams.decompose(spellings._codes([w]))
        assert all(2 <= e - p <= 4 or e == len(w) + 1 for p, e in enumerate(end[0].tolist()))
        assert np.all(gram > 0)
