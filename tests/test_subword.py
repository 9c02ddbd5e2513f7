"""F2/F3 against a brute-force BPE, one merge at a time."""
import random
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import docs_df
from corpusmill.functions.text import split_words
from corpusmill.operators import subword

TEXTS = ["low lower lowest", "newer newest new", "wide wider", "low low new", ""]


def _py_merges(texts, k):
    words = Counter(w for t in texts for w in t.split())
    syms = {w: list(w) for w in words}
    out = []
    for _ in range(k):
        pc = Counter()
        for w, n in words.items():
            s = syms[w]
            for a, b in zip(s, s[1:]):
                pc[(a, b)] += n
        if not pc:
            break
        best = min(pc.items(), key=lambda kv: (-kv[1], kv[0]))[0]
        out.append(best)
        for w in syms:
            s, i, new = syms[w], 0, []
            while i < len(s):
                if i + 1 < len(s) and (s[i], s[i + 1]) == best:
                    new.append(s[i] + s[i + 1])
                    i += 2
                else:
                    new.append(s[i])
                    i += 1
            syms[w] = new
    return out


def test_learn_merges_and_encode(spark):
    d = docs_df(spark, TEXTS)
    merges = subword.learn_merges(d, 8, cut_every=3)
    assert merges == _py_merges(TEXTS, 8)
    alpha = subword.alphabet(d)
    ids = subword.symbol_table(alpha, merges)
    eos = len(ids)
    enc = {r["doc_id"]: list(r["ids"]) for r in subword.encode_subword(d, merges, ids, eos).collect()}
    ranks = {m: r for r, m in enumerate(merges)}
    for i, t in enumerate(TEXTS):
        want = [ids[s] for w in t.split() for s in subword.bpe_encode_word(w, ranks)] + [eos]
        assert enc[i] == want
    assert subword.bpe_encode_word("lowest", ranks)[0].startswith("low")


@pytest.mark.parametrize("texts", [
    ["ab\x01cd ab\x01cd", "a\x01b"],                         # a control character is a symbol like any other
    ["aaaa aaa aaaaa", "aaaaaaaa baab"],                      # one symbol twice in a row
    ["żółw żółw 日本 日本語 \U0001f600\U0001f600 é$\\1 é$\\1 1 12 21"],
    [" ".join("".join(random.Random(k).choices("abcd", k=random.Random(-k).randint(1, 9))) for k in range(300))],
    ["", None],
])
def test_merges_are_those_of_one_at_a_time(spark, texts):
    got = subword.learn_merges(docs_df(spark, texts), 25, cut_every=4)
    assert got == _py_merges([t or "" for t in texts], 25)


@pytest.mark.parametrize("tracked,held,cut", [(3, 100, 512), (20, 5, 4), (200_000, 0, 9), (200_000, 100_000, 512)])
def test_rounds_and_proposals_do_not_change_the_merges(spark, monkeypatch, tracked, held, cut):
    monkeypatch.setattr(subword, "TRACKED", tracked)
    monkeypatch.setattr(subword, "HELD_WORDS", held)
    rng = random.Random(6)
    texts = [" ".join("".join(rng.choices("abcd", k=rng.randint(1, 12))) for _ in range(60)) for _ in range(6)]
    # symbols that come about in two ways, and pairs of one symbol
    texts += ["abc abc bcx abcab aaaa aaa " * 3, "xabcx abcabc"]
    got = subword.learn_merges(docs_df(spark, texts), 24, cut_every=cut)
    assert got == _py_merges(texts, 24)


def test_changes_of_counts_are_those_of_a_recount():
    rng = random.Random(8)
    index = subword.Words([(" ".join(rng.choices("abc", k=rng.randint(1, 14))), rng.randint(1, 5)) for _ in range(80)])
    times = [int(index.n[np.flatnonzero(index.word == k)[0]]) for k in range(80)]

    def recount():
        counts = Counter()
        for own, n in zip(map(str.split, index.lines()), times):
            for pair in zip(own, own[1:]):
                counts[pair] += n
        return counts

    counts = recount()
    for _ in range(30):
        if not counts:
            break
        pair = max(counts, key=lambda p: (counts[p], p))
        before = [x.split() for x in index.lines()]
        assert index.total(*pair) <= counts[pair]
        for p, c in index.merge(*pair).items():
            counts[p] += c
        counts = +counts
        assert counts == recount()
        assert all(x == y for x, y in zip(before, map(str.split, index.lines())) if pair not in list(zip(x, x[1:])))


def _loop(word, ranks):
    """Merges by rescanning the word."""
    syms = list(word)
    while True:
        found = min((ranks[p] for p in zip(syms, syms[1:]) if p in ranks), default=None)
        if found is None:
            return syms
        out, i = [], 0
        while i < len(syms):
            if i + 1 < len(syms) and ranks.get((syms[i], syms[i + 1])) == found:
                out.append(syms[i] + syms[i + 1])
                i += 2
            else:
                out.append(syms[i])
                i += 1
        syms = out


def test_encoding_a_word_equals_rescanning_and_takes_long_words():
    rng = random.Random(12)
    for _ in range(60):
        parts, pairs = ["a", "b", "c"], []
        for _ in range(12):
            pair = (rng.choice(parts), rng.choice(parts))
            pairs.append(pair)
            parts.append("".join(pair))
        rng.shuffle(pairs)  # also tables in which a later merge has a lower rank
        ranks = {p: r for r, p in enumerate(dict.fromkeys(pairs))}
        for _ in range(20):
            word = "".join(rng.choices("abc", k=rng.randint(0, 30)))
            assert subword.bpe_encode_word(word, ranks) == _loop(word, ranks)
    ranks = {("a", "b"): 0, ("ab", "ab"): 1, ("abab", "abab"): 2, ("c", "c"): 3}
    began = time.process_time()
    out = subword.bpe_encode_word("ab" * 400_000 + "c" * 200_000, ranks)
    assert time.process_time() - began < 20
    assert out == ["abababab"] * 100_000 + ["cc"] * 100_000


def test_rank_table_and_no_end_marker_above_the_broadcast_limit(spark):
    d = docs_df(spark, TEXTS + [None])
    merges = subword.learn_merges(d, 8)
    ids = subword.symbol_table(subword.alphabet(d), merges)
    ranks = subword.merges_table(spark, merges).repartition(3)
    for eos in (None, len(ids)):
        want = {r["doc_id"]: (r["n"], list(r["ids"])) for r in subword.encode_subword(d, merges, ids, eos).collect()}
        got = subword.encode_subword(d, ranks, ids, eos, max_rows=0, hot_rows=2)
        assert {r["doc_id"]: (r["n"], list(r["ids"])) for r in got.collect()} == want
        assert want[4][1] == want[5][1] == ([] if eos is None else [eos])


def test_many_words_are_encoded_together_as_one_by_one(monkeypatch):
    import pyarrow as pa
    rng = random.Random(3)
    monkeypatch.setattr(subword, "LONG_WORD", 25)
    for _ in range(60):
        parts, pairs = ["a", "b", "c"], []
        for _ in range(rng.randint(0, 12)):
            pairs.append((rng.choice(parts), rng.choice(parts)))
            parts.append("".join(pairs[-1]))
        rng.shuffle(pairs)  # also tables in which a later merge has a lower rank
        ranks = {p: r for r, p in enumerate(dict.fromkeys(pairs))}
        ids = {s: i for i, s in enumerate(dict.fromkeys(parts)) if i != 1}
        words = ["".join(rng.choices("abc\U0001f600é", k=rng.choice([0, 1, 2, 5, 20, 40]))) for _ in range(30)]
        got = subword.Encoder(ranks, ids).lists(pa.array(words)).to_pylist()
        assert got == [[ids.get(s, -1) for s in subword.bpe_encode_word(w, ranks)] for w in words]
    assert subword.Encoder({}, {}).lists(pa.array([], pa.string())).to_pylist() == []


def test_documents_are_encoded_where_they_lie(spark, monkeypatch):
    from corpusmill.operators import vocab
    from corpusmill.plans import dictionaries
    monkeypatch.setattr(dictionaries, "BLOCK_ROWS", 3)
    texts = ["abc abd ab abc", "", "ab ab b", None, "c " * 40, "abc bcd cde def efg"] * 4
    d = docs_df(spark, texts).repartition(2)
    merges = subword.learn_merges(d, 6)
    ids = subword.symbol_table(subword.alphabet(d), merges)
    ranks = {p: r for r, p in enumerate(merges)}
    out = subword.encode_subword(d, merges, ids, len(ids))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "explode" not in plan  # no word is shuffled or looked up
    got = {r["doc_id"]: (r["n"], r["ids"]) for r in out.collect()}
    for r in d.collect():
        want = [ids[s] for w in (r["text"] or "").split() for s in subword.bpe_encode_word(w, ranks)] + [len(ids)]
        assert got[r["doc_id"]] == (len(want), want)
    # rows that share an id are merged, as of a lookup
    twice = d.unionByName(d.where("doc_id IN (2, 5)")).unionByName(d.where("doc_id < 2").withColumn("doc_id", F.lit(None).cast("bigint")))
    words = subword.encode_words(subword.word_counts(twice), merges, ids)
    want = vocab.relabel(twice.select("doc_id", split_words("text").alias("words")), "doc_id", "words", words, "word", "sub", flat=True)
    for encoded in (None, words):
        got = subword.encode_subword(twice, merges, ids, None, encoded=encoded)
        assert sorted(map(str, got.select("doc_id", "ids").collect())) == sorted(map(str, want.select("doc_id", F.col("sub").alias("ids")).collect()))
