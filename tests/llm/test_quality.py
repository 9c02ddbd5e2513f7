"""Measures against a plain brute force; edge rows."""
import random
import re

from corpusmill.llm import quality as q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    words = WORD.findall(text or "")
    out = {}
    for n in (5, *q.COVERAGE_PCT):
        grams = [tuple(words[k:k + n]) for k in range(len(words) - n + 1)]
        mask = [False] * len(words)
        for k, g in enumerate(grams):
            if grams.count(g) > 1:
                mask[k:k + n] = [True] * n
        out[n] = (sum(mask), sum(len(w) for w, m in zip(words, mask) if m))
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    dup = [x for k, x in enumerate(lines) if x in lines[:k]]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(dup), out[5][0],
            sum(len("".join(WORD.findall(x))) for x in dup), [out[n][1] for n in q.COVERAGE_PCT])


def test_measure_equals_brute_force():
    rnd = random.Random(3)
    for _ in range(300):
        text = "".join(rnd.choice(["a ", "é ", "bc ", "\n", "d  ", "#% ", "\t", "e\x0b", "\x1cf "]) for _ in range(rnd.randint(0, 60)))
        assert q.measure(text) == brute(text), text


def test_rows(spark, write_tables):
    good = " ".join(f"w{k}" for k in range(40))
    rows = [(1, good, 1), (2, "a b c d e " * 8, 1), (None, None, 1), (4, "", 1), (5, good, 1), (5, good, 1), (6, "ab " * 200_000, 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, _quality int")
    d = write_tables(documents=df)
    got = {(r.doc_id, r.n_words): (r.base_failed, r.kept) for r in q.query(spark, d).collect()}
    assert got == {(1, 40): (False, True), (2, 40): (True, False), (None, 0): (True, False), (4, 0): (True, False),
                   (5, 40): (False, True), (6, 200_000): (True, False)}
    kept = q.keep_good(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [1, 5, 5]
    assert q.keep_good(df.limit(0)).count() == 0
