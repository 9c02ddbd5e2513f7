"""Matches against brute-force containment in the windows; no Python in the plan; edge rows."""
import random
import re

from corpusmill.llm import licenses as lc


def brute(text):
    words, out = lc.words_of(text or ""), {}
    for (size, length), own in lc._classes(lc.TEMPLATES).items():
        for name, t in own:
            want = {tuple(t[k:k + size]) for k in range(len(t) - size + 1)}
            for start in range(0, len(words), length):
                held = words[start:start + 2 * length]
                share = len(want & {tuple(held[k:k + size]) for k in range(len(held) - size + 1)}) / len(want)
                if share >= 0.8 and share > out.get(name, (0,))[0]:
                    out[name] = (share, start)
    return out


def test_scan_equals_brute_force(spark, write_tables):
    rnd = random.Random(4)
    docs = []
    for k in range(120):
        words = [rnd.choice(["the", "License", "software", "x", "copy", "of", "é"]) for _ in range(rnd.randint(0, 150))]
        for _, t in rnd.sample(lc.TEMPLATES, rnd.randint(0, 3)):
            part = t.split()
            if len(part) > 30:
                part[rnd.randrange(len(part))] = "changed"
            words[(at := rnd.randint(0, len(words))):at] = part
        docs.append((k, rnd.choice([" ", "\n", " - "]).join(words).swapcase(), "x"))
    docs += [(200, None, "x"), (201, "", "x"), (None, "MIT; released under the mit license!", "x"), (None, "MIT; released under the mit license!", "x"),
             (202, "license " * 60_000, "x")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, words string")
    got = {(r.doc_id, r.license_id): (round(r.containment, 6), r.start) for r in lc.scan(df).collect()}
    want = {(d, n): (round(s, 6), at) for d, t, _ in docs for n, (s, at) in brute(t).items()}
    assert got == want and (None, "mit") in got
    plan = lc.scan(df)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    assert lc.query(spark, write_tables(documents=df.limit(0))).count() == 0


def test_anchors_leave_too_few_shingles():
    for _, t in lc.TEMPLATES:
        words = lc.words_of(t)
        grams = set(lc._shingles(words, min(5, len(words))))
        chosen = set(lc.anchors(words))
        assert sum(not chosen & set(g.split()) for g in grams) < 0.8 * len(grams)


def test_short_templates_in_one_window(spark):
    rnd = random.Random(12)
    docs = []
    for k in range(4000):
        words = [f"w{rnd.randrange(10**6)}" for _ in range(11)]
        at = rnd.randrange(4)  # the first window only
        words[at:at] = "released under the mit license".split()
        docs.append((k, " ".join(words)))
    got = lc.scan(spark.createDataFrame(docs, "doc_id bigint, text string"), [("mit", "Released under the MIT License.")])
    assert got.count() == len(docs)


def test_bands_keep_the_miss_bound():
    for templates in (lc.TEMPLATES, [("five", "a b c d e"), ("nine", "a b c d e f g h i"), ("three", "a b c"), ("one", "a")]):
        for (size, length), own in lc._classes(templates).items():
            for _, words in own:
                m = len(set(lc._shingles(words, size)))
                c = next(c for c in range(1, m + 1) if c / m >= 0.8)
                assert (1 - c / (2 * length - size + 1 + m - c)) ** lc.bands_of(size, length, own) <= 2e-5
