"""Leaks against a brute force over all windows and items; edge rows."""
import random
import time
from collections import Counter

import numpy as np

from corpusmill.llm import decontaminate as dc


def brute(text, items):
    words, out = dc.words_of(text), []
    for item_id, t in items:
        want = dc.words_of(t)
        n, size = len(want), min(5, len(want))
        if not n:
            continue
        grams = lambda w: Counter(tuple(w[k:k + size]) for k in range(len(w) - size + 1))
        best = None
        for s in range(len(words) - n + 1):
            a, b = grams(words[s:s + n]), grams(want)
            sim = sum((a & b).values()) / sum((a | b).values())
            if sim >= 0.8 and (best is None or sim > best[1]):
                best = (item_id, sim, s, n)
        if best:
            out.append(best)
    return out


def test_leaks_equal_brute_force():
    rnd = random.Random(6)
    vocab = [f"w{k}" for k in range(60)] + ["É", "a"]
    items = [(k, " ".join(rnd.choice(vocab) for _ in range(rnd.choice([1, 3, 5, 12, 30, 30, 45])))) for k in range(40)]
    index = dc.Items(items)
    for _ in range(150):
        words = [rnd.choice(vocab) for _ in range(rnd.randint(0, 60))]
        for _, t in rnd.sample(items, rnd.randint(0, 2)):
            part = t.split()
            for _ in range(rnd.choice([0, 0, 1, 2]) if len(part) > 2 else 0):
                k = rnd.randrange(len(part))
                part[k:k + 1] = rnd.choice([[], ["new"], ["x", "y"]])
            at = rnd.randint(0, len(words))
            words[at:at] = part
        text = rnd.choice([" ", ", ", "\n"]).join(words).upper()
        assert index.leaks(text) == brute(text, items)


def test_rows(spark, write_tables):
    item = " ".join(f"q{k}" for k in range(30))
    docs = spark.createDataFrame([(1, "x y " + item.replace(" ", "\n") + " z", 1), (1, item, 1), (1, item, 1), (2, "clean text here", 1),
                                  (None, None, 1), (3, "", 1), (4, "q " * 200_000, 1)], "doc_id bigint, text string, _leaks int")
    items = spark.createDataFrame([(7, item, 0), (7, item, 0), (8, None, 0), (9, "", 0), (None, "- ?", 0)], "item_id bigint, text string, doc_id int")
    for block in (dc.ITEM_WORDS, 10):
        got = sorted(map(tuple, dc.leaks(docs, items, block).collect()))
        assert got == [(1, 7, 1.0, 0, 30)] * 4 + [(1, 7, 1.0, 2, 30)] * 2
        clean = dc.drop_leaky(docs, items, block)
        assert clean.columns == docs.columns and sorted(str(r.doc_id) for r in clean.collect()) == ["2", "3", "4", "None"]
    assert dc.leaks(docs, items.limit(0)).count() == 0 and dc.drop_leaky(docs, items.limit(0)).count() == 7
    d = write_tables(documents=docs.limit(0), benchmark=items)
    assert dc.query(spark, d).count() == 0


def test_documents_shorter_than_the_item():
    item = [f"q{k}" for k in range(60)]
    index = dc.Items([(7, " ".join(item)), (8, "one two three four five")])
    for gone in ([59], [0], [30], [58, 59], [10, 11]):
        words = [w for k, w in enumerate(item) if k not in gone]
        n, left = len(words), len(words) - 4 - (4 if 4 <= gone[0] < 56 else 0)
        want = left / (56 + len(words) - 4 - left)
        assert want >= 0.8 and index.leaks(" ".join(words)) == [(7, want, 0, n)]
    assert index.leaks(" ".join(item[:48])) == [] and index.leaks(" ".join(item[:49])) == [(7, 45 / 56, 0, 49)]
    assert index.leaks("one two three four") == [] and index.leaks("q1 q2") == []


def test_short_documents_equal_brute_force():
    rnd = random.Random(9)
    items = [(k, " ".join(f"w{rnd.randrange(40)}" for _ in range(rnd.randint(1, 40)))) for k in range(60)]
    index, found = dc.Items(items), 0
    for _ in range(200):
        words = rnd.choice(items)[1].split()
        for _ in range(rnd.randint(0, 3)):
            if words:
                del words[rnd.choice([0, -1, rnd.randrange(len(words))])]
        text, want = " ".join(words), []
        for item_id, t in items:
            own = t.split()
            n, size = min(len(own), len(words)), min(5, len(own))
            grams = lambda w: Counter(tuple(w[k:k + size]) for k in range(len(w) - size + 1))
            b, best = grams(own), None
            for s in range(len(words) - n + 1 if words else 0):
                a = grams(words[s:s + n])
                sim = sum((a & b).values()) / sum((a | b).values())
                if sim >= 0.8 and (best is None or sim > best[1]):
                    best = (item_id, sim, s, n)
            want += [best] if best else []
            found += bool(best and n < len(own))
        assert index.leaks(text) == want
    assert found > 20


def test_few_random_items_pass_the_blocks_and_near_ones_do():
    rnd = random.Random(3)
    text = lambda: " ".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=44))
    items = [(k, text()) for k in range(1500)]
    index = dc.Items(items)
    prints = index.groups[44][1]
    passed = 0
    for _ in range(40):
        window = dc.fingerprint(dc._hashes(text().split(), 5))
        values = dc._block_values(window[None])[0]
        every = dc._block_values(prints)
        passed += (np.bitwise_count(every ^ values) <= dc.errors_of(40)).any(axis=1).sum()
    assert passed / (40 * 1500) < 0.01
    found = total = 0
    for k, t in items:
        words = t.split()
        grams = [" ".join(words[j:j + 5]) for j in range(40)]
        for at in rnd.sample(range(40), 4):  # four of forty shingles differ: 36 / 44, just above 0.8
            grams[at] = f"a new shingle {k} {at}"
        h = [dc._hashes(g.split(), 5)[0] for g in grams]
        found += k in index.near(44, dc.fingerprint(h))
        total += 1
    assert found / total >= 0.99


def test_cost_of_a_document_does_not_follow_the_items():
    rnd = random.Random(4)
    vocab = [f"w{k}" for k in range(300)]
    doc = " ".join(rnd.choices(vocab, k=1800))
    took = {}
    for n in (2000, 8000):
        index = dc.Items([(k, " ".join(rnd.choices(vocab, k=6))) for k in range(n)] + [(-1, " ".join(doc.split()[700:706]))])
        index.leaks(doc)
        t = time.process_time()
        assert [x[0] for x in index.leaks(doc)] == [-1]
        took[n] = time.process_time() - t
    assert took[8000] < 2 * took[2000] + 0.2 and took[8000] < 1


def test_blocks_of_items_are_measured_in_words(spark):
    items = spark.createDataFrame([(k, "\n".join(f"a{k}b{j}" for j in range(40))) for k in range(20)] + [(99, "x" * 4000)], "item_id bigint, text string")
    held = [len(b.ids) for b in dc._blocks(items, 200)]
    assert sum(held) == 21 and len(held) >= 5


def test_the_ball_holds_every_value_once():
    ball = dc._ball(3)
    assert len(set(ball.tolist())) == len(ball) == 1 + 24 + 276 + 2024 and np.bitwise_count(ball).max() == 3


def test_both_ways_of_a_block_lookup_find_the_same(monkeypatch):
    rnd = random.Random(2)
    vocab = [f"w{k}" for k in range(9)]
    index = dc.Items([(k, " ".join(rnd.choices(vocab, k=24))) for k in range(400)])
    windows = [dc.fingerprint(dc._hashes(rnd.choices(vocab, k=24), 5)) for _ in range(30)] + [index.groups[24][1][k] for k in range(30)]
    few = [index.near(24, w) for w in windows]
    ball = dc._ball(4)
    monkeypatch.setattr(dc, "_ball", lambda errors: _Short(ball))
    assert [index.near(24, w) for w in windows] == few and sum(map(len, few)) >= 30


class _Short(np.ndarray):
    """A ball that says it is smaller than any number of values."""

    def __new__(cls, held):
        return np.asarray(held).view(cls)

    def __len__(self):
        return 0
