"""Keys and links against brute force; components; edge rows."""
import random
import re

import numpy as np
import xxhash

from corpusmill.llm import simhash as sh
from corpusmill.llm.graph import components


def brute_print(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    grams = [" ".join(words[k:k + 3]) for k in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    fs = list(fps)
    for i, a in enumerate(fs):
        for b in fs[:i]:
            if ((a ^ b) & (2**64 - 1)).bit_count() <= 2:
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {f: find(f) for f in fs}


def test_fingerprint_equals_brute_force():
    rnd = random.Random(5)
    for text in [None, "", " \n", "One", "A b", "É É É", *(" ".join(rnd.choice(["Ab", "é", "Zz\x1c", "q\x0bq"]) for _ in range(rnd.randint(1, 40)))
                                                    for _ in range(60))]:
        assert sh.fingerprint(text) & (2**64 - 1) == brute_print(text)


def test_golay_keys_meet_within_one_bit_and_link_keys_within_two():
    rng = np.random.default_rng(1)
    v = rng.integers(0, 1 << 23, 200)
    for flip in range(23):
        a, b = (set(zip(*map(np.ndarray.tolist, sh.golay_keys(x)))) for x in (v, v ^ (1 << flip)))
        assert {r for r, _ in a & b} == set(range(200))
    f = rng.integers(-2**63, 2**63 - 1, 60)
    for i in range(64):
        for j in range(i):
            g = (f.view(np.uint64) ^ np.uint64(1 << i | 1 << j)).view(np.int64)
            a, b = (set(zip(*map(np.ndarray.tolist, sh.link_keys(x)))) for x in (f, g))
            assert {r for r, _ in a & b} == set(range(60))
    rows, _ = sh.link_keys(f)
    assert np.bincount(rows).max() <= 18


def test_links_have_the_components_of_all_pairs(spark):
    rnd = random.Random(2)
    fps = set()
    for _ in range(6):
        c = rnd.getrandbits(64)
        for _ in range(40):
            for _ in range(rnd.randint(0, 2)):
                c ^= 1 << rnd.randrange(64)
            fps.add(c - (1 << 64) if c >> 63 else c)
    want = brute_components(fps)
    df = spark.createDataFrame([(f,) for f in fps], "fp bigint")
    for hot in (1, 4, 1000):  # all by shared points, mixed, all by pairs
        got = {r.node: r.root for r in components(sh.links(df, hot)).collect()}
        assert all(got.get(f, f) == want[f] for f in fps)


def test_components_on_a_long_path_and_empty(spark):
    e = spark.createDataFrame([(i + 1, i) for i in range(60)] + [(100, 200)], "u bigint, v bigint")
    got = {r.node: r.root for r in components(e).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 200: 100}
    assert components(e.limit(0)).count() == 0


def test_rows(spark, write_tables):
    text = " ".join(f"w{k % 37}x{k}" for k in range(300))
    rows = [(7, text, 1), (3, text, 1), (3, text, 1), (None, text, 1), (9, None, 2), (4, "", 2), (5, " \n", 2), (8, "Other words here", 3)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, component_id int")
    got = sorted((r.doc_id, r.component_id) for r in sh.query(spark, write_tables(documents=df)).collect() if r.doc_id is not None)
    assert got == [(3, 3), (3, 3), (4, 4), (5, 4), (7, 3), (8, 8), (9, 4)]
    kept = sh.keep_one(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [3, 4, 8]
    assert sh.keep_one(df.limit(0)).count() == 0
