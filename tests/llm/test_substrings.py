"""Substring dedup: brute force over all windows, and the symbols' own promise."""
import hashlib
import random

import numpy as np
import pytest

from corpusmill.llm import substrings


def brute(rows, width=20):
    """Words removed and kept of every (doc_id, text), documents in order of id, null first."""
    seen, out = set(), {}
    for key in sorted({(d is not None, d or 0, t) for d, t in rows}, key=lambda x: (x[0], x[1])):
        words = (key[2] or "").encode().split()
        gone = set()
        for p in range(len(words) - width + 1):
            window = tuple(words[p:p + width])
            if window in seen:
                gone.update(range(p, p + width))
            seen.add(window)
        kept = b" ".join(w for k, w in enumerate(words) if k not in gone)
        out[(key[1] if key[0] else None, key[2])] = (len(words), len(gone), hashlib.sha256(kept).hexdigest())
    return out


def corpus(seed, n=60, vocabulary=12):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        words = [f"w{rng.randrange(vocabulary)}" for _ in range(rng.choice([0, 3, 19, 20, 21, 50, 120]))]
        if rows and rng.random() < 0.7:
            old = (rng.choice(rows)[1] or "").split()
            if old:
                a = rng.randrange(len(old))
                at = rng.randrange(len(words) + 1)
                words[at:at] = old[a:a + rng.choice([10, 20, 25, 60])]
        if rng.random() < 0.2:
            words += ["x"] * rng.choice([5, 30, 70])
        if rng.random() < 0.2:
            words += ["p", "q", "r"] * rng.choice([5, 30])
        rows.append((k, None if rng.random() < 0.05 else rng.choice([" ", "\n", "\t "]).join(words)))
    return rows


@pytest.mark.parametrize("seed,shift,long", [(1, 0, 32), (2, -30, 32), (3, 2**60, 6)])
def test_query_equals_brute_force(spark, write_tables, monkeypatch, seed, shift, long):
    monkeypatch.setattr(substrings, "LONG", long)
    monkeypatch.setattr(substrings, "GROUP_BYTES", 900)
    rows = [(k + shift, t) for k, t in corpus(seed)]
    path = write_tables(documents=spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5))
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substrings.query(spark, path).collect()}
    assert got == {d: v for (d, _), v in brute(rows).items()}
    assert sum(v[1] for v in got.values()) > 300


def test_repeated_rows_null_ids_and_clashing_columns(spark):
    text = " ".join(f"a{k}" for k in range(40))
    rows = [(None, text, 1), (None, text, 2), (5, text, 3), (5, "new " + text, 4), (5, None, 5), (7, "", 6), (8, text + " end", 7)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, num int")
    got = {r["num"]: r["text"] for r in substrings.drop_repeats(df).collect()}
    # rows 1 and 2 are one document, the first; the order of rows 3 and 4 is that of a hash
    assert got[1] == got[2] == text and got[5] is None and got[6] == "" and got[7] == "end"
    assert (got[3], got[4]) == ("", "new")
    empty = substrings.drop_repeats(df.limit(0))
    assert empty.collect() == [] and empty.columns == ["doc_id", "text", "num"]


def test_every_copy_of_a_long_text_goes_but_the_first(spark):
    body = " ".join(f"t{k * k % 9973}" for k in range(9000))
    rows = [(k, f"{body} own{k}" if k % 2 else f"own{k} {body}") for k in range(24)] + [(99, " ".join(["z"] * 50_000))]
    got = {r["doc_id"]: r["text"] for r in substrings.drop_repeats(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got[0] == rows[0][1] and all(got[k] == f"own{k}" for k in range(1, 24))
    # windows that start at the second word and later repeat the first window
    assert got[99] == "z"


def test_equal_spans_hold_equal_symbols():
    rng = np.random.default_rng(5)
    words = rng.integers(1, 9, 4000).astype(np.uint64)
    words[2000:2600] = words[300:900]
    s = substrings.Symbols(words, np.array([2000, 2000])).compress(4, 3)
    held = {(a, z): n for a, z, n in zip(s.start.tolist(), s.end.tolist(), s.name.tolist())}
    checked = 0
    for a, z, lo, hi, n in zip(s.start.tolist(), s.end.tolist(), s.lo.tolist(), s.hi.tolist(), s.name.tolist()):
        if 300 <= lo and hi <= 900:
            assert held[(a + 1700, z + 1700)] == n
            checked += 1
    assert checked > 50
    assert np.array_equal(s.start[1:], s.end[:-1]) and s.start[0] == 0 and s.end[-1] == 4000
