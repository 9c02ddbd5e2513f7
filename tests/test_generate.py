"""I3/I4 against a brute-force beam search over the same count model."""
import math

from corpusmill.operators import generate as gen
from corpusmill.operators import ngram as ng

SEQS = [[0, 1, 2, 1, 3], [2, 2, 4], [1, 3, 0, 1, 2, 4], [4, 0, 1]]
EOS = 4


def _docs(spark):
    rows, off = [], 0
    for d, s in enumerate(SEQS):
        rows.append((d, off, len(s), s))
        off += len(s)
    return spark.createDataFrame(rows, "doc_id bigint, off bigint, n bigint, ids array<bigint>")


def _brute(model_rows, prompt, beams, steps):
    succ = {}
    for c, x, n, lp in model_rows:
        succ.setdefault(c, []).append((-n, x, lp))
    top = {c: sorted(v)[:beams] for c, v in succ.items()}
    state = [(list(prompt), 0.0, False)]
    for _ in range(steps):
        cand = []
        for ids, sc, done in state:
            if done:
                cand.append((ids, sc, True))
                continue
            nxt = top.get(ids[-1])
            if not nxt:
                cand.append((ids, sc, True))
                continue
            for _, x, lp in nxt:
                cand.append((ids + [x], sc + lp, x == EOS))
        cand.sort(key=lambda t: (-t[1], t[0]))
        state = cand[:beams]
    return state


def test_beams_match_brute_force(spark):
    m = ng.fit_ngram(_docs(spark), 5, alpha=0.1)
    rows = [(r["ctx"], r["next"], r["n"], r["lp"]) for r in m.pairs.collect()]
    prompts = spark.createDataFrame([(0, [0]), (1, [2, 2]), (2, [3]), (3, [9])], "k bigint, ids array<bigint>")
    for beams, steps in ((1, 6), (2, 5), (3, 4)):
        out = gen.generate(m, prompts, "k", EOS, beams=beams, max_new=steps, cut_every=2).collect()
        got = {}
        for r in out:
            got.setdefault(r["k"], []).append((r["rank"], list(r["ids"]), r["score"]))
        for k, p in [(0, [0]), (1, [2, 2]), (2, [3]), (3, [9])]:
            want = _brute(rows, p, beams, steps)
            have = sorted(got[k])
            assert [ids for _, ids, _ in have] == [ids for ids, _, _ in want], (k, beams)
            assert all(math.isclose(a[2], b[1]) for a, b in zip(have, want))


def test_greedy_from_eos_length(spark):
    m = ng.fit_ngram(_docs(spark), 5, alpha=0.1)
    g = gen.greedy_from_eos(m, spark, EOS, total_len=6).first()
    assert g["ids"][0] == EOS and len(g["ids"]) <= 6


def test_beams_without_broadcast(spark, monkeypatch):
    m = ng.fit_ngram(_docs(spark), 5, alpha=0.1)
    prompts = spark.createDataFrame([(0, [0]), (1, [2, 2])], "k bigint, ids array<bigint>")
    a = sorted((r["k"], r["rank"], list(r["ids"])) for r in gen.generate(m, prompts, "k", EOS, 2, 4).collect())
    monkeypatch.setattr(gen, "fits_broadcast", lambda *args, **kw: False)
    b = sorted((r["k"], r["rank"], list(r["ids"])) for r in gen.generate(m, prompts, "k", EOS, 2, 4).collect())
    assert a == b
