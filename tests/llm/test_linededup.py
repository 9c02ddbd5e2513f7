"""Runs against a brute force over all ranges of lines; no Python in the plan; edge rows."""
import random
import re

from corpusmill.llm import linededup as ld

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_native_plan(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id bigint, text string")
    plan = ld.drop_runs(df)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_rows(spark, write_tables):
    passage = "\n".join(" ".join(f"w{k}x{j}" for j in range(20)) for k in range(4))
    rows = [(1, "own one\n" + passage, "x"), (2, "own two\n\n" + passage + "\n", "x"), (3, passage, "x"), (3, passage, "x"),
            (4, None, "x"), (None, "", "x"), (5, passage.split("\n")[0], "x"), (6, "z\n" * 30_000, "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, _runs string")
    out = ld.drop_runs(df)
    assert out.columns == df.columns
    got = {(r.doc_id, r.text) for r in out.collect()}
    # the long text repeats one line: all windows but the first are matches, from its second line on
    assert got == {(1, rows[0][1]), (2, "own two\n\n"), (3, ""), (4, None), (None, ""), (5, rows[6][1]), (6, "z\n")}
    assert ld.drop_runs(df.limit(0)).count() == 0
    d = write_tables(documents=df)
    assert sorted(r.n_deleted for r in ld.query(spark, d).collect())[:4] == [0, 0, 0, 0]


def brute(docs, min_words):
    """Texts by (doc_id, text), without any lines of an earlier occurrence, however they are cut:
    all ranges of lines with enough words are compared."""
    places, lines = {}, {}
    for key in sorted(set(docs)):
        lines[key] = own = key[1].split("\n")
        full = [k for k, x in enumerate(own) if WORD.search(x)]
        for i in range(len(full)):
            for j in range(i, len(full)):
                if sum(len(WORD.findall(own[k])) for k in full[i:j + 1]) >= min_words:
                    places.setdefault(tuple(own[k] for k in full[i:j + 1]), []).append((key, full[i], full[j]))
    gone = {key: set() for key in lines}
    for found in places.values():
        for key, s, e in found[1:]:
            gone[key].update(range(s, e + 1))
    return {key: "\n".join(x for k, x in enumerate(own) if k not in gone[key]) for key, own in lines.items()}


def test_whole_runs_with_uneven_lines(spark):
    line = lambda tag, n: " ".join(f"{tag}{j}" for j in range(n))
    rnd = random.Random(5)
    pool = ["a b c", "d", "", " ", "e f", "g h i j k l", "m n", "a b c", "o p q r s t u v w"]
    docs = [(k, "\n".join(rnd.choice(pool) for _ in range(rnd.randint(0, 14)))) for k in range(80)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    for min_words in (1, 4, 9):
        out = ld.drop_runs(df, min_words)
        got = {(r.doc_id, t): r.text for (r, t) in zip(sorted(out.collect()), [t for _, t in sorted(docs)])}
        # a line without a word between two matches may stay
        full = lambda texts: {k: [x for x in t.split("\n") if WORD.search(x)] for k, t in texts.items()}
        assert full(got) == full(brute(docs, min_words))
    for sizes in ((100, 20), (49, 2, 45), (60, 10, 10)):
        run = "\n".join(line(f"r{k}x", n) for k, n in enumerate(sizes))
        docs = [(k, f"{line(f'own{k}y', 5)}\n{run}\n{line(f'end{k}y', 5)}") for k in range(3)] + [(7, run)]
        got = ld.drop_runs(spark.createDataFrame(docs, "doc_id bigint, text string"))
        want = {0: docs[0][1], 7: ""} | {k: f"{line(f'own{k}y', 5)}\n{line(f'end{k}y', 5)}" for k in (1, 2)}
        assert {r.doc_id: r.text for r in got.collect()} == want
    assert not re.search("Python|Pandas|Arrow", out._jdf.queryExecution().toString())
