"""The stages against the operators' own rules on a small corpus; edge rows; empty input."""
import corpus_pipeline as cp
from corpusmill.llm import quality
from corpusmill.llm.common import materialize


def corpus(spark, n=60):
    own = lambda k, m=60: " ".join(f"d{k}w{j}" for j in range(m))
    passage = " ".join(f"p{j}" for j in range(55))
    item = " ".join(f"item{j}" for j in range(25))
    rows = [(k, own(k), "en", f"s{k % 4}", 1) for k in range(n)]
    rows += [(100, own(3), "en", "s0", 1), (101, own(7, 300), "en", "s1", 1),
             (102, own(7, 300).upper(), "en", "s1", 1), (103, own(200) + "\n" + passage, "en", "s1", 1),
             (104, own(201) + "\n" + passage, "en", "s2", 1), (105, own(202) + " " + item + " " + own(203), "en", "s2", 1),
             (106, None, None, None, None), (107, "", "en", None, 0), (None, own(300), "en", None, 1), (108, "too short", "en", "s0", 1),
             (109, own(400), "en", "s3", 1), (109, own(400), "en", "s3", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    return docs, spark.createDataFrame([(1, item)], "item_id bigint, text string")


def test_stages(spark, write_tables):
    docs, items = corpus(spark)
    d = write_tables(documents=docs, benchmark=items)
    seen = {}
    at = spark.read.parquet(f"{d}/documents.parquet")
    for name, stage in cp.STAGES:
        at = materialize(stage(spark, at, d), "test-stage")
        seen[name] = {r.doc_id: r.text for r in at.collect()}
        if name != cp.STAGES[-1][0]:
            assert at.columns == docs.columns
    ids = {k: set(v) for k, v in seen.items()}
    assert ids["quality rules"] == {*range(60), 100, 101, 102, 103, 104, 105, 109, None}
    assert 100 not in ids["line dedup"] and "p0" in seen["line dedup"][103] and "p0" not in seen["line dedup"][104]
    assert {101, 102} & ids["SimHash near-dedup"] == {101}
    assert ids["line dedup"] - ids["benchmark decontamination"] == {102, 105}
    assert ids["mixing sources to target weights"] <= ids["benchmark decontamination"]
    out = cp.run(spark, d)
    assert out.columns == [*docs.columns, "copies"]
    assert {r.doc_id for r in out.collect()} == ids["mixing sources to target weights"]


def test_empty_and_extra_columns(spark, write_tables):
    docs, items = corpus(spark, 5)
    d = write_tables(documents=docs.limit(0), benchmark=items)
    assert cp.run(spark, d).count() == 0
    odd = docs.selectExpr("*", "1 AS copies", "2 AS _runs", "3 AS fp", "4 AS _keep", "5 AS _leaks", "6 AS _quality")
    d = write_tables(documents=odd, benchmark=items)
    out = cp.run(spark, d)
    assert out.columns == [*odd.columns, "copies_"] and out.count() > 0
    assert quality.quality_rules(odd).count() == odd.count()


def test_line_dedup_stage_deletes_the_tail_of_a_run(spark):
    line = lambda tag, n: " ".join(f"{tag}{j}" for j in range(n))
    run = line("r", 100) + "\n" + line("s", 20)
    rows = [(1, "one\n" + run), (2, "two\n" + run), (3, run)]
    got = cp.line_dedup(spark, spark.createDataFrame(rows, "doc_id bigint, text string"), None)
    assert {r.doc_id: r.text for r in got.collect()} == {1: rows[0][1], 2: "two"}
