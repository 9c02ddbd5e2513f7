"""Targets against the rule by brute force; balance of the flight; edge rows."""
import random
from collections import defaultdict

import numpy as np
import pytest

from corpusmill.llm import mixing as mx


def brute_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + k % 3 for k, s in enumerate(names)}
    target, open_, rest = {}, set(names), float(sum(sizes.values()))
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if rest * weight[s] / total > 3 * sizes[s]}
        if not over:
            target.update({s: rest * weight[s] / total for s in open_})
            break
        for s in over:
            target[s] = 3.0 * sizes[s]
            rest -= 3 * sizes[s]
        open_ -= over
    return target


def test_flight_keeps_both_totals_and_landing_settles():
    rng = np.random.default_rng(4)
    for n in (0, 1, 2, 3, 50, 2000):
        size, p = rng.integers(0, 9, n) ** 3, rng.random(n)
        out = mx.fly(size, p, 1)
        assert ((out > 0) & (out < 1)).sum() <= 2
        assert abs(out.sum() - p.sum()) < 1e-4 and abs((out * size).sum() - (p * size).sum()) < 1e-2
        landed = mx.land(size, out)
        assert set(landed.tolist()) <= {0.0, 1.0}
        assert (mx.fly(size, p, 1) == out).all()


def test_mix(spark, write_tables):
    rnd = random.Random(1)
    rows = []
    for k in range(3000):
        source = rnd.choice(["a"] * 10 + ["b", "c", "d", None])
        rows.append((k, "w " * rnd.randint(0, 60), source))
    rows += [(9999, "x y z", "b")] * 2 + [(None, None, "b"), (5000, "", "zero")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    want = brute_targets(sizes)
    d = write_tables(documents=df)
    for block in (mx.BLOCK, 50):
        out = mx.mixture(df, block).collect()
        assert len(out) == len(rows) and all(0 <= r.copies <= 3 for r in out)
        for s in sizes:
            own = [r for r in out if r.source == s]
            assert own[0].target == pytest.approx(want[s]) and own[0].source_size == sizes[s]
            assert abs(sum(r.copies * r.size for r in own) - want[s]) <= 60
    a, b = (sorted(map(str, mx.query(spark, d).collect())) for _ in range(2))
    assert a == b
    mixed = mx.mix(df.withColumn("copies", df.doc_id))
    assert mixed.columns == ["doc_id", "text", "source", "copies", "copies_"] and mixed.count() == len(rows)
    assert mx.mix(df.limit(0)).count() == 0


def test_one_source_takes_everything_once(spark):
    df = spark.createDataFrame([(1, "a b", None), (2, "c", None)], "doc_id bigint, text string, source string")
    assert [r.copies for r in mx.mixture(df).collect()] == [1, 1]


def test_ids_above_2_53_with_null_ids(spark):
    rows = [(2**60 + 2 * k + 1, "w " * (k % 7), "a") for k in range(60)] + [(None, "w w", "a"), (None, "w w", "b"), (-2**60 - 1, "w", "b")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    for block in (mx.BLOCK, 8):
        assert sorted(str(r.doc_id) for r in mx.mixture(df, block).collect()) == sorted(str(r[0]) for r in rows)
        assert sorted(str(r.doc_id) for r in mx.mix(df, block).collect()) == sorted(str(r[0]) for r in rows)


def test_equal_rows_are_one_unit_whatever_their_number(spark):
    df = spark.range(100_000).selectExpr("7L AS doc_id", "concat('w w ', id % 3) AS text", "'a' AS source", "id AS num") \
        .unionByName(spark.range(5000).selectExpr("id + 100 AS doc_id", "'x y z' AS text", "'b' AS source", "-id AS num"))
    units = mx.mixed_units(df.select("doc_id", "text", "source"), 100)
    assert units.where("doc_id = 7").count() == 1
    out = mx.mixture(df, 100).groupBy("source").agg({"copies": "sum", "target": "max", "*": "count"}).collect()
    for r in out:
        assert r["count(1)"] == (100_000 if r.source == "a" else 5000) and abs(3 * r["sum(copies)"] - r["max(target)"]) <= 3
    mixed = mx.mix(df, 100)
    assert mixed.count() == 105_000 and mixed.select("num", "doc_id").distinct().count() == 105_000
    copies = {r.source: r["s"] for r in mixed.selectExpr("source", "copies").groupBy("source").agg({"copies": "sum"})
              .withColumnRenamed("sum(copies)", "s").collect()}
    assert all(abs(3 * copies[r.source] - r["max(target)"]) <= 3 for r in out)
