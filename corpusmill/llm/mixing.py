"""Mixing sources to target weights by the cube method.

Targets: sources in code-point order (null last) weigh 1, 2, 3, repeating, and share the
words of the whole corpus; a target stops at 3 times its source's words and the excess is
shared again by weight until none is above. So every target is ``min(level * weight,
3 * words)`` for one level, found from a few sums over the source table.

Sampling: a document's expected number of copies is ``target / words`` of its source: whole
copies for sure, plus one more with the fractional inclusion probability ``p``. The cube
method settles the fractions. Its flight takes three undecided documents of a source, moves
their probabilities along the null space of two constraints (total words and number of
documents stay as they are) until one reaches 0 or 1, and goes on with the next; two
documents at most are left undecided. A source is flown in blocks of about ``block``
documents (by a hash of the row), then the few left of every block fly again together, level
by level, until each source has one small landing problem, which is solved for the nearest
total of words. A hot source is many blocks; only ids and sizes are shuffled.

Reruns agree: directions are drawn from generators seeded by a block's content, in an order
fixed by a hash of the rows. Rows with equal doc_id, source and size are one unit with a count: their whole
copies and the whole part of their expected rest are settled at once, and one fraction flies for
them all, so a row that repeats a million times is one row of one block. Ids pass through
Python as strings.

Edge cases: null text is size 0; a source without words has target 0; an empty table gives an
empty result; null ids and sources are values like any other; extra columns are ignored by
the operator and kept by ``mix``.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.common import WORD, fresh, materialize, ship, table
from corpusmill.plans.ordering import global_offsets, global_rank

WEIGHTS = (1, 2, 3)
MAX_REPEAT = 3
BLOCK = 4_000
#: Equal rows that one array lists at a time.
LOT = 10_000
_EPS = 1e-9


def source_targets(sized: DataFrame) -> DataFrame:
    """``(source, source_size, target)`` of ``sized (source, size)``."""
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size")) \
        .withColumn("_null", F.col("source").isNull().cast("int")) \
        .withColumn("_name", F.coalesce(F.col("source"), F.lit("")))
    ranked = global_rank(materialize(per, "mix-sources"), ["_null", "_name"], out="_rank")
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("_rank") % len(WEIGHTS) + 1).cast("int"))
    per = materialize(ranked.select("source", "source_size", weight.cast("bigint").alias("weight")), "mix-weights")
    # sources fill up in order of 3 * size / weight: behind the ones that are full the rest is shared by weight
    fill = per.withColumn("_fill", MAX_REPEAT * F.col("source_size") / F.col("weight")).withColumn("_full", MAX_REPEAT * F.col("source_size"))
    order = ["_fill", "weight", "source"]
    sums = global_offsets(materialize(fill, "mix-fill"), "_fill", "_full", out="_taken", order=order)
    sums = global_offsets(materialize(sums, "mix-taken"), "_fill", "weight", out="_weight", order=order)
    both = per.agg(F.sum("source_size").alias("total"), F.sum("weight").alias("weight")).first()
    # the level of the first source in order that it does not fill
    share = (F.lit(both["total"] or 0) - F.col("_taken")) / (F.lit(both["weight"] or 0) - F.col("_weight"))
    level = sums.select(share.alias("level"), "_fill").where("level <= _fill").agg(F.min(F.struct("_fill", "level")).alias("m")).first()["m"]
    level = level["level"] if level else float("inf")
    target = F.least(F.col("weight") * F.lit(float(level)), (MAX_REPEAT * F.col("source_size")).cast("double"))
    return per.select("source", "source_size", target.alias("target"))


def fly(size: np.ndarray, p: np.ndarray, seed: int) -> np.ndarray:
    """The flight phase: probabilities moved to 0 or 1 under both constraints, but for two at
    most. Sums of ``p`` and of ``p * size`` stay as they are."""
    p, rng = p.astype(float).copy(), np.random.default_rng(seed)
    draws, at, live, queue = rng.random(len(p) + 3), 0, [], np.flatnonzero((p > 0) & (p < 1)).tolist()[::-1]
    s = size.astype(float)
    while True:
        while len(live) < 3 and queue:
            live.append(queue.pop())
        if len(live) < 3 and not (len(live) == 2 and s[live[0]] == s[live[1]]):
            return p
        if len(live) == 2:
            move = (1.0, -1.0)
        else:
            a, b, c = s[live[0]], s[live[1]], s[live[2]]
            move = (b - c, c - a, a - b) if not a == b == c else (1.0, -1.0, 0.0)
        up = min((1 - p[i]) / u if u > 0 else p[i] / -u for i, u in zip(live, move) if u)
        down = min(p[i] / u if u > 0 else (1 - p[i]) / -u for i, u in zip(live, move) if u)
        # the mean move is zero: each end is as likely as the other end is far
        by = up if draws[at] * (up + down) < down else -down
        at += 1
        stay = []
        for i, u in zip(live, move):
            x = p[i] + by * u
            p[i] = 0.0 if x < _EPS else 1.0 if x > 1 - _EPS else x
            if 0 < p[i] < 1:
                stay.append(i)
        if len(stay) == len(live):  # rounding: settle the nearest one
            near = min(live, key=lambda i: min(p[i], 1 - p[i]))
            p[near] = round(p[near])
            stay.remove(near)
        live = stay


def land(size: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Every open probability to 0 or 1, for the total of words nearest the expected one (then
    the nearest number of documents). After a flight two at most are open."""
    p, open_ = p.copy(), np.flatnonzero((p > 0) & (p < 1))
    best = min(range(2 ** len(open_)), key=lambda m: (
        abs(sum(size[i] * ((m >> k & 1) - p[i]) for k, i in enumerate(open_))),
        abs(sum((m >> k & 1) - p[i] for k, i in enumerate(open_))), m), default=0)
    for k, i in enumerate(open_):
        p[i] = float(best >> k & 1)
    return p


def _fly_block(last: bool):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_order", "size", "doc_id"], na_position="last", kind="stable")
        size = pdf["size"].to_numpy(np.int64)
        seed = int(np.bitwise_xor.reduce(pdf["_order"].to_numpy(np.int64) * np.arange(1, 2 * len(pdf), 2))) & (2**63 - 1)
        p = fly(size, pdf["p"].to_numpy(float), seed)
        return pdf.assign(p=land(size, p) if last else p)

    return run


def balanced_units(sized: DataFrame, targets: DataFrame, block: int = BLOCK) -> DataFrame:
    """``(doc_id, source, size, source_size, target, often, whole, more)``: the distinct rows of ``sized``, how often each
    stands, the copies that each of the equal rows has, and how many of them have one more."""
    # equal rows are counted before the shuffle, the hot source is split by the engine
    units = sized.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("often"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    t = targets.withColumnRenamed("source", "_source")
    rows = units.join(t, units["source"].eqNullSafe(F.col("_source"))).drop("_source") \
        .withColumn("_rate", rate).withColumn("_order", F.xxhash64("doc_id", "source", "size")) \
        .withColumn("doc_id", F.col("doc_id").cast("string")) \
        .withColumn("whole", F.floor("_rate").cast("int")).withColumn("_rest", F.col("often") * (F.col("_rate") - F.floor("_rate"))) \
        .withColumn("more", F.floor("_rest").cast("bigint")).withColumn("p", F.col("_rest") - F.floor("_rest")).drop("_rate", "_rest")
    done, undecided, level = None, rows, 0
    schema = ("doc_id string, size bigint, source string, source_size bigint, target double, often bigint, _order bigint, "
              "whole int, more bigint, p double, _n bigint")
    while True:
        per = undecided.groupBy("source").agg(F.count(F.lit(1)).alias("_n")).withColumnRenamed("source", "_source")
        counted = undecided.join(per, undecided["source"].eqNullSafe(F.col("_source"))).drop("_source")
        # one block once a source's documents fit it: then it lands
        blocks = F.ceil(F.col("_n") / F.lit(block)).cast("bigint")
        key = F.pmod(F.xxhash64("_order", F.lit(level)), blocks)
        cols = [c.split()[0] for c in schema.split(", ")]
        flown = counted.withColumn("_block", key).withColumn("_last", blocks == 1).groupBy("source", "_block", "_last") \
            .applyInPandas(_fly(cols), schema)
        flown = materialize(flown, f"mix-flight{level}")
        settled = (F.col("p") == 0) | (F.col("p") == 1)
        done = flown.where(settled) if done is None else done.unionByName(flown.where(settled))
        undecided = flown.where(~settled).drop("_n")
        if undecided.isEmpty():
            break
        level += 1
    return done.select(F.col("doc_id").cast("bigint").alias("doc_id"), "source", "size", "source_size", "target", "often", "whole",
                       (F.col("more") + F.col("p").cast("bigint")).alias("more"))


def _rows_of(units: DataFrame) -> DataFrame:
    """A row for each of a unit's equal rows, the first ``more`` with one copy more."""
    lots = units.withColumn("_lot", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(often - 1) div {LOT}"))))
    each = lots.withColumn("_k", F.explode(F.sequence(F.col("_lot") * LOT, F.least("often", (F.col("_lot") + 1) * LOT) - 1)))
    return each.select("doc_id", "source", "size", "source_size", "target", (F.col("whole") + (F.col("_k") < F.col("more")).cast("int")).alias("copies"))


def _fly(cols: list[str]):
    open_flight, landing = _fly_block(False), _fly_block(True)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return (landing if bool(key[2]) else open_flight)(pdf)[cols]

    return run


def sizes(docs: DataFrame) -> DataFrame:
    """``(doc_id, source, size)``, written once: the text is read in one scan."""
    size = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("bigint")
    return materialize(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "source", size.alias("size")), "mix-sizes")


def mixed_units(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """``balanced_units`` of ``docs (doc_id, text, source)``."""
    sized = sizes(docs)
    return balanced_units(sized, source_targets(sized), block)


def mixture(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """``(doc_id, source, size, source_size, target, copies)`` for every row of ``docs (doc_id, text, source)``."""
    return _rows_of(mixed_units(docs, block))


def mix(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """``docs`` with the number of ``copies`` that the mix takes of each (0: left out); the
    column's name is lengthened if ``docs`` has it. Of rows that repeat a doc_id, source and size, the first in order
    of a hash of the text have the copies that do not go round."""
    units = materialize(mixed_units(docs, block).select("doc_id", "source", "size", "often", "whole", "more"), "mix-units")
    # among repeated rows, those of a unit are neighbours in order: from the place ``first`` on
    repeated = materialize(global_offsets(units.where("often > 1"), "doc_id", "often", out="first", order=["doc_id", "source", "size"]), "mix-often")
    name, size, at, text = (fresh(docs.columns, n) for n in ("copies", "_mix_size", "_mix_at", "_mix_text"))
    sized = docs.withColumn(size, F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("bigint"))

    def meet(table_: DataFrame) -> tuple[DataFrame, dict]:
        names = {c: fresh([*docs.columns, size], f"_mix_{c}") for c in table_.columns}
        u = table_.select(*[F.col(c).alias(n) for c, n in names.items()])
        same = sized["doc_id"].cast("bigint").eqNullSafe(u[names["doc_id"]]) & sized["source"].eqNullSafe(u[names["source"]]) \
            & (sized[size] == u[names["size"]])
        # the units grow with the corpus: a shuffle at every size, never a broadcast
        return sized.join(u.hint("merge"), same), names

    rows, n = meet(units.where("often = 1"))
    out = rows.select(*docs.columns, (F.col(n["whole"]) + F.col(n["more"])).cast("int").alias(name))
    if repeated.isEmpty():
        return out
    rows, n = meet(repeated)
    rows = materialize(rows.withColumn(text, F.xxhash64("text")), "mix-repeats")
    ranked = global_rank(rows, [n["doc_id"], n["source"], n["size"], text], out=at)
    more = (F.col(at) - F.col(n["first"]) < F.col(n["more"])).cast("int")
    return out.unionByName(ranked.select(*docs.columns, (F.col(n["whole"]) + more).cast("int").alias(name)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixture(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


ship(__name__)
