"""Queries that go with training runs.

Metric logs ``(run, step, value)``, artifact listings ``(grp, dir, name, mtime)`` and
lookup candidates are DataFrames; every per-group choice is an aggregate (``max_by``,
``min``) or a ``row_number() <= k`` that Spark limits per task before the shuffle, so a
run holding a third of all rows never becomes one unbounded group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions.names import EPOCH_STEP, LAST_NAME, NUMBERED, SUFFIX, number_from, zero_pad
from corpusmill.functions.text import is_stop_word, py_strip
from corpusmill.plans.joins import lookup_join, restrict_to
from corpusmill.plans.lineage import materialize
from corpusmill.plans.ordering import ROWS_PER_BUCKET, global_rank


# ---------------------------------------------------------------- prompts

def take_until(df: DataFrame, part: str, order: str, stop: Column) -> DataFrame:
    """Per ``part``, the rows before the first row (in ``order``) where ``stop`` holds;
    that row and all later ones are dropped.

    The first stop per group is a partial aggregate (``min``), joined back with a
    size-checked join: no per-group window over all rows.
    """
    first = materialize(df.where(stop).groupBy(part).agg(F.min(order).alias("_stop"), F.count(F.lit(1)).alias("_n")), "stops")
    j = lookup_join(df, first, part, how="left", weight="_n").drop("_n")
    return j.where(F.col("_stop").isNull() | (F.col(order) < F.col("_stop"))).drop("_stop")


def take_until_exit(df: DataFrame, part: str = "conv_id", order: str = "turn", text: str = "text") -> DataFrame:
    """P4 with the reference's rule: stop at ``text.lower() in ("quit", "exit")``."""
    return take_until(df, part, order, is_stop_word(text))


def require_nonblank(df: DataFrame, col: str) -> DataFrame:
    """Keep rows whose value, stripped of Unicode whitespace, is not empty."""
    return df.where(F.coalesce(py_strip(col), F.lit("")) != "")


# ---------------------------------------------------------------- metric log

def metric_log(events: DataFrame, run: str = "user_id", ts: str = "ts", tie: str = "event_id",
               value: str = "value", extra: tuple[str, ...] = (),
               rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """``(run, step, value)``: step = 1-based rank of the event in ``(ts, tie)`` order within
    its run. Ranked globally over ``(run, ts, tie)`` with range buckets (a hot run is split
    by ``ts``), minus the run's first rank (one row per run, size-checked join)."""
    e = events.select(F.col(run).alias("run"), F.col(ts).alias("_ts"), F.col(tie).alias("_tie"),
                      F.col(value).cast("double").alias("value"), *extra)
    r = materialize(global_rank(e, ["run", "_ts", "_tie"], out="_g", rows_per_bucket=rows_per_bucket), "ranked-log")
    starts = materialize(r.groupBy("run").agg(F.min("_g").alias("_g0"), F.count(F.lit(1)).alias("_n")), "run-starts")
    j = lookup_join(r, starts, "run", weight="_n")  # a run of a third of all events stays where it is
    return j.select("run", (F.col("_g") - F.col("_g0") + 1).cast("bigint").alias("step"), "value", *extra)


def best_steps(log: DataFrame, every_n: int = 1000, k: int = 3, mode: str = "min") -> DataFrame:
    """T4: checkpoints kept for each run: at every ``every_n``-th step, the ``k`` best values
    (``mode`` min or max; ties: earlier step), plus always the newest step of the run.
    ``(run, step, value, is_top, is_last)``."""
    saved = log.where(F.col("step") % every_n == 0)
    order = F.col("value").asc() if mode == "min" else F.col("value").desc()
    w = Window.partitionBy("run").orderBy(order, F.col("step").asc())
    top = saved.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k) \
        .select("run", "step", "value", F.lit(True).alias("is_top"), F.lit(False).alias("is_last"))
    last = log.groupBy("run").agg(F.max("step").alias("step"), F.max_by("value", "step").alias("value")) \
        .select("run", "step", "value", F.lit(False).alias("is_top"), F.lit(True).alias("is_last"))
    u = top.unionByName(last)
    return u.groupBy("run", "step").agg(F.first("value").alias("value"), F.max("is_top").alias("is_top"),
                                        F.max("is_last").alias("is_last"))


# ---------------------------------------------------------------- artifacts

def artifact_files(log: DataFrame, every_n: int = 10, kind: str = "event_type", ts: str = "ts") -> DataFrame:
    """S8 stand-in listing ``(grp, dir, name, mtime)`` derived from a metric log that kept
    its events' type and time: every saved step (``step % every_n == 0``) of a run is one
    file, named in the style its event type selects, so every latest-version tier and the
    near-miss names occur."""
    s = log.where(F.col("step") % every_n == 0)
    k, run, step = F.col(kind), F.col("run"), F.col("step")
    # This test-data convention maps event types to naming styles.
    d = (F.when(k == "error", F.format_string("lightning_logs/version_%d/checkpoints", F.expr("step div 30")))
         .otherwise(F.lit("checkpoints")))
    name = (F.when(k == "purchase", F.lit(LAST_NAME))
            .when(k == "view", F.concat(F.lit("run"), run.cast("string"), F.lit("-"), zero_pad(step), F.lit(".ckpt")))
            .when(k == "click", F.format_string("run%d-step=%06d.ckpt", run, step))
            .when(k == "error", F.format_string("epoch=%d-step=%d.ckpt", F.expr("step div 25"), step))
            .otherwise(F.format_string("run%d-%06d.txt", run, step)))
    return s.select(run.alias("grp"), d.alias("dir"), name.alias("name"),
                    (F.unix_micros(F.col(ts).cast("timestamp")) / 1e6).alias("mtime"))


def artifact_listing(files: DataFrame, suffix: str = SUFFIX, exclude: str | None = None) -> DataFrame:
    """Files whose name ends with ``suffix``, minus one exact name."""
    out = files.where(F.col("name").endswith(suffix))
    if exclude is not None:
        out = out.where(F.col("name") != exclude)
    return out


def latest_artifact(files: DataFrame, top_dir: str = "checkpoints", log_dir: str = "lightning_logs",
                    numbered: str = NUMBERED, epoch_step: str = EPOCH_STEP, last_name: str = LAST_NAME,
                    suffix: str = SUFFIX) -> DataFrame:
    """T5 per ``grp``: (1) ``top_dir/last.ckpt``; else (2) in ``top_dir`` the ``*.ckpt``
    (not ``last.ckpt``) with the largest number matched by ``numbered``; else (3) under
    ``log_dir/<version>/checkpoints`` the largest ``(epoch, step)``. Numbers compare as
    integers; remaining ties: the larger (dir, name). Groups with no candidate give no row.

    One partial aggregate per group (``max_by`` over a struct), no window.
    ``(grp, tier, path)``."""
    name, d = F.col("name"), F.col("dir")
    is_top = d == top_dir
    in_logs = d.startswith(log_dir + "/") & d.endswith("/checkpoints") & \
        (F.size(F.split(d, "/")) == F.lit(len(log_dir.split("/")) + 2))
    ck = name.endswith(suffix)
    n2 = number_from("name", numbered)
    e3, s3 = number_from("name", epoch_step, 1), number_from("name", epoch_step, 2)
    tier = (F.when(is_top & (name == last_name), F.lit(1))
            .when(is_top & ck & (name != last_name) & n2.isNotNull(), F.lit(2))
            .when(in_logs & ck & e3.isNotNull() & s3.isNotNull(), F.lit(3)))
    a = F.when(tier == 2, n2).when(tier == 3, e3).otherwise(F.lit(0))
    b = F.when(tier == 3, s3).otherwise(F.lit(0))
    t = files.select("grp", "dir", "name", tier.alias("tier"), a.alias("_a"), b.alias("_b")).where(F.col("tier").isNotNull())
    key = F.struct((-F.col("tier")).alias("t"), F.col("_a").alias("a"), F.col("_b").alias("b"),
                   F.col("dir").alias("d"), F.col("name").alias("n"))
    g = t.groupBy("grp").agg(F.max(key).alias("_k"))
    return g.select("grp", (-F.col("_k.t")).cast("int").alias("tier"),
                    F.concat_ws("/", F.col("_k.d"), F.col("_k.n")).alias("path"))


# ---------------------------------------------------------------- lookup

def fuzzy_lookup(candidates: DataFrame, queries: DataFrame, name: str = "name", order: str = "ord",
                 recency: str = "mtime", query: str = "query", qid: str = "qid") -> DataFrame:
    """For every query, the candidate with the longest common substring with it; the
    first-listed (smallest ``order``) wins ties. If no candidate shares even one character
    with the query, or the query is null, the newest candidate (largest ``recency``; a
    recency <= 0 counts as 0; first-listed wins ties).

    Exact and without a cross product: candidate ``c`` has LCS ``m`` with ``q`` iff it
    contains some substring of ``q`` of length ``m``. So the candidates' substrings (up to
    the longest query) are reduced to ``sub -> first-listed candidate`` by one partial
    aggregate, equi-joined with the queries' substrings, and the longest wins.
    ``(qid, query, name, match_size)``."""
    q = queries.select(F.col(qid).alias("qid"), F.col(query).alias("query"))
    maxq = q.agg(F.max(F.length("query")).alias("m")).first()["m"] or 0
    c = candidates.select(F.col(name).alias("name"), F.col(order).alias("ord"), F.col(recency).alias("rec"))
    qsub = _substrings(q.where(F.col("query").isNotNull()), "query", maxq).select("qid", "sub", "len").distinct()
    qsub = materialize(qsub, "query-substrings")
    # one row per substring before any join: a common character costs one row per task
    csub = restrict_to(_substrings(c, "name", maxq), qsub, ["sub"]).groupBy("sub").agg(F.min("ord").alias("ord"))
    hits = qsub.join(csub, "sub")
    best = hits.groupBy("qid").agg(
        F.max(F.struct(F.col("len").alias("len"), (-F.col("ord")).alias("o"))).alias("_h"))
    best = best.select("qid", (-F.col("_h.o")).alias("ord"), F.col("_h.len").alias("_len"))
    names = c.groupBy("ord").agg(F.min("name").alias("_hit"))
    best = best.join(names, "ord", "left").drop("ord")
    newest = c.agg(F.min(F.struct((-F.greatest(F.col("rec").cast("double"), F.lit(0.0))).alias("r"),
                                  F.col("ord").alias("o"), F.col("name").alias("name"))).alias("_n")).first()["_n"]
    fallback = F.lit(None).cast("string") if newest is None else F.lit(newest["name"])
    j = q.join(best, "qid", "left")
    return j.select("qid", "query", F.coalesce(F.col("_hit"), fallback).alias("name"),
                    F.coalesce("_len", F.lit(0)).cast("int").alias("match_size"))


def _substrings(df: DataFrame, col: str, max_len: int) -> DataFrame:
    """All substrings of ``col`` of length 1..``max_len``: ``(..., sub, len)``."""
    s = F.col(col)
    n = F.length(s)
    t = df.where(n > 0).withColumn("_st", F.explode(F.sequence(F.lit(1), n)))
    t = t.withColumn("len", F.explode(F.sequence(F.lit(1), F.least(n - F.col("_st") + 1, F.lit(max(1, max_len))))))
    return t.withColumn("sub", F.substring(s, F.col("_st"), F.col("len"))).drop("_st")
