"""Line dedup by winnowing over line hashes. DataFrame functions only.

A document's lines with a word are hashed (128 bits each). A window is a stretch of lines with ``min_words``
words or more that would have fewer without its last line, or without its first one: every line
starts one of the first kind and ends one of the second, where the document has that many words. Winnowing selects the
smallest line hash of every window (the leftmost among equals): two equal windows select the
same line, so any run of lines with ``min_words`` words that occurs twice shares a selected
fingerprint. Places are joined on shared fingerprints: each with the earliest one (by doc_id, then
line) whose surroundings agree line by line over a window. From its place a match
reaches both ways, to the first and the last line that the windows around it share with an
earlier occurrence: a line of a repeated run starts a window inside the run, or lies in the
one that ends with the run's last line, so the union of the matches of both kinds is the maximal repeated run.
That run is deleted; the first occurrence in the corpus stays.

A fingerprint that a third of the documents holds costs one row per task before the shuffle
(counts and smallest occurrences are partial aggregates) and its join is split by the engine;
no pairs of occurrences are made.

Edge cases: lines are cut at U+000A only; lines without a word are never fingerprints and go
with the run around them. A null text stays null, an empty one empty; a text may lose all its
lines (it becomes empty). Rows with the same doc_id and text are one document and are treated
alike. Null ids come first. Extra columns are kept by ``drop_runs``; empty tables give empty
results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.llm.common import WORD, fresh, materialize, table

MIN_WORDS = 50


def _lines(text: str):
    return F.split(F.col(text), "\n", -1)


def _windows(docs: DataFrame, min_words: int) -> DataFrame:
    """``(doc, th, pos, last, content, more, mark, at)``: every window with its first and last line, two
    hashes of its lines, its winnowed line hash and that line's place."""
    lists = docs.select(F.col("doc_id").alias("doc"), F.xxhash64("text").alias("th"), _lines("text").alias("ls")) \
        .where("ls IS NOT NULL") \
        .select("doc", "th", F.transform("ls", lambda x: F.struct(
            F.xxhash64(x).alias("line"), F.xxhash64(F.lit(1), x).alias("other"), F.regexp_count(x, F.lit(WORD)).alias("words"))).alias("ls")) \
        .groupBy("doc", "th").agg(F.first("ls").alias("ls"))
    rows = lists.select("doc", "th", F.posexplode("ls").alias("pos", "l")) \
        .select("doc", "th", "pos", "l.line", "l.other", F.col("l.words").cast("bigint").alias("words")).where("words > 0")
    doc = Window.partitionBy("doc", "th")
    before = doc.orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("start", F.coalesce(F.sum("words").over(before), F.lit(0))) \
        .withColumn("total", F.sum("words").over(doc)).withColumn("rank", F.row_number().over(doc.orderBy("pos")))
    rows = rows.withColumn("end", F.col("start") + F.col("words"))
    ahead = doc.orderBy("start").rangeBetween(Window.currentRow, min_words - 1)
    back = doc.orderBy("end").rangeBetween(-(min_words - 1), Window.currentRow)
    held = lambda frame: [F.collect_list("line").over(frame).alias("held"), F.collect_list("other").over(frame).alias("others")]
    forward = F.when(F.col("start") + min_words <= F.col("total"), F.struct(
        "pos", F.max("pos").over(ahead).alias("last"), F.col("rank").cast("bigint").alias("rank"), *held(ahead)))
    # left out where the window forward from its first line is the same lines
    backward = F.when((F.col("end") >= min_words) & (F.col("start") - F.min("start").over(back) >= min_words), F.struct(
        F.min("pos").over(back).alias("pos"), F.col("pos").alias("last"), F.min("rank").over(back).cast("bigint").alias("rank"), *held(back)))
    rows = rows.select("doc", "th", forward.alias("f"), backward.alias("b")).select("doc", "th", F.explode(F.array("f", "b")).alias("w"))
    return rows.where("w IS NOT NULL").select("doc", "th", "w.*") \
        .select("doc", "th", "pos", "last", F.xxhash64("held").alias("content"), F.xxhash64(F.lit(2), "others").alias("more"),
                F.array_min("held").alias("mark"), F.expr("rank + array_position(held, array_min(held))").alias("at"))


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``(doc, th, runs)``: for each document with later repeated runs, its sorted, disjoint
    ``runs`` of line numbers ``(s, e)``, both included. ``th`` is the hash of the text."""
    w = materialize(_windows(docs, min_words), "line-windows")
    # a fingerprint is a selected line; windows in a row often select the same one
    prints = w.groupBy("mark").agg(F.min(F.struct("doc", "th", "at")).alias("a"),
                                   F.max(F.struct("doc", "th", "at")).alias("b"))
    shared = prints.where("a <> b OR a.doc IS DISTINCT FROM b.doc").select("mark")
    placed = w.join(shared, "mark", "left_semi")
    first = placed.groupBy("content", "more").agg(F.min(F.struct("doc", "th", "pos")).alias("f"), F.count(F.lit(1)).alias("n")) \
        .where("n > 1").select("content", "more", F.col("f.doc").alias("fd"), F.col("f.th").alias("ft"), F.col("f.pos").alias("fp"))
    later = placed.join(first, ["content", "more"]).where("NOT (doc <=> fd AND th = ft AND pos = fp)")
    doc = Window.partitionBy("doc", "th").orderBy("pos")
    reach = F.max("last").over(doc.rowsBetween(Window.unboundedPreceding, -1))
    runs = later.select("doc", "th", "pos", "last", (F.coalesce(reach, F.lit(-2)) + 1 < F.col("pos")).cast("int").alias("new")) \
        .withColumn("run", F.sum("new").over(doc)) \
        .groupBy("doc", "th", "run").agg(F.min("pos").alias("s"), F.max("last").alias("e")) \
        .groupBy("doc", "th").agg(F.array_sort(F.collect_list(F.struct("s", "e"))).alias("runs"))
    return materialize(runs, "line-runs")


def drop_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with ``text`` without its later repeated runs; every row and column stays."""
    out = _cleaned(docs, min_words)[0]
    return out.select(*docs.columns)


def _cleaned(docs: DataFrame, min_words: int) -> tuple[DataFrame, str]:
    runs = repeated_runs(docs, min_words)
    name = fresh(docs.columns, "_runs")
    d, h = fresh(docs.columns, "_runs_doc"), fresh(docs.columns, "_runs_text")
    r = runs.select(F.col("doc").alias(d), F.col("th").alias(h), F.col("runs").alias(name))
    on = docs["doc_id"].eqNullSafe(F.col(d)) & (F.xxhash64(docs["text"]) == F.col(h))
    # the runs grow with the corpus: a shuffle at every size, never a broadcast
    joined = docs.join(r.hint("merge"), on, "left").drop(d, h)
    ls = _lines("text")
    # the pieces between the runs: after one run's end, up to the next one's start
    starts = F.concat(F.array(F.lit(0)), F.transform(F.col(name), lambda x: x["e"] + 1))
    ends = F.concat(F.transform(F.col(name), lambda x: x["s"]), F.array(F.size(ls)))
    kept = F.flatten(F.zip_with(starts, ends, lambda a, b: F.slice(ls, a + 1, F.greatest(b - a, F.lit(0)))))
    text = F.when(F.col(name).isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    return joined.withColumn("text", text), name


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its cleaned text and the number of lines deleted."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out, runs = _cleaned(docs, MIN_WORDS)
    gone = F.aggregate(F.col(runs), F.lit(0), lambda n, x: n + x["e"] - x["s"] + 1)
    return out.select("doc_id", "text", F.coalesce(gone, F.lit(0)).cast("bigint").alias("n_deleted"))


def sql(view: str = "documents", min_words: int = MIN_WORDS) -> str:
    """The same in DuckDB: window contents as strings; of runs that occur earlier, the lines in any window of either kind."""
    return rf"""
    WITH ls AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos
                FROM {view} WHERE text IS NOT NULL),
    counted AS (SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words FROM ls),
    placed AS (SELECT *, (sum(words) OVER (PARTITION BY doc_id ORDER BY pos))::BIGINT AS stop,
                      (sum(words) OVER (PARTITION BY doc_id))::BIGINT AS total FROM counted WHERE words > 0),
    windows AS (SELECT doc_id, pos, max(pos) OVER w AS last, string_agg(line, chr(10)) OVER w AS content, stop - words + {min_words} <= total AS whole
                FROM placed WINDOW w AS (PARTITION BY doc_id ORDER BY stop - words RANGE BETWEEN CURRENT ROW AND {min_words - 1} FOLLOWING)
                UNION ALL
                SELECT doc_id, min(pos) OVER w AS pos, pos AS last, string_agg(line, chr(10)) OVER w AS content, stop >= {min_words} AS whole
                FROM placed WINDOW w AS (PARTITION BY doc_id ORDER BY stop RANGE BETWEEN {min_words - 1} PRECEDING AND CURRENT ROW)),
    later AS (SELECT * FROM (SELECT *, rank() OVER (PARTITION BY content ORDER BY doc_id, pos) AS k FROM windows WHERE whole) WHERE k > 1),
    gone AS (SELECT DISTINCT ls.doc_id, ls.pos FROM ls JOIN later ON ls.doc_id = later.doc_id AND ls.pos BETWEEN later.pos AND later.last),
    kept AS (SELECT ls.doc_id, string_agg(line, chr(10) ORDER BY ls.pos) FILTER (gone.pos IS NULL) AS text, count(gone.pos) AS n_deleted
             FROM ls LEFT JOIN gone ON ls.doc_id = gone.doc_id AND ls.pos = gone.pos GROUP BY ls.doc_id)
    SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(kept.text, '') END AS text,
           coalesce(kept.n_deleted, 0)::BIGINT AS n_deleted
    FROM {view} d LEFT JOIN kept ON d.doc_id = kept.doc_id
    """
