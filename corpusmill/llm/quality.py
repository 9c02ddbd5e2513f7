"""Quality rules by repetition coverage.

A text's words are numbered, and windows of ``n`` words get a rolling 64-bit hash, for
several ``n``. A window is duplicated when the text holds its hash twice. The measure for
``n`` is the share of word characters that lie inside any duplicated window (each character
counted once); for lines, the share inside lines that equal an earlier line. A duplicated
window of ``n`` words starts with a duplicated one of ``n - 1``, so each length looks only
at the windows the previous length left: one sort over the text, then few rows.

Edge cases: a null or empty text has no words, fails the base rule and is not kept. Blank
lines count nowhere. Rows are judged one by one, so repeated rows, ties, null ids and extra
columns change nothing; an empty table gives an empty result. A text of any length is
measured whole.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.common import ship, table

#: Words in a window -> the largest share (percent) of word characters in duplicated windows.
COVERAGE_PCT = {5: 20, 6: 19, 7: 18, 8: 17, 9: 16, 10: 15}
#: The largest share (percent) of word characters in lines equal to an earlier line.
DUP_LINE_PCT = 20
MIN_WORDS = 10
REPEAT_WORDS_PCT = 20
SYMBOLS = b"#*$%&|<>"

SCHEMA = ("n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
          "dup_line_chars bigint, covered array<bigint>")

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(SYMBOLS)] = True
_MIX, _STEP = np.uint64(0x9E3779B97F4A7C15), 0xD6E8FEB86659FD93


def _word_spans(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end byte of every word of a UTF-8 buffer."""
    edge = np.diff(np.concatenate(([0], (~_SPACE[buf]).view(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _covered(starts: np.ndarray, n: int, total: int) -> np.ndarray:
    """Mask of the words inside the windows of ``n`` words at ``starts``."""
    step = np.zeros(total + 1, dtype=np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + n, -1)
    return np.cumsum(step[:-1]) > 0


def measure(text: str | None, lengths: tuple[int, ...] = tuple(COVERAGE_PCT)) -> tuple:
    """The columns of ``SCHEMA`` for one text; ``covered`` follows ``lengths``."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    total = len(words)
    if not total:
        return 0, 0, int(_SYMBOL[np.frombuffer(raw, np.uint8)].sum()), 0, 0, 0, [0] * len(lengths)
    buf = np.frombuffer(raw, np.uint8)
    starts, ends = _word_spans(buf)
    points = np.concatenate(([0], np.cumsum((buf & 0xC0) != 0x80)))
    chars = points[ends] - points[starts]
    seen: set[bytes] = set()
    dup_lines = dup_chars = 0
    for line in raw.split(b"\n"):
        if line.strip():
            if line in seen:
                dup_lines += 1
                dup_chars += sum(len(w.decode("utf-8", "surrogatepass")) for w in line.split())
            seen.add(line)
    number: dict[bytes, int] = {}
    put = number.setdefault
    ids = np.array([put(w, len(number)) for w in words], dtype=np.uint64)
    ids = (ids + np.uint64(1)) * _MIX
    ids ^= ids >> np.uint64(29)
    ids *= _MIX
    ids ^= ids >> np.uint64(32)
    at, hashes, size, power = np.arange(total), np.zeros(total, np.uint64), 0, 1
    repeat_words, covered = 0, {}
    for n in sorted({5, *lengths}):
        at, hashes = at[at <= total - n], hashes[at <= total - n]
        while size < n and len(at):
            hashes = hashes + ids[at + size] * np.uint64(power)
            size, power = size + 1, power * _STEP % 2**64
        if len(at) < 2:
            break
        order = np.argsort(hashes, kind="stable")
        same = hashes[order][1:] == hashes[order][:-1]
        twice = np.zeros(len(at), dtype=bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        at, hashes = at[twice], hashes[twice]
        if not len(at):
            break
        mask = _covered(at, n, total)
        covered[n] = int(chars[mask].sum())
        if n == 5:
            repeat_words = int(mask.sum())
    return (total, int(chars.sum()), int(_SYMBOL[buf].sum()), dup_lines, repeat_words, dup_chars,
            [covered.get(n, 0) for n in lengths])


def repetition(text: str = "text") -> Column:
    """A struct column of ``SCHEMA`` for the whole text (an Arrow UDF, no shuffle)."""
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    @F.pandas_udf(SCHEMA)
    def udf(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([measure(t) for t in texts], columns=names)

    return udf(F.col(text))


def base_failed(m: str) -> Column:
    return (F.col(f"{m}.n_words") < MIN_WORDS) | \
        (100 * F.col(f"{m}.n_repeat_words") > REPEAT_WORDS_PCT * F.col(f"{m}.n_words"))


def verdict(m: str) -> Column:
    """Kept: the base rule holds and no repetition coverage is above its limit."""
    chars = F.col(f"{m}.word_chars")
    ok = ~base_failed(m) & (100 * F.col(f"{m}.dup_line_chars") <= DUP_LINE_PCT * chars)
    for k, pct in enumerate(COVERAGE_PCT.values()):
        ok = ok & (100 * F.col(f"{m}.covered")[k] <= pct * chars)
    return ok


def quality_rules(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    kept, dup_line_chars, covered)`` for every row of ``docs (doc_id, text)``."""
    m = docs.select("doc_id", repetition().alias("m"))
    return m.select("doc_id", "m.n_words", "m.word_chars", "m.n_symbols", "m.n_dup_lines", "m.n_repeat_words",
                    base_failed("m").alias("base_failed"), verdict("m").alias("kept"), "m.dup_line_chars", "m.covered")


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, all columns as they are."""
    from corpusmill.llm.common import fresh

    m = fresh(docs.columns, "_quality")
    return docs.withColumn(m, repetition()).where(verdict(m)).drop(m)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                      "base_failed", "kept", "dup_line_chars",
                      *[F.col("covered")[k].alias(f"covered_{n}") for k, n in enumerate(COVERAGE_PCT)])


def sql(view: str = "documents") -> str:
    """The same result in DuckDB: windows as strings, counted per document."""
    grams = ",\n".join(
        f"""g{n} AS (SELECT doc_id, pos, CASE WHEN c > 1 AND full_window THEN 1 ELSE 0 END AS dup FROM (
             SELECT *, count(*) OVER (PARTITION BY doc_id, gram, full_window) AS c FROM (
               SELECT doc_id, pos, string_agg(word, ' ') OVER w AS gram, count(*) OVER w = {n} AS full_window
               FROM words WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND {n - 1} FOLLOWING)))),
        k{n} AS (SELECT doc_id, sum(CASE WHEN m = 1 THEN length(word) ELSE 0 END) AS chars, sum(m) AS n FROM (
             SELECT g{n}.doc_id, words.word, max(dup) OVER (PARTITION BY g{n}.doc_id ORDER BY g{n}.pos
                    ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS m
             FROM g{n} JOIN words ON words.doc_id = g{n}.doc_id AND words.pos = g{n}.pos) GROUP BY doc_id)"""
        for n in COVERAGE_PCT)
    cover = ", ".join(f"coalesce(k{n}.chars, 0)::BIGINT AS covered_{n}" for n in COVERAGE_PCT)
    rules = " AND ".join(f"100 * covered_{n} <= {p} * word_chars" for n, p in COVERAGE_PCT.items())
    joins = " ".join(f"LEFT JOIN k{n} ON k{n}.doc_id = d.doc_id" for n in COVERAGE_PCT)
    return rf"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM {view}),
    lists AS (SELECT doc_id, regexp_extract_all(text, '{WORD_SQL}') AS ws FROM d),
    words AS (SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS pos FROM lists),
    counts AS (SELECT doc_id, len(ws)::BIGINT AS n_words,
                      coalesce(list_sum(list_transform(ws, lambda w: length(w))), 0)::BIGINT AS word_chars FROM lists),
    lines AS (SELECT doc_id, line, length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g')) AS chars FROM (
                SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '{WORD_SQL}')),
    dups AS (SELECT doc_id, sum(n - 1)::BIGINT AS n_dup_lines, sum((n - 1) * chars)::BIGINT AS dup_line_chars FROM (
               SELECT doc_id, line, any_value(chars) AS chars, count(*) AS n FROM lines GROUP BY doc_id, line) GROUP BY doc_id),
    {grams},
    m AS (SELECT d.doc_id, n_words, word_chars,
                 length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
                 coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(k5.n, 0)::BIGINT AS n_repeat_words,
                 coalesce(dup_line_chars, 0)::BIGINT AS dup_line_chars, {cover}
          FROM d JOIN counts ON counts.doc_id = d.doc_id LEFT JOIN dups ON dups.doc_id = d.doc_id {joins}),
    f AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEAT_WORDS_PCT} * n_words AS base_failed FROM m)
    SELECT *, NOT base_failed AND 100 * dup_line_chars <= {DUP_LINE_PCT} * word_chars AND {rules} AS kept FROM f
    """


WORD_SQL = r"[^\x20\x09-\x0D]+"

ship(__name__)
