"""Substring dedup by recompression: repeated runs of words go, the first occurrence stays.

A document is its sequence of words, each named by a hash. A round of recompression names
maximal runs of one symbol and then pairs: a coin drawn from the name marks a symbol as left
or right, and every left symbol followed by a right one becomes one new symbol, named from
the two. Names come from content alone, so equal substrings get equal symbols in their interior
wherever they stand; only symbols at their ends can differ. With every symbol goes the span of words that forces it: an
equal span elsewhere holds the same symbol at the same place.

Spark rounds meet the names of the whole corpus, each an aggregate by name that returns
places to their documents:

1. Interior symbols of some words each. A symbol that occurs once proves every window of
   ``width`` words around its span unique; the other windows are open. Documents
   without an open window are done.
2. High-level symbols (up to ``2 * LONG`` words) of the documents with a long stretch of open windows, each with
   the symbols that the windows starting in it reach into. Such a block that occurs earlier proves all these
   windows repeated: copies are settled a symbol at a time.
3. The windows left, each under its own 128-bit name: those of blocks that occur for the first
   time, and all open ones of documents without blocks. The earliest occurrence of any window is among
   them, so what is not the first of its name is a repeat.

A word covered by a repeated window goes. Names that decide are 128 bits (two independent
64-bit names); those of the first step may collide without harm, as this only leaves a window
to the later steps. Every aggregate is partial, so a passage that a third of the documents
share is one row per task; nothing is joined by name, so no name is a hot key. No step makes
pairs of occurrences.

Edge cases: a null text has no words; documents below ``width`` words lose nothing. Rows with
the same doc_id and text are one document and are treated alike; rows with the same doc_id
and other texts are documents in the order of a hash of the text. Null ids come first. Very
long texts are read whole. Extra columns are kept by ``drop_repeats``; an empty table gives
an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.common import fresh, materialize, ship, table
from corpusmill.plans.ordering import global_rank

WIDTH = 20
#: Words up to which a symbol still joins a pair, and rounds, for interior and for high-level symbols;
#: words that an interior symbol needs to be counted (smaller ones are rarely unique).
SHORT, SHORT_ROUNDS, SHORT_LEAST = 3, 6, 3
LONG, LONG_ROUNDS = 32, 16
#: Bytes of text that a task holds as arrays at once, but for a longer document.
GROUP_BYTES = 400_000
_FAR = 1 << 40
_BASE = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))


def words_of(text: str | None) -> list[bytes]:
    """Words between U+0020 and U+0009-U+000D."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def _mix(a: np.ndarray, b) -> np.ndarray:
    """A name from two."""
    b = np.atleast_1d(b)  # whole arrays wrap around without a warning
    x = (a ^ (b * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(32)
    x = (x + b) * np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(29)
    x = (x ^ b) * np.uint64(0x9FB21C651E98DF25)
    return x ^ (x >> np.uint64(32))


class Symbols:
    """The symbols of some documents laid end to end: names, word range ``[start, end)``, and the
    span ``[lo, hi)`` of words that forces each. ``first`` and ``last`` mark document ends."""

    def __init__(self, words: np.ndarray, sizes: np.ndarray):
        n = len(words)
        self.words, self.name = words, words
        self.start = np.arange(n, dtype=np.int64)
        self.end = self.start + 1
        self.lo, self.hi = self.start.copy(), self.end.copy()
        ends = np.cumsum(sizes)
        self.first, self.last = np.zeros(n, bool), np.zeros(n, bool)
        self.first[(ends - sizes)[sizes > 0]] = True
        self.last[ends[sizes > 0] - 1] = True

    def name_runs(self, level: int) -> None:
        """Maximal runs of one symbol become one symbol."""
        head = np.concatenate(([True], (self.name[1:] != self.name[:-1]) | self.first[1:]))
        a = np.flatnonzero(head)
        z = np.append(a[1:], len(head)) - 1
        often = (z - a + 1).astype(np.uint64)
        name = np.where(often > 1, _mix(self.name[a], often * np.uint64(2 * level + 1)), self.name[a])
        start, end, w = self.start[a], self.end[z], self.words
        # a run ends where the next symbol differs: seen by one word if its nearest word does
        before, after = np.maximum(a - 1, 0), np.minimum(z + 1, len(head) - 1)
        lo = np.where(self.first[a], -_FAR, np.where(w[np.maximum(start - 1, 0)] != w[self.end[a] - 1], start - 1, self.lo[before]))
        hi = np.where(self.last[z], _FAR, np.where(w[np.minimum(end, len(w) - 1)] != w[self.start[z]], end + 1, self.hi[after]))
        self.lo = np.minimum(np.minimum.reduceat(self.lo, a), lo)
        self.hi = np.maximum(np.maximum.reduceat(self.hi, a), hi)
        self.name, self.start, self.end, self.first, self.last = name, start, end, self.first[a], self.last[z]

    def name_pairs(self, level: int, longest: int) -> None:
        """Left symbols and the right ones that follow become one; symbols above ``longest`` words rest."""
        short = self.end - self.start <= longest
        coin = (_mix(self.name, np.uint64(7919 * level + 1)) >> np.uint64(63)).astype(bool)
        left, right = short & ~coin, short & coin
        joins = np.append(left[:-1] & right[1:] & ~self.last[:-1], False)
        taken = np.concatenate(([False], joins[:-1]))
        after, before = np.minimum(np.arange(1, len(joins) + 1), len(joins) - 1), np.maximum(np.arange(len(joins)) - 1, 0)
        # a left symbol stays alone because of the one after it, a right one because of the one before
        hi = np.where(left & ~joins, np.where(self.last, _FAR, np.maximum(self.hi, self.hi[after])), self.hi)
        lo = np.where(right & ~taken, np.where(self.first, -_FAR, np.minimum(self.lo, self.lo[before])), self.lo)
        hi = np.where(joins, np.maximum(self.hi, self.hi[after]), hi)
        lo = np.where(joins, np.minimum(self.lo, self.lo[after]), lo)
        name = np.where(joins, _mix(self.name, self.name[after] + np.uint64(level)), self.name)
        end, last = np.where(joins, self.end[after], self.end), np.where(joins, self.last[after], self.last)
        stay = ~taken
        self.name, self.start, self.end, self.lo, self.hi = name[stay], self.start[stay], end[stay], lo[stay], hi[stay]
        self.first, self.last = self.first[stay], last[stay]

    def compress(self, rounds: int, longest: int) -> Symbols:
        for level in range(1, rounds + 1) if len(self.words) else ():
            self.name_runs(level)
            self.name_pairs(level, longest)
        return self


def _powers(base: np.uint64, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The first powers of ``base`` and of its inverse."""
    of = lambda x: np.cumprod(np.concatenate(([np.uint64(1)], np.full(count, x, np.uint64))))
    return of(base), of(np.uint64(pow(int(base), -1, 2**64)))


class _Namer:
    """Names of byte strings and of ranges of names: the family ``k`` of two independent ones."""

    def __init__(self, k: int):
        self.base, self.values = _BASE[k], np.random.default_rng(k).integers(1, 2**63, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1)
        self.powers = _powers(self.base, 1 << 16)

    def ranges(self, values: np.ndarray, a: np.ndarray, z: np.ndarray) -> np.ndarray:
        """Names of the ranges ``[a, z)`` of ``values``, from prefix sums."""
        if len(values) >= len(self.powers[0]):
            self.powers = _powers(self.base, 2 * len(values))
        up, back = self.powers
        prefix = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * up[:len(values)], out=prefix[1:])
        return _mix((prefix[z] - prefix[a]) * back[a], (z - a).astype(np.uint64))

    def windows(self, words: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
        h = np.zeros(len(starts), np.uint64)
        for k in range(width):
            h = h * self.base + words[starts + k]
        return _mix(h, np.uint64(width))


_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


class _Group:
    """Some documents laid end to end: numbers, texts, the bytes of their words, sizes and offsets in
    words, and per document the arrays of other columns."""

    def __init__(self, rows: list[tuple], raw: list[bytes]):
        self.num = np.array([r[0] for r in rows], dtype=np.int64)
        self.more = [r[2:] for r in rows]
        self.bytes = np.frombuffer(b"\n".join([*raw, b""]), np.uint8)
        edge = np.diff(np.concatenate(([1], _SPACE[self.bytes].astype(np.int8))))
        self.begin, self.end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        until = np.searchsorted(self.begin, np.cumsum([len(r) + 1 for r in raw]))
        self.offs = np.concatenate(([0], until[:-1]))
        self.sizes, self.total = until - self.offs, len(self.begin)

    def name(self, namer: _Namer) -> np.ndarray:
        return namer.ranges(namer.values[self.bytes], self.begin, self.end)

    def document(self, at: np.ndarray) -> np.ndarray:
        """The document of each place (empty ones share an offset with the next, which has the word)."""
        return np.searchsorted(self.offs, at, side="right") - 1

    def places(self, column: int) -> np.ndarray:
        """A column of places within documents as places in the group."""
        held = [x + o for x, o in zip((m[column] for m in self.more), self.offs) if len(x)]
        return np.concatenate(held) if held else np.zeros(0, np.int64)

    def mask(self, column: int) -> np.ndarray:
        """The starts that a column of ranges ``s, e, s, e ...`` holds."""
        edge = self.places(column)
        return _between(edge[::2], edge[1::2], self.total)

    def packed(self, at: np.ndarray, b: int) -> np.ndarray:
        doc = self.document(at)
        return (self.num[doc] << b) | (at - self.offs[doc])


def _between(starts: np.ndarray, ends: np.ndarray, size: int) -> np.ndarray:
    """Which places lie in a range ``[s, e)``."""
    mark = np.zeros(size + 1, np.int64)
    np.add.at(mark, starts, 1)
    np.add.at(mark, ends, -1)
    return np.cumsum(mark)[:-1] > 0


def _lists(column) -> list[np.ndarray]:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    ends, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    return [values[s:e] if known else values[:0] for s, e, known in zip(ends[:-1], ends[1:], column.is_valid().to_pylist())]


def _groups(batch: pa.RecordBatch, *lists: str):
    """The rows of a batch in groups of about ``GROUP_BYTES`` bytes of text."""
    rows, raw, count = [], [], 0
    for row in zip(batch["num"].to_pylist(), batch["text"].to_pylist(), *(_lists(batch[c]) for c in lists)):
        rows.append(row)
        raw.append((row[1] or "").encode("utf-8", "surrogatepass"))
        count += len(raw[-1])
        if count >= GROUP_BYTES:
            yield _Group(rows, raw)
            rows, raw, count = [], [], 0
    if rows:
        yield _Group(rows, raw)


def _signed(names: np.ndarray) -> np.ndarray:
    return names.view(np.int64)


def _bits(most: int) -> int:
    return max(1, int(most).bit_length())


def _interior(b: int, width: int):
    """Rows ``(name, at)`` of interior symbols; ``at`` packs number, span start and span length."""
    w = _bits(width)

    def run(batches):
        names = _Namer(0)
        for batch in batches:
            for g in _groups(batch):
                s = Symbols(g.name(names), g.sizes).compress(SHORT_ROUNDS, SHORT)
                held = (s.hi - s.lo <= width) & (s.end - s.start >= SHORT_LEAST)
                lo, length = s.lo[held], (s.hi - s.lo)[held]
                yield pa.RecordBatch.from_arrays([pa.array(_signed(s.name[held])), pa.array((g.packed(lo, b) << w) | length)],
                                                 names=["name", "at"])

    return run


def _open_starts(width: int):
    """``open``: ranges ``[s, e)`` of window starts that no unique span rules out, flat; the
    ``longest`` of them and the ``count`` of starts."""
    w = _bits(width)

    @F.pandas_udf("open array<bigint>, longest bigint, count bigint")
    def udf(n: pd.Series, spans: pd.Series) -> pd.DataFrame:
        out = []
        for size, own in zip(n, spans):
            count = size - width + 1
            if count <= 0:
                out.append([])
                continue
            if own is None or not len(own):
                out.append([0, count])
                continue
            own = np.asarray(own, dtype=np.int64)
            lo = own >> w
            hi = lo + (own & ((1 << w) - 1))
            mark = np.zeros(count + 1, np.int64)
            np.add.at(mark, np.clip(hi - width, 0, count), 1)
            np.add.at(mark, np.clip(lo + 1, 0, count), -1)
            out.append(_ranges(np.cumsum(mark)[:count] == 0))
        sizes = [[e - s for s, e in zip(o[::2], o[1::2])] for o in out]
        return pd.DataFrame({"open": out, "longest": [max(x, default=0) for x in sizes], "count": list(map(sum, sizes))})

    return udf


def _ranges(mask: np.ndarray) -> list[int]:
    """The runs of true places as a flat list ``s, e, s, e ...``, e exclusive."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], mask.astype(np.int8), [0]))))
    return edge.tolist()


def _cut(width: int):
    """The words of a text that its open windows cover, as ``piece``; ``cover`` has their ranges in the text, ``open`` the
    starts of open windows within the piece."""
    def cut(texts: pd.Series, opened: pd.Series) -> pd.DataFrame:
        rows = []
        for text, ranges in zip(texts, opened):
            words, cover, own, piece, shift = words_of(text), [], [], [], 0
            for s, e in zip(ranges[::2].tolist(), ranges[1::2].tolist()):
                if not cover or s > cover[-1]:
                    shift = s - len(piece)
                    cover += [s, s]
                piece += words[cover[-1]:e + width - 1]
                cover[-1] = e + width - 1
                own += [s - shift, e - shift]
            rows.append((b" ".join(piece).decode("utf-8", "surrogatepass"), cover, own))
        return pd.DataFrame(rows, columns=["piece", "cover", "open"])

    return F.pandas_udf(cut, "piece string, cover array<bigint>, open array<bigint>")


_CANDIDATE = "num bigint, cover array<bigint>, open array<bigint>, start array<bigint>, end array<bigint>, one array<bigint>, two array<bigint>"


def _columns(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _list(values: np.ndarray, ends: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values))


def _blocks(width: int):
    """The high-level symbols in which an open window starts. The names of such a block are made
    from those of the symbol and of the symbols that its windows reach into."""
    def run(batches):
        namers = _Namer(0), _Namer(1)
        for batch in batches:
            for g in _groups(batch, "open", "cover"):
                words = [g.name(n) for n in namers]
                # no symbol reaches from one covered range into the next
                sizes = np.concatenate([m[1][1::2] - m[1][::2] for m in g.more])
                s, until = Symbols(words[0], sizes).compress(LONG_ROUNDS, LONG), np.cumsum(sizes)
                behind = until[np.searchsorted(until, s.start, side="right")]
                reach = np.searchsorted(s.start, np.minimum(s.end + width - 1, behind))
                held = np.concatenate(([0], np.cumsum(g.mask(0))))
                k = np.flatnonzero(held[s.end] > held[s.start])
                names = [n.ranges(n.ranges(w, s.start, s.end), k, reach[k]) for n, w in zip(namers, words)]
                doc = g.document(s.start[k])
                ends, off = np.searchsorted(doc, np.arange(len(g.num) + 1)), g.offs[doc]
                opened, cover = (pa.array([m[c] for m in g.more], pa.list_(pa.int64())) for c in (0, 1))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(g.num), cover, opened, _list(s.start[k] - off, ends), _list(s.end[k] - off, ends),
                     *(_list(_signed(n), ends) for n in names)], names=_columns(_CANDIDATE))

    return run


def _settle(opened: pd.Series, start: pd.Series, end: pd.Series, firsts: pd.Series) -> pd.DataFrame:
    """Open starts in blocks that occur earlier, and those in first blocks, as ranges."""
    copied, tested, count = [], [], []
    for o, s, e, f in zip(opened, start, end, firsts):
        size = int(o[-1])
        mask = _between(o[::2], o[1::2], size)
        new = np.isin(s, f) if f is not None else np.zeros(len(s), bool)
        first = _between(np.minimum(s[new], size), np.minimum(e[new], size), size)
        copied.append(_ranges(mask & ~first))
        tested.append(_ranges(mask & first))
        count.append(int((mask & first).sum()))
    return pd.DataFrame({"copied": copied, "tested": tested, "count": count})


def _windows(b: int, width: int):
    def run(batches):
        namers = _Namer(0), _Namer(1)
        for batch in batches:
            for g in _groups(batch, "tested"):
                starts = np.flatnonzero(g.mask(0))
                if len(starts):
                    names = [_signed(n.windows(g.name(n), starts, width)) for n in namers]
                    yield pa.RecordBatch.from_arrays([*map(pa.array, names), pa.array(g.packed(starts, b))], names=["one", "two", "at"])

    return run


def _spans(width: int):
    """The word ranges of a text that go, flat, and their number of words."""
    def spans(cover: pd.Series, copied: pd.Series, tested: pd.Series, firsts: pd.Series) -> pd.DataFrame:
        rows = []
        for c, old, new, first in zip(cover, copied, tested, firsts):
            size = int((c[1::2] - c[::2]).sum())
            again = _between(new[::2], new[1::2], size)
            if first is not None:
                again[first] = False
            at = np.flatnonzero(again | _between(old[::2], old[1::2], size))
            gone = np.flatnonzero(_between(at, at + width, size))
            # places in the piece to places in the text
            ends = np.cumsum(c[1::2] - c[::2])
            part = np.searchsorted(ends, gone, side="right")
            gone = gone + (c[1::2] - ends)[part]
            cut = np.flatnonzero(np.diff(gone) != 1)
            rows.append((len(gone), np.stack((gone[np.concatenate(([0], cut + 1))], gone[np.append(cut, len(gone) - 1)] + 1), axis=1).ravel()))
        return pd.DataFrame(rows, columns=["n_removed", "spans"])

    return F.pandas_udf(spans, "n_removed bigint, spans array<bigint>")


def _kept(texts: pd.Series, spans: pd.Series) -> pd.Series:
    """The words outside of the spans, joined by a space."""
    out = []
    for text, own in zip(texts, spans):
        words, kept, at = words_of(text), [], 0
        for s, e in zip(own[::2].tolist(), own[1::2].tolist()):
            kept += words[at:s]
            at = e
        out.append(b" ".join(kept + words[at:]).decode("utf-8", "surrogatepass"))
    return pd.Series(out, dtype=object)


def digests(text: str = "text") -> Column:
    """A struct ``(n_words, sha)``: the number of words, and SHA-256 of the words joined by one space."""
    @F.pandas_udf("n_words bigint, sha string")
    def udf(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:  # one text's words in memory at a time
            own = words_of(t)
            rows.append((len(own), hashlib.sha256(b" ".join(own)).hexdigest()))
        return pd.DataFrame(rows, columns=["n_words", "sha"])

    return udf(F.col(text))


def _by_document(firsts: DataFrame, b: int) -> DataFrame:
    """Places ``at`` (number and start packed) as ``(num, at array)``."""
    return firsts.groupBy(F.shiftright("at", b).alias("num")).agg(F.collect_list(F.col("at").bitwiseAND((1 << b) - 1)).alias("at"))


def _earliest(rows: DataFrame) -> DataFrame:
    """The earliest place of every 128-bit name."""
    return rows.groupBy("one", "two").agg(F.min("at").alias("at")).select("at")


def repeats(docs: DataFrame, sizes: DataFrame, width: int = WIDTH) -> DataFrame:
    """``(doc_id, th, n_removed, kept, spans)`` of every document that loses words; ``spans`` are the
    word ranges ``s, e, s, e ...`` that go. ``sizes (doc_id, th, n_words)`` is a written table with a row for every row of
    ``docs``; ``th`` is the hash of the text."""
    keys = sizes.where(F.col("n_words") >= width)
    r = sizes.where("n_words > 0").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("doc_id").alias("ids"), F.min("doc_id").alias("lo"),
                 F.max("doc_id").alias("hi"), F.max("n_words").alias("most")).first()
    b, w = _bits(r["most"] or 0), _bits(width)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("th"), "text")
    if r["rows"] == r["ids"] and (r["lo"] is None or r["lo"] >= 0 and _bits(r["hi"]) + b + w <= 62):
        numbered = keys.withColumn("num", F.col("doc_id"))
        texts = rows.select(F.col("doc_id").alias("num"), "text").where("text IS NOT NULL AND num IS NOT NULL")
    else:  # ids that repeat, are missing or too large: documents are numbered in their order
        one = keys.groupBy("doc_id", "th").agg(F.first("n_words").alias("n_words")) \
            .withColumn("_null", F.col("doc_id").isNotNull().cast("int")).withColumn("_id", F.coalesce("doc_id", F.lit(0)))
        numbered = materialize(global_rank(materialize(one, "substring-ids"), ["_null", "_id", "th"], out="num"), "substring-numbers")
        named = numbered.select(F.col("doc_id").alias("_doc"), F.col("th").alias("_th"), "num")
        texts = rows.join(named.hint("merge"), rows["doc_id"].eqNullSafe(F.col("_doc")) & (rows["th"] == F.col("_th"))) \
            .select("num", "text").dropDuplicates(["num"])
        texts = materialize(texts, "substring-texts")
    symbols = texts.mapInArrow(_interior(b, width), "name bigint, at bigint")
    single = symbols.groupBy("name").agg(F.min("at").alias("at"), F.count(F.lit(1)).alias("n")).where("n = 1").select("at")
    spans = _by_document(single, b + w)
    sized = numbered.select("num", F.col("n_words").alias("n"))
    opened = sized.join(spans.hint("merge"), "num", "left").select("num", _open_starts(width)("n", "at").alias("m")) \
        .select("num", "m.open", "m.longest", "m.count").where(F.size("open") > 0)
    # the texts and what is known of them meet by shuffle at every size, never by broadcast
    found = materialize(texts.join(opened.hint("merge"), "num").select("num", _cut(width)("text", "open").alias("m"), "longest", "count")
                        .select("num", "m.*", "longest", "count"), "substring-open")
    # a copied passage of some length is one long range; a document without one is tested window by window
    long_ = F.col("longest") >= 2 * LONG
    pieces = found.where(long_).select("num", F.col("piece").alias("text"), "cover", "open")
    candidates = materialize(pieces.mapInArrow(_blocks(width), _CANDIDATE), "substring-candidates")
    named = candidates.select("num", F.explode(F.arrays_zip("one", "two", "start")).alias("x")) \
        .select("x.one", "x.two", (F.shiftleft("num", b) + F.col("x.start")).alias("at"))
    settled = F.pandas_udf(_settle, "copied array<bigint>, tested array<bigint>, count bigint")
    split = candidates.join(_by_document(_earliest(named), b).hint("merge"), "num", "left") \
        .select("num", "cover", settled("open", "start", "end", "at").alias("m")).select("num", "cover", "m.*")
    split = materialize(split, "substring-blocks")
    direct = found.where(~long_).select("num", "cover", F.array().cast("array<bigint>").alias("copied"), F.col("open").alias("tested"), "count")
    tested = found.where(~long_).select("num", F.col("piece").alias("text"), F.col("open").alias("tested")) \
        .unionByName(pieces.select("num", "text").join(split.where("count > 0").select("num", "tested").hint("merge"), "num"))
    windows = _by_document(_earliest(tested.mapInArrow(_windows(b, width), "one bigint, two bigint, at bigint")), b)
    # where every tested window is the first and none is copied, no word goes
    lost = split.unionByName(direct).join(windows.hint("merge"), "num", "left").where("size(copied) > 0 OR coalesce(size(at), 0) < count") \
        .select("num", _spans(width)("cover", "copied", "tested", "at").alias("m")).select("num", "m.*")
    kept = F.pandas_udf(_kept, "string")
    gone = texts.join(materialize(lost, "substring-spans").hint("merge"), "num").select("num", "n_removed", kept("text", "spans").alias("kept"), "spans")
    key = numbered.select("num", "doc_id", "th")
    return key.join(gone.hint("merge"), "num").select("doc_id", "th", "n_removed", "kept", "spans")


def _sizes(docs: DataFrame) -> DataFrame:
    return materialize(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("th"), digests().alias("d"))
                       .select("doc_id", "th", "d.*"), "substring-sizes")


def drop_repeats(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """``docs`` with the kept words, joined by one space, as ``text`` where words go; every row and
    column stays."""
    gone = materialize(repeats(docs, _sizes(docs), width), "substring-repeats")
    d, h, k = (fresh(docs.columns, c) for c in ("_gone_doc", "_gone_text", "_gone_kept"))
    g = gone.select(F.col("doc_id").alias(d), F.col("th").alias(h), F.col("kept").alias(k))
    same = docs["doc_id"].cast("bigint").eqNullSafe(F.col(d)) & (F.xxhash64(docs["text"]) == F.col(h))
    return docs.join(g.hint("merge"), same, "left").withColumn("text", F.coalesce(F.col(k), F.col("text"))).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document the words, the words removed, and the digest of those kept."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    sizes = _sizes(docs)
    gone = repeats(docs, sizes).select(F.col("doc_id").alias("_doc"), F.col("th").alias("_th"), "n_removed",
                                       F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
    same = sizes["doc_id"].eqNullSafe(F.col("_doc")) & (sizes["th"] == F.col("_th"))
    return sizes.join(gone.hint("merge"), same, "left").select(
        "doc_id", "n_words", F.coalesce("n_removed", F.lit(0).cast("bigint")).alias("n_removed"),
        F.coalesce("kept_sha256", "sha").alias("kept_sha256"))


def sql(view: str = "documents", width: int = WIDTH) -> str:
    """The same in DuckDB: every window as a string, ranked by place."""
    return rf"""
    WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM {view}),
    starts AS (SELECT doc_id, unnest(range(1, len(w) - {width} + 2)) AS s FROM d),
    windows AS (SELECT starts.doc_id, s, array_to_string(list_slice(w, s, s + {width} - 1), ' ') AS content
                FROM starts JOIN d ON starts.doc_id = d.doc_id),
    again AS (SELECT doc_id, s FROM (SELECT *, row_number() OVER (PARTITION BY content ORDER BY doc_id, s) AS k FROM windows) WHERE k > 1),
    gone AS (SELECT doc_id, list(DISTINCT p) AS ps FROM (SELECT doc_id, unnest(range(s, s + {width})) AS p FROM again) GROUP BY doc_id),
    words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
    cut AS (SELECT words.doc_id, string_agg(word, ' ' ORDER BY p) FILTER (NOT list_contains(ps, p)) AS kept, max(len(ps)) AS n
            FROM words JOIN gone ON words.doc_id = gone.doc_id GROUP BY words.doc_id)
    SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(cut.n, 0)::BIGINT AS n_removed,
           sha256(CASE WHEN cut.n IS NULL THEN array_to_string(w, ' ') ELSE coalesce(cut.kept, '') END) AS kept_sha256
    FROM d LEFT JOIN cut ON d.doc_id = cut.doc_id
    """


ship(__name__)
