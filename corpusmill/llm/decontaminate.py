"""Benchmark decontamination by SimHash of item-sized windows.

Words are runs of letters and digits, lower-cased; shingles are five words (an item with
fewer words is one shingle). For every item length, windows of that many words slide over a
document (one with fewer words is itself the one window). A window can reach the similarity only if
so many of its shingles stand in items of that length that the sum of minima can: nine shared ones for
each four of both sides together. This is counted exactly, so it loses nothing, and
all other windows are left out.

Each window left has a SimHash of ``BITS`` = 288 bits, looked up by multi-index Hamming blocks: twelve
blocks of 24 bits. Two fingerprints within 59 bits have, by the pigeonhole principle, a
block with at most 4 errors: the values within 4 bits of the window's block value, 12,951 of 2^24, are
looked up among those of the items (or those of the items looked at, where they are fewer), so a window costs
no more for any larger number of items, and 0.9 % of random items become candidates. Items of few shingles, whose distances vary more, allow 5 or 6 errors
(71 or 83 bits). At a similarity of just 0.8 the distance is 42 bits on average with a deviation of 6: 99.4 % or more of such
windows are found for every number of shingles (measured), and more above. Candidates within the radius are
verified by their exact weighted-shingle similarity (weights are counts: sum of minima over sum of
maxima), 0.8 or more.

The items are a query set: they go to the tasks in blocks of ``ITEM_WORDS`` words, one block
in memory at a time, each against all documents; there is no shuffle. A word counts once for each eight of
its characters.

Edge cases: null or empty texts and items match nothing; items that repeat are separate
items; of windows of one item with equal similarity the first counts; rows are judged one by one, so repeated rows, null ids and extra columns change
nothing. Texts are read whole. Empty tables give empty results.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.common import fresh, materialize, ship, table

SHINGLE, SIMILARITY = 5, 0.8
BLOCKS, WIDTH = 12, 24
BITS = BLOCKS * WIDTH
#: Errors that a block may have, by the least number of shingles of an item: distances of small sets vary more.
ERRORS = ((20, 4), (7, 5), (0, 6))
#: Windows whose shingles are held at once.
STRIP = 20_000
#: Words of benchmark items that a task holds at once.
ITEM_WORDS = 2_000_000
_WORD = re.compile(r"[^\W_]+")
_STEP = [pow(0x9E3779B97F4A7C15, k, 2**64) for k in range(SHINGLE)]


def errors_of(shingles: int) -> int:
    return next(e for least, e in ERRORS if shingles >= least)


def radius_of(shingles: int) -> int:
    """The distance that is found without a miss: beyond it every block may have an error more than is looked up."""
    return BLOCKS * (errors_of(shingles) + 1) - 1


@cache
def _ball(errors: int) -> np.ndarray:
    """The numbers of ``WIDTH`` bits with so many ones at most."""
    out = np.zeros(1, np.uint32)
    top = np.full(1, -1)
    parts = [out]
    for _ in range(errors):  # one bit more, above all others
        grown = [(out[top < k] | np.uint32(1 << k), k) for k in range(WIDTH)]
        out, top = np.concatenate([g for g, _ in grown]), np.concatenate([np.full(len(g), k) for g, k in grown])
        parts.append(out)
    return np.concatenate(parts)


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def _hashes(words: list[str], size: int) -> list[bytes]:
    return [hashlib.blake2b(" ".join(words[k:k + size]).encode("utf-8", "surrogatepass"), digest_size=BITS // 8).digest()
            for k in range(len(words) - size + 1)]


def _votes(hashes: list[bytes]) -> np.ndarray:
    """The votes of every shingle, (n, BITS). A shingle weighs one and a bit, by its hash, so that ties are rare and
    settled alike by similar sets, and no bit is rarer than its opposite."""
    digests = np.frombuffer(b"".join(hashes), np.uint8).reshape(-1, BITS // 8)
    weight = 1024 + digests[:, :1].astype(np.int32)
    return (np.unpackbits(digests, axis=1).astype(np.int32) * 2 - 1) * weight


def _pack(sums: np.ndarray) -> np.ndarray:
    """Bit sums (n, BITS) to fingerprints as bytes (n, BITS / 8)."""
    return np.packbits(sums > 0, axis=1)


def fingerprint(hashes: list[bytes]) -> np.ndarray:
    """The SimHash of some shingles, as bytes."""
    return _pack(_votes(hashes).sum(axis=0, keepdims=True))[0]


def _block_values(prints: np.ndarray) -> np.ndarray:
    """Fingerprints as block values (n, BLOCKS)."""
    parts = prints.reshape(len(prints), BLOCKS, WIDTH // 8).astype(np.uint32)
    return (parts[:, :, 0] << np.uint32(16)) | (parts[:, :, 1] << np.uint32(8)) | parts[:, :, 2]


def least_shared(own: int, other: int) -> int:
    """Shingles that two sets of these sizes share at least if they are similar enough: s / (own + other - s) >= 0.8."""
    return -(-4 * (own + other) // 9)


class Items:
    """The index of one block of items ``[(item_id, text)]``."""

    def __init__(self, items: list[tuple]):
        tokens = [(i, w) for i, t in items if (w := words_of(t))]
        self.vocab: dict[str, int] = {}
        for _, w in tokens:
            for x in w:
                self.vocab.setdefault(x, len(self.vocab) + 1)
        self.ids = [i for i, _ in tokens]
        self.shingles = [Counter(_hashes(w, min(SHINGLE, len(w)))) for _, w in tokens]
        #: by shingle size: the codes of all item shingles, and the lengths of the items that have each
        holders: dict[int, dict[int, set[int]]] = defaultdict(lambda: defaultdict(set))
        groups = defaultdict(list)
        for k, (_, w) in enumerate(tokens):
            groups[len(w)].append(k)
            size = min(SHINGLE, len(w))
            for c in self._codes(np.array([self.vocab[x] for x in w], np.uint64), size).tolist():
                holders[size][c].add(len(w))
        self.codes = {s: np.array(sorted(h), np.uint64) for s, h in holders.items()}
        self.lengths = {s: [sorted(h[c]) for c in sorted(h)] for s, h in holders.items()}
        #: by item length: item numbers, fingerprints, and by block the items that have each value
        self.groups, self.values = {}, {}
        #: by block, one bit for every value that some item has
        self.seen = np.zeros((BLOCKS, 1 << WIDTH - 3), np.uint8)
        for n, members in groups.items():
            size = min(SHINGLE, n)
            prints = np.stack([fingerprint(_hashes(tokens[k][1], size)) for k in members])
            values = _block_values(prints)
            posted = [defaultdict(list) for _ in range(BLOCKS)]
            for b in range(BLOCKS):
                np.bitwise_or.at(self.seen[b], values[:, b] >> np.uint32(3), np.uint8(1) << (values[:, b] & np.uint32(7)).astype(np.uint8))
                for k, v in enumerate(values[:, b].tolist()):
                    posted[b][v].append(k)
            self.groups[n] = (np.array(members), prints, [dict(p) for p in posted])
            self.values[n] = [np.array(list(p), np.uint32) for p in posted]

    def near(self, n: int, window: np.ndarray) -> list[int]:
        """The items of ``n`` words within the radius of a fingerprint, by their number."""
        members, prints, posted = self.groups[n]
        shingles = n - min(SHINGLE, n) + 1
        ball, found = _ball(errors_of(shingles)), set()
        for b, value in enumerate(_block_values(window[None])[0]):
            if len(posted[b]) <= len(ball):  # fewer values than the ball holds: each is looked at instead
                own = self.values[n][b]
                held = own[np.bitwise_count(own ^ value) <= errors_of(shingles)]
                for v in held.tolist():
                    found.update(posted[b][v])
                continue
            near = ball ^ value
            held = near[(self.seen[b][near >> np.uint32(3)] >> (near & np.uint32(7)).astype(np.uint8)) & np.uint8(1) > 0]
            for v in held.tolist():
                found.update(posted[b].get(v, ()))
        k = np.array(sorted(found), dtype=np.int64)
        far = np.bitwise_count(prints[k] ^ window).sum(axis=1)
        return members[k[far <= radius_of(shingles)]].tolist()

    @staticmethod
    def _codes(ids: np.ndarray, size: int) -> np.ndarray:
        """A rolling code of ``size`` word numbers at each place."""
        n = max(0, len(ids) - size + 1)
        out = np.zeros(n, np.uint64)
        for k in range(size):
            out += ids[k:k + n] * np.uint64(_STEP[k])
        return out

    def _starts(self, words: list[str]) -> dict[int, np.ndarray]:
        """By item length, the starts of all windows with enough shingles of such items."""
        get = self.vocab.get
        ids = np.array([get(w, 0) for w in words], np.uint64)
        known = np.concatenate(([0], np.cumsum(ids > 0)))
        places = defaultdict(list)
        for size, codes in self.codes.items():
            if len(ids) < size:
                continue
            at = np.flatnonzero(known[size:] - known[:-size] == size)  # all words known
            if not len(at):
                continue
            own = self._codes(ids, size)[at]
            place = np.minimum(np.searchsorted(codes, own), len(codes) - 1)
            hit = codes[place] == own
            for p, c in zip(at[hit].tolist(), place[hit].tolist()):
                for n in self.lengths[size][c]:
                    places[n].append(p)
        out = {}
        for n, held in places.items():
            size, at = min(SHINGLE, n), np.array(held, dtype=np.int64)
            per = min(n, len(words)) - size + 1  # a shorter document is one window
            need = least_shared(per, n - size + 1)
            if need > per or need > len(at):
                continue
            low, high = at[:len(at) - need + 1], at[need - 1:]  # so many places in a row
            close = high - low < per
            mark = np.zeros(len(words) + 2, np.int64)
            np.add.at(mark, np.maximum(high[close] - per + 1, 0), 1)
            np.add.at(mark, np.minimum(low[close], len(words) - size + 1 - per) + 1, -1)
            starts = np.flatnonzero(np.cumsum(mark) > 0)
            if len(starts):
                out[n] = starts
        return out

    def leaks(self, text: str | None) -> list[tuple]:
        """``(item_id, similarity, start word, words)`` of the best window of each leaked item."""
        words = words_of(text)
        best: dict[int, tuple] = {}
        for n, starts in (self._starts(words) if words else {}).items():
            size, of = min(SHINGLE, n), n
            n = min(n, len(words))
            lo, per = int(starts[0]), n - size + 1
            # runs of starts that lie close share one strip of shingles
            far = np.flatnonzero(np.diff(starts) > n) + 1
            for strip in (x[k:k + STRIP] for x in np.split(starts, far) for k in range(0, len(x), STRIP)):
                lo = int(strip[0])
                hashes = _hashes(words[lo:int(strip[-1]) + n], size)
                sums = np.concatenate((np.zeros((1, BITS), np.int32), np.cumsum(_votes(hashes), axis=0)))
                windows = _pack(sums[strip - lo + per] - sums[strip - lo])
                distinct, first = np.unique(windows, axis=0, return_inverse=True)
                near = [self.near(of, w) for w in distinct]
                for x, y in ((x, y) for x, d in enumerate(first.ravel().tolist()) for y in near[d]):
                    s = int(strip[x]) - lo
                    got, want = Counter(hashes[s:s + per]), self.shingles[y]
                    sim = sum((got & want).values()) / sum((got | want).values())
                    if sim >= SIMILARITY and (y not in best or (-sim, s + lo) < best[y][:2]):
                        best[y] = (-sim, s + lo, n)
        return [(self.ids[y], -b[0], b[1], b[2]) for y, b in sorted(best.items())]


def _blocks(items: DataFrame, block_words: int):
    """The items, block by block; one block is in memory at a time."""
    sized = materialize(items.select("item_id", "text").where("text IS NOT NULL")
                        .withColumn("n", F.greatest(F.regexp_count("text", F.lit(r"(?U)\p{Alnum}+")), F.length("text") / 8).cast("bigint") + 1), "benchmark-items")
    total = sized.agg(F.sum("n")).first()[0] or 0
    count = max(1, -(-total // block_words))
    for b in range(count):
        rows = sized.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == b).collect()
        if rows:
            yield Items(sorted(((r["item_id"], r["text"]) for r in rows), key=lambda x: (x[0] is None, x[0] or 0, x[1])))


def leaks_of(index, text: str = "text") -> Column:
    @F.pandas_udf("array<struct<item_id: bigint, similarity: double, start: bigint, words: bigint>>")
    def udf(texts: pd.Series) -> pd.Series:
        own = index.value
        return pd.Series([own.leaks(t) for t in texts])

    return udf(F.col(text))


def leaks(docs: DataFrame, items: DataFrame, block_words: int = ITEM_WORDS) -> DataFrame:
    """``(doc_id, item_id, similarity, start, words)``: the best window of every leaked item
    in every row of ``docs``."""
    spark, out = docs.sparkSession, None
    schema = "doc_id bigint, item_id bigint, similarity double, start bigint, words bigint"
    for index in _blocks(items, block_words):
        sent = spark.sparkContext.broadcast(index)  # bounded by block_words
        found = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.inline(leaks_of(sent)))
        found = materialize(found, "leaks")
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], schema) if out is None else out


def drop_leaky(docs: DataFrame, items: DataFrame, block_words: int = ITEM_WORDS) -> DataFrame:
    """The rows of ``docs`` without a leak, all columns as they are."""
    name, spark = fresh(docs.columns, "_leaks"), docs.sparkSession
    for index in _blocks(items, block_words):
        sent = spark.sparkContext.broadcast(index)
        docs = docs.withColumn(name, leaks_of(sent)).where(F.size(name) == 0).drop(name)
    return docs


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ship(__name__)
