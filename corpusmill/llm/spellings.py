"""Spelling variants by a variable-length gram index.

Dictionary: grams of ``SHORTEST`` to ``LONGEST`` code points, pruned by frequency. A gram is
extended by the next code point while more than ``limit`` places of the word list hold it, so
common grams give way to longer, rarer ones. The limit rises with the list (``1 / COMMON`` of all
places), which bounds the extended grams by ``COMMON`` of each length: these alone are sent to
the tasks.

Decomposition: the gram that starts at each place of a word. It depends on its own code points
alone (and on the word's end, where that cuts it short), so an edit leaves every gram that ends
before it, at the same distance from the word's start, and every gram that starts behind it, at
the same distance from the end. The others are the grams that an edit at that place can
affect; all others must be shared, which is the bound for merging the gram lists. The
lists are merged before they are shuffled: for each edit place a word goes under one key made
of all grams that are left, so words meet exactly if they are in every one of these lists.

Verification: words under one key are near if the code points around the edit are equal too. As
words that agree everywhere but at one place differ in that code point only, a verified group holds at most
one word for each letter; counts and the best partner come from the group without making pairs.
An inserted code point in a run of equal ones counts at its last place, so no pair is found twice.

Roots follow forms by pointer doubling; each form is at least ``RATIO`` times as frequent as its
word, so chains are short.

Edge cases: null texts have no words; a null doc_id counts as an empty string in the key
that damages words. Words above ``LONG`` code points are sent as digests, so a run of a million
letters costs rows, not copies of itself. Repeated rows count as often as they stand. Extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.common import materialize, ship, table

LEAST_LENGTH, LEAST_COUNT, RATIO, DAMAGE = 7, 2, 10, 31
SHORTEST, LONGEST = 2, 4
#: Grams of one length that may be extended, and places that a gram must have at least for that.
COMMON, FEW = 20_000, 20
#: Code points above which a word travels as a digest, distinct words counted and cells computed at once.
LONG, HELD, CELLS = 64, 100_000, 200_000
_RUN = re.compile(r"[a-zÀ-ÿ]+")
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
SAME, LONGER, SHORTER = range(3)


def runs_of(text: str | None) -> list[str]:
    """The letter runs of a text, A-Z in lower case."""
    return _RUN.findall((text or "").encode("utf-8", "surrogatepass").translate(_LOWER).decode("utf-8", "surrogatepass"))


def _counted(batches):
    """``(word, n)`` of damaged runs, counted by task in bounded steps."""
    held: Counter = Counter()

    def out():
        return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])

    for batch in batches:
        for doc, text in zip(batch["doc"].to_pylist(), batch["text"].to_pylist()):
            key = zlib.crc32(f"{doc or ''}:".encode())
            for run in runs_of(text):
                if len(run) < LEAST_LENGTH:
                    continue
                h = zlib.crc32(run.encode(), key)
                if not h % DAMAGE:
                    at = h % len(run)
                    run = run[:at] + run[at + 1:]
                    if len(run) < LEAST_LENGTH:
                        continue
                held[run] += 1
            if len(held) >= HELD:
                yield out()
                held.clear()
    if held:
        yield out()


def words(docs: DataFrame) -> DataFrame:
    """``(word, n)``: the words of ``docs (doc_id, text)`` that are long and frequent enough, written once."""
    rows = docs.select(F.col("doc_id").cast("string").alias("doc"), "text").mapInArrow(_counted, "word string, n bigint")
    return materialize(rows.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT), "spelling-words")


def _codes(own: list[str]) -> np.ndarray:
    """Words of one length as a matrix of letter numbers from 1, below 2^7."""
    points = np.frombuffer("".join(own).encode("utf-32-le"), np.uint32).reshape(len(own), -1)
    return np.where(points < 128, points - 96, points - 0xC0 + 27).astype(np.uint64)


def _packed(codes: np.ndarray, size: int) -> np.ndarray:
    """The grams of one size at every place, as numbers."""
    count = codes.shape[1] - size + 1
    out = np.zeros((codes.shape[0], max(0, count)), np.uint64)
    for k in range(size):
        out = (out << np.uint64(7)) | codes[:, k:k + count] if count > 0 else out
    return out


def _by_length(own: list[str]):
    """Positions of words of equal length, in bounded lots."""
    groups: dict[int, list[int]] = {}
    for k, w in enumerate(own):
        groups.setdefault(len(w), []).append(k)
    for length, at in groups.items():
        step = max(1, CELLS // length)
        for k in range(0, len(at), step):
            yield at[k:k + step]


def _gram_counts(batches):
    """``(size, gram, n)`` by task: the places of every gram that may be extended."""
    sums = {size: np.zeros(1 << 7 * size, np.int64) for size in range(SHORTEST, LONGEST)}
    for batch in batches:
        own = batch["word"].to_pylist()
        for at in _by_length(own):
            codes = _codes([own[k] for k in at])
            for size, total in sums.items():
                grams, n = np.unique(_packed(codes, size), return_counts=True)
                total[grams.astype(np.int64)] += n
    for size, total in sums.items():
        grams = np.flatnonzero(total)
        if len(grams):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(grams), size, np.int64)), pa.array(grams), pa.array(total[grams])],
                                             names=["size", "gram", "n"])


class Grams:
    """The dictionary: which grams are extended. At most ``COMMON`` of each size."""

    def __init__(self, extended: dict[int, list[int]]):
        self.extended = {size: np.zeros(1 << 7 * size, bool) for size in range(SHORTEST, LONGEST)}
        for size, grams in extended.items():
            self.extended[size][grams] = True

    def decompose(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The gram at every place of words of one length, as numbers, and where each ends; a gram that the word's
        end cuts short ends behind the word."""
        rows, length = codes.shape
        count = max(0, length - SHORTEST + 1)
        gram, end = _packed(codes, SHORTEST), np.tile(np.arange(count, dtype=np.int64) + SHORTEST, (rows, 1))
        grows = np.ones((rows, count), bool)
        for size in range(SHORTEST, LONGEST):
            here = np.zeros_like(grows)
            own = _packed(codes, size)
            here[:, :own.shape[1]] = self.extended[size][own.astype(np.int64)]
            grows &= here
            longer = _packed(codes, size + 1)
            fits = longer.shape[1]
            end[:, fits:][grows[:, fits:]] = length + 1
            gram[:, :fits] = np.where(grows[:, :fits], longer, gram[:, :fits])
            end[:, :fits] += grows[:, :fits]
            grows[:, fits:] = False
        return gram, end


def grams_of(own: DataFrame) -> Grams:
    """The dictionary of a word list."""
    counts = materialize(own.select("word").mapInArrow(_gram_counts, "size bigint, gram bigint, n bigint")
                         .groupBy("size", "gram").agg(F.sum("n").alias("n")), "spelling-grams")
    places = {r["size"]: r["n"] for r in counts.groupBy("size").agg(F.sum("n").alias("n")).collect()}
    extended = {}
    for size, total in places.items():  # at most COMMON grams have more than total / COMMON places
        limit = max(FEW, total // COMMON)
        extended[size] = [r["gram"] for r in counts.where((F.col("size") == size) & (F.col("n") > limit)).select("gram").collect()]
    return Grams(extended)


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (a ^ (b * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(32)
    x = (x + b) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(29))


def keys_of(codes: np.ndarray, grams: Grams) -> dict[int, np.ndarray]:
    """By kind, a matrix of keys (word, edit place): ``SAME`` for a replaced code point, ``LONGER`` for
    one deleted from the word, ``SHORTER`` for one inserted into it."""
    rows, length = codes.shape
    gram, end = grams.decompose(codes)
    at = np.arange(gram.shape[1], dtype=np.uint64)
    whole = np.arange(rows)
    # sums of what ends at or before a place, and of what starts at or behind it
    before, behind = np.zeros((rows, length + 2), np.uint64), np.zeros((rows, length + 1), np.uint64)
    from_start = _mix(gram, np.broadcast_to(at + np.uint64(1), gram.shape))
    from_end = _mix(gram + np.uint64(1 << 40), np.broadcast_to(np.uint64(length) - at, gram.shape))
    for p in range(gram.shape[1]):
        before[whole, end[:, p]] += from_start[:, p]
    before = np.cumsum(before, axis=1, dtype=np.uint64)
    behind[:, :gram.shape[1]] = np.cumsum(from_end[:, ::-1], axis=1, dtype=np.uint64)[:, ::-1]
    place = np.arange(length + 1, dtype=np.uint64)

    def key(left, right, longest, kind):
        salt = _mix(np.full(left.shape[1], 2 * longest + kind, np.uint64), place[:left.shape[1]] + np.uint64(1))
        return _mix(_mix(left, right), np.broadcast_to(salt, left.shape))

    return {SAME: key(before[:, :length], behind[:, 1:], length, 0), LONGER: key(before[:, :length], behind[:, 1:], length, 1),
            SHORTER: key(before[:, :length + 1], behind, length + 1, 1)}


def label_of(word: str) -> str:
    """A word as it travels: itself, or a digest of a long one."""
    return word if len(word) <= LONG else "#" + hashlib.md5(word.encode()).hexdigest()


def _rests(codes: np.ndarray) -> tuple[list, list]:
    """Of one long word: digests of what is left without the code point at each place, and of the whole."""
    out, whole = [], []
    for base in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93):
        up = np.cumprod(np.concatenate(([np.uint64(1)], np.full(len(codes), base, np.uint64))))
        left = np.concatenate(([np.uint64(0)], np.cumsum(codes * up[:-1])))  # of the first k code points
        # the code points behind move forward by one place
        back = np.uint64(pow(base, -1, 2**64))
        out.append(left[:-1] + (left[-1] - left[1:]) * back)
        whole.append(int(left[-1]))
    return [f"#{a:016x}{b:016x}" for a, b in zip(*(x.tolist() for x in out))], f"#{whole[0]:016x}{whole[1]:016x}"


_ENTRY = "key bigint, kind int, at int, word string, rest string, n bigint"


def _entries(sent):
    """The keys of every word, with what the verification needs."""
    def run(batches):
        grams = sent.value
        for batch in batches:
            every, counts = batch["word"].to_pylist(), batch["n"].to_numpy()
            for lot in _by_length(every):
                own, n = [every[k] for k in lot], counts[lot]
                codes = _codes(own)
                length, labels = codes.shape[1], pa.array([label_of(w) for w in own], pa.string())
                for kind, keys in keys_of(codes, grams).items():
                    use = np.ones(keys.shape, bool)
                    if kind == LONGER:  # in a run of equal code points only the last place
                        use[:, :-1] = codes[:, 1:] != codes[:, :-1]
                    row, at = np.nonzero(use)
                    if length + (kind == SHORTER) <= LONG:  # both words of a pair are short
                        rest = pa.nulls(len(row), pa.string())
                    else:
                        rests = [_rests(c) for c in codes]
                        rest = pa.array([rests[r][1] if kind == SHORTER else rests[r][0][a] for r, a in zip(row.tolist(), at.tolist())], pa.string())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys[use].view(np.int64)), pa.array(np.full(len(row), kind, np.int32)), pa.array(at.astype(np.int32)),
                         labels.take(pa.array(row)), rest, pa.array(n[row])], names=[c.split()[0] for c in _ENTRY.split(", ")])

    return run


def near_words(own: DataFrame) -> DataFrame:
    """``(word, n_near, best_n, best)``: for every word of ``own (word, n)`` with a word at edit distance one, how many it
    has, and the most frequent (ties: smallest). Long words are digests."""
    sent = own.sparkSession.sparkContext.broadcast(grams_of(own))  # at most COMMON grams of each size
    entries = own.select("word", "n").mapInArrow(_entries(sent), _ENTRY).repartition(F.col("key"))
    cut = F.concat(F.expr("substring(word, 1, at)"), F.expr("substring(word, at + 2)"))
    rest = F.coalesce("rest", F.when(F.col("kind") == SHORTER, F.col("word")).otherwise(cut))
    # one word for each letter at most, and the shorter one
    groups = entries.select("key", rest.alias("rest"), F.struct((-F.col("n")).alias("neg"), "word", "kind").alias("x")) \
        .groupBy("key", "rest").agg(F.collect_list("x").alias("xs")).where(F.size("xs") > 1).select(F.array_sort("xs").alias("xs"))
    first, second = F.get("xs", 0), F.get("xs", 1)
    members = groups.select("xs", F.get(F.filter("xs", lambda x: x["kind"] == SHORTER), 0).alias("short"), F.explode("xs").alias("x"))
    kind, others = F.col("x.kind"), (F.size("xs") - 1).cast("bigint")
    best = F.when(kind == LONGER, F.col("short")).when(first["word"] == F.col("x.word"), second).otherwise(first)
    found = members.where((kind == SAME) | F.col("short").isNotNull()) \
        .select(F.col("x.word").alias("word"), F.when(kind == LONGER, F.lit(1).cast("bigint")).otherwise(others).alias("c"),
                F.struct(best["neg"].alias("neg"), best["word"].alias("word")).alias("best"))
    return found.groupBy("word").agg(F.sum("c").alias("n_near"), F.min("best").alias("b")) \
        .select("word", "n_near", (-F.col("b.neg")).alias("best_n"), F.col("b.word").alias("best"))


def variants(docs: DataFrame) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` for the words of ``docs (doc_id, text)``."""
    own = words(docs)
    label = F.when(F.length("word") <= LONG, F.col("word")).otherwise(F.concat(F.lit("#"), F.md5("word")))
    near = materialize(near_words(own), "spelling-near")
    named = own.select("word", "n", label.alias("label"))
    far = named.join(near.withColumnRenamed("word", "label").hint("merge"), "label", "left")
    is_form = F.col("best_n") >= RATIO * F.col("n")
    table_ = materialize(far.select("label", "word", "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"),
                                    F.when(is_form, F.col("best")).alias("form"), F.when(is_form, F.col("best_n")).alias("form_n")), "spelling-forms")
    up = table_.where("form IS NOT NULL").select("label", F.col("form").alias("root"))
    while True:  # every round follows twice as many forms
        up = materialize(up, "spelling-roots")
        step = up.select(F.col("label").alias("root"), F.col("root").alias("_next"))
        moved = up.join(step.hint("merge"), "root", "left")
        if moved.where("_next IS NOT NULL").isEmpty():
            break
        up = moved.select("label", F.coalesce("_next", "root").alias("root"))
    out = table_.join(up.hint("merge"), "label", "left").withColumn("root", F.coalesce("root", "label"))
    back = lambda c: out.select(c).where(F.col(c).startswith("#")).distinct() \
        .join(named.select(F.col("label").alias(c), F.col("word").alias(f"{c}_word")), c)
    for c in ("form", "root"):  # digests back to their long words
        out = out.join(materialize(back(c), f"spelling-long-{c}"), c, "left").withColumn(c, F.coalesce(f"{c}_word", c)).drop(f"{c}_word")
    return out.select("word", "form", "root", "n", "n_near", "form_n")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents").select("doc_id", "text"))


ship(__name__)
