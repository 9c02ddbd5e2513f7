"""Subword tokens (F2, F3): a merge table learned from the corpus, and encoding with it.

``learn_merges``: the ``(word, n)`` table is counted once, and so are its pairs. Merges are proposed
and proved in rounds. The driver proposes the next ones from the exact counts and from the words it
holds, a bounded number of the most frequent. Every task then makes the proposed merges on its own words, held as one
array of symbols: a merge rewrites only the places of its pair and gives the changes of the pair counts beside
them; nothing else is counted again. The changes of all tasks, summed by step, prove the proposals: as
long as a proposed pair is the most frequent of all, with ties by symbols, it is the next merge; the first one that is not ends the round.
So the merges are those of one at a time, whatever the proposals, and a round makes many.
The driver holds the counts of ``TRACKED`` pairs and of all pairs that merges made: an untracked pair can only
become rarer, and pairs are counted anew where one might be the next.

``encode_subword``: the documents are encoded where they lie, in blocks of rows. Each *distinct* word of a block is encoded once
by the merge ranks -- the rank table is bounded by the merge count and shipped with the function -- and put at its places;
no word is shuffled or joined. The words of a block are merged together in numpy (``Encoder``).

A symbol is its UTF-8 in hexadecimal, whose order is code point order.
"""

from __future__ import annotations

import heapq
import sys
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from corpusmill.functions.text import split_words
from corpusmill.operators.vocab import relabel, shared_keys
from corpusmill.plans import dictionaries
from corpusmill.plans.lineage import PACKED, materialize

#: One character of hexadecimal UTF-8 (also read by the SQL check).
HEX_CHARACTER = "[0-7][0-9A-F]|[C-F][0-9A-F](?:[89AB][0-9A-F])+"
#: Pairs whose counts are held, words that the driver proposes from, merges proposed in a round, and merges
#: after which words are written again.
TRACKED, HELD_WORDS, PROPOSED, WRITE_EVERY = 200_000, 50_000, 64, 256
#: Symbols of the words that a task merges at a time.
LOT_SYMBOLS = 1_000_000
#: Characters up to which words are encoded together; a longer word is encoded by itself.
LONG_WORD = 200


def word_counts(docs: DataFrame) -> DataFrame:
    """``(word, n)`` over whitespace words of ``docs.text``."""
    return docs.select(F.explode(split_words("text")).alias("word")).groupBy("word").agg(
        F.count(F.lit(1)).cast("bigint").alias("n"))


def symbols(word: str):
    """The characters of a word as spaced hexadecimal symbols."""
    return F.regexp_replace(F.hex(F.col(word)), HEX_CHARACTER, " $0 ")


def _text(symbol: str) -> str:
    return bytes.fromhex(symbol).decode("utf-8", "replace")


class Words:
    """Words as one array of symbol numbers, with each place's word and count. A merge finds the places of its
    pair, rewrites those and counts the pairs beside them; no other pair is counted again."""

    def __init__(self, words: list[tuple[str, int]]):
        # split and numbered in Arrow: no Python string per symbol
        own = pc.ascii_split_whitespace(pa.array([w or None for w, _ in words], pa.string()))
        sizes = pc.fill_null(pc.list_value_length(own), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = own.flatten().dictionary_encode()
        self.names: list[str] = flat.dictionary.to_pylist()
        self.number: dict[str, int] = {s: k for k, s in enumerate(self.names)}
        self.x = flat.indices.to_numpy(zero_copy_only=False).astype(np.int32)
        self.word = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
        self.n = np.repeat(np.array([n for _, n in words], dtype=np.int64), sizes)

    def copy(self) -> Words:
        other = Words([])
        other.names, other.number = list(self.names), dict(self.number)
        other.x, other.word, other.n = self.x.copy(), self.word, self.n  # a merge writes x in place, the others anew
        return other

    def _number(self, symbol: str) -> int:
        k = self.number.get(symbol)
        if k is None:
            k = self.number[symbol] = len(self.names)
            self.names.append(symbol)
        return k

    def _places(self, a: str, b: str) -> np.ndarray:
        """Where the pair starts, from the left and without overlap."""
        if a not in self.number or b not in self.number or not len(self.x):
            return np.zeros(0, np.int64)
        at = np.flatnonzero((self.x[:-1] == self.number[a]) & (self.x[1:] == self.number[b]) & (self.word[:-1] == self.word[1:]))
        if a == b and len(at):  # of neighbouring places every second one
            first = np.concatenate(([True], np.diff(at) > 1))
            run = np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - run) % 2 == 0]
        return at

    def total(self, a: str, b: str) -> int:
        return int(self.n[self._places(a, b)].sum())

    def _pairs(self, at: np.ndarray, sign: int, changes: Counter) -> None:
        """Adds the pairs that start at these places."""
        at = np.unique(at[(at >= 0) & (at + 1 < len(self.x))])
        at = at[self.word[at] == self.word[at + 1]]
        code = self.x[at].astype(np.int64) * len(self.names) + self.x[at + 1]
        pairs, where = np.unique(code, return_inverse=True)
        sums = np.zeros(len(pairs), np.int64)
        np.add.at(sums, where, self.n[at])
        for c, n in zip(pairs.tolist(), sums.tolist()):
            changes[self.names[c // len(self.names)], self.names[c % len(self.names)]] += sign * n

    def merge(self, a: str, b: str) -> dict[tuple[str, str], int]:
        """Rewrites the places of the pair; the changes of pair counts."""
        at, changes = self._places(a, b), Counter()
        if not len(at):
            return {}
        self._pairs(np.concatenate((at - 1, at, at + 1)), -1, changes)
        self.x[at] = self._number(a + b)
        keep = np.ones(len(self.x), bool)
        keep[at + 1] = False
        self.x, self.word, self.n = self.x[keep], self.word[keep], self.n[keep]
        at = at - np.arange(len(at))
        self._pairs(np.concatenate((at - 1, at)), 1, changes)
        return {p: c for p, c in changes.items() if c}

    def lines(self) -> list[str]:
        """The words in order, their symbols between spaces."""
        out = [self.names[k] for k in self.x.tolist()]
        ends = np.flatnonzero(np.diff(np.append(self.word, -1))) + 1
        return [" ".join(out[s:e]) for s, e in zip([0, *ends[:-1].tolist()], ends.tolist())] if len(out) else []


class Ranking:
    """The counts of pairs, most frequent first, ties by symbols."""

    def __init__(self, counts: dict[tuple[str, str], int]):
        self.counts = dict(counts)
        self.heap = [(-n, a, b) for (a, b), n in counts.items()]
        heapq.heapify(self.heap)

    def add(self, changes: dict[tuple[str, str], int], merged: str) -> None:
        for pair, change in changes.items():
            if pair in self.counts or merged in pair:  # a new symbol's pairs are new, so their count is whole
                self.counts[pair] = n = self.counts.get(pair, 0) + change
                heapq.heappush(self.heap, (-n, *pair))

    def best(self) -> tuple[str, str, int] | None:
        while self.heap:
            n, a, b = self.heap[0]
            if self.counts.get((a, b), 0) == -n and n < 0:
                return a, b, -n
            heapq.heappop(self.heap)
        return None


    def copy(self) -> Ranking:
        other = Ranking({})
        other.counts, other.heap = dict(self.counts), list(self.heap)
        return other


def _propose(held: Words, ranking: Ranking, known: set[str], floor: int, most: int) -> list[tuple[str, str]]:
    """The next merges by the exact counts, changed as the held words change. ``held`` is used up."""
    guess, counts, symbols = [], ranking.copy(), set(known)
    while len(guess) < most:
        best = counts.best()
        if best is None or best[2] <= floor:
            break
        a, b, n = best
        own = held.total(a, b)
        scale = n / own if own else 1.0
        guess.append((a, b))
        if a + b in symbols:
            break
        symbols.add(a + b)
        changes = {p: round(c * scale) for p, c in held.merge(a, b).items()}
        counts.add({**changes, (a, b): -n}, a + b)
    return guess


_CHANGES, _WORDS = "step int, a string, b string, c bigint", "syms string, n bigint"


def _lots(batches, most: int = LOT_SYMBOLS):
    """Some words at a time: a merge costs a lot of words little more than a few. A lot is bounded by its symbols, so long words
    make it no larger; one word is never cut."""
    held, count = [], 0
    for pdf in batches:
        if not len(pdf):
            continue
        sizes = (pdf["syms"].str.count(" ") + 1).to_numpy()
        at = 0
        while at < len(pdf):
            upto = max(at + 1 if not count else at, at + int(np.searchsorted(np.cumsum(sizes[at:]), most - count, side="right")))
            held.append(pdf.iloc[at:upto])
            count += int(sizes[at:upto].sum())
            at = upto
            if at < len(pdf) or count >= most:
                yield pd.concat(held, ignore_index=True)
                held, count = [], 0
    if held:
        yield pd.concat(held, ignore_index=True)


def _changes(done: list[tuple[str, str]], guess: list[tuple[str, str]]):
    """The change of every pair count by the proposed merges, on the words of a task behind the merges that are done."""
    def run(batches):
        for pdf in _lots(batches):
            index = Words(list(zip(pdf["syms"].tolist(), pdf["n"].tolist())))
            for pair in done:
                index.merge(*pair)
            rows = [(step, *p, c) for step, pair in enumerate(guess) for p, c in index.merge(*pair).items()]
            yield pd.DataFrame(rows, columns=["step", "a", "b", "c"])

    return run


def _rewritten(done: list[tuple[str, str]]):
    def run(batches):
        for pdf in _lots(batches):
            index = Words(list(zip(pdf["syms"].tolist(), pdf["n"].tolist())))
            for pair in done:
                index.merge(*pair)
            yield pd.DataFrame({"syms": index.lines(), "n": pdf["n"].tolist()})

    return run


def _pair_counts(wc: DataFrame) -> tuple[dict[tuple[str, str], int], int]:
    """The most frequent pairs, ``TRACKED`` at most, and the count that no other pair exceeds."""
    arr = F.split("syms", " ")
    pairs = wc.where(F.size(arr) > 1).select(F.explode(F.arrays_zip(
        F.slice(arr, 1, F.size(arr) - 1).alias("a"), F.slice(arr, 2, F.size(arr) - 1).alias("b"))).alias("p"), "n")
    counts = pairs.groupBy(F.col("p.a").alias("a"), F.col("p.b").alias("b")).agg(F.sum("n").alias("c"))
    top = counts.orderBy(F.col("c").desc(), "a", "b").limit(TRACKED + 1).collect()  # bounded by TRACKED
    return {(r["a"], r["b"]): r["c"] for r in top[:TRACKED]}, top[TRACKED]["c"] if len(top) > TRACKED else 0


def _held(wc: DataFrame) -> Words:
    """The most frequent words, ``HELD_WORDS`` at most."""
    return Words([(r["syms"], r["n"]) for r in wc.orderBy(F.col("n").desc(), "syms").limit(HELD_WORDS).collect()])


def _dealt(rows: DataFrame) -> DataFrame:
    slots = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(slots, "syms") if rows.rdd.getNumPartitions() < slots else rows


def learn_merges(docs: DataFrame | None, n_merges: int, cut_every: int = WRITE_EVERY, words: DataFrame | None = None) -> list[tuple[str, str]]:
    """the first ``n_merges`` merges, most frequent adjacent pair first (ties: the
    smallest pair). ``words``: a written ``(word, n)`` table in place of the documents. Words are written again
    after ``cut_every`` merges."""
    source = word_counts(docs) if words is None else words
    rows = source.select(F.trim(F.regexp_replace(symbols("word"), " +", " ")).alias("syms"), "n").where(F.col("syms").contains(" "))
    # many small tasks: a round's work is in Python, so the files are for all slots, however small the table is
    wc = materialize(_dealt(rows), "merge-words")
    merges: list[tuple[str, str]] = []
    done: list[tuple[str, str]] = []  # merges that the written words do not have yet
    ranking, floor, held = None, 0, Words([])
    while len(merges) < int(n_merges):
        if ranking is None:
            if done:
                wc, done = materialize(_dealt(wc).mapInPandas(_rewritten(done), _WORDS), "merge-words"), []
            tracked, floor = _pair_counts(wc)
            ranking, held = Ranking(tracked), _held(wc)
        best = ranking.best()
        if best is None:
            break
        alone = best[2] <= floor  # just counted, with all counts equal: the first pair is the next merge, no more is known
        known = {a + b for a, b in merges}
        most = 1 if alone else min(PROPOSED, int(n_merges) - len(merges))
        guess = _propose(held.copy(), ranking, known, 0 if alone else floor, most)
        by_step: dict[int, dict] = defaultdict(dict)
        for r in wc.mapInPandas(_changes(done, guess), _CHANGES).groupBy("step", "a", "b").agg(F.sum("c").alias("c")).collect():
            by_step[r["step"]][r["a"], r["b"]] = r["c"]  # a step changes the pairs beside one merge: bounded by the symbols
        again = alone
        for step, (a, b) in enumerate(guess):
            best = ranking.best()
            if best is None or best[:2] != (a, b) or best[2] <= floor and not alone:
                break
            merges.append((a, b))
            done.append((a, b))
            held.merge(a, b)
            if a + b in known:  # its pairs may be among those not tracked
                again = True
                break
            known.add(a + b)
            ranking.add(by_step[step], a + b)
        best = ranking.best()
        if again or best is not None and best[2] <= floor:
            ranking = None
        elif len(done) >= int(cut_every):
            wc, done = materialize(_dealt(wc).mapInPandas(_rewritten(done), _WORDS), "merge-words"), []
    return [(_text(a), _text(b)) for a, b in merges]


def merges_table(spark, merges: list[tuple[str, str]]) -> DataFrame:
    return spark.createDataFrame([(r, a, b) for r, (a, b) in enumerate(merges)],
                                 "rank int, left string, right string")


def read_merges(table: DataFrame) -> list[tuple[str, str]]:
    """The merges of a rank table ``(rank, left, right)`` in order (bounded by the merge count)."""
    return [(r["left"], r["right"]) for r in table.select("rank", "left", "right").orderBy("rank").collect()]


def alphabet(docs: DataFrame | None, words: DataFrame | None = None) -> list[str]:
    """The distinct characters of the corpus words in code point order (bounded by the
    character set, not by the data). ``words``: a written ``(word, n)`` table in place of the documents."""
    own = docs.select(F.explode(split_words("text")).alias("word")).distinct() if words is None else words
    return [_text(r["s"]) for r in own.select(F.explode(F.split(F.trim(symbols("word")), "  ")).alias("s")).distinct()
            .orderBy("s").collect()]


def bpe_encode_word(word: str, ranks: dict[tuple[str, str], int]) -> list[str]:
    """Apply merges to one word: the adjacent pair of lowest rank, at all its places from the left, again and again.

    The symbols are a linked list and the pairs a heap by rank and place, so a word of n characters takes
    n log n steps."""
    syms, after, before = list(word), list(range(1, len(word) + 1)), list(range(-1, len(word) - 1))
    end = len(word)
    heap = [(r, i) for i in range(end - 1) if (r := ranks.get((syms[i], syms[i + 1]))) is not None]
    heapq.heapify(heap)
    while heap:
        rank, grown = heap[0][0], []
        while heap and heap[0][0] == rank:
            i = heapq.heappop(heap)[1]
            j = after[i] if syms[i] is not None else end
            if j == end or ranks.get((syms[i], syms[j])) != rank:
                continue  # a symbol of the pair was merged before
            syms[i], syms[j], after[i] = syms[i] + syms[j], None, after[j]
            if after[i] < end:
                before[after[i]] = i
            grown.append(i)
        for i in grown:  # the pairs around the new symbols
            for left in (before[i], i):
                if left >= 0 and syms[left] is not None and after[left] < end:
                    if (r := ranks.get((syms[left], syms[after[left]]))) is not None:
                        heapq.heappush(heap, (r, left))
    return [s for s in syms if s is not None]


class Encoder:
    """``bpe_encode_word`` for many words at a time, as ids (-1 for a symbol without one). Symbols are numbers: a character its code point,
    a longer symbol one behind them. In every step each word's adjacent pair of lowest rank is merged at all its places, until no word has one."""

    FIRST = 0x110000

    def __init__(self, ranks: dict[tuple[str, str], int], ids: dict[str, int]):
        self.ranks, self.ids, number = ranks, ids, {}

        def of(symbol: str) -> int:
            return ord(symbol) if len(symbol) == 1 else number.setdefault(symbol, self.FIRST + len(number))

        pairs = sorted((of(a) << 32 | of(b), r, of(a + b)) for (a, b), r in ranks.items() if a and b)
        self.codes, self.rank, self.merged = (np.array([p[k] for p in pairs], np.int64) for k in range(3))
        self.id = np.full(self.FIRST + len(number), -1, np.int64)
        for symbol, i in ids.items():
            if len(symbol) == 1 or symbol in number:
                self.id[of(symbol)] = i

    def _step(self, x: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The symbols and their words behind one merge in each word, and which of them are in words that had none left."""
        code = x[:-1] << 32 | x[1:]
        at = np.searchsorted(self.codes, code).clip(max=len(self.codes) - 1)
        none = np.iinfo(np.int64).max
        rank = np.append(np.where((self.codes[at] == code) & (word[:-1] == word[1:]), self.rank[at], none), none)
        heads = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
        least = np.repeat(np.minimum.reduceat(rank, heads), np.diff(np.append(heads, len(x))))
        places = np.flatnonzero((rank == least) & (rank < none))
        if len(places):  # of neighbouring places every second one, from the left
            first = np.concatenate(([True], np.diff(places) > 1))
            run = np.maximum.accumulate(np.where(first, np.arange(len(places)), 0))
            places = places[(np.arange(len(places)) - run) % 2 == 0]
        x[places] = self.merged[at[places]]
        keep = np.ones(len(x), bool)
        keep[places + 1] = False
        return x[keep], word[keep], (least == none)[keep]

    def lists(self, words: pa.Array) -> pa.Array:
        own = words.to_pylist()
        sizes = np.fromiter(map(len, own), np.int64, len(own))
        by_itself = np.flatnonzero(sizes > LONG_WORD)
        for k in by_itself.tolist():
            sizes[k], own[k] = 0, ""
        x = np.frombuffer("".join(own).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        word, done = np.repeat(np.arange(len(own)), sizes), []
        while len(x) and len(self.codes):
            x, word, ended = self._step(x, word)
            done.append((x[ended], word[ended]))
            x, word = x[~ended], word[~ended]
        done.append((x, word))
        for k in by_itself.tolist():
            syms = bpe_encode_word(words[k].as_py(), self.ranks)
            done.append((-1 - np.arange(len(syms)), np.full(len(syms), k)))
            own[k] = [self.ids.get(s, -1) for s in syms]
        x, word = (np.concatenate([d[k] for d in done]) for k in (0, 1))
        order = np.argsort(word, kind="stable")
        x, word = x[order], word[order]
        found = self.id[np.maximum(x, 0)]
        for k in by_itself.tolist():
            found[np.searchsorted(word, k):np.searchsorted(word, k, side="right")] = own[k]
        return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(np.bincount(word, minlength=len(own))))).astype(np.int32)), pa.array(found))


def _ranks(merges: DataFrame | list[tuple[str, str]]) -> dict[tuple[str, str], int]:
    return {(a, b): r for r, (a, b) in enumerate(read_merges(merges) if isinstance(merges, DataFrame) else merges)}


def encode_words(words: DataFrame, merges: DataFrame | list[tuple[str, str]], symbol_ids: dict[str, int]) -> DataFrame:
    """``(word, n, sub)`` for ``words (word, n)``: each distinct word's ids, written once for a rank table."""
    ranks, ids = _ranks(merges), dict(symbol_ids)

    @F.arrow_udf(ArrayType(LongType()))
    def enc(own: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = Encoder(ranks, ids)
        for batch in own:
            yield encoder.lists(batch)

    return materialize(words.withColumn("sub", enc(F.col("word"))), "subwords", codec=PACKED)


def _encoded(ranks: dict[tuple[str, str], int], ids: dict[str, int], rows: int, most: int):
    def run(batches):
        encoder = Encoder(ranks, ids)
        for b in dictionaries.lots_of_rows(batches, "words", rows, most):
            lists = b.column("words")
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            own = lists.flatten().dictionary_encode()
            found = encoder.lists(own.dictionary).take(own.indices)
            ends = np.concatenate(([0], np.cumsum(pc.list_value_length(found).to_numpy(zero_copy_only=False).astype(np.int64))))
            offsets = ends[np.concatenate(([0], np.cumsum(sizes)))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), found.flatten())], ["doc_id", "sub"])

    return run


def encode_subword(docs: DataFrame, merges: DataFrame | list[tuple[str, str]], symbol_ids: dict[str, int],
                   eos_id: int | None, encoded: DataFrame | None = None, **limits) -> DataFrame:
    """``(doc_id, n, ids)``: every document's words encoded with the merges (a rank table or
    a list), one end-of-sequence id per document (none if ``eos_id`` is None). The words of rows that share an id are merged,
    by a lookup of the ids of their distinct words: ``encoded``, from ``encode_words``, if these are written already."""
    words, shared = docs.select("doc_id", split_words("text").alias("words")), shared_keys(docs.select("doc_id"), "doc_id")
    own, one = F.struct("doc_id").eqNullSafe(F.col("_key")), words
    if shared is not None:
        one = words.join(shared, own, "left_anti")
    schema = StructType([docs.schema["doc_id"], StructField("sub", ArrayType(LongType()))])
    out = one.mapInArrow(_encoded(_ranks(merges), dict(symbol_ids), dictionaries.BLOCK_ROWS, dictionaries.BLOCK_VALUES), schema)
    if shared is not None:
        twice = docs.join(shared, own, "left_semi")
        distinct = encode_words(word_counts(twice), merges, symbol_ids) if encoded is None else encoded
        own_words = twice.select("doc_id", split_words("text").alias("words"))
        out = out.unionByName(relabel(own_words, "doc_id", "words", distinct, "word", "sub", flat=True, few=sys.maxsize, **limits))
    seq = F.col("sub")
    if eos_id is not None:
        seq = F.concat(seq, F.array(F.lit(eos_id).cast("bigint")))
    out = out.select("doc_id", seq.alias("ids"))
    return out.select("doc_id", F.size("ids").cast("bigint").alias("n"), "ids")


def symbol_table(alpha: list[str], merges: list[tuple[str, str]]) -> dict[str, int]:
    """Ids: alphabet symbols first (given order), then merged symbols by rank."""
    ids = {s: i for i, s in enumerate(alpha)}
    for a, b in merges:
        ids.setdefault(a + b, len(ids))
    return ids


# Python workers need not have this package installed: the BPE helper travels by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
