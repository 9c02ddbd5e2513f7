"""SimHash near-duplicates by Golay-code fuzzy hashing.

A fingerprint has 64 bits; two texts are linked at ``max_bits`` = 2 or fewer differing bits.
The fingerprint is cut into three segments of 22, 21 and 21 bits. The perfect Golay code
(23, 12, 7) puts every segment (zero-padded to 23 bits) within 3 bits of one codeword; the
keys of a segment are the 12-bit indices of all codewords within 4 bits: one key, or six when
it lies 3 bits off. Segments at most 1 bit apart always share a key. Two differing bits leave,
by the pigeonhole principle, a segment ``a`` without error whose next segment (cyclically)
has at most one. So the keys "segment a exactly, plus one Golay index of the next" for the
three ``a`` lose no link: at most 18 keys of 34 bits for each distinct fingerprint.

Fingerprints that share a key are joined and verified bit by bit. Keys with more than
``HOT`` fingerprints are not paired up: their fingerprints emit the 65 points within one bit,
and those that share a point are within 2 bits of each other, and any two within 2 bits
share a point. A star to the point's smallest fingerprint keeps exactly the same components
with rows in proportion to the fingerprints. Copies collapse to one fingerprint first.

Edge cases: a null text counts as empty; texts without a word have fingerprint zero and link
like any other. Repeated rows share a fingerprint and a component; a null doc_id never is
a component's id unless no other exists. Extra columns are ignored by the operator and kept
by ``keep_one``. Empty tables give empty results. Texts of any length are hashed whole.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.common import fresh, materialize, ship, table
from corpusmill.llm.graph import components

SHINGLE, MAX_BITS, SEED = 3, 2, 42
#: Above so many fingerprints under one key, links come from shared points instead of pairs.
HOT = 32
SEGMENTS = ((0, 22), (22, 21), (43, 21))
# Fixed value: generator polynomial of the binary Golay code (23, 12, 7), x^11+x^10+x^6+x^5+x^4+x^2+1.
_GENERATOR = 0b110001110101
_CHUNK = 65_536


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """The SimHash of a text's word shingles as a signed 64-bit number."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    joined, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    span = min(size, len(words))
    first, last = starts[:len(words) - span + 1].tolist(), ends[span - 1:].tolist()
    votes, digest = np.zeros(64, dtype=np.int64), xxhash.xxh64_digest
    for k in range(0, len(first), _CHUNK):
        raw = b"".join([digest(joined[a:b], SEED) for a, b in zip(first[k:k + _CHUNK], last[k:k + _CHUNK])])
        votes += np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(first)).view(">i8")[0])


def fingerprint_of(text: str = "text") -> Column:
    @F.pandas_udf("bigint")
    def udf(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t) for t in texts], dtype="int64")

    return udf(F.col(text))


@cache
def _golay() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By syndrome: the error pattern of at most 3 bits; the codewords of weight 7 over each
    pattern of 3 bits (else -1). And the syndrome of every byte at each of three places."""
    def rest(v: int) -> int:
        for bit in range(22, 10, -1):
            if v >> bit & 1:
                v ^= _GENERATOR << (bit - 11)
        return v

    unit = [rest(1 << b) for b in range(23)]
    error = np.zeros(2048, dtype=np.int64)
    for a in range(23):
        error[unit[a]] = 1 << a
        for b in range(a):
            error[unit[a] ^ unit[b]] = 1 << a | 1 << b
            for c in range(b):
                error[unit[a] ^ unit[b] ^ unit[c]] = 1 << a | 1 << b | 1 << c
    words = [m << 11 ^ rest(m << 11) for m in range(4096)]
    over: dict[int, list[int]] = {}
    for w in words:
        if w.bit_count() == 7:
            on = [b for b in range(23) if w >> b & 1]
            for i in range(7):
                for j in range(i):
                    for k in range(j):
                        over.setdefault(unit[on[i]] ^ unit[on[j]] ^ unit[on[k]], []).append(w)
    near = np.full((2048, 5), -1, dtype=np.int64)
    for s, ws in over.items():
        near[s] = ws
    part = np.array([[rest(v << shift & 0x7FFFFF) for v in range(256)] for shift in (0, 8, 16)], dtype=np.int64)
    return error, near, part


def golay_keys(segment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(row, index)``: the indices of the codewords within 4 bits of each 23-bit segment."""
    error, near, part = _golay()
    syndrome = part[0][segment & 255] ^ part[1][segment >> 8 & 255] ^ part[2][segment >> 16]
    word = segment ^ error[syndrome]
    row, k = np.nonzero(near[syndrome] >= 0)
    more = word[row] ^ near[syndrome][row, k]
    return np.concatenate((np.arange(len(segment)), row)), np.concatenate((word, more)) >> 11


def link_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(row, key)`` for signed 64-bit fingerprints."""
    bits = fps.astype(np.int64).view(np.uint64)
    segments = [(bits >> np.uint64(at) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]
    rows, keys = [], []
    for a in range(3):
        row, index = golay_keys(segments[(a + 1) % 3])
        rows.append(row)
        keys.append(a << 34 | segments[a][row] << 12 | index)
    return np.concatenate(rows), np.concatenate(keys)


def _emit_keys(batches):
    for b in batches:
        fps = b["fp"].to_numpy(np.int64)
        row, key = link_keys(fps)
        yield pd.DataFrame({"key": key, "fp": fps[row]})


def _emit_points(batches):
    flips = np.concatenate(([np.uint64(0)], np.uint64(1) << np.arange(64, dtype=np.uint64)))
    for b in batches:
        for k in range(0, len(b), 4096):
            fps = b["fp"].to_numpy(np.int64)[k:k + 4096]
            points = (fps.view(np.uint64)[:, None] ^ flips[None, :]).view(np.int64)
            yield pd.DataFrame({"point": points.ravel(), "fp": np.repeat(fps, len(flips))})


def links(fps: DataFrame, hot: int = HOT) -> DataFrame:
    """Edges ``(u, v)`` between distinct fingerprints ``fps (fp)`` whose components are those
    of all pairs at 2 or fewer differing bits; every edge is such a pair."""
    keys = materialize(fps.select("fp").mapInPandas(_emit_keys, "key bigint, fp bigint"), "simhash-keys")
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = materialize(keys.join(shared, "key"), "simhash-shared")
    cold = shared.where(F.col("n") <= hot)
    a, b = cold.select("key", F.col("fp").alias("u")), cold.select("key", F.col("fp").alias("v"))
    near = F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= MAX_BITS
    pairs = a.join(b, (a["key"] == b["key"]) & (F.col("u") < F.col("v")) & near).select("u", "v")
    points = shared.where(F.col("n") > hot).select("fp").distinct() \
        .mapInPandas(_emit_points, "point bigint, fp bigint")
    hubs = points.groupBy("point").agg(F.min("fp").alias("u"), F.count(F.lit(1)).alias("n")).where("n > 1")
    stars = points.join(hubs, "point").where("fp <> u").select("u", F.col("fp").alias("v"))
    return pairs.unionByName(stars).distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``(doc_id, fp, component_id, root)`` for every row of ``docs (doc_id, text)``; ``root`` is
    the smallest fingerprint of the component."""
    prints = materialize(docs.select("doc_id", fingerprint_of().alias("fp")), "simhash-prints")
    # distinct fingerprints with their smallest doc_id; copies meet in a partial aggregate
    classes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("low")), "simhash-classes")
    roots = materialize(components(links(classes)).select(F.col("node").alias("fp"), "root"), "simhash-roots")
    linked = classes.join(roots, "fp")
    low = linked.groupBy("root").agg(F.min("low").alias("component_id"))
    one = classes.join(roots.select("fp"), "fp", "left_anti").select("fp", F.col("low").alias("component_id"), F.col("fp").alias("root"))
    ids = materialize(linked.join(low, "root").select("fp", "component_id", "root").unionByName(one), "simhash-ids")
    return prints.join(ids, "fp").select("doc_id", "fp", "component_id", "root")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the smallest of their component, all columns as
    they are; of rows that repeat a doc_id within a component, one stays."""
    found = materialize(near_duplicates(docs), "simhash-found")
    first = F.col("doc_id").eqNullSafe(F.col("component_id"))
    per = materialize(found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.max(first).alias("first")), "simhash-ids")
    key, fp, root = (fresh(docs.columns, c) for c in ("_keep", "_keep_fp", "_keep_root"))
    same = docs["doc_id"].eqNullSafe(F.col(key))
    once = per.where("n = 1 AND first").select(F.col("doc_id").alias(key))
    # the kept ids grow with the corpus: a shuffle at every size, never a broadcast
    kept = docs.join(once.hint("merge"), same, "left_semi")
    often = per.where("n > 1").select(F.col("doc_id").alias(key))
    if often.isEmpty():
        return kept
    chosen = found.where(first).select(F.col("doc_id").alias(key), F.col("fp").alias(fp), F.col("root").alias(root)).distinct()
    again = docs.join(often, same, "left_semi").withColumn(fp + "_", fingerprint_of())
    again = again.join(chosen, again["doc_id"].eqNullSafe(F.col(key)) & (F.col(fp + "_") == F.col(fp)))
    return kept.unionByName(again.dropDuplicates(["doc_id", root]).select(*[again[c] for c in docs.columns]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


ship(__name__)
