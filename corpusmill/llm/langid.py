"""Language identification: multinomial logistic regression on TF-IDF character n-grams,
trained by follow-the-regularised-leader with elastic-net penalties, then calibrated.

A text's lower-cased letters (everything else is one space) give hashed n-grams of 1 to 3
characters in ``2**BITS`` buckets, weighed ``(1 + ln tf) * idf`` and scaled to length one.
Document frequencies are counted over all learnable rows, one row per task and bucket before
the shuffle. The classifier is fitted on a bounded sample: about ``PER_LABEL`` distinct texts
of each label, chosen by a hash of the text; a fifth of them, again by hash, is kept out of
the training to fit the temperature that divides the scores. FTRL keeps weights at exactly
zero where evidence is below the L1 penalty, so the model is sparse. Prediction reads whole
texts in one pass without a shuffle; it sees the text alone.

Edge cases: a null text, or one without a letter, is ``und`` with score 0; so is everything
when there is nothing to learn from. Rows without a label, and held-out rows, are not learned
from; a null doc_id counts as the empty text in the hold-out rule. Repeated texts count for the frequencies and
once for the fit. Ties go to the first label by code point. Extra columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.common import materialize, ship, table

BITS, ORDERS = 15, (1, 2, 3)
#: Bound of the training sample, in distinct texts of each label.
PER_LABEL = 400
EPOCHS, ALPHA, BETA, L1, L2 = 4, 1.0, 1.0, 0.02, 0.001
FOLDS = 5
_MIX = np.uint64(0x9E3779B97F4A7C15)
_SEEDS = [np.uint64(s) for s in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]


@cache
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def counts_of(text: str | None) -> np.ndarray | None:
    """n-gram counts by bucket, or None for a text without a letter."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[points]
    if not letter.any():
        return None
    c = np.where(letter, points, 32).astype(np.uint64)
    blank = c == 32
    c = c[~(blank & np.concatenate(([False], blank[:-1])))]  # one space for each run
    out = np.zeros(1 << BITS, np.int64)
    h = np.zeros(len(c), np.uint64)
    for n in ORDERS:
        if len(c) < n:
            break
        h = h[:len(c) - n + 1] * _SEEDS[0] + (c[n - 1:] + np.uint64(n)) * _SEEDS[n - 1]
        mixed = h * _MIX
        mixed ^= mixed >> np.uint64(31)
        out += np.bincount((mixed * _SEEDS[1] >> np.uint64(64 - BITS)).astype(np.int64), minlength=1 << BITS)
    return out


def weigh(counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(buckets, values)`` of the TF-IDF vector of length one."""
    at = np.flatnonzero(counts)
    v = (1 + np.log(counts[at])) * idf[at]
    return at, v / max(float(np.sqrt((v * v).sum())), 1e-12)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


class Ftrl:
    """FTRL-proximal state of a multinomial model; the last column is the bias."""

    def __init__(self, labels: int):
        self.z, self.n = np.zeros((labels, (1 << BITS) + 1)), np.zeros((labels, (1 << BITS) + 1))

    def weights(self, at) -> np.ndarray:
        z, n = self.z[:, at], self.n[:, at]
        w = -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2)
        return np.where(np.abs(z) <= L1, 0.0, w)

    def learn(self, at: np.ndarray, v: np.ndarray, label: int) -> None:
        at, v = np.append(at, 1 << BITS), np.append(v, 1.0)
        w = self.weights(at)
        error = _softmax(w @ v)
        error[label] -= 1
        g = error[:, None] * v
        n = self.n[:, at]
        self.z[:, at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[:, at] = n + g * g


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of the smallest log loss, by golden-section search on its logarithm."""
    if not len(labels):
        return 1.0
    loss = lambda t: -np.log(np.maximum(_softmax(logits / np.exp(t))[np.arange(len(labels)), labels], 1e-300)).mean()
    lo, hi, r = np.log(0.01), np.log(100.0), (5 ** 0.5 - 1) / 2
    for _ in range(60):
        a, b = hi - r * (hi - lo), lo + r * (hi - lo)
        lo, hi = (lo, b) if loss(a) <= loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def fold() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % FOLDS


def _frequencies(batches):
    df, n = np.zeros(1 << BITS, np.int64), 0
    for b in batches:
        for t in b["text"]:
            c = counts_of(t)
            if c is not None:
                df += c > 0
                n += 1
    at = np.flatnonzero(df)
    yield pd.DataFrame({"bucket": np.append(at, -1), "n": np.append(df[at], n)})


def _vectors(idf):
    def run(batches):
        for b in batches:
            rows = []
            for t, lang, h in zip(b["text"], b["lang"], b["h"]):
                c = counts_of(t)
                if c is not None:
                    at, v = weigh(c, idf)
                    rows.append((lang, h, at.astype("<i4").tobytes(), v.astype("<f4").tobytes()))
            yield pd.DataFrame(rows, columns=["lang", "h", "at", "v"])

    return run


class Model:
    def __init__(self, labels: list[str], idf: np.ndarray, weights: np.ndarray, heat: float):
        self.labels, self.idf, self.weights, self.heat = labels, idf, weights, heat

    def predict(self, text: str | None) -> tuple[str, float]:
        c = counts_of(text) if self.labels else None
        if c is None:
            return "und", 0.0
        at, v = weigh(c, self.idf)
        p = _softmax((v @ self.weights[at] + self.weights[-1]) / self.heat)
        k = int(p.argmax())
        return self.labels[k], float(min(1.0, p[k]))


def fit(labelled: DataFrame, per_label: int = PER_LABEL) -> Model:
    """A model of ``labelled (text, lang)``; null labels and texts are left out."""
    rows = labelled.select("text", "lang").where("text IS NOT NULL AND lang IS NOT NULL")
    df = dict(rows.select("text").mapInPandas(_frequencies, "bucket int, n bigint").groupBy("bucket")
              .agg(F.sum("n").alias("n")).collect())  # at most 2**BITS + 1 rows
    total = df.pop(-1, 0)
    idf = np.full(1 << BITS, 1.0 + np.log1p(total))
    for b, n in df.items():
        idf[b] = 1.0 + np.log((1 + total) / (1 + n))
    # one row per label; the sample takes a share of each label's distinct texts by their hash
    count = rows.select("lang", F.xxhash64("text").alias("h")).distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    u = F.pmod(F.xxhash64(F.col("text"), F.lit("sample")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = rows.join(F.broadcast(count), "lang").where(u < F.least(F.lit(1.0), F.lit(float(per_label)) / F.col("n"))) \
        .withColumn("h", F.xxhash64("text")).dropDuplicates(["lang", "h"]).select("text", "lang", "h")
    vectors = materialize(sample.mapInPandas(_vectors(idf), "lang string, h bigint, at binary, v binary"), "langid-sample")
    got = sorted(((r["h"], r["lang"], np.frombuffer(r["at"], "<i4"), np.frombuffer(r["v"], "<f4").astype(float))
                  for r in vectors.collect()), key=lambda r: r[:2])  # bounded by per_label and labels
    labels = sorted({r[1] for r in got})
    number, ftrl = {c: k for k, c in enumerate(labels)}, Ftrl(len(labels))
    held = [r for r in got if r[0] % 5 == 0]
    train = [r for r in got if r[0] % 5] or got
    for epoch in range(EPOCHS):
        for k in np.random.default_rng(epoch).permutation(len(train)):
            ftrl.learn(train[k][2], train[k][3], number[train[k][1]])
    weights = ftrl.weights(slice(None)).T.astype(np.float32).copy() if labels else np.zeros((1, 0), np.float32)
    logits = np.array([r[3] @ weights[r[2]] + weights[-1] for r in held]).reshape(len(held), len(labels))
    return Model(labels, idf, weights, temperature(logits, np.array([number[r[1]] for r in held], dtype=int)))


def predictions(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)`` for every row of ``docs (doc_id, text)``."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # 2**BITS rows of labels

    @F.pandas_udf("lang string, score double")
    def udf(texts: pd.Series) -> pd.DataFrame:
        own = sent.value
        return pd.DataFrame([own.predict(t) for t in texts], columns=["lang", "score"])

    p = docs.select("doc_id", (fold() == 0).alias("held_out"), udf("text").alias("p"))
    return p.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predictions(docs, fit(docs.where(fold() != 0)))


ship(__name__)
