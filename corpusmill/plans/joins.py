"""Join strategies with a checked size before any broadcast, and ways around hot keys.

``lookup_join`` joins a large fact side to a dimension keyed by ``key``:

* dimension size checked (rows and estimated bytes) -> broadcast hash join,
  no shuffle of the large side;
* otherwise the ``hot_rows`` most frequent keys (by the dimension's own count column)
  are broadcast -- a bound set by the parameter -- and only the remaining, cold keys go
  through a shuffled sort-merge join, so no reducer receives a hot key. AQE's skew
  join stays on as a second guard.

``spread_join`` is for keys of several columns, for dimensions with many rows a key and for facts without a
count column: the heavy keys of the fact come from a mergeable top-k sketch of the key's hash (one pass, partial
sketches, at most ``HEAVY_KEYS`` numbers on the driver); their rows are dealt over ``SALTS`` salts, and the
dimension's rows of these keys are repeated for each salt. A key that the sketch takes for heavy
by mistake is only repeated for nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, DateType, NumericType, StringType, TimestampType

BROADCAST_ROWS = 2_000_000
BROADCAST_BYTES = 256 << 20
HOT_ROWS = 100_000
#: Keys that a sketch may report, entries that it keeps, the share of all rows that makes a key heavy, and salts.
HEAVY_KEYS, HEAVY_TRACKED, HEAVY_SHARE, SALTS = 100, 10_000, 0.005, 32


def _width(column) -> Column | int:
    """The bytes of a column's value: fixed for numbers, by length for strings and arrays of numbers, else by its JSON."""
    kind = column.dataType
    if isinstance(kind, (NumericType, BooleanType, DateType, TimestampType)):
        return 8
    if isinstance(kind, (StringType, BinaryType)):
        return F.coalesce(F.octet_length(column.name), F.lit(0)) + 16
    if isinstance(kind, ArrayType) and isinstance(kind.elementType, NumericType):
        return F.coalesce(F.size(column.name) * 8, F.lit(0)) + 16
    return F.length(F.to_json(F.struct(F.col(column.name))))


def size_of(dim: DataFrame, key: str) -> tuple[int, int]:
    """(rows, estimated bytes) of a dimension table, by one aggregation: every column counts, arrays too."""
    widths = [_width(c) for c in dim.schema.fields]
    fixed = 24 + sum(w for w in widths if isinstance(w, int))
    wide = sum((w for w in widths if not isinstance(w, int)), F.lit(fixed))
    r = dim.agg(F.count(F.lit(1)).alias("n"), F.sum(wide).alias("b")).first()
    return int(r["n"] or 0), int(r["b"] or 0)


def fits_broadcast(dim: DataFrame, key: str, max_rows: int = BROADCAST_ROWS,
                   max_bytes: int = BROADCAST_BYTES) -> bool:
    rows, nbytes = size_of(dim, key)
    return rows <= max_rows and nbytes <= max_bytes


def lookup_join(fact: DataFrame, dim: DataFrame, key: str, how: str = "inner", weight: str | None = None,
                max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES,
                hot_rows: int = HOT_ROWS) -> DataFrame:
    """``fact`` joined with ``dim`` on ``key`` (``how`` is 'inner' or 'left')."""
    if fits_broadcast(dim, key, max_rows, max_bytes):
        return fact.join(F.broadcast(dim), key, how)
    if weight is None:
        return fact.join(dim, key, how)
    return split_join(fact, dim, key, how, weight, hot_rows)


def split_join(fact: DataFrame, dim: DataFrame, key: str, how: str, weight: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``fact`` joined with a ``dim`` too large to broadcast: hot keys by a broadcast of
    ``hot_rows`` rows, the others by a shuffle. Both sides are read twice: pass written tables."""
    hot = dim.orderBy(F.col(weight).desc(), F.col(key)).limit(hot_rows)  # bounded by hot_rows
    hot_keys = hot.select(key)
    hot_part = fact.join(F.broadcast(hot), key, "inner")
    cold_fact = fact.join(F.broadcast(hot_keys), key, "left_anti")
    cold_dim = dim.join(F.broadcast(hot_keys), key, "left_anti")
    cold_part = cold_fact.join(cold_dim, key, how)
    return hot_part.unionByName(cold_part)


def restrict_to(big: DataFrame, small: DataFrame, keys: list[str], max_rows: int = BROADCAST_ROWS,
                max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Rows of ``big`` whose ``keys`` occur in ``small``. When the distinct keys of ``small``
    pass the size check they are broadcast into a left-semi join, so ``big`` is filtered
    while it is scanned and never shuffled; otherwise ``big`` is returned as it is."""
    k = small.select(*keys).distinct()
    if fits_broadcast(k, keys[0], max_rows, max_bytes):
        return big.join(F.broadcast(k), keys, "left_semi")
    return big


def heavy_hashes(fact: DataFrame, keys: list[str], share: float = HEAVY_SHARE) -> list[int]:
    """Hashes of the keys that hold more than ``share`` of the rows, by a mergeable sketch."""
    r = fact.select(F.xxhash64(*keys).alias("k")).agg(
        F.expr(f"approx_top_k(k, {HEAVY_KEYS}, {HEAVY_TRACKED})").alias("top"), F.count(F.lit(1)).alias("n")).first()
    return [t["item"] for t in r["top"] or [] if t["count"] > share * r["n"]]


def salted_join(fact: DataFrame, dim: DataFrame, keys: list[str], how: str = "inner", salts: int = SALTS,
                share: float = HEAVY_SHARE, measured: DataFrame | None = None) -> DataFrame:
    """``fact`` joined with ``dim`` on ``keys`` (``how`` is 'inner' or 'left') by a shuffle that deals heavy keys over ``salts``
    parts. ``measured``: a written table with the fact's distribution of keys, if the fact itself is not cheap to read."""
    heavy = heavy_hashes(fact if measured is None else measured, keys, share)
    if not heavy:
        return fact.join(dim, keys, how)
    is_heavy = F.xxhash64(*keys).isin(heavy)
    # the place in the scan, not a random number: a repeated task deals its rows alike
    dealt = fact.withColumn("_salt", F.when(is_heavy, F.monotonically_increasing_id() % salts).otherwise(F.lit(0).cast("bigint")))
    every = F.when(is_heavy, F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))).otherwise(
        F.array(F.lit(0).cast("bigint")))
    repeated = dim.withColumn("_salt", F.explode(every))
    return dealt.join(repeated, [*keys, "_salt"], how).drop("_salt")


def spread_join(fact: DataFrame, dim: DataFrame, keys: list[str], how: str = "inner", measured: DataFrame | None = None,
                max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES, **salting) -> DataFrame:
    """``fact`` joined with ``dim`` on ``keys``: a broadcast where the size check allows it, else a salted shuffle."""
    if fits_broadcast(dim, keys[0], max_rows, max_bytes):
        return fact.join(F.broadcast(dim), keys, how)
    return salted_join(fact, dim, keys, how, measured=measured, **salting)
