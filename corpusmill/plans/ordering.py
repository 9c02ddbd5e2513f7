"""Global order without a single-task window (W1, G1's ranking, T4's steps).

A plain ``Window.orderBy(key)`` moves every row into one task. Instead:

1. the engine's range exchange (``repartitionByRange`` on the whole order key, then a sort inside
   each partition) puts the rows in order over ``rows / rows_per_bucket`` partitions, however many
   that are; rows that share a hot leading key are split by the columns behind it;
2. ``monotonically_increasing_id`` notes each row's partition and place, and the rows are written:
   the layout is computed once, so a lost executor cannot change it;
3. one small row per partition (its count, or the sum of a measure) gets its exclusive prefix in an
   ordered window and is broadcast back -- bounded by the number of partitions, not by the data.

At most ``rows_per_bucket`` rows need none of this: one ordered window is bounded then.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.plans.lineage import PACKED, materialize

ROWS_PER_BUCKET = 4_000_000
#: Bits of ``monotonically_increasing_id`` that hold the place inside a partition.
_PLACE_BITS = 33


def ranges_needed(df: DataFrame, rows_per_bucket: int, max_buckets: int | None = None) -> int:
    parts = -(-df.count() // max(1, rows_per_bucket))
    return min(parts, max_buckets) if max_buckets else parts


def range_ordered(df: DataFrame, order: list[str], parts: int, name: str = "ordered") -> DataFrame:
    """``df`` written in ``order`` (null first) over ``parts`` range partitions, with ``_part``, the
    partition's number, and ``_place``, the row's place in it."""
    spread = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    t = materialize(spread.withColumn("_m", F.monotonically_increasing_id()), name, codec=PACKED)
    place = F.col("_m").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1))
    return t.withColumn("_part", F.shiftright("_m", _PLACE_BITS)).withColumn("_place", place).drop("_m")


def _with_base(t: DataFrame, measure: Column) -> DataFrame:
    totals = t.groupBy("_part").agg(F.sum(measure).alias("_total"))
    prior = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("_part", F.coalesce(F.sum("_total").over(prior), F.lit(0)).cast("bigint").alias("_base"))
    # one row per range partition: bounded by their number
    return t.join(F.broadcast(bases), "_part")


def global_offsets(df: DataFrame, key: str, size: str, out: str = "off", order: list[str] | None = None,
                   rows_per_bucket: int = ROWS_PER_BUCKET, max_buckets: int | None = None) -> DataFrame:
    """Exclusive prefix sum of ``size`` in ``order`` (default ``[key]``), as column ``out``."""
    order = order or [key]
    parts = ranges_needed(df, rows_per_bucket, max_buckets)
    if parts <= 1:
        w = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumn(out, F.coalesce(F.sum(size).over(w), F.lit(0)).cast("bigint"))
    t = _with_base(range_ordered(df, order, parts), F.col(size))
    w = Window.partitionBy("_part").orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
    return (t.withColumn(out, (F.col("_base") + F.coalesce(F.sum(size).over(w), F.lit(0))).cast("bigint"))
             .drop("_part", "_place", "_base"))


def global_rank(df: DataFrame, order: list[str], out: str = "idx", rows_per_bucket: int = ROWS_PER_BUCKET,
                max_buckets: int | None = None) -> DataFrame:
    """0-based row number of every row in ``order``, a total order over any comparable columns."""
    parts = ranges_needed(df, rows_per_bucket, max_buckets)
    if parts <= 1:
        return df.withColumn(out, (F.row_number().over(Window.orderBy(*order)) - 1).cast("bigint"))
    t = _with_base(range_ordered(df, order, parts), F.lit(1))
    return t.withColumn(out, (F.col("_base") + F.col("_place")).cast("bigint")).drop("_part", "_place", "_base")


def global_index(df: DataFrame, key: str, order: list[str] | None = None, out: str = "idx",
                 rows_per_bucket: int = ROWS_PER_BUCKET, max_buckets: int | None = None) -> DataFrame:
    """0-based row number of every row in ``order`` (a total order whose first column is ``key``)."""
    return global_rank(df, order or [key], out, rows_per_bucket, max_buckets)
