"""Sinks (S4, S6, S7): idempotent landing, sharded training samples, appended metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def land_once(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` to ``path`` unless a table is already there; return the landed table. A
    second call is a no-op. A path without the writer's success marker is a failed write and
    is refused."""
    spark = df.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(where) and not fs.exists(spark._jvm.org.apache.hadoop.fs.Path(where, "_SUCCESS")):
        raise RuntimeError(f"{path} holds an unfinished write")
    df.write.mode("ignore").parquet(path)
    return spark.read.parquet(path)


def write_samples(samples: DataFrame, path: str, batches_per_shard: int) -> DataFrame:
    """Training samples written as shards of ``batches_per_shard`` consecutive batches
    (``shard`` partition folders); a loader reads shard by shard in order."""
    out = samples.withColumn("shard", F.expr(f"batch_id div {int(batches_per_shard)}"))
    out = out.repartitionByRange("shard").sortWithinPartitions("shard", "sample_id")  # a shard is in one file, in order
    out.write.mode("overwrite").partitionBy("shard").parquet(path)
    return samples.sparkSession.read.parquet(path)


def append_metrics(df: DataFrame, path: str) -> DataFrame:
    """Append named scalars ``(run, step, name, value)`` to a metric log table."""
    df.write.mode("append").parquet(path)
    return df.sparkSession.read.parquet(path)
