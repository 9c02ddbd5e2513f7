"""Cutting lineage: write an intermediate table to the shared checkpoint folder.

A written parquet table (not ``localCheckpoint``) survives the loss of any executor,
is columnar (later scans prune columns and push filters), and is computed once.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from corpusmill.session import scratch_folder, scratch_path

#: The codec of tables of the size of the corpus: half of what the session's default leaves.
PACKED = "zstd"
#: The files of a step's shuffles go when the step ends, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession):
    """Steps that run inside leave no shuffle files behind."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def materialize(df: DataFrame, name: str, partition_by: list[str] | None = None, codec: str | None = None) -> DataFrame:
    """Write ``df`` under ``spark.checkpoint.dir`` (packed by the session's codec, or ``codec``) and return a scan of the
    written table."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    if codec:
        w = w.option("compression", codec)
    with shuffles_dropped(spark):
        w.parquet(path)
    return spark.read.parquet(path)


def discard(*tables: DataFrame) -> None:
    """Deletes tables of ``materialize`` that nothing reads any more; other DataFrames are left alone."""
    for df in tables:
        spark = df.sparkSession
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            own = spark._jvm.org.apache.hadoop.fs.Path(scratch_folder(spark))
            fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
            if path.getParent() is not None and fs.makeQualified(path.getParent()).equals(fs.makeQualified(own)):
                fs.delete(path, True)

