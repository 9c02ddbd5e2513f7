"""Session helpers: building a local session and finding the shared scratch folder.

Library code never invents a machine-local folder: intermediate tables go under
``spark.checkpoint.dir``, which a cluster points at shared storage. Only tests,
the bench and the smoke entry set it, and only when it is unset.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession

_DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, driver_memory: str = "16g",
                  app_name: str = "corpusmill") -> SparkSession:
    """A local session for tests and the bench (one JVM, ``cores`` task threads)."""
    b = SparkSession.builder.master(f"local[{cores}]").appName(app_name)
    for k, v in _DEFAULT_CONF.items():
        b = b.config(k, v)
    b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    b = b.config("spark.driver.memory", driver_memory)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str | None:
    """The shared folder named by the session (``spark.checkpoint.dir``), or None."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        d = spark.sparkContext.getCheckpointDir()
    return d or None


def ensure_checkpoint_dir(spark: SparkSession, fallback: str | None = None) -> str:
    """Return the session's checkpoint folder; set a fresh one only when none is set.

    The fallback (a fresh temp folder) is for local runs only: on a cluster the
    setting is always present and is used as given.
    """
    d = checkpoint_dir(spark)
    if d:
        return d
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir is not set; point it at storage that the executors share")
    d = fallback or tempfile.mkdtemp(prefix="corpusmill-ckpt-")
    spark.sparkContext.setCheckpointDir(d)
    try:
        spark.conf.set("spark.checkpoint.dir", d)
    except Exception:  # static conf in some deployments; the context setting is enough
        pass
    return checkpoint_dir(spark) or d


def scratch_folder(spark: SparkSession) -> str:
    """The session's folder in the shared checkpoint folder."""
    d = checkpoint_dir(spark)
    if not d:
        raise RuntimeError("spark.checkpoint.dir is not set; point it at shared storage")
    return f"{d.rstrip('/')}/corpusmill/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unique path under the session's folder in the shared checkpoint folder."""
    return f"{scratch_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def drop_scratch(spark: SparkSession) -> None:
    """Deletes all tables that this session wrote to the checkpoint folder. DataFrames that read them end here: a job
    calls it once its results are written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(scratch_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
