"""Scans (S1-S3, P1) of the document tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions.text import split_lines


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Hash-partition by ``key`` only when the scan has fewer splits than the cluster has
    task slots (small single-file inputs). Large inputs keep their scan splits."""
    spark = df.sparkSession
    slots = spark.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < slots:
        return df.repartition(slots, key)
    return df


def read_documents(spark: SparkSession, sf_dir: str, table: str = "documents", key: str = "doc_id",
                   columns: tuple[str, ...] = ("text",)) -> DataFrame:
    """``(doc_id, text[, ...])`` of a document table: only the order key and the asked columns."""
    df = read_table(spark, sf_dir, table).select(F.col(key).alias("doc_id"), *columns)
    return spread(df, "doc_id")


def lines(docs: DataFrame) -> DataFrame:
    """``(doc_id, line_no, line)``, line_no from 0, universal newlines."""
    return docs.select("doc_id", F.posexplode(split_lines("text")).alias("line_no", "line")) \
        .withColumn("line_no", F.col("line_no").cast("int"))


def whole_text(docs: DataFrame) -> DataFrame:
    """One text value per document, newlines kept."""
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
