"""Small helpers shared by the operators of this package."""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

from corpusmill.plans.lineage import materialize
from corpusmill.session import ensure_checkpoint_dir
from corpusmill.sources.documents import read_table

#: A word: a run of characters other than space and U+0009-U+000D (Java and RE2 syntax).
WORD = r"[^\x20\x09-\x0D]+"


def ship(module: str) -> None:
    """Functions of ``module`` travel by value with a UDF; workers need no install."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    return read_table(spark, sf_dir, name)


def fresh(taken: list[str], name: str) -> str:
    """``name``, lengthened until no column of ``taken`` has it (case aside)."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name += "_"
    return name


__all__ = ["WORD", "ship", "table", "fresh", "materialize"]
