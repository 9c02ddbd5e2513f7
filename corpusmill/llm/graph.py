"""Connected components of an edge table, by alternating large-star and small-star rounds.

Every round is two joins and partial aggregates over the edges and is written to the shared
folder, so lineage never grows and a lost executor costs one round. Nothing but two numbers
per round reaches the driver. A hub of the graph is a hot join key; the engine's skewed-join
split covers it, since both sides of each join are plain shuffles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import materialize


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(low, "u").where("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def _state(e: DataFrame) -> tuple:
    r = e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return r["n"], r["h"]


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(node, root)`` for every node of ``edges (u, v)`` (longs, u <> v): ``root`` is the
    smallest node of its component. No edges: an empty table."""
    e = materialize(edges.select("u", "v").where("u <> v").distinct(), "components")
    seen = _state(e)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        e = materialize(_small_star(_large_star(e)), "components")
        now = _state(e)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components: no fixed point after {max_rounds} rounds")
    # at the fixed point every edge points to its component's smallest node
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")) \
        .unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
