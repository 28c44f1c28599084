"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.session import materialise, measured


def _large(e: DataFrame) -> DataFrame:
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy(F.col("u").alias("w")).agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.where("v > u").join(least, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m"))
    moved = down.join(least, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = least.select(F.col("w").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(own).where("u <> v").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``u, v`` edges -> ``u, v`` where v is the least vertex reachable from u (u > v only).

    Each round is written to the shared folder, so lost executors cost one
    round at most. Minima are partial aggregates; a vertex with very many
    neighbours only makes its rows of one join uneven, which Spark splits.
    """
    e = materialise(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = None
    for _ in range(rounds):
        e, now = measured(_small(_large(e)), "edges", n=F.count("*"), h=F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")))
        if now == seen:
            return e
        seen = now
    raise RuntimeError(f"components did not settle in {rounds} rounds")
