"""Classification and retrieval metrics as aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def balanced_accuracy(df: DataFrame) -> DataFrame:
    """``truth, pred`` -> mean recall over the true classes."""
    by_class = df.groupBy("truth").agg(F.avg((F.col("truth") == F.col("pred")).cast("double")).alias("r"))
    return by_class.agg(F.avg("r").alias("balanced_accuracy"))


def micro_f1(df: DataFrame) -> DataFrame:
    """Sums of ``tp, fp, fn`` -> precision, recall and F1 (null where undefined)."""
    s = df.agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    return s.select("tp", "fp", "fn", F.try_divide("tp", F.col("tp") + F.col("fp")).alias("precision"), F.try_divide("tp", F.col("tp") + F.col("fn")).alias("recall"), F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"))


def hit_and_mrr(hits: DataFrame, ks: tuple[int, ...]) -> DataFrame:
    """``query_id, rank, relevant`` -> one row: hit@k for each k, and MRR at the largest."""
    first = hits.groupBy("query_id").agg(F.min(F.when(F.col("relevant"), F.col("rank"))).alias("first"))
    rates = [F.avg((F.coalesce("first", F.lit(1 << 30)) <= k).cast("double")).alias(f"hit_{k}") for k in ks]
    return first.agg(F.count("*").alias("n"), *rates, F.avg(F.when(F.col("first") <= max(ks), 1 / F.col("first")).otherwise(0.0)).alias("mrr"))
