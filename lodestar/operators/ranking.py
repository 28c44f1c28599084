"""Top rows, ties and running bounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def top_n(df: DataFrame, keys: list[str], order: list[Column], n: int, place: str) -> DataFrame:
    """First ``n`` rows of each key under a total order; Spark keeps n a task before the shuffle."""
    return df.withColumn(place, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(place) <= n)


def top_ties(df: DataFrame, keys: list[str], order: list[Column], tie_break: list[Column], k: int, cap: int, place: str) -> DataFrame:
    """Rows of rank up to ``k``, ties included, but at most ``cap`` a key."""
    w = Window.partitionBy(*keys)
    ranked = df.withColumn(place, F.rank().over(w.orderBy(*order))).withColumn("__n", F.row_number().over(w.orderBy(*order, *tie_break)))
    return ranked.where((F.col(place) <= k) & (F.col("__n") <= cap)).drop("__n")


def running_bounds(df: DataFrame, key: str, weight: str) -> DataFrame:
    """``key, weight, lo, hi``: half-open cumulative bounds in order of key, for inverse lookups.

    The table of weights is an aggregate of few rows; it goes through one window.
    """
    w = Window.orderBy(key)
    return df.select(key, weight, F.coalesce(F.sum(weight).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long").alias("lo"), F.sum(weight).over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long").alias("hi"))


def numbered(df: DataFrame, part: Column, order: list[str], place: str) -> DataFrame:
    """Numbers from 1 in the order of ``part`` then ``order``, without one task for all rows.

    ``part`` is a coarse, order-keeping value (a day of a time): rows are
    numbered within each part, and each part starts after those before it.
    """
    d = df.withColumn("_part", part)
    own = d.withColumn("_own", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    sizes = d.groupBy(F.col("_part").alias("_p")).agg(F.count("*").alias("_n"))
    before = sizes.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))  # one row a part
    return own.join(before, F.col("_part").eqNullSafe(F.col("_p"))).withColumn(place, F.col("_own") + F.col("_before")).drop("_part", "_own", "_p", "_before")
