"""Ranges of time with a halo: each range of rows together with the rows shortly before it.

An operator whose rows look back a bounded time can then work on all ranges at
once, in as many tasks as there are ranges, and gives the same for any length
of range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def seconds(ts: Column) -> Column:
    """Seconds since the epoch as double, with their fractions."""
    return F.unix_micros(ts.cast("timestamp")) / 1e6


def ranges(df: DataFrame, ts: str, length_s: float, halo_s: float) -> DataFrame:
    """Adds ``range`` and ``own``: a row is its own range's, and a guest of those that begin within ``halo_s`` after it.

    A row is copied once for each range it is a guest of, at most ``halo_s / length_s`` rounded up.
    """
    at = seconds(F.col(ts))
    first, last = (F.floor(x / length_s).cast("long") for x in (at, at + halo_s))
    spread = df.where(F.col(ts).isNotNull()).select("*", first.alias("__first"), F.explode(F.sequence(first, last)).alias("range"))
    return spread.withColumn("own", F.col("range") == F.col("__first")).drop("__first")
