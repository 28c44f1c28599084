"""Minute and hour series: buckets with empty ones, alignment, gaps, profiles."""

from __future__ import annotations

import math
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def spine(df: DataFrame, ts: str, unit: str = "minute") -> DataFrame:
    """Every bucket between the first and the last, as ``ts``."""
    ends = df.agg(F.min(F.date_trunc(unit, ts)).alias("a"), F.max(F.date_trunc(unit, ts)).alias("b"))
    return ends.where("a is not null").select(F.explode(F.expr(f"sequence(a, b, interval 1 {unit})")).alias("ts"))


def summary(events: DataFrame, unit: str = "minute", seconds: int = 60) -> DataFrame:
    """``ts, n_ok, n_err, tps, p50, p95, err_pct`` a bucket; empty buckets are rows with zero counts.

    Percentiles are nearest-rank; rates of empty buckets are null.
    """
    failed = F.col("event_type") == "error"
    agg = events.groupBy(F.date_trunc(unit, "ts").alias("ts")).agg(
        F.count_if(~failed).alias("n_ok"), F.count_if(failed).alias("n_err"), F.expr("percentile_disc(0.5) within group (order by value)").alias("p50"), F.expr("percentile_disc(0.95) within group (order by value)").alias("p95")
    )
    n = F.col("n_ok") + F.col("n_err")
    full = spine(events, "ts", unit).join(agg, "ts", "left").fillna(0, ["n_ok", "n_err"])
    return full.select("ts", "n_ok", "n_err", (n / seconds).alias("tps"), "p50", "p95", F.try_divide(100 * F.col("n_err"), n).alias("err_pct"))


def signals(events: DataFrame, types: tuple[str, ...] = ("click", "error", "purchase", "signup", "view")) -> DataFrame:
    """Wide hourly series: one count a type, total value and largest value."""
    wide = events.groupBy(F.date_trunc("hour", "ts").alias("ts")).agg(*[F.count_if(F.col("event_type") == t).cast("double").alias(t) for t in types], F.sum(F.col("value").cast("decimal(18,4)")).cast("double").alias("total"), F.max("value").alias("top"))
    return wide


def long_form(wide: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Unpivoted, without nulls: ``key, signal, val``."""
    return wide.unpivot([key], columns, "signal", "val").where("val is not null")


#: Sines and cosines of the 60 whole seconds, as the C library has them, of angles that are exact products before they are
#: rounded. The JVM's differ in the last bit, which decides whether a mean on the full minute is a hair below 60 or 0.
TURN = "6.283185307179586"
SINES, COSINES = ([f(float(s * Decimal(TURN)) / 60) for s in range(60)] for f in (math.sin, math.cos))


def phase(seconds: Column, window) -> Column:
    """Circular mean of whole seconds within a minute over a window; null where they cancel out."""
    of = lambda values: F.get(F.array(*[F.lit(v) for v in values]), seconds)
    y, x = F.sum(of(SINES)).over(window), F.sum(of(COSINES)).over(window)
    turned = F.atan2(y, x) * 60 / float(TURN) + 60
    return F.when(F.abs(x) + F.abs(y) > 1e-6, (turned % 60 + 60) % 60)  # 60 added again: what is less than its last bit below 60 is 0


def aligned(df: DataFrame, ts: str, keys: list[str], order: list[str], before: int = 5) -> DataFrame:
    """Adds ``phase`` of this and the last rows, and ``minute_key``: the minute whose phase-shifted middle is nearest."""
    w = Window.partitionBy(*keys).orderBy(ts, *order).rowsBetween(-before, 0)  # each feed has its own clock
    out = df.withColumn("phase", phase(F.second(ts), w))
    return out.withColumn("minute_key", F.date_trunc("minute", F.expr(f"{ts} + make_dt_interval(0, 0, 0, 30.0 - phase)")))


def gaps(df: DataFrame, ts: str, keys: list[str], seconds: int) -> DataFrame:
    """Rows that follow the row before them by more than ``seconds``: ``keys, gap_from, gap_to, gap_s``."""
    w = Window.partitionBy(*keys).orderBy(ts)
    before = df.withColumn("gap_from", F.lag(ts).over(w))
    gap = F.unix_timestamp(ts) - F.unix_timestamp("gap_from")
    return before.where(gap > seconds).select(*keys, "gap_from", F.col(ts).alias("gap_to"), gap.alias("gap_s"))


def backfill(live: DataFrame, history: DataFrame, key: str) -> DataFrame:
    """Live rows plus the history rows whose key is absent from them."""
    return live.unionByName(history.join(live.select(key).distinct(), key, "left_anti"))


def robust_base(long: DataFrame, group: Column, least: int = 30) -> DataFrame:
    """Median and MAD of each (signal, group) with at least ``least`` rows.

    A MAD of zero falls back to the signal's MAD, then to its mean absolute
    deviation times 1.2533 / 1.4826, then to 1.
    """
    rows = long.withColumn("g", group)
    med = rows.groupBy("signal", "g").agg(F.median("val").alias("med"), F.count("*").alias("n"))
    dev = rows.join(med, ["signal", "g"]).withColumn("dev", F.abs(F.col("val") - F.col("med")))
    own = dev.groupBy("signal", "g", "med", "n").agg(F.median("dev").alias("mad"))
    everywhere = dev.groupBy("signal").agg(F.median("dev").alias("all_mad"), (F.sum(F.col("dev").cast("decimal(28,10)")).cast("double") / F.count("*") * 1.2533 / 1.4826).alias("all_mean"))
    mad = F.when(F.col("mad") > 0, F.col("mad")).when(F.col("all_mad") > 0, F.col("all_mad")).when(F.col("all_mean") > 0, F.col("all_mean")).otherwise(1.0)
    return own.where(F.col("n") >= least).join(everywhere, "signal").select("signal", "g", "med", mad.alias("mad"), "n")
