"""Anomaly detectors over metric series.

Thresholds, seasonal baselines and PCA residuals are DataFrame expressions on
the long form ``ts, signal, val``; models that are fitted are in ``fitted``. In
all scores flag is 1, 0, or null for times that cannot be scored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestar.operators import intervals, series


def incomplete(columns: list[str]) -> Column:
    """True where any of the columns is null."""
    return reduce(or_, [F.col(c).isNull() for c in columns])


def usable_signals(long: DataFrame) -> DataFrame:
    """Signals that have values and vary: ``signal, low, high, n``."""
    s = long.groupBy("signal").agg(F.min("val").alias("low"), F.max("val").alias("high"), F.count("*").alias("n"))
    return s.where("low < high")


def select_signals(wide: DataFrame, columns: list[str], passes: int = 5) -> list[str]:
    """Drop empty and constant signals; repeat while the rows left by null removal make more of them constant."""
    for _ in range(passes):
        if not columns:
            return []
        long = series.long_form(wide.where(~incomplete(columns)) if _ else wide, "ts", columns)
        kept = {r.signal for r in usable_signals(long).select("signal").collect()}  # one row a column
        left = [c for c in columns if c in kept]
        if left == columns and _:
            break
        columns = left
    return columns


def training_rows(wide: DataFrame, incidents: DataFrame, columns: list[str], start: str, end: str, before: str = "5 minutes", after: str = "30 minutes") -> DataFrame:
    """Complete rows in [start, end) outside every incident, widened on both sides; an open end excludes all that follows."""
    until = F.coalesce(F.expr(f"end_ts + interval {after}"), F.lit(end).cast("timestamp"))
    out = incidents.select(F.expr(f"start_ts - interval {before}").alias("__a"), until.alias("__z"))
    rows = wide.where((F.col("ts") >= F.lit(start).cast("timestamp")) & (F.col("ts") < F.lit(end).cast("timestamp")) & ~incomplete(columns))
    return intervals.point_in_interval(rows, "ts", out, "__a", "__z", "left_anti")


def static_train(long: DataFrame, pct: float, two_sided: tuple[str, ...]) -> DataFrame:
    """``signal, hi, lo``: interpolated percentiles; a low bound only for ``two_sided`` signals."""
    q = long.groupBy("signal").agg(F.expr(f"percentile_cont({pct / 100}) within group (order by val)").alias("hi"), F.expr(f"percentile_cont({(100 - pct) / 100}) within group (order by val)").alias("lo"))
    return q.withColumn("lo", F.when(F.col("signal").isin(list(two_sided)), F.col("lo")))


def static_ratios(long: DataFrame, model: DataFrame) -> DataFrame:
    """``ts, signal, val, ratio``: how far beyond its bounds a value is, at most 100."""
    j = long.join(F.broadcast(model), "signal")  # one row a signal
    high = F.when(F.col("hi") > 0, F.col("val") / F.col("hi")).when(F.col("val") > 0, 100.0).otherwise(0.0)
    low = F.when(F.col("lo").isNull(), 0.0).when(F.col("val") > 0, F.col("lo") / F.col("val")).when(F.col("lo") > 0, 100.0).otherwise(0.0)
    return j.select("ts", "signal", "val", F.least(F.lit(100.0), F.greatest(high, low)).alias("ratio"))


def static_score(long: DataFrame, model: DataFrame) -> DataFrame:
    """``ts, flag, score, breached``: flag where a ratio is over 1; breached names them, largest first."""
    over = F.when(F.col("ratio") > 1, F.struct((-F.col("ratio")).alias("r"), "signal"))
    agg = static_ratios(long, model).groupBy("ts").agg(F.max("ratio").alias("score"), F.array_sort(F.collect_list(over)).alias("b"))
    names = F.array_join(F.col("b.signal"), ",")
    return agg.select("ts", (F.col("score") > 1).cast("int").alias("flag"), "score", F.nullif(names, F.lit("")).alias("breached"))


def seasonal_score(long: DataFrame, base: DataFrame, k: float, group: Column | None = None) -> DataFrame:
    """``ts, flag, score``: largest robust z of a time over k, against ``series.robust_base``."""
    g = F.hour("ts") if group is None else group
    z = F.abs(F.col("val") - F.col("med")) / (1.4826 * F.col("mad"))
    j = long.withColumn("g", g).join(F.broadcast(base.select("signal", "g", "med", "mad")), ["signal", "g"])  # signals x 24
    return j.groupBy("ts").agg(F.max(z).alias("z")).select("ts", (F.col("z") > k).cast("int").alias("flag"), (F.col("z") / k).alias("score"))


def with_unscored(times: DataFrame, scored: DataFrame, ts: str) -> DataFrame:
    """All times; those without a score have nulls."""
    return times.join(scored, ts, "left")


def contributors(long: DataFrame, key: str, weight: str, first: int = 5, ties: int = 3, cap: int = 40) -> DataFrame:
    """The ``first`` signals by weight and all of rank up to ``ties``, at most ``cap``, ranked 1, 2, ..."""
    w = Window.partitionBy(key)
    r = long.withColumn("rank", F.row_number().over(w.orderBy(F.desc(weight), "signal"))).withColumn("__k", F.rank().over(w.orderBy(F.desc(weight))))
    return r.where(((F.col("rank") <= first) | (F.col("__k") <= ties)) & (F.col("rank") <= cap)).drop("__k")


@dataclass
class Pca:
    signals: list[str]
    mean: np.ndarray
    sd: np.ndarray
    basis: np.ndarray  # signals x k
    threshold: float


def _residuals(wide: DataFrame, model: Pca) -> DataFrame:
    """One column of residual a signal: z minus its projection, as expressions."""
    z = [(F.col(s) - float(m)) / float(d) for s, m, d in zip(model.signals, model.mean, model.sd, strict=True)]
    p = wide.select("ts", *[c.alias(f"__z{i}") for i, c in enumerate(z)])
    k = model.basis.shape[1]
    score = [sum((F.col(f"__z{i}") * float(model.basis[i, j]) for i in range(len(z))), F.lit(0.0)) for j in range(k)]
    p = p.select("*", *[c.alias(f"__p{j}") for j, c in enumerate(score)])
    back = [F.col(f"__z{i}") - sum((F.col(f"__p{j}") * float(model.basis[i, j]) for j in range(k)), F.lit(0.0)) for i in range(len(z))]
    return p.select("ts", *[c.alias(s) for c, s in zip(back, model.signals, strict=True)])


def pca_train(wide: DataFrame, columns: list[str], variance: float = 0.9, quantile: float = 0.995) -> Pca:
    """Fewest components with ``variance`` of the z-scored variance; threshold is a quantile of the squared residual.

    Only means and a columns x columns covariance reach the driver.
    """
    rows = wide.where(~incomplete(columns))
    m = rows.agg(F.count("*").alias("n"), *[F.avg(c).alias(f"a{i}") for i, c in enumerate(columns)], *[F.stddev_samp(c).alias(f"s{i}") for i, c in enumerate(columns)]).first()
    mean, sd = (np.array([m[f"{x}{i}"] for i in range(len(columns))], float) for x in "as")
    z = [(F.col(c) - float(a)) / float(s) for c, a, s in zip(columns, mean, sd, strict=True)]
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    cov = rows.agg(*[F.avg(z[i] * z[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    c = np.zeros((len(columns),) * 2)
    for i, j in pairs:
        c[i, j] = c[j, i] = cov[f"c{i}_{j}"]
    values, vectors = np.linalg.eigh(c)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = int(np.searchsorted(np.cumsum(values) / values.sum(), variance - 1e-12) + 1)
    model = Pca(columns, mean, sd, vectors[:, :k], 1.0)
    model.threshold = pca_error(rows, model).agg(F.expr(f"percentile_cont({quantile}) within group (order by error)")).first()[0] or 1.0
    return model


def pca_error(wide: DataFrame, model: Pca) -> DataFrame:
    sq = sum((F.col(s) * F.col(s) for s in model.signals), F.lit(0.0))
    return _residuals(wide.where(~incomplete(model.signals)), model).select("ts", sq.alias("error"))


def pca_score(wide: DataFrame, model: Pca) -> DataFrame:
    """``ts, flag, score``: squared residual over the threshold."""
    return pca_error(wide, model).select("ts", (F.col("error") > model.threshold).cast("int").alias("flag"), (F.col("error") / model.threshold).alias("score"))


def pca_contributors(wide: DataFrame, model: Pca) -> DataFrame:
    long = series.long_form(_residuals(wide.where(~incomplete(model.signals)), model), "ts", model.signals)
    return contributors(long.withColumn("weight", F.abs("val")), "ts", "weight")


def feed_soak(df: DataFrame, ts: str, unit: str, tail_s: int) -> DataFrame:
    """One row: buckets missing inside the feed, its largest bucket, and gaps of more than ``tail_s`` seconds."""
    h = df.groupBy(F.date_trunc(unit, ts).alias("ts")).agg(F.count("*").alias("n"))
    missing = series.spine(df, ts, unit).join(h, "ts", "left_anti").agg(F.count("*").alias("missing"))
    gap = F.unix_timestamp("ts") - F.unix_timestamp(F.lag("ts").over(Window.orderBy("ts")))
    rest = h.withColumn("g", gap).agg(F.max("n").alias("peak"), F.count_if(F.col("g") > tail_s).alias("breaks"))
    return missing.crossJoin(F.broadcast(rest))
