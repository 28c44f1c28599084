"""Exact and interval statistics: small helpers on counts, and their Spark expressions."""

from __future__ import annotations

from math import comb, floor, sqrt

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def mcnemar_exact_p(b: int, c: int) -> float:
    """Two-sided exact McNemar test of b and c discordant pairs."""
    n = b + c
    return min(1.0, 2 * sum(comb(n, i) for i in range(min(b, c) + 1)) / 2**n) if n else 1.0


def mcnemar_p(b: Column, c: Column) -> Column:
    """The same as a Spark expression, by a recurrence over binomial terms; n up to about 1000."""
    n, low = (b + c).cast("int"), F.least(b, c).cast("int")
    zero = F.struct(F.pow(F.lit(0.5), n).alias("term"), F.lit(0.0).alias("total"))

    def step(acc, i):
        return F.struct((acc["term"] * (n - i) / (i + 1)).alias("term"), (acc["total"] + acc["term"]).alias("total"))

    return F.least(F.lit(1.0), 2 * F.aggregate(F.sequence(F.lit(0), low), zero, step, lambda a: a["total"]))


def wilson(successes: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """Wilson interval of a rate (null for n = 0)."""
    p = F.try_divide(successes, n)
    mid, spread = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return (mid - spread) / (1 + z * z / n), (mid + spread) / (1 + z * z / n)


def wilson_interval(successes: int, n: int, z: float = 1.959963984540054) -> tuple[float, float]:
    p = successes / n
    mid, spread, scale = p + z * z / (2 * n), z * sqrt(p * (1 - p) / n + z * z / (4 * n * n)), 1 + z * z / n
    return (mid - spread) / scale, (mid + spread) / scale


def holm(p: list[float]) -> list[float]:
    """Holm-adjusted p-values, in the order given."""
    out, most = [0.0] * len(p), 0.0
    for k, i in enumerate(sorted(range(len(p)), key=p.__getitem__)):
        most = max(most, min(1.0, (len(p) - k) * p[i]))
        out[i] = most
    return out


def holm_adjusted(df: DataFrame, p: str, family: list[str], out: str = "p_holm") -> DataFrame:
    """Adds Holm-adjusted p-values within each family: a running maximum of one window."""
    from pyspark.sql.window import Window

    w = Window.partitionBy(*family).orderBy(p)
    m = F.count("*").over(Window.partitionBy(*family))
    step = df.withColumn("__s", F.least(F.lit(1.0), (m - F.row_number().over(w) + 1) * F.col(p)))
    return step.withColumn(out, F.max("__s").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__s")


def tie_chance(above: int, tied: int, wanted_above: int, wanted_tied: int, k: int = 3) -> float:
    """Chance that a wanted signal is among the top k if ties at the edge are broken at random.

    ``above`` signals rank strictly before the tied group, ``wanted_above`` of
    them wanted; ``wanted_tied`` of the ``tied`` ones are wanted.
    """
    if wanted_above:
        return 1.0
    places = k - above
    if places <= 0 or not wanted_tied:
        return 0.0
    return 1.0 if places >= tied else 1 - comb(tied - wanted_tied, places) / comb(tied, places)


def percentile(values: list[float], q: float) -> float:
    """Linear interpolation between order statistics."""
    s = sorted(values)
    at = (len(s) - 1) * q / 100
    low = floor(at)
    return s[low] + (s[min(low + 1, len(s) - 1)] - s[low]) * (at - low)


def f1(counts: list[tuple[int, int, int]]) -> float:
    tp, fp, fn = (sum(c[i] for c in counts) for i in range(3))
    return 2 * tp / (2 * tp + fp + fn) if tp + fp + fn else 1.0


def permutation_p(spark, a: list[tuple[int, int, int]], b: list[tuple[int, int, int]]) -> float:
    """Exact paired test on micro-F1: all 2^n sign flips as Spark rows; share at least as far apart as observed."""
    n = len(a)
    if n > 24:
        raise ValueError("2^n flips are enumerated")
    bit = [F.shiftright("id", i).bitwiseAND(F.lit(1)) for i in range(n)]

    def side(flip: int, k: int) -> Column:
        x, y = (a, b) if not flip else (b, a)
        return sum((F.when(bit[i] == 0, x[i][k]).otherwise(y[i][k]) for i in range(n)), F.lit(0))

    def score(flip: int) -> Column:
        tp, fp, fn = (side(flip, k) for k in range(3))
        return F.when(tp + fp + fn == 0, 1.0).otherwise(2 * tp / (2 * tp + fp + fn))

    seen = abs(f1(a) - f1(b))
    far = F.abs(score(0) - score(1)) >= F.lit(seen - 1e-12)
    return spark.range(2**n).agg(F.avg(far.cast("double"))).first()[0]


def paired_bootstrap(a: np.ndarray, b: np.ndarray, resamples: int = 10_000, seed: int = 1, alpha: float = 0.05) -> tuple[float, float]:
    """Mean difference a - b and its one-sided lower bound, one draw shared by both."""
    d = np.asarray(a, float) - np.asarray(b, float)
    draw = np.random.default_rng(seed).integers(0, len(d), (resamples, len(d)))
    return float(d.mean()), float(np.percentile(d[draw].mean(1), 100 * alpha))


def lehmer(seed: int) -> int:
    """Next state of the minimal standard generator."""
    return seed * 48271 % (2**31 - 1)


def lehmer_sample(seed: int, n: int) -> list[float]:
    out = []
    for _ in range(n):
        seed = lehmer(seed)
        out.append(seed / (2**31 - 1))
    return out
