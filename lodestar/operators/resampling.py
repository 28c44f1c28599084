"""Permutation and bootstrap tests over tables, the same for any number of tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.operators.ranking import numbered
from lodestar.session import materialise

#: Units that are flipped in all ways, and flips of one task's row.
MOST_UNITS, BLOCK = 24, 1 << 12
#: Comparisons times units up to which their numbers are sent to every task; beyond, draws are joined with them.
SENT_NUMBERS = 2_000_000

# A prime below 2^31 and odd factors of a counter-based generator; x^5 is a bijection modulo this prime.
PRIME, FACTORS = 2**31 - 1, (1_000_003, 7_919, 69_069, 40_503)


def f1(tp, fp, fn):
    """Micro-F1 of counts as arrays; 1 where there is nothing to find and nothing was found."""
    all_ = 2 * tp + fp + fn
    return np.where(all_ > 0, 2 * tp / np.maximum(all_, 1), 1.0)


def permutation_test(counts: DataFrame) -> DataFrame:
    """``comparison, unit, a_tp, a_fp, a_fn, b_tp, b_fp, b_fn`` -> per comparison ``units, difference, extreme, total, p``.

    Exact and paired: in all 2^n ways the counts of a and b are swapped in some
    units; ``extreme`` ways leave the micro-F1 values at least as far apart as
    they are. Blocks of flips are rows dealt over tasks; within a block each flip
    differs from the one before in one unit (Gray code), so that sums are
    running ones. Null counts are 0; more than ``MOST_UNITS`` units are an error.
    """
    names = ("tp", "fp", "fn")
    pair = [F.coalesce(F.col(f"{s}_{k}").cast("long"), F.lit(0).cast("long")).alias(f"{s}_{k}") for s in "ab" for k in names]
    g = counts.groupBy("comparison").agg(F.array_sort(F.collect_list(F.struct("unit", *pair))).alias("u"))
    n = F.size("u")
    g = g.withColumn("u", F.when(n <= MOST_UNITS, F.col("u")).otherwise(F.raise_error(F.lit(f"more than {MOST_UNITS} units: 2^n flips are enumerated"))))
    blocks = g.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.pow(F.lit(2), n) - 1) / BLOCK).cast("long"))))
    dealt = blocks.select("comparison", n.cast("int").alias("n"), "block", *[F.col(f"u.{s}_{t}").alias(f"{s}_{t}") for s in "ab" for t in names])
    kind = dealt.schema["comparison"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            rows = batch.to_pydict()
            far, ways, diff = [], [], []
            for i, m in enumerate(rows["n"]):
                a, b = (np.array([rows[f"{s}_{k}"][i] for k in names], np.int64).reshape(3, m) for s in "ab")
                flip = np.arange(rows["block"][i] * BLOCK, min((rows["block"][i] + 1) * BLOCK, 2**m))
                gray = flip ^ (flip >> 1)
                start = ((gray[0] >> np.arange(m)) & 1).astype(bool)
                turned = np.zeros(len(flip), np.int64)
                if len(flip) > 1:  # the unit that flips is the number of trailing zeros
                    turned[1:] = np.log2(flip[1:] & -flip[1:]).astype(np.int64)
                up = np.where((gray >> turned) & 1, 1, -1)
                step = (b - a)[:, turned] * up if m else np.zeros((3, 1), np.int64)
                step[:, 0] = np.where(start, b, a).sum(1)
                mine = np.cumsum(step, axis=1)
                other = (a + b).sum(1)[:, None] - mine
                seen = abs(float(f1(*a.sum(1)) - f1(*b.sum(1))))
                far.append(int((np.abs(f1(*mine) - f1(*other)) >= seen - 1e-12).sum()))
                ways.append(len(flip))
                diff.append(float(f1(*a.sum(1)) - f1(*b.sum(1))))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(far, pa.int64()), pa.array(ways, pa.int64()), pa.array(diff, pa.float64())], ["comparison", "units", "extreme", "total", "difference"])

    each = dealt.repartition("comparison", "block").mapInArrow(run, f"comparison {kind}, units int, extreme long, total long, difference double")
    out = each.groupBy("comparison").agg(F.max("units").alias("units"), F.max("difference").alias("difference"), F.sum("extreme").alias("extreme"), F.sum("total").alias("total"))
    return out.withColumn("p", F.col("extreme") / F.col("total"))


def _fifth(x):
    """x^5 modulo the prime, in 64-bit whole numbers; of columns or arrays."""
    square = x * x % PRIME
    return square * square % PRIME * x % PRIME


def draw(resample, place, seed: int, n):
    """Which of ``n`` units resample number ``resample`` has at ``place``: a function of these numbers alone."""
    a, b, c, d = FACTORS
    x = _fifth((resample * a + place * b + seed) % PRIME)
    x = _fifth((x + resample * c) % PRIME)
    return _fifth((x + place * d) % PRIME) % n


def paired_bootstrap(values: DataFrame, resamples: int = 10_000, seed: int = 1, alpha: float = 0.05) -> DataFrame:
    """``comparison, unit, a, b`` -> per comparison ``units, difference, bound``: mean of a - b, and its one-sided lower bound.

    Units are numbered in order over all comparisons, and one draw of units is
    shared by every comparison; a unit that a comparison lacks, or that has a
    null, adds nothing to it. The bound is the interpolated ``alpha`` quantile of
    the resampled means. Resamples are dealt over tasks.
    """
    spark = values.sparkSession
    d = values.groupBy("comparison", "unit").agg(F.sum(F.col("a").cast("double") - F.col("b").cast("double")).alias("d"), F.count(F.col("a") - F.col("b")).alias("m"))
    units = values.select("unit").where("unit is not null").distinct()
    n = units.count()
    kind = values.schema["comparison"].dataType.simpleString()
    if not n:
        return spark.createDataFrame([], f"comparison {kind}, units long, difference double, bound double")
    unit = F.col("unit")
    part = F.floor(unit / 4096) if isinstance(values.schema["unit"].dataType, T.NumericType) else F.substring(unit.cast("string"), 1, 3)  # in the units' own order
    place = materialise(numbered(units, part, ["unit"], "i").select("unit", (F.col("i") - 1).alias("i")), "bootstrap-units")
    d = materialise(d.join(place, "unit").where("m > 0").select("comparison", "i", "d", "m"), "bootstrap-values")
    if d.select("comparison").distinct().count() * n <= SENT_NUMBERS:
        got = d.toArrow()
        names = sorted({x for x in got["comparison"].to_pylist()}, key=str)
        row = {c: k for k, c in enumerate(names)}
        of = np.array([row[c] for c in got["comparison"].to_pylist()], np.int64)
        total, count = np.zeros((2, len(names), n))
        total[of, got["i"].to_numpy()], count[of, got["i"].to_numpy()] = got["d"].to_numpy(), got["m"].to_numpy()

        def run(batches):
            j = np.arange(n, dtype=np.int64)
            for batch in batches:
                for r in batch.column(0).to_pylist():
                    times = np.bincount(draw(r, j, seed, n), minlength=n)
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(names), dtype=np.int32)), pa.array(total @ times), pa.array((count @ times).astype(np.int64))], ["c", "s", "m"])

        drawn = spark.range(resamples).mapInArrow(run, "c int, s double, m long")
        back = spark.createDataFrame([(k, c) for k, c in enumerate(names)], f"k int, comparison {kind}")
        drawn = drawn.join(F.broadcast(back), F.col("c") == F.col("k")).select("comparison", "s", "m")  # a row a comparison
    else:
        every = spark.range(resamples).withColumnRenamed("id", "r").withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
        times = every.groupBy("r", draw(F.col("r"), F.col("j"), seed, F.lit(n)).alias("at")).agg(F.count("*").alias("times"))
        drawn = times.join(d, F.col("at") == F.col("i")).groupBy("comparison", "r").agg(F.sum(F.col("d") * F.col("times")).alias("s"), F.sum(F.col("m") * F.col("times")).alias("m"))
    bound = drawn.groupBy("comparison").agg(F.expr(f"percentile_cont({alpha}) within group (order by try_divide(s, m))").alias("bound"))
    seen = d.groupBy("comparison").agg(F.sum("m").alias("units"), F.try_divide(F.sum("d"), F.sum("m")).alias("difference"))
    return seen.join(bound, "comparison").select("comparison", "units", "difference", "bound")
