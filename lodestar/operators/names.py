"""Names that are nearly the same, without comparing all pairs.

Two names within k edits (a letter dropped, added, changed, or two neighbours
swapped) have a common text after at most k letters are dropped from each. So
each name is listed under all its shortened forms, names that meet under one
are candidates, and the distance decides.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Cells of the table of distances that a task holds at once.
CELLS = 4_000_000


def shortened(name: Column, k: int) -> Column:
    """All texts left when up to ``k`` letters are dropped, the name itself among them."""
    drop = lambda v: F.transform(F.sequence(F.lit(1), F.length(v)), lambda i: F.concat(F.substring(v, F.lit(1), i - 1), F.substring(v, i + 1, F.length(v))))
    levels = [F.array(name)]
    for _ in range(k):
        levels.append(F.array_distinct(F.flatten(F.transform(F.filter(levels[-1], lambda v: F.length(v) > 0), drop))))
    return F.array_distinct(reduce(F.concat, levels))


def osa_distances(a: list[str], b: list[str]) -> np.ndarray:
    """Optimal string alignment distance of each pair, all pairs of a slice at once."""
    out = np.zeros(len(a), np.int32)
    order = np.argsort([len(x) + len(y) for x, y in zip(a, b, strict=True)], kind="stable")
    at = 0
    while at < len(order):
        wide = max(len(a[order[at]]), len(b[order[at]])) + 1
        own = order[at : at + max(1, CELLS // (wide * 8))]
        wide = max(max(len(a[i]), len(b[i])) for i in own) + 1
        own = own[: max(1, CELLS // wide)]
        at += len(own)
        x, y = (np.full((len(own), max(len(v[i]) for i in own) + 1), fill, np.int64) for v, fill in ((a, -1), (b, -2)))
        size = np.array([[len(a[i]), len(b[i])] for i in own])
        for row, i in enumerate(own):
            x[row, : len(a[i])] = [ord(c) for c in a[i]]
            y[row, : len(b[i])] = [ord(c) for c in b[i]]
        before = None
        last = np.tile(np.arange(y.shape[1], dtype=np.int32)[:, None], len(own))
        done = np.where(size[:, 0] == 0, size[:, 1], 0).astype(np.int32)
        for i in range(1, x.shape[1]):
            now = np.empty_like(last)
            now[0] = i
            for j in range(1, y.shape[1]):
                now[j] = np.minimum(np.minimum(last[j], now[j - 1]) + 1, last[j - 1] + (x[:, i - 1] != y[:, j - 1]))
                if i > 1 and j > 1:
                    swapped = (x[:, i - 1] == y[:, j - 2]) & (x[:, i - 2] == y[:, j - 1])
                    now[j] = np.where(swapped, np.minimum(now[j], before[j - 2] + 1), now[j])
            ended = np.flatnonzero(size[:, 0] == i)
            done[ended] = now[size[ended, 1], ended]
            before, last = last, now
        out[own] = done
    return out


def _one_apart(n: DataFrame) -> DataFrame:
    """``a, b``: pairs of names one edit apart, told by which letter of which place is dropped.

    Names that leave one text when the same place is dropped differ in that
    letter; when the same letter of neighbouring places is dropped, in a swap;
    and a name that is left itself is a letter shorter. Each is an equality, so
    no pair is made that has to be compared. Forms are many times as many as
    names, which Spark's estimate of their size does not tell: no side is broadcast.
    """
    at = F.explode(F.sequence(F.lit(1), F.length("name"))).alias("at")
    drops = n.where(F.length("name") > 0).select("name", at)
    form = F.concat(F.substring("name", F.lit(1), F.col("at") - 1), F.substring(F.col("name"), F.col("at") + 1, F.length("name")))
    drops = drops.select("name", "at", form.alias("form"), F.substring(F.col("name"), F.col("at"), F.lit(1)).alias("letter"))
    other = drops.select(F.col("name").alias("o_name"), F.col("at").alias("o_at"), F.col("form").alias("o_form"), F.col("letter").alias("o_letter")).hint("merge")
    same = F.col("form") == F.col("o_form")
    changed = drops.join(other, same & (F.col("at") == F.col("o_at")) & (F.col("name") < F.col("o_name")))
    swapped = drops.join(other, same & (F.col("letter") == F.col("o_letter")) & (F.col("at") + 1 == F.col("o_at")))
    shorter = drops.join(n.select(F.col("name").alias("o_name")).hint("merge"), F.col("form") == F.col("o_name"))
    pairs = [d.select("name", "o_name") for d in (changed, swapped, shorter)]
    either = reduce(DataFrame.union, pairs).where("name <> o_name")
    return either.select(F.least("name", "o_name").alias("a"), F.greatest("name", "o_name").alias("b")).distinct()


def near_names(names: DataFrame, column: str, k: int = 1) -> DataFrame:
    """``a, b, distance``: pairs of different names (a before b) at most ``k`` edits apart.

    Names are distinct texts, compared as they are; nulls are none. The work
    is in proportion to the names times the shortened forms of each, and a form
    is shared by names that are within ``2 k`` edits only.
    """
    n = names.select(F.col(column).cast("string").alias("name")).where("name is not null").distinct()
    if k == 1:
        return _one_apart(n).withColumn("distance", F.lit(1))
    under = n.select("name", F.explode(shortened(F.col("name"), k)).alias("form"))
    pairs = under.select(F.col("name").alias("a"), "form").join(under.select(F.col("name").alias("b"), "form").hint("merge"), "form").where("a < b").select("a", "b").distinct()

    @F.pandas_udf("int")
    def distance(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(osa_distances(a.tolist(), b.tolist()))

    return pairs.withColumn("distance", distance("a", "b")).where(F.col("distance") <= k)
