"""Comparing tables and result sets: fingerprints, coverage, bag equality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fingerprint(df: DataFrame, name: str) -> DataFrame:
    """``t, n, fp``: row count and an order-free sum of row hashes."""
    h = F.conv(F.substring(F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in df.columns])), 1, 12), 16, 10).cast("decimal(38,0)")
    return df.agg(F.lit(name).alias("t"), F.count("*").alias("n"), F.coalesce(F.sum(h), F.lit(0)).cast("decimal(38,0)").cast("string").alias("fp"))


def coverage(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row: keys only left and only right (null keys match nothing)."""
    a = left.join(right, key, "left_anti").agg(F.count("*").alias("only_left"))
    b = right.join(left, key, "left_anti").agg(F.count("*").alias("only_right"))
    return a.crossJoin(F.broadcast(b))


def normal(value: Column, kind: str) -> Column:
    """A value as comparable text: numbers to two decimals, midnight as its date, text trimmed and folded."""
    if kind in ("timestamp", "timestamp_ntz"):
        return F.regexp_replace(F.date_format(value, "yyyy-MM-dd HH:mm:ss"), " 00:00:00$", "")
    if kind == "date":
        return F.date_format(value, "yyyy-MM-dd")
    if kind == "boolean":
        return value.cast("string")
    text = F.lower(F.trim(value.cast("string")))
    number = text.try_cast("decimal(30,6)")
    return F.when(number.isNotNull(), F.bround(number, 2).cast("string")).otherwise(text)


def normalised(df: DataFrame) -> DataFrame:
    kinds = dict(df.dtypes)
    return df.select(*[F.coalesce(normal(F.col(f"`{c}`"), kinds[c]), F.lit("\u0000null")).alias(f"c{i}") for i, c in enumerate(df.columns)])


def signatures(df: DataFrame) -> list[tuple]:
    """Of each column of a normalised table: an order-free signature of its bag of values."""
    row = df.agg(*[F.struct(F.count("*"), F.sum(F.xxhash64(c).cast("decimal(38,0)")), F.sum(F.hash(c).cast("decimal(38,0)"))).alias(c) for c in df.columns]).first()
    return [tuple(row[c]) for c in df.columns]


def same_bag(gold: DataFrame, result: DataFrame) -> bool:
    """Whether some distinct columns of ``result`` hold exactly the rows of ``gold``, in any order.

    Column signatures leave few assignments; each is decided by comparing bags
    of rows on the cluster. Only counts and signatures reach the driver.
    """
    g, r = normalised(gold), normalised(result)
    sg, sr = signatures(g), signatures(r)
    choices = [[j for j, s in enumerate(sr) if s == want] for want in sg]

    def assign(i: int, used: tuple[int, ...]):
        if i == len(choices):
            yield used
        else:
            for j in choices[i]:
                if j not in used:
                    yield from assign(i + 1, (*used, j))

    for columns in assign(0, ()):
        picked = r.select(*[F.col(f"c{j}").alias(f"c{i}") for i, j in enumerate(columns)])
        if g.exceptAll(picked).isEmpty():  # the counts are equal, so one direction decides
            return True
    return False


def same_sequence(gold: DataFrame, result: DataFrame, position: str) -> bool:
    """As ``same_bag``, with rows in the same order: both tables number their rows in ``position``."""
    return same_bag(gold.withColumn(position, F.col(position).cast("string")), result.withColumn(position, F.col(position).cast("string")))
