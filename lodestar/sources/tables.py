"""Table maintenance on immutable files: merge, tombstones, idempotent insert, split writes."""

from __future__ import annotations

import uuid
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def merge(target: DataFrame, source: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """(merged rows, counts of inserted, updated and unchanged); update only where a column differs, nulls equal.

    One full outer join on the key; keys are unique on both sides.
    """
    other = [c for c in target.columns if c not in key]
    t = target.select(*key, F.struct(*other).alias("__t"), F.lit(1).alias("__in_t"))
    s = source.select(*key, F.struct(*other).alias("__s"), F.lit(1).alias("__in_s"))
    j = t.join(s, key, "full_outer")
    fresh = F.col("__in_s").isNotNull()
    act = F.when(F.col("__in_t").isNull(), "insert").when(fresh & ~F.col("__t").eqNullSafe(F.col("__s")), "update").otherwise("keep")
    rows = j.select(*key, *[F.when(fresh, F.col("__s")[c]).otherwise(F.col("__t")[c]).alias(c) for c in other], act.alias("__act"))
    return rows.drop("__act").select(*target.columns), rows.groupBy(F.col("__act").alias("action")).count()


def swap_in(spark: SparkSession, fresh: str, path: str) -> None:
    """Put the finished folder ``fresh`` in the place of ``path``.

    The old folder is renamed away, the new one in, and only then is the old
    one deleted: a crash between leaves a whole table under one of the names
    ``path``, ``fresh`` or ``path-old-...``.
    """
    at = spark._jvm.org.apache.hadoop.fs.Path
    fs = at(path).getFileSystem(spark._jsc.hadoopConfiguration())
    old = at(f"{path}-old-{uuid.uuid4().hex}")
    had = fs.exists(at(path))
    if had and not fs.rename(at(path), old):
        raise OSError(f"cannot move {path}")
    if not fs.rename(at(fresh), at(path)):
        raise OSError(f"cannot move {fresh} to {path}")
    if had:
        fs.delete(old, True)


def merge_path(spark: SparkSession, path: str, source: DataFrame, key: list[str]) -> None:
    """Merge into a Parquet table at ``path`` (created if absent): new files beside, then swapped in."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    rows = merge(spark.read.schema(source.schema).parquet(path), source, key)[0] if fs.exists(hadoop) else source
    fresh = f"{path}-{uuid.uuid4().hex}"
    rows.write.parquet(fresh)
    swap_in(spark, fresh, path)


def tombstone(target: DataFrame, source: DataFrame, key: list[str], at: Column, column: str = "gone_ts") -> DataFrame:
    """Set ``column`` where the source no longer has the key; set marks stay, returning rows lose theirs."""
    seen = source.select(*key).distinct().withColumn("__here", F.lit(1))
    j = target.join(seen, key, "left")
    mark = F.when(F.col("__here").isNotNull(), None).otherwise(F.coalesce(F.col(column), at))
    return j.withColumn(column, mark).select(*target.columns)


def insert_missing(target: DataFrame, source: DataFrame, key: list[str]) -> DataFrame:
    """Target plus the source rows of new keys."""
    return target.unionByName(source.join(target.select(*key), key, "left_anti").select(*target.columns))


def split_write(df: DataFrame, routes: dict[str, tuple[Column, str]]) -> None:
    """Feed several tables from one input: name -> (condition, path). Cached once, written by route."""
    df = df.where(reduce(or_, [c for c, _ in routes.values()])).cache()
    try:
        for condition, path in routes.values():
            df.where(condition).write.mode("append").parquet(path)
    finally:
        df.unpersist()


def assert_columns(df: DataFrame, wanted: str) -> None:
    """Raise if any of the comma-separated columns is missing."""
    missing = [c for c in wanted.split(",") if c.strip().lower() not in {x.lower() for x in df.columns}]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
