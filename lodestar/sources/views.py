"""Materialised views kept by partition: only what changed in the source is built again.

A view is a folder with one folder a build of a partition, and a map of which
build of each partition is the current one with the fingerprint of the source
rows it was built from. A refresh compares fingerprints, builds the partitions
that changed, and swaps in a new map: readers see the old view or the new one.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.sources.tables import swap_in

MAP = "part string, fingerprint string, build string"


def fingerprints(source: DataFrame, part: Column) -> DataFrame:
    """``part, fingerprint``: row count and order-free sums of two hashes of whole rows; a null part is ``\\N``."""
    row = F.struct(*[F.col(f"`{c}`") for c in source.columns])
    text = F.to_json(row, {"ignoreNullFields": "false"})
    g = source.groupBy(F.coalesce(part.cast("string"), F.lit("\\N")).alias("part"))
    total = lambda h: F.sum(h.cast("decimal(38,0)")).cast("string")
    return g.agg(F.concat_ws(":", F.count("*").cast("string"), total(F.xxhash64(text)), total(F.xxhash64(F.lit(1), text))).alias("fingerprint"))


class View:
    """A view at ``path``, whose partitions of source rows are told by ``part`` and built by ``build`` (of any number of partitions at once)."""

    def __init__(self, spark: SparkSession, path: str, part: Column, build: Callable[[DataFrame], DataFrame]):
        self.spark, self.path, self.part, self.build = spark, path.rstrip("/"), F.coalesce(part.cast("string"), F.lit("\\N")), build
        self._at = spark._jvm.org.apache.hadoop.fs.Path

    def _exists(self, path: str) -> bool:
        at = self._at(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def map(self) -> DataFrame:
        """``part, fingerprint, build`` of the current partitions."""
        return self.spark.read.schema(MAP).parquet(f"{self.path}/map") if self._exists(f"{self.path}/map") else self.spark.createDataFrame([], MAP)

    def refresh(self, source: DataFrame) -> tuple[int, int, int]:
        """(partitions built, left as they were, dropped). One pass for the fingerprints, one over the changed partitions."""
        now = fingerprints(source, self.part).withColumnRenamed("part", "n_part").withColumnRenamed("fingerprint", "n_fp")
        build = uuid.uuid4().hex
        both = self.map().join(now, F.col("part") == F.col("n_part"), "full")
        state = F.when(F.col("n_part").isNull(), "dropped").when(F.col("fingerprint") == F.col("n_fp"), "kept").otherwise("built")
        # a row a partition of the source
        which = F.when(state == "kept", F.col("build")).otherwise(F.lit(build))
        fresh = both.select(state.alias("state"), F.coalesce("n_part", "part").alias("part"), F.coalesce("n_fp", "fingerprint").alias("fingerprint"), which.alias("build"))
        aside = f"{self.path}/_map-{build}"
        fresh.write.parquet(aside)
        fresh = self.spark.read.schema(f"state string, {MAP}").parquet(aside)
        counts = {r.state: r["count"] for r in fresh.groupBy("state").count().collect()}
        if counts.get("built"):
            changed = fresh.where("state = 'built'").select(F.col("part").alias("__part"))
            rows = source.withColumn("__of", self.part).join(changed, F.col("__of") == F.col("__part"), "left_semi").drop("__of")
            self.build(rows).write.parquet(f"{self.path}/build-{build}")
        if counts.get("built") or counts.get("dropped"):
            new = f"{self.path}/_new-{build}"
            fresh.where("state <> 'dropped'").select("part", "fingerprint", "build").write.parquet(new)
            swap_in(self.spark, new, f"{self.path}/map")
        return counts.get("built", 0), counts.get("kept", 0), counts.get("dropped", 0)

    def read(self, part: Column) -> DataFrame:
        """The view; ``part`` tells the partition of a row of the view. Of each build only partitions that are current are read."""
        current = self.map().select(F.col("part").alias("__p"), F.col("build").alias("__b"))
        builds = [r[0] for r in current.select("__b").distinct().collect()]  # a row a refresh that is still in use
        if not builds:
            raise ValueError("the view has not been built")
        rows = self.spark.read.parquet(*[f"{self.path}/build-{b}" for b in builds]).select("*", F.regexp_extract("_metadata.file_path", "build-([0-9a-f]{32})", 1).alias("__of"), F.coalesce(part.cast("string"), F.lit("\\N")).alias("__part"))
        return rows.join(current, (F.col("__of") == F.col("__b")) & (F.col("__part") == F.col("__p")), "left_semi").drop("__of", "__part")
