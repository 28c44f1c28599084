"""Session helpers: where durable intermediate tables go, and batch bounds."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Only a plain local session (one machine) may fall back to a temporary
    folder; on a cluster the setting is required.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lodestar-")
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def materialise(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts lineage without tying rows to any executor's disk: a lost executor
    costs nothing that was already written.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lodestar/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def measured(df: DataFrame, name: str = "step", **metrics: Column) -> tuple[DataFrame, dict]:
    """``materialise``, and aggregates of the rows written, which the writing tasks take along: no job reads them again."""
    seen = Observation()
    out = materialise(df.observe(seen, *[c.alias(k) for k, c in metrics.items()]), name)
    return out, seen.get


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Bound the rows of one Arrow batch, since documents may be very long."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows or int(spark.conf.get(key)) <= 0:
        spark.conf.set(key, str(rows))
