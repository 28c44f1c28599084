"""Publishing minutes to a store that may be away: a bounded buffer, flushed in order and in one step.

Rows that cannot be sent are kept in the shared folder, the newest ``most``
minutes of them; when the store is back, all that is pending goes out with the
new rows, ordered by time, in one call. The buffer is emptied only after that
call; a crash between leaves rows that are sent again, so the store must take
a row it has (``tables.merge_path`` does).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.sources.tables import swap_in


@dataclass
class Published:
    sent: int
    kept: int
    dropped: int


class Publisher:
    """Keeps pending rows of ``schema`` (with a time ``ts`` and a ``key``) at ``path``; ``send`` takes rows in order or raises."""

    def __init__(self, spark: SparkSession, path: str, schema, send: Callable[[DataFrame], None], key: list[str], most: int = 120):
        if most < 1:
            raise ValueError("the buffer holds one minute at least")
        self.spark, self.path, self.schema, self.send, self.key, self.most = spark, path.rstrip("/"), schema, send, key, most
        at = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        self._there = lambda: at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)

    def pending(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path) if self._there() else self.spark.createDataFrame([], self.schema)

    def _keep(self, rows: DataFrame) -> DataFrame:
        fresh = f"{self.path}-{uuid.uuid4().hex}"
        rows.write.parquet(fresh)
        swap_in(self.spark, fresh, self.path)
        return self.pending()

    def offer(self, batch: DataFrame) -> Published:
        """Send the pending rows and these. A row offered again replaces the one that waits; rows without a time are left out."""
        new = batch.select(*self.pending().columns).where(F.col("ts").isNotNull())
        old = self.pending().join(new.select(*self.key), self.key, "left_anti").select(*new.columns)
        rows = self._keep(old.unionByName(new))  # safe before anything is tried
        minute = F.date_trunc("minute", "ts")
        newest = rows.select(minute.alias("m")).distinct().orderBy(F.desc("m")).limit(self.most).agg(F.min("m").alias("m")).first().m
        total = rows.count()
        if newest is None:
            return Published(0, 0, 0)
        fits = rows.where(minute >= newest)
        n = fits.count()
        try:
            self.send(fits.orderBy("ts", *self.key))
        except Exception:  # whatever the store raises, the rows wait
            if n < total:
                self._keep(fits)
            return Published(0, n, total - n)
        self._keep(rows.where("1 = 0"))
        return Published(n, 0, total - n)

    def batch(self, rows: DataFrame, _: int) -> None:
        """For ``writeStream.foreachBatch``."""
        self.offer(rows)
