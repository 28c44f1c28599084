"""Scoring that goes on where the last run stopped, and adds nothing twice.

The table is a folder of parts, each named by the range of time it covers. A
run writes its part aside and renames it in: that one step commits both the
rows and the new high-water mark, which is the end of the last part. A run
that dies before leaves the table as it was, and the next one does it again.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_PART = re.compile(r"part-(\d{20})-(\d{20})$")


def _micros(t: datetime) -> int:
    return (t.replace(tzinfo=t.tzinfo or timezone.utc) - datetime(1970, 1, 1, tzinfo=timezone.utc)) // timedelta(microseconds=1)


class ScoredTable:
    """The table at ``path``; times are naive UTC."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._at = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._at(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def parts(self) -> list[tuple[int, int, str]]:
        """(first microsecond, one past the last, folder) of each committed part, in order."""
        if not self._fs.exists(self._at(self.path)):
            return []
        names = [s.getPath().toString() for s in self._fs.listStatus(self._at(self.path))]
        return sorted((int(m[1]), int(m[2]), n) for n in names if (m := _PART.search(n)))

    def high_water(self) -> datetime | None:
        """All before this time has been scored."""
        p = self.parts()
        return datetime(1970, 1, 1) + timedelta(microseconds=p[-1][1]) if p else None

    def read(self, schema) -> DataFrame:
        folders = [p[2] for p in self.parts()]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def commit(self, rows: DataFrame, begin: datetime, end: datetime) -> bool:
        """Add the rows of [begin, end) in one step; False if another run has been there first."""
        aside = f"{self.path}/_aside-{uuid.uuid4().hex}"
        rows.write.parquet(aside)
        name = self._at(f"{self.path}/part-{_micros(begin):020d}-{_micros(end):020d}")
        # a rename onto a folder that is there would go inside it
        if any(a <= _micros(begin) < b for a, b, _ in self.parts()) or self._fs.exists(name) or not self._rename(self._at(aside), name):
            self._fs.delete(self._at(aside), True)
            return False
        return True

    def _rename(self, a, b) -> bool:
        return self._fs.rename(a, b)


def next_range(features: DataFrame, columns: list[str], since: datetime | None, start: datetime, now: datetime, wait: timedelta, most: timedelta) -> tuple[datetime, datetime] | None:
    """[begin, end) that may be scored now: up to the newest row, at most ``most``, and not past an incomplete row younger than ``wait``."""
    begin = since or start
    missing = F.lit(False)
    for c in columns:
        missing = missing | F.col(c).isNull()
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    m = features.where(at >= _micros(begin)).agg(F.max(at).alias("newest"), F.min(F.when(missing & (at > _micros(now - wait)), at)).alias("stop")).first()
    if m.newest is None:
        return None
    end = datetime(1970, 1, 1) + timedelta(microseconds=m.newest + 1 if m.stop is None else m.stop)
    end = min(end, begin + most)
    return (begin, end) if end > begin else None


def score_new(table: ScoredTable, features: DataFrame, columns: list[str], score: Callable[[DataFrame], DataFrame], start: datetime, now: datetime, step: timedelta = timedelta(minutes=1), context: timedelta = timedelta(0), wait: timedelta = timedelta(minutes=5), most: timedelta = timedelta(days=1)) -> bool:
    """Score what is new and commit it; False if there is nothing to do.

    ``score`` is given the rows of the range and of the ``context`` before it,
    and returns ``ts, flag, score``. Steps of the range without a score, their
    row missing or incomplete, are rows with nulls.
    """
    found = next_range(features, columns, table.high_water(), start, now, wait, most)
    if found is None:
        return False
    begin, end = found
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    scored = score(features.where((at >= _micros(begin - context)) & (at < _micros(end)))).where((at >= _micros(begin)) & (at < _micros(end)))
    width = step // timedelta(microseconds=1)
    first = -(-_micros(begin) // width)
    steps = table.spark.range(first, max(first, -(-_micros(end) // width))).select(F.timestamp_micros(F.col("id") * width).alias("ts"))
    rows = steps.join(scored.select(F.col("ts").cast("timestamp").alias("s_ts"), "flag", F.col("score").cast("double").alias("score")), F.col("ts") == F.col("s_ts"), "full")
    return table.commit(rows.select(F.coalesce("ts", "s_ts").alias("ts"), F.col("flag").cast("int").alias("flag"), "score"), begin, end)


def score_all_new(table: ScoredTable, *args, **params) -> int:
    """Runs until nothing is new; how many there were."""
    runs = 0
    while score_new(table, *args, **params):
        runs += 1
    return runs


SCORED = "ts timestamp, flag int, score double"
