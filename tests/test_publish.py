"""A store that is away for a while."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from lodestar.sources.tables import merge_path
from lodestar.streaming.publish import Published, Publisher

T0 = datetime(2024, 3, 1)
ROW = "ts timestamp, feed string, n int"


def minutes(spark, *ms, n=1):
    return spark.createDataFrame([(T0 + timedelta(minutes=m), f, n) for m in ms for f in ("a", "b")], ROW)


def test_buffer_is_bounded_and_flushed_in_order(spark, tmp_path):
    sent, away = [], [True]

    def send(rows):
        if away[0]:
            raise OSError("away")
        sent.append([(int((r.ts - T0).total_seconds() // 60), r.feed, r.n) for r in rows.collect()])

    p = Publisher(spark, str(tmp_path / "b"), ROW, send, ["feed", "ts"], most=3)
    assert p.offer(minutes(spark, 2, 1)) == Published(0, 4, 0)
    assert p.offer(minutes(spark, 3, 2, n=5)) == Published(0, 6, 0)  # minute 2 anew
    assert p.offer(minutes(spark, 4)) == Published(0, 6, 2)  # minute 1 is dropped
    away[0] = False
    assert p.offer(minutes(spark, 5)) == Published(6, 0, 2)
    assert sent == [[(m, f, 5 if m == 3 else 1) for m in (3, 4, 5) for f in ("a", "b")]]
    assert p.pending().count() == 0 and p.offer(minutes(spark)) == Published(0, 0, 0)
    assert p.offer(minutes(spark, 9)) == Published(2, 0, 0) and len(sent) == 2


def test_crash_after_sending_adds_nothing_twice(spark, tmp_path):
    table = str(tmp_path / "t")
    p = Publisher(spark, str(tmp_path / "b"), ROW, lambda rows: merge_path(spark, table, rows, ["feed", "ts"]), ["feed", "ts"])
    keep = p._keep
    calls = []

    def killed(rows):
        calls.append(1)
        if len(calls) == 2:
            raise KeyboardInterrupt
        return keep(rows)

    p._keep = killed
    try:
        p.offer(minutes(spark, 1, 2))
    except KeyboardInterrupt:
        pass
    p._keep = keep
    assert p.pending().count() == 4
    p.offer(minutes(spark, 3))
    rows = spark.read.parquet(table)
    assert rows.count() == 6 and rows.groupBy("ts", "feed").count().where(F.col("count") > 1).count() == 0
