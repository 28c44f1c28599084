"""Minutes closed by timers against a table, and runs that go on after a crash."""

import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lodestar.plans.monitoring import feeds
from lodestar.sources import progress
from lodestar.streaming import minutes

T0 = datetime(2024, 3, 1)
EVENT = "feed string, ts timestamp, event_type string, value double"


def streamed(spark, tmp_path, batches, name):
    for i, b in enumerate(batches):
        b.coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"{i:03d}"))
        for f in (tmp_path / "in" / f"{i:03d}").glob("*.parquet"):
            os.utime(f, (1_700_000_000 + 60 * i,) * 2)  # the source takes files by age
    source = spark.readStream.schema(batches[0].schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(tmp_path / "in" / "*"))
    q = minutes.closed_minutes(source).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(300)
    return spark.table(name)


def rows(df):
    return sorted(tuple(r) for r in df.select("feed", "ts", "n_ok", "n_err", "top").collect())


def test_stream_of_given_events_equals_table(spark, tmp_path):
    """Feeds with planted gaps, in batches; a silent feed's empty minutes come too."""
    e = feeds(spark.read.parquet("/root/testdata/sf0.001/events.parquet").where("ts >= '2024-01-02' and ts < '2024-01-04'")).select(*(c.split()[0] for c in EVENT.split(", ")))
    day = [e.where(f"floor(unix_timestamp(ts) / 21600) % 8 = {k}") for k in sorted({r[0] for r in e.select(F.expr("floor(unix_timestamp(ts) / 21600) % 8")).distinct().collect()}, key=lambda k: (k - 4) % 8)]
    order = sorted(day, key=lambda b: b.agg(F.min("ts")).first()[0])
    got = rows(streamed(spark, tmp_path, order, "given_minutes"))
    want = rows(minutes.minute_table(e))
    assert got == want and len(want) > 2000 and any(r[2] == r[3] == 0 for r in want)


def test_partial_first_minute_late_events_and_silence(spark, tmp_path):
    at = lambda m, s=0: T0 + timedelta(minutes=m, seconds=s)
    first = [("a", at(1, 30), "x", 1.0), ("a", at(2, 5), "error", 2.0), ("a", at(3), "x", None)]
    second = [("a", at(0, 59), "x", 9.0), ("b", at(4, 1), "x", 5.0), ("a", at(2, 50), "x", 7.0)]  # an earlier first minute, and one in time
    third = [("b", at(20), "x", 1.0), (None, at(20), "x", 1.0)]
    fourth = [("a", at(3, 30), "x", 99.0), ("b", at(40), "x", 3.0)]  # too late
    got = rows(streamed(spark, tmp_path, [spark.createDataFrame(b, EVENT) for b in (first, second, third, fourth)], "planted_minutes").where("feed is not null"))
    mine = {(f, (t - T0).seconds // 60): (n, e, top) for f, t, n, e, top in got}
    assert mine[("a", 1)] == (1, 0, 1.0) and mine[("a", 2)] == (1, 1, 7.0) and mine[("a", 3)] == (1, 0, None) and mine[("a", 4)] == (0, 0, None)
    assert ("a", 0) not in mine and ("b", 4) not in mine and mine[("b", 20)] == (1, 0, 1.0)
    assert sorted(m for f, m in mine if f == "a") == list(range(1, 35)) and sorted(m for f, m in mine if f == "b") == list(range(5, 35))


@pytest.fixture()
def features(spark):
    data = [(T0 + timedelta(minutes=m), None if m in (100, 2000) else float(m % 11)) for m in range(3000) if m % 97]
    return spark.createDataFrame(data, "ts timestamp, a double").cache()


def rule(df):
    return df.where("a is not null").select("ts", (F.col("a") > 8).cast("int").alias("flag"), F.col("a").alias("score"))


def test_three_runs_one_killed_equal_one(spark, features, tmp_path, monkeypatch):
    start, now = T0, T0 + timedelta(days=9)
    one = progress.ScoredTable(spark, str(tmp_path / "one"))
    assert progress.score_new(one, features, ["a"], rule, start, now, most=timedelta(days=30))
    many = progress.ScoredTable(spark, str(tmp_path / "many"))
    assert many.high_water() is None and progress.score_new(many, features, ["a"], rule, start, now)
    assert many.high_water() == T0 + timedelta(days=1)

    def killed(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m, pytest.raises(KeyboardInterrupt):
        m.setattr(many, "_rename", killed)  # all is written, nothing is committed
        progress.score_new(many, features, ["a"], rule, start, now)
    assert many.high_water() == T0 + timedelta(days=1)
    assert progress.score_all_new(many, features, ["a"], rule, start, now) == 2 and not progress.score_new(many, features, ["a"], rule, start, now)
    a, b = (sorted(map(tuple, t.read(progress.SCORED).collect())) for t in (one, many))
    assert a == b and len(a) == 3000 and sum(r[1] is None for r in a) == 31 + 2
    # the slower of two runs of one range adds nothing
    assert not many.commit(spark.createDataFrame([], progress.SCORED), T0, T0 + timedelta(days=1))


def test_young_incomplete_rows_wait(spark, features, tmp_path):
    t = progress.ScoredTable(spark, str(tmp_path / "t"))
    assert progress.score_new(t, features, ["a"], rule, T0, T0 + timedelta(minutes=103))
    assert t.high_water() == T0 + timedelta(minutes=100) and not progress.score_new(t, features, ["a"], rule, T0, T0 + timedelta(minutes=104))
    assert progress.score_new(t, features, ["a"], rule, T0, T0 + timedelta(minutes=106), most=timedelta(minutes=30))
    assert t.read(progress.SCORED).where(F.col("ts") == T0 + timedelta(minutes=100)).first().flag is None


def test_context_is_given_and_not_scored(spark, features, tmp_path):
    seen = []

    def window(df):
        seen.append(df.agg(F.min("ts")).first()[0])
        return rule(df)

    t = progress.ScoredTable(spark, str(tmp_path / "t"))
    progress.score_all_new(t, features, ["a"], window, T0, T0 + timedelta(days=9), context=timedelta(hours=2))
    assert seen[1] == T0 + timedelta(hours=22) and t.read(progress.SCORED).count() == 3000
