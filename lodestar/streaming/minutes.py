"""Minutes of a stream of events, closed by timers: empty ones are rows, the partial first one is not.

A feed is first heard of in the middle of a minute, which is skipped. Every
later minute is a row, whether it had events or not, once the watermark has
passed its end: events may come ``wait`` late, later ones are dropped. Timers
fire by the watermark of all feeds, so that a silent feed has its empty
minutes too.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

MINUTES = "feed string, ts timestamp, n_ok long, n_err long, top double"


def _events(events: DataFrame, feed: str) -> DataFrame:
    failed = F.coalesce(F.col("event_type") == "error", F.lit(False))
    return events.select(F.coalesce(F.col(feed).cast("string"), F.lit("\u0000")).alias("feed"), F.col("ts").cast("timestamp").alias("ts"), F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 60).alias("minute"), failed.alias("failed"), F.col("value").cast("double").alias("value"))


class Minutes(StatefulProcessor):
    """State of a feed: its first and last closed minute, and sums of each minute that is open."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.closed = handle.getValueState("closed", "first long, last long, timer long")
        self.open = handle.getMapState("open", "minute long", "n_ok long, n_err long, top double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first, last, timer = self.closed.get() if self.closed.exists() else (None, None, None)
        begun = last is not None and last > first
        ended = timerValues.getCurrentWatermarkInMs() // 60_000  # minutes before this one
        for pdf in rows:
            sums = pdf.assign(ok=~pdf["failed"]).groupby("minute").agg(n_ok=("ok", "sum"), n_err=("failed", "sum"), top=("value", "max"))
            for m, n_ok, n_err, top in sums.itertuples():
                m = int(m)
                if m < ended or (begun and m <= last):
                    continue  # too late
                # until a minute has been closed, one that comes later may be the first
                first = m if first is None else min(first, m)
                before = self.open.getValue((m,)) if self.open.containsKey((m,)) else (0, 0, None)
                known = [t for t in (before[2], top) if t is not None and t == t]
                self.open.updateValue((m,), (before[0] + int(n_ok), before[1] + int(n_err), max(known, default=None)))
        if first is None:
            return iter(())
        last = last if begun else first
        self._keep(first, last, timer)
        return iter(())

    def _keep(self, first: int, last: int, timer: int | None) -> None:
        at = (last + 2) * 60_000  # the end of the next minute to close
        if timer != at:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(at)
        self.closed.update((first, last, at))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        first, last, _ = self.closed.get()
        until = timerValues.getCurrentWatermarkInMs() // 60_000  # minutes before this one have ended
        out = []
        for m in range(last + 1, until):
            held = self.open.containsKey((m,))
            n_ok, n_err, top = self.open.getValue((m,)) if held else (0, 0, None)
            out.append((key[0], pd.Timestamp(m * 60, unit="s"), n_ok, n_err, top))
            if held:
                self.open.removeKey((m,))
        if self.open.containsKey((first,)):
            self.open.removeKey((first,))
        self._keep(first, max(last, until - 1), None)
        if out:
            yield pd.DataFrame(out, columns=["feed", "ts", "n_ok", "n_err", "top"]).astype({"top": "float64"})

    def close(self) -> None:
        pass


def closed_minutes(events: DataFrame, feed: str = "feed", wait: str = "5 minutes") -> DataFrame:
    """A stream of ``feed, ts, event_type, value`` -> ``feed, ts, n_ok, n_err, top`` as minutes close; a null feed is one feed."""
    e = _events(events.where(F.col("ts").isNotNull()), feed).withWatermark("ts", wait)
    out = e.groupBy("feed").transformWithStateInPandas(Minutes(), MINUTES, "Append", "EventTime")
    return out.withColumn("feed", F.nullif("feed", F.lit("\u0000")))


def minute_table(events: DataFrame, feed: str = "feed", wait: str = "5 minutes") -> DataFrame:
    """What the stream gives in the end, from a table: minutes that ended ``wait`` before the last event of all."""
    e = _events(events.where(F.col("ts").isNotNull()), feed).withColumn("minute", F.timestamp_seconds(F.col("minute") * 60))
    last = e.agg(F.date_trunc("minute", F.max("ts") - F.expr(f"interval {wait}")).alias("until"))
    known = e.groupBy("feed").agg(F.min("minute").alias("first"))
    whole = known.crossJoin(F.broadcast(last)).select("feed", F.expr("first + interval 1 minute").alias("a"), F.expr("until - interval 1 minute").alias("b")).where("a <= b")
    spine = whole.select("feed", F.explode(F.sequence("a", "b", F.expr("interval 1 minute"))).alias("ts"))
    sums = e.groupBy(F.col("feed").alias("f"), "minute").agg(F.count_if(~F.col("failed")).alias("n_ok"), F.count_if("failed").alias("n_err"), F.max("value").alias("top"))
    out = spine.join(sums, (F.col("feed") == F.col("f")) & (F.col("ts") == F.col("minute")), "left").fillna(0, ["n_ok", "n_err"])
    return out.select(F.nullif("feed", F.lit("\u0000")).alias("feed"), "ts", "n_ok", "n_err", "top")
