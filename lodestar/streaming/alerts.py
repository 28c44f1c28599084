"""Streams: minute buckets with a watermark, and alert episodes with keyed state.

The episode processor folds rows with the same transition as the batch form,
so a finished stream and a batch over the same rows agree. Rows of a key are
ordered within a micro-batch; a row not later than the state's last time is
dropped.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lodestar.operators import episodes as ep


def minutes(events: DataFrame, late: str = "5 minutes") -> DataFrame:
    """Tumbling minute counts of a stream of ``ts, event_type, value``, closed ``late`` after their end."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", "1 minute"))
    failed = F.col("event_type") == "error"
    return w.agg(F.count_if(~failed).alias("n_ok"), F.count_if(failed).alias("n_err"), F.max("value").alias("top")).select(F.col("window.start").alias("ts"), "n_ok", "n_err", "top")


class Episodes(StatefulProcessor):
    """State of a key: the transition's state as JSON."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("episode", "state string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        s = ep.State(**json.loads(self.state.get()[0])) if self.state.exists() else ep.State()
        pdf = pd.concat(list(rows))
        if s.prev is not None:
            pdf = pdf[pdf["ts"].map(lambda t: t.timestamp()) > s.prev]
        if len(pdf):
            out = list(ep.fold(s, key[0], pdf["rule"].iloc[0], ep._clean(pdf)))
            self.state.update((json.dumps(asdict(s)),))
            if out:
                yield pd.DataFrame(out, columns=[c.split()[0] for c in ep.EPISODES.split(", ")])

    def close(self) -> None:
        pass


def closed_episodes(scores: DataFrame) -> DataFrame:
    """A stream of ``model, rule, ts, flag, score, breached`` -> episodes as they close."""
    return scores.groupBy("model").transformWithStateInPandas(Episodes(), ep.EPISODES, "Append", "None")


def upsert(path: str, key: list[str]):
    """A ``foreachBatch`` sink: each batch replaces rows of equal key in the table at ``path``."""
    from lodestar.sources.tables import merge_path

    def write(batch: DataFrame, _: int) -> None:
        merge_path(batch.sparkSession, path, batch, key)

    return write
