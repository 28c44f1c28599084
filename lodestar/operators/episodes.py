"""Alert episodes: state machine over ranges of time and over streams, grading, attribution.

State of a key: last time, consecutive flags, unflagged rows, run length of
each breached signal, and the open episode. A row flagged 1 advances the runs;
0 and null end them. An episode opens at 1 flag, 3 consecutive flags, or the
same signal in 3 consecutive flagged rows, by rule; it extends with every
flagged row and closes at 10 unflagged rows. A gap of over 90 seconds ends the
runs but neither closes an episode nor resets its unflagged rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict, dataclass, field, replace

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from lodestar.functions.stats import mcnemar_exact_p
from lodestar.operators import halo, intervals
from lodestar.session import materialise

GAP_S, CLOSE_AFTER, OPEN_AT, RUN_CAP = 90, 10, 3, 3
#: How each rule opens: after one flag, after consecutive flags, or by one signal's run.
SINGLE, CONSECUTIVE, SAME_SIGNAL = "single", "consecutive", "same_signal"
EPISODES = "model string, episode_no int, start_ts timestamp, last_ts timestamp, end_ts timestamp, status string, peak_score double, fired string"


def runs_next(runs: dict[str, int], breached: str | None) -> dict[str, int]:
    """Run lengths after a row that breached these signals; a repeated name counts once."""
    names = dict.fromkeys(s for s in (breached or "").split(",") if s)
    return {s: min(RUN_CAP, runs.get(s, 0) + 1) for s in names}


def runs_max(runs: dict[str, int]) -> int:
    return max(runs.values(), default=0)


def runs_fired(runs: dict[str, int], breached: str | None) -> str | None:
    """Signals of this row whose run is long enough, in order of the row."""
    names = dict.fromkeys(s for s in (breached or "").split(",") if s)
    return ",".join(s for s in names if runs.get(s, 0) >= RUN_CAP) or None


@dataclass
class State:
    prev: float | None = None
    consecutive: int = 0
    unflagged: int = 0
    count: int = 0
    runs: dict[str, int] = field(default_factory=dict)
    start: float | None = None
    last: float | None = None
    peak: float | None = None
    fired: str | None = None

    def row(self, model: str, status: str, end: float | None) -> tuple:
        stamp = lambda t: None if t is None else pd.Timestamp(t, unit="s")
        return (model, self.count, stamp(self.start), stamp(self.last), stamp(end), status, self.peak, self.fired)


def advance(s: State, rule: str, ts: float, flag: int | None, score: float | None, breached: str | None) -> bool:
    """Fold one row, in order of time, into the state; True if an open episode closes at this row."""
    if s.prev is not None and ts - s.prev > GAP_S:
        s.consecutive, s.runs = 0, {}
    s.prev = ts
    if flag == 1:
        s.runs = runs_next(s.runs, breached)
        s.consecutive = runs_max(s.runs) if rule == SAME_SIGNAL else s.consecutive + 1
        if s.start is not None:
            s.last, s.unflagged = ts, 0
            s.peak = score if s.peak is None else s.peak if score is None else max(s.peak, score)
        elif s.consecutive >= (1 if rule == SINGLE else OPEN_AT):
            s.start = s.last = ts
            s.count, s.unflagged, s.peak = s.count + 1, 0, score
            s.fired = runs_fired(s.runs, breached) if rule == SAME_SIGNAL else None
        return False
    s.consecutive, s.runs = 0, {}
    if s.start is None:
        return False
    s.unflagged += 1
    return s.unflagged >= CLOSE_AFTER


def close(s: State) -> None:
    s.start = s.last = s.peak = s.fired = None
    s.unflagged = 0


def fold(s: State, model: str, rule: str, rows: Iterator[tuple]) -> Iterator[tuple]:
    """Rows ``(ts seconds, flag, score, breached)`` -> closed episodes; the state keeps an open one."""
    for ts, flag, score, breached in rows:
        if advance(s, rule, ts, flag, score, breached):
            yield s.row(model, "CLOSED", ts)
            close(s)


def _clean(pdf: pd.DataFrame) -> Iterator[tuple]:
    pdf = pdf.sort_values("ts")
    ok = lambda v: None if pd.isna(v) else v
    for ts, flag, score, breached in zip(pdf["ts"], pdf["flag"], pdf["score"], pdf["breached"], strict=True):
        yield ts.timestamp(), ok(flag), ok(score), ok(breached)


#: Length of a range of time that one task folds, and ranges that one task combines.
RANGE_S, FAN = 6 * 3600, 256


def flagged_runs(scores: DataFrame, gap_s: float = GAP_S, range_s: float = RANGE_S) -> DataFrame:
    """``model, rule, ts, flag, score, range, runs, longest, fired, opens`` of each row.

    ``runs`` has the run length of each signal this row breached, at most
    ``RUN_CAP``, ``longest`` their maximum, ``fired`` those at the cap in order
    of the row, and ``opens`` tells whether the row opens an episode if none is
    open. All of it follows from a row and the two before it, if these follow
    within ``gap_s``: ranges of time with a halo, and window functions within.
    A null flag ends runs as 0 does; rows without a time are left out.
    """
    names = F.array_distinct(F.filter(F.split(F.coalesce("breached", F.lit("")), ","), lambda x: x != ""))
    rows = scores.select("model", "rule", F.col("ts").cast("timestamp").alias("ts"), "flag", "score", "breached", names.alias("names"))
    rows = halo.ranges(rows, "ts", range_s, (RUN_CAP - 1) * gap_s)
    w = Window.partitionBy("model", "range").orderBy("ts", F.desc_nulls_last("flag"), "score", "breached")
    here = F.struct(F.col("ts"), (F.col("flag") == 1).alias("up"), F.col("names"))
    rows = rows.withColumn("b1", F.lag(here, 1).over(w)).withColumn("b2", F.lag(here, 2).over(w)).where("own")
    apart = lambda x, y: halo.seconds(x) - halo.seconds(y)
    up = F.coalesce(F.col("flag") == 1, F.lit(False))
    one = F.coalesce(F.col("b1.up") & (apart(F.col("ts"), F.col("b1.ts")) <= gap_s), F.lit(False))
    two = one & F.coalesce(F.col("b2.up") & (apart(F.col("b1.ts"), F.col("b2.ts")) <= gap_s), F.lit(False))
    follows = lambda s: one & F.array_contains("b1.names", s)
    length = lambda s: F.when(follows(s) & two & F.array_contains("b2.names", s), 3).when(follows(s), 2).otherwise(1)
    runs = F.when(up, F.transform("names", lambda s: F.struct(s.alias("signal"), length(s).alias("n")))).otherwise(F.array().cast("array<struct<signal: string, n: int>>"))
    rows = rows.select("model", "rule", "ts", "flag", "score", "range", up.alias("up"), one.alias("one"), two.alias("two"), runs.alias("r"))
    longest = F.coalesce(F.array_max(F.col("r.n")), F.lit(0))
    fired = F.nullif(F.array_join(F.filter("r", lambda x: x["n"] >= RUN_CAP)["signal"], ","), F.lit(""))
    opens = F.col("up") & F.when(F.col("rule") == SINGLE, True).when(F.col("rule") == SAME_SIGNAL, longest >= OPEN_AT).otherwise(F.col("two"))
    return rows.select("model", "rule", "ts", "flag", "score", "range", F.map_from_entries("r").alias("runs"), longest.alias("longest"), fired.alias("fired"), opens.alias("opens"))


@dataclass
class Open:
    """An open episode; ``carried`` if it was open at the entry of a range, whose start is then unknown."""

    unflagged: int
    start: float | None
    last: float | None
    peak: float | None
    fired: str | None
    number: int
    carried: bool = False


@dataclass
class Effect:
    """What a range of rows does to the machine, whatever state it enters in.

    ``lead`` unflagged rows come first (counted to the closing number). Entered
    without an open episode it leaves ``calm`` (None or an open episode) after
    ``calm_n`` openings. Entered with an open episode that lives to the first
    flag, it leaves ``live`` after ``live_n`` openings; ``flagged`` tells whether
    there is a flag at all.
    """

    lead: int
    flagged: bool
    calm: Open | None = None
    calm_n: int = 0
    live: Open | None = None
    live_n: int = 0


Entry = tuple[Open | None, int]


def _higher(a: float | None, b: float | None) -> float | None:
    return b if a is None else a if b is None else max(a, b)


def enter(e: Effect, state: Entry, close_after: int) -> Entry:
    """State after a range, from that before it: ``(open episode or None, episodes opened so far)``."""
    held, count = state
    if held is not None and e.lead + held.unflagged < close_after:
        if not e.flagged:
            return replace(held, unflagged=held.unflagged + e.lead), count
        end, n = e.live, e.live_n
        if end is not None and end.carried:
            return replace(held, unflagged=end.unflagged, last=end.last, peak=_higher(held.peak, end.peak)), count
    else:
        end, n = e.calm, e.calm_n
    return (None if end is None else replace(end, number=end.number + count)), count + n


def compose(a: Effect, b: Effect, close_after: int) -> Effect:
    """The effect of a range followed by another."""
    calm, calm_n = enter(b, (a.calm, a.calm_n), close_after)
    if not a.flagged:
        return Effect(min(close_after, a.lead + b.lead), b.flagged, calm, calm_n, b.live, b.live_n)
    live, live_n = enter(b, (a.live, a.live_n), close_after)
    return Effect(a.lead, True, calm, calm_n, live, live_n)


def machine(rows: Iterator[tuple], state: Entry, close_after: int, closed=None) -> Entry:
    """Rows ``(ts, up, opens, score, fired)`` in order; ``closed(episode, end)`` is told of each closing."""
    held, count = state
    for ts, up, opens, score, fired in rows:
        if held is None:
            if opens:
                count += 1
                held = Open(0, ts, ts, score, fired, count)
        elif up:
            held.last, held.unflagged, held.peak = ts, 0, _higher(held.peak, score)
        else:
            held.unflagged += 1
            if held.unflagged >= close_after:
                if closed is not None:
                    closed(held, ts)
                held = None
    return held, count


def effect(rows: list[tuple], close_after: int) -> Effect:
    """The effect of a range: its rows from no episode, and from one that is open at the first flag."""
    first = next((i for i, r in enumerate(rows) if r[1]), len(rows))
    e = Effect(min(first, close_after), first < len(rows))
    e.calm, e.calm_n = machine(iter(rows), (None, 0), close_after)
    if e.flagged:
        e.live, e.live_n = machine(iter(rows[first:]), (Open(0, None, None, None, None, 0, True), 0), close_after)
    return e


_OPEN = "struct<unflagged: int, start: double, last: double, peak: double, fired: string, number: int, carried: boolean>"
_EFFECT = f"model string, range long, lead int, flagged boolean, calm {_OPEN}, calm_n int, live {_OPEN}, live_n int"
_ENTRY = f"model string, range long, held {_OPEN}, count int, final boolean"


def _none(v):
    return None if v is None or v != v else v


def _rows(table: pa.Table) -> list[tuple]:
    d = table.sort_by([("ts", "ascending"), ("up", "descending"), ("score", "ascending"), ("fired", "ascending")]).to_pydict()
    return list(zip(d["at"], d["up"], d["opens"], map(_none, d["score"]), d["fired"], strict=True))


def _open(d: dict | None) -> Open | None:
    return None if d is None else Open(**d)


def _effects(table: pa.Table) -> list[tuple[int, Effect]]:
    return sorted(((d["range"], Effect(d["lead"], d["flagged"], _open(d["calm"]), d["calm_n"], _open(d["live"]), d["live_n"])) for d in table.to_pylist()), key=lambda x: x[0])


def _as_table(rows: list[dict], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_pylist(rows, schema)


def entries(effects: DataFrame, close_after: int = CLOSE_AFTER, fan: int = FAN) -> DataFrame:
    """``model, range, held, count, final``: the state in which each range is entered, by a scan over blocks of ranges.

    ``fan`` consecutive ranges are composed into one effect, these again, until
    one block holds all of time; then the states go back down, block by block.
    No task sees more than ``fan`` effects of a model.
    """
    kinds = {k: to_arrow_schema(StructType.fromDDL(v)) for k, v in (("effect", _EFFECT), ("entry", _ENTRY))}
    ends = effects.agg(F.min("range").alias("a"), F.max("range").alias("b")).first()
    levels = [effects]
    low, high = (0, 0) if ends.a is None else (ends.a, ends.b)

    def composed(key, table):
        found = _effects(table)
        e = found[0][1]
        for _, other in found[1:]:
            e = compose(e, other, close_after)
        return _as_table([{"model": key[0].as_py(), "range": key[1].as_py(), **asdict(e)}], kinds["effect"])

    def down(key, mine, above):
        top = above.to_pylist()[0] if above.num_rows else {"held": None, "count": 0, "final": True}
        state, found, out = (_open(top["held"]), top["count"]), _effects(mine), []
        for i, (at, e) in enumerate(found):
            out.append({"model": key[0].as_py(), "range": at, "held": None if state[0] is None else asdict(state[0]), "count": state[1], "final": top["final"] and i == len(found) - 1})
            state = enter(e, state, close_after)
        return _as_table(out, kinds["entry"])

    block = F.floor(F.col("range") / fan).cast("long").alias("block")
    while low // fan != high // fan:
        levels.append(materialise(levels[-1].groupBy("model", block).applyInArrow(composed, _EFFECT), "episode-effects"))
        low, high = low // fan, high // fan
    found = effects.sparkSession.createDataFrame([], _ENTRY)
    for level in reversed(levels):
        found = materialise(level.groupBy("model", block).cogroup(found.groupBy("model", "range")).applyInArrow(down, _ENTRY), "episode-entries")
    return found


def episodes(scores: DataFrame, gap_s: float = GAP_S, close_after: int = CLOSE_AFTER, range_s: float = RANGE_S, fan: int = FAN) -> DataFrame:
    """``model, rule, ts, flag, score, breached`` -> episodes; the last of a model may be open.

    Each range of ``range_s`` seconds is folded by itself, twice: first to learn
    its effect on any state, then, once a scan has told in which state it is
    entered, to find its episodes. So a model's rows are never in one task, and
    the episodes are the same for any length of range. A model has one rule; its
    rows of one time are taken flagged ones first. Null models are one model.
    """
    named = scores.withColumn("model", F.coalesce(F.col("model").cast("string"), F.lit("\u0000")))
    rows = flagged_runs(named, gap_s, range_s)
    rows = rows.select("model", "range", "ts", halo.seconds(F.col("ts")).alias("at"), F.coalesce(F.col("flag") == 1, F.lit(False)).alias("up"), F.coalesce("opens", F.lit(False)).alias("opens"), F.col("score").cast("double").alias("score"), F.when(F.col("rule") == SAME_SIGNAL, F.col("fired")).alias("fired"))
    rows = materialise(rows, "episode-rows")
    kind = to_arrow_schema(StructType.fromDDL(_EFFECT))
    final = to_arrow_schema(StructType.fromDDL(_FOUND))

    def summary(key, table):
        return _as_table([{"model": key[0].as_py(), "range": key[1].as_py(), **asdict(effect(_rows(table), close_after))}], kind)

    def folded(key, mine, entry):
        at, out = entry.to_pylist()[0], []

        def closed(e: Open, end: float | None, status: str = "CLOSED") -> None:
            out.append({"model": key[0].as_py(), "episode_no": e.number, "start": e.start, "last": e.last, "end": end, "status": status, "peak_score": e.peak, "fired": e.fired})

        held, _ = machine(iter(_rows(mine)), (_open(at["held"]), at["count"]), close_after, closed)
        if held is not None and at["final"]:
            closed(held, None, "OPEN")
        return _as_table(out, final)

    effects = materialise(rows.groupBy("model", "range").applyInArrow(summary, _EFFECT), "episode-effects")
    entry = entries(effects, close_after, fan)
    found = rows.groupBy("model", "range").cogroup(entry.groupBy("model", "range")).applyInArrow(folded, _FOUND)
    stamp = lambda c: F.timestamp_micros(F.round(F.col(c) * 1e6).cast("long"))
    return found.select(F.nullif("model", F.lit("\u0000")).alias("model"), "episode_no", stamp("start").alias("start_ts"), stamp("last").alias("last_ts"), stamp("end").alias("end_ts"), "status", "peak_score", "fired")


_FOUND = "model string, episode_no int, start double, last double, end double, status string, peak_score double, fired string"


def grade(ep: DataFrame, incidents: DataFrame, hours: float, after: int = 10, excuse: int = 30, excused: DataFrame | None = None) -> DataFrame:
    """Per model: incidents, caught, median and p90 minutes to detect, false alarms, per 24 h.

    ``incidents``: ``incident, start_ts, end_ts``. An incident is caught by the
    first episode that opens in [start, end + ``after`` min]; a false alarm is
    an episode outside every [start, end + ``excuse`` min] of ``excused``.
    """
    models = ep.select("model").distinct()
    wanted = models.crossJoin(F.broadcast(incidents.select("incident", "start_ts", "end_ts"))).withColumnRenamed("start_ts", "i_start")
    wanted = wanted.withColumn("until", F.col("end_ts") + F.make_dt_interval(mins=F.lit(after))).drop("end_ts")
    e = ep.select("model", F.col("start_ts").cast("timestamp").alias("opened"), "episode_no")
    inside = intervals.point_in_interval(e, "opened", wanted, "i_start", "until", on=["model"])
    first = inside.groupBy("model", "incident", "i_start").agg(F.min("opened").alias("opened"))
    minutes = (F.unix_timestamp("opened") - F.unix_timestamp(F.col("i_start").cast("timestamp"))) / 60
    caught = first.groupBy("model").agg(F.count("*").alias("caught"), F.median(minutes).alias("median_ttd"), F.expr("percentile_cont(0.9) within group (order by (unix_timestamp(opened) - unix_timestamp(cast(i_start as timestamp))) / 60)").alias("p90_ttd"))
    calm = (incidents if excused is None else excused).select(F.col("start_ts").alias("x0"), (F.col("end_ts") + F.make_dt_interval(mins=F.lit(excuse))).alias("x1"))
    false = intervals.point_in_interval(e, "opened", calm, "x0", "x1", "left_anti").groupBy("model").agg(F.count("*").alias("false_alarms"))
    n = incidents.agg(F.count("*").alias("incidents"))
    out = models.join(caught, "model", "left").join(false, "model", "left").crossJoin(F.broadcast(n)).fillna(0, ["caught", "false_alarms"])
    return out.select("model", "incidents", "caught", "median_ttd", "p90_ttd", "false_alarms", (F.col("false_alarms") * 24 / hours).alias("per_24h"))


def discordant(caught: DataFrame, reference: str) -> DataFrame:
    """``model, incident, caught`` (0/1) -> per other model the pairs only one caught, and the exact p-value."""
    r = caught.where(F.col("model") == reference).select("incident", F.col("caught").alias("ref"))
    j = caught.where(F.col("model") != reference).join(r, "incident")
    from lodestar.functions.stats import mcnemar_p

    g = j.groupBy("model").agg(F.count_if((F.col("ref") == 1) & (F.col("caught") == 0)).alias("b"), F.count_if((F.col("ref") == 0) & (F.col("caught") == 1)).alias("c"))
    return g.withColumn("p", mcnemar_p(F.col("b"), F.col("c")))


def best_rival(graded: DataFrame, reference: str) -> DataFrame:
    """The other model with most caught, then fewest false alarms, then least median, then name."""
    order = [F.desc("caught"), F.asc("false_alarms"), F.asc_nulls_last("median_ttd"), F.asc("model")]
    return graded.where(F.col("model") != reference).orderBy(*order).limit(1)


def attribution(details: DataFrame, expected: DataFrame, k: int = 3) -> DataFrame:
    """``incident, signal, weight`` against ``incident, signal`` expected: ``hit`` and the chance of a hit.

    Signals of rank up to k count, ties included; ``chance`` is that of an
    expected signal in the first k if ties at the edge are broken at random.
    """
    rank = F.rank().over(Window.partitionBy("incident").orderBy(F.desc("weight")))
    d = details.withColumn("r", rank).where(F.col("r") <= k).join(expected.withColumn("want", F.lit(1)), ["incident", "signal"], "left")
    edge = d.withColumn("edge", F.max("r").over(Window.partitionBy("incident")))
    tied, wanted = F.col("r") == F.col("edge"), F.col("want").isNotNull()
    g = edge.groupBy("incident").agg(F.count_if(~tied).alias("above"), F.count_if(tied).alias("tied"), F.count_if(~tied & wanted).alias("sure"), F.count_if(tied & wanted).alias("maybe"))
    places = F.lit(k) - F.col("above")
    # none of the places goes to a wanted one: a product of falling shares
    miss = F.aggregate(F.sequence(F.lit(0), F.greatest(places, F.lit(1)).cast("int") - 1), F.lit(1.0), lambda acc, i: acc * F.greatest(F.lit(0.0), F.try_divide(F.col("tied") - F.col("maybe") - i, F.col("tied") - i)))
    chance = F.when(F.col("sure") > 0, 1.0).when((F.col("maybe") == 0) | (places <= 0), 0.0).when(places >= F.col("tied"), 1.0).otherwise(1 - miss)
    return g.select("incident", ((F.col("sure") + F.col("maybe")) > 0).alias("hit"), chance.alias("chance"))


def p_value(b: int, c: int) -> float:
    return mcnemar_exact_p(b, c)
