"""Time series over ``events``: summaries, gaps, interval joins, simple detectors."""

from __future__ import annotations

import uuid
from datetime import datetime, timedelta

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestar.operators import detectors, fitted, intervals, ranking, series
from lodestar.plans.tables import MICRO, micro, table
from lodestar.registry import query
from lodestar.session import shared_dir
from lodestar.sources import progress
from lodestar.streaming import minutes

TYPES = ["click", "error", "purchase", "signup", "view"]
SIGNALS = [*TYPES, "total", "top"]
#: Incidents: every 40th error opens a window of 90 minutes.
INCIDENTS_SQL = """select 'I' || lpad((n / 40)::bigint::varchar, 4, '0') as incident, ts as start_ts, ts + interval 90 minute as end_ts from
  (select ts, row_number() over (order by ts, event_id) as n from events where event_type = 'error') where n % 40 = 0"""
SIGNALS_SQL = f"""select date_trunc('hour', ts) as ts, {', '.join(f"count_if(event_type = '{t}')::double as {t}" for t in TYPES)},
  cast(sum(cast(value as decimal(18,4))) as double) as total, max(value) as top from events group by 1"""
LONG_SQL = f"""select ts, signal, val from s unpivot (val for signal in ({', '.join(SIGNALS)}))"""


def incidents(spark, d):
    e = table(spark, d, "events").where("event_type = 'error'").select("ts", "event_id")
    e = ranking.numbered(e, F.to_date("ts"), ["ts", "event_id"], "n").where("n % 40 = 0")
    return e.select(F.concat(F.lit("I"), F.lpad((F.col("n") / 40).cast("int").cast("string"), 4, "0")).alias("incident"), F.col("ts").alias("start_ts"), F.expr("ts + interval 90 minutes").alias("end_ts"))


def long_signals(spark, d):
    return series.long_form(series.signals(table(spark, d, "events")), "ts", SIGNALS)


@query("a16_minute_summary", f"""with a as (select date_trunc('minute', ts) as ts, count_if(event_type <> 'error') as n_ok, count_if(event_type = 'error') as n_err, quantile_disc(value, 0.5) as p50, quantile_disc(value, 0.95) as p95 from events group by 1),
  sp as (select unnest(generate_series(min(ts), max(ts), interval 1 minute)) as ts from a)
  select sp.ts, coalesce(n_ok, 0) as n_ok, coalesce(n_err, 0) as n_err, p50, p95, {MICRO.format('(coalesce(n_ok, 0) + coalesce(n_err, 0)) / 60.0')} as tps, {MICRO.format('100.0 * n_err / (n_ok + n_err)')} as err_pct from sp left join a on sp.ts = a.ts""")  # fmt: skip
def minute_summary(spark, d):
    s = series.summary(table(spark, d, "events"))
    return s.select("ts", "n_ok", "n_err", "p50", "p95", micro(F.col("tps")).alias("tps"), micro(F.col("err_pct")).alias("err_pct"))


@query("a23_cycle_profile", "select minute(ts) % 15 as slot, floor(second(ts) / 15)::bigint as quarter, count(*) as n, count_if(event_type = 'error') as errors from events group by 1, 2")
def cycle_profile(spark, d):
    return table(spark, d, "events").groupBy((F.minute("ts") % 15).cast("long").alias("slot"), F.floor(F.second("ts") / 15).alias("quarter")).agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"))


@query("wide_signals", SIGNALS_SQL)
def wide_signals(spark, d):
    return series.signals(table(spark, d, "events"))


@query("unpivot_long", f"with s as ({SIGNALS_SQL}) {LONG_SQL}")
def unpivot_long(spark, d):
    return long_signals(spark, d)


@query("wn4_gap_detection", "select user_id, gap_from, ts as gap_to, epoch(ts)::bigint - epoch(gap_from)::bigint as gap_s from (select user_id, ts, lag(ts) over (partition by user_id order by ts) as gap_from from events) where epoch(ts)::bigint - epoch(gap_from)::bigint > 86400".replace("epoch(ts)::bigint", "floor(epoch(ts))::bigint").replace("epoch(gap_from)::bigint", "floor(epoch(gap_from))::bigint"))
def gap_detection(spark, d):
    return series.gaps(table(spark, d, "events").select("user_id", "ts"), "ts", ["user_id"], 86400)


@query("wn6_circular_phase", f"""with r as (select event_id, user_id, ts, second(ts) * 6.283185307179586 / 60 as rad from events),
  p as (select event_id, ts, case when abs(sum(sin(rad)) over w) + abs(sum(cos(rad)) over w) > 1e-6 then ((atan2(sum(sin(rad)) over w, sum(cos(rad)) over w) * 60 / 6.283185307179586 + 60) % 60 + 60) % 60 end as phase from r window w as (partition by user_id order by ts, event_id rows between 5 preceding and current row))
  select event_id, cast(floor(phase * 1000 + 0.5) as bigint) as phase_milli from p""")  # fmt: skip
def circular_phase(spark, d):
    a = series.aligned(table(spark, d, "events").select("event_id", "user_id", "ts"), "ts", ["user_id"], ["event_id"])
    return a.select("event_id", F.floor(F.col("phase") * 1000 + 0.5).alias("phase_milli"))


@query("d3_backfill", """with live as (select date_trunc('hour', ts) as ts, 'L' as source from events where minute(ts) < 20 group by 1), hist as (select date_trunc('hour', ts) as ts, 'H' as source from events group by 1)
  select * from live union all select * from hist anti join live using (ts)""")  # fmt: skip
def backfill(spark, d):
    hours = table(spark, d, "events").withColumn("h", F.date_trunc("hour", "ts"))
    live = hours.where(F.minute("ts") < 20).select(F.col("h").alias("ts")).distinct().withColumn("source", F.lit("L"))
    return series.backfill(live, hours.select(F.col("h").alias("ts")).distinct().withColumn("source", F.lit("H")), "ts")


@query("j6_outside_incidents", f"with i as ({INCIDENTS_SQL}) select event_id, ts from events e where not exists (select 1 from i where e.ts >= start_ts - interval 5 minute and e.ts <= end_ts + interval 30 minute)")
def outside_incidents(spark, d):
    i = incidents(spark, d).select(F.expr("start_ts - interval 5 minutes").alias("a"), F.expr("end_ts + interval 30 minutes").alias("b"))
    return intervals.point_in_interval(table(spark, d, "events").select("event_id", "ts"), "ts", i, "a", "b", "left_anti")


@query("j8_point_in_interval", f"with i as ({INCIDENTS_SQL}) select event_id, incident from events join i on ts >= start_ts and ts <= end_ts")
def point_in_interval(spark, d):
    return intervals.point_in_interval(table(spark, d, "events").select("event_id", "ts"), "ts", incidents(spark, d), "start_ts", "end_ts").select("event_id", "incident")


@query("j11_interval_overlap", f"with i as ({INCIDENTS_SQL}) select a.incident as a, b.incident as b from i a join i b on a.start_ts < b.end_ts and a.end_ts + interval 12 hour >= b.start_ts and a.incident < b.incident")
def interval_overlap(spark, d):
    i = incidents(spark, d)
    a, b = i.select(F.col("incident").alias("a"), F.col("start_ts").alias("a0"), F.expr("end_ts + interval 12 hours").alias("a1")), i.select(F.col("incident").alias("b"), F.col("start_ts").alias("b0"), F.col("end_ts").alias("b1"))
    return intervals.overlapping(a, b, ("a0", "a1"), ("b0", "b1")).where("a < b").select("a", "b")


@query("j12_first_in_window", f"""with i as ({INCIDENTS_SQL}) select incident, event_id, ts from (select incident, e.event_id, e.ts, row_number() over (partition by incident order by e.ts, e.event_id) as rn
  from i left join (select * from events where event_type = 'signup') e on e.ts >= start_ts and e.ts <= end_ts + interval 10 minute) where rn = 1""")  # fmt: skip
def first_in_window(spark, d):
    i = incidents(spark, d).select("incident", "start_ts", F.expr("end_ts + interval 10 minutes").alias("until"))
    s = table(spark, d, "events").where("event_type = 'signup'").select("event_id", "ts")
    return intervals.first_within(i, "start_ts", "until", s, "ts", ["incident"], ["event_id"]).select("incident", "event_id", "ts")


@query("j13_last_before", "select p.event_id, c.ts as last_ts, c.value as last_value from (select * from events where event_type = 'purchase') p asof left join (select * from events where event_type = 'view') c on p.user_id = c.user_id and p.ts >= c.ts")
def last_before(spark, d):
    e = table(spark, d, "events")
    p, v = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), e.where("event_type = 'view'").select("user_id", "ts", "value")
    return intervals.last_before(p, "ts", v, "ts", ["user_id"], ["value"]).select("event_id", "last_ts", "last_value")


@query("j9_inverse_cdf", """with h as (select hour(ts) as h, count(*) as w from events group by 1), b as (select h, coalesce(sum(w) over (order by h rows between unbounded preceding and 1 preceding), 0) as lo, sum(w) over (order by h rows unbounded preceding) as hi from h)
  select o_orderkey, h from orders join b on (o_orderkey * 7919) % (select count(*) from events) >= lo and (o_orderkey * 7919) % (select count(*) from events) < hi""")  # fmt: skip
def inverse_cdf(spark, d):
    from lodestar.operators.ranking import running_bounds

    e = table(spark, d, "events")
    b = running_bounds(e.groupBy(F.hour("ts").alias("h")).agg(F.count("*").alias("w")), "h", "w")
    o = table(spark, d, "orders").crossJoin(F.broadcast(e.agg(F.count("*").alias("n")))).select("o_orderkey", ((F.col("o_orderkey") * 7919) % F.col("n")).alias("u"))
    return o.join(F.broadcast(b), (F.col("u") >= F.col("lo")) & (F.col("u") < F.col("hi"))).select("o_orderkey", "h")  # 24 hours


@query("j20_band_join", "select a.event_id as signup, b.event_id as view from events a join events b on a.user_id = b.user_id and b.ts between a.ts - interval 30 minute and a.ts + interval 30 minute where a.event_type = 'signup' and b.event_type = 'view'")
def band_join(spark, d):
    e = table(spark, d, "events")
    a = e.where("event_type = 'signup'").select(F.col("event_id").alias("signup"), "user_id", F.expr("ts - interval 30 minutes").alias("a0"), F.expr("ts + interval 30 minutes").alias("a1"))
    b = e.where("event_type = 'view'").select(F.col("event_id").alias("view"), "user_id", "ts")
    return intervals.point_in_interval(b, "ts", a, "a0", "a1", on=["user_id"]).select("signup", "view")


@query("d4_signal_selection", f"with s as ({SIGNALS_SQL}), l as ({LONG_SQL}) select signal, min(val) as low, max(val) as high, count(*) as n from l group by signal having min(val) < max(val)")
def signal_selection(spark, d):
    return detectors.usable_signals(long_signals(spark, d)).select("signal", "low", "high", "n")


@query("d5_training_rows", f"""with s as ({SIGNALS_SQL}), i as ({INCIDENTS_SQL}) select ts from s where ts >= timestamp '2024-01-03' and ts < timestamp '2024-01-25' and click + error + purchase + signup + view + total + top is not null
  and not exists (select 1 from i where s.ts >= start_ts - interval 5 minute and s.ts <= end_ts + interval 30 minute)""")  # fmt: skip
def training_rows(spark, d):
    return detectors.training_rows(series.signals(table(spark, d, "events")), incidents(spark, d), SIGNALS, "2024-01-03", "2024-01-25").select("ts")


@query("d6_static_train", f"""with s as ({SIGNALS_SQL}), l as ({LONG_SQL}) select signal, quantile_cont(val, 0.99) as hi, case when signal in ('click', 'view') then quantile_cont(val, 0.01) end as lo from l where ts < timestamp '2024-01-21' group by signal""")
def static_train(spark, d):
    return detectors.static_train(long_signals(spark, d).where("ts < '2024-01-21'"), 99, ("click", "view"))


STATIC_SQL = f"""with s as ({SIGNALS_SQL}), l as ({LONG_SQL}), t as (select signal, quantile_cont(val, 0.99) as hi, case when signal in ('click', 'view') then quantile_cont(val, 0.01) end as lo from l where ts < timestamp '2024-01-21' group by signal),
  r as (select ts, l.signal, least(100, greatest(case when hi > 0 then val / hi when val > 0 then 100 else 0 end, case when lo is null then 0 when val > 0 then lo / val when lo > 0 then 100 else 0 end)) as ratio from l join t on l.signal = t.signal where ts >= timestamp '2024-01-21')"""


@query("d7_static_score", STATIC_SQL + f" select ts, case when max(ratio) > 1 then 1 else 0 end as flag, {MICRO.format('max(ratio)')} as score, string_agg(signal, ',' order by ratio desc, signal) filter (where ratio > 1) as breached from r group by ts")
def static_score(spark, d):
    long = long_signals(spark, d)
    model = detectors.static_train(long.where("ts < '2024-01-21'"), 99, ("click", "view"))
    s = detectors.static_score(long.where("ts >= '2024-01-21'"), model)
    return s.select("ts", "flag", micro(F.col("score")).alias("score"), "breached")


SEASONAL_SQL = f"""with s as ({SIGNALS_SQL}), l as ({LONG_SQL}), b as (select *, hour(ts) as g from l where ts < timestamp '2024-01-28'), m as (select signal, g, median(val) as med, count(*) as n from b group by 1, 2),
  dv as (select b.signal, b.g, med, n, abs(val - med) as dev from b join m on b.signal = m.signal and b.g = m.g), o as (select signal, g, med, n, median(dev) as mad from dv group by 1, 2, 3, 4),
  a as (select signal, median(dev) as all_mad, cast(sum(cast(dev as decimal(28,10))) as double) / count(*) * 1.2533 / 1.4826 as all_mean from dv group by 1),
  base as (select o.signal, g, med, case when mad > 0 then mad when all_mad > 0 then all_mad when all_mean > 0 then all_mean else 1.0 end as mad, n from o join a on o.signal = a.signal where n >= 20)"""


@query("a9_d8_seasonal_train", SEASONAL_SQL + f" select signal, g, {MICRO.format('med')} as med, {MICRO.format('mad')} as mad, n from base")
def seasonal_train(spark, d):
    b = series.robust_base(long_signals(spark, d).where("ts < '2024-01-28'"), F.hour("ts"), 20)
    return b.select("signal", "g", micro(F.col("med")).alias("med"), micro(F.col("mad")).alias("mad"), "n")


@query("d9_seasonal_score", SEASONAL_SQL + f", z as (select ts, abs(val - med) / (1.4826 * mad) as z from l join base on l.signal = base.signal and hour(ts) = g where ts >= timestamp '2024-01-28') select ts, case when max(z) > 4 then 1 else 0 end as flag, {MICRO.format('max(z) / 4')} as score from z group by ts")
def seasonal_score(spark, d):
    long = long_signals(spark, d)
    base = series.robust_base(long.where("ts < '2024-01-28'"), F.hour("ts"), 20)
    return detectors.seasonal_score(long.where("ts >= '2024-01-28'"), base, 4).select("ts", "flag", micro(F.col("score")).alias("score"))


@query("d16_unscored_minutes", f"""with s as ({SIGNALS_SQL}), sp as (select unnest(generate_series(min(ts), max(ts), interval 1 hour)) as ts from s)
  select sp.ts, case when top is null or error = 0 then null when error > 2 then 1 else 0 end as flag from sp left join s on sp.ts = s.ts""")  # fmt: skip
def unscored_minutes(spark, d):
    wide = series.signals(table(spark, d, "events"))
    scored = wide.where("top is not null and error > 0").select("ts", (F.col("error") > 2).cast("int").alias("flag"))
    return detectors.with_unscored(series.spine(table(spark, d, "events"), "ts", "hour"), scored, "ts")


@query("d17_top_contributors", STATIC_SQL + ", k as (select *, rank() over (partition by ts order by ratio desc) as rk, row_number() over (partition by ts order by ratio desc, signal) as rn from r) select ts, signal, rn as rank from k where rn <= 5 or rk <= 3")
def top_contributors(spark, d):
    long = long_signals(spark, d)
    model = detectors.static_train(long.where("ts < '2024-01-21'"), 99, ("click", "view"))
    return detectors.contributors(detectors.static_ratios(long.where("ts >= '2024-01-21'"), model), "ts", "ratio", first=5, ties=3, cap=40).select("ts", "signal", "rank")


@query("d27_run_report", f"""with i as ({INCIDENTS_SQL}), s as ({SIGNALS_SQL}), clean as (select median(error) as base from s where not exists (select 1 from i where s.ts between start_ts and end_ts)),
  r as (select incident, cast(sum(error) as double) / count(*) as mean, max(error) as peak, count(*) as n from i join s on s.ts between start_ts and end_ts group by incident) select incident, {MICRO.format('mean')} as mean, peak, n, base from r, clean""")  # fmt: skip
def run_report(spark, d):
    i, s = incidents(spark, d), series.signals(table(spark, d, "events")).select("ts", "error")
    clean = intervals.point_in_interval(s, "ts", i, "start_ts", "end_ts", "left_anti").agg(F.median("error").alias("base"))
    r = intervals.point_in_interval(s, "ts", i, "start_ts", "end_ts").groupBy("incident").agg((F.sum("error") / F.count("*")).alias("mean"), F.max("error").alias("peak"), F.count("*").alias("n"))
    return r.crossJoin(F.broadcast(clean)).select("incident", micro(F.col("mean")).alias("mean"), "peak", "n", "base")


@query("d28_feed_soak", """with h as (select date_trunc('hour', ts) as ts, count(*) as n from events where event_type = 'signup' group by 1), sp as (select unnest(generate_series(min(ts), max(ts), interval 1 hour)) as ts from h)
  select (select count(*) from sp anti join h using (ts)) as missing, (select max(n) from h) as peak, (select count(*) from (select date_diff('hour', lag(ts) over (order by ts), ts) as g from h) where g > 2) as breaks""")  # fmt: skip
def feed_soak(spark, d):
    e = table(spark, d, "events").where("event_type = 'signup'")
    return detectors.feed_soak(e, "ts", "hour", 2 * 3600)


@query("d29_scenario_summary", f"with i as ({INCIDENTS_SQL}) select substr(incident, 4, 2) as scenario, count(*) as runs, min(start_ts) as first, max(end_ts) as last from i group by 1")
def scenario_summary(spark, d):
    return incidents(spark, d).groupBy(F.substring("incident", 4, 2).alias("scenario")).agg(F.count("*").alias("runs"), F.min("start_ts").alias("first"), F.max("end_ts").alias("last"))


@query("x37_rolling_error_stop", "select event_id, cast(sum(case when event_type = 'error' then 1 else 0 end) over (partition by user_id order by ts, event_id rows between 49 preceding and current row) as bigint) > 2.5 as stop from events")
def rolling_error_stop(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-49, 0)
    return table(spark, d, "events").select("event_id", (F.sum((F.col("event_type") == "error").cast("int")).over(w) > 2.5).alias("stop"))


@query("c7_time_window_guard", "select event_id, (hour(ts) >= 22 or hour(ts) < 6) and not (dayofweek(ts) = 0 or day(ts) = 15) as allowed from events")
def time_window_guard(spark, d):
    from lodestar.functions.calendar import in_window

    return table(spark, d, "events").select("event_id", in_window(F.col("ts"), 22, 6, blackout=(F.dayofweek("ts") == 1) | (F.dayofmonth("ts") == 15)).alias("allowed"))


@query("d10_d11_pca", f"""with s as ({SIGNALS_SQL}), t as (select * from s where ts < timestamp '2024-01-21'),
  m as (select avg(click) as a, stddev_samp(click) as sa, avg(view) as b, stddev_samp(view) as sb, sign(corr(click, view)) as r from t),
  e as (select ts, pow((click - a) / sa - r * (view - b) / sb, 2) / 2 as error from s, m), q as (select quantile_cont(error, 0.995) as limit_ from e where ts < timestamp '2024-01-21')
  select ts, (error > limit_)::int as flag, {MICRO.format('error / limit_')} as score from e, q where ts >= timestamp '2024-01-21'""")  # fmt: skip
def pca_residual(spark, d):
    """Of two signals the first component is their sum or difference, which SQL can say."""
    wide = series.signals(table(spark, d, "events"))
    model = detectors.pca_train(wide.where("ts < '2024-01-21'"), ["click", "view"], variance=0.5)
    return detectors.pca_score(wide.where("ts >= '2024-01-21'"), model).select("ts", "flag", micro(F.col("score")).alias("score"))


def _scored_by(fit, spark, d):
    wide = series.signals(table(spark, d, "events"))
    return fitted.score(wide.where("ts >= '2024-01-21'"), fit(wide.where("ts < '2024-01-21'"), SIGNALS))


@query("d12_one_class")
def one_class_scores(spark, d):
    return _scored_by(fitted.one_class, spark, d)


@query("d13_mixture")
def mixture_scores(spark, d):
    return _scored_by(fitted.mixture, spark, d)


@query("d14_mset_sprt")
def mset_sprt_scores(spark, d):
    wide = series.signals(table(spark, d, "events"))
    train = wide.where("ts < '2024-01-21'")
    model = fitted.memory_estimate(train, SIGNALS)
    return fitted.mset_sprt(wide.where("ts >= '2024-01-16'"), model, fitted.sprt_trained(train, model, step_s=3600.0), range_s=5 * 86400).where("ts >= '2024-01-21'")


@query("d15_isolation_forest")
def forest_scores(spark, d):
    return _scored_by(fitted.isolation_forest, spark, d)


#: Feeds are thirds of the users; one of them is silent from 3 to 4 every night.
@query("st5_closed_minutes", """with e as (select 'F' || (user_id % 3) as feed, * from events where user_id % 3 <> 1 or hour(ts) <> 3),
  u as (select date_trunc('minute', max(ts) - interval 5 minute) as until from e), f as (select feed, min(date_trunc('minute', ts)) as first from e group by 1),
  sp as (select feed, unnest(generate_series(first + interval 1 minute, until - interval 1 minute, interval 1 minute)) as ts from f, u),
  n as (select feed, date_trunc('minute', ts) as ts, count_if(event_type <> 'error') as n_ok, count_if(event_type = 'error') as n_err, max(value) as top from e group by 1, 2)
  select feed, ts, coalesce(n_ok, 0) as n_ok, coalesce(n_err, 0) as n_err, top from sp left join n using (feed, ts)""")  # fmt: skip
def closed_minutes(spark, d):
    return minutes.minute_table(feeds(table(spark, d, "events")))


def feeds(events):
    """Events with their feed, and a planted gap."""
    return events.where("user_id % 3 <> 1 or hour(ts) <> 3").withColumn("feed", F.concat(F.lit("F"), (F.col("user_id") % 3).cast("string")))


@query("st3_resumed_scores", f"""with s as ({SIGNALS_SQL}), m as (select max(ts) as until from s), sp as (select unnest(generate_series(timestamp '2024-01-27', until, interval 1 hour)) as ts from m)
  select sp.ts, (error > click / 4)::int as flag, {MICRO.format('error / (1 + click)')} as score from sp left join s using (ts)""")  # fmt: skip
def resumed_scores(spark, d):
    """A day a run, each going on where the table ends; together they are one run over all."""
    wide = series.signals(table(spark, d, "events")).select("ts", "error", "click")
    scored = progress.ScoredTable(spark, f"{shared_dir(spark)}/lodestar/resumed-{uuid.uuid4().hex}")
    rule = lambda rows: rows.where("error is not null").select("ts", (F.col("error") > F.col("click") / 4).cast("int").alias("flag"), (F.col("error") / (1 + F.col("click"))).alias("score"))
    progress.score_all_new(scored, wide, ["error", "click"], rule, datetime(2024, 1, 27), datetime(2024, 3, 1), step=timedelta(hours=1))
    return scored.read(progress.SCORED).select("ts", "flag", micro(F.col("score")).alias("score"))
