"""Known answers of the alert state machine, grading and attribution."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lodestar.operators import episodes as ep

T0 = datetime(2024, 3, 1)
MSET = [63, 100, 215, 216, 260, 395, 790, 1000, 1005, 1020]
FOREST = [1300, 1301, 1302, 1329, 1330, 1331]
STATIC = {
    61: "CPU", 62: "CPU", 64: "CPU", 65: "CPU,DBTIME", 66: "CPU,DBTIME", 198: "PIO", 199: "PIO,W_USERIO", 200: "PIO,W_USERIO", 405: "PIO", 406: "PIO,W_APPL", 407: "W_APPL,PIO",
    499: "REDO", 501: "REDO", 502: "REDO", 1100: "REDO", 1101: "REDO,PIO", 1102: "REDO", 1200: "CPU", 1201: "PIO", 1202: "CPU", 1203: "PIO",
}
INCIDENTS = [("cpu_hog", 60, 80), ("io_storm", 200, 230), ("blocking_chain", 400, 410), ("slow_drift", 600, 780)]


def at(m):
    return T0 + timedelta(minutes=m)


def scores(spark, model, rule, flags, breached=None, skip=(), minutes=range(1440)):
    rows = [(model, rule, at(m), int(m in flags), 1.0 if m in flags else 0.0, (breached or {}).get(m)) for m in minutes if m not in skip]
    return spark.createDataFrame(rows, "model string, rule string, ts timestamp, flag int, score double, breached string")


def spans(df):
    def minute(t):
        return None if t is None else int((t - T0).total_seconds() // 60)

    return [(minute(r.start_ts), minute(r.last_ts), minute(r.end_ts)) for r in df.orderBy("start_ts").collect()]


@pytest.fixture(scope="module")
def found(spark):
    s = scores(spark, "MSET", ep.SINGLE, MSET).unionByName(scores(spark, "STATIC", ep.SAME_SIGNAL, STATIC, STATIC, skip=(500,))).unionByName(scores(spark, "IFOREST", ep.CONSECUTIVE, FOREST))
    return ep.episodes(s).cache()


def test_episodes(found):
    assert spans(found.where("model = 'MSET'")) == [(63, 63, 73), (100, 100, 110), (215, 216, 226), (260, 260, 270), (395, 395, 405), (790, 790, 800), (1000, 1005, 1015), (1020, 1020, 1030)]
    assert spans(found.where("model = 'STATIC'")) == [(66, 66, 76), (200, 200, 210), (407, 407, 417), (1102, 1102, 1112)]
    assert [r.fired for r in found.where("model = 'STATIC'").orderBy("start_ts").collect()] == ["CPU", "PIO", "PIO", "REDO"]
    assert spans(found.where("model = 'IFOREST'")) == [(1302, 1302, 1312), (1331, 1331, 1341)]


def test_grade(spark, found):
    inc = spark.createDataFrame([(n, at(a), at(b)) for n, a, b in INCIDENTS], "incident string, start_ts timestamp, end_ts timestamp")
    excused = inc.unionByName(spark.createDataFrame([("ui", at(1295), at(1300))], inc.schema))
    g = {r.model: r for r in ep.grade(found, inc, 24, excused=excused).collect()}
    assert [(g[m].incidents, g[m].caught, g[m].false_alarms) for m in ("MSET", "STATIC", "IFOREST")] == [(4, 3, 3), (4, 3, 1), (4, 0, 1)]
    assert (g["MSET"].median_ttd, round(g["MSET"].p90_ttd, 6)) == (15, 155)
    assert (g["STATIC"].median_ttd, round(g["STATIC"].p90_ttd, 6)) == (6, 6.8)
    assert g["MSET"].per_24h == 3
    rival = ep.best_rival(ep.grade(found, inc, 24, excused=excused), "MSET").first()
    assert rival.model == "STATIC"


def test_state_carries_over_between_runs(spark):
    s = ep.State()
    rows = lambda ms, flags: [(float(m * 60), int(m in flags), 1.0, None) for m in ms]
    assert list(ep.fold(s, "SVM", ep.CONSECUTIVE, iter(rows(range(13), {5, 6, 7, 8})))) == []
    assert (s.start, s.last) == (7 * 60, 8 * 60)
    closed = list(ep.fold(s, "SVM", ep.CONSECUTIVE, iter(rows(range(13, 41), {30, 31}))))
    assert [(r[2].timestamp() / 60, r[3].timestamp() / 60, r[4].timestamp() / 60) for r in closed] == [(7, 8, 18)]
    s = ep.State()
    list(ep.fold(s, "STATIC", ep.SAME_SIGNAL, iter([(m * 60.0, int(m in (10, 11)), 1.0, {10: "CPU", 11: "CPU,AAS"}.get(m)) for m in range(12)])))
    assert s.runs == {"CPU": 2, "AAS": 1}
    list(ep.fold(s, "STATIC", ep.SAME_SIGNAL, iter([(720.0, 1, 1.0, "PIO,CPU")])))
    assert (s.start, s.fired) == (720, "CPU")


def test_runs():
    assert ep.runs_next({}, "CPU,PIO") == {"CPU": 1, "PIO": 1}
    assert ep.runs_next({"CPU": 1, "PIO": 1}, "CPU") == {"CPU": 2}
    assert ep.runs_next({"CPU": 3}, "CPU,AAS") == {"CPU": 3, "AAS": 1}
    assert ep.runs_next({"CPU": 1}, "CPU,CPU") == {"CPU": 2} and ep.runs_next({"CPU": 1}, None) == {}
    assert ep.runs_fired({"W_APPL": 2, "PIO": 3}, "W_APPL,PIO") == "PIO"
    assert ep.runs_fired({"REDO": 3, "CPU": 3}, "CPU,REDO") == "CPU,REDO"


def test_null_flag_and_gap():
    s = ep.State()
    rows = [(0.0, 1, 1.0, None), (60.0, 1, 1.0, None), (200.0, 1, 1.0, None), (260.0, None, None, None), (320.0, 1, 1.0, None)]
    assert not list(ep.fold(s, "m", ep.CONSECUTIVE, iter(rows))) and s.consecutive == 1 and s.start is None


def test_discordant_and_attribution(spark):
    caught = spark.createDataFrame([("M", i, c) for i, c in enumerate((1, 1, 1, 0))] + [("S", i, c) for i, c in enumerate((1, 1, 0, 1))] + [("F", i, 0) for i in range(4)], "model string, incident int, caught int")
    d = {r.model: (r.b, r.c, r.p) for r in ep.discordant(caught, "M").collect()}
    assert d == {"S": (1, 1, 1.0), "F": (3, 0, 0.25)}
    details = spark.createDataFrame([(1, "A", 9.0), (1, "B", 8.0), (1, "C", 5.0), (1, "D", 5.0), (1, "E", 5.0), (2, "A", 1.0)], "incident int, signal string, weight double")
    expected = spark.createDataFrame([(1, "C"), (2, "Z")], "incident int, signal string")
    got = {r.incident: (r.hit, round(r.chance, 9)) for r in ep.attribution(details, expected).collect()}
    assert got == {1: (True, round(1 / 3, 9)), 2: (False, 0.0)}


def test_stream_equals_batch(spark, tmp_path):
    from lodestar.streaming.alerts import closed_episodes

    s = scores(spark, "MSET", ep.SINGLE, MSET).unionByName(scores(spark, "STATIC", ep.SAME_SIGNAL, STATIC, STATIC, skip=(500,)))
    src = str(tmp_path / "in")
    for k in range(3):  # three files, three micro-batches
        s.where((F.col("ts") >= F.lit(at(480 * k))) & (F.col("ts") < F.lit(at(480 * k + 480)))).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(s.schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = closed_episodes(stream).writeStream.format("memory").queryName("ep_out").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    key = ["model", "start_ts", "last_ts", "end_ts", "fired"]
    want = sorted(map(str, ep.episodes(s).where("status = 'CLOSED'").select(*key).collect()))
    assert sorted(map(str, spark.table("ep_out").select(*key).collect())) == want


def test_minutes_stream_and_upsert(spark, tmp_path):
    from lodestar.streaming.alerts import minutes, upsert

    rows = [(at(0), "ok", 1.0), (at(0), "error", 2.0), (at(1), "ok", 3.0), (at(30), "ok", 1.0)]
    spark.createDataFrame(rows, "ts timestamp, event_type string, value double").coalesce(1).write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema("ts timestamp, event_type string, value double").parquet(str(tmp_path / "e"))
    out = str(tmp_path / "t")
    q = minutes(stream).writeStream.outputMode("update").foreachBatch(upsert(out, ["ts"])).option("checkpointLocation", str(tmp_path / "ck2")).start()
    q.processAllAvailable()
    q.stop()
    assert [(r.n_ok, r.n_err) for r in spark.read.parquet(out).orderBy("ts").collect()] == [(1, 1), (1, 0), (1, 0)]


def random_scores(seed, models=4, n=900):
    import random

    rng, rows = random.Random(seed), []
    for m in range(models):
        rule = (ep.SINGLE, ep.CONSECUTIVE, ep.SAME_SIGNAL)[m % 3]
        t, busy = 0.0, 0.3
        for _ in range(n):
            t += rng.choice([30, 60, 60, 60, 60, 89, 90, 91, 400]) + rng.choice([0, 0.25])
            if rng.random() < 0.05:
                busy = rng.choice([0.03, 0.3, 0.9])
            flag = rng.choice([0, None]) if rng.random() > busy else 1
            names = ",".join(rng.choices(["CPU", "IO", "NET", "", "CPU"], k=rng.randrange(4))) or None
            rows.append((f"m{m}", rule, T0 + timedelta(seconds=t), flag, rng.choice([None, round(rng.random(), 3)]), names))
    return rows


ROW = "model string, rule string, ts timestamp, flag int, score double, breached string"


@pytest.mark.parametrize("range_s, fan", [(300, 3), (6 * 3600, 256), (7, 5)])
def test_ranges_equal_one_fold(spark, range_s, fan):
    """Split into any ranges, scanned in any blocks, the episodes are those of one fold over all rows."""
    rows = random_scores(range_s, n=250 if range_s < 100 else 900)
    want = []
    for model in sorted({r[0] for r in rows}):
        mine, s = [r for r in rows if r[0] == model], ep.State()
        want += ep.fold(s, model, mine[0][1], ((r[2].timestamp(), *r[3:]) for r in mine))
        if s.start is not None:
            want.append(s.row(model, "OPEN", None))
    got = ep.episodes(spark.createDataFrame(rows, ROW).repartition(5), range_s=range_s, fan=fan).collect()
    key = lambda r: (r[0], r[1])
    plain = lambda t: None if t is None else t.to_pydatetime().replace(tzinfo=None)
    assert sorted(map(tuple, got), key=key) == sorted([(m, n, *map(plain, times), *rest) for m, n, *times, rest in ((w[0], w[1], w[2], w[3], w[4], w[5:]) for w in want)], key=key)
    assert len(want) > 8


def test_effects_compose(spark):
    """Any split of rows into ranges composes to the effect of the whole, entered in any state."""
    import random

    rng = random.Random(5)
    for _ in range(400):
        n = rng.randrange(1, 40)
        up = [rng.random() < rng.choice([0.1, 0.5]) for _ in range(n)]
        rows = [(float(i), u, u and rng.random() < 0.5, rng.choice([None, float(i)]), None) for i, u in enumerate(up)]
        cuts = sorted(rng.sample(range(1, n), min(n - 1, rng.randrange(4))))
        parts = [ep.effect(rows[a:b], 4) for a, b in zip([0, *cuts], [*cuts, n], strict=True)]
        whole = parts[0]
        for p in parts[1:]:
            whole = ep.compose(whole, p, 4)
        for held in (None, *(ep.Open(u, -5.0, -4.0, 0.5, "x", 3) for u in range(4))):
            from dataclasses import replace

            want = ep.machine(iter(rows), (held and replace(held), 3), 4)
            assert ep.enter(whole, (held, 3), 4) == want == ep.enter(ep.effect(rows, 4), (held, 3), 4)


def test_no_rows_and_rows_without_time_or_model(spark):
    assert ep.episodes(spark.createDataFrame([], ROW)).count() == 0
    rows = [(None, ep.SINGLE, at(1), 1, 2.0, None), ("a", ep.SINGLE, None, 1, 2.0, None), (None, ep.SINGLE, at(1), 0, None, None)]
    assert [(r.model, r.status, r.peak_score) for r in ep.episodes(spark.createDataFrame(rows, ROW)).collect()] == [(None, "OPEN", 2.0)]
