"""Known answers of statistics, text, comparison, graph, ledger and table helpers."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lodestar.functions import stats, text
from lodestar.operators import compare, detectors, fitted, graph, ledger, ml, retrieval, series
from lodestar.sources import files, tables


def test_mcnemar(spark):
    known = {(0, 5): 0.0625, (1, 7): 0.0703125, (2, 10): 0.03857421875, (5, 1): 0.21875, (3, 0): 0.25, (3, 3): 1.0, (0, 0): 1.0}
    for (b, c), p in known.items():
        assert stats.mcnemar_exact_p(b, c) == p
    df = spark.createDataFrame(list(known), "b int, c int")
    assert {(r.b, r.c): round(r.p, 12) for r in df.select("b", "c", stats.mcnemar_p(F.col("b"), F.col("c")).alias("p")).collect()} == {k: round(v, 12) for k, v in known.items()}


def test_statistics(spark):
    assert stats.holm([0.01, 0.04, 0.03, 0.005]) == pytest.approx([0.03, 0.06, 0.06, 0.02])
    df = spark.createDataFrame([(i, p) for i, p in enumerate([0.01, 0.04, 0.03, 0.005])], "i int, p double").withColumn("f", F.lit(1))
    assert [r.p_holm for r in stats.holm_adjusted(df, "p", ["f"]).orderBy("i").collect()] == pytest.approx([0.03, 0.06, 0.06, 0.02])
    assert stats.percentile([1, 2, 3, 4], 50) == 2.5
    assert stats.f1([(3, 1, 0), (0, 0, 2)]) == pytest.approx(6 / 9)
    assert stats.permutation_p(spark, [(9, 0, 0)] * 12, [(0, 0, 9)] * 12) == pytest.approx(2 / 4096)
    assert stats.permutation_p(spark, [(1, 2, 3)] * 4, [(1, 2, 3)] * 4) == 1
    assert stats.lehmer_sample(20261004, 5) == pytest.approx([0.425551412360, 0.792226010371, 0.541746623601, 0.651267830120, 0.349427725351], abs=1e-12)
    low, high = stats.wilson_interval(12, 14)
    assert (round(low, 4), round(high, 4)) == (0.6006, 0.9599)
    mean, bound = stats.paired_bootstrap([1, 1, 0, 1] * 10, [0, 1, 0, 0] * 10, 500)
    assert mean == 0.5 and 0.3 < bound < 0.5
    assert stats.tie_chance(2, 3, 0, 1) == pytest.approx(1 / 3) and stats.tie_chance(0, 2, 0, 1) == 1 and stats.tie_chance(3, 4, 0, 2) == 0


def test_text(spark):
    cases = [("left on 09-Nov, at 2,417,305.50 eur", "left on november 9, at eur 2417305.5"), ("3.70 KB of 12%", "3.7 kb of 12 percent"), ("7 usd", "usd 7")]
    got = spark.createDataFrame(cases, "t string, want string").select(text.dates_units(F.col("t")).alias("t"), "want").collect()
    assert [r.t for r in got] == [r.want for r in got]
    terms = [("8 tb", "no more than 8TB.", True), ("8 tb", "about 18 TB", False), ("march 5", "due 05-mar", True)]
    got = spark.createDataFrame(terms, "a string, b string, want boolean").select(text.has_term(F.col("a"), F.col("b")).alias("t"), "want").collect()
    assert [r.t for r in got] == [r.want for r in got]
    assert text.osa("row-1967", "row-1976") == 1 and text.osa("kitten", "sitting") == 3
    assert text.nfkc("Ａ​é ١٢٣ 1,200  x") == "ae 123 1200 x"
    assert text.numbers("two hundred and five of 1,200 or three thousand") == [205, 1200, 3000]
    df = spark.createDataFrame([("a" * 7,), ("b",), ("c" * 30,)], "t string")
    assert [r[0] for r in df.select(text.token_estimate(F.col("t"))).collect()] == [2, 1, 9]
    raw = 'x passwd: hunter42\nsee "/srv/data/a.txt" or 10.2.3.4 box-77'
    red = spark.createDataFrame([(raw,)], "t string").select(text.redact(F.col("t"), {"box": "box-[0-9]+"})).first()[0]
    assert red == 'x passwd: [secret]\nsee "[path]" or [address] [box]'
    page = "<html><style>p{}</style><p>a &amp; b</p><!-- x --><script>1</script> c</html>"
    assert spark.createDataFrame([(page,)], "h string").select(text.visible_text(F.col("h"))).first()[0] == "a & b c"
    got = spark.createDataFrame([("x" * 120,)], "t string").select(F.explode(text.chunks(F.col("t"), 50, 10)).alias("c")).select("c.start", F.length("c.chunk")).collect()
    assert [tuple(r) for r in got] == [(0, 50), (40, 50), (80, 40)]
    run = spark.createDataFrame([(["a", "b", "c", "d"], ["x", "b", "c", "y"])], "a array<string>, b array<string>").select(text.longest_common_run("a", "b")).first()[0]
    assert run == 2


def test_bag_equality(spark):
    gold = spark.createDataFrame([(1, "a", 600), (2, "b", 5)], "k int, v string, n int")
    assert compare.same_bag(gold, spark.createDataFrame([("B ", "5.001", 2, 9), ("a", "600", 1, 9)], "x string, y string, z int, extra int"))
    assert not compare.same_bag(gold, spark.createDataFrame([("b", "600", 2), ("a", "5", 1)], "x string, y string, z int"))
    day = spark.createDataFrame([(datetime(2024, 1, 2),)], "t timestamp")
    assert compare.same_bag(day.select(F.to_date("t").alias("d")), day)
    seq = spark.createDataFrame([(1, "a"), (2, "b")], "i int, v string")
    assert compare.same_sequence(seq, seq, "i") and not compare.same_sequence(seq, spark.createDataFrame([(2, "a"), (1, "b")], "i int, v string"), "i")


def test_links(spark):
    gold = spark.createDataFrame([("t", "A", "B", "supports"), ("t", "C", "D", "invalidates")], "thread string, source string, target string, kind string")
    pred = spark.createDataFrame([("t", 1, "B", "A", "supports"), ("t", 2, "C", "D", "supports"), ("t", 3, "E", "F", "invalidates"), ("t", 4, None, "B", "supports")], "thread string, seq int, source string, target string, kind string")
    bad = spark.createDataFrame([("t", "F", "E")], "thread string, a string, b string")
    r = graph.score_links(pred, gold, bad).first()
    assert (r.tp, r.fp, r.fn, r.harmful, r.distractor, r.pair_hits) == (0, 4, 2, 1, 1, 2)
    twice = spark.createDataFrame([("t", 1, "A", "B", "supports"), ("t", 2, "A", "B", "supports")], pred.schema)
    r = graph.score_links(twice, gold, bad).first()
    assert (r.tp, r.fp) == (1, 1)


def test_slots(spark):
    m = spark.createDataFrame([(1, "cap at 5 gb for Doha"), (2, "nothing"), (3, "5 gb doha plan b")], "memory_id int, text string")
    s = spark.createDataFrame([("cap", [["5 gb", "5gb"], ["doha"]]), ("plan", [["plan b"]])], "slot string, groups array<array<string>>")
    assert {r.memory_id: (r.slot, r.status) for r in graph.match_slots(m, s).collect()} == {1: ("cap", "matched"), 2: (None, "unmatched"), 3: (None, "ambiguous")}


def test_ledger(spark):
    e = spark.createDataFrame([("a", 1, "x", "claim", 60.0), ("a", 2, "y", "claim", 60.0), ("a", 3, "x", "settle", 30.0), ("a", 4, "y", "claim", 60.0), ("a", 5, "y", "settle", 80.0), ("a", 6, "z", "claim", 1.0), ("a", 7, "q", "settle", 1.0)], "allotment string, seq long, claim string, action string, amount double")
    got = [r.outcome for r in ledger.run_ledger(e, spark.createDataFrame([("a", 100.0)], "allotment string, budget double")).orderBy("seq").collect()]
    assert got == ["granted", "refused", "settled", "granted", "breach", "closed", "unknown"]


def test_merge_tombstone_insert(spark, tmp_path):
    t = spark.createDataFrame([(1, "a", None), (2, "b", None), (3, None, None)], "k int, v string, gone_ts string")
    s = spark.createDataFrame([(2, "B", None), (3, None, None), (4, "d", None)], "k int, v string, gone_ts string")
    rows, counts = tables.merge(t, s, ["k"])
    assert sorted((r.k, r.v) for r in rows.collect()) == [(1, "a"), (2, "B"), (3, None), (4, "d")]
    assert {r.action: r["count"] for r in counts.collect()} == {"keep": 2, "update": 1, "insert": 1}
    assert {r.k: r.gone_ts for r in tables.tombstone(t, s, ["k"], F.lit("now")).collect()} == {1: "now", 2: None, 3: None}
    assert tables.insert_missing(t, s, ["k"]).count() == 4
    tables.split_write(t, {"a": (F.col("k") <= 2, str(tmp_path / "a")), "b": (F.col("k") > 1, str(tmp_path / "b"))})
    assert (spark.read.parquet(str(tmp_path / "a")).count(), spark.read.parquet(str(tmp_path / "b")).count()) == (2, 2)
    with pytest.raises(ValueError, match="nope"):
        tables.assert_columns(t, "k,nope")


def test_readers(spark, tmp_path):
    (tmp_path / "j").write_text('{"a": 1}\n{"a": 2}\n{"a":\n')
    good, bad = files.json_lines(spark, str(tmp_path / "j"), "a int")
    assert (sorted(r.a for r in good.collect()), bad.count()) == ([1, 2], 1)
    with pytest.raises(ValueError):
        files.json_lines(spark, str(tmp_path / "j"), "a int", strict=True)
    (tmp_path / "s").write_text("head\n@@ one\n1,2\n3,4\n@@ two\n5\n")
    assert [(r.name, r.n, r.line) for r in files.spool(spark, str(tmp_path / "s")).orderBy("name", "n").collect()] == [("one", 1, "1,2"), ("one", 2, "3,4"), ("two", 1, "5")]
    docs = spark.createDataFrame([("d", "[Title: X y]\n[Lang: en]\nfirst\nblock\n\nsecond\n")], "doc string, text string")
    got = files.marked_documents(docs).orderBy("n").collect()
    assert [(r.meta["title"], r.n, r.block) for r in got] == [("X y", 0, "first\nblock"), ("X y", 1, "second")]
    (tmp_path / "l").write_text('{"level":"i","msg":"minute","n_ok":3}\nbroken\n')
    logs, kinds = files.log_lines(spark, str(tmp_path / "l"))
    assert logs.first().n_ok == 3 and {r.msg: r["count"] for r in kinds.collect()} == {"minute": 1, None: 1}


def test_retrieval_rules(spark):
    assert retrieval.keep_default_or_best([("a", 40, 100), ("b", 42, 100), ("c", 43, 100)], "a") == "c"
    assert retrieval.keep_default_or_best([("a", 40, 100), ("b", 42, 100)], "a") == "a"
    assert retrieval.budgeted_k(6000, 1024) == 6 and retrieval.budgeted_k(6000, 4000) == 2
    assert retrieval.ranking_equal([(1, 0.5), (2, 0.5), (3, 0.1)], [(2, 0.5), (1, 0.5), (3, 0.1)]) and not retrieval.ranking_equal([(1, 0.5), (3, 0.1)], [(3, 0.5), (1, 0.1)])


@pytest.fixture(scope="module")
def drift(spark):
    """A daily sine drives five signals; s3 drifts by a third after minute 150 of the test part."""
    load = 1 + 0.5 * F.sin(F.col("id") / 1440 * 6.283185)
    noise = lambda k: (F.pmod(F.xxhash64("id", F.lit(k)), F.lit(1000)) / 1000 - 0.5) * 0.1
    d = spark.range(1740).select(F.timestamp_seconds(F.col("id") * 60).alias("ts"), "id", *[(load * k + noise(k)).alias(f"s{k}") for k in range(1, 6)])
    return d.withColumn("s3", F.when(F.col("id") >= 1590, F.col("s3") * 1.3).otherwise(F.col("s3"))).cache()


def test_pca_residual_finds_drift(drift):
    cols = [f"s{k}" for k in range(1, 6)]
    m = detectors.pca_train(drift.where("id < 1440"), cols)
    s = detectors.pca_score(drift.where("id >= 1440"), m).groupBy((F.unix_timestamp("ts") >= 1590 * 60).alias("late")).agg(F.avg("flag").alias("rate"))
    r = {x.late: x.rate for x in s.collect()}
    assert r[True] > 0.95 and r[False] < 0.05
    top = detectors.pca_contributors(drift.where("id >= 1600"), m).where("rank = 1").groupBy("signal").count().orderBy(F.desc("count")).first()
    assert top.signal == "s3"


@pytest.mark.parametrize("fit", [fitted.isolation_forest, fitted.mixture, fitted.one_class, fitted.memory_estimate])
def test_models_find_drift(drift, fit):
    cols = [f"s{k}" for k in range(1, 6)]
    model = fit(drift.where("id < 1440"), cols)
    spiked = drift.where("id >= 1440").withColumn("s3", F.when(F.col("id") >= 1590, F.col("s3") * 2).otherwise(F.col("s3")))
    s = fitted.score(spiked, model)
    r = {x.late: x.rate for x in s.groupBy((F.unix_timestamp("ts") >= 1590 * 60).alias("late")).agg(F.avg("flag").alias("rate")).collect()}
    assert r[True] > 0.8 and r[False] < 0.2


def test_forest_does_not_depend_on_tasks(drift):
    import numpy as np

    cols, x = ["s1", "s2"], np.array([[0.4, 1.1], [3.0, 2.0], [1.0, 2.0]])
    one, two = (fitted.isolation_forest(drift.repartition(n), cols, trees=8, size=32) for n in (1, 7))
    assert np.allclose(one.raise_(x), two.raise_(x), rtol=1e-9)


def test_fits_pass_over_incomplete_rows(spark):
    d = spark.createDataFrame([(datetime(2024, 1, 1, 0, i % 60), float(i % 7), float(i % 5)) for i in range(60)] + [(datetime(2024, 1, 2), None, 1.0), (datetime(2024, 1, 2), float("nan"), 1.0), (datetime(2024, 1, 2), float("inf"), 1.0)], "ts timestamp, a double, b double")
    for fit in (fitted.isolation_forest, fitted.mixture, fitted.memory_estimate):
        s = fitted.score(d, fit(d, ["a", "b"]))
        assert s.where("flag is null and score is null").count() == 3 and s.where("score > 0 or score = 0").count() == 60
    with pytest.raises(ValueError, match="no complete rows"):
        fitted.mixture(d.where("a is null"), ["a", "b"])


def plain_sprt(rows, t):
    """Flag of each (seconds, score) row, its test replayed from the beginning of its context."""
    import math

    upper, lower = math.log((1 - t.beta) / t.alpha), math.log(t.beta / (1 - t.alpha))
    decided = []
    for at, x in rows:
        total, fired = 0.0, False
        for b, y in rows:
            if at - t.context * t.step_s < b <= at and y is not None:
                total = max(total, lower) + t.shift * ((y - t.mean) / t.sd - t.shift / 2)
                fired = total >= upper
                if fired or total <= lower:
                    total = 0.0
        decided.append(fired and x is not None)
    return [None if x is None else int(sum(f for f, (b, _) in zip(decided, rows, strict=True) if at - t.window * t.step_s < b <= at) >= t.count) for at, x in rows]


def test_mset_sprt_for_any_ranges(spark):
    """Equal to a row by row replay, however time is cut into ranges; gaps and missing rows included."""
    import random

    rng, at, rows = random.Random(4), 0, []
    for i in range(500):
        at += rng.choice([60, 60, 60, 120, 600])
        load, odd = rng.uniform(0, 1), 6.0 if 150 < i < 175 or i > 480 else 0.0
        rows.append((datetime(1970, 1, 1) + timedelta(seconds=at), None if rng.random() < 0.05 else load + odd, 2 * load))
    d = spark.createDataFrame(rows, "ts timestamp, a double, b double")
    model = fitted.memory_estimate(d.limit(150), ["a", "b"], memory=40)
    test = fitted.sprt_trained(d.limit(150), model, context=20)
    want = plain_sprt([(r.ts.timestamp(), r.score) for r in fitted.score(d, model).orderBy("ts").collect()], test)
    assert {0, 1, None} == set(want)
    for range_s in (300, 3600, 10**9):
        got = [r.flag for r in fitted.mset_sprt(d.repartition(3), model, test, range_s).orderBy("ts").collect()]
        assert got == want, range_s


def test_signal_selection_and_hand_scores(spark):
    d = spark.createDataFrame([(datetime(2024, 1, 1, 0, i), float(i), 1.0, None, 2.0 if i else 3.0, None if i == 0 else 1.0) for i in range(6)], "ts timestamp, a double, const double, none double, b double, part double")
    # b varies only in a row that null removal drops; part is constant
    assert detectors.select_signals(d, ["a", "const", "none", "b", "part"]) == ["a", "b"]
    model = spark.createDataFrame([("AAS", 2.0, None), ("TXN", 9.0, 4.0)], "signal string, hi double, lo double")
    long = spark.createDataFrame([(1, "AAS", 6.0), (1, "TXN", 2.0), (2, "AAS", 1.0), (2, "TXN", 5.0)], "ts int, signal string, val double")
    got = {r.ts: (r.flag, r.score, r.breached) for r in detectors.static_score(long, model).collect()}
    assert got == {1: (1, 3.0, "AAS,TXN"), 2: (0, 0.8, None)}
    base = spark.createDataFrame([("CPU", 0, 10.0, 2.0)], "signal string, g int, med double, mad double")
    z = spark.createDataFrame([(datetime(2024, 1, 1), "CPU", 10 + 6 * 1.4826 * 2)], "ts timestamp, signal string, val double")
    r = detectors.seasonal_score(z, base, 4).first()
    assert r.flag == 1 and r.score == pytest.approx(1.5)


def test_smoothing_and_rules(spark):
    s = ml.smooth(spark.createDataFrame([("x", i, 2.0 * i) for i in range(20)], "series string, t int, y double"), "series").first()
    assert s.forecast == pytest.approx(40.0)
    b = spark.createDataFrame([(i, ["a", "b"]) for i in range(6)] + [(9, ["a"]), (10, ["c"])], "owner int, items array<string>")
    rec = ml.recommend(b, ml.rules(b, 0.1, 0.2), "owner").collect()
    assert [(r.owner, r.rec) for r in rec] == [(9, "b")]


def test_series_helpers(spark):
    e = spark.createDataFrame([(datetime(2024, 1, 1, 0, 0, 5), "click", 1.0), (datetime(2024, 1, 1, 0, 2, 5), "error", 3.0)], "ts timestamp, event_type string, value double")
    assert [(r.n_ok, r.n_err, r.err_pct) for r in series.summary(e).orderBy("ts").collect()] == [(1, 0, 0.0), (0, 0, None), (0, 1, 100.0)]
