"""Cases that the third review found."""

from datetime import datetime

import numpy as np

from lodestar.operators import graph, intervals, ledger, matching, ml, names, retrieval, series


def test_phase_of_a_mean_on_the_full_minute(spark):
    rows = [(u, i, datetime(2024, 1, 1, 0, i, s)) for u, seconds in enumerate([(14, 46), (53, 7, 48, 34, 26, 12), (57, 21, 52, 27, 8, 39)]) for i, s in enumerate(seconds)]
    got = series.aligned(spark.createDataFrame(rows, "u int, i int, ts timestamp"), "ts", ["u"], ["i"]).where("i = 5 or u = 0 and i = 1").orderBy("u").collect()
    # what the SQL says of these three: on the minute, a hair above it, a hair below it
    assert [int(r.phase * 1000 + 0.5) for r in got] == [0, 0, 60000]


def test_first_of_windows_that_share_a_key(spark):
    t = lambda m: datetime(2024, 1, 1, 0, m)
    left = spark.createDataFrame([("a", t(20), t(30)), ("a", t(0), t(10)), ("b", t(0), t(1)), ("b", t(40), t(41)), ("c", t(0), t(2))], "k string, a timestamp, b timestamp")
    right = spark.createDataFrame([(1, t(25)), (2, t(5)), (3, t(41))], "id int, ts timestamp")
    got = intervals.first_within(left, "a", "b", right, "ts", ["k"], ["id"]).collect()
    assert sorted((r.k, r.a, r.id) for r in got if r.k != "c") == [("a", t(0), 2), ("b", t(0), 3)]
    assert [r.id for r in got if r.k == "c"] == [None] and len(got) == 3


def test_near_names_broadcast_nothing(spark):
    n = spark.createDataFrame([("aab",), ("aba",), ("ab",), ("abb",), ("",), ("a",), ("ééb",), ("bb",)], "n string")
    for k in (1, 2):
        d = names.near_names(n, "n", k)
        d.collect()
        assert "Broadcast" not in d._jdf.queryExecution().executedPlan().toString()


def test_slots_are_found_without_sending_texts_with_words(spark):
    m = spark.createDataFrame([(i, "5 gb doha " + "word%d " * 50) for i in range(3)], "memory_id int, text string")
    s = spark.createDataFrame([("cap", [["5 gb"], ["doha"]]), ("none", [["%"], ["plan"]])], "slot string, groups array<array<string>>")
    d = graph.match_slots(m, s)
    assert [(r.slot, r.status) for r in d.collect()] == [("cap", "matched")] * 3
    plan = d._jdf.queryExecution().optimizedPlan().toString()
    exploded = [line for line in plan.splitlines() if "Generate explode" in line]
    assert exploded and all("text" not in line.split("],")[-1] for line in exploded), exploded


def test_allotments_folded_one_after_another(spark):
    rows = [(k, i, f"c{i // 2}", "claim" if i % 2 == 0 else "settle", 10.0) for k in "abc" for i in range(40)]
    e = spark.createDataFrame(rows, "allotment string, seq long, claim string, action string, amount double").repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        d = ledger.run_ledger(e, spark.createDataFrame([("a", 55.0), ("b", 100.0)], "allotment string, budget double"))
        got = d.orderBy("allotment", "seq").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert "FlatMapGroups" not in d._jdf.queryExecution().executedPlan().toString()
    granted = {k: [r.outcome for r in got if r.allotment == k].count("granted") for k in "abc"}
    assert granted == {"a": 5, "b": 10, "c": 0} and [r.spent for r in got if r.allotment == "a"][-1] == 50.0


def test_rules_meet_each_set_of_items_once(spark):
    b = spark.createDataFrame([(i, ["a", "b"]) for i in range(6)] + [(9, ["a"]), (10, ["c"]), (11, ["a"]), (12, [])], "owner int, items array<string>")
    d = ml.recommend(b, ml.rules(b, 0.1, 0.2), "owner")
    assert sorted((r.owner, r.rec, r.rank) for r in d.collect()) == [(9, "b", 1), (11, "b", 1)]
    assert d.columns == ["owner", "rec", "lift", "rank"]


def test_clusters_of_equal_rows_by_weight(spark):
    rows = [(0.0, 0.0)] * 30 + [(10.0, 10.0)] * 10
    got = ml.cluster(spark.createDataFrame(rows, "x double, y double"), ["x", "y"], (2,)).collect()
    assert [(r.model, round(r.score, 6)) for r in got] == [("kmeans", 1.0), ("mixture", 1.0)]


def test_bucket_search_is_the_best_of_its_buckets_in_any_blocks(spark):
    x = np.random.default_rng(0).normal(size=(400, 8))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "i long, v array<double>")
    q, c = rows.where("i % 20 = 0").selectExpr("i as query_id", "v as qv"), rows.selectExpr("i as chunk_id", "v as cv")
    sides = np.einsum("nd,tbd->ntb", x, np.random.default_rng(1).normal(size=(6, 3, 8))) > 0
    u = x / np.linalg.norm(x, axis=1)[:, None]
    for blocks in ((20_000, 2_000), (37, 3)):
        d = retrieval.approximate_search(q, c, 5, bits=3, chunk_block=blocks[0], query_block=blocks[1])
        got = {(r.query_id, r["rank"]): r.chunk_id for r in d.collect()}
        want = {}
        for i in range(0, 400, 20):
            met = np.flatnonzero((sides == sides[i]).all(2).any(1))
            want |= {(i, n): j for n, j in enumerate(sorted(met.tolist(), key=lambda j: 1 - u[i] @ u[j])[:5], 1)}
        assert got == want
    exact = {(r.query_id, r["rank"]): r.chunk_id for r in retrieval.search(q, c, 5, 37, 3).collect()}
    assert exact == {(i, n): j for i in range(0, 400, 20) for n, j in enumerate(np.argsort(1 - u @ u[i], kind="stable")[:5].tolist(), 1)}


def test_small_bags_are_decided_where_they_stand(spark):
    rows = [(k % 5 if k % 5 else None, float(k), "x") for k in range(40)] + [(9, k * 3.0, "y") for k in range(60)]
    gold, result = spark.createDataFrame(rows, "bag int, a double, c string"), spark.createDataFrame([(b, a + 0.5, c) for b, a, c in rows], "bag int, a double, c string")
    d = matching.tolerant_rows(gold, result, ["bag"], ["a", "c"], 1.0)
    assert {(r.bag, r.n_gold, r.n_result, r.matches) for r in d.collect()} == {(b, n, n, True) for b, n in ((None, 8), (1, 8), (2, 8), (3, 8), (4, 8), (9, 60))}
    small = matching.tolerant_rows(gold.where("bag < 9 or bag is null"), result.where("bag < 9 or bag is null"), ["bag"], ["a", "c"], 1.0)
    plan = small._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "FlatMapGroups" not in plan
