"""Readers and writers of files, on small ones."""

import json

import pytest

from lodestar.operators import ranking
from lodestar.sources import files, tables


def test_replace_keeps_a_whole_table(spark, tmp_path):
    one, two = spark.range(3).toDF("a"), spark.createDataFrame([(7, None)], "a long, b string")
    for kind in ("csv", "json"):
        path = str(tmp_path / kind)
        files.replace(one, path, kind)
        files.replace(two, path, kind)
        got = spark.read.option("header", True).csv(path) if kind == "csv" else spark.read.json(path)
        assert [str(r.a) for r in got.collect()] == ["7"]
    assert sorted(p.name for p in tmp_path.iterdir()) == ["csv", "json"]


def test_merge_path_twice(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.merge_path(spark, path, spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), ["k"])
    tables.merge_path(spark, path, spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string"), ["k"])
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [(1, "a"), (2, "c"), (3, "d")]


def test_rotated_logs_are_told_apart(spark, tmp_path):
    line = lambda msg, ts: json.dumps({"msg": msg, "ts": ts})
    (tmp_path / "app.log").write_text(line("minute", "3") + "\nbroken\n")
    (tmp_path / "app.log.1").write_text(line("minute", "2") + "\n")
    (tmp_path / "app.log.2").write_text(line("start", "1") + "\n")
    rows, kinds = files.log_lines(spark, str(tmp_path / "app.log"))
    assert [r.ts for r in rows.orderBy("age", ascending=False).collect()] == ["1", "2", "3"]
    assert {r.msg: r["count"] for r in kinds.collect()} == {"minute": 2, "start": 1, None: 1}


def test_json_lines_strict_and_tolerant(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1}\nnot json\n\n{"a": 2}\n')
    good, broken = files.json_lines(spark, str(tmp_path / "x.jsonl"), "a int")
    assert sorted(r.a for r in good.collect()) == [1, 2] and broken.count() == 2
    with pytest.raises(ValueError):
        files.json_lines(spark, str(tmp_path / "x.jsonl"), "a int", strict=True)


def test_numbers_run_on_over_parts(spark):
    df = spark.range(100).selectExpr("id", "id div 7 as part")
    from pyspark.sql import functions as F

    got = ranking.numbered(df, F.col("part"), ["id"], "n").collect()
    assert all(r.n == r.id + 1 for r in got)
