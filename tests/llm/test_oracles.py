"""Operators that SQL expresses, against DuckDB on small tables full of edge cases."""

import random

import duckdb
import pandas as pd
import pytest

from lodestar.llm import decontamination, mixing, substring_dedup

ITEM = "every quick test item holds more than thirteen plain words so that windows really slide".split()


def corpus():
    r = random.Random(11)
    words = [f"w{i}" for i in range(60)] + ["É", "naïve", "A1", "it's"]
    passage = r.choices(words, k=70)
    rows = [(i, " ".join(r.choices(words, k=r.randint(0, 40))), r.choice(["a", "b", "é", "z", None])) for i in range(80)]
    rows += [(100 + i, " ".join([*r.choices(words, k=5), *passage[: r.randint(10, 70)], *r.choices(words, k=5)]), "hot") for i in range(60)]
    rows += [(200 + i, rows[85][1], "hot") for i in range(30)]
    rows += [(300, None, "a"), (301, "", None), (302, " \t\n", "b"), (303, "x " * 6000, "b"), (304, ("x " * 13).strip(), "c")]
    rows += [(400 + i, " ".join([*r.choices(words, k=30), *(w.title() for w in ITEM[: r.randint(11, 15)]), "end"]), "d") for i in range(12)]
    rows += [(420, " ".join(ITEM), "d"), (421, "Short,item; here!", "d"), (422, "short item", None)]
    return rows


ITEMS = [(1, " ".join(ITEM)), (2, "short item here"), (3, None), (4, ""), (10, "short item"), (11, ", ".join(ITEM[2:])), (12, "short item")]


@pytest.fixture(scope="module")
def tables(spark):
    docs = pd.DataFrame(corpus(), columns=["doc_id", "text", "source"])
    items = pd.DataFrame(ITEMS, columns=["item_id", "text"])
    con = duckdb.connect()
    for name, df in (("documents", docs), ("benchmark", items)):
        con.register("frame", df)
        con.execute(f"create table {name} as select * from frame")
    rows = [tuple(None if pd.isna(v) else v for v in x) for x in docs.itertuples(index=False)]
    return con, spark.createDataFrame(rows, "doc_id long, text string, source string"), spark.createDataFrame(ITEMS, "item_id long, text string")


def same(con, df, sql):
    want = con.execute(sql)
    names = sorted(x[0] for x in want.description)
    order = [[x[0] for x in want.description].index(c) for c in names]
    want = sorted((tuple(x[i] for i in order) for x in want.fetchall()), key=str)
    assert sorted(df.columns) == names
    got = sorted((tuple(x) for x in df.select(*names).collect()), key=str)
    assert [tuple(round(v, 6) if isinstance(v, float) else v for v in x) for x in got] == [tuple(round(v, 6) if isinstance(v, float) else v for v in x) for x in want]


def test_substring_dedup(tables):
    con, docs, _ = tables
    same(con, substring_dedup.report(docs), substring_dedup.ORACLE_SQL)


@pytest.mark.parametrize("size", [1024, 4096])
def test_words_of_one_polynomial_hash_are_told_apart(spark, size):
    """Thue-Morse words and their complements collide for every polynomial modulo 2^64."""
    bits = [bin(i).count("1") % 2 for i in range(size)]
    x, y = ("".join("ab"[b ^ flip] for b in bits) for flip in (0, 1))
    tail = " ".join(ITEM[:12])
    rows = [(1, f"{x} {tail}"), (2, f"{y} {tail}"), (3, f"{y} {tail} more")]
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text"]))
    got = spark.createDataFrame(rows, "doc_id long, text string")
    same(con, substring_dedup.report(got), substring_dedup.ORACLE_SQL)
    assert [(r.doc_id, r.n_removed) for r in substring_dedup.report(got).orderBy("doc_id").collect()] == [(1, 0), (2, 0), (3, 13)]


def test_kept_words(tables):
    _, docs, _ = tables
    out = {x.doc_id: x for x in substring_dedup.deduplicate(docs).collect()}
    assert out[304].n_removed == 13 and out[304].text == "" and out[303].n_removed == 0
    assert out[200].text == "" or out[200].n_removed > 0


def test_mixing(tables):
    con, docs, _ = tables
    same(con, mixing.mix_table(docs), mixing.ORACLE_SQL)


def test_mix_comes_near_its_targets(tables):
    _, docs, _ = tables
    for x in mixing.mix_table(docs).groupBy("source_size", "target").agg({"taken": "sum", "size": "max"}).collect():
        assert abs(x["sum(taken)"] - x.target) <= x["max(size)"]


def test_decontamination(tables):
    con, docs, items = tables
    same(con, decontamination.report(docs, items), decontamination.ORACLE_SQL)


def test_decontamination_by_shuffle(tables):
    con, docs, items = tables
    same(con, decontamination.report(docs, items, broadcast_windows=0), decontamination.ORACLE_SQL)
