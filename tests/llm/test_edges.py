"""Defined results for null, empty, repeated and clashing input, for every operator."""

import hashlib

import pytest
from pyspark.sql import functions as F

from lodestar.llm import ann, decontamination, langid, lm_scoring, mixing, near_duplicates, pii, secret_scan, simhash, substring_dedup, toxicity

E = hashlib.sha256(b"").hexdigest()
ROWS = [
    (1, None, None, None, 5), (2, "", "en", "a", 6), (3, "the same words again and again", "en", "a", 7), (3, "the same words again and again", "en", "a", 7),
    (None, "no id here", "en", None, 8), (4, "é" * 3000 + " x" * 5000, None, "b", 9), (20, "12 34 !!", "fr", "b", 1), (21, " \t\n", "fr", "c", 2),
]
SCHEMA = "doc_id long, text string, lang string, source string, score int"
LABELS = [(1, 0, 1), (2, None, None), (3, 1, 0), (3, 1, 1), (None, 0, 1)]
ITEMS = [(1, "same words"), (2, None), (None, "again and"), (3, "")]


@pytest.fixture(scope="module")
def tables(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    for clash in ("row_key", "h", "size", "fp", "mark", "word", "stats", "base", "terms", "w", "at", "key", "row", "copies", "target", "id", "label", "d", "t", "uid", "__key", "__row", "__n", "a-b", "a b", "a.b", "q`q"):
        docs = docs.withColumn(clash, F.lit("x"))
    return docs, spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int"), spark.createDataFrame(ITEMS, "item_id long, text string")


REPORTS = {
    "secrets": lambda d, s, b: secret_scan.report(d, findings=120), "lm": lambda d, s, b: lm_scoring.report(d), "pii": lambda d, s, b: pii.report(d),
    "substring": lambda d, s, b: substring_dedup.report(d), "mix": lambda d, s, b: mixing.mix_table(d), "simhash": lambda d, s, b: simhash.report(d),
    "toxicity": lambda d, s, b: toxicity.report(d, s), "bench": lambda d, s, b: decontamination.report(d, b), "lang": lambda d, s, b: langid.report(d),
}


@pytest.mark.parametrize("name", REPORTS)
def test_one_row_for_each_row(tables, name):
    docs, labels, items = tables
    got = REPORTS[name](docs, labels, items).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in ROWS)
    by = {r.doc_id: r for r in got}
    if name == "secrets":
        assert all(r.base_sha256 == E and r.spans == "" for r in got)
    if name == "lm":
        assert by[1].n_tokens == by[2].n_tokens == 1 and by[None].held_out is False
    if name == "substring":
        assert by[1].kept_sha256 == E and all(r.n_removed == 0 for r in got)
    if name == "mix":
        assert by[1].taken == by[2].taken == 0
    if name == "simhash":
        assert by[1].fingerprint == "0" * 16 and by[21].component_id == 1
    if name == "toxicity":
        assert by[1].score == by[2].score == 0.0
    if name == "bench":
        assert (by[3].n_hit, by[3].n_items, by[3].contaminated) == (4, 1, True) and by[1].n_words == 0
    if name == "lang":
        assert by[1].lang_pred == by[20].lang_pred == "und" and by[3].lang_pred == "en"


@pytest.mark.parametrize("name", REPORTS)
def test_empty_tables(tables, name):
    docs, labels, items = tables
    assert REPORTS[name](docs.where("1 = 0"), labels.where("1 = 0"), items.where("1 = 0")).count() == 0


def test_filters_keep_columns_and_clean_rows(tables):
    docs, labels, items = tables
    for kept in (toxicity.remove_toxic(docs, labels), simhash.deduplicate(docs), near_duplicates.deduplicate(docs), decontamination.decontaminate(docs, items), pii.sanitise(docs), mixing.mix_documents(docs, copies="n")):
        assert [c for c in kept.columns if c != "n"] == docs.columns
        kept.collect()
    assert decontamination.decontaminate(docs, items).where("doc_id = 3").count() == 0
    assert simhash.deduplicate(docs).where("doc_id = 3").count() == 1


def test_vectors_null_zero_broken_and_repeated(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, [0.5, 0.0]), (7, [0.5, 0.0]), (8, [1.0, 0.0, 0.0]), (None, [1.0, 1.0]), (20, [-1.0, 0.0]), (40, None)]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert [(r["rank"], r.vec_id, r.score) for r in got if r.query_id == 0] == [(1, 1, 1.0), (2, 8, 1.0), (3, 7, 0.5), (4, 20, -1.0)]
    assert {r.query_id for r in got} == {0, 20}
    assert ann.search(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_ids_that_are_text(tables):
    docs, labels, items = tables
    docs = docs.withColumn("doc_id", F.concat(F.lit("n"), F.col("doc_id").cast("string")))
    for name in REPORTS:
        assert REPORTS[name](docs, labels, items).count() == len(ROWS)
    assert near_duplicates.deduplicate(docs).count() == 5


def test_weights_need_not_be_whole(tables):
    got = mixing.mix_table(tables[0], weights=(0.5, 1.5)).collect()
    assert len(got) == len(ROWS) and all(r.target is not None for r in got)


def test_joins_without_broadcast(tables, monkeypatch):
    docs, _, items = tables
    reports = {"bench": lambda: decontamination.report(docs, items, broadcast_windows=0), "pii": lambda: pii.report(docs), "simhash": lambda: simhash.report(docs), "mix": lambda: mixing.mix_table(docs)}
    with_broadcast = {"bench": decontamination.report(docs, items), "pii": pii.report(docs), "simhash": simhash.report(docs), "mix": mixing.mix_table(docs)}
    want = {k: sorted(map(str, v.collect())) for k, v in with_broadcast.items()}
    monkeypatch.setattr(pii, "BROADCAST_TERMS", 0)
    monkeypatch.setattr(simhash, "BROADCAST_KEYS", 0)
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    for name, make in reports.items():
        assert sorted(map(str, make().collect())) == want[name], name


def colliding(n=2):
    """Texts of different lengths whose 32-bit row hashes agree; found by trying, as such pairs are common."""
    import numpy as np

    rng = np.random.default_rng(8)
    return [" ".join(f"w{x}" for x in rng.integers(0, 10**6, 1 + 40 * (i % 2))) for i in range(n)]


def test_null_ids_with_equal_short_hashes(spark):
    """Rows without an id are told apart even where a 32-bit hash of their texts agrees."""
    texts = spark.createDataFrame([(x,) for x in colliding(240_000)], "text string").withColumn("h", F.hash("text"))
    pair = texts.groupBy("h").agg(F.collect_set("text").alias("t"), F.countDistinct(F.length("text") > 100).alias("k")).where("k = 2").first().t
    twice = spark.createDataFrame([(5, "z"), *((None, t) for t in pair)], "doc_id long, text string")
    words = sorted(len(t.split()) for t in pair)
    assert sorted(r.n_words for r in substring_dedup.report(twice).where("doc_id is null").collect()) == words
    assert sorted(r.n_tokens for r in lm_scoring.report(twice).where("doc_id is null").collect()) == [n + 1 for n in words]


def test_text_ids_keep_their_type(spark):
    d = spark.createDataFrame([("a", "x y z"), ("7", "x y z")], "doc_id string, text string")
    assert sorted(r.doc_id for r in substring_dedup.report(d).collect()) == ["7", "a"]
