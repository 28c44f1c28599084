"""Every pipeline stage against a plain reading of it, on the smallest tables."""

import os

import pytest

import corpus_pipeline
from lodestar.llm import decontamination, mixing, pii, toxicity
from lodestar.session import materialise
from test_near_duplicates import brute

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the provided tables")


@pytest.fixture(scope="module")
def steps(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        after = materialise(stage(spark, docs, SF), f"test-{name}")
        out.append((docs, after))
        docs = after
    return out


def ids(df):
    return sorted(x.doc_id for x in df.select("doc_id").collect())


def test_columns_stay(steps):
    names = steps[0][0].columns
    assert all(after.columns == names for _, after in steps[:-1])
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash", "decontamination", "pii", "mixing"]


def test_toxicity_rejects_what_it_predicts(spark, steps):
    before, after = steps[0]
    scored = toxicity.report(before, spark.read.parquet(f"{SF}/labels.parquet"))
    assert ids(after) == ids(scored.where("predicted = 0"))


def test_one_document_of_each_group_stays(steps):
    before, after = steps[1]
    rows = [(x.doc_id, x.text) for x in before.select("doc_id", "text").collect()]
    least = {}
    for k, (d, _) in zip(brute(rows), rows, strict=True):
        least[k] = min(d, least.get(k, d))
    assert ids(after) == sorted(least.values())


def test_contaminated_documents_go(spark, steps):
    before, after = steps[2]
    found = decontamination.report(before, spark.read.parquet(f"{SF}/benchmark.parquet"))
    assert ids(after) == ids(found.where("not contaminated"))


def test_personal_data_is_replaced_and_the_rest_stays(steps):
    before, after = steps[3]
    texts = {x.doc_id: x.text for x in after.collect()}
    spans = {x.doc_id: x for x in pii.find(before).collect()}
    labels = ["[EMAIL]", "[IP]", "[CARD]", "[PHONE]"]
    for x in before.collect():
        out, at = [], 0
        for s in sorted([*spans[x.doc_id].base, *spans[x.doc_id].terms], key=lambda s: (s.start, s.k, s.end)):
            if s.start >= at:
                out += [x.text[at : s.start], labels[s.k] if s.k < 4 else s.value]
            at = max(at, s.end)
        want = "".join([*out, x.text[at:]]) if x.text else x.text
        assert texts[x.doc_id] == want


def test_mix_takes_what_its_table_says(steps):
    before, after = steps[4]
    taken = {x.doc_id: x.taken // x.size if x.size else 1 for x in mixing.mix_table(before).collect()}
    assert {x.doc_id: x.copies for x in after.collect()} == {k: n for k, n in taken.items() if n}


def test_run_gives_the_same(spark, steps):
    got = corpus_pipeline.run(spark, SF)
    assert sorted(map(str, got.collect())) == sorted(map(str, steps[-1][1].collect()))
