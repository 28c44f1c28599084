"""Pattern spans against a brute-force reading of the contract; sanitising."""

import hashlib
import random
import re

import pytest

from lodestar.llm import pii

RULES = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def brute(text):
    out = []
    for k, (kind, rule) in enumerate(RULES.items()):
        for m in rule.finditer(text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (12 <= len(d) <= 19 and luhn(d)):
                continue
            if kind == "phone" and not 9 <= len(d) <= 15:
                continue
            out.append((m.start(), k, m.end()))
    return sorted(out)


TEXTS = [
    None, "", "a@b.c", "x@y.z_foo@bar.com x@y..z", "a@b.c.d-e.f@g.h", "éa.b@c.d😀 1.2.3.4.5.6.7.8", "256.1.1.1 001.002.003.0255 1.2.3",
    "4111 1111 1111 1111 and 4111-1111-1111-1112", "4111  1111 1111 1111", "+1 (017) 555-7713 x +12 +1-.", "+1 4111 1111 1111 1111 23", "12345678901234567890" * 60,
    "a" * 3000 + "@" + "b.c" * 300, "0000.0.0.0 99999999999.1.1.1", "😀😀 +49 (0) 123-456 789)",
]


def fuzz(n):
    r = random.Random(5)
    return ["".join(r.choice(["1", "2", "45", ".", "-", " ", "+", "@", "a", "b.c", "(", ")", "é", "4111111111111111", "_"]) for _ in range(r.randint(1, 60))) for _ in range(n)]


def test_spans_equal_brute_force(spark):
    texts = TEXTS + fuzz(300)
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(0, None, "x"), (None, "q@w.e", None)], "doc_id long, text string, base string")
    got = pii.report(df).collect()
    assert len(got) == len(texts) + 2
    for row in got:
        if row.doc_id is None:
            assert row.spans == "email:0:5"
            continue
        want = brute(texts[row.doc_id])
        text = ",".join(f"{list(RULES)[k]}:{a}:{b}" for a, k, b in want)
        assert row.base_sha256 == hashlib.sha256(text.encode()).hexdigest(), (texts[row.doc_id], row.spans, text)
        assert (row.n_email, row.n_ip, row.n_card, row.n_phone) == tuple(sum(k == j for _, k, _ in want) for j in range(4))


def test_sanitise_removes_all_and_keeps_the_rest(spark):
    rows = [(1, "call +1 (017) 555-7713 now", "s"), (2, "plain", None), (3, None, "s"), (4, "a@b.co, 1.2.3.4; 4111 1111 1111 1111.", "s"), (4, "a@b.co, 1.2.3.4; 4111 1111 1111 1111.", "s")]
    out = pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string, `terms` string"))
    assert out.columns == ["doc_id", "text", "terms"]
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    assert got == [(1, "call [PHONE] now"), (2, "plain"), (3, None), (4, "[EMAIL], [IP]; [CARD]."), (4, "[EMAIL], [IP]; [CARD].")]


def test_terms_that_reveal_an_entity_are_found(spark):
    r = random.Random(1)
    filler = ["alpha", "river", "table", "green", "house", "cloud", "stone", "paper", "music", "light"]
    rows = [(i, f"{' '.join(r.choices(filler, k=12))} Zarquon {r.choice(filler)} contact z@q.org {' '.join(r.choices(filler, k=9))}") for i in range(8)]
    rows += [(100 + i, " ".join(r.choices(filler, k=40))) for i in range(200)]
    f = pii.find(spark.createDataFrame(rows, "doc_id long, text string")).where("size(terms) > 0").collect()
    texts = dict(rows)
    assert {x.doc_id for x in f} == set(range(8))
    assert {texts[x.doc_id][s.start : s.end] for x in f for s in x.terms} == {"Zarquon", "contact"}
    clean = pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).where("doc_id = 0").first().text
    assert "Zarquon" not in clean and "[EMAIL]" in clean


def test_terms_are_sought_and_removed_in_whole_texts(spark):
    r = random.Random(2)
    filler = ["alpha", "river", "table", "green", "house", "cloud", "stone", "paper", "music", "light"]
    far = lambda: " ".join(r.choices(filler, k=60))
    rows = [(i, f"Qx7 {far()} {r.choice(filler)} z@q.org {far()} ZO {far()}") for i in range(6)]
    rows += [(50 + i, rows[0][1]) for i in range(400)]  # copies prove and hide nothing
    rows += [(500, f"{far()} qx7, {far()} Qx70"), *((600 + i, far()) for i in range(200))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    texts, found = dict(rows), {}
    for x in pii.find(df).collect():
        found[x.doc_id] = {texts[x.doc_id][s.start : s.end] for s in x.terms}
    assert all(found[i] == {"Qx7", "ZO"} for i in [*range(6), *range(50, 450)])
    assert found[500] == {"qx7"} and not any(found[600 + i] for i in range(200))
    clean = {x.doc_id: x.text for x in pii.sanitise(df).collect()}
    assert "Qx7" not in clean[50] and "ZO" not in clean[50] and "qx7" not in clean[500] and clean[500].endswith("Qx70") and clean[600] == texts[600]


def test_near_copies_alone_prove_nothing(spark):
    r = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    body = " ".join(words[:60])
    rows = [(i, f"{body} write to z@q.org today {' '.join(words[60:120])} {words[200 + i]}") for i in range(20)]
    rows += [(100 + i, " ".join(r.choices(words[120:], k=50))) for i in range(100)]
    assert pii.find(spark.createDataFrame(rows, "doc_id long, text string")).where("size(terms) > 0").count() == 0


@pytest.mark.parametrize("f", [pii.report, pii.sanitise])
def test_empty_table(spark, f):
    assert f(spark.createDataFrame([], "doc_id long, text string, lang string")).count() == 0
