"""Alignment of two tokenizers against a plain reading, byte by byte."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from lodestar.llm import alignment
from pyspark.sql import functions as F

FILES = (alignment.A_FILE, alignment.B_FILE)


@pytest.fixture(scope="module")
def tokenizers():
    return alignment.Tokenizers(*(open(f, "rb").read() for f in FILES))


def plain(t, text):
    """(A ids, B ids, groups as lists of token numbers) from sets of ends."""
    if not text:
        return [], [], []
    a, b = t.a.encode(" " + text, add_special_tokens=False).ids, t.b.encode(text)
    decoded = t.a.decode(a, skip_special_tokens=False) if "�" not in text else " " + text
    joined = b"".join(t.b_bytes[i] for i in b)
    if joined != (" " + text).encode() or (decoded != " " + text and "�" not in decoded):
        return [], [], []
    ends = [np.cumsum([len(x[i]) for i in ids]).tolist() for x, ids in ((t.a_bytes, a), (t.b_bytes, b))]
    groups, i, j = [], 0, 0
    for cut in sorted(set(ends[0]) & set(ends[1])):
        g = ([], [])
        while i < len(a) and ends[0][i] <= cut:
            g[0].append(a[i])
            i += 1
        while j < len(b) and ends[1][j] <= cut:
            g[1].append(b[j])
            j += 1
        groups.append(g)
    return a, b, groups


def brute(t, texts):
    rows, held = [], Counter()
    for text in texts:
        a, b, groups = plain(t, text)
        links = [(x, y) for g in groups for x in g[0] for y in g[1]]
        held.update(set(links))
        shown = ";".join(",".join(map(str, g[0])) + "|" + ",".join(map(str, g[1])) for g in groups)
        rows.append((len(a), len(b), len(groups), links, hashlib.sha256(shown.encode()).hexdigest() if a else ""))
    top = {}
    for (x, _), n in held.items():
        top[x] = max(top.get(x, 0), n)
    return [(n_a, n_b, n_g, len(links), sum(held[p] == top[p[0]] for p in links), sum(held[p] for p in links), h) for n_a, n_b, n_g, links, h in rows]


TEXTS = [
    None, "", " ", "  two  spaces ", "a", "the cat sat on the mat", "The Cat, sat; on thé mät!\n\tnew\r\nline", "<|endoftext|> and <s> </s> <unk> <0x0A> text", "a▁b", " hard", "日本語のテキスト、中国的文字", "🙂🙃👩‍👩‍👧 emoji",
    "x" * 3000, "ab1" * 900, "zzzzqqqq" * 40 + " end", "é combining ​ zero", "don't they'll I'VE", "\x00\x01 control", "   ", "ends with space ", "Ünïcödé   tabs\t\t\tx", "http://a.b/c?d=e&f=%20", "ﬁ ligature ① ½",
]


def got(df):
    return [tuple(r)[1:] for r in df.orderBy("doc_id").collect()]


def test_against_plain_reading(spark, tokenizers):
    df = spark.createDataFrame([(i, x, 1) for i, x in enumerate(TEXTS)], "doc_id long, text string, n_a int").repartition(3)
    assert got(alignment.report(df)) == brute(tokenizers, TEXTS)


def test_given_documents(spark, tokenizers):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = [r.text for r in docs.orderBy("doc_id").collect()]
    assert got(alignment.report(docs)) == brute(tokenizers, texts)


def test_shuffled_counts_and_split_rows(spark, tokenizers, monkeypatch):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    want = got(alignment.report(df))
    for name, value in (("BROADCAST_PAIRS", 0), ("ROW_PAIRS", 7), ("GROUP_LINKS", 3)):
        monkeypatch.setattr(alignment, name, value)
    t = tokenizers
    for text, found in zip(TEXTS, t.encode(TEXTS), strict=True):  # wide groups by distinct ids, and few links at once
        x = alignment.Alignment(t, *found)
        k, n = x.links(len(t.b_bytes))
        g = plain(t, text)[2]
        assert Counter(a * len(t.b_bytes) + b for p in g for a in p[0] for b in p[1]) == dict(zip(k.tolist(), n.tolist(), strict=True))
    assert got(alignment.report(df)) == want


def test_words_do_not_change_tokens(tokenizers, monkeypatch):
    """Tokens of words between lone spaces are those of the whole text."""
    t = tokenizers
    assert t.parted
    docs = [x for x in TEXTS if x] + [" ".join(x for x in TEXTS if x) * 3, "word " * 300, "a  b   c " * 90, "x ▁ y " * 50, " ' s 'll " * 60]
    for words in (alignment.GROUP_WORDS, 3):
        monkeypatch.setattr(alignment, "GROUP_WORDS", words)
        for x, (a, b) in zip(docs, t.encode(docs), strict=True):
            assert not len(a) or (a.tolist(), b.tolist()) == (t.a.encode(" " + x, add_special_tokens=False).ids, t.b.encode(x)), x


def test_edges(spark):
    df = spark.createDataFrame([(None, "same text"), (None, "same text"), (3, "same text")], "doc_id long, text string")
    rows = alignment.report(df).collect()
    assert len(rows) == 3 and len({tuple(r)[1:] for r in rows}) == 1 and rows[0].count_sum == 3 * rows[0].n_links
    assert alignment.report(df.where("false")).count() == 0
    text_id = alignment.report(df.select(F.lit("x").alias("doc_id"), "text"))
    assert text_id.schema["doc_id"].dataType.simpleString() == "string"


def test_tokens_and_table(spark, tokenizers):
    df = spark.createDataFrame([(1, "the cat"), (2, "the dog the")], "doc_id long, text string")
    row = alignment.align(df).where("doc_id = 1").first()
    assert b"".join(tokenizers.a_bytes[i] for i in row.a_ids) == b" the cat" and row.a_group == sorted(row.a_group)
    pairs = {(tokenizers.a_bytes[r.a_id], tokenizers.b_bytes[r.b_id]): (r.documents, r.best) for r in alignment.table(df).collect()}
    assert pairs[b" the", b" the"] == (2, True)
