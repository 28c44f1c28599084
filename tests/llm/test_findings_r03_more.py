"""Cases of the third review that were left over: crowds of the pipeline's near-duplicate stage."""

import itertools
import random

from lodestar.llm import near_duplicates


def test_texts_of_a_crowd_meet_by_rare_shingles_only(spark):
    r = random.Random(4)
    rows = []
    for i in range(120):  # all hold shingle 1; every third has a copy of another group, changed in up to two of its forty
        own = [1, *range(1000 * i + 10, 1000 * i + 49)]
        rows.append((2 * i, own))
        if i % 3 == 0:
            rows.append((2 * i + 1, own[: 40 - i % 3] + [-i - 1] if i % 2 else [*own[2:], -i - 1, -i - 1000]))
    rows += [(500 + i, sorted(r.sample(range(5), 4))) for i in range(40)]  # short ones of frequent shingles alone
    mixed = spark.createDataFrame([(u, u) for u, _ in rows], "uid long, r long")
    sets = spark.createDataFrame([(u, s) for u, s in rows], "uid long, shingles array<long>")
    similar = lambda a, b: len(set(a) & set(b)) >= 0.8 * len(set(a) | set(b))
    want = {(a, b) for (a, s), (b, t) in itertools.combinations(rows, 2) if similar(s, t)}
    for size in (near_duplicates.BLOCK, 7):
        got = [(x.u, x.v) for x in near_duplicates._apart(mixed, sets, 0.8, size).collect()]
        assert len(got) == len(set(got)) and {(min(p), max(p)) for p in got} >= want
        assert sum(max(p) < 500 for p in got) == 40  # the 40 copies, of 12,720 pairs
    one = mixed.selectExpr("uid", "0L as r")
    assert near_duplicates._apart(one, sets, 0.8).count() == 0
