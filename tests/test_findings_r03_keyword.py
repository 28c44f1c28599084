"""Keyword search in blocks, of the third review (F20, F21)."""

import re
from collections import Counter

from lodestar.operators import retrieval


def test_common_words_make_no_row_for_each_query_and_chunk(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "CELLS", 50)
    chunks = [(i, f"The {'red' if i % 3 else 'blue'} fox-{i % 5} and the dog {i % 7}") for i in range(200)] + [(7, "red dog"), (None, "red dog 3"), (900, None), (901, ""), (902, " -- ")]
    queries = [(i, f"the dog, the {'RED' if i % 2 else 'blue'} fox-{i}") for i in range(9)] + [(3, "dog 5"), (None, "the dog"), (50, None), (51, "nothing")]
    words = lambda t: {w for w in re.split(r"[^\w-]+", (t or "").lower()) if w}
    score = Counter()
    for q, a in queries:
        for c, b in chunks:
            score[q, c] += len(words(a) & words(b))
    want = []
    for q in {q for q, _ in queries}:
        of = sorted((-n, c is None, c or 0, c) for (x, c), n in score.items() if x == q and n)[:6]
        want += [(q, k + 1, x[3], -x[0]) for k, x in enumerate(of)]
    q, c = spark.createDataFrame(queries, "query_id long, text string"), spark.createDataFrame(chunks, "chunk_id long, text string")
    for size in ({}, {"chars": 900, "query_block": 4}):
        found = retrieval.keyword_search(q, c, 6, **size)
        assert sorted(map(tuple, found.collect()), key=str) == sorted(want, key=str)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "BroadcastHashJoin" not in plan
    assert retrieval.keyword_search(q.limit(0), c, 6).count() == retrieval.keyword_search(q, c.limit(0), 6).count() == 0
