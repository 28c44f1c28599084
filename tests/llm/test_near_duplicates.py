"""Near duplicates against brute force on shingle sets."""

import itertools
import random

from lodestar.llm import near_duplicates


def sets(text):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return frozenset([b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))] if w else [])


def brute(rows):
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    s = [sets(t) for _, t in rows]
    for i, j in itertools.combinations(range(len(rows)), 2):
        if s[i] == s[j] or len(s[i] & s[j]) >= 0.8 * len(s[i] | s[j]):
            parent[root(j)] = root(i)
    return [root(i) for i in range(len(rows))]


def corpus(copies):
    r = random.Random(21)
    word = lambda: "".join(r.choices("abcdefghij", k=r.randint(2, 7)))
    rows = [(i, " ".join(word() for _ in range(r.randint(1, 80)))) for i in range(150)]
    base = [word() for _ in range(200)]
    for i in range(copies):
        w = base[:]
        for _ in range(r.randint(0, 3)):
            w[r.randrange(200)] = word()
        rows.append((1000 + i, " ".join(w).upper() if i % 5 == 0 else " ".join(w)))
    rows += [(5000 + i, t) for i, (_, t) in enumerate(rows[:20])]
    rows += [(6000, None), (6001, ""), (6002, "\t"), (6003, "One two"), (6004, "one  TWO"), (None, rows[3][1]), (None, "a lonely row"), (7, rows[7][1])]
    return rows


def test_groups_equal_brute_force(spark):
    for copies in (12, 200):
        rows = corpus(copies)
        df = spark.createDataFrame(rows, "doc_id long, text string")
        want = {}
        for k, (d, t) in zip(brute(rows), rows, strict=True):
            want.setdefault(k, []).append((d, t))
        got = {}
        joined = near_duplicates.groups(df).select("doc_id", "row_key", "root").collect()
        assert len(joined) == len(rows)
        for x in joined:
            got.setdefault(x.root, []).append(x.doc_id)
        key = lambda ids: sorted(map(str, ids))
        assert sorted(key(v) for v in got.values()) == sorted(key(d for d, _ in v) for v in want.values())


def test_one_of_each_group_stays(spark):
    rows = corpus(40)
    df = spark.createDataFrame([(d, t, i, "x") for i, (d, t) in enumerate(rows)], "doc_id long, text string, `a b` int, uid string")
    kept = near_duplicates.deduplicate(df)
    assert kept.columns == df.columns
    groups = {}
    for k, (d, _) in zip(brute(rows), rows, strict=True):
        groups.setdefault(k, []).append(d)
    least = sorted(str(min((d for d in ids if d is not None), default=None)) for ids in groups.values())
    assert sorted(str(r.doc_id) for r in kept.collect()) == least
    assert near_duplicates.deduplicate(df.limit(0)).count() == 0
