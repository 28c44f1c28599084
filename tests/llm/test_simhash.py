import itertools
import random

import numpy as np
import pytest
import xxhash

from lodestar.llm import simhash


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def brute(rows):
    fps = []
    for _, text in rows:
        w = lower(text or "").encode().split()
        sh = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        hs = [xxhash.xxh64_intdigest(s, 42) for s in sh]
        fps.append(sum((2 * sum(h >> b & 1 for h in hs) > len(hs)) << b for b in range(64)))
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= 2:
            parent[root(j)] = root(i)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    brute.groups = len({root(i) for i in range(len(rows))})
    return [(d, f"{f:016x}", least.get(root(i))) for i, ((d, _), f) in enumerate(zip(rows, fps))]


def corpus():
    r = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(r.choices(words, k=r.randint(1, 60)))) for i in range(120)]
    base = r.choices(words, k=400)
    for i in range(70):  # near copies: a long text with a word changed
        w = base[:]
        w[r.randrange(400)] = r.choice(words)
        rows.append((200 + i, " ".join(w)))
    rows += [(300, None), (301, ""), (302, " \t\n"), (303, "One"), (304, "ONE"), (305, "one two"), (306, "É a É"), (None, "lonely row here now"), (None, rows[0][1]), (5, rows[5][1]), (5, "other text altogether")]
    return rows


def test_equals_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, fp string")
    got = sorted((tuple(x) for x in simhash.report(df).collect()), key=str)
    assert got == sorted(brute(rows), key=str)


def test_large_keys_take_the_other_exact_way(spark):
    r = random.Random(8)
    center = r.getrandbits(64)
    fps = {center} | {center ^ (1 << a) ^ (1 << b) for a, b in ((r.randrange(64), r.randrange(64)) for _ in range(150))} | {r.getrandbits(64) for _ in range(100)}
    fps = sorted(np.array(sorted(fps), np.uint64).view(np.int64).tolist())
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    from lodestar.llm.components import components

    n, p, corr = simhash.bit_statistics(df)
    for parts in (simhash.plan(n, p, corr), [(list(range(32)), 1), (list(range(32, 64)), 0)]):
        got = {(x.u, x.v) for x in components(simhash.links(df, parts, pairs=4)).collect()}
        u = [f & (2**64 - 1) for f in fps]
        parent = {f: f for f in fps}

        def root(f):
            while parent[f] != f:
                f = parent[f]
            return f

        for (i, a), (j, b) in itertools.combinations(enumerate(u), 2):
            if (a ^ b).bit_count() <= 2:
                x, y = root(fps[i]), root(fps[j])
                parent[max(x, y)] = min(x, y)
        assert got == {(f, root(f)) for f in fps if root(f) != f}


def test_allotment_is_the_cheapest():
    r = random.Random(2)
    for _ in range(30):
        costs = [[0.0, r.random(), r.random() * 9] for _ in range(r.randint(2, 4))]
        total = 2 - len(costs) + 1
        every = [(sum(c[t + 1] for c, t in zip(costs, ts)), list(ts)) for ts in itertools.product((-1, 0, 1), repeat=len(costs)) if sum(ts) == total]
        assert simhash.allot(costs, total)[0] == pytest.approx(min(every)[0])


def test_deduplicate_keeps_one_of_each_group(spark):
    rows = corpus()
    df = spark.createDataFrame([(d, t, i) for i, (d, t) in enumerate(rows)], "doc_id long, text string, __n int")
    kept = simhash.deduplicate(df)
    assert kept.columns == df.columns
    brute(rows)
    assert kept.count() == brute.groups
    assert simhash.deduplicate(df.limit(0)).count() == 0
