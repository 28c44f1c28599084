"""Bags of rows matched with tolerance, against trying all pairings."""

import itertools
import random

from lodestar.operators import matching

ROWS = "bag int, a double, b double, c string"


def near(x, y, tolerance=1.0):
    same = lambda p, q: p == q or (p is not None and q is not None and (p != p and q != q or abs(p - q) < tolerance))
    return same(x[0], y[0]) and same(x[1], y[1]) and x[2] == y[2]


def brute(gold, result):
    return len(gold) == len(result) and any(all(map(near, gold, p)) for p in itertools.permutations(result))


def test_small_bags_against_all_pairings(spark):
    rng = random.Random(2)
    bags, gold, result = {}, [], []
    for k in range(160):
        n = rng.randrange(0, 6)
        value = lambda: (rng.choice([None, float("nan"), *[i / 2 for i in range(6)]]), rng.choice([0.0, 0.75, 1.5]), rng.choice(["x", None]))
        g = [value() for _ in range(n)]
        r = [(a if a is None else a + rng.choice([0, 0.5, -0.9]), b + rng.choice([0, 0.75]), c) for a, b, c in g] if rng.random() < 0.8 else [value() for _ in range(rng.randrange(0, 6))]
        rng.shuffle(r)
        if g or r:
            bags[k] = (g, r)
            gold += [(k, *x) for x in g]
            result += [(k, *x) for x in r]
    got = matching.tolerant_rows(spark.createDataFrame(gold, ROWS), spark.createDataFrame(result, ROWS).repartition(3), ["bag"], ["a", "b", "c"], 1.0)
    want = {k: (len(g), len(r), brute(g, r)) for k, (g, r) in bags.items()}
    assert {x.bag: (x.n_gold, x.n_result, x.matches) for x in got.collect()} == want
    assert {True, False} == {w[2] for w in want.values()}


def test_where_greedy_fails(spark):
    # 1.0 may take 1.6 or 0.4, but 2.2 has only 1.6; and first to first fails in two columns
    gold = [(1, 1.0, 0.0, "x"), (1, 2.2, 0.0, "x"), (2, 0.0, 0.0, "x"), (2, 0.9, 0.9, "x"), (3, 1.0, 1.0, "x")]
    result = [(1, 1.6, 0.0, "x"), (1, 0.4, 0.0, "x"), (2, 0.8, 0.8, "x"), (2, 1.8, 0.1, "x"), (3, 1.0, 1.0, "y")]
    got = matching.tolerant_rows(spark.createDataFrame(gold, ROWS), spark.createDataFrame(result, ROWS), ["bag"], ["a", "b", "c"], 1.0)
    assert {r.bag: r.matches for r in got.collect()} == {1: True, 2: True, 3: False}


def test_long_chains_and_many_repeats(spark):
    gold = [(1, i * 0.6, 0.0, "x") for i in range(300)] + [(2, 5.0, 0.0, "x")] * 4000
    result = [(1, i * 0.6 + 0.5, 0.0, "x") for i in range(300)] + [(2, 5.5, 0.0, "x")] * 3000 + [(2, 4.5, 0.0, "x")] * 1000
    got = matching.tolerant_rows(spark.createDataFrame(gold, ROWS), spark.createDataFrame(result, ROWS), ["bag"], ["a", "b", "c"], 1.0)
    assert {r.bag: (r.n_gold, r.matches) for r in got.collect()} == {1: (300, True), 2: (4000, True)}
    empty = spark.createDataFrame([], ROWS)
    assert matching.tolerant_rows(empty, empty, ["bag"], ["a", "b", "c"]).count() == 0


def test_dealing():
    assert matching.saturated({0: 3, 2: 2}, {1: 2, 3: 3}, {0: [1, 3], 2: [1]})
    assert not matching.saturated({0: 3, 2: 3}, {1: 2, 3: 4}, {0: [1, 3], 2: [1]})
    assert not matching.saturated({0: 1}, {1: 2}, {0: [1]}) and matching.saturated({}, {}, {})
