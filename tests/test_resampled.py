"""Near names, tests over tables, rankings, spooled files and views against plain readings."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.functions import text
from lodestar.operators import names, resampling, retrieval
from lodestar.sources import files, views


@pytest.mark.parametrize("k", [1, 2])
def test_near_names_against_all_pairs(spark, k):
    rng = random.Random(k)
    words = {"", "a", "ab", "ba", "né", "nè", "x" * 40, "x" * 39 + "y"} | {"".join(rng.choices("abc", k=rng.randrange(1, 7))) for _ in range(120)}
    got = names.near_names(spark.createDataFrame([(w,) for w in [*words, None, "ab", "ab"]], "n string"), "n", k).collect()
    want = {(a, b): d for a, b in itertools.combinations(sorted(words), 2) if (d := text.osa(a, b)) <= k}
    assert {(r.a, r.b): r.distance for r in got} == want and len(got) == len(want)


def test_distances_of_slices(monkeypatch):
    rng = random.Random(1)
    pairs = [tuple("".join(rng.choices("ab1", k=rng.randrange(0, 12))) for _ in range(2)) for _ in range(300)]
    for cells in (names.CELLS, 40):
        monkeypatch.setattr(names, "CELLS", cells)
        assert names.osa_distances(*map(list, zip(*pairs, strict=True))).tolist() == [text.osa(a, b) for a, b in pairs]


def micro(c):
    tp, fp, fn = (sum(x) for x in zip(*c, strict=True))
    return 2 * tp / (2 * tp + fp + fn) if tp + fp + fn else 1.0


def test_permutations_against_all_flips(spark, monkeypatch):
    rng, rows, want = random.Random(3), [], {}
    for c, n in (("x", 1), ("y", 6), ("z", 7)):
        a, b = ([tuple(rng.randrange(4) for _ in range(3)) for _ in range(n)] for _ in range(2))
        rows += [(c, f"u{i}", *x, *y) for i, (x, y) in enumerate(zip(a, b, strict=True))]
        far = [abs(micro([y if s else x for x, y, s in zip(a, b, f, strict=True)]) - micro([x if s else y for x, y, s in zip(a, b, f, strict=True)])) for f in itertools.product((0, 1), repeat=n)]
        want[c] = (n, sum(x >= abs(micro(a) - micro(b)) - 1e-12 for x in far), 2**n)
    df = spark.createDataFrame(rows, "comparison string, unit string, a_tp int, a_fp int, a_fn int, b_tp int, b_fp int, b_fn int")
    for block in (resampling.BLOCK, 8):
        monkeypatch.setattr(resampling, "BLOCK", block)
        got = resampling.permutation_test(df.repartition(3)).collect()
        assert {r.comparison: (r.units, r.extreme, r.total) for r in got} == want
    with pytest.raises(Exception, match="more than 24 units"):
        resampling.permutation_test(spark.range(25).select(F.lit(1).alias("comparison"), F.col("id").alias("unit"), *[F.lit(1).alias(c) for c in df.columns[2:]])).collect()


def test_bootstrap_shares_one_draw(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(c, u, rng.random(), rng.random()) for c in ("p", "q") for u in range(30) if c == "p" or u % 5] + [("q", 3, None, 1.0)]
    df = spark.createDataFrame(rows, "comparison string, unit int, a double, b double")
    draws = resampling.draw(np.arange(200)[:, None], np.arange(30), 9, 30)
    want = {}
    for c in ("p", "q"):
        d, m = np.zeros(30), np.zeros(30)
        for x, u, a, b in rows:
            if x == c and a is not None:
                d[u] += a - b
                m[u] += 1
        means = d[draws].sum(1) / m[draws].sum(1)
        want[c] = (int(m.sum()), d.sum() / m.sum(), np.quantile(means, 0.05))
    assert np.bincount(resampling.draw(np.arange(4000)[:, None], np.arange(30), 1, 30).ravel()).std() / 4000 < 0.03  # even
    for bound in (resampling.SENT_NUMBERS, 0):  # sent to tasks, or joined
        monkeypatch.setattr(resampling, "SENT_NUMBERS", bound)
        got = {r.comparison: (r.units, r.difference, r.bound) for r in resampling.paired_bootstrap(df.repartition(3), 200, 9).collect()}
        assert got.keys() == want.keys() and all(got[c] == pytest.approx(want[c]) for c in want)


def test_rankings_up_to_ties(spark):
    hits = [
        ("A", 1, 1, "a", 0.9), ("A", 1, 2, "b", 0.9), ("A", 1, 3, "c", 0.5), ("B", 1, 1, "b", 0.9), ("B", 1, 2, "a", 0.9), ("B", 1, 3, "c", 0.5),  # a tie swapped
        ("A", 2, 1, "a", 0.9), ("A", 2, 2, "b", 0.8), ("B", 2, 1, "b", 0.9), ("B", 2, 2, "a", 0.8),  # an order changed
        ("A", 3, 1, "a", 0.9), ("A", 3, 2, "b", 0.8), ("B", 3, 1, "a", 0.9), ("B", 3, 2, "z", 0.8),  # the last tie cut
        ("A", 4, 1, "a", 0.9), ("B", 5, 1, "a", 0.9), ("A", 6, 1, "a", 0.9), ("B", 6, 1, "a", 0.7), ("B", 6, 2, "b", 0.1),
    ]
    df = spark.createDataFrame(hits, "run string, query int, rank int, id string, score double")
    got = {r.query: (r.identical, r.equivalent, r.overlap) for r in retrieval.compared(df, "A", "B").collect()}
    assert got == {1: (False, True, 3), 2: (False, False, 2), 3: (False, True, 1), 4: (False, False, 0), 5: (False, False, 0), 6: (False, False, 1)}
    strict = {r.query: r.equivalent for r in retrieval.compared(df, "A", "B", truncated=False).collect()}
    assert strict[1] and not strict[3]
    p = retrieval.passes(df, "A", "B").first()
    assert (p.compared, p.different, p.not_equivalent, round(p.max_drift, 6)) == (6, 6, 4, 0.2)


def test_spool_over_many_blocks(spark, tmp_path):
    lines, want, name, n = ["before any"], [], None, {}
    rng = random.Random(6)
    for i in range(400):
        if rng.random() < 0.04:
            name = rng.choice(["one", "two", "three four"])
            lines.append(f"@@ {name}")
        else:
            lines.append(f"{i}," + "x" * rng.randrange(12))
            if name:
                n[name] = n.get(name, 0) + 1
                want.append((name, n[name], lines[-1]))
    (tmp_path / "spool").write_text("\n".join(lines) + "\n")
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        assert files.ordered_lines(spark, str(tmp_path / "spool")).select("block").distinct().count() > 8
        assert sorted(map(tuple, files.spool(spark, str(tmp_path / "spool")).collect())) == sorted(want)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_view_builds_only_what_changed(spark, tmp_path):
    built = []

    def build(rows):
        built.append(sorted(str(r[0]) for r in rows.select("p").distinct().collect()))
        return rows.groupBy("p").agg(F.sum("v").alias("v"))

    view = views.View(spark, str(tmp_path / "v"), F.col("p"), build)
    with pytest.raises(ValueError, match="not been built"):
        view.read(F.col("p"))
    one = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), ("c", 4)], "p string, v int")
    assert view.refresh(one) == (3, 0, 0) and view.refresh(one.orderBy(F.desc("v"))) == (0, 3, 0)
    two = spark.createDataFrame([("a", 1), ("a", 2), ("b", 5), (None, 6)], "p string, v int")
    assert view.refresh(two) == (2, 1, 1)
    assert sorted(map(tuple, view.read(F.col("p")).collect()), key=str) == sorted([("a", 3), ("b", 5), (None, 6)], key=str)
    assert built[0] == ["a", "b", "c"] and len(built) == 2
