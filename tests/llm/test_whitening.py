"""Whitening against numpy."""

import math

import numpy as np
import pytest
from lodestar.llm import whitening

FIELDS = "vec_id long, embedding array<float>, component int"


def reference(vectors):
    x = np.array([[math.floor(1024 * float(np.float32(c))) + 100_000 for c in v] for v in vectors])
    n, s = len(x), x.sum(0)
    c = (n * x - s) / n
    values, basis = np.linalg.eigh(c.T @ c / n)
    values, basis = values[::-1][:8], basis[:, ::-1][:, :8]
    return ((n * x - s) ** 2).sum(1), c @ basis / np.sqrt(values), values / np.trace(c.T @ c / n)


def compare(spark, vectors):
    rows = [(i, [float(c) for c in v], 9) for i, v in enumerate(vectors)]
    bad = [(900, None, 1), (901, [1.0, None], 1), (902, [float("nan")] * len(vectors[0]), 1), (903, [float("inf")] + [0.0] * (len(vectors[0]) - 1), 1), (904, [], 1), (905, [1.0], 1)]
    got = whitening.report(spark.createDataFrame(rows + bad, FIELDS)).toPandas()
    deviation, white, explained = reference(vectors)
    k = white.shape[1]
    assert len(got) == len(vectors) * k and set(got.n) == {len(vectors)} and got.identity_error.max() < 1e-9
    assert (got[got.component == 1].sort_values("vec_id").deviation.to_numpy() == deviation).all()
    w = got.pivot(index="vec_id", columns="component", values="whitened").sort_index().to_numpy()
    assert np.allclose(w * np.sign((w * white).sum(0)), white, atol=1e-8)
    assert np.allclose(got.groupby("component").explained.first().to_numpy(), explained, rtol=1e-9)


@pytest.mark.parametrize("d", [2, 5, 24])
def test_random_vectors(spark, d):
    rng = np.random.default_rng(d)
    compare(spark, rng.normal(3, rng.uniform(0.2, 4, d), (200, d)).astype(np.float32))


def test_long_axis_and_repeats(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(0, 1, (60, 12)).astype(np.float32) * np.array([300, 40, 9, 5, 3, 2, 1.5, 1, 0.8, 0.5, 0.3, 0.2], np.float32)
    compare(spark, np.concatenate([x, x[:20], x[:20]]))


def test_no_component_without_variance(spark):
    # only three directions vary, so three components
    rng = np.random.default_rng(3)
    x = rng.integers(-9, 9, (80, 3)) @ rng.integers(-3, 3, (3, 10))
    got = whitening.report(spark.createDataFrame([(i, v.astype(float).tolist(), 0) for i, v in enumerate(x)], FIELDS)).toPandas()
    assert sorted(set(got.component)) == [1, 2, 3] and got.identity_error.max() < 1e-9 and abs(got.groupby("component").explained.first().sum() - 1) < 1e-9
    same = spark.createDataFrame([(i, [1.0, 2.0], 0) for i in range(4)], FIELDS)
    assert whitening.report(same).count() == 0 and whitening.report(same.where("false")).count() == 0
    assert whitening.report(spark.createDataFrame([(1, None, 0)], FIELDS)).count() == 0


def test_huge_entries(spark):
    rows = [(i, [float(i % 3) * 1e30, -1e20 * (i % 2), 1.0 * i], 0) for i in range(12)]
    got = whitening.report(spark.createDataFrame(rows, FIELDS)).toPandas()
    assert len(got) and got.deviation.isna().any() and np.isfinite(got.whitened).all()


def test_null_and_repeated_ids(spark):
    rows = [(None, [1.0, 2.0], 0), (None, [2.0, 1.0], 0), (7, [0.0, 0.5], 0), (7, [0.0, 0.5], 0)]
    got = whitening.report(spark.createDataFrame(rows, FIELDS)).toPandas()
    assert len(got) == 8 and got.vec_id.isna().sum() == 4
