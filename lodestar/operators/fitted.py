"""Detectors fitted on all rows: mixture, one-class, isolation forest, state estimation.

Rows are the wide form, ``ts`` and a column a signal. Every fit reads all
complete training rows where they are: means, statistics, subgradients and
samples are summed or chosen by Spark, and only models of a fixed size reach
the driver. Scores are applied in Arrow batches without a shuffle. Rows with a
null, NaN or infinite signal take no part in a fit and have null flag and score.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import GaussianMixture
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.operators import halo
from lodestar.session import materialise

#: Rows from which the width of a kernel is learnt.
WIDTH_ROWS = 400


@dataclass
class Scaled:
    """Signals scaled by their training mean and deviation, then ``raise_`` (larger is odder) over ``limit``."""

    columns: list[str]
    mean: np.ndarray
    sd: np.ndarray
    raise_: Callable[[np.ndarray], np.ndarray]
    limit: float = 1.0

    def score(self, x: np.ndarray) -> np.ndarray:
        return self.raise_((x - self.mean) / self.sd) / self.limit


def complete(wide: DataFrame, columns: list[str]) -> DataFrame:
    """``ts`` and the signals as doubles, of rows where all are finite."""
    d = wide.select("ts", *[F.col(c).cast("double").alias(c) for c in columns])
    for c in columns:
        d = d.where(F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return d


def standard(wide: DataFrame, columns: list[str]) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """(``ts, z, x``: scaled and plain signals as arrays, means, deviations); a constant signal is only centred."""
    rows = complete(wide, columns)
    m = rows.agg(*[F.avg(c).alias(f"a{i}") for i, c in enumerate(columns)], *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(columns)]).first()
    if m.a0 is None:
        raise ValueError("no complete rows to fit on")
    mean = np.array([m[f"a{i}"] for i in range(len(columns))])
    sd = np.array([m[f"s{i}"] or 1.0 for i in range(len(columns))])
    z = F.array(*[(F.col(c) - float(a)) / float(s) for c, a, s in zip(columns, mean, sd, strict=True)])
    return rows.select("ts", z.alias("z"), F.array(*columns).alias("x")), mean, sd


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def score(wide: DataFrame, model: Scaled) -> DataFrame:
    """``ts, flag, score`` of every row; flag is 1 over the limit."""
    columns = model.columns

    def run(batches):
        for batch in batches:
            x = np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns[1:]], 1)
            ok = np.isfinite(x).all(1)
            s = np.full(len(x), np.nan)
            if ok.any():
                s[ok] = model.score(x[ok])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.where(ok, s > 1, 0).astype(np.int32), mask=~ok), pa.array(s, mask=~ok)], ["ts", "flag", "score"])

    return wide.select(F.col("ts").cast("timestamp").alias("ts"), *[F.col(c).cast("double").alias(c) for c in columns]).mapInArrow(run, "ts timestamp, flag int, score double")


def limited(wide: DataFrame, model: Scaled, outliers: float) -> Scaled:
    """The model with the limit that about a share ``outliers`` of the training rows exceeds."""
    q = score(wide, model).agg(F.percentile_approx("score", F.lit(1 - outliers), F.lit(10_000))).first()[0]
    return replace(model, limit=max(q, 1e-12))


def mixture(wide: DataFrame, columns: list[str], parts: int = 3, outliers: float = 0.01, rounds: int = 50, seed: int = 7) -> Scaled:
    """Gaussian mixture by Spark's EM, whose rounds sum statistics over all rows; low density is odd."""
    z, mean, sd = standard(wide, columns)
    data = materialise(z.select(array_to_vector("z").alias("features")), "mixture-rows")
    model = GaussianMixture(k=parts, maxIter=rounds, seed=seed).fit(data)
    parts_ = model.gaussiansDF.collect()  # a row a part
    d = len(columns)
    # a little more variance keeps a part that sits on equal rows from a density without bound
    low = [np.linalg.cholesky(np.asarray(r["cov"].toArray()) + 1e-3 * np.eye(d)) for r in parts_]
    at, weight = [r["mean"].toArray() for r in parts_], np.log(np.maximum(model.weights, 1e-300))

    def raise_(rows):
        logs = [w - 0.5 * (np.linalg.solve(c, (rows - m).T) ** 2).sum(0) - np.log(np.diag(c)).sum() for m, c, w in zip(at, low, weight, strict=True)]
        return np.exp(np.minimum(-np.logaddexp.reduce(np.stack(logs, 1), 1) / d, 700.0))

    return limited(wide, Scaled(columns, mean, sd, raise_), outliers)


def _summed(z: DataFrame, partial: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """The sum over all rows of a vector of ``size`` numbers that ``partial`` gives for a batch of rows."""

    def run(batches):
        total, n = np.zeros(size), 0
        for batch in batches:
            if batch.num_rows:
                total += partial(_matrix(batch.column(0)))
                n += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(total)], ["i", "v"])

    got = z.select("z").mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros(size)
    out[got["i"].to_numpy()] = got["v"].to_numpy()
    return out


def one_class(wide: DataFrame, columns: list[str], features: int = 256, outliers: float = 0.01, steps: int = 40, seed: int = 5) -> Scaled:
    """One-class SVM with a Gaussian kernel: random Fourier features, subgradients over all rows summed by Spark.

    The kernel's width is the median distance of ``WIDTH_ROWS`` rows, chosen by hash.
    """
    z, mean, sd = standard(wide, columns)
    z = materialise(z, "one-class-rows")
    rng = np.random.default_rng(seed)
    few = np.array([r.z for r in z.orderBy(F.xxhash64("ts", "x"), "ts").limit(WIDTH_ROWS).collect()])
    near = np.sqrt(((few[rng.integers(0, len(few), 400)] - few[rng.integers(0, len(few), 400)]) ** 2).sum(1))
    w = rng.normal(0, 1 / max(float(np.median(near)), 1e-6), (len(columns), features))
    b = rng.uniform(0, 2 * np.pi, features)
    phi = lambda rows: np.sqrt(2 / features) * np.cos(rows @ w + b)
    total = _summed(z, lambda x: np.append(phi(x).sum(0), len(x)), features + 1)
    n, v, rho = total[-1], total[:-1] / total[-1], 0.0
    for t in range(1, steps + 1):

        def gradient(x, v=v, rho=rho):
            p = phi(x)
            under = p @ v < rho
            return np.append(p[under].sum(0), under.sum())

        g = _summed(z, gradient, features + 1)
        v = v - (v - g[:-1] / (outliers * n)) / (t + 10)
        rho = rho - (g[-1] / n / outliers - 1) / (t + 10)
    return limited(wide, Scaled(columns, mean, sd, lambda rows: np.exp(rho - phi(rows) @ v)), outliers)


def _path(n: float) -> float:
    """Mean depth of a random tree of n rows."""
    return 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else float(n == 2)


@dataclass
class Tree:
    """Nodes in arrays: cut ``feature < cut`` to ``left``, else ``right``; -1 ends in a leaf. Each knows the box of its rows."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    rows: np.ndarray
    low: np.ndarray
    high: np.ndarray

    @staticmethod
    def grown(z: np.ndarray, rng: np.random.Generator) -> Tree:
        depth = int(np.ceil(np.log2(max(len(z), 2))))
        nodes: list[list] = []

        def grow(own: np.ndarray, left: int) -> int:
            at, low, high = len(nodes), own.min(0), own.max(0)
            node = [-1, 0.0, -1, -1, len(own), low, high]
            nodes.append(node)
            free = np.flatnonzero(high > low)
            if len(own) > 1 and left and len(free):
                f = int(rng.choice(free))
                cut = rng.uniform(low[f], high[f])
                below = own[:, f] < cut
                if below.any() and not below.all():
                    node[:4] = f, cut, grow(own[below], left - 1), grow(own[~below], left - 1)
            return at

        grow(z, depth)
        return Tree(*(np.array(c) for c in zip(*nodes, strict=True)))

    def depth(self, x: np.ndarray) -> np.ndarray:
        """Expected depth at which each row is alone.

        A row outside a node's box is cut off there with the chance that a
        random cut of the box and the row together falls between them; so rows
        beyond what was fitted are odder the further out they are.
        """
        out = np.zeros(len(x))
        todo = [(0, 0, np.arange(len(x)), np.ones(len(x)))]
        while todo:
            node, level, at, chance = todo.pop()
            out_of = (np.maximum(self.low[node] - x[at], 0) + np.maximum(x[at] - self.high[node], 0)).sum(1)
            off = out_of / np.maximum(out_of + (self.high[node] - self.low[node]).sum(), 1e-300)
            out[at] += chance * off * (level + 1)
            chance = chance * (1 - off)
            if self.feature[node] < 0:
                out[at] += chance * (level + _path(self.rows[node]))
                continue
            below = x[at, self.feature[node]] < self.cut[node]
            for child, own in ((self.left[node], below), (self.right[node], ~below)):
                if own.any():
                    todo.append((child, level + 1, at[own], chance[own]))
        return out


def isolation_forest(wide: DataFrame, columns: list[str], trees: int = 100, size: int = 256, outliers: float = 0.01, seed: int = 42) -> Scaled:
    """Isolation forest: each tree grows in a task of its own on ``size`` rows drawn from all by hash.

    A row joins a tree's pool with a chance that gives about twice ``size``
    rows, of which those of least hash are taken; so a sample does not depend
    on how the rows are dealt over tasks.
    """
    z, mean, sd = standard(wide, columns)
    n = z.count()
    h = F.xxhash64("ts", "x", "tree", F.lit(seed))
    most = 2.0**63 * (2 * min(1.0, 2 * size / max(n, 1)) - 1)
    pool = z.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))).withColumn("h", h).where(F.col("h").cast("double") <= most)
    d = len(columns)

    def grow(key, table):
        table = table.drop_columns(["x"]).sort_by([("h", "ascending"), ("ts", "ascending")]).slice(0, size)
        t = Tree.grown(_matrix(table["z"].combine_chunks()), np.random.default_rng([seed, key[0].as_py()]))
        lists = [pa.array(x.tolist(), pa.list_(pa.float64())) for x in (t.low, t.high)]
        return pa.table([pa.array(np.full(len(t.rows), key[0].as_py(), np.int32)), pa.array(np.arange(len(t.rows), dtype=np.int32)), *(pa.array(x.astype(k)) for x, k in ((t.feature, np.int32), (t.cut, float), (t.left, np.int32), (t.right, np.int32), (t.rows, np.int32))), *lists],
                        ["tree", "node", "feature", "cut", "left", "right", "rows", "low", "high"])

    shape = "tree int, node int, feature int, cut double, left int, right int, rows int, low array<double>, high array<double>"
    grown = pool.groupBy("tree").applyInArrow(grow, shape).toArrow().sort_by([("tree", "ascending"), ("node", "ascending")])  # trees x 2 x size nodes at most
    tree = grown["tree"].to_numpy()
    cols = [grown[c].to_numpy() for c in ("feature", "cut", "left", "right", "rows")] + [_matrix(grown[c].combine_chunks()).reshape(-1, d) for c in ("low", "high")]
    forest = [Tree(*(c[tree == t] for c in cols)) for t in np.unique(tree)]
    norm = max(_path(min(size, n)), 1e-9)
    raise_ = lambda rows: 2.0 ** (-np.mean([t.depth(rows) for t in forest], 0) / norm)
    return limited(wide, Scaled(columns, mean, sd, raise_), outliers)


def memory_estimate(wide: DataFrame, columns: list[str], memory: int = 200, outliers: float = 0.01) -> Scaled:
    """Multivariate state estimation: distance to a similarity-weighted mix of memory vectors.

    The memory has the rows with each signal's extremes, and rows at ``memory``
    quantiles of the distance from the mean.
    """
    z, mean, sd = standard(wide, columns)
    z = materialise(z.withColumn("norm", F.aggregate("z", F.lit(0.0), lambda a, x: a + x * x)), "memory-rows")
    ends = z.agg(*[f(F.struct(F.element_at("z", i + 1).alias("v"), F.col("z").alias("z"))).alias(f"{k}{i}") for i in range(len(columns)) for k, f in (("a", F.min), ("b", F.max))], F.percentile_approx("norm", F.lit([i / max(memory - 1, 1) for i in range(memory)]), F.lit(10_000)).alias("q")).first()
    at = z.where(F.col("norm").isin(sorted(set(ends.q)))).groupBy("norm").agg(F.min("z").alias("z")).collect()  # a row a quantile
    d = np.unique(np.array([ends[f"{k}{i}"].z for i in range(len(columns)) for k in "ab"] + [r.z for r in at]), axis=0)

    def likeness(a, b):
        return 1 / (1 + np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * a @ b.T, 0)))

    inverse = np.linalg.pinv(likeness(d, d) + 1e-6 * np.eye(len(d)))

    def raise_(rows):
        w = likeness(rows, d) @ inverse
        return ((rows - w / np.maximum(np.abs(w.sum(1, keepdims=True)), 1e-9) @ d) ** 2).sum(1)

    return limited(wide, Scaled(columns, mean, sd, raise_), outliers)


@dataclass
class Sprt:
    """Sequential probability ratio test of a score whose mean rises by ``shift`` deviations.

    The test of a row begins anew ``context`` steps before it, so that it is a
    function of these rows alone; an alert is ``count`` decisions in the last
    ``window`` steps.
    """

    mean: float
    sd: float
    step_s: float = 60.0
    context: int = 120
    count: int = 3
    window: int = 5
    shift: float = 3.0
    alpha: float = 0.01
    beta: float = 0.1

    @property
    def halo_s(self) -> float:
        return (self.context + self.window) * self.step_s


def sprt_trained(wide: DataFrame, model: Scaled, **params) -> Sprt:
    """The test with the mean and deviation of the training rows' scores."""
    m = score(wide, model).agg(F.avg("score"), F.stddev_pop("score")).first()
    return Sprt(m[0], m[1] or 1e-12, **params)


def decisions(ts: np.ndarray, x: np.ndarray, t: Sprt) -> np.ndarray:
    """1 where the test decides at this row (in order of time, NaN tells nothing), from its own context; all rows at once."""
    upper, lower = np.log((1 - t.beta) / t.alpha), np.log(t.beta / (1 - t.alpha))
    gain = np.where(np.isnan(x), 0.0, t.shift * ((x - t.mean) / t.sd - t.shift / 2))
    begin = np.searchsorted(ts, ts - t.context * t.step_s, "right")
    total, fired = np.zeros(len(x)), np.zeros(len(x), bool)
    order = np.arange(len(x))
    for k in range(int((order - begin).max(initial=-1)) + 1):
        live = order[begin + k <= order]
        at = begin[live] + k
        s = np.maximum(total[live], lower) + gain[at]
        fired[live] = (s >= upper) & ~np.isnan(x[at])
        total[live] = np.where((s >= upper) | (s <= lower), 0.0, s)
    return fired.astype(int)


def mset_sprt(wide: DataFrame, model: Scaled, test: Sprt, range_s: float = 30 * 86400) -> DataFrame:
    """``ts, flag, score`` of every row by state estimation and the sequential test; null where a signal is missing.

    Each range of ``range_s`` seconds is one task, with the context before it;
    the result is the same for any ``range_s``. Rows of one time follow in
    order of their score.
    """
    scored = score(wide, model)
    rows = halo.ranges(scored.where("ts is not null"), "ts", range_s, test.halo_s).withColumn("at", halo.seconds(F.col("ts")))

    def run(key, table):
        table = table.sort_by([("at", "ascending"), ("score", "ascending")])
        at, x = table["at"].to_numpy(), table["score"].to_numpy(zero_copy_only=False).astype(float)
        hit = np.append(0, np.cumsum(decisions(at, x, test)))
        since = np.searchsorted(at, at - test.window * test.step_s, "right")
        flag = (hit[1:] - hit[since] >= test.count).astype(np.int32)
        out = pa.table([table["ts"], pa.array(flag, mask=np.isnan(x)), table["score"]], ["ts", "flag", "score"])
        return out.filter(table["own"])

    return rows.groupBy("range").applyInArrow(run, "ts timestamp, flag int, score double")
