"""Whitening of embeddings: Spark MLlib's singular values of the centred rows.

Entries become whole numbers, so that sums and deviations are exact in any
order. Rows are centred by the exact mean before anything is multiplied; the
singular values of the centred rows, squared and divided by n, are the
variances of the components, and the total variance comes from the exact
deviations, apart from any decomposition.

Nulls, ties and the like: a vector that is null, empty or holds a null, NaN or
infinite entry takes no part. All vectors of a fit have one length: the most
frequent one, the longer of tied ones; others take no part. Whole numbers stop
at plus and minus ``REACH``. A component whose singular value is below
``LEAST`` times the first (or without any variance) has no rows, so that equal
vectors give none and an empty table gives none. Components of equal variance
are any orthonormal basis of their space. ``deviation`` is null where it does
not fit into a long. Ids are carried as they are, null or repeated ones too;
other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.session import materialise

COMPONENTS, SCALE, SHIFT = 8, 1024, 100_000
#: Least singular value of a component, as a share of the first.
LEAST = 1e-6
#: Largest size of a whole number, so that its sums stay exact in 38 digits.
REACH = 10**17


@dataclass
class Whitening:
    """``mean`` and ``sums`` of the whole numbers, ``basis`` (dimensions x components), variances and their total."""

    n: int
    sums: list[int]
    basis: np.ndarray
    variance: np.ndarray
    total: float

    @property
    def mean(self) -> list[float]:
        return [s / self.n for s in self.sums]


def whole(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``vec_id, x``: vectors without bad entries, as whole numbers ``floor(SCALE * c) + SHIFT``."""
    v = vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"))
    fine = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    number = lambda c: F.floor(F.greatest(F.lit(-float(REACH)), F.least(F.lit(float(REACH)), SCALE * c))).cast("long") + SHIFT
    return v.where((F.size("v") > 0) & fine).select("vec_id", F.transform("v", number).alias("x"))


def _centred(sums: list[int], n: int) -> Column:
    """``x - S/n`` in doubles: the exact whole part of the mean first, then its rest."""
    parts = F.array(*[F.struct(F.lit(s // n).cast("long").alias("q"), F.lit((s % n) / n).alias("r")) for s in sums])
    return F.zip_with("x", parts, lambda x, m: (x - m["q"]).cast("double") - m["r"])


def _deviation(sums: list[int], n: int) -> Column:
    """Sum of ``(n*x - S)^2``, exact, as decimal(38,0); null where 38 digits do not hold it."""
    parts = F.array(*[F.lit(s).cast("decimal(38,0)") if abs(s) < 2**63 else F.lit(str(s)).cast("decimal(38,0)") for s in sums])
    each = F.zip_with("x", parts, lambda x, s: (x.cast("decimal(19,0)") * F.lit(n).cast("decimal(18,0)") - s).try_cast("decimal(19,0)"))
    return F.aggregate(each, F.lit(0).cast("decimal(38,0)"), lambda acc, y: F.try_add(acc, y * y).try_cast("decimal(38,0)"))


def _rows(x: DataFrame, sums: list[int], n: int) -> RowMatrix:
    v = MLUtils.convertVectorColumnsFromML(x.select(array_to_vector(_centred(sums, n)).alias("v")), "v")
    return RowMatrix(v, n, len(sums))


def one_length(x: DataFrame) -> tuple[DataFrame, int]:
    """Vectors of the most frequent length (the longer of tied ones), and that length; 0 if there are none."""
    top = x.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    return (x, 0) if top is None else (x.where(F.size("x") == top.d), top.d)


def fit(x: DataFrame, d: int, components: int = COMPONENTS) -> Whitening:
    """The whitening of ``x`` (``vec_id, x``, all of length ``d``, at least one row)."""
    wide = x.select(*[F.element_at("x", j + 1).cast("decimal(28,0)").alias(f"x{j}") for j in range(d)])
    got = wide.agg(F.count("*").alias("n"), *[F.sum(f"x{j}").alias(f"s{j}") for j in range(d)]).first()
    n, sums = got.n, [int(got[f"s{j}"]) for j in range(d)]
    dev = x.select(_deviation(sums, n).alias("dev"), F.aggregate(_centred(sums, n), F.lit(0.0), lambda acc, y: acc + y * y).alias("rough"))
    t = dev.agg(F.try_sum("dev").alias("exact"), F.count("dev").alias("known"), F.avg("rough").alias("rough")).first()
    # entries so large that their squares leave 38 digits have their total in doubles
    total = float(t.exact) / float(n) ** 3 if t.known == n and t.exact is not None else t.rough
    if not total:  # all vectors are equal
        return Whitening(n, sums, np.zeros((d, 0)), np.zeros(0), 0.0)
    # all singular values, so that Spark decomposes the covariance by LAPACK to full precision
    svd = _rows(x, sums, n).computeSVD(d, False, LEAST)
    s = svd.s.toArray()[:components]
    return Whitening(n, sums, svd.V.toArray()[:, : len(s)], s * s / n, total)


def transform(x: DataFrame, w: Whitening) -> DataFrame:
    """``vec_id, deviation, whitened`` (an array, a value a component)."""
    c = F.col("c")
    scaled = w.basis / np.sqrt(w.variance)
    # from zip_with of a row's entries and each component's constants: doubles in a fixed order
    value = [F.aggregate(F.zip_with(c, F.lit(scaled[:, k].tolist()), lambda a, b: a * b), F.lit(0.0), lambda acc, y: acc + y) for k in range(scaled.shape[1])]
    out = x.select("vec_id", _deviation(w.sums, w.n).try_cast("long").alias("deviation"), _centred(w.sums, w.n).alias("c"))
    return out.select("vec_id", "deviation", F.array(*value).cast("array<double>").alias("whitened"))


def identity_error(whitened: DataFrame, k: int) -> float:
    """Largest absolute entry of the covariance of the ``k`` whitened columns minus the identity."""
    if not k:
        return 0.0
    w = whitened.select(*[F.element_at("whitened", i + 1).alias(f"w{i}") for i in range(k)])
    mean = w.agg(*[F.avg(f"w{i}").alias(f"m{i}") for i in range(k)]).first()
    both = [(i, j) for i in range(k) for j in range(i, k)]
    off = w.agg(*[F.avg((F.col(f"w{i}") - mean[i]) * (F.col(f"w{j}") - mean[j])).alias(f"c{i}_{j}") for i, j in both]).first()
    return max(abs(off[f"c{i}_{j}"] - (i == j)) for i, j in both)


def report(vectors: DataFrame, components: int = COMPONENTS, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """Per row and component ``vec_id, component, n, deviation, whitened, explained, identity_error``."""
    x = materialise(whole(vectors, vec_id, embedding), "whitening-whole")
    x, d = one_length(x)
    w = fit(x, d, components) if d else Whitening(0, [], np.zeros((0, 0)), np.zeros(0), 0.0)
    k = len(w.variance)
    out = materialise(transform(x, w), "whitening") if k else None
    if out is None:
        kind = x.schema["vec_id"].dataType.simpleString()
        return x.sparkSession.createDataFrame([], f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    error = identity_error(out, k)
    explained = F.element_at(F.lit((w.variance / w.total).tolist()), F.col("pos") + 1)
    each = out.select("vec_id", "deviation", F.posexplode("whitened").alias("pos", "whitened"))
    return each.select("vec_id", (F.col("pos") + 1).cast("int").alias("component"), F.lit(w.n).cast("long").alias("n"), "deviation", "whitened", explained.alias("explained"), F.lit(float(error)).alias("identity_error"))
