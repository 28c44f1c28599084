"""Nearest neighbours by additive quantisation, with exact reranking.

A vector is split into its norm (in double precision, so that components of any
finite size take part) and its direction. A direction is approximated by the
sum of M codewords, one from each of M full-dimensional codebooks. Codebooks
start as residual k-means and are refined by least squares over beam-search
codes; they are fitted on at most ``SAMPLE`` distinct vectors (least hash of id
first), while every vector is encoded and searched. The index row of a vector
holds its M code bytes, its norm, and the norm of its approximation, which
rescales looked-up inner products. Codes travel with their vectors, so that a
task rescores what it found and returns no more than a ranking can use.

The index is divided into cells: power-of-two bands of the norm, times a pair
of centroids of the direction's two halves, so many that a cell has about
``CELL`` vectors. A query probes the cells of largest estimated inner product.
In a cell, inner products of the queries with all codewords form a lookup
table, a vector's score is the sum of M lookups, and the best candidates of a
query in each block are rescored there with their original vectors in double
precision. Work and shuffle are thus in proportion to the rows, up to
``HALF``^2 cells a band; beyond them cells grow.

Recall is measured before the search: ``TRIAL`` queries, drawn among all
queries, copies included, are searched exactly. Probes are the fewest whose
cells hold their neighbours (all cells if ``MOST_PROBES`` do not), and
candidates are doubled until ``TARGET`` of the neighbours are found. A neighbour
is found if its id is: of vectors with one score only those of least ids are
neighbours, and lookups tell such vectors apart by chance, so that tied scores
take more candidates.

Equal vectors are searched once and stand for their least k + 1 ids, which is
all that a ranking of k with ties to the smaller id can use.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestar.session import materialise

BOOKS, WORDS, BEAM, SAMPLE = 32, 64, 4, 16_384
#: Vectors a cell; centroids of a half at most.
CELL, HALF = 65_536, 1024
#: Candidates the trial starts with, its number of queries, the recall it asks for, the probes it weighs.
CANDIDATES, TRIAL, TARGET, MOST_PROBES = 200, 64, 0.97, 4096
CODE_BLOCK, QUERY_BLOCK = 65_536, 512
#: Numbers of the vectors of a block of codes at most; how many more are kept of a block than a ranking needs.
NUMBERS, SPARE = 1 << 22, 8


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    c = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        near = np.argmin((c * c).sum(1) - 2 * x @ c.T, 1)
        n = np.bincount(near, minlength=k)
        order = np.argsort(near, kind="stable")
        c[n > 0] = np.add.reduceat(x[order], (np.cumsum(n) - n)[n > 0]) / n[n > 0, None]
        c[n == 0] = x[rng.choice(len(x), int((n == 0).sum()))]
    return c


def encode(x: np.ndarray, books: np.ndarray, beam: int = BEAM) -> np.ndarray:
    """Beam search: codes (n, M) whose codewords' sum is near x."""
    m, k, d = books.shape
    flat = books.reshape(m * k, d)
    dots, gram = x @ flat.T, flat @ flat.T
    rows = np.arange(len(x))[:, None]
    codes = np.zeros((len(x), 1, 0), np.int64)
    cost = np.zeros((len(x), 1), np.float32)
    for b in range(m):
        own = slice(b * k, (b + 1) * k)
        step = np.diag(gram)[own] - 2 * dots[:, None, own] + 2 * sum((gram[codes[:, :, j] + j * k, own] for j in range(b)), np.float32(0))
        total = (cost[:, :, None] + step).reshape(len(x), -1)
        width = min(beam, total.shape[1])
        best = np.argpartition(total, width - 1, 1)[:, :width]
        cost = total[rows, best]
        codes = np.concatenate([codes[rows, best // k], (best % k)[:, :, None]], 2)
    return codes[np.arange(len(x)), np.argmin(cost, 1)].astype(np.uint8)


def train(x: np.ndarray, books: int = BOOKS, words: int = WORDS, rounds: int = 1) -> np.ndarray:
    rng = np.random.default_rng(11)
    x = x.astype(np.float32)
    left, out = x.copy(), []
    for _ in range(books):
        c = kmeans(left, words, rng)
        left = left - c[np.argmin((c * c).sum(1) - 2 * left @ c.T, 1)]
        out.append(c)
    c = np.stack(out)
    for _ in range(rounds):
        size = books * words
        gram, right = np.zeros((size, size)), np.zeros((size, x.shape[1]))
        for i in range(0, len(x), 512):
            part = x[i : i + 512]
            used = np.zeros((len(part), size), np.float32)
            np.put_along_axis(used, encode(part, c).astype(np.int64) + np.arange(books) * words, 1, 1)
            gram += used.T @ used
            right += used.T @ part
        # codewords that no vector uses, and small shifts between books, stay where they are
        ridge = 0.1
        c = np.linalg.solve(gram + ridge * np.eye(size), right + ridge * c.reshape(size, -1)).astype(np.float32).reshape(c.shape)
    return c


def valid(vectors: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """``id, v``: usable vectors (not null, not zero, all components finite), as doubles.

    Vectors shorter than the longest are filled up with zeros, which changes no inner product.
    """
    ok = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("v", lambda c: c != 0)
    d = vectors.select(F.col(vec_id).try_cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull() & ok)
    sizes = d.agg(F.min(F.size("v")).alias("low"), F.max(F.size("v")).alias("high")).first()
    if sizes.low == sizes.high:
        return d
    return d.select("id", F.concat("v", F.array_repeat(F.lit(0.0), F.lit(sizes.high) - F.size("v"))).alias("v"))


def split(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(norms in double precision, directions as float32)."""
    top = np.abs(x).max(1)
    u = x / top[:, None]
    size = np.sqrt((u * u).sum(1))
    with np.errstate(over="ignore"):
        norm = np.minimum(top * size, np.finfo(float).max)
    return norm, (u / size[:, None]).astype(np.float32)


@dataclass
class Index:
    """Codebooks (M, words, d) and the centroids of the two halves of a direction."""

    books: np.ndarray
    halves: tuple[np.ndarray, np.ndarray]
    bands: list[int]

    @classmethod
    def fit(cls, x: np.ndarray, n: int, bands: list[int]) -> Index:
        _, u = split(x)
        k = int(min(HALF, max(1, np.ceil(np.sqrt(n / CELL / max(len(bands), 1)))), max(1, len(u) // 8)))
        rng, half = np.random.default_rng(5), (u.shape[1] + 1) // 2
        return cls(train(u), tuple(kmeans(part, k, rng) for part in (u[:, :half], u[:, half:])), bands)

    def cells(self, norm: np.ndarray, u: np.ndarray) -> np.ndarray:
        """band * HALF^2 + place of the first half * HALF + place of the second."""
        out, at = band(norm) * HALF * HALF, 0
        for c, step in zip(self.halves, (HALF, 1), strict=True):
            part = u[:, at : at + c.shape[1]]
            out += np.argmin((c * c).sum(1) - 2 * part @ c.T, 1) * step
            at += c.shape[1]
        return out

    def all_cells(self) -> int:
        return len(self.bands) * len(self.halves[0]) ** 2

    def probes(self, u: np.ndarray, n: int) -> np.ndarray:
        """The n cells of largest estimated inner product with each direction (all, if fewer)."""
        half, k = self.halves[0].shape[1], len(self.halves[0])
        n = min(n, self.all_cells())
        # with both halves in order, the cell (i, j) has (i + 1) (j + 1) - 1 cells before it
        i = np.repeat(np.arange(k), [min(k, n // (r + 1)) for r in range(k)])
        j = np.concatenate([np.arange(min(k, n // (r + 1))) for r in range(k)])
        bands = np.array(self.bands, np.int64)
        scale = np.ldexp(0.75, np.maximum(bands - bands.max(), -1000))  # the middle of a band stands for its norms
        out, block = [], max(1, (1 << 22) // (len(i) * len(bands)))
        for at in range(0, len(u), block):
            one, two = u[at : at + block, :half] @ self.halves[0].T, u[at : at + block, half:] @ self.halves[1].T
            a, b = np.argsort(-one, 1, kind="stable"), np.argsort(-two, 1, kind="stable")
            both = np.take_along_axis(one, a, 1)[:, i] + np.take_along_axis(two, b, 1)[:, j]
            score = (both[:, None, :] * scale[:, None]).reshape(len(one), -1)
            cell = ((a[:, i] * HALF + b[:, j])[:, None, :] + bands[:, None] * HALF * HALF).reshape(len(one), -1)
            out.append(np.take_along_axis(cell, np.argsort(-score, 1, kind="stable")[:, :n], 1))
        return np.concatenate(out)


def band(norm: np.ndarray) -> np.ndarray:
    return np.frexp(norm)[1].astype(np.int64) - 1


def _vectors(batch: pa.RecordBatch) -> np.ndarray:
    v = batch.column(batch.schema.get_field_index("v"))
    return v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1)


def _bands(batches):
    for batch in batches:
        if batch.num_rows:
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(band(split(_vectors(batch))[0])))], ["band"])


def _encode(index: Index):
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            norm, u = split(_vectors(batch))
            codes = np.concatenate([encode(u[i : i + 512], index.books) for i in range(0, len(u), 512)])
            near = np.linalg.norm(index.books[np.arange(len(index.books)), codes].sum(1).astype(float), axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(index.cells(norm, u)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(norm), pa.array(near)], ["rep", "first", "v", "cell", "codes", "norm", "near_norm"])

    return run


def _probe(index: Index, n: int):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                cells = index.probes(split(_vectors(batch))[1], n)
                at = pa.array(np.repeat(np.arange(len(cells)), cells.shape[1]))
                yield pa.RecordBatch.from_arrays([batch.column("rep").take(at), pa.array(cells.ravel())], ["q", "cell"])

    return run


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    v = column.combine_chunks()
    return v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1)


def _ranked(score: np.ndarray, first: np.ndarray, n: int) -> np.ndarray:
    """Places of the n best scores, ties to the smaller ``first``."""
    level = np.partition(score, len(score) - n)[len(score) - n]
    near = np.flatnonzero(score >= level)
    return near[np.lexsort((first[near], -score[near]))[:n]]


def _search(books: np.ndarray, top: int, keep: int):
    """A block of queries and one of codes -> of each query the ``keep`` best by original vectors among the ``top`` by lookups."""
    m, k, d = books.shape

    def run(key, queries: pa.Table, codes: pa.Table) -> pa.Table:
        asked, found, near = [], [], []
        if len(queries) and len(codes):
            codes = codes.sort_by("rep")
            rep, first, v = codes["rep"].to_numpy(), codes["first"].to_numpy(), _matrix(codes["v"])
            c = np.frombuffer(b"".join(codes["codes"].to_pylist()), np.uint8).reshape(-1, m)
            scale = codes["norm"].to_numpy() / np.maximum(codes["near_norm"].to_numpy(), 1e-12)
            n, ids, wanted = min(top, len(rep)), queries["rep"].to_numpy(), _matrix(queries["v"])
            for i in range(0, len(ids), 32):
                x = wanted[i : i + 32]
                table = split(x)[1] @ books.reshape(m * k, d).T
                score = sum(table[:, b * k : (b + 1) * k][:, c[:, b]] for b in range(m)) * scale
                best = np.sort(np.argpartition(-score, n - 1, 1)[:, :n], 1)
                for q, vector, at in zip(ids[i : i + 32].tolist(), x, best, strict=True):
                    with np.errstate(over="ignore", invalid="ignore"):
                        exact = np.nan_to_num(v[at] @ vector, nan=-np.inf, posinf=np.inf, neginf=-np.inf)
                    own = _ranked(exact, first[at], min(keep, n))
                    asked.append(np.full(len(own), q))
                    found.append(at[own])
                    near.append(exact[own])
        if not found:
            return pa.table({"q": np.zeros(0, np.int64), "rep": np.zeros(0, np.int64), "first": np.zeros(0, np.int64), "near": np.zeros(0)})
        at = np.concatenate(found)
        return pa.table({"q": np.concatenate(asked), "rep": rep[at], "first": first[at], "near": np.concatenate(near)})

    return run


def _dot(x, y):
    return F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda s, c: s + c)


def _candidates(wanted: DataFrame, codes: DataFrame, sizes: DataFrame, index: Index, probes: int, candidates: int, keep: int) -> DataFrame:
    """``q, rep``: ``keep`` and a few more of each query by original vectors, among ``candidates`` by looked-up scores in each block of its cells.

    A large cell is dealt out in blocks of codes, a much asked one in blocks of queries.
    """
    asked = wanted.mapInArrow(_probe(index, probes), "q long, cell long").join(F.broadcast(sizes), "cell")
    load = asked.groupBy(F.col("cell").alias("l_cell")).agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("long").alias("q_blocks"))
    asked = asked.join(load, F.col("cell") == F.col("l_cell")).join(wanted, F.col("q") == F.col("rep"))
    left = asked.select("rep", "v", "cell", F.pmod(F.xxhash64("rep"), "q_blocks").alias("qb"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("c_blocks") - 1)).alias("cb"))
    right = codes.join(F.broadcast(sizes), "cell").join(load, F.col("cell") == F.col("l_cell"))
    right = right.select("rep", "first", "v", "codes", "norm", "near_norm", "cell", F.pmod(F.xxhash64("rep", F.lit(1)), "c_blocks").alias("cb"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("q_blocks") - 1)).alias("qb"))
    keys = ("cell", "cb", "qb")
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_search(index.books, candidates, keep + SPARE), "q long, rep long, first long, near double")
    return _best(found, keep + SPARE)


def _best(found: DataFrame, n: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("near"), "first"))
    return found.withColumn("place", place).where(F.col("place") <= n).select("q", "rep")


def _rescored(found: DataFrame, wanted: DataFrame, each: DataFrame, keep: int) -> DataFrame:
    """``q, rep, score, ids``: the best ``keep`` candidates of each query by the original vectors."""
    a, b = wanted.select(F.col("rep").alias("qr"), F.col("v").alias("qv")), each.select(F.col("rep").alias("cr"), F.col("v").alias("cv"), "ids")
    pairs = found.join(b, F.col("rep") == F.col("cr")).join(a, F.col("q") == F.col("qr"))
    scored = pairs.select("q", "rep", _dot("qv", "cv").alias("score"), F.col("ids")[0].alias("first"), "ids")
    return scored.withColumn("place", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "first"))).where(F.col("place") <= keep)


def _listed(scored: DataFrame, k: int) -> DataFrame:
    """``q, score, vec_id``: the k + 1 nearest ids of each query vector, ties to the smaller."""
    listed = scored.select("q", "score", F.explode("ids").alias("vec_id"))
    return listed.withColumn("place", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))).where(F.col("place") <= k + 1)


def _exact(queries: pd.DataFrame, keep: int):
    """Brute force for a few queries: each batch's best."""
    q, v = queries["rep"].to_numpy(), np.stack(queries["v"].to_list())

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                with np.errstate(over="ignore", invalid="ignore"):
                    score = np.nan_to_num(v @ _vectors(batch).T, nan=-np.inf, posinf=np.inf, neginf=-np.inf)
                first, n = batch.column("first").to_numpy(), min(keep, batch.num_rows)
                at = np.stack([_ranked(row, first, n) for row in score])
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q, n)), batch.column("rep").take(pa.array(at.ravel())), pa.array(first[at.ravel()]), pa.array(np.take_along_axis(score, at, 1).ravel())], ["q", "rep", "first", "near"])

    return run


def search(vectors: DataFrame, k: int = 20, every: int = 20, vec_id: str = "vec_id", vector: str = "embedding", target: float = TARGET, sample: int = SAMPLE) -> DataFrame:
    """Each query's k nearest: ``query_id, rank, vec_id, score``.

    Queries are the rows whose id is divisible by ``every``; all other rows are
    candidates. Vectors that are null, zero or not finite take no part, nor do
    ids that are null or no integers; vectors of several lengths are filled up
    with zeros. Repeated rows count once; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    d = valid(vectors, vec_id, vector)
    nth = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    least = d.distinct().withColumn("nth", nth).where(F.col("nth") <= k + 1)
    same = least.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids"))  # at most k + 1 of them
    each = materialise(same.select(F.xxhash64("v").alias("rep"), "ids", "v"), "ann-distinct")
    n = each.count()
    fit_on = each.orderBy(F.xxhash64(F.col("ids")[0]), F.col("ids")[0]).limit(sample).select("v").collect()
    if not fit_on:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    bands = sorted(r.band for r in each.select("v").mapInArrow(_bands, "band long").distinct().collect())  # exponents of a double
    index = Index.fit(np.array([r.v for r in fit_on]), n, bands)
    codes = materialise(each.select("rep", F.col("ids")[0].alias("first"), "v").mapInArrow(_encode(index), "rep long, first long, v array<double>, cell long, codes binary, norm double, near_norm double"), "ann-codes")
    block = max(1, min(CODE_BLOCK, NUMBERS // len(fit_on[0].v)))
    sizes = materialise(codes.groupBy("cell").agg(F.ceil(F.count("*") / block).cast("long").alias("c_blocks")), "ann-cells")

    asked = d.where(F.col("id") % every == 0).select(F.col("id").alias("query_id"), F.xxhash64("v").alias("q")).distinct()
    wanted = materialise(each.join(asked.select("q").distinct(), F.col("rep") == F.col("q"), "left_semi").select("rep", "v"), "ann-queries")
    probes, candidates = calibrate(asked, wanted, each, codes, sizes, index, k, n, target)

    listed = _listed(_rescored(_candidates(wanted, codes, sizes, index, probes, candidates, k + 1), wanted, each, k + 1), k)
    listed = materialise(listed.groupBy("q").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))).alias("near")), "ann-near")
    out = asked.join(listed, "q").select("query_id", F.filter("near", lambda x: x["vec_id"] != F.col("query_id")).alias("near"))
    return out.select("query_id", F.posexplode(F.slice("near", 1, k)).alias("pos", "x")).select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.s")).alias("score"))


def calibrate(asked: DataFrame, wanted: DataFrame, each: DataFrame, codes: DataFrame, sizes: DataFrame, index: Index, k: int, n: int, target: float) -> tuple[int, int]:
    """(probes, candidates) with which ``TRIAL`` queries find ``target`` of their exact neighbours, by id."""
    drawn = asked.orderBy(F.xxhash64("query_id", F.lit(3)), "query_id").limit(TRIAL).groupBy("q").count().collect()
    if not drawn:
        return 1, CANDIDATES
    times = {r.q: r["count"] for r in drawn}
    some = wanted.join(F.broadcast(wanted.sparkSession.createDataFrame([(q,) for q in times], "t long")), F.col("rep") == F.col("t"), "left_semi")
    some = materialise(some, "ann-trial")
    trial, keep = some.toPandas(), min(k + 1, n)
    exact = each.select("rep", F.col("ids")[0].alias("first"), "v").mapInArrow(_exact(trial, keep + SPARE), "q long, rep long, first long, near double")
    exact = materialise(_rescored(_best(exact, keep + SPARE), some, each, keep), "ann-exact")
    near = exact.join(codes.select(F.col("rep").alias("c_rep"), "cell"), F.col("rep") == F.col("c_rep")).select("q", "cell").collect()  # keep rows a trial query
    order = index.probes(split(np.stack(trial["v"].to_list()))[1], MOST_PROBES)
    place = {(q, c): i for q, row in zip(trial["rep"], order.tolist(), strict=True) for i, c in enumerate(row)}
    needed = sorted(place.get((r.q, r.cell), index.all_cells() - 1) for r in near for _ in range(times[r.q]))
    probes = needed[min(len(needed) - 1, int((1 + target) / 2 * len(needed)))] + 1
    nearest = {(r.q, r.vec_id) for r in _listed(exact, k).select("q", "vec_id").collect()}
    candidates = max(CANDIDATES, k + 1)
    while candidates < n:
        scored = _rescored(_candidates(some, codes, sizes, index, probes, candidates, keep), some, each, keep)
        found = [times[r.q] for r in _listed(scored, k).select("q", "vec_id").collect() if (r.q, r.vec_id) in nearest]
        if sum(found) >= target * sum(times[q] for q, _ in nearest):
            break
        candidates *= 2
    return probes, candidates
