"""Vector, keyword and hybrid search; retrieval summaries and tuning rules."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestar.functions.stats import wilson
from lodestar.session import materialise


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; a zero vector is at distance 1."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, 1.0).otherwise(1 - F.try_divide(dot(a, b), norm))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))


#: Chunks and queries that one task holds at a time; distances that it holds at once.
CHUNK_BLOCK, QUERY_BLOCK, CELLS = 20_000, 2_000, 1_000_000
#: Characters of texts that a task of the keyword search holds of either side.
CHAR_BLOCK = 8_000_000


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    v = column.combine_chunks()
    return v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1).astype(float)


def _best(k: int):
    """A block of queries and one of chunks -> the k nearest of each query; slice by slice, so that memory is bounded."""

    def run(key, q: pa.Table, c: pa.Table) -> pa.Table:
        asked, found, far = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        if len(q) and len(c):
            c = c.sort_by("chunk_id")
            ids, query = c["chunk_id"].to_numpy(), q["query_id"].to_numpy()
            v, x = _matrix(c["cv"]), _matrix(q["qv"])
            norm, size, n = np.linalg.norm(v, axis=1), np.linalg.norm(x, axis=1), min(k, len(c))
            step = max(1, CELLS // len(c))
            for i in range(0, len(x), step):
                dist = x[i : i + step] @ v.T
                both = np.outer(size[i : i + step], norm)
                np.divide(dist, both, out=dist, where=both > 0)
                dist[both == 0] = 0
                np.subtract(1, dist, out=dist)
                for row, qid in zip(dist, query[i : i + step].tolist(), strict=True):
                    near = np.flatnonzero(row <= np.partition(row, n - 1)[n - 1])
                    near = near[np.argsort(row[near], kind="stable")][:n]
                    asked.append(np.full(len(near), qid))
                    found.append(ids[near])
                    far.append(row[near])
        return pa.table({"query_id": np.concatenate(asked), "chunk_id": np.concatenate(found), "distance": np.concatenate(far)})

    return run


def _met(left: DataFrame, right: DataFrame, k: int, chunk_block: int, query_block: int) -> DataFrame:
    """``query_id, chunk_id, distance``: the k nearest of each query in each block of chunks of its cell.

    ``left`` (query_id, qv, cell) and ``right`` (chunk_id, cv, cell) are counted
    by cell and dealt into blocks of a bounded size; no pair is a row.
    """
    count = lambda df, size, name: df.groupBy("cell").agg(F.ceil(F.count("*") / size).cast("long").alias(name))
    blocks = count(right, chunk_block, "parts").join(count(left, query_block, "asked"), "cell")  # a row a cell
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    deal = lambda key, n: F.pmod(F.xxhash64(key), F.col(n))
    left = left.join(F.broadcast(blocks), "cell").select("cell", "query_id", "qv", deal("query_id", "asked").alias("block"), every("parts").alias("share"))
    right = right.join(F.broadcast(blocks), "cell").select("cell", "chunk_id", "cv", deal("chunk_id", "parts").alias("share"), every("asked").alias("block"))
    keys = ("cell", "share", "block")
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_best(k), "query_id long, chunk_id long, distance double")


def search(queries: DataFrame, chunks: DataFrame, k: int, chunk_block: int = CHUNK_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """``query_id, rank, chunk_id, distance``: exact cosine top k under the order (distance, chunk_id).

    ``queries`` (query_id, qv) is a stated set, met block by block: both sides
    are counted and dealt into blocks of a bounded size, each pair of blocks
    keeps its k best of each query, and the few survivors are ranked. Nothing
    is broadcast and no pair is a row.
    """
    left = queries.select(F.col("query_id").cast("long").alias("query_id"), "qv", F.lit(0).alias("cell"))
    right = chunks.select(F.col("chunk_id").cast("long").alias("chunk_id"), "cv", F.lit(0).alias("cell"))
    w = Window.partitionBy("query_id").orderBy("distance", "chunk_id")
    near = _met(left, right, k, chunk_block, query_block)
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "chunk_id", "distance")


def approximate_search(queries: DataFrame, chunks: DataFrame, k: int, bits: int = 8, tables: int = 6, seed: int = 1, chunk_block: int = CHUNK_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """Random-hyperplane buckets first; queries whose buckets hold fewer than k chunks are searched exactly.

    A bucket's queries and chunks meet in blocks as in ``search``, which keep
    the k nearest of each: vectors are sent once a table and block, pairs never.
    """
    size = queries.select(F.size("qv")).first()
    if size is None:
        return search(queries, chunks, k)
    rng = np.random.default_rng(seed)
    planes = rng.normal(size=(tables, bits, size[0]))

    def keys(batches):
        for batch in batches:
            if batch.num_rows:
                sides = np.einsum("nd,tbd->ntb", _matrix(pa.chunked_array([batch.column(1)])), planes) > 0
                cell = (sides * (1 << np.arange(bits))).sum(2) + (np.arange(tables) << bits)
                at = pa.array(np.repeat(np.arange(batch.num_rows), tables))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(cell.ravel())], [*batch.schema.names, "cell"])

    q = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("qv").cast("array<double>").alias("qv")).mapInArrow(keys, "query_id long, qv array<double>, cell long")
    c = chunks.select(F.col("chunk_id").cast("long").alias("chunk_id"), F.col("cv").cast("array<double>").alias("cv")).mapInArrow(keys, "chunk_id long, cv array<double>, cell long")
    met = _met(q, c, k, chunk_block, query_block).groupBy("query_id", "chunk_id").agg(F.min("distance").alias("distance"))  # met in several tables
    w = Window.partitionBy("query_id")
    # a query has k chunks in all of its buckets if and only if k are left of them
    near = met.withColumn("n", F.count("*").over(w)).where(F.col("n") >= k).withColumn("rank", F.row_number().over(w.orderBy("distance", "chunk_id"))).where(F.col("rank") <= k)
    near = materialise(near.select("query_id", "rank", "chunk_id", "distance"), "near-buckets")
    left = queries.join(near.select("query_id").distinct(), "query_id", "left_anti")
    return near.unionByName(search(left, chunks, k, chunk_block, query_block))


def _most_words(k: int):
    """A block of queries and one of chunks -> the k chunks of most words in common with each query; slice by slice, so that memory is bounded."""

    def read(t: pa.Table, name: str):
        """The distinct ids, nulls last, and the owner and value of each word, in order of owners."""
        t = t.sort_by(name).combine_chunks()
        ids = t[name].combine_chunks().dictionary_encode(null_encoding="encode")
        words = pc.split_pattern(t["words"].combine_chunks(), " ")
        return ids.dictionary, np.repeat(ids.indices.to_numpy().astype(np.int64), pc.list_value_length(words).to_numpy()), words.flatten()

    def run(key, q: pa.Table, c: pa.Table) -> pa.Table:
        rows = []
        if len(q) and len(c):
            (asked, holder, own), (chunks, of, words) = read(q, "query_id"), read(c, "chunk_id")
            known = pc.unique(own)
            number = pc.index_in(own, value_set=known).to_numpy()
            order = np.argsort(number, kind="stable")
            holder, first = holder[order], np.searchsorted(number[order], np.arange(len(known) + 1))  # the queries of each word
            word = pc.index_in(words, value_set=known).fill_null(-1).to_numpy()
            word, of = word[word >= 0], of[word >= 0]
            times = np.diff(first)[word]
            start = np.searchsorted(of, np.arange(len(chunks) + 1))
            met = np.append(0, np.cumsum(times))[start]
            i = 0
            while i < len(chunks):
                j = min(i + max(1, CELLS // len(asked)), int(np.searchsorted(met, met[i] + CELLS, "right")) - 1, len(chunks))
                j = max(i + 1, j)
                at, t = word[start[i] : start[j]], times[start[i] : start[j]]
                who = holder[np.repeat(first[at] - np.cumsum(t) + t, t) + np.arange(t.sum())]
                score = np.bincount(who * (j - i) + np.repeat(of[start[i] : start[j]] - i, t), minlength=len(asked) * (j - i)).reshape(-1, j - i)
                best = np.argsort(-score, 1, kind="stable")[:, :k]
                value = np.take_along_axis(score, best, 1)
                row, nth = np.nonzero(value)
                rows.append((row, i + best[row, nth], value[row, nth]))
                i = j
        if not rows:
            return pa.table({"query_id": q["query_id"][:0], "chunk_id": c["chunk_id"][:0], "score": pa.array([], pa.int64())})
        row, col, value = (pa.array(np.concatenate(x)) for x in zip(*rows, strict=True))
        return pa.table({"query_id": asked.take(row), "chunk_id": chunks.take(col), "score": value})

    return run


def keyword_search(queries: DataFrame, chunks: DataFrame, k: int, chars: int = CHAR_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """``query_id, text`` against ``chunk_id, text``: number of distinct query words a chunk has.

    Both sides are dealt into blocks of counted size, each pair of blocks keeps
    its k best of each query, and the few survivors are ranked: a common word
    makes no row for each chunk and query. Rows of one id add up.
    """
    # no word has a space; joined by it they travel in fewer bytes than as an array
    own = lambda c: F.array_join(F.array_distinct(F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}-]+"), lambda w: w != "")), " ")
    q = queries.select("query_id", own(F.col("text")).alias("words")).where("words <> ''")
    c = chunks.select("chunk_id", own(F.col("text")).alias("words")).where("words <> ''")
    size = lambda df, rows, name: df.agg(F.ceil(F.greatest(F.coalesce(F.sum(F.length("text").cast("long")), F.lit(0)) / chars, F.count("*") / rows, F.lit(1))).cast("long").alias(name))
    blocks = F.broadcast(size(chunks, chars, "parts").crossJoin(size(queries, query_block, "asked")))  # one row
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    deal = lambda key, n: F.pmod(F.xxhash64(key), F.col(n))
    left = q.crossJoin(blocks).select("query_id", "words", deal("query_id", "asked").alias("block"), every("parts").alias("share"))
    right = c.crossJoin(blocks).select("chunk_id", "words", deal("chunk_id", "parts").alias("share"), every("asked").alias("block"))
    keys, kind = ("share", "block"), {x: df.schema[x].dataType.simpleString() for df, x in ((queries, "query_id"), (chunks, "chunk_id"))}
    score = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_most_words(k), f"query_id {kind['query_id']}, chunk_id {kind['chunk_id']}, score long")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc_nulls_last("chunk_id"))
    return score.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "chunk_id", "score")


def fuse(first: DataFrame, second: DataFrame, k: int, constant: int = 60) -> DataFrame:
    """Hybrid ranking: reciprocal ranks of two result lists, summed."""
    both = first.select("query_id", "chunk_id", "rank").unionByName(second.select("query_id", "chunk_id", "rank"))
    s = both.groupBy("query_id", "chunk_id").agg(F.sum(1 / (F.col("rank") + constant)).alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return s.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "chunk_id", "score")


def summary(first: DataFrame, groups: list[str], k: int) -> DataFrame:
    """``groups, first`` (rank of the first relevant hit or null) by group and over all: n, hits, rate, Wilson bounds."""
    hit = F.count_if(F.col("first") <= k)
    by = first.groupBy(*groups).agg(F.count("*").alias("n"), hit.alias("hits"))
    every = first.agg(F.count("*").alias("n"), hit.alias("hits")).select(*[F.lit("ALL").alias(g) for g in groups], "n", "hits")
    low, high = wilson(F.col("hits"), F.col("n"))
    both = by.select(*[F.col(g).cast("string").alias(g) for g in groups], "n", "hits").unionByName(every)
    return both.withColumn("rate", F.try_divide("hits", "n")).withColumn("low", low).withColumn("high", high)


def calibrate(scored: DataFrame) -> DataFrame:
    """``score, relevant`` -> the threshold (score >= it) of best balanced accuracy, ties to the lower.

    Counts by distinct score and running sums; no pair of score and candidate.
    """
    by = scored.groupBy("score").agg(F.count_if(F.col("relevant")).alias("p"), F.count_if(~F.col("relevant")).alias("n"))
    down = Window.orderBy(F.desc("score"))  # distinct scores of a labelled set
    every = Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    r = by.select("score", F.sum("p").over(down).alias("tp"), F.sum("n").over(down).alias("fp"), F.sum("p").over(every).alias("P"), F.sum("n").over(every).alias("N"))
    r = r.withColumn("accuracy", (F.try_divide("tp", "P") + F.try_divide(F.col("N") - F.col("fp"), "N")) / 2)
    return r.orderBy(F.desc("accuracy"), "score").limit(1).select(F.col("score").alias("threshold"), F.col("accuracy").alias("balanced_accuracy"))


def smallest_k(rates: DataFrame, margin: float = 0.02) -> DataFrame:
    """``k, rate`` -> the least k whose rate is within ``margin`` of the largest k's."""
    top = rates.agg(F.max_by("rate", "k").alias("top"))
    return rates.crossJoin(F.broadcast(top)).where(F.col("rate") >= F.col("top") - margin).agg(F.min("k").alias("k"))


def keep_default_or_best(cells: list[tuple[str, int, int]], default: str, margin_pp: int = 3) -> str:
    """The best rate's name if it beats the default's by ``margin_pp`` points, compared in integers; ties keep the earlier."""
    base = next(c for c in cells if c[0] == default)
    best = base
    for c in cells:
        if c[1] * best[2] > best[1] * c[2]:
            best = c
    gain = best[1] * base[2] - base[1] * best[2]
    return best[0] if 100 * gain >= margin_pp * best[2] * base[2] else default


def kept_or_best(cells: DataFrame, family: str, name: str, default, margin_pp: int = 3) -> DataFrame:
    """``family, name, hits, n`` -> per family ``family, kept``: its best name if that beats ``default`` by ``margin_pp`` points, else the default.

    Rates are compared as exact fractions; of equal ones the name nearest to the
    default is best, then the lesser. Names are whole numbers; a family without
    the default has none kept.
    """
    rate, off = F.col("hits").cast("double") / F.col("n"), F.abs(F.col(name) - default)
    cell = F.struct(F.col("hits").cast("decimal(19,0)").alias("h"), F.col("n").cast("decimal(19,0)").alias("n"), F.col(name).alias("name"))
    g = cells.where("n > 0").groupBy(family).agg(F.max_by(cell, F.struct(rate, -off, -F.col(name))).alias("b"), F.max(F.when(F.col(name) == default, cell)).alias("d"))
    gain = 100 * (F.col("b.h") * F.col("d.n") - F.col("d.h") * F.col("b.n")) >= margin_pp * F.col("b.n") * F.col("d.n")
    return g.select(family, F.when(gain, F.col("b.name")).otherwise(F.col("d.name")).alias("kept"))


def of_files(chunks: DataFrame, name: str, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """Chunks whose file, the part of ``name`` before the first slash, is included (all are if none are named) and not excluded."""
    file = F.substring_index(F.col(name), "/", 1)
    kept = chunks if not include else chunks.where(file.isin(include))
    return kept if not exclude else kept.where(~F.coalesce(file.isin(exclude), F.lit(False)))


def budgeted_k(budget: int, size: int) -> int:
    return int(budget / size + 0.5)


def ranking_equal(a: list[tuple], b: list[tuple], digits: int = 6) -> bool:
    """Whether two rankings of (id, score) agree up to the order within equal scores."""

    def groups(r):
        out: list[tuple[float, set]] = []
        for i, s in r:
            s = round(s, digits)
            if out and out[-1][0] == s:
                out[-1][1].add(i)
            else:
                out.append((s, {i}))
        return out

    return groups(a) == groups(b)


def overlap_at(a: Column, b: Column, k: int) -> Column:
    """Size of the common part of two arrays' first k."""
    return F.size(F.array_intersect(F.slice(a, 1, k), F.slice(b, 1, k)))


def canonical(hits: DataFrame, tie: float = 1e-6) -> DataFrame:
    """``run, query, rank, id, score`` -> per run and query ``hits, ids, scores, groups``: its ranking up to the order within ties.

    ``groups`` lists, for each run of scores that differ by no more than ``tie``
    from the one before, its first place and a hash of its sorted ids. A ranking
    is as long as its top-k; the groups of two of any number of queries compare
    by one join.
    """
    w = Window.partitionBy("run", "query").orderBy("rank", "id")
    new = F.coalesce((F.abs(F.col("score") - F.lag("score").over(w)) > tie).cast("int"), F.lit(1))
    placed = hits.select("run", "query", "rank", "id", F.col("score").cast("double").alias("score"), new.alias("new"), F.row_number().over(w).alias("at"))
    placed = placed.withColumn("g", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    groups = placed.groupBy("run", "query", "g").agg(F.min("at").alias("at"), F.array_sort(F.collect_list(F.struct("at", "id", "score"))).alias("h"))
    groups = groups.withColumn("group", F.struct("at", F.xxhash64(F.array_sort(F.col("h.id"))).alias("ids")))
    out = groups.groupBy("run", "query").agg(F.array_sort(F.collect_list("group")).alias("groups"), F.array_sort(F.flatten(F.collect_list("h"))).alias("h"))
    return out.select("run", "query", F.size("h").alias("hits"), F.col("h.id").alias("ids"), F.col("h.score").alias("scores"), "groups")


def compared(hits: DataFrame, one: str, other: str, k: int = 10, tie: float = 1e-6, truncated: bool = True) -> DataFrame:
    """Per query of either run ``query, identical, equivalent, overlap, drift``.

    ``identical``: the same ids in the same first ``k`` places. ``equivalent``:
    all hits agree up to the order within ties; with ``truncated`` the last tie
    may hold other ids on both sides, as the limit cut it. ``overlap``: common
    ids in the first k. ``drift``: the largest difference of scores at one place
    of the first k. A query that one run lacks is neither, with overlap 0.
    """
    c = canonical(hits.where(F.col("run").isin(one, other)), tie)
    a, b = (c.where(F.col("run") == r).select(F.col("query").alias(f"q_{s}"), *[F.col(x).alias(f"{x}_{s}") for x in ("hits", "ids", "scores", "groups")]) for r, s in ((one, "a"), (other, "b")))
    j = a.join(b, F.col("q_a") == F.col("q_b"), "full")
    first = lambda x: F.slice(x, 1, k)
    head = lambda x: F.slice(x, 1, F.greatest(F.size(x) - 1, F.lit(0)))
    same = F.col("groups_a") == F.col("groups_b")
    cut = (F.col("hits_a") == F.col("hits_b")) & (head("groups_a") == head("groups_b")) & (F.element_at("groups_a", -1)["at"] == F.element_at("groups_b", -1)["at"])
    drift = F.array_max(F.zip_with(first("scores_a"), first("scores_b"), lambda x, y: F.abs(x - y)))
    no = F.lit(False)
    return j.select(
        F.coalesce("q_a", "q_b").alias("query"), F.coalesce(first("ids_a") == first("ids_b"), no).alias("identical"),
        F.coalesce(same | cut if truncated else same, no).alias("equivalent"), F.coalesce(F.size(F.array_intersect(first("ids_a"), first("ids_b"))), F.lit(0)).alias("overlap"), drift.alias("drift"),
    )


def passes(hits: DataFrame, one: str, other: str, k: int = 10, tie: float = 1e-6) -> DataFrame:
    """One row ``compared, different, not_equivalent, max_drift`` of two passes or of an index and its rebuild."""
    c = compared(hits, one, other, k, tie)
    return c.agg(F.count("*").alias("compared"), F.count_if(~F.col("identical")).alias("different"), F.count_if(~F.col("equivalent")).alias("not_equivalent"), F.max("drift").alias("max_drift"))
