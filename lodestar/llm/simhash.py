"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints are 64 majority bits over the XXH64 hashes of word shingles.
Equal fingerprints are one class, so only distinct ones are compared. Their
bit correlations, counted over all of them, group correlated bits into m
partitions; thresholds t_i >= -1 with sum t_i = tau - m + 1 guarantee that two
fingerprints within tau bits agree within t_i in some partition. A dynamic
programme allots the t_i (and m) by the estimated number of candidates, and
each fingerprint is filed under its partition values (t = 0) or its values with
one bit masked (t = 1).

Candidates of a key are verified pair by pair up to ``PAIRS`` fingerprints. A
larger key goes another, exact way: fingerprints within two bits of each other
both lie within one bit of a common value, so each is filed under the 65 values
within one bit of it and linked to the least fingerprint filed there. Such a
group has 65 members at most and its links are all true ones. Links between
fingerprints never leave the cluster; components are found by star steps.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.components import components
from lodestar.llm.decontamination import row_key
from lodestar.llm.rows import packed, unpacked
from lodestar.llm.tokens import pieces, utf8
from lodestar.session import materialise, small_batches

SHINGLE, DISTANCE, SEED, BITS = 3, 2, 42, 64
#: Fingerprints of one key that are compared pair by pair.
PAIRS = 24
CHUNK = 4 << 20
BROADCAST_KEYS = 500_000


def fingerprint_bits(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Majority bits of ``hashes[first[i]:first[i+1]]`` for each i; zero where there are none."""
    out = np.zeros(len(first) - 1, np.uint64)
    count = np.diff(first)
    some = np.flatnonzero(count)
    if len(some):
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        sums = np.add.reduceat(bits, first[:-1][some], axis=0, dtype=np.int64)
        over = (2 * sums > count[some, None]).astype(np.uint8)
        out[some] = np.packbits(over, axis=1, bitorder="little").view("<u8").ravel()
    return out


def _fingerprints(shingle: int):
    h = xxhash.xxh64_intdigest

    def run(batches):
        for batch in pieces(batches, "text", CHUNK):
            data, offsets = utf8(batch.column("text"))
            hashes, first = [], [0]
            for i in range(batch.num_rows):
                words = data[offsets[i] : offsets[i + 1]].tobytes().lower().split()
                if 0 < len(words) <= shingle:
                    hashes.append(h(b" ".join(words), SEED))
                elif words:
                    line = b" ".join(words)
                    ends = np.fromiter(map(len, words), np.int64, len(words))
                    ends = np.cumsum(ends + 1) - 1
                    starts = [0, *(ends[:-shingle] + 1).tolist()]
                    hashes += [h(line[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)]
                first.append(len(hashes))
            fp = fingerprint_bits(np.array(hashes, np.uint64), np.array(first, np.int64)).view(np.int64)
            cols = [batch.column(k) for k in range(batch.num_columns) if batch.schema.names[k] != "text"]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(fp)], [*(c for c in batch.schema.names if c != "text"), "fp"])

    return run


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, row_key, fp`` for each row; fp is the fingerprint as a signed long."""
    small_batches(docs.sparkSession)
    d = docs.select(F.col(doc_id).try_cast("long").alias("doc_id"), row_key(F.col(doc_id), F.col(text)).alias("row_key"), F.col(text).alias("text"))
    return d.mapInArrow(_fingerprints(shingle), "doc_id long, row_key string, fp long")


def _pair_counts(batches):
    total = np.zeros((BITS + 1, BITS), np.int64)
    for batch in batches:
        x = batch.column(0).to_numpy().view(np.uint64)
        bits = ((x[:, None] >> np.arange(BITS, dtype=np.uint64)) & np.uint64(1)).astype(np.float64)
        total[:BITS] += np.rint(bits.T @ bits).astype(np.int64)
        total[BITS] += len(x)
    i, j = np.indices(total.shape)
    yield pa.RecordBatch.from_arrays([pa.array(i.ravel().astype(np.int32)), pa.array(j.ravel().astype(np.int32)), pa.array(total.ravel())], ["i", "j", "n"])


def bit_statistics(fps: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """(fingerprints, share of ones of each bit, correlations) over all fingerprints."""
    rows = fps.select("fp").mapInArrow(_pair_counts, "i int, j int, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect()  # 65 * 64 rows
    both = np.zeros((BITS + 1, BITS))
    for r in rows:
        both[r.i, r.j] = r.n
    n = max(both[BITS, 0], 1)
    p = np.diag(both[:BITS]) / n
    cov = both[:BITS] / n - np.outer(p, p)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    return int(n), p, cov / np.outer(sd, sd)


def group_bits(corr: np.ndarray, m: int) -> list[list[int]]:
    """m partitions of nearly equal size; each takes the bits most correlated with it."""
    left, out = set(range(len(corr))), []
    strength = np.abs(corr) - np.eye(len(corr))
    for g in range(m):
        size = math.ceil(len(left) / (m - g))
        free = sorted(left)
        group = [max(free, key=lambda b: strength[b, free].sum())]
        left.discard(group[0])
        while len(group) < size:
            b = max(sorted(left), key=lambda b: strength[b, group].sum())
            group.append(b)
            left.discard(b)
        out.append(sorted(group))
    return out


def estimate(n: int, p: np.ndarray, corr: np.ndarray, group: list[int], t: int) -> float:
    """Expected partners of a fingerprint within t bits in a partition, plus its keys."""
    if t < 0:
        return 0.0
    agree = p[group] ** 2 + (1 - p[group]) ** 2
    rho = float((corr[np.ix_(group, group)] ** 2).sum()) / len(group)  # 1 if independent
    k = len(group) / max(rho, 1.0)
    q = 1 - float(np.exp(np.log(agree).mean()))
    near = sum(math.exp(math.lgamma(k + 1) - math.lgamma(d + 1) - math.lgamma(max(k - d, 0) + 1)) * q**d * (1 - q) ** max(k - d, 0) for d in range(t + 1) if d <= k)
    return n * near + (1 if t == 0 else len(group) if t == 1 else math.inf)


def allot(costs: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Thresholds (-1, 0, ...: position - 1 in each row of costs) of sum ``total`` and least cost."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for (s, (c, ts)), (t, cost) in itertools.product(best.items(), enumerate(row, -1)):
            if s + t not in step or c + cost < step[s + t][0]:
                step[s + t] = (c + cost, [*ts, t])
        best = step
    return best[total]


def plan(n: int, p: np.ndarray, corr: np.ndarray, distance: int = DISTANCE) -> list[tuple[list[int], int]]:
    """(bits, threshold) of the partitions that are probed."""
    options = []
    for m in range(2, distance + 3):
        groups = group_bits(corr, m)
        cost, ts = allot([[estimate(n, p, corr, g, t) for t in range(-1, 2)] for g in groups], distance - m + 1)
        options.append((cost, m, [(g, t) for g, t in zip(groups, ts, strict=True) if t >= 0]))
    return min(options)[2]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def links(fps: DataFrame, partitions: list[tuple[list[int], int]], distance: int = DISTANCE, pairs: int = PAIRS) -> DataFrame:
    """``u, v``: links that connect whatever is within ``distance`` bits, all of them true."""
    if distance != 2:
        raise ValueError("the exact way for large keys holds for two bits")
    slots = []
    for bits, t in partitions:
        mask = sum(1 << b for b in bits)
        slots += [mask] if t == 0 else [mask & ~(1 << b) for b in bits]
    keyed = fps.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("slot"), F.col("fp").bitwiseAND(F.lit(_signed(s))).alias("key")) for i, s in enumerate(slots)])).alias("k")).select("fp", "k.slot", "k.key")
    counts = materialise(keyed.groupBy("slot", "key").agg(F.count("*").alias("n")).where("n > 1"), "simhash-keys")
    # a key's fingerprints meet only where there are few of them
    few = counts.where(F.col("n") <= pairs).select("slot", "key")
    few = F.broadcast(few) if few.count() <= BROADCAST_KEYS else few
    groups = keyed.join(few, ["slot", "key"], "left_semi").groupBy("slot", "key").agg(F.array_sort(F.collect_list("fp")).alias("f"))
    a = groups.select("f", F.posexplode("f").alias("i", "u")).select("u", F.explode(F.slice("f", F.col("i") + 2, F.size("f"))).alias("v"))
    near = a.where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= distance).select("u", "v")

    many = counts.where(F.col("n") > pairs).select("slot", "key")
    many = F.broadcast(many) if many.count() <= BROADCAST_KEYS else many
    crowd = keyed.join(many, ["slot", "key"], "left_semi").select("fp").distinct()
    ball = crowd.select("fp", F.explode(F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(_signed(1 << b))) for b in range(BITS)])).alias("c"))
    star = ball.groupBy("c").agg(F.collect_list("fp").alias("f")).where(F.size("f") > 1)
    star = star.select(F.array_min("f").alias("u"), F.explode("f").alias("v")).where("u <> v")
    return near.unionByName(star)


def grouped(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, distance: int = DISTANCE) -> tuple[DataFrame, DataFrame]:
    """(``doc_id, row_key, fp`` of each row, ``f, root, component_id`` of each fingerprint)."""
    fp = materialise(fingerprints(docs, doc_id, text, shingle), "simhash-fp")
    each = materialise(fp.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    n, p, corr = bit_statistics(each)
    found = components(links(each, plan(n, p, corr, distance), distance))
    rooted = each.join(found, each["fp"] == found["u"], "left").select("fp", "least", F.coalesce("v", "fp").alias("root"))
    least = rooted.groupBy(F.col("root").alias("r")).agg(F.min("least").alias("component_id"))
    return fp, materialise(rooted.join(least, F.col("root") == F.col("r")).select(F.col("fp").alias("f"), "root", "component_id"), "simhash-groups")


def report(docs: DataFrame, **params) -> DataFrame:
    """Per row ``doc_id, fingerprint, component_id``.

    Texts without words, null included, have fingerprint zero and are linked
    like any other; null ids never name a component (null if all are null);
    repeated rows each get their row; an empty table gives no rows.
    """
    fp, groups = grouped(docs, **params)
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return fp.join(groups, F.col("fp") == F.col("f")).select("doc_id", hexed.alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **params) -> DataFrame:
    """One document of each group of ``report``, unchanged, with all its columns: the one of least id (nulls last).

    Texts without words, null included, are one group; an empty table stays empty.
    """
    fp, groups = grouped(docs, doc_id, text, **params)
    rows = fp.join(groups, F.col("fp") == F.col("f")).groupBy("root", "row_key").agg(F.first("doc_id").alias("doc_id"), F.count("*").alias("n"))
    keep = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("row_key"), F.col("n"))).alias("k"))
    keep = materialise(keep.select(F.col("k.row_key").alias("k_key"), F.col("k.n").alias("n")), "simhash-keep")
    row = packed(docs, key=row_key(F.col(doc_id), F.col(text)))
    once = row.join(keep.where("n = 1"), F.col("key") == F.col("k_key"), "left_semi")
    again = row.join(keep.where("n > 1"), F.col("key") == F.col("k_key"), "left_semi").dropDuplicates(["key"])
    return unpacked(once.unionByName(again), docs.columns)
