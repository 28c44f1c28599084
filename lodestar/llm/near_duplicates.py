"""Near duplicates by shingle similarity: SimHash probes wide enough for 0.8, then an exact check.

Two texts are near duplicates if the sets of their five-word shingles have a
Jaccard similarity of 0.8 or more. Such texts differ in a few words, so they are
sought by a long SimHash fingerprint, the majority bits of the hashes of their
distinct words: 512 bits of which near copies differ in about a tenth at most,
and unrelated texts in a half.

The generalised pigeonhole of ``simhash`` deals the bits, correlated ones
together, into m partitions that are a little longer than the number of
fingerprints needs; a dynamic programme allots thresholds t_i of sum 0, which
guarantees every pair within m - 1 bits and finds most of the wider ones, as
each partition is another try. Texts of equal words are one class before
anything is compared, and every candidate is verified on its whole shingle sets.

A key of up to ``PAIRS`` fingerprints is compared pair by pair. In a larger one,
a crowd of near copies, each text first meets one leader of its crowds; what is
then still apart meets the leader and a neighbour in every one of its keys (each
key has its own order, in blocks of ``BLOCK``). A crowd that is one group by then
is done. The texts of all others meet, across groups, wherever they share one of the
rarest shingles of either set, as every pair of that similarity does (prefix
filtering): no link is lost, and texts of a crowd that have little in common but
its key never meet.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestar.llm.components import components
from lodestar.llm.decontamination import row_key
from lodestar.llm.rows import packed, unpacked
from lodestar.llm.simhash import allot, estimate, group_bits
from lodestar.llm.tokens import Words, mix64, pieces, windows
from lodestar.session import materialise, measured, small_batches

SHINGLE, SIMILARITY = 5, 0.8
LONGS = 8
BITS = 64 * LONGS
#: Bits of the first 64 in which candidates may differ: 0.8 lies near 7, chance near 32.
FAR = 20
#: Partitions at most, and how many bits more than log2 of the fingerprints each should have.
PARTS, SPARE = 32, 3
PAIRS, BLOCK = 24, 1000
#: What a key costs, in candidates.
KEY_COST = 50
CHUNK = 1 << 19
BROADCAST_ROWS = 500_000
#: Candidates that are verified in one go, without asking first which of them still join two groups.
AT_ONCE = 50_000


def _majority(w: Words, codes: np.ndarray, name: np.ndarray, n: int) -> np.ndarray:
    """Fingerprints as (n, BITS / 8) bytes: bits set in over half of a text's distinct words."""
    doc = np.repeat(np.arange(n), np.diff(w.first))
    wide = max(len(name), 1)
    pair = np.unique(doc * wide + codes)
    doc, code = pair // wide, pair % wide
    hashes = np.stack([mix64(name, k + 1) for k in range(LONGS)], 1).astype("<u8").view(np.uint8)
    sums = np.zeros((n, BITS), np.int32)
    for i in range(0, len(pair), 1 << 14):
        d = doc[i : i + (1 << 14)]
        bits = np.unpackbits(hashes[code[i : i + (1 << 14)]], axis=1, bitorder="little")
        head = np.flatnonzero(np.append(True, np.diff(d) > 0))
        sums[d[head]] += np.add.reduceat(bits, head, axis=0, dtype=np.int32)
    return np.packbits(2 * sums > np.bincount(doc, minlength=n)[:, None], axis=1, bitorder="little")


def _features(shingle: int):
    def run(batches):
        for batch in pieces(batches, "text", CHUNK):
            n = batch.num_rows
            w = Words(batch.column("text"), lower=True)
            codes, words = w.distinct()
            name = np.array([xxhash.xxh64_intdigest(x, 42) for x in words], np.uint64)
            fp = _majority(w, codes, name, n)
            size = np.diff(w.first)
            of = np.repeat(np.arange(n), size)
            hashed = windows(name[codes], shingle)
            start = np.flatnonzero(of[: len(hashed)] == of[shingle - 1 :][: len(hashed)]) if len(hashed) else np.zeros(0, np.int64)
            own, value = of[start], hashed[start]
            short = np.flatnonzero((size > 0) & (size < shingle))  # the whole sequence is the one shingle
            own = np.append(own, short)
            whole = [xxhash.xxh64_intdigest(b" ".join(words[c] for c in codes[w.first[i] : w.first[i + 1]]), 7) for i in short.tolist()]
            value = np.append(value, np.array(whole, np.uint64))
            order = np.lexsort((value, own))
            own, value = own[order], value[order]
            new = np.append(True, (own[1:] != own[:-1]) | (value[1:] != value[:-1]))[: len(own)]
            own, value = own[new], value[new]
            offsets = np.searchsorted(own, np.arange(n + 1)).astype(np.int32)
            sets = pa.ListArray.from_arrays(pa.array(offsets), pa.array(value.view(np.int64)))
            seq = [xxhash.xxh3_128_digest(b" ".join(w.text(i).split())) for i in range(n)]
            cols = [*batch.columns[:2], pa.array(seq, pa.binary()), pa.array([r.tobytes() for r in fp], pa.binary()), sets]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "row_key", "seq", "fp", "shingles"])

    return run


def _bits(column: pa.Array) -> np.ndarray:
    flat = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)
    return np.unpackbits(flat, axis=1, bitorder="little")


def _pair_counts(batches):
    total = np.zeros((BITS, BITS))
    n = 0
    for batch in batches:
        b = _bits(batch.column(0)).astype(np.float32)
        total += b.T @ b
        n += len(b)
    i, j = np.triu_indices(BITS)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(i, BITS).astype(np.int32)), pa.array(np.append(j, BITS).astype(np.int32)), pa.array(np.append(np.rint(total[i, j]), n).astype(np.int64))], ["i", "j", "n"])


def statistics(fps: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(share of ones of each bit, correlations) over all ``n`` fingerprints."""
    few = fps.select("fp").coalesce(n // 100_000 + 1)  # fingerprints are narrow; each task gives BITS^2 / 2 counts
    rows = few.mapInArrow(_pair_counts, "i int, j int, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).toArrow()
    both = np.zeros((BITS + 1, BITS + 1))
    both[rows["i"].to_numpy(), rows["j"].to_numpy()] = rows["n"].to_numpy()
    both = np.maximum(both, both.T)[:BITS, :BITS] / max(n, 1)
    p = np.diag(both)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    return p, (both - np.outer(p, p)) / np.outer(sd, sd)


def plan(n: int, p: np.ndarray, corr: np.ndarray) -> list[tuple[list[int], int]]:
    """(bits, threshold) of the partitions that are probed."""
    m = min(PARTS, BITS // min(60, max(12, math.ceil(math.log2(max(n, 2))) + SPARE)))
    groups = group_bits(corr, m)
    # a key is written and shuffled, a candidate only compared
    cost = lambda g, t: estimate(n, p, corr, g, t) + KEY_COST * (0, 1, len(g))[t + 1]
    _, ts = allot([[cost(g, t) for t in range(-1, 2)] for g in groups], 0)
    return [(g, t) for g, t in zip(groups, ts, strict=True) if t >= 0]


def _keys(partitions: list[tuple[list[int], int]]):
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            bits, uid = _bits(batch.column("fp")), batch.column("uid")
            first = pa.array(np.packbits(bits[:, :64], axis=1, bitorder="little").view("<i8").ravel())
            for g, (own, t) in enumerate(partitions):
                value = bits[:, own].astype(np.int64) @ (1 << np.arange(len(own), dtype=np.int64))
                for slot in range(1 if t == 0 else len(own)):
                    key = value if t == 0 else value & ~(1 << slot)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), g * 64 + slot, np.int32)), pa.array(key), uid, first], ["slot", "key", "uid", "f"])

    return run


def _few(df: DataFrame, most: int) -> DataFrame:
    """``df``, broadcast if it is small; ``most``: of how many rows it is known not to have more."""
    return F.broadcast(df) if most <= BROADCAST_ROWS or df.count() <= BROADCAST_ROWS else df


def _near(a, b):
    return F.bit_count(a.bitwiseXOR(b)) <= FAR


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float, most: int | None = None) -> DataFrame:
    """The pairs ``u, v`` whose shingle sets are similar; only the sets of texts in pairs travel. ``most``: the pairs are written already and not more than so many."""
    if most is None:
        pairs, seen = measured(pairs, "near-pairs", n=F.count("*"))
        most = seen["n"]
    if not most:
        return pairs.select("u", "v")
    ids = pairs.select(F.col("u").alias("i")).union(pairs.select("v")).distinct()
    sets = sets.join(_few(ids, 2 * most), F.col("uid") == F.col("i"), "left_semi")
    one = sets.select(F.col("uid").alias("u1"), F.col("shingles").alias("s1"))
    two = sets.select(F.col("uid").alias("u2"), F.col("shingles").alias("s2"))
    both = pairs.join(one, F.col("u") == F.col("u1")).join(two, F.col("v") == F.col("u2"))
    common = F.size(F.array_intersect("s1", "s2"))
    return both.where(common >= similarity * (F.size("s1") + F.size("s2") - common)).select("u", "v")


def _pair(a, b):
    return [F.least(a, b).alias("u"), F.greatest(a, b).alias("v")]


def links(reps: DataFrame, sets: DataFrame, partitions: list[tuple[list[int], int]], similarity: float, pairs: int = PAIRS) -> DataFrame:
    """``u, v``: the least text v that each other text u is linked to by verified links between texts ``uid, fp``; see the module for crowds."""
    keyed = reps.select("uid", "fp").mapInArrow(_keys(partitions), "slot int, key long, uid long, f long")
    place = F.struct(F.xxhash64("uid", "slot").alias("h"), F.col("uid").alias("uid"), F.col("f").alias("f"))
    counts = keyed.groupBy(F.col("slot").alias("k_slot"), F.col("key").alias("k_key")).agg(F.count("*").alias("n"), F.min(place).alias("leader"))
    counts, seen = measured(counts.where("n > 1"), "near-keys", few=F.count_if(F.col("n") <= pairs), many=F.count_if(F.col("n") > pairs))
    on = (F.col("slot") == F.col("k_slot")) & (F.col("key") == F.col("k_key"))
    few = counts.where(F.col("n") <= pairs).select("k_slot", "k_key")
    groups = keyed.join(_few(few, seen["few"]), on, "left_semi").groupBy("slot", "key").agg(F.array_sort(F.collect_list(F.struct("uid", "f"))).alias("m"))
    each = groups.select("m", F.posexplode("m").alias("i", "a")).select("a", F.explode(F.slice("m", F.col("i") + 2, F.size("m"))).alias("b"))
    found = each.where(_near(F.col("a.f"), F.col("b.f"))).select(*_pair(F.col("a.uid"), F.col("b.uid"))).distinct()
    edges = materialise(_verified(found, sets, similarity), "near-links")

    if not seen["many"]:
        return components(edges)
    crowd = materialise(keyed.join(_few(counts.where(F.col("n") > pairs), seen["many"]), on).select("uid", "f", "slot", "key", "n", "leader"), "near-crowds")
    led = crowd.where((F.col("leader.uid") != F.col("uid")) & _near(F.col("f"), F.col("leader.f")))
    first = led.groupBy("uid").agg(F.min("leader").alias("l")).select(*_pair(F.col("uid"), F.col("l.uid"))).distinct()
    edges = edges.unionByName(materialise(_verified(first, sets, similarity), "near-links"))
    block = F.pmod(F.xxhash64("uid", F.lit(5)), F.ceil(F.col("n") / BLOCK).cast("long"))
    order = Window.partitionBy("slot", "key", "block").orderBy(F.xxhash64("uid", "slot"), "uid")
    beside = crowd.withColumn("block", block).withColumn("b", F.lag(F.struct("uid", "f")).over(order))
    rest = beside.select("uid", "f", F.explode(F.array("b", F.struct(F.col("leader.uid").alias("uid"), F.col("leader.f").alias("f")))).alias("o"))
    rest = rest.where(F.col("o").isNotNull() & (F.col("o.uid") != F.col("uid")) & _near(F.col("f"), F.col("o.f")))
    rest = materialise(rest.select(*_pair(F.col("uid"), F.col("o.uid"))).distinct(), "near-candidates")
    root = _joined(components(edges), rest, sets, similarity)
    mixed, texts = _mixed(crowd, root)
    return _joined(root, _apart(mixed, sets, similarity), sets, similarity) if texts else root


def _mixed(crowd: DataFrame, root: DataFrame) -> tuple[DataFrame, int]:
    """``uid, r``: the texts of crowds that are not all of one group r; and how many."""
    rooted = crowd.join(root.select(F.col("u").alias("m"), F.col("v").alias("r")), F.col("uid") == F.col("m"), "left").select("uid", F.coalesce("r", "uid").alias("r"), "slot", "key")
    rooted = materialise(rooted, "near-rooted")
    split = rooted.groupBy(F.col("slot").alias("k_slot"), F.col("key").alias("k_key")).agg(F.min("r").alias("a"), F.max("r").alias("b")).where("a <> b")
    mixed = rooted.join(split.select("k_slot", "k_key"), (F.col("slot") == F.col("k_slot")) & (F.col("key") == F.col("k_key")), "left_semi")
    mixed, seen = measured(mixed.select("uid", "r").distinct(), "near-mixed", n=F.count("*"))
    return mixed, seen["n"]


def _apart(mixed: DataFrame, sets: DataFrame, similarity: float, size: int = BLOCK) -> DataFrame:
    """``u, v``: pairs of texts ``uid, r`` of different groups r, among them all whose shingle sets are similar.

    Shingles stand in one order: those of a single group, which no such pair has
    in common, then the others, rare ones first. From the first shingle that two
    sets have in common on, each must hold as many as they need in common. So
    only the first ones of a set meet those of others, block by block.
    """
    asked = mixed.select(F.col("uid").alias("i"), "r")
    held = sets.join(_few(asked, asked.count()), F.col("uid") == F.col("i")).select("uid", "r", F.size("shingles").alias("size"), F.explode("shingles").alias("key"))
    among = lambda df: df.groupBy(F.col("key").alias("k_key")).agg(F.count("*").alias("n"), F.min("r").alias("a"), F.max("r").alias("b")).where("a <> b").select("k_key", "n")
    listed = held.join(among(held), F.col("key") == F.col("k_key")).groupBy("uid", "r", "size").agg(F.array_sort(F.collect_list(F.struct("n", "key"))).alias("m"))
    placed = listed.select("uid", "r", "size", F.size("m").alias("all"), F.posexplode("m").alias("at", "m")).select("uid", "r", "size", F.col("m.key").alias("key"), (F.col("all") - F.col("at")).alias("rest"))
    placed = materialise(placed.where(F.col("rest") >= similarity * F.col("size")), "near-prefixes")
    placed = placed.join(among(placed), F.col("key") == F.col("k_key")).drop("k_key")

    blocks = F.ceil(F.col("n") / size).cast("long")
    own = placed.withColumn("own", F.pmod(F.xxhash64("uid", F.lit(9)), blocks))
    left = own.select("key", "uid", "r", "size", "rest", F.col("own").alias("one"), F.explode(F.sequence(F.col("own"), blocks - 1)).alias("two"))
    right = own.select(*[F.col(c).alias(f"o_{c}") for c in ("key", "uid", "r", "size", "rest")], F.col("own").alias("o_two"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("own"))).alias("o_one"))
    met = (F.col("key") == F.col("o_key")) & (F.col("one") == F.col("o_one")) & (F.col("two") == F.col("o_two"))
    once = (F.col("r") != F.col("o_r")) & ((F.col("one") < F.col("two")) | (F.col("uid") < F.col("o_uid")))
    most = F.least("rest", "o_rest")  # that they can have in common
    pairs = left.hint("shuffle_merge").join(right, met & once & (most >= similarity * (F.col("size") + F.col("o_size") - most))).select(*_pair(F.col("uid"), F.col("o_uid")))
    return materialise(pairs.distinct(), "near-candidates")


def _joined(root: DataFrame, rest: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """``root`` with the groups joined that verified pairs of ``rest`` connect."""
    tries = 0
    while True:
        # only pairs that would still join two groups; of each two groups a few first, then many more
        for c in ("u", "v"):
            rest = rest.drop(f"r_{c}").join(root.select(F.col("u").alias("m"), F.col("v").alias("r")), F.col(c) == F.col("m"), "left").withColumn(f"r_{c}", F.coalesce("r", c)).drop("m", "r")
        among = Window.partitionBy(F.least("r_u", "r_v"), F.greatest("r_u", "r_v"), F.pmod(F.xxhash64("u", "v"), F.lit(8))).orderBy(F.xxhash64("u", "v"), "u", "v")
        rest, seen = measured(rest.where("r_u <> r_v").withColumn("nth", F.row_number().over(among)), "near-candidates", n=F.count("*"))
        left = seen["n"]
        if not left:
            return root
        now = rest if left <= AT_ONCE else rest.where(F.col("nth") <= 16**tries)
        met = _verified(now.select("u", "v"), sets, similarity, left).join(now.select(F.col("u").alias("x"), F.col("v").alias("y"), "r_u", "r_v"), (F.col("u") == F.col("x")) & (F.col("v") == F.col("y")))
        # groups that met: their roots alone are joined, and the texts below them follow
        joined = components(met.select(F.col("r_u").alias("u"), F.col("r_v").alias("v")))
        below = root.join(joined.select(F.col("u").alias("m"), F.col("v").alias("r")), F.col("v") == F.col("m"), "left").select("u", F.coalesce("r", "v").alias("v"))
        root = materialise(below.unionByName(joined), "near-roots")
        if left <= AT_ONCE:
            return root
        rest = rest.where(F.col("nth") > 16**tries).drop("nth")
        tries += 1


def groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """``uid, doc_id, row_key, root`` of each row; rows of one root are near duplicates.

    Texts of equal words (A-Z in lower case) are always in one group, those
    without words, null included, too. A text of fewer words than a shingle is
    its own shingle.
    """
    small_batches(docs.sparkSession)
    d = docs.select(F.col(doc_id).try_cast("long").alias("doc_id"), row_key(F.col(doc_id), F.col(text)).alias("row_key"), F.col(text).alias("text"))
    t = d.mapInArrow(_features(shingle), "doc_id long, row_key string, seq binary, fp binary, shingles array<long>")
    t = materialise(t.withColumn("uid", F.monotonically_increasing_id()), "near-features")
    classes = materialise(t.groupBy(F.col("seq").alias("c_seq")).agg(F.min("uid").alias("rep")), "near-classes")
    reps, seen = measured(t.select("uid", "fp", "seq").join(classes, F.col("uid") == F.col("rep"), "left_semi").select("uid", "fp"), "near-texts", n=F.count("*"))
    n = seen["n"]
    p, corr = statistics(reps, n)
    found = links(reps, t.select("uid", "shingles"), plan(n, p, corr), similarity)
    rooted = classes.join(found, F.col("rep") == F.col("u"), "left").select("c_seq", F.coalesce("v", "rep").alias("root"))
    return t.select("uid", "doc_id", "row_key", "seq").join(rooted, F.col("seq") == F.col("c_seq")).select("uid", "doc_id", "row_key", "root")


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **params) -> DataFrame:
    """One document of each group of ``groups``, unchanged, with all its columns: the one of least id (nulls last).

    Of equal rows one stays; an empty table stays empty.
    """
    rows = groups(docs, doc_id, text, **params)
    keep = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("row_key"))).alias("k"))
    keep = materialise(keep.select(F.col("k.row_key").alias("k_key")), "near-keep")
    counts = rows.groupBy(F.col("row_key").alias("n_key")).agg(F.count("*").alias("n")).where("n > 1")
    counts = materialise(counts.join(keep, F.col("n_key") == F.col("k_key"), "left_semi").select("n_key"), "near-repeated")
    row = packed(docs, key=row_key(F.col(doc_id), F.col(text))).join(keep, F.col("key") == F.col("k_key"), "left_semi")
    once = row.join(counts, F.col("key") == F.col("n_key"), "left_anti").select("row")
    again = row.join(counts, F.col("key") == F.col("n_key"), "left_semi").dropDuplicates(["key"]).select("row")
    return unpacked(once.unionByName(again), docs.columns)
