"""Mix sources to target weights with hash-threshold histograms (native).

Each document gets a 60-bit hash of its id and text. Tokens are summed by (source,
top 12 hash bits); a running sum over at most 4096 buckets a source finds the
bucket in which the source's budget runs out; only that boundary bucket is
refined by the next 12 bits, and so on. What comes out is one hash threshold a
source, so choosing documents is a filter: nothing is sorted by document.
Budgets are nested: a larger target of the same source keeps every document
that a smaller one keeps.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lodestar.llm.rows import packed, unpacked
from lodestar.session import materialise

WORD = r"[^\x20\x09-\x0D]+"
HASH_BITS, STEP_BITS = 60, 12
#: A plan has one row a source; it is broadcast only up to this many sources.
BROADCAST_SOURCES = 200_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def row_hash(doc_id: Column, text: Column) -> Column:
    """60 uniform bits of the document's id and text; equal rows share one value."""
    both = F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(" "), F.md5(F.coalesce(text, F.lit(""))))
    return F.conv(F.substring(F.md5(both), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (1, 2, 3), max_repeats: int = 3) -> DataFrame:
    """``source, source_size`` -> the same plus ``target``.

    Sources in code-point order, null last, weigh ``weights`` repeating and
    share the total size; a target stops at ``max_repeats`` times its source,
    the excess going to the others by weight until none is above (the fixed
    point: min(cap, level * weight) with one common level). One row a source
    goes through one window here: a table of names, not of documents.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    src = sizes.select("source", "source_size", weight.alias("w")).withColumn("cap", F.col("source_size") * max_repeats)
    by_ratio = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before, everything = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    src = src.withColumn("level", (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0))))
    level = F.min(F.when(F.col("cap") / F.col("w") >= F.col("level"), F.struct(F.col("cap") / F.col("w"), F.col("level")))).over(everything)["level"]
    target = F.least(F.col("cap").cast("double"), F.coalesce(level * F.col("w"), F.col("cap").cast("double")))
    return src.select("source", "source_size", target.alias("target"))


def thresholds(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """``source, size, h`` and targets -> ``source, source_size, target, whole, cut``.

    A source is taken ``whole`` times, and once more where ``h <= cut`` (cut is
    -1 for none). The document in which the budget runs out is kept if that
    brings the sum nearer to the target.
    """
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = targets.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    plan = plan.select("*", F.lit(0).cast("long").alias("low"), F.lit(0).cast("long").alias("got"), F.lit(None).cast("long").alias("cut"))
    for bits in range(HASH_BITS - STEP_BITS, -1, -STEP_BITS):
        # rows of the boundary bucket that the previous rounds left open: [low, low + 2^(bits + 12))
        b = plan.where("cut is null").select(F.col("source").alias("p_source"), "rest", "low", "got")
        width = 1 << (bits + STEP_BITS)
        near = F.col("source").eqNullSafe(F.col("p_source")) & (F.col("h") >= F.col("low")) & (F.col("h") < F.col("low") + F.lit(width))
        hist = sized.join(_small(b), near, "inner").groupBy("source", F.shiftright("h", bits).alias("bucket"), "rest", "got").agg(F.sum("size").alias("n"), F.min("h").alias("h0"), F.max("h").alias("h1"))
        run = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        hist = hist.withColumn("after", F.col("got") + F.sum("n").over(run))
        over = F.col("after") > F.col("rest")
        edge = F.min(F.when(over, F.struct("bucket", "n", "after", "h0", "h1")))
        found = hist.groupBy(F.col("source").alias("f_source")).agg(edge.alias("edge"), F.max(F.when(~over, F.col("h1"))).alias("full_to"))
        single = F.col("edge.h0") == F.col("edge.h1")
        nearer = 2 * (F.col("edge.after") - F.col("edge.n")) + F.col("edge.n") <= 2 * F.col("rest")
        below = F.coalesce(F.col("full_to"), F.col("low") - 1)
        cut = F.when(F.col("cut").isNotNull(), F.col("cut")).when(F.col("edge").isNull(), below).when(single & nearer, F.col("edge.h1")).when(single, below)
        plan = plan.join(found, plan["source"].eqNullSafe(found["f_source"]), "left").select(
            "source", "source_size", "target", "whole", "rest",
            F.coalesce(F.shiftleft(F.col("edge.bucket"), bits), F.col("low")).alias("low"),
            F.coalesce(F.col("edge.after") - F.col("edge.n"), F.col("got")).alias("got"),
            cut.cast("long").alias("cut"),
        )
        plan = materialise(plan, "mix-plan")
        if plan.where("cut is null").isEmpty():
            break
    return plan.select("source", "source_size", "target", "whole", F.coalesce("cut", F.lit(-1)).alias("cut"))


def _small(plan: DataFrame) -> DataFrame:
    return F.broadcast(plan) if plan.count() <= BROADCAST_SOURCES else plan


def plan_mix(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), max_repeats: int = 3, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> tuple[DataFrame, DataFrame]:
    """(documents as ``doc_id, source, size, h``, plan of ``thresholds``).

    The texts are read once; sizes and hashes are then a narrow written table.
    """
    sized = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), word_count(F.col(text)).alias("size"), row_hash(F.col(doc_id), F.col(text)).alias("h"))
    sized = materialise(sized, "mix-sizes")
    targets = materialise(source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, max_repeats), "mix-targets")
    return sized, thresholds(sized, targets)


def _taken(rows: DataFrame, plan: DataFrame) -> DataFrame:
    p = _small(plan.withColumnRenamed("source", "p_source"))
    return rows.join(p, rows["source"].eqNullSafe(p["p_source"]), "left")


def mix_table(docs: DataFrame, **params) -> DataFrame:
    """Per document ``doc_id, size, source_size, target, taken``; see ``plan_mix``.

    Null texts have size 0, an empty table gives no rows, equal rows stand or
    fall together, and further columns are ignored.
    """
    sized, plan = plan_mix(docs, **params)
    copies = F.col("whole") + (F.col("h") <= F.col("cut")).cast("long")
    return _taken(sized, plan).select("doc_id", "size", "source_size", "target", (F.col("size") * copies).alias("taken"))


def mix_documents(docs: DataFrame, copies: str = "copies", **params) -> DataFrame:
    """The documents that the mix takes, unchanged, with their number of copies.

    Documents without words weigh nothing in a mix; they stay with one copy.
    An existing column named like ``copies`` is replaced.
    """
    _, plan = plan_mix(docs, **params)
    doc_id, text, source = (params.get(k, k) for k in ("doc_id", "text", "source"))
    docs = docs.drop(copies)
    inner = packed(docs, source=F.col(source).cast("string"), h=row_hash(F.col(doc_id), F.col(text)), empty=F.regexp_instr(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)) == 0)
    n = F.when(F.col("empty"), F.lit(1)).otherwise(F.col("whole") + (F.col("h") <= F.col("cut")).cast("long")).cast("int")
    taken = _taken(inner, plan).select("row", n.alias("n")).where("n > 0")
    return unpacked(taken, docs.columns, None, F.col("n").alias(copies))


ORACLE_SQL = r"""
with sized as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
         ('0x' || substr(md5(coalesce(doc_id::varchar, 'null') || ' ' || md5(coalesce(text, ''))), 1, 15))::bigint as h from documents),
src as (
  select source, sum(size)::bigint as source_size,
         ((row_number() over (order by encode(source) nulls last) - 1) % 3 + 1)::bigint as w from sized group by source),
ord as (
  select *, 3 * source_size as cap,
         (sum(source_size) over () - coalesce(sum(3 * source_size) over r, 0))::double
           / (sum(w) over () - coalesce(sum(w) over r, 0))::double as level
  from src window r as (order by 3 * source_size / w, encode(source) nulls last rows between unbounded preceding and 1 preceding)),
lev as (select min(struct_pack(r := cap / w, level := level)) as x from ord where cap / w >= level),
tgt as (
  select source, source_size, least(cap::double, coalesce((select x.level from lev) * w, cap::double)) as target from ord),
pl as (
  select *, case when source_size > 0 then floor(target / source_size)::bigint else 0 end as whole from tgt),
g as (
  select source, h, sum(size) as n, sum(sum(size)) over (partition by source order by h) as after from sized group by source, h),
res as (
  select s.doc_id, s.size, p.source_size, p.target,
         (s.size * (p.whole + case when 2 * (g.after - g.n) + g.n <= 2 * (p.target - p.whole * p.source_size) then 1 else 0 end))::bigint as taken
  from sized s join pl p on s.source is not distinct from p.source
  join g on g.source is not distinct from s.source and g.h = s.h)
select doc_id, size, source_size, target, taken from res
"""
