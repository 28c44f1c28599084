"""Benchmark decontamination with a broadcast hash set of test n-grams (native).

Every 13-word window of a benchmark item (the whole item, if shorter) is
hashed. Training texts are cut into the same normalised words and each token
window is hashed inside one code-generated stage: scan, split, explode the
positions, probe the broadcast hash set, and compare the words of each hit, so
no window leaves the stage unless it really occurs. Per document the hit words
are the union of the windows found.

The hash set is broadcast only up to ``broadcast_windows`` rows; a larger
benchmark is joined by shuffling (hash, second hash, document, position) rows,
and the words of what is found are compared with the texts afterwards.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestar.llm.rows import packed, unpacked
from lodestar.session import materialise

BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SIZE = 13
BROADCAST_WINDOWS = 1_000_000


def ascii_lower(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def words_of(text: Column) -> Column:
    """Lower-cased (A-Z) runs of letters, digits and non-ASCII characters."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BREAK), "")


def row_key(doc_id: Column, text: Column) -> Column:
    """Tells rows apart even where doc_id is null or repeated; equal rows share it."""
    return F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("null")), F.hex(F.xxhash64(text)), F.coalesce(F.length(text), F.lit(-1)).cast("string"))


def _hash(words: Column, at: Column, n: int, *first: Column) -> Column:
    return F.xxhash64(*first, *[F.get(words, at + k) for k in range(n)])


def item_windows(items: DataFrame, item_id: str = "item_id", text: str = "text", size: int = SIZE) -> DataFrame:
    """``item, len, win`` for every window of every item."""
    w = items.select(F.col(item_id).cast("string").alias("item"), words_of(F.col(text)).alias("w"))
    starts = F.when(F.size("w") >= size, F.sequence(F.lit(0), F.size("w") - size)).when(F.size("w") > 0, F.array(F.lit(0)))
    w = w.select("item", "w", F.least(F.size("w"), F.lit(size)).alias("len"), F.explode(starts).alias("at"))
    return w.select("item", "len", F.array_join(F.expr("slice(w, at + 1, len)"), " ").alias("win")).distinct()


def scan(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SIZE, broadcast_windows: int = BROADCAST_WINDOWS) -> tuple[DataFrame, DataFrame]:
    """One pass over the texts: (rows, windows with items).

    Rows are ``doc_id, row_key, n_words, at, len, win_id``: one with ``at`` = -1
    for each document and one for each window found in it. Null texts have no
    words, null items no windows; repeated rows share a key and their windows,
    windows that several items share are one. Empty tables give no rows.
    """
    wins = materialise(item_windows(items, size=size).withColumn("win_id", F.xxhash64("win")), "bench-windows")
    each = wins.select("win_id", "win", "len").distinct()
    lengths = sorted(r[0] for r in each.select("len").distinct().collect())  # at most `size` numbers
    small = each.count() <= broadcast_windows

    cut = docs.select(F.col(doc_id).alias("doc_id"), row_key(F.col(doc_id), F.col(text)).alias("row_key"), words_of(F.col(text)).alias("w"))
    cut = cut.select("*", F.size("w").alias("n_words"))
    least = lengths[0] if lengths else size
    pos = cut.select("*", F.explode(F.when(F.col("n_words") >= least, F.sequence(F.lit(-1), F.col("n_words") - least)).otherwise(F.array(F.lit(-1)))).alias("at"))
    split_win = each.select("win_id", "win", "len", F.split("win", " ").alias("v"))
    keyed = None
    for n in lengths:
        k = split_win.where(F.col("len") == n).select("win_id", "win", "len", _hash(F.col("v"), F.lit(0), n).alias("key"), _hash(F.col("v"), F.lit(0), n, F.lit("check")).alias("check"))
        keyed = k if keyed is None else keyed.unionByName(k)
    if keyed is None:
        none = F.lit(None)
        return cut.select("doc_id", "row_key", "n_words", F.lit(-1).alias("at"), none.cast("int").alias("len"), none.cast("long").alias("win_id")), wins

    def probe(n: int) -> Column:
        fits = (F.col("at") >= 0) & (F.col("at") + n <= F.col("n_words"))
        return F.when(fits, F.struct(F.lit(n).alias("n"), _hash(F.col("w"), F.col("at"), n).alias("key"), _hash(F.col("w"), F.col("at"), n, F.lit("check")).alias("check") if not small else F.lit(0).cast("long").alias("check")))

    if len(lengths) == 1:
        pos = pos.select("*", probe(lengths[0]).alias("p"))
    else:
        pos = pos.select("*", F.explode(F.when(F.col("at") < 0, F.array(probe(lengths[0]))).otherwise(F.array(*[probe(n) for n in lengths]))).alias("p"))
    if small:
        same = F.expr("array_join(slice(w, greatest(at, 0) + 1, len), ' ') = win")
        on = (F.col("p.key") == F.col("key")) & (F.col("p.n") == F.col("len")) & (F.col("at") >= 0) & same
        found = pos.join(F.broadcast(keyed.drop("check")), on, "left")
    else:
        heads = pos.where("at < 0").select("doc_id", "row_key", "n_words", "at", F.lit(None).cast("int").alias("len"), F.lit(None).cast("long").alias("win_id"))
        pos = pos.where("at >= 0").select("doc_id", "row_key", "n_words", "at", F.col("p.key").alias("k1"), F.col("p.check").alias("k2"), F.col("p.n").alias("k3"))
        on = (F.col("k1") == F.col("key")) & (F.col("k2") == F.col("check")) & (F.col("k3") == F.col("len"))
        hits = pos.join(keyed, on).select("doc_id", "row_key", "n_words", "at", "len", "win_id", "win")
        texts = cut.select(F.col("row_key").alias("t_key"), "w").dropDuplicates(["t_key"])
        same = F.expr("array_join(slice(w, at + 1, len), ' ') = win")
        found = hits.join(texts, (F.col("row_key") == F.col("t_key")) & same).select("doc_id", "row_key", "n_words", "at", "len", "win_id").unionByName(heads)
    found = found.where((F.col("at") < 0) | F.col("win_id").isNotNull()).select("doc_id", "row_key", "n_words", "at", "len", "win_id")
    return materialise(found, "bench-hits"), wins


def judge(rows: DataFrame, wins: DataFrame, share: int = 20) -> DataFrame:
    """What ``scan`` gave -> one row a document; contaminated: hits are 1/share of its words."""
    hits = rows.where("at >= 0")
    spot = hits.groupBy("row_key", "at").agg(F.max("len").alias("len"))
    run = Window.partitionBy("row_key").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    to = F.col("at") + F.col("len")
    spot = spot.withColumn("seen", F.coalesce(F.max(to).over(run), F.lit(0)))
    covered = spot.groupBy("row_key").agg(F.sum(F.greatest(F.lit(0), to - F.greatest("at", "seen"))).cast("long").alias("hit"))
    pairs = hits.select("row_key", "win_id").distinct().join(wins.where("item is not null").select("win_id", "item"), "win_id").select("row_key", "item").distinct()
    named = pairs.groupBy("row_key").agg(F.count("*").alias("n_items"), F.array_join(F.array_sort(F.collect_list("item")), ",").alias("items"))
    out = rows.where("at < 0").join(covered, "row_key", "left").join(named, "row_key", "left")
    n_hit = F.coalesce("hit", F.lit(0)).cast("long")
    return out.select(
        "doc_id", "row_key", F.col("n_words").cast("long").alias("n_words"), n_hit.alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce("items", F.lit("")), 256).alias("items_sha256"),
        ((n_hit > 0) & (n_hit * share >= F.col("n_words"))).alias("contaminated"),
    )


def report(docs: DataFrame, items: DataFrame, **params) -> DataFrame:
    """Per document ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated``.

    Null or wordless texts have no words and are clean; items without words are
    ignored, as are null item ids in the list of items; without items or
    documents all are clean; repeated rows each get their row.
    """
    return judge(*scan(docs, items, **params)).drop("row_key")


def decontaminate(docs: DataFrame, items: DataFrame, **params) -> DataFrame:
    """The documents that are not contaminated, unchanged, with all their columns.

    Documents without words stay, as all do without items; repeated rows stay or go together.
    """
    dirty = judge(*scan(docs, items, **params)).where("contaminated").select(F.col("row_key").alias("dirty_key")).distinct()
    rows = packed(docs, key=row_key(F.col(params.get("doc_id", "doc_id")), F.col(params.get("text", "text"))))
    return unpacked(rows.join(dirty, F.col("key") == F.col("dirty_key"), "left_anti"), docs.columns)


ORACLE_SQL = r"""
with dw as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
iw as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
win as (
  select distinct item_id, least(len(w), 13) as n,
         unnest(list_transform(range(0, len(w) - least(len(w), 13) + 1), lambda i: array_to_string(w[i + 1 : i + least(len(w), 13)], ' '))) as win
  from iw where len(w) > 0),
dpos as (
  select doc_id, n, unnest(list_transform(range(0, len(w) - n + 1), lambda i: {'pos': i, 'win': array_to_string(w[i + 1 : i + n], ' ')})) as p
  from dw, (select distinct n from win) where len(w) >= n),
hits as (select d.doc_id, d.p.pos as pos, d.n, v.item_id from dpos d join win v on v.n = d.n and v.win = d.p.win),
cov as (select doc_id, count(distinct pos + k) as n_hit from (select doc_id, pos, unnest(range(0, n)) as k from hits) group by 1),
its as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct doc_id, item_id::varchar as item from hits) group by 1)
select d.doc_id, len(d.w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
       sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(d.w) as contaminated
from dw d left join cov using (doc_id) left join its using (doc_id)
"""
