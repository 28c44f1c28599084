"""Personal data: pattern spans plus information-theoretic sanitisation (native).

Protected entities are the e-mail addresses, IP addresses, card and phone
numbers that the patterns find. Corpus co-occurrence then estimates how much a
term reveals an entity. All counts are of distinct texts, so copies count once:
with n(e) the texts that spell e out, n(t) those holding the term t, n(t, e)
those holding both and D all of them,

    P(e) = n(e) / D,   P(e|t) = n(t, e) / n(t),
    disclosure(t, e) = log2(P(e|t) / P(e)),   information(e) = -log2 P(e).

Terms are whole words of letters, marks and digits outside the pattern spans. A
term whose disclosure reaches ``alpha`` of the entity's information becomes a
span of kind ``term`` wherever it occurs, in texts without the entity too: it is
removed where P(e|t) is at least ``remove_at``, else generalised to a class.
An estimate needs ``support`` distinct surroundings of the entity, each in a
text that holds the term or with the term within ``reach`` characters; near
copies share their surroundings, so copying alone proves nothing. An entity
with fewer surroundings than that has no estimate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.decontamination import row_key
from lodestar.llm.rows import packed, unpacked
from lodestar.session import materialise

KINDS = ("email", "ip", "card", "phone", "term")
# The contract's patterns, in forms that find the same matches without backtracking.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"[0-9](?<![0-9][0-9])[0-9]*+\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9]){11,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# a whole word that no pattern span (masked by NUL) touches
TERM = r"(?<![\p{L}\p{M}\p{N}\x00])[\p{L}\p{M}\p{N}]++(?!\x00)"
LABELS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]"}
REACH = 80
BROADCAST_TERMS = 500_000


def located(text: Column, matches: Column, pattern: str) -> Column:
    """``array<struct<start, end, value>>`` in code points, of all matches of a pattern."""
    pieces = F.split(text, pattern, -1)
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,value:string>>").alias("out"))

    def step(acc, pair):
        start = acc["at"] + F.length(pair["piece"])
        end = start + F.length(pair["match"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), end.alias("end"), pair["match"].alias("value")))).alias("out"))

    pairs = F.arrays_zip(F.slice(pieces, F.lit(1), F.size(matches)).alias("piece"), matches.alias("match"))
    return F.when(F.size(matches) > 0, F.aggregate(pairs, zero, step, lambda acc: acc["out"])).otherwise(zero["out"])


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """12 to 19 digits whose Luhn sum is divisible by ten."""
    d = F.transform(F.split(F.reverse(_digits(value)), "(?<=[0-9])(?=[0-9])"), lambda x: x.cast("int"))
    one = F.transform(d, lambda x, i: F.when(i % 2 == 0, x).when(x > 4, 2 * x - 9).otherwise(2 * x))
    return F.length(_digits(value)).between(12, 19) & (F.aggregate(one, F.lit(0), lambda a, x: a + x) % 10 == 0)


def _ip_ok(value: Column) -> Column:
    def part(p):
        significant = F.regexp_replace(p, "^0+(?=[0-9])", "")
        return (F.length(significant) <= 3) & (F.substring(significant, 1, 3).cast("int") <= 255)

    return F.forall(F.split(value, r"\."), part)


def _tagged(found: Column, k: int, keep) -> Column:
    kept = F.filter(found, lambda s: keep(s["value"])) if keep else found
    return F.transform(kept, lambda s: F.struct(s["start"].alias("start"), F.lit(k).alias("k"), s["end"].alias("end"), s["value"].alias("value")))


def _count(spans: str, k: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["k"] == k)).cast("long")


def base_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, row_key, t, base``: the pattern spans ``struct<start, k, end, value>``, sorted."""
    t = F.coalesce(F.col(text), F.lit(""))
    d = docs.select(F.col(doc_id).alias("doc_id"), row_key(F.col(doc_id), F.col(text)).alias("row_key"), t.alias("t"))
    none = F.array().cast("array<string>")

    def all_of(pattern, when=None):
        m = F.regexp_extract_all("t", F.lit(pattern), F.lit(0))
        return m if when is None else F.when(F.contains(F.col("t"), F.lit(when)), m).otherwise(none)

    d = d.select("*", all_of(EMAIL, "@").alias("m0"), all_of(IP).alias("m1"), all_of(CARD).alias("m2"), all_of(PHONE, "+").alias("m3"))
    keeps = (None, _ip_ok, luhn, lambda v: F.length(_digits(v)).between(9, 15))
    lists = []
    for k, (pattern, keep) in enumerate(zip((EMAIL, IP, CARD, PHONE), keeps, strict=True)):
        found = located(F.col("t"), F.col(f"m{k}"), pattern)
        lists.append(_tagged(found, k, keep))
    return d.select("doc_id", "row_key", "t", F.array_sort(F.concat(*lists)).alias("base"))


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["k"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _masked(t: Column) -> Column:
    """The text with NUL for each character of its pattern spans."""
    nul = F.lit("\0")

    def step(acc, s):
        gap = F.substring(t, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        fill = F.repeat(nul, F.greatest(s["end"] - F.greatest(s["start"], acc["at"]), F.lit(0)))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], F.array(gap, fill)).alias("out"))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    masked = F.aggregate("base", zero, step, lambda acc: F.array_join(F.concat(acc["out"], F.array(F.substring(t, acc["at"] + 1, F.length(t)))), ""))
    return F.when(F.size("base") > 0, masked).otherwise(t)


def _words(masked: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(masked, F.lit(TERM), F.lit(0)), F.lower))


def _term_spans(masked: Column, puts: Column) -> Column:
    """Spans of the words that ``puts`` (lower-case term -> replacement) holds."""
    m = F.regexp_extract_all(masked, F.lit(TERM), F.lit(0))
    kind = "array<struct<start:int,k:int,end:int,value:string>>"
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out"))

    def step(acc, pair):
        start = acc["at"] + F.length(pair["piece"])
        end = start + F.length(pair["match"])
        put = F.try_element_at(puts, F.lower(pair["match"]))
        span = F.array(F.struct(start.alias("start"), F.lit(4).alias("k"), end.alias("end"), put.alias("value"))).cast(kind)
        return F.struct(end.alias("at"), F.when(put.isNotNull(), F.concat(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    pairs = F.arrays_zip(F.slice(F.split(masked, TERM, -1), F.lit(1), F.size(m)).alias("piece"), m.alias("match"))
    return F.aggregate(pairs, zero, step, lambda acc: acc["out"])


def _few(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_TERMS else df


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", alpha: float = 0.8, support: int = 3, remove_at: float = 0.5, reach: int = REACH) -> DataFrame:
    """``doc_id, row_key, base, terms``: pattern spans and disclosing terms of each document.

    ``terms`` holds ``struct<start, k, end, value>`` whose value is the
    replacement: empty for removal, else the class that generalises the term.
    Null and empty texts have no spans; a null id is carried, and repeated rows
    each get their row. An empty table, or one without entities of enough
    support, gives no terms. Terms tied at a threshold are treated alike.
    """
    based = base_spans(docs, doc_id, text).withColumn("m", _masked(F.col("t")))

    def context(s):
        left, right = F.greatest(s["start"] - reach, F.lit(0)), s["end"] + reach
        # the character before and after the reach shows whether its outer words are whole
        around = F.xxhash64(F.substring(F.col("t"), left + 1, s["start"] - left), F.substring(F.col("t"), s["end"] + 1, right - s["end"]))
        wide = F.greatest(left - 1, F.lit(0))
        l, r = F.substring(F.col("m"), wide + 1, s["start"] - wide), F.substring(F.col("m"), s["end"] + 1, right + 1 - s["end"])
        l = F.when(left > 0, F.regexp_replace(l, r"^[\p{L}\p{M}\p{N}]+", " ")).otherwise(l)
        r = F.when(F.length(r) > reach, F.regexp_replace(r, r"[\p{L}\p{M}\p{N}]+\z", " ")).otherwise(r)
        return F.struct(F.concat_ws(":", s["k"].cast("string"), F.lower(s["value"])).alias("entity"), around.alias("context"), F.concat(l, F.repeat(F.lit("\0"), s["end"] - s["start"]), r).alias("s"))

    based = based.select("doc_id", "row_key", "base", "m", F.transform("base", context).alias("near"), F.xxhash64("t").alias("h"), F.length("t").alias("n"), F.monotonically_increasing_id().alias("uid"))
    based = materialise(based, "pii-base")

    # one row of each distinct text
    copied = materialise(based.groupBy(F.col("h").alias("c_h"), F.col("n").alias("c_n")).agg(F.count("*").alias("copies"), F.min("uid").alias("first")).where("copies > 1"), "pii-copies")
    texts = based.join(_few(copied.drop("copies")), (F.col("h") == F.col("c_h")) & (F.col("n") == F.col("c_n")), "left").where("first is null or first = uid").select("uid", "m", "near")
    total = based.select("h", "n").distinct().agg(F.count("*").alias("d"))

    spot = materialise(texts.select("uid", F.explode("near").alias("e")).select("uid", "e.entity", "e.context", "e.s"), "pii-near")
    alone = spot.groupBy(F.col("entity").alias("a_entity")).agg(F.countDistinct("uid").alias("n_e"), F.countDistinct("context").alias("seen")).where(F.col("seen") >= support)
    alone = materialise(alone.drop("seen"), "pii-entities")
    spot = spot.join(_few(alone.select("a_entity")), F.col("entity") == F.col("a_entity"), "left_semi")

    close = spot.select("entity", "context", F.explode(_words(F.col("s"))).alias("term"), F.lit(0).alias("whole"))
    owned = spot.groupBy("uid", "entity").agg(F.min("context").alias("context")).groupBy(F.col("uid").alias("o_uid")).agg(F.collect_list(F.struct("entity", "context")).alias("own"))
    held = texts.where(F.size("near") > 0).select("uid", "m").join(owned, F.col("uid") == F.col("o_uid")).select("own", F.explode(_words(F.col("m"))).alias("term"))
    held = held.select(F.explode("own").alias("e"), "term").select("e.entity", "e.context", "term", F.lit(1).alias("whole"))
    joint = held.unionByName(close).groupBy("entity", "term").agg(F.sum("whole").alias("n_te"), F.countDistinct("context").alias("seen")).where((F.col("seen") >= support) & (F.col("n_te") > 0))
    joint = materialise(joint.join(alone, F.col("entity") == F.col("a_entity")).select("entity", "term", "n_te", "n_e"), "pii-joint")

    every = texts.select(F.explode(_words(F.col("m"))).alias("term")).groupBy("term").agg(F.count("*").alias("n_t"))
    every = every.join(_few(joint.select("term").distinct()), "term")  # counted first: the join sees a term once
    p, info = F.col("n_te") / F.greatest("n_t", "n_te"), F.log2(F.col("d") / F.col("n_e"))
    tells = joint.join(every, "term").crossJoin(F.broadcast(total)).withColumn("p", p).where((F.log2("p") + info >= alpha * info) & (info > 0))
    tells = tells.groupBy("term").agg(F.max("p").alias("p")).select("term", F.when(F.col("p") >= remove_at, F.lit("")).otherwise(F.lit("[TERM]")).alias("put"))
    tells = materialise(tells, "pii-terms")

    # every text that holds such a term, whether it spells the entity out or not
    hits = based.select("uid", F.explode(_words(F.col("m"))).alias("term")).join(_few(tells), "term").groupBy(F.col("uid").alias("h_uid")).agg(F.map_from_entries(F.collect_list(F.struct("term", "put"))).alias("puts"))
    hits = materialise(hits, "pii-hits")
    spans = based.select("uid", "m").join(_few(hits), F.col("uid") == F.col("h_uid")).select("h_uid", _term_spans(F.col("m"), F.col("puts")).alias("terms"))
    out = based.select("doc_id", "row_key", "base", "uid").join(spans, F.col("uid") == F.col("h_uid"), "left")
    return out.select("doc_id", "row_key", "base", F.coalesce("terms", F.array().cast(spans.schema["terms"].dataType)).alias("terms"))


def report(docs: DataFrame, **params) -> DataFrame:
    """Per document the counts of pattern spans, their digest, and all spans.

    Null texts count as empty and have no spans; an empty table gives no rows;
    repeated rows each get their row; further columns are ignored.
    """
    f = find(docs, **params)
    n = [_count("base", k).alias(f"n_{KINDS[k]}") for k in range(4)]
    both = F.array_sort(F.concat("base", "terms"))
    return f.select("doc_id", *n, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(both).alias("spans"))


def sanitise(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **params) -> DataFrame:
    """The documents with every span replaced by its label, removed or generalised.

    Columns and rows stay; texts without spans stay as they are, null included.
    """
    f = find(docs, doc_id, text, **params).where((F.size("base") > 0) | (F.size("terms") > 0))
    labels = F.array(*[F.lit(LABELS[k]) for k in KINDS[:4]])
    f = f.select(F.col("row_key").alias("f_key"), F.array_sort(F.concat("base", "terms")).alias("spans")).dropDuplicates(["f_key"])
    rows = packed(docs, key=row_key(F.col(doc_id), F.col(text)), t=F.col(text)).join(f, F.col("key") == F.col("f_key"), "left")
    t = F.col("t")

    def step(acc, s):
        put = F.when(s["start"] < acc["at"], F.lit("")).otherwise(F.concat(F.substring(t, acc["at"] + 1, s["start"] - acc["at"]), F.when(s["k"] < 4, F.get(labels, s["k"])).otherwise(s["value"])))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], F.array(put)).alias("out"))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    clean = F.aggregate("spans", zero, step, lambda acc: F.array_join(F.concat(acc["out"], F.array(F.substring(t, acc["at"] + 1, F.length(t)))), ""))
    return unpacked(rows, docs.columns, {text: F.when(F.col("spans").isNull(), t).otherwise(clean)})
