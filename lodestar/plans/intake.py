"""Reading and writing: JSON lines, logs, marked texts, replaced tables, one input to several tables, generated orders."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lodestar.operators.ranking import running_bounds
from lodestar.plans.tables import money, table
from lodestar.registry import query
from lodestar.session import shared_dir
from lodestar.sources import files, tables


def _fresh(spark, name: str) -> str:
    return f"{shared_dir(spark)}/lodestar/{name}-{uuid.uuid4().hex}"


@query("s8_s9_json_lines", "select event_type, count(*) filter (where event_id % 50 <> 0) as good, cast(sum(cast(value as decimal(18,4))) filter (where event_id % 50 <> 0) as double) as total, (select count(*) from events where event_id % 50 = 0) as broken, true as strict_raises from events group by 1")
def json_lines(spark, d):
    """Events as JSON lines, one in fifty of them cut off: the tolerant reader keeps those apart, the strict one raises."""
    line = F.to_json(F.struct("event_id", "event_type", "value"))
    path = _fresh(spark, "lines")
    table(spark, d, "events").select(F.when(F.col("event_id") % 50 == 0, F.substring(line, 1, 12)).otherwise(line).alias("value")).write.text(path)
    schema = "event_id long, event_type string, value double"
    good, broken = files.json_lines(spark, path, schema)
    try:
        files.json_lines(spark, path, schema, strict=True)
        raises = False
    except ValueError:
        raises = True
    n = broken.agg(F.count("*").alias("broken"))
    sums = good.groupBy("event_type").agg(F.count("*").alias("good"), F.sum(money(F.col("value"))).cast("double").alias("total"))
    return sums.crossJoin(F.broadcast(n)).withColumn("strict_raises", F.lit(raises))  # one row


@query("s11_marked_documents", """with b as (select doc_id, lang, source, unnest(string_split(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')), '. ')) as block, unnest(range(0, len(string_split(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')), '. ')))) as n from documents where lang is not null)
  select doc_id, lang, source, n::int as n, sha256(trim(block)) as sha from b where trim(block) <> '' and not regexp_matches(block, '^\\[[^:\\]]+:[^\\]]*\\]$')""")  # fmt: skip
def marked_documents(spark, d):
    """Documents written as marked-up text, their sentences as blocks, and read again."""
    plain = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"[ \t\n\f\r]+", " "))
    docs = table(spark, d, "documents").where("lang is not null")
    head = F.concat(F.lit("[Lang: "), "lang", F.lit("]\n[Source: "), F.coalesce("source", F.lit("")), F.lit("]\n"))
    texts = docs.select(F.col("doc_id").cast("string").alias("doc"), F.concat(head, F.regexp_replace(plain, r"\. ", "\n\n")).alias("text"))
    m = files.marked_documents(texts)
    return m.select(F.col("doc").cast("long").alias("doc_id"), F.col("meta")["lang"].alias("lang"), F.nullif(F.col("meta")["source"], F.lit("")).alias("source"), "n", F.sha2("block", 256).alias("sha"))


@query("s13_replaced_tables", "select kind, c_custkey, c_name, c_mktsegment from customer, (values ('csv'), ('json')) k(kind) where c_custkey % 2 = 0")
def replaced_tables(spark, d):
    """A table of CSV and one of JSON lines, each written whole and then replaced by half of its rows."""
    c, out = table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment"), None
    for kind in ("csv", "json"):
        path = _fresh(spark, kind)
        files.replace(c, path, kind)
        files.replace(c.where("c_custkey % 2 = 0"), path, kind)
        read = spark.read.schema(c.schema).option("header", True).format(kind).load(path).select(F.lit(kind).alias("kind"), "*")
        out = read if out is None else out.unionByName(read)
    return out


@query("s17_conditional_insert", """select 'large' as route, o_orderkey, cast(o_totalprice as double) as total from orders where o_totalprice > 200000 union all select 'urgent', o_orderkey, o_totalprice from orders where o_orderpriority = '1-URGENT' union all select 'rest', o_orderkey, o_totalprice from orders where o_totalprice <= 200000 and o_orderpriority <> '1-URGENT'""")
def conditional_insert(spark, d):
    """One pass over the orders feeds three tables; an order may go to two."""
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority")
    large, urgent = F.col("o_totalprice") > 200000, F.col("o_orderpriority") == "1-URGENT"
    routes = {k: (c, _fresh(spark, k)) for k, c in (("large", large), ("urgent", urgent), ("rest", ~large & ~urgent))}
    tables.split_write(o, routes)
    out = None
    for name, (_, path) in routes.items():
        read = spark.read.schema(o.schema).parquet(path).select(F.lit(name).alias("route"), "o_orderkey", F.col("o_totalprice").cast("double").alias("total"))
        out = read if out is None else out.unionByName(read)
    return out


@query("d31_generated_orders", """with h as (select hour(ts) as h, count(*) as w from events group by 1), b as (select h, coalesce(sum(w) over (order by h rows between unbounded preceding and 1 preceding), 0) as lo, sum(w) over (order by h rows unbounded preceding) as hi from h),
  o as (select o_orderkey, o_orderdate, h, 1 + o_orderkey % 4 as n from orders join b on (o_orderkey * 7919) % (select count(*) from events) >= lo and (o_orderkey * 7919) % (select count(*) from events) < hi)
  select o_orderkey, o_orderdate + to_hours(h::int) + to_minutes((o_orderkey % 60)::int) as placed, l as line_no, (1 + (o_orderkey * 31 + l * 17) % 50)::bigint as quantity from o join (select unnest(range(1, 5)) as l) lines on l <= n""")  # fmt: skip
def generated_orders(spark, d):
    """Orders spread over the hours as events are (inverse of their cumulated counts), each with as many lines as it asks for."""
    e = table(spark, d, "events")
    bounds = running_bounds(e.groupBy(F.hour("ts").alias("h")).agg(F.count("*").alias("w")), "h", "w")
    k = F.col("o_orderkey")
    o = table(spark, d, "orders").crossJoin(F.broadcast(e.agg(F.count("*").alias("total")))).select("o_orderkey", "o_orderdate", ((k * 7919) % F.col("total")).alias("u"))  # one row
    o = o.join(F.broadcast(bounds), (F.col("u") >= F.col("lo")) & (F.col("u") < F.col("hi")))  # 24 hours
    placed = F.col("o_orderdate").cast("timestamp_ntz") + F.make_dt_interval(hours=F.col("h").cast("int"), mins=(k % 60).cast("int"))
    lines = o.withColumn("line_no", F.explode(F.sequence(F.lit(1).cast("long"), 1 + k % 4)))
    return lines.select("o_orderkey", placed.alias("placed"), "line_no", (1 + (k * 31 + F.col("line_no") * 17) % 50).cast("long").alias("quantity"))


@query("formatted_values", r"select o_orderkey, format('{:,.2f}', o_totalprice) as money, strftime(o_orderdate, '%d.%m.%Y') as day, printf('%08d', o_orderkey) as padded, try_cast(substr(o_orderpriority, 1, 1) as int) as number, try_cast(o_orderpriority as int) as none from orders")
def formatted_values(spark, d):
    o = table(spark, d, "orders")
    return o.select("o_orderkey", F.format_number("o_totalprice", 2).alias("money"), F.date_format("o_orderdate", "dd.MM.yyyy").alias("day"), F.format_string("%08d", "o_orderkey").alias("padded"), F.substring("o_orderpriority", 1, 1).try_cast("int").alias("number"), F.col("o_orderpriority").try_cast("int").alias("none"))
