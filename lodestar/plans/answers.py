"""Questions about customers and service, catalogue views over JSON, and rules that pick a winner."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar.functions import facts
from lodestar.operators import compare, ml, retrieval, verdicts
from lodestar.plans.knowledge import TOPK_SQL, top_hits
from lodestar.plans.tables import MICRO, NET, micro, net_amount, table
from lodestar.registry import query

# Customers are the users of events: an error is an escalation, one of over 60 is critical. Today is the day of the last order.
LINES_SQL = f"o as (select *, (select max(o_orderdate) from orders) as today from orders), paid as (select o_custkey, o_orderkey, o_orderdate, today, sum({NET}) as net from o join lineitem on l_orderkey = o_orderkey where o_orderstatus = 'F' group by 1, 2, 3, 4), good as (select o_custkey from paid group by 1 having sum(net) > 400000)"
PLACE_SQL = "place as (select c_custkey, c_mktsegment, c_acctbal, r_name as region from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey)"


def paid(spark, d):
    """Closed orders with their net amount, and today."""
    o = table(spark, d, "orders")
    today = o.agg(F.max("o_orderdate").alias("today"))
    li = table(spark, d, "lineitem").select("l_orderkey", net_amount().alias("net"))
    sums = o.where("o_orderstatus = 'F'").join(li, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey", "o_orderkey", "o_orderdate").agg(F.sum("net").alias("net"))
    return sums.crossJoin(F.broadcast(today))  # one row


def good(spark, d):
    return paid(spark, d).groupBy("o_custkey").agg(F.sum("net").alias("net")).where("net > 400000").select("o_custkey")


def place(spark, d):
    c, n, r = (table(spark, d, t) for t in ("customer", "nation", "region"))
    where = n.join(r, n["n_regionkey"] == r["r_regionkey"]).select("n_nationkey", F.col("r_name").alias("region"))
    return c.join(where, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_mktsegment", "c_acctbal", "region")


@query("r9_high_value_customers", f"with {LINES_SQL} select count(*) as n from good")
def high_value_customers(spark, d):
    return good(spark, d).agg(F.count("*").alias("n"))


@query("r9_at_risk_by_region", f"""with {LINES_SQL}, {PLACE_SQL} select region, count(*) as n from place where c_custkey in (select o_custkey from good)
  and c_custkey not in (select o_custkey from o where o_orderstatus <> 'P' and o_orderdate >= today - interval 400 day) and c_custkey in (select user_id from events where event_type = 'error') group by region""")  # fmt: skip
def at_risk_by_region(spark, d):
    o = table(spark, d, "orders")
    today = o.agg(F.max("o_orderdate").alias("today"))
    late = o.where("o_orderstatus <> 'P'").crossJoin(F.broadcast(today)).where("o_orderdate >= today - interval 400 days").select("o_custkey")
    c, errors = F.col("c_custkey"), table(spark, d, "events").where("event_type = 'error'").select("user_id")
    risky = place(spark, d).join(good(spark, d).withColumnRenamed("o_custkey", "g"), c == F.col("g"), "left_semi")
    risky = risky.join(late, c == F.col("o_custkey"), "left_anti").join(errors, c == F.col("user_id"), "left_semi")
    return risky.groupBy("region").agg(F.count("*").alias("n"))


_LATE = "l_shipdate > o_orderdate + interval 60 day"
_FISCAL = "o_orderdate >= timestamp '1997-04-01' and o_orderdate < timestamp '1998-04-01'"


def _shipped(spark, d):
    o = table(spark, d, "orders").where(f"o_orderstatus = 'F' and {_FISCAL}").select("o_orderkey", "o_orderdate")
    return o.join(table(spark, d, "lineitem").select("l_orderkey", "l_shipdate"), F.col("l_orderkey") == F.col("o_orderkey")).withColumn("late", F.expr(_LATE))


@query("r9_late_shipments", f"select count(*) as n from orders join lineitem on l_orderkey = o_orderkey where o_orderstatus = 'F' and {_LATE} and {_FISCAL}")
def late_shipments(spark, d):
    return _shipped(spark, d).where("late").agg(F.count("*").alias("n"))


@query("r9_late_share", f"select {MICRO.format(f'count_if({_LATE}) / count(*)')} as share from orders join lineitem on l_orderkey = o_orderkey where o_orderstatus = 'F' and {_FISCAL}")
def late_share(spark, d):
    return _shipped(spark, d).agg(micro(F.count_if("late") / F.count("*")).alias("share"))


@query("r9_critical_open", "select count(*) as n from events where event_type = 'error' and value > 60 and user_id not in (select user_id from events where event_type = 'purchase' and value > 60)")
def critical_open(spark, d):
    e = table(spark, d, "events").where("value > 60")
    return e.where("event_type = 'error'").join(e.where("event_type = 'purchase'").select("user_id"), "user_id", "left_anti").agg(F.count("*").alias("n"))


@query("r9_churned_customers", f"with {LINES_SQL} select count(*) as n from customer where c_acctbal < 0 or not exists (select 1 from paid where o_custkey = c_custkey and o_orderdate >= today - interval 180 day)")
def churned_customers(spark, d):
    recent = paid(spark, d).where("o_orderdate >= today - interval 180 days").select("o_custkey").distinct()
    c = table(spark, d, "customer").join(recent, F.col("c_custkey") == F.col("o_custkey"), "left")
    return c.where("c_acctbal < 0 or o_custkey is null").agg(F.count("*").alias("n"))


@query("r9_repeat_customers", "select c_mktsegment, count(*) as n from customer where (select count(*) from orders where o_custkey = c_custkey and o_orderstatus = 'F') >= 3 group by 1")
def repeat_customers(spark, d):
    often = table(spark, d, "orders").where("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.count("*").alias("orders")).where("orders >= 3")
    return table(spark, d, "customer").join(often, F.col("c_custkey") == F.col("o_custkey"), "left_semi").groupBy("c_mktsegment").agg(F.count("*").alias("n"))


@query("r9_most_escalations", f"with {PLACE_SQL} select region, count(*) as n from events join place on user_id = c_custkey where event_type = 'error' group by 1 order by n desc, region limit 1")
def most_escalations(spark, d):
    e = table(spark, d, "events").where("event_type = 'error'").select("user_id")
    return e.join(place(spark, d), F.col("user_id") == F.col("c_custkey")).groupBy("region").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "region").limit(1)


@query("r9_region_revenue_this_year", f"""with {LINES_SQL}, {PLACE_SQL} select region, cast(sum(net) as double) as revenue from paid join place on o_custkey = c_custkey
  where o_orderdate >= date_trunc('year', today - interval 3 month) + interval 3 month and o_orderdate < date_trunc('year', today - interval 3 month) + interval 15 month group by 1""")  # fmt: skip
def region_revenue_this_year(spark, d):
    begin = F.add_months(F.trunc(F.add_months("today", -3), "year"), 3)
    p = paid(spark, d).where((F.col("o_orderdate") >= begin) & (F.col("o_orderdate") < F.add_months(begin, 12)))
    return p.join(place(spark, d), F.col("o_custkey") == F.col("c_custkey")).groupBy("region").agg(F.sum("net").cast("double").alias("revenue"))


SPELLED = [facts.spelled(n) for n in range(61)]


def sentences(spark, d):
    """A sentence for each order line, with its quantity in words; what it says is known from the line."""
    words = F.element_at(F.array(*[F.lit(w) for w in SPELLED]), F.col("l_quantity").cast("int") + 1)
    discount = F.round(F.col("l_discount") * 100).cast("int").cast("string")
    text = F.concat(F.lit("Order "), (F.col("l_orderkey") + 1000).cast("string"), F.lit(" ships within "), words, F.lit(" working days at "), discount, F.lit("% off, see section "), F.col("l_linenumber").cast("string"), F.lit(".2 at 09:30."))
    # dealt by order first: texts are read in Python, by all tasks alike however few files there are
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_discount").repartition("l_orderkey")
    return lines.select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity", text.alias("text"))


@query("x19_facts", """select l_orderkey, l_partkey, l_linenumber, (l_orderkey + 1000)::varchar || ',-;' || l_quantity::int || ',day;' || round(l_discount * 100)::int || ',percent' as facts from lineitem""")
def facts_of_sentences(spark, d):
    """Facts read from sentences; SQL says them from the columns the sentences were made of."""
    one = lambda f: F.concat_ws(",", f["value"], F.coalesce(f["unit"], F.lit("-")))
    return sentences(spark, d).select("l_orderkey", "l_partkey", "l_linenumber", F.array_join(F.transform(facts.facts("text"), one), ";").alias("facts"))


@query("x9_facts_in_window", """with l as (select l_orderkey, l_partkey, l_linenumber, l_quantity::int as q, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_quantity) as n from lineitem)
  select a.l_orderkey, a.n, count_if(b.q = 2 * a.q) > 0 as double_days from l a join l b on a.l_orderkey = b.l_orderkey and b.n between a.n and a.n + 2 group by 1, 2""")  # fmt: skip
def facts_in_window(spark, d):
    """Whether a fact, twice a line's days, stands in the text of that line and the next two."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_quantity")
    # a line's facts do not depend on the lines beside it, so each is read once and its days go into three windows
    days = lambda f: F.transform(F.filter(f, lambda x: x["unit"] == "day"), lambda x: x["value"])
    read = sentences(spark, d).withColumn("days", days(facts.facts("text")))
    s = read.withColumn("n", F.row_number().over(w)).withColumn("win", F.array("days", F.lead("days", 1).over(w), F.lead("days", 2).over(w)))
    wanted = (2 * F.col("l_quantity").cast("int")).cast("string")
    met = F.exists("win", lambda line: F.coalesce(F.array_contains(line, wanted), F.lit(False)))
    return s.select("l_orderkey", F.col("n").cast("long").alias("n"), met.alias("double_days"))


@query("x1_vector_include_exclude", """with q as (select vec_id as query_id, embedding as qv from embeddings where vec_id % 20 = 0), e as (select *, 'file-' || (vec_id % 7) || '/part' || label as name from embeddings),
  p as (select query_id, vec_id as chunk_id, 1 - list_dot_product(qv::double[], embedding::double[]) / (sqrt(list_dot_product(qv::double[], qv::double[])) * sqrt(list_dot_product(embedding::double[], embedding::double[]))) as distance from q, e where regexp_extract(name, '^[^/]*') in ('file-1', 'file-2', 'file-3') and regexp_extract(name, '^[^/]*') <> 'file-3')
  select query_id, row_number() over (partition by query_id order by distance, chunk_id) as rank, chunk_id from p qualify rank <= 5""")  # fmt: skip
def vector_include_exclude(spark, d):
    e = table(spark, d, "embeddings").withColumn("name", F.concat(F.lit("file-"), (F.col("vec_id") % 7).cast("string"), F.lit("/part"), F.col("label").cast("string")))
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qv"))
    kept = retrieval.of_files(e, "name", include=["file-1", "file-2", "file-3"], exclude=["file-3"])
    hits = retrieval.search(q, kept.select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("cv")), 5)
    return hits.select("query_id", F.col("rank").cast("long").alias("rank"), "chunk_id")


@query("euclidean_nearest", f"""with q as (select embedding as qv from embeddings where vec_id = 0), p as (select vec_id, label, list_distance(qv::double[], embedding::double[]) as dist from q, embeddings)
  select vec_id, label, {MICRO.format('dist')} as distance from p""")  # fmt: skip
def euclidean_distances(spark, d):
    e = table(spark, d, "embeddings")
    q = e.where("vec_id = 0").select(F.col("embedding").alias("qv"))  # one row
    return e.crossJoin(F.broadcast(q)).select("vec_id", "label", micro(retrieval.euclidean(F.col("qv"), F.col("embedding"))).alias("distance"))


@query("x29_recall", f"""with got as (select l_orderkey as q, list_distinct(list(l_partkey)) as got from lineitem where l_linenumber <= 3 group by 1), want as (select l_orderkey as q, list_distinct(list(l_partkey)) as want from lineitem where l_linenumber >= 2 group by 1)
  select q, {MICRO.format('len(list_intersect(got, want)) / len(want)')} as recall, {MICRO.format('len(list_intersect(got, want)) / len(got)')} as "precision" from want join got using (q)""")  # fmt: skip
def recall(spark, d):
    li = table(spark, d, "lineitem")
    got = li.where("l_linenumber <= 3").groupBy(F.col("l_orderkey").alias("q")).agg(F.collect_set("l_partkey").alias("got"))
    want = li.where("l_linenumber >= 2").groupBy(F.col("l_orderkey").alias("q")).agg(F.collect_set("l_partkey").alias("want"))
    both = F.size(F.array_intersect("got", "want"))
    return want.join(got, "q").select("q", micro(F.try_divide(both, F.size("want"))).alias("recall"), micro(F.try_divide(both, F.size("got"))).alias("precision"))


@query("x14_keep_default", """with c as (select l_returnflag as family, l_linenumber as name, count_if(l_discount > 0.045) as hits, count(*) as n from lineitem group by 1, 2), b as (select * from c where name = 1),
  r as (select c.*, row_number() over (partition by c.family order by c.hits::double / c.n desc, abs(c.name - 1), c.name) as place from c), t as (select * from r where place = 1)
  select t.family, case when 100 * (t.hits * b.n - b.hits * t.n) >= 1 * t.n * b.n then t.name else 1 end as kept from t join b using (family)""")  # fmt: skip
def keep_default(spark, d):
    c = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("family"), F.col("l_linenumber").alias("name")).agg(F.count_if(F.col("l_discount") > 0.045).alias("hits"), F.count("*").alias("n"))
    return retrieval.kept_or_best(c, "family", "name", 1, margin_pp=1)


@query("r1_normalised", """select c_custkey, lower(trim(c_name)) as name, case when c_acctbal is null then null else round_even(c_acctbal::decimal(30, 6), 2)::decimal(30, 2)::varchar end as balance, strftime(o_orderdate, '%Y-%m-%d') as day
  from customer join orders on o_custkey = c_custkey""")  # fmt: skip
def normalised_values(spark, d):
    j = table(spark, d, "customer").join(table(spark, d, "orders"), F.col("o_custkey") == F.col("c_custkey"))
    n = lambda c, k: compare.normal(F.col(c), k)
    return j.select("c_custkey", n("c_name", "string").alias("name"), n("c_acctbal", "double").alias("balance"), n("o_orderdate", j.schema["o_orderdate"].dataType.simpleString()).alias("day"))


_ROUNDED = "select lower(trim(n_name)) as a, r_name as b, round_even(cast(c_acctbal as decimal(30, 6)), 2) as c from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey"


@query("r2_bag_equality", f"""with g as ({_ROUNDED}), moved as (select b as x, c as y, a as z, 1 as w from g), wrong as (select a, b, c + case when c = (select max(c) from g) then 1 else 0 end as c from g), swapped as (select a, b, row_number() over (order by c) as n, c from g),
  crossed as (select a, b, lead(c, 1, (select min(c) from g)) over (order by c) as c from g)
  select 'moved' as result, not exists (select a, b, c from g except all select z, x, y from moved) as same from g limit 1""".replace("  select 'moved'", "  (select 'moved'").replace("from g limit 1", "from g limit 1)") + """ union all (select 'wrong', not exists (select a, b, c from g except all select a, b, c from wrong) from g limit 1) union all (select 'crossed', not exists (select a, b, c from g except all select a, b, c from crossed) from g limit 1)""")  # fmt: skip
def bag_equality(spark, d):
    """A result with its columns in another order and one more is the same; one value changed, or values paired otherwise, is not."""
    from pyspark.sql.window import Window

    c, n, r = (table(spark, d, t) for t in ("customer", "nation", "region"))
    g = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("a"), F.col("r_name").alias("b"), F.col("c_acctbal").alias("c"))
    ends = g.agg(F.max("c").alias("high"), F.min("c").alias("low"))
    wide = g.crossJoin(F.broadcast(ends))  # one row
    results = {
        "moved": g.select(F.col("b").alias("x"), F.col("c").alias("y"), F.upper("a").alias("z"), F.lit(1).alias("w")),
        "wrong": wide.select("a", "b", F.when(F.col("c") == F.col("high"), F.col("c") + 1).otherwise(F.col("c")).alias("c")),
        "crossed": wide.select("a", "b", F.coalesce(F.lead("c").over(Window.orderBy("c")), F.col("low")).alias("c")),
    }
    return spark.createDataFrame([(k, compare.same_bag(g, v)) for k, v in results.items()], "result string, same boolean")


_STRATEGIES = "f as (select query_id, ql % 2 as part, min(case when relevant then rank end) as first from hits group by 1, 2), s as (select query_id, part, k as strategy, coalesce(first <= k, false) as hit from f, (values (1), (3), (12)) v(k))"


def _strategies(spark, d):
    f = top_hits(spark, d).groupBy("query_id", (F.col("ql") % 2).alias("part")).agg(F.min(F.when(F.col("relevant"), F.col("rank"))).alias("first"))
    s = f.select("query_id", "part", "first", F.explode(F.array(F.lit(1), F.lit(3), F.lit(12))).alias("strategy"))
    return s.withColumn("hit", F.coalesce(F.col("first") <= F.col("strategy"), F.lit(False)))


@query("x27_confirmatory", f"""{TOPK_SQL}, {_STRATEGIES},
  g as (select x.part, x.strategy as a, y.strategy as b, count(*) as n, count_if(x.hit) as hits_a, count_if(y.hit) as hits_b, count_if(x.hit and not y.hit) as only_a, count_if(not x.hit and y.hit) as only_b from s x join s y on x.query_id = y.query_id and x.strategy < y.strategy group by all),
  t as (select *, least(1.0, (select 2 * sum(exp(lgamma(only_a + only_b + 1) - lgamma(i + 1) - lgamma(only_a + only_b - i + 1))) / pow(2, only_a + only_b) from range(0, least(only_a, only_b)::bigint + 1) r(i))) as p from g),
  h as (select *, row_number() over (order by p) as k, count(*) over () as m from t), a as (select *, max(least(1.0, (m - k + 1) * p)) over (order by p rows unbounded preceding) as p_holm from h)
  select part, a, b, n, hits_a, hits_b, only_a, only_b, {MICRO.format('p')} as p, {MICRO.format('p_holm')} as p_holm, case when p_holm < 0.05 and only_a > only_b then a || ' better' when p_holm < 0.05 and only_b > only_a then b || ' better' else 'no difference detected' end as verdict from a""")  # fmt: skip
def confirmatory(spark, d):
    t = verdicts.confirmatory(_strategies(spark, d), "query_id", "part", "strategy", "hit")
    return t.withColumn("p", micro(F.col("p"))).withColumn("p_holm", micro(F.col("p_holm"))).select("part", "a", "b", "n", "hits_a", "hits_b", "only_a", "only_b", "p", "p_holm", "verdict")


@query("m3_agreement", f"""with z as (select event_type as model, (value > 100)::int as flag, (value - (select avg(value) from events)) / (select stddev_samp(value) from events) as z from events) select model, {MICRO.format('avg(abs(z))')} as mean_extremeness, count(*) as n from z where flag = 1 group by 1""")
def agreement(spark, d):
    e = table(spark, d, "events")
    m = e.agg(F.avg("value").alias("a"), F.stddev_samp("value").alias("s"))
    scores = e.crossJoin(F.broadcast(m)).select(F.col("event_type").alias("model"), (F.col("value") > 100).cast("int").alias("flag"), ((F.col("value") - F.col("a")) / F.col("s")).alias("z"))  # one row
    return ml.extremeness(scores).select("model", micro(F.col("mean_extremeness")).alias("mean_extremeness"), "n")


@query("x16_budgeted_k_by_source", "select source, floor(6000.0 / greatest(1, avg(n_chars)) + 0.5)::int as k from documents group by source")
def budgeted_k_by_source(spark, d):
    """How many chunks of a source's mean size fit a budget of characters, rounded half up."""
    return table(spark, d, "documents").groupBy("source").agg(F.floor(F.lit(6000.0) / F.greatest(F.lit(1.0), F.avg("n_chars")) + 0.5).cast("int").alias("k"))


@query("s3_s5_generated_rows", """select p_partkey, 'row' as kind, g::varchar as item, g as pos from part, range(1, p_size % 5 + 1) t(g) union all select p_partkey, 'list', unnest([p_brand, p_type]), unnest(range(0, 2)) from part
  union all select p_partkey, 'word', unnest(string_split(p_type, ' ')), unnest(range(0, len(string_split(p_type, ' ')))) from part union all select p_partkey, 'const', c.item, c.pos from part join (values ('small', 1, 10), ('large', 2, 99)) c(item, pos, top) on p_size > 40 and top > 50 or p_size <= 40 and top < 50""")  # fmt: skip
def generated_rows(spark, d):
    """Rows made for each part: by a number of it, from a list, from the words of a text, and from constants."""
    p = table(spark, d, "part")
    n = p.where("p_size % 5 > 0").select("p_partkey", F.lit("row").alias("kind"), F.explode(F.sequence(F.lit(1).cast("long"), (F.col("p_size") % 5).cast("long"))).alias("pos")).select("p_partkey", "kind", F.col("pos").cast("string").alias("item"), "pos")
    listed = p.select("p_partkey", F.lit("list").alias("kind"), F.posexplode(F.array("p_brand", "p_type")).alias("pos", "item"))
    words = p.select("p_partkey", F.lit("word").alias("kind"), F.posexplode(F.split("p_type", " ")).alias("pos", "item"))
    const = spark.createDataFrame([("small", 1, False), ("large", 2, True)], "item string, pos long, large boolean")
    sized = p.join(F.broadcast(const), (F.col("p_size") > 40) == F.col("large")).select("p_partkey", F.lit("const").alias("kind"), "item", "pos")  # two rows
    order = ["p_partkey", "kind", "item", F.col("pos").cast("long").alias("pos")]
    return n.select(*order).union(listed.select(*order)).union(words.select(*order)).union(sized.select(*order))
