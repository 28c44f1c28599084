"""Business reporting over the star schema: joins, aggregates, windows, set operations."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestar.plans.tables import MICRO, NET, SALES_SQL, fiscal_quarter, fiscal_year, micro, money, net_amount, sales, table, views
from lodestar.registry import query


def total(column="net_amt"):
    return F.sum(column).cast("double")


@query("r9_revenue_by_region_segment", f"""with s as ({SALES_SQL})
select region, segment, cast(sum(net_amt) as double) as revenue, count(distinct o_orderkey) as n_orders from s
where order_date >= timestamp '1995-01-01' and order_date < timestamp '1997-01-01' group by region, segment""")  # fmt: skip
def revenue_by_region_segment(spark, d):
    s = sales(spark, d).where((F.col("order_date") >= "1995-01-01") & (F.col("order_date") < "1997-01-01"))
    return s.groupBy("region", "segment").agg(total().alias("revenue"), F.countDistinct("o_orderkey").alias("n_orders"))


@query("r10_sales_view", SALES_SQL.replace(f"{NET} as net_amt", f"cast({NET} as double) as net_amt"))
def sales_view(spark, d):
    return sales(spark, d).withColumn("net_amt", F.col("net_amt").cast("double"))


@query("r10_orders_view", """select o_orderkey, c_name, n_name as nation, case when o_orderstatus = 'F' then 'Y' else 'N' end as closed,
  year(o_orderdate - interval 3 month) as fiscal_year, coalesce(nullif(c_mktsegment, 'MACHINERY'), 'OTHER') as segment
  from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey""")  # fmt: skip
def orders_view(spark, d):
    o, c, n = (table(spark, d, t) for t in ("orders", "customer", "nation"))
    j = o.join(c, o["o_custkey"] == c["c_custkey"]).join(n, c["c_nationkey"] == n["n_nationkey"])
    return j.select("o_orderkey", "c_name", F.col("n_name").alias("nation"), F.when(F.col("o_orderstatus") == "F", "Y").otherwise("N").alias("closed"), fiscal_year(F.col("o_orderdate")).alias("fiscal_year"), F.coalesce(F.nullif("c_mktsegment", F.lit("MACHINERY")), F.lit("OTHER")).alias("segment"))


@query("t2_top_customers", f"""with s as ({SALES_SQL}) select c_custkey, c_name, cast(sum(net_amt) as double) as revenue from s
group by c_custkey, c_name order by sum(net_amt) desc, c_custkey limit 10""")  # fmt: skip
def top_customers(spark, d):
    g = sales(spark, d).groupBy("c_custkey", "c_name").agg(F.sum("net_amt").alias("r"))
    return g.orderBy(F.desc("r"), "c_custkey").limit(10).select("c_custkey", "c_name", F.col("r").cast("double").alias("revenue"))


@query("r9_share_of_region", f"""with s as ({SALES_SQL}), g as (select region, nation, sum(net_amt) as amt from s group by region, nation)
select region, nation, cast(amt as double) as revenue, {MICRO.format('cast(amt as double) / cast(sum(amt) over (partition by region) as double)')} as share_micro from g""")  # fmt: skip
def share_of_region(spark, d):
    g = sales(spark, d).groupBy("region", "nation").agg(F.sum("net_amt").alias("amt"))
    share = F.col("amt").cast("double") / F.sum("amt").over(Window.partitionBy("region")).cast("double")
    return g.select("region", "nation", F.col("amt").cast("double").alias("revenue"), micro(share).alias("share_micro"))


@query("r9_distinct_customers", f"""with s as ({SALES_SQL}) select nation, count(distinct c_custkey) as customers,
  count(distinct case when status = 'closed' then o_orderkey end) as closed_orders from s group by nation""")  # fmt: skip
def distinct_customers(spark, d):
    return sales(spark, d).groupBy("nation").agg(F.countDistinct("c_custkey").alias("customers"), F.countDistinct(F.when(F.col("status") == "closed", F.col("o_orderkey"))).alias("closed_orders"))


@query("j5_customers_without_orders", "select c_custkey, c_name from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'F' and o_orderpriority = '1-URGENT')")
def customers_without_orders(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    o = o.where((F.col("o_orderstatus") == "F") & (F.col("o_orderpriority") == "1-URGENT"))
    return c.join(o, c["c_custkey"] == o["o_custkey"], "left_anti").select("c_custkey", "c_name")


@query("j4_customers_with_urgent_orders", """select c_custkey, c_name from customer where exists (select 1 from orders where o_custkey = c_custkey
  and o_orderpriority like '1-%') and c_nationkey in (select n_nationkey from nation where n_regionkey = 1)""")  # fmt: skip
def customers_with_urgent_orders(spark, d):
    c, o, n = (table(spark, d, t) for t in ("customer", "orders", "nation"))
    o, n = o.where(F.col("o_orderpriority").like("1-%")), n.where(F.col("n_regionkey") == 1)
    return c.join(o, c["c_custkey"] == o["o_custkey"], "left_semi").join(n, c["c_nationkey"] == n["n_nationkey"], "left_semi").select("c_custkey", "c_name")


@query("j7_null_aware_not_in", """select n_name from nation where n_nationkey not in (select case when c_acctbal > 9990 then null else c_nationkey end from customer where c_acctbal > 9000)
  union all select r_name from region where r_regionkey not in (select n_regionkey from nation where n_regionkey < 3)""")  # fmt: skip
def null_aware_not_in(spark, d):
    views(spark, d, "nation", "customer", "region")
    return spark.sql("""select n_name from nation where n_nationkey not in (select case when c_acctbal > 9990 then null else c_nationkey end from customer where c_acctbal > 9000)
        union all select r_name from region where r_regionkey not in (select n_regionkey from nation where n_regionkey < 3)""")


@query("j2_orders_per_customer", """select c_custkey, count(o_orderkey) as n_orders, cast(coalesce(sum(cast(o_totalprice as decimal(18,4))), 0) as double) as spent
  from customer left join orders on c_custkey = o_custkey group by c_custkey""")  # fmt: skip
def orders_per_customer(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    j = c.join(o, c["c_custkey"] == o["o_custkey"], "left")
    return j.groupBy("c_custkey").agg(F.count("o_orderkey").alias("n_orders"), F.coalesce(F.sum(money(F.col("o_totalprice"))), F.lit(0)).cast("double").alias("spent"))


@query("j3_left_join_constant", """select c_mktsegment, count(*) as pairs, count(o_orderkey) as matched from customer left join orders
  on c_custkey = o_custkey and o_orderstatus = 'P' and o_orderdate >= timestamp '1996-01-01' group by c_mktsegment""")  # fmt: skip
def left_join_constant(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    on = (c["c_custkey"] == o["o_custkey"]) & (o["o_orderstatus"] == "P") & (o["o_orderdate"] >= F.lit("1996-01-01").cast("timestamp"))
    return c.join(o, on, "left").groupBy("c_mktsegment").agg(F.count("*").alias("pairs"), F.count("o_orderkey").alias("matched"))


@query("p8_correlated_above_average", """select o_orderkey, o_custkey from orders o where o_totalprice > (select 1.8 * avg(cast(o_totalprice as decimal(18,4))) from orders i where i.o_custkey = o.o_custkey)""")
def correlated_above_average(spark, d):
    # the correlated average, decorrelated into one aggregate and one join
    o = table(spark, d, "orders")
    mean = o.groupBy(F.col("o_custkey").alias("k")).agg((F.sum(money(F.col("o_totalprice"))).cast("double") / F.count("*") * 1.8).alias("m"))
    return o.join(mean, o["o_custkey"] == mean["k"]).where(F.col("o_totalprice") > F.col("m")).select("o_orderkey", "o_custkey")


@query("r9_year_growth", f"""with s as ({SALES_SQL}), g as (select region, sum(case when year(order_date) = 1995 then net_amt else 0 end) as y0, sum(case when year(order_date) = 1996 then net_amt else 0 end) as y1 from s group by region)
select region, cast(y0 as double) as y1995, cast(y1 as double) as y1996, {MICRO.format('(cast(y1 as double) - cast(y0 as double)) / nullif(cast(y0 as double), 0)')} as growth_micro from g""")  # fmt: skip
def year_growth(spark, d):
    year = F.year("order_date")
    amount = lambda y: F.sum(F.when(year == y, F.col("net_amt")).otherwise(0)).cast("double")
    g = sales(spark, d).groupBy("region").agg(amount(1995).alias("y1995"), amount(1996).alias("y1996"))
    return g.withColumn("growth_micro", micro(F.try_divide(F.col("y1996") - F.col("y1995"), F.nullif("y1995", F.lit(0.0)))))


@query("a6_having_busy_nations", f"with s as ({SALES_SQL}) select nation, count(*) as n_lines from s group by nation having count(*) > (select count(*) / 25.0 from s)")
def having_busy_nations(spark, d):
    s = sales(spark, d)
    g = s.groupBy("nation").agg(F.count("*").alias("n_lines"))
    mean = s.agg((F.count("*") / 25.0).alias("m"))  # one row
    return g.crossJoin(F.broadcast(mean)).where(F.col("n_lines") > F.col("m")).select("nation", "n_lines")


@query("fiscal_quarter_sales", f"""with s as ({SALES_SQL}) select year(order_date - interval 3 month) as fy, quarter(order_date - interval 3 month) as fq,
  'FY' || (year(order_date - interval 3 month))::varchar as label, cast(sum(net_amt) as double) as revenue from s group by 1, 2, 3""".replace("order_date - interval 3 month", "date_trunc('month', order_date) - interval 3 month"))  # fmt: skip
def fiscal_quarter_sales(spark, d):
    fy = fiscal_year(F.col("order_date"))
    return sales(spark, d).groupBy(fy.alias("fy"), fiscal_quarter(F.col("order_date")).alias("fq"), F.concat(F.lit("FY"), fy.cast("string")).alias("label")).agg(total().alias("revenue"))


@query("a5_grouping_sets", f"""with s as ({SALES_SQL}) select coalesce(region, '(all)') as region, coalesce(segment, '(all)') as segment, status, cast(grouping(region) as int) as all_regions, count(*) as n
  from s group by status, grouping sets ((region, segment), (region), ())""")  # fmt: skip
def grouping_sets(spark, d):
    sales(spark, d).createOrReplaceTempView("sales_v")
    return spark.sql("""select coalesce(region, '(all)') as region, coalesce(segment, '(all)') as segment, status, cast(grouping(region) as int) as all_regions, count(*) as n
        from sales_v group by status, grouping sets ((region, segment), (region), ())""")


@query("c3_grand_total_labels", """select case when grouping(o_orderstatus) = 1 then 'TOTAL' else o_orderstatus end as status, count(*) as n from orders group by grouping sets ((o_orderstatus), ())""")
def grand_total_labels(spark, d):
    views(spark, d, "orders")
    return spark.sql("select case when grouping(o_orderstatus) = 1 then 'TOTAL' else o_orderstatus end as status, count(*) as n from orders group by grouping sets ((o_orderstatus), ())")


@query("a10_listagg", "select r_name, string_agg(n_name, ',' order by n_name) as nations, string_agg(distinct substr(n_name, 1, 1), '' order by substr(n_name, 1, 1)) as initials from nation join region on n_regionkey = r_regionkey group by r_name")
def listagg(spark, d):
    views(spark, d, "nation", "region")
    return spark.sql("select r_name, listagg(n_name, ',') within group (order by n_name) as nations, listagg(distinct substr(n_name, 1, 1), '') within group (order by substr(n_name, 1, 1)) as initials from nation join region on n_regionkey = r_regionkey group by r_name")


@query("a11_first_last_order", """select o_custkey, arg_min(o_orderkey, (o_orderdate, o_orderkey)) as first_order, arg_max(o_orderpriority, (o_orderdate, o_orderkey)) as last_priority from orders group by o_custkey""")
def first_last_order(spark, d):
    key = F.struct("o_orderdate", "o_orderkey")
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.min_by("o_orderkey", key).alias("first_order"), F.max_by("o_orderpriority", key).alias("last_priority"))


@query("a7_percentiles", f"""select o_orderpriority, {MICRO.format('quantile_cont(o_totalprice, 0.9)')} as p90, {MICRO.format('median(o_totalprice)')} as med,
  {MICRO.format('quantile_disc(o_totalprice, 0.95)')} as nearest95 from orders where o_orderstatus <> 'P' group by o_orderpriority""")  # fmt: skip
def percentiles(spark, d):
    views(spark, d, "orders")
    return spark.sql("""select o_orderpriority, percentile_cont(0.9) within group (order by o_totalprice) as a, median(o_totalprice) as b,
        percentile_disc(0.95) within group (order by o_totalprice) as c from orders where o_orderstatus <> 'P' group by o_orderpriority""").select("o_orderpriority", micro(F.col("a")).alias("p90"), micro(F.col("b")).alias("med"), micro(F.col("c")).alias("nearest95"))


@query("a8_spread_by_type", f"select event_type, count(value) as n, {MICRO.format('avg(value)')} as mean, {MICRO.format('stddev_samp(value)')} as sd, min(value) as low, max(value) as high from events group by event_type")
def spread_by_type(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count("value").alias("n"), micro(F.avg("value")).alias("mean"), micro(F.stddev_samp("value")).alias("sd"), F.min("value").alias("low"), F.max("value").alias("high"))


@query("a2_conditional_counts", """select c_mktsegment, count_if(c_acctbal < 0) as in_debt, sum(case when c_acctbal >= 5000 then 1 else 0 end)::bigint as rich, count(*) filter (where c_nationkey < 5) as near from customer group by c_mktsegment""")
def conditional_counts(spark, d):
    return table(spark, d, "customer").groupBy("c_mktsegment").agg(F.count_if(F.col("c_acctbal") < 0).alias("in_debt"), F.sum(F.when(F.col("c_acctbal") >= 5000, 1).otherwise(0)).alias("rich"), F.count_if(F.col("c_nationkey") < 5).alias("near"))


@query("a4_pivot_complete", """select date_trunc('hour', ts) as hour, max(case when event_type = 'click' then value end) as click, max(case when event_type = 'error' then value end) as error,
  max(case when event_type = 'view' then value end) as view from events group by 1 having count(distinct event_type) = 5""")  # fmt: skip
def pivot_complete(spark, d):
    e = table(spark, d, "events").withColumn("hour", F.date_trunc("hour", "ts"))
    whole = e.groupBy("hour").pivot("event_type", ["click", "error", "purchase", "signup", "view"]).agg(F.max("value"))
    return whole.dropna(subset=["click", "error", "purchase", "signup", "view"]).select("hour", "click", "error", "view")


@query("a15_row_fingerprint", """select 'nation' as t, count(*) as n, sum(('0x' || substr(md5(concat_ws('|', n_nationkey::varchar, n_name, n_regionkey::varchar)), 1, 12))::bigint)::varchar as fp from nation
  union all select 'customer', count(*), sum(('0x' || substr(md5(concat_ws('|', c_custkey::varchar, c_name, c_mktsegment)), 1, 12))::bigint)::varchar from customer""")  # fmt: skip
def row_fingerprint(spark, d):
    from lodestar.operators.compare import fingerprint

    n, c = table(spark, d, "nation"), table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return fingerprint(n, "nation").unionByName(fingerprint(c, "customer"))


@query("a24_best_rule", """with rules(cat, min_total, from_date, pct) as (values ('1-URGENT', 100000, date '1992-01-01', 5), ('1-URGENT', 200000, date '1994-01-01', 12), ('2-HIGH', 50000, date '1993-01-01', 4), ('3-MEDIUM,2-HIGH', 150000, date '1995-01-01', 9)),
  r as (select unnest(string_split(cat, ',')) as cat, min_total, from_date, pct from rules)
  select o_orderkey, max(pct) as discount from orders join r on o_orderpriority = r.cat and o_totalprice >= min_total and o_orderdate >= from_date group by o_orderkey""")  # fmt: skip
def best_rule(spark, d):
    rules = spark.createDataFrame([("1-URGENT", 100000, "1992-01-01", 5), ("1-URGENT", 200000, "1994-01-01", 12), ("2-HIGH", 50000, "1993-01-01", 4), ("3-MEDIUM,2-HIGH", 150000, "1995-01-01", 9)], "cat string, min_total int, from_date string, pct int")
    rules = rules.withColumn("cat", F.explode(F.split("cat", ","))).withColumn("from_date", F.to_date("from_date"))
    o = table(spark, d, "orders")
    hit = o.join(F.broadcast(rules), (o["o_orderpriority"] == rules["cat"]) & (o["o_totalprice"] >= rules["min_total"]) & (o["o_orderdate"] >= rules["from_date"]))  # four constant rules
    return hit.groupBy("o_orderkey").agg(F.max("pct").alias("discount"))


@query("a12_weighted_rate", f"""select date_trunc('day', ts) as day, {MICRO.format("coalesce(sum(case when event_type = 'error' then value end), 0) / (count(*) / 100.0)")} as error_rate,
  {MICRO.format("coalesce(sum(case when event_type = 'purchase' then value end), 0) / (count(*) / 100.0)")} as purchase_rate from events group by 1""".replace("then value", "then cast(value as decimal(18,4))"))  # fmt: skip
def weighted_rate(spark, d):
    part = lambda t: micro(F.coalesce(F.sum(F.when(F.col("event_type") == t, money(F.col("value")))), F.lit(0)).cast("double") / (F.count("*") / 100.0))
    return table(spark, d, "events").groupBy(F.date_trunc("day", "ts").alias("day")).agg(part("error").alias("error_rate"), part("purchase").alias("purchase_rate"))


@query("a13_balanced_accuracy", f"""with p as (select l.toxic as truth, case when length(text) > 2000 then 1 else 0 end as pred from labels l join documents d using (doc_id)),
  c as (select truth, avg(case when pred = truth then 1.0 else 0.0 end) as r from p group by truth) select {MICRO.format('avg(r)')} as balanced_accuracy from c""")  # fmt: skip
def balanced_accuracy(spark, d):
    from lodestar.operators.metrics import balanced_accuracy as metric

    p = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", F.length("text").alias("n")), "doc_id")
    return metric(p.select(F.col("toxic").alias("truth"), (F.col("n") > 2000).cast("int").alias("pred"))).select(micro(F.col("balanced_accuracy")).alias("balanced_accuracy"))


@query("a14_share_guarded", f"select c_nationkey, {MICRO.format('count_if(c_acctbal < -900) / nullif(count_if(c_acctbal < 0), 0)')} as deep_share from customer group by c_nationkey")
def share_guarded(spark, d):
    return table(spark, d, "customer").groupBy("c_nationkey").agg(micro(F.try_divide(F.count_if(F.col("c_acctbal") < -900), F.count_if(F.col("c_acctbal") < 0))).alias("deep_share"))


@query("a19_word_frequency", """select lower(w) as word, count(*) as n from (select unnest(string_split(r_name, ' ')) as w from region union all select unnest(string_split(p_name, ' ')) from part) group by 1""")
def word_frequency(spark, d):
    w = table(spark, d, "region").select("r_name").union(table(spark, d, "part").select("p_name")).select(F.explode(F.split("r_name", " ")).alias("w"))
    return w.groupBy(F.lower("w").alias("word")).agg(F.count("*").alias("n"))


@query("wn1_rank_nulls_last", "select s_suppkey, s_nationkey, rank() over (partition by s_nationkey order by nullif(floor(s_acctbal / 1000), 3) desc nulls last, s_name) as rnk from supplier")
def rank_nulls_last(spark, d):
    w = Window.partitionBy("s_nationkey").orderBy(F.nullif(F.floor(F.col("s_acctbal") / 1000), F.lit(3)).desc_nulls_last(), "s_name")
    return table(spark, d, "supplier").select("s_suppkey", "s_nationkey", F.rank().over(w).alias("rnk"))


@query("wn2_top3_parts_per_brand", "select p_brand, p_partkey, rn from (select p_brand, p_partkey, row_number() over (partition by p_brand order by p_retailprice desc, p_partkey) as rn from part) where rn <= 3")
def top3_parts_per_brand(spark, d):
    from lodestar.operators.ranking import top_n

    return top_n(table(spark, d, "part"), ["p_brand"], [F.desc("p_retailprice"), F.asc("p_partkey")], 3, "rn").select("p_brand", "p_partkey", "rn")


@query("wn3_keep_ties_with_cap", """select p_brand, p_partkey, rk from (select p_brand, p_partkey, rank() over (partition by p_brand order by p_size desc) as rk,
  row_number() over (partition by p_brand order by p_size desc, p_partkey) as rn from part) where rk <= 2 and rn <= 6""")  # fmt: skip
def keep_ties_with_cap(spark, d):
    from lodestar.operators.ranking import top_ties

    return top_ties(table(spark, d, "part"), ["p_brand"], [F.desc("p_size")], [F.asc("p_partkey")], 2, 6, "rk").select("p_brand", "p_partkey", "rk")


@query("wn12_best_line_per_customer", f"""select c_custkey, o_orderkey, l_linenumber from (select *, row_number() over (partition by c_custkey order by net_amt desc, l_partkey, o_orderkey, l_linenumber) as rn from ({SALES_SQL})) where rn = 1""")
def best_line_per_customer(spark, d):
    from lodestar.operators.ranking import top_n

    return top_n(sales(spark, d), ["c_custkey"], [F.desc("net_amt"), F.asc("l_partkey"), F.asc("o_orderkey"), F.asc("l_linenumber")], 1, "rn").select("c_custkey", "o_orderkey", "l_linenumber")


@query("wn13_sample_per_group", "select c_mktsegment, c_custkey from (select c_mktsegment, c_custkey, row_number() over (partition by c_mktsegment order by sha256(c_custkey::varchar), c_custkey) as rn from customer) where rn <= 5")
def sample_per_group(spark, d):
    from lodestar.operators.ranking import top_n

    return top_n(table(spark, d, "customer"), ["c_mktsegment"], [F.sha2(F.col("c_custkey").cast("string"), 256).asc(), F.asc("c_custkey")], 5, "rn").select("c_mktsegment", "c_custkey")


@query("wn5_cdf_bounds", """with h as (select hour(ts) as h, count(*) as w from events group by 1) select h, w, coalesce(sum(w) over (order by h rows between unbounded preceding and 1 preceding), 0)::bigint as lo,
  (sum(w) over (order by h rows unbounded preceding))::bigint as hi from h""")  # fmt: skip
def cdf_bounds(spark, d):
    from lodestar.operators.ranking import running_bounds

    return running_bounds(table(spark, d, "events").groupBy(F.hour("ts").alias("h")).agg(F.count("*").alias("w")), "h", "w")


@query("wn7_line_share_of_order", f"select l_orderkey, l_linenumber, {MICRO.format(f'cast({NET} as double) / cast(sum({NET}) over (partition by l_orderkey) as double)')} as share_micro from lineitem")
def line_share_of_order(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", net_amount().alias("amt"))
    return li.select("l_orderkey", "l_linenumber", micro(F.col("amt").cast("double") / F.sum("amt").over(Window.partitionBy("l_orderkey")).cast("double")).alias("share_micro"))


@query("wn8_cumulative_share", f"""with m as (select p_brand, cast(sum(p_size * p_size) as double) as v from part group by p_brand) select p_brand, {MICRO.format('sum(v) over (order by p_brand) / sum(v) over ()')} as cum_micro from m""")
def cumulative_share(spark, d):
    m = table(spark, d, "part").groupBy("p_brand").agg(F.sum(F.col("p_size") * F.col("p_size")).cast("double").alias("v"))
    w = Window.orderBy("p_brand")  # a few dozen brands, after aggregation
    return m.select("p_brand", micro(F.sum("v").over(w) / F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("cum_micro"))


@query("wn10_latest_order_per_customer", "select o_custkey, o_orderkey, o_orderstatus from (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as rn from orders) where rn = 1")
def latest_order_per_customer(spark, d):
    # the latest row of a key is an aggregate: no sort, and combined before the shuffle
    last = F.max(F.struct("o_orderdate", "o_orderkey", "o_orderstatus")).alias("x")
    return table(spark, d, "orders").groupBy("o_custkey").agg(last).select("o_custkey", "x.o_orderkey", "x.o_orderstatus")


@query("wn11_order_spacing", "select o_orderkey, date_diff('day', lag(o_orderdate) over (partition by o_custkey order by o_orderdate, o_orderkey), o_orderdate) as gap_days from orders")
def order_spacing(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", F.datediff("o_orderdate", F.lag("o_orderdate").over(w)).cast("long").alias("gap_days"))


@query("t1_custom_order", """select o_orderkey, o_orderstatus from orders order by case o_orderstatus when 'P' then 1 when 'O' then 2 else 3 end, nullif(o_orderpriority, '5-LOW') asc nulls last, o_orderkey limit 50""")
def custom_order(spark, d):
    rank = F.when(F.col("o_orderstatus") == "P", 1).when(F.col("o_orderstatus") == "O", 2).otherwise(3)
    return table(spark, d, "orders").orderBy(rank, F.nullif("o_orderpriority", F.lit("5-LOW")).asc_nulls_last(), "o_orderkey").limit(50).select("o_orderkey", "o_orderstatus")


@query("t5_t8_set_operations", """select 'union' as op, count(*) as n from (select c_nationkey from customer union select s_nationkey from supplier)
  union all select 'all', count(*) from (select c_nationkey from customer union all select s_nationkey from supplier)
  union all select 'minus', count(*) from (select n_nationkey from nation except select s_nationkey from supplier where s_acctbal > 0)
  union all select 'left_only', count(*) from (select distinct o_custkey from orders anti join customer on o_custkey = c_custkey)
  union all select 'right_only', count(*) from (select c_custkey from customer anti join orders on o_custkey = c_custkey)""")  # fmt: skip
def set_operations(spark, d):
    c, s, n, o = (table(spark, d, t) for t in ("customer", "supplier", "nation", "orders"))
    both = c.select("c_nationkey").union(s.select("s_nationkey"))
    parts = [("union", both.distinct()), ("all", both), ("minus", n.select("n_nationkey").exceptAll(n.select("n_nationkey").limit(0)).subtract(s.where("s_acctbal > 0").select("s_nationkey")))]
    parts += [("left_only", o.select("o_custkey").distinct().join(c, F.col("o_custkey") == F.col("c_custkey"), "left_anti")), ("right_only", c.join(o, F.col("c_custkey") == F.col("o_custkey"), "left_anti"))]
    out = None
    for name, x in parts:
        one = x.agg(F.count("*").alias("n")).select(F.lit(name).alias("op"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("j14_paired_self_join", """with a as (select o_custkey, year(o_orderdate) as y, count(*) as n from orders group by 1, 2)
  select a.o_custkey, a.n as n_1995, b.n as n_1996, a.n < b.n as grew from a join a b on a.o_custkey = b.o_custkey and a.y = 1995 and b.y = 1996""")  # fmt: skip
def paired_self_join(spark, d):
    a = table(spark, d, "orders").groupBy("o_custkey", F.year("o_orderdate").alias("y")).agg(F.count("*").alias("n"))
    x, y = a.where("y = 1995").select("o_custkey", F.col("n").alias("n_1995")), a.where("y = 1996").select("o_custkey", F.col("n").alias("n_1996"))
    return x.join(y, "o_custkey").withColumn("grew", F.col("n_1995") < F.col("n_1996"))


@query("j15_one_row_cross_join", f"with t as (select avg(cast(o_totalprice as decimal(18,4))) as m from orders) select o_orderstatus, count(*) as above from orders, t where o_totalprice > m group by 1")
def one_row_cross_join(spark, d):
    o = table(spark, d, "orders")
    mean = o.agg((F.sum(money(F.col("o_totalprice"))).cast("double") / F.count("*")).alias("m"))
    return o.crossJoin(F.broadcast(mean)).where(F.col("o_totalprice") > F.col("m")).groupBy("o_orderstatus").agg(F.count("*").alias("above"))


@query("j16_lateral_top2", "select n_name, s_suppkey from nation, lateral (select s_suppkey from supplier where s_nationkey = n_nationkey order by s_acctbal desc, s_suppkey limit 2)")
def lateral_top2(spark, d):
    from lodestar.operators.ranking import top_n

    best = top_n(table(spark, d, "supplier"), ["s_nationkey"], [F.desc("s_acctbal"), F.asc("s_suppkey")], 2, "rn")
    return table(spark, d, "nation").join(best, F.col("n_nationkey") == F.col("s_nationkey")).select("n_name", "s_suppkey")


@query("j17_union_key_spine", """with k as (select c_nationkey as k from customer where c_acctbal > 9000 union select s_nationkey from supplier where s_acctbal > 5000)
  select k, (select count(*) from customer where c_nationkey = k and c_acctbal > 9000) as customers, (select count(*) from supplier where s_nationkey = k and s_acctbal > 5000) as suppliers from k""")  # fmt: skip
def union_key_spine(spark, d):
    c = table(spark, d, "customer").where("c_acctbal > 9000").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("customers"))
    s = table(spark, d, "supplier").where("s_acctbal > 5000").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("suppliers"))
    return c.join(s, "k", "full_outer").select("k", *(F.coalesce(x, F.lit(0)).cast("long").alias(x) for x in ("customers", "suppliers")))


@query("j18_identity_coverage", """select (select count(*) from labels l anti join documents d on l.doc_id = d.doc_id) as only_left, (select count(*) from documents d anti join labels l on l.doc_id = d.doc_id) as only_right""")
def identity_coverage(spark, d):
    from lodestar.operators.compare import coverage

    return coverage(table(spark, d, "labels").select("doc_id"), table(spark, d, "documents").select("doc_id"), "doc_id")


@query("j10_theta_multiply", "select p_partkey, k from part, lateral (select unnest(range(1, p_size + 1)) as k)")
def theta_multiply(spark, d):
    return table(spark, d, "part").select("p_partkey", F.explode(F.sequence(F.lit(1).cast("long"), F.col("p_size").cast("long"))).alias("k"))


@query("s20_daily_settlement", """select o_orderdate as day, count(*) as n, cast(sum(cast(o_totalprice as decimal(18,4))) as double) as amount from orders where o_orderstatus = 'F' group by 1""".replace("o_orderdate as day", "date_trunc('day', o_orderdate) as day"))
def daily_settlement(spark, d):
    return table(spark, d, "orders").where("o_orderstatus = 'F'").groupBy(F.date_trunc("day", "o_orderdate").alias("day")).agg(F.count("*").alias("n"), F.sum(money(F.col("o_totalprice"))).cast("double").alias("amount"))


@query("p3_tuple_in", "select s_suppkey from supplier where (s_nationkey, s_acctbal > 0) in ((1, true), (2, false)) union all select -s_suppkey from supplier where (s_nationkey, s_acctbal > 0) not in ((1, true), (2, false)) and s_nationkey < 3")
def tuple_in(spark, d):
    views(spark, d, "supplier")
    pair = "(s_nationkey, s_acctbal > 0)"
    return spark.sql(f"select s_suppkey from supplier where {pair} in ((1, true), (2, false)) union all select -s_suppkey from supplier where {pair} not in ((1, true), (2, false)) and s_nationkey < 3")


@query("p1_p6_predicates", """select p_partkey, coalesce(nullif(p_size, 7), -1) as size, least(100, greatest(0, p_size * 3)) as capped, case when p_brand like '%2%' escape '!' then 'two' else 'other' end as kind
  from part where p_size between 5 and 20 and p_retailprice >= 900 and p_retailprice < 1500 and regexp_matches(p_type, '(?i)promo|economy')""")  # fmt: skip
def predicates(spark, d):
    p = table(spark, d, "part").where(F.col("p_size").between(5, 20) & (F.col("p_retailprice") >= 900) & (F.col("p_retailprice") < 1500) & F.col("p_type").rlike("(?i)promo|economy"))
    return p.select("p_partkey", F.coalesce(F.nullif("p_size", F.lit(7)), F.lit(-1)).alias("size"), F.least(F.lit(100), F.greatest(F.lit(0), F.col("p_size") * 3)).alias("capped"), F.when(F.col("p_brand").like("%2%"), "two").otherwise("other").alias("kind"))
