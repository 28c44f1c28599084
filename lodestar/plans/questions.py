"""Gold business questions over the semantic view of sales, each with its SQL.

Revenue is of closed orders; fiscal years begin in April.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestar.plans.tables import MICRO, SALES_SQL, micro, money, sales, table
from lodestar.registry import query

S = f"with s as ({SALES_SQL}), part_of as (select p_partkey, p_name, p_type, p_brand, p_retailprice from part) "
YEAR_SQL, FISCAL_SQL = ("order_date >= timestamp '{}' and order_date < timestamp '{}'".format(*x) for x in (("1998-01-01", "1999-01-01"), ("1998-04-01", "1999-04-01")))
TARGETS = [("AFRICA", 1.0e8), ("AMERICA", 2.0e6), ("ASIA", 5.0e7), ("EUROPE", 3.0e6), ("MIDDLE EAST", 4.0e9)]


def between(low: str, high: str) -> Column:
    return (F.col("order_date") >= low) & (F.col("order_date") < high)


def year(n: int = 1998) -> Column:
    return between(f"{n}-01-01", f"{n + 1}-01-01")


def fiscal(n: int = 1998) -> Column:
    return between(f"{n}-04-01", f"{n + 1}-04-01")


def closed() -> Column:
    return F.col("status") == "closed"


def revenue() -> Column:
    return F.sum("net_amt").cast("double").alias("revenue")


def with_parts(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_name", "p_type", "p_brand", "p_retailprice")
    return sales(spark, d).join(p, F.col("l_partkey") == F.col("p_partkey"))


REVENUE = "cast(sum(net_amt) as double) as revenue"


@query("r9_customers_total", "select count(*) as n from customer")
def customers_total(spark, d):
    return table(spark, d, "customer").agg(F.count("*").alias("n"))


@query("r9_customers_in_region", "select count(*) as n from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey where r_name = 'EUROPE'")
def customers_in_region(spark, d):
    c, n, r = (table(spark, d, t) for t in ("customer", "nation", "region"))
    place = n.join(r, n["n_regionkey"] == r["r_regionkey"]).where("r_name = 'EUROPE'").select("n_nationkey")
    return c.join(place, F.col("c_nationkey") == F.col("n_nationkey"), "left_semi").agg(F.count("*").alias("n"))


@query("r9_revenue_of_year", f"{S} select {REVENUE} from s where status = 'closed' and {YEAR_SQL}")
def revenue_of_year(spark, d):
    return sales(spark, d).where(closed() & year()).agg(revenue())


@query("r9_revenue_by_type", f"{S} select p_type, {REVENUE} from s join part_of on l_partkey = p_partkey where status = 'closed' and {FISCAL_SQL} group by p_type")
def revenue_by_type(spark, d):
    return with_parts(spark, d).where(closed() & fiscal()).groupBy("p_type").agg(revenue())


@query("r9_top_parts", f"{S} select p_partkey, p_name, {REVENUE} from s join part_of on l_partkey = p_partkey where status = 'closed' and {YEAR_SQL} group by p_partkey, p_name order by sum(net_amt) desc, p_partkey limit 5")
def top_parts(spark, d):
    g = with_parts(spark, d).where(closed() & year()).groupBy("p_partkey", "p_name").agg(F.sum("net_amt").alias("r"))
    return g.orderBy(F.desc("r"), "p_partkey").limit(5).select("p_partkey", "p_name", F.col("r").cast("double").alias("revenue"))


@query("r9_orders_of_status", f"select count(*) as n from orders where o_orderstatus = 'P' and {FISCAL_SQL.replace('order_date', 'o_orderdate')}")
def orders_of_status(spark, d):
    o = table(spark, d, "orders").withColumnRenamed("o_orderdate", "order_date")
    return o.where((F.col("o_orderstatus") == "P") & fiscal()).agg(F.count("*").alias("n"))


@query("r9_average_order_value", f"{S}, o as (select o_orderkey, sum(net_amt) as v from s where status = 'closed' and channel in ('1-URGENT', '2-HIGH') and {YEAR_SQL} group by 1) select {MICRO.format('cast(sum(v) as double) / count(*)')} as average from o")
def average_order_value(spark, d):
    o = sales(spark, d).where(closed() & year() & F.col("channel").isin("1-URGENT", "2-HIGH"))
    # an order's lines need not meet first: the mean is revenue over orders
    return o.agg(micro(F.sum("net_amt").cast("double") / F.countDistinct("o_orderkey")).alias("average"))


@query("r9_rank_of_types", f"{S}, g as (select p_type, sum(net_amt) as r from s join part_of on l_partkey = p_partkey where status <> 'other' and {FISCAL_SQL} group by 1) select p_type, cast(r as double) as revenue, rank() over (order by r desc)::int as place from g")
def rank_of_types(spark, d):
    g = with_parts(spark, d).where((F.col("status") != "other") & fiscal()).groupBy("p_type").agg(F.sum("net_amt").alias("r"))
    return g.select("p_type", F.col("r").cast("double").alias("revenue"), F.rank().over(Window.orderBy(F.desc("r"))).alias("place"))  # one row a type


@query("r9_margin_by_type", f"{S} select p_type, cast(sum(net_amt - cast(l_quantity * p_retailprice * 0.5 as decimal(18,4))) as double) as margin from s join part_of on l_partkey = p_partkey where status = 'closed' and {YEAR_SQL} group by p_type")
def margin_by_type(spark, d):
    cost = money(F.col("l_quantity") * F.col("p_retailprice") * 0.5)
    return with_parts(spark, d).where(closed() & year()).groupBy("p_type").agg(F.sum(F.col("net_amt") - cost).cast("double").alias("margin"))


@query("r9_active_customers", f"{S} select count(distinct c_custkey) as n from s where segment = 'BUILDING' and status = 'closed' and order_date >= timestamp '2000-03-01' and order_date < timestamp '2000-04-01'")
def active_customers(spark, d):
    return sales(spark, d).where(closed() & (F.col("segment") == "BUILDING") & between("2000-03-01", "2000-04-01")).agg(F.countDistinct("c_custkey").alias("n"))


@query("r9_top_customers_of_region", f"{S} select c_custkey, c_name, {REVENUE} from s where region = 'ASIA' and status = 'closed' and {FISCAL_SQL} group by c_custkey, c_name order by sum(net_amt) desc, c_custkey limit 3")
def top_customers_of_region(spark, d):
    g = sales(spark, d).where(closed() & fiscal() & (F.col("region") == "ASIA")).groupBy("c_custkey", "c_name").agg(F.sum("net_amt").alias("r"))
    return g.orderBy(F.desc("r"), "c_custkey").limit(3).select("c_custkey", "c_name", F.col("r").cast("double").alias("revenue"))


@query("r9_share_by_channel", f"select o_orderpriority as channel, {MICRO.format('100.0 * count_if(o_orderstatus = $$P$$) / count(*)').replace('$$', chr(39))} as share from orders where {YEAR_SQL.replace('order_date', 'o_orderdate')} group by 1")
def share_by_channel(spark, d):
    o = table(spark, d, "orders").withColumnRenamed("o_orderdate", "order_date").where(year())
    return o.groupBy(F.col("o_orderpriority").alias("channel")).agg(micro(100.0 * F.count_if(F.col("o_orderstatus") == "P") / F.count("*")).alias("share"))


@query("r9_revenue_of_quarter", f"{S} select {REVENUE} from s where status = 'closed' and order_date >= timestamp '1998-04-01' and order_date < timestamp '1998-07-01'")
def revenue_of_quarter(spark, d):
    return sales(spark, d).where(closed() & between("1998-04-01", "1998-07-01")).agg(revenue())


@query("r9_never_ordered", f"select n_name as nation, count(*) as n from customer join nation on c_nationkey = n_nationkey where not exists (select 1 from orders where o_custkey = c_custkey and {YEAR_SQL.replace('order_date', 'o_orderdate')}) group by 1")
def never_ordered(spark, d):
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    o = table(spark, d, "orders").withColumnRenamed("o_orderdate", "order_date").where(year()).select("o_custkey")
    idle = c.join(o, F.col("c_custkey") == F.col("o_custkey"), "left_anti")
    return idle.join(n, F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_name").alias("nation")).agg(F.count("*").alias("n"))


@query("r9_units_of_type", f"{S} select cast(sum(l_quantity) as double) as units from s join part_of on l_partkey = p_partkey where p_type = 'PROMO' and status = 'closed' and {YEAR_SQL}")
def units_of_type(spark, d):
    return with_parts(spark, d).where(closed() & year() & (F.col("p_type") == "PROMO")).agg(F.sum("l_quantity").alias("units"))


@query("r9_busiest_region", f"{S} select region, count(distinct o_orderkey) as orders from s where channel = '5-LOW' and {YEAR_SQL} group by region order by orders desc, region limit 1")
def busiest_region(spark, d):
    g = sales(spark, d).where(year() & (F.col("channel") == "5-LOW")).groupBy("region").agg(F.countDistinct("o_orderkey").alias("orders"))
    return g.orderBy(F.desc("orders"), "region").limit(1)


@query("r9_average_discount", f"select {MICRO.format('cast(sum(cast(l_discount as decimal(18,4))) as double) / count(*)')} as discount from lineitem join orders on l_orderkey = o_orderkey where o_orderstatus = 'F' and {FISCAL_SQL.replace('order_date', 'o_orderdate')}")
def average_discount(spark, d):
    o = table(spark, d, "orders").withColumnRenamed("o_orderdate", "order_date").where((F.col("o_orderstatus") == "F") & fiscal()).select("o_orderkey")
    li = table(spark, d, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    return li.agg(micro(F.sum(money(F.col("l_discount"))).cast("double") / F.count("*")).alias("discount"))


@query("r9_regions_over_target", f"{S}, t(region, target) as (values {', '.join(f'({chr(39)}{r}{chr(39)}, {v})' for r, v in TARGETS)}) select region from s join t using (region) where status = 'closed' and {FISCAL_SQL} group by region, target having sum(net_amt) > target")
def regions_over_target(spark, d):
    t = spark.createDataFrame(TARGETS, "t_region string, target double")
    g = sales(spark, d).where(closed() & fiscal()).groupBy("region").agg(revenue())
    return g.join(F.broadcast(t), F.col("region") == F.col("t_region")).where("revenue > target").select("region")


@query("r9_revenue_by_channel", f"{S} select channel, {REVENUE}, count(distinct o_orderkey) as orders from s where status = 'closed' and {FISCAL_SQL} group by channel")
def revenue_by_channel(spark, d):
    return sales(spark, d).where(closed() & fiscal()).groupBy("channel").agg(revenue(), F.countDistinct("o_orderkey").alias("orders"))


@query("r9_revenue_growth", f"""{S}, g as (select c_custkey, c_name, sum(case when order_date >= timestamp '1998-04-01' then net_amt else 0 end) - sum(case when order_date < timestamp '1998-04-01' then net_amt else 0 end) as up
  from s where status = 'closed' and order_date >= timestamp '1997-04-01' and order_date < timestamp '1999-04-01' group by 1, 2) select c_custkey, c_name, cast(up as double) as growth from g order by up desc, c_custkey limit 5""")  # fmt: skip
def revenue_growth(spark, d):
    s = sales(spark, d).where(closed() & between("1997-04-01", "1999-04-01"))
    signed = F.when(F.col("order_date") >= "1998-04-01", F.col("net_amt")).otherwise(-F.col("net_amt"))
    g = s.groupBy("c_custkey", "c_name").agg(F.sum(signed).alias("up"))
    return g.orderBy(F.desc("up"), "c_custkey").limit(5).select("c_custkey", "c_name", F.col("up").cast("double").alias("growth"))


@query("r9_revenue_by_month", f"{S} select date_trunc('month', order_date)::timestamp as month, {REVENUE} from s where status = 'closed' and {YEAR_SQL} group by 1")
def revenue_by_month(spark, d):
    return sales(spark, d).where(closed() & year()).groupBy(F.date_trunc("month", "order_date").alias("month")).agg(revenue())
