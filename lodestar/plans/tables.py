"""Readers of the provided tables, and business columns on top of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def views(spark, sf_dir: str, *names: str) -> None:
    for name in names:
        table(spark, sf_dir, name).createOrReplaceTempView(name)


def money(value: Column) -> Column:
    """Exact sums of amounts: decimal, so that the order of rows does not matter."""
    return value.cast("decimal(18,4)")


def net_amount() -> Column:
    return money(F.col("l_extendedprice") * (1 - F.col("l_discount")))


def micro(value: Column) -> Column:
    """A real number as whole millionths, for results that are compared exactly."""
    return F.floor(value * 1_000_000 + 0.5).cast("long")


MICRO = "cast(floor(({}) * 1000000 + 0.5) as bigint)"
NET = "cast(l_extendedprice * (1 - l_discount) as decimal(18,4))"


def fiscal_year(ts: Column, start_month: int = 4) -> Column:
    return F.year(F.add_months(F.trunc(ts, "MM"), 1 - start_month))


def fiscal_quarter(ts: Column, start_month: int = 4) -> Column:
    return F.quarter(F.add_months(F.trunc(ts, "MM"), 1 - start_month))


def sales(spark, sf_dir: str) -> DataFrame:
    """Semantic view of sales: one row an order line with decoded, named columns."""
    o, li, c = (table(spark, sf_dir, t) for t in ("orders", "lineitem", "customer"))
    n, r = (table(spark, sf_dir, t) for t in ("nation", "region"))
    place = n.join(r, n["n_regionkey"] == r["r_regionkey"]).select("n_nationkey", "n_name", "r_name")  # two fixed dimensions
    status = F.when(F.col("o_orderstatus") == "F", "closed").when(F.col("o_orderstatus") == "O", "open").when(F.col("o_orderstatus") == "P", "partial").otherwise("other")
    return (
        li.join(o, li["l_orderkey"] == o["o_orderkey"]).join(c, o["o_custkey"] == c["c_custkey"]).join(place, c["c_nationkey"] == place["n_nationkey"])
        .select("o_orderkey", "c_custkey", "c_name", F.col("c_mktsegment").alias("segment"), F.col("n_name").alias("nation"), F.col("r_name").alias("region"), F.col("o_orderdate").alias("order_date"), status.alias("status"), F.col("o_orderpriority").alias("channel"), "l_partkey", "l_linenumber", "l_quantity", net_amount().alias("net_amt"))
    )


SALES_SQL = f"""select o_orderkey, c_custkey, c_name, c_mktsegment as segment, n_name as nation, r_name as region, o_orderdate as order_date,
  case o_orderstatus when 'F' then 'closed' when 'O' then 'open' when 'P' then 'partial' else 'other' end as status,
  o_orderpriority as channel, l_partkey, l_linenumber, l_quantity, {NET} as net_amt
  from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey"""
