"""Tests over tables, rankings of two runs, near names, spooled results and refreshed views."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lodestar.operators import names, resampling, retrieval
from lodestar.plans.tables import MICRO, micro, money, table
from lodestar.registry import query
from lodestar.session import shared_dir
from lodestar.sources import files, views

_COUNTS = {"a_tp": "l_discount > 0.055", "a_fp": "l_tax > 0.065", "a_fn": "l_quantity > 45", "b_tp": "l_tax > 0.035", "b_fp": "l_discount > 0.085", "b_fn": "l_quantity < 6"}


@query("g10_permutation", f"""with c as (select l_returnflag as comparison, l_suppkey % 12 as unit, {', '.join(f'count_if({v}) as {k}' for k, v in _COUNTS.items())} from lineitem group by 1, 2),
  s as (select comparison, f, {', '.join(f"sum(case when (f >> unit) & 1 = 1 then {o}_{k} else {s}_{k} end) as {s}{k}" for s, o in ('ab', 'ba') for k in ('tp', 'fp', 'fn'))} from c, (select unnest(range(4096)) as f) group by 1, 2),
  d as (select comparison, f, 2 * atp / (2 * atp + afp + afn) - 2 * btp / (2 * btp + bfp + bfn) as d from s), o as (select comparison, d as seen from d where f = 0)
  select comparison, 12 as units, {MICRO.format('any_value(seen)')} as difference, count_if(abs(d) >= abs(seen) - 1e-12) as extreme, count(*) as total, {MICRO.format('count_if(abs(d) >= abs(seen) - 1e-12) / count(*)')} as p from d join o using (comparison) group by 1""")  # fmt: skip
def permutation(spark, d):
    c = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("comparison"), (F.col("l_suppkey") % 12).alias("unit")).agg(*[F.count_if(F.expr(v)).alias(k) for k, v in _COUNTS.items()])
    return resampling.permutation_test(c).select("comparison", "units", micro(F.col("difference")).alias("difference"), "extreme", "total", micro(F.col("p")).alias("p"))


def _fifth(x: str) -> str:
    p = resampling.PRIME
    return f"({x}) * ({x}) % {p} * (({x}) * ({x}) % {p}) % {p} * ({x}) % {p}"


_A, _B, _C, _D = resampling.FACTORS
_P = resampling.PRIME


@query("g11_bootstrap", f"""with u as (select unit, row_number() over (order by unit) - 1 as i, count(*) over () as n from (select distinct l_suppkey as unit from lineitem)),
  v as (select l_returnflag as comparison, i, sum(l_discount - l_tax) as d, count(*) as m from lineitem join u on l_suppkey = unit group by 1, 2),
  r as (select r, j, (r * {_A} + j * {_B} + 7) % {_P} as x from (select unnest(range(400)) as r), (select i as j from u)),
  r1 as (select r, j, {_fifth('x')} as x from r), r2 as (select r, j, ({_fifth(f'(x + r * {_C}) % {_P}')}) as x from r1), r3 as (select r, ({_fifth(f'(x + j * {_D}) % {_P}')}) % (select any_value(n) from u) as i from r2),
  b as (select comparison, r, sum(d) / sum(m) as mean from r3 join v using (i) group by 1, 2), o as (select comparison, sum(m)::bigint as units, sum(d) / sum(m) as difference from v group by 1)
  select o.comparison, units, {MICRO.format('difference')} as difference, {MICRO.format('bound')} as bound from o join (select comparison, quantile_cont(mean, 0.05) as bound from b group by 1) using (comparison)""")  # fmt: skip
def bootstrap(spark, d):
    v = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("comparison"), F.col("l_suppkey").alias("unit"), F.col("l_discount").alias("a"), F.col("l_tax").alias("b"))
    return resampling.paired_bootstrap(v, resamples=400, seed=7).select("comparison", "units", micro(F.col("difference")).alias("difference"), micro(F.col("bound")).alias("bound"))


#: Two runs rank an order's lines by quantity: they break ties the other way, one run differs for some orders and lacks others.
@query("x13_rankings", """with h as (select 'A' as run, l_orderkey as query, l_partkey * 8 + l_linenumber as id, l_quantity as score, l_partkey * 8 + l_linenumber as tie from lineitem
    union all select 'B', l_orderkey, l_partkey * 8 + l_linenumber, l_quantity + case when l_orderkey % 19 = 0 then l_linenumber % 3 else 0 end, -(l_partkey * 8 + l_linenumber) from lineitem where l_orderkey % 23 <> 0),
  p as (select *, row_number() over w as pos, coalesce((abs(score - lag(score) over w) > 1e-6)::int, 1) as new from h window w as (partition by run, query order by score desc, tie)),
  g as (select *, sum(new) over (partition by run, query order by pos) as g from p), t as (select run, query, min(pos) as pos, list_sort(list(id)) as ids from g group by run, query, g),
  c as (select run, query, list({'pos': pos, 'ids': ids} order by pos) as groups from t group by 1, 2), f as (select run, query, list(id order by pos) as ids, list(score order by pos) as scores from g group by 1, 2),
  j as (select a.query, a.ids as ia, b.ids as ib, a.scores as sa, b.scores as sb, a.groups as ga, b.groups as gb from (select * from c join f using (run, query) where run = 'A') a left join (select * from c join f using (run, query) where run = 'B') b on a.query = b.query)
  select query, coalesce(ia[1:3] = ib[1:3], false) as identical, coalesce(ga = gb or (len(ia) = len(ib) and ga[1:len(ga) - 1] = gb[1:len(gb) - 1] and ga[-1].pos = gb[-1].pos), false) as equivalent,
    coalesce(len(list_intersect(ia[1:3], ib[1:3])), 0)::int as overlap, case when ib is not null then list_max(list_transform(range(1, least(len(ia), 3) + 1), lambda i: abs(sa[i] - sb[i]))) end as drift from j""")  # fmt: skip
def rankings(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("query"), (F.col("l_partkey") * 8 + F.col("l_linenumber")).alias("id"), F.col("l_quantity").cast("double").alias("q"), F.col("l_linenumber").alias("n"))
    a = li.select(F.lit("A").alias("run"), "query", "id", F.col("q").alias("score"), F.struct((-F.col("q")).alias("by"), F.col("id").alias("tie")).alias("rank"))
    moved = F.col("q") + F.when(F.col("query") % 19 == 0, F.col("n") % 3).otherwise(0)
    b = li.where("query % 23 <> 0").select(F.lit("B").alias("run"), "query", "id", moved.alias("score"), F.struct((-moved).alias("by"), (-F.col("id")).alias("tie")).alias("rank"))
    return retrieval.compared(a.unionByName(b.select(*a.columns)), "A", "B", k=3)


@query("x32_near_names", "select a.c_name as a, b.c_name as b, damerau_levenshtein(a.c_name, b.c_name)::int as distance from (select distinct c_name from customer) a join (select distinct c_name from customer) b on a.c_name < b.c_name and damerau_levenshtein(a.c_name, b.c_name) <= 1")
def near_names(spark, d):
    return names.near_names(table(spark, d, "customer"), "c_name", 1)


@query("s12_spooled_results", "select n_name as name, row_number() over (partition by c_nationkey order by c_custkey) as n, c_custkey || ',' || c_name as line from customer join nation on c_nationkey = n_nationkey")
def spooled_results(spark, d):
    """One result a nation, spooled to text files with a marker before each, and split again."""
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.concat(F.lit("@@ "), "n_name").alias("value"), F.lit(-1).cast("long").alias("at"))
    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("k"), F.concat_ws(",", "c_custkey", "c_name").alias("value"), F.col("c_custkey").cast("long").alias("at"))
    path = f"{shared_dir(spark)}/lodestar/spool-{uuid.uuid4().hex}"
    n.unionByName(c).repartitionByRange(4, "k").sortWithinPartitions("k", "at").select("value").write.text(path)
    return files.spool(spark, path)


@query("s18_refreshed_view", "select strftime(o_orderdate, '%Y-%m') as month, o_orderpriority, count(*) as orders, cast(sum(cast(o_totalprice as decimal(18,4))) as double) as total from orders group by 1, 2")
def refreshed_view(spark, d):
    """Built from a part of the orders, then refreshed from all: months that did not change are not built again."""
    o, month = table(spark, d, "orders"), F.date_format("o_orderdate", "yyyy-MM")
    build = lambda rows: rows.groupBy(month.alias("month"), "o_orderpriority").agg(F.count("*").alias("orders"), F.sum(money(F.col("o_totalprice"))).cast("double").alias("total"))
    view = views.View(spark, f"{shared_dir(spark)}/lodestar/view-{uuid.uuid4().hex}", month, build)
    view.refresh(o.where(F.month("o_orderdate") != 5))
    view.refresh(o)
    return view.read(F.col("month"))
