"""Judging, strategies, graph checks, feeds and tuning over the provided tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lodestar.functions import text
from lodestar.operators import episodes, graph, matching, retrieval, verdicts
from lodestar.plans.knowledge import EDGES_SQL, TOPK_SQL, edges, top_hits
from lodestar.plans.monitoring import INCIDENTS_SQL, incidents
from lodestar.plans.tables import MICRO, micro, table
from lodestar.registry import query
from lodestar.session import materialise
from lodestar.sources import tables as upserts


@query("r3_tolerant_matching", """with g as (select c_nationkey as nation, c_acctbal as v, row_number() over (partition by c_nationkey order by c_acctbal) as p from customer),
  x as (select nation, v, row_number() over (partition by nation order by v) as p from (select c_nationkey as nation, c_acctbal + case when c_custkey % 97 = 0 then 0.02 else 0.002 end as v from customer))
  select coalesce(g.nation, x.nation) as nation, bool_and(coalesce(abs(g.v - x.v) < 0.005, false)) as matches from g full join x on g.nation = x.nation and g.p = x.p group by 1""")  # fmt: skip
def tolerant_matching(spark, d):
    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("nation"), "c_custkey", F.col("c_acctbal").alias("v"))
    shifted = c.withColumn("v", F.col("v") + F.when(F.col("c_custkey") % 97 == 0, 0.02).otherwise(0.002))
    return verdicts.tolerant_bags(c, shifted, ["nation"], "v")


#: Of each order, its lines' rates against rates that are a hundredth or two off: more than one line is near enough.
@query("r3_row_matching", """with g as (select l_orderkey as o, l_discount as d, l_tax as t, l_returnflag as f, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) as p from lineitem),
  r as (select l_orderkey as o, l_discount + case l_linenumber % 3 when 0 then 0.02 when 1 then 0.01 else 0 end as d, l_tax - case l_linenumber % 2 when 0 then 0.01 else 0 end as t, case when l_orderkey % 13 = 0 then 'N' else l_returnflag end as f,
    row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) as p from lineitem where l_orderkey % 17 <> 0 or l_linenumber <> 2),
  a as (select g.o, g.p, coalesce(bit_or((1 << (r.p - 1))::bigint) filter (where abs(g.d - r.d) < 0.015 and abs(g.t - r.t) < 0.015 and g.f = r.f), 0) as near from g left join r on g.o = r.o group by 1, 2),
  n as (select o, count(*) as n_gold, coalesce(any_value(m), 0) as n_result from g left join (select o, count(*) as m from r group by 1) using (o) group by 1),
  halls as (select a.o, s.s, bit_count(bit_or(near)) >= count(*) as fits from a join n on a.o = n.o join lateral (select unnest(range(1, (1 << n_gold)::bigint)) as s) s on true where (s.s >> (a.p - 1)) & 1 = 1 group by 1, 2)
  select n.o as l_orderkey, n_gold::bigint as n_gold, n_result::bigint as n_result, n_gold = n_result and fits as matches from n join (select o, bool_and(fits) as fits from halls group by 1) using (o)""")  # fmt: skip
def row_matching(spark, d):
    li, n = table(spark, d, "lineitem"), F.col("l_linenumber")
    gold = li.select("l_orderkey", F.col("l_discount").alias("d"), F.col("l_tax").alias("t"), F.col("l_returnflag").alias("f"))
    off = F.when(n % 3 == 0, 0.02).when(n % 3 == 1, 0.01).otherwise(0.0)
    flag = F.when(F.col("l_orderkey") % 13 == 0, "N").otherwise(F.col("l_returnflag"))
    result = li.where((F.col("l_orderkey") % 17 != 0) | (n != 2)).select("l_orderkey", (F.col("l_discount") + off).alias("d"), (F.col("l_tax") - F.when(n % 2 == 0, 0.01).otherwise(0.0)).alias("t"), flag.alias("f"))
    return matching.tolerant_rows(gold, result, ["l_orderkey"], ["d", "t", "f"], 0.015)


@query("r4_percent_units", """with t as (select l_orderkey, l_linenumber, round(100 * l_discount, 1) as gold, case when l_linenumber % 2 = 0 then l_discount else 100 * l_discount + case when l_linenumber = 3 then 0.3 else 0 end end as v from lineitem)
  select l_orderkey, l_linenumber, abs(gold - v) < 0.005 or (round(gold, 1) = gold and round(v, 1) = gold) or abs(gold - 100 * v) < 0.005 or (round(gold, 1) = gold and round(100 * v, 1) = gold) as matches from t""")  # fmt: skip
def percent_units(spark, d):
    n, share = F.col("l_linenumber"), F.col("l_discount")
    t = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(100 * share, 1).alias("gold"), F.when(n % 2 == 0, share).otherwise(100 * share + F.when(n == 3, 0.3).otherwise(0.0)).alias("v"))
    return t.select("l_orderkey", "l_linenumber", verdicts.close_percent(F.col("gold"), F.col("v")).alias("matches"))


ANSWERS_SQL = """answers as (select l_partkey as q, l_linenumber as run, l_orderkey as o, l_tax as seconds, p_retailprice + case l_linenumber % 4 when 1 then 0.001 when 2 then 1 else 0 end as value, 2 + l_linenumber % 2 as columns from lineitem join part on l_partkey = p_partkey),
  golds as (select p_partkey as q, 1 as place, p_retailprice as gold, 2 as gold_columns from part union all select p_partkey, 2, p_retailprice + 1, 2 from part),
  j as (select a.*, round_even(value, 2) = round_even(gold, 2) as two, round_even(value, 6) = round_even(gold, 6) as six, columns = gold_columns as same, place = 1 as first_one from answers a join golds using (q))"""


def _judged(spark, d):
    li, p = table(spark, d, "lineitem"), table(spark, d, "part")
    n = F.col("l_linenumber")
    off = F.when(n % 4 == 1, 0.001).when(n % 4 == 2, 1.0).otherwise(0.0)
    answers = li.join(p, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_partkey").alias("q"), n.alias("run"), F.col("l_orderkey").alias("o"), F.col("l_tax").alias("seconds"), (F.col("p_retailprice") + off).alias("value"), (2 + n % 2).alias("columns"))
    gold = p.select(F.col("p_partkey").alias("q"), F.explode(F.array(F.struct(F.lit(1).alias("place"), F.col("p_retailprice").alias("gold")), F.struct(F.lit(2).alias("place"), (F.col("p_retailprice") + 1).alias("gold")))).alias("g")).select("q", "g.place", "g.gold", F.lit(2).alias("gold_columns"))
    return verdicts.sensitivity(answers, gold, ["q"])


@query("r5_r6_comparison_rules", f"""with {ANSWERS_SQL}, v as (select q, run, o, seconds, value, columns, bool_or(two) as published, bool_or(six) as exact_numbers, bool_or(two and same) as exact_columns, bool_or(two and first_one) as first_gold, bool_or(six and same and first_one) as strict from j group by all)
  select run, count(*) as n, count_if(published) as published, count_if(exact_numbers) as exact_numbers, count_if(exact_columns) as exact_columns, count_if(first_gold) as first_gold, count_if(strict) as strict from v group by run""")  # fmt: skip
def comparison_rules(spark, d):
    rules = ("published", "exact_numbers", "exact_columns", "first_gold", "strict")
    return _judged(spark, d).groupBy("run").agg(F.count("*").alias("n"), *[F.count_if(r).alias(r) for r in rules])


@query("r7_accuracy_and_latency", f"with {ANSWERS_SQL}, v as (select q, run, o, seconds, value, columns, bool_or(two) as ok from j group by all) select run, count(*) as n, count_if(ok) as right, {MICRO.format('count_if(ok) / count(*)')} as accuracy, {MICRO.format('median(seconds)')} as median_seconds from v group by run".replace(" as right", ' as "right"'))
def accuracy_and_latency(spark, d):
    a = verdicts.accuracy(_judged(spark, d), ["run"], "published", "seconds")
    return a.select("run", "n", "right", micro(F.col("accuracy")).alias("accuracy"), micro(F.col("median_seconds")).alias("median_seconds"))


@query("x9_fact_in_window", """with w as (select conv_id, turn, substr(concat_ws(chr(10), text, lead(text, 1) over c, lead(text, 2) over c), 1, 1200) as win from conversations window c as (partition by conv_id order by turn))
  select conv_id, turn, length(win)::int as size, contains(lower(win), 'de') and contains(lower(win), 'la') as both from w""")  # fmt: skip
def fact_in_window(spark, d):
    c = Window.partitionBy("conv_id").orderBy("turn")
    win = F.substring(F.concat_ws("\n", "text", F.lead("text", 1).over(c), F.lead("text", 2).over(c)), 1, 1200)
    w = table(spark, d, "conversations").select("conv_id", "turn", win.alias("win"))
    return w.select("conv_id", "turn", F.length("win").alias("size"), (F.contains(F.lower("win"), F.lit("de")) & F.contains(F.lower("win"), F.lit("la"))).alias("both"))


@query("x10_twin_language_first", TOPK_SQL + """, t as (select query_id, min(case when label % 2 = ql % 2 then rank end) as own, min(case when label % 2 <> ql % 2 then rank end) as other from hits group by 1)
  select query_id, own::int as own, other::int as other, coalesce(other < coalesce(own, 1073741824), false) as twin_first from t""")  # fmt: skip
def twin_language_first(spark, d):
    h = top_hits(spark, d).withColumn("twin", F.col("label") % 2 != F.col("ql") % 2)
    return verdicts.twin_first(h, "query_id", "rank", "twin")


@query("x15_model_ranking", TOPK_SQL + f""", f as (select ql as model, query_id, min(case when relevant then rank end) as first from hits group by all), g as (select model, count(*) as n, count_if(coalesce(first, 99) <= 5) as hits, {MICRO.format('avg(coalesce(1.0 / first, 0))')} as mrr from f group by 1)
  select model, n, hits, mrr, row_number() over (order by hits / n desc, mrr desc, model)::int as place from g""")  # fmt: skip
def model_ranking(spark, d):
    f = top_hits(spark, d).groupBy(F.col("ql").alias("model"), "query_id").agg(F.min(F.when(F.col("relevant"), F.col("rank"))).alias("first"))
    r = f.groupBy("model").agg(F.count("*").alias("n"), F.count_if(F.col("first") <= 5).alias("hits"), micro(F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0)))).alias("mrr"))
    return verdicts.ranked_models(r, [F.desc(F.col("hits") / F.col("n")), F.desc("mrr"), F.asc("model")])


@query("x19_number_with_unit", r"select doc_id, len(regexp_extract_all(text, '[0-9]+'))::bigint as numbers, regexp_matches(text, '(^|[^0-9.,])[0-9]+ ?(gb|mb|kg|km|%)') as measured from documents")
def number_with_unit(spark, d):
    return table(spark, d, "documents").select("doc_id", F.regexp_count("text", F.lit("[0-9]+")).cast("long").alias("numbers"), F.regexp_like("text", F.lit("(^|[^0-9.,])[0-9]+ ?(gb|mb|kg|km|%)")).alias("measured"))


@query("x20_answer_verdict", """with t as (select l_orderkey as o, l_linenumber as n, l_quantity > 20 as correct, l_discount > 0.05 as hedged, l_returnflag = 'R' as contaminated, l_linestatus = 'O' and l_linenumber = 1 as refused, l_tax < 0.07 as answerable from lineitem),
  v as (select o, n, case when refused then case when answerable then 'false_refusal' else 'right_refusal' end when not answerable then 'invented' when correct and contaminated then 'contaminated' when correct and hedged then 'hedged' when correct then 'correct' else 'wrong' end as verdict from t) select verdict, count(*) as n, min(o) as least from v group by 1""")  # fmt: skip
def answer_verdict(spark, d):
    t = table(spark, d, "lineitem")
    v = verdicts.verdict(F.col("l_quantity") > 20, F.col("l_discount") > 0.05, F.col("l_returnflag") == "R", (F.col("l_linestatus") == "O") & (F.col("l_linenumber") == 1), F.col("l_tax") < 0.07)
    return t.groupBy(v.alias("verdict")).agg(F.count("*").alias("n"), F.min("l_orderkey").alias("least"))


@query("x27_strategy_pairs", TOPK_SQL + """, f as (select query_id, min(case when relevant then rank end) as first from hits group by 1), s as (select query_id, k as strategy, coalesce(first <= k, false) as hit from f, (values (1), (3), (5)) v(k))
  select x.strategy as a, y.strategy as b, count_if(x.hit and y.hit) as both, count_if(x.hit and not y.hit) as only_a, count_if(not x.hit and y.hit) as only_b from s x join s y on x.query_id = y.query_id and x.strategy < y.strategy group by 1, 2""")  # fmt: skip
def strategy_pairs(spark, d):
    f = top_hits(spark, d).groupBy("query_id").agg(F.min(F.when(F.col("relevant"), F.col("rank"))).alias("first"))
    s = f.select("query_id", "first", F.explode(F.array(F.lit(1), F.lit(3), F.lit(5))).alias("strategy"))
    return verdicts.paired(s.withColumn("hit", F.coalesce(F.col("first") <= F.col("strategy"), F.lit(False))), "query_id", "strategy", "hit")


@query("x30_runs_differ", "with r as (select l_partkey as q, list(l_suppkey order by l_suppkey) filter (where l_linenumber % 2 = 0) as a, list(l_suppkey order by l_suppkey) filter (where l_linenumber % 2 = 1) as b from lineitem group by 1) select q, coalesce(a, []) is distinct from coalesce(b, []) as differ from r")
def runs_differ(spark, d):
    even = F.col("l_linenumber") % 2 == 0
    r = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("q")).agg(F.array_sort(F.collect_list(F.when(even, F.col("l_suppkey")))).alias("a"), F.array_sort(F.collect_list(F.when(~even, F.col("l_suppkey")))).alias("b"))
    return r.select("q", (F.col("a") != F.col("b")).alias("differ"))


@query("x36_flatten_with_checks", "select conv_id, count(*) as records, count_if(text is null or length(text) = 0) as without_text, max(turn) + 1 = count(*) as whole, count(distinct turn) = count(*) as unique_turns from conversations group by conv_id")
def flatten_with_checks(spark, d):
    record = F.struct("turn", "role", "text")
    nested = table(spark, d, "conversations").groupBy("conv_id").agg(F.to_json(F.collect_list(record), {"ignoreNullFields": "false"}).alias("body"))  # one record file a conversation
    flat = nested.select("conv_id", F.explode(F.from_json("body", "array<struct<turn: long, role: string, text: string>>")).alias("r"))
    n = F.count("*")
    return flat.groupBy("conv_id").agg(n.alias("records"), F.count_if(F.col("r.text").isNull() | (F.length("r.text") == 0)).alias("without_text"), (F.max("r.turn") + 1 == n).alias("whole"), (F.countDistinct("r.turn") == n).alias("unique_turns"))


@query("g2_edges_with_nodes", f"with {EDGES_SQL} select src, dst, kind, a.label as src_label, b.label as dst_label from e join embeddings a on a.vec_id = src join embeddings b on b.vec_id = dst")
def edges_with_nodes(spark, d):
    n = table(spark, d, "embeddings").select("vec_id", "label")
    a, b = n.select(F.col("vec_id").alias("src"), F.col("label").alias("src_label")), n.select(F.col("vec_id").alias("dst"), F.col("label").alias("dst_label"))
    return edges(spark, d).join(a, "src").join(b, "dst").select("src", "dst", "kind", "src_label", "dst_label")


def _fixed(e):
    """Walks of one to three edges with the ids between as columns."""
    one = e.select("src", F.lit(None).cast("long").alias("via_1"), F.lit(None).cast("long").alias("via_2"), "dst", F.lit(1).alias("hops"))
    step = lambda c: e.select(F.col("src").alias(f"{c}_from"), F.col("dst").alias(f"{c}_to"))
    two = e.join(step("b"), F.col("dst") == F.col("b_from"))
    three = two.join(step("c"), F.col("b_to") == F.col("c_from")).select("src", F.col("dst").alias("via_1"), F.col("b_to").alias("via_2"), F.col("c_to").alias("dst"), F.lit(3).alias("hops"))
    return one.unionByName(two.select("src", F.col("dst").alias("via_1"), F.lit(None).cast("long").alias("via_2"), F.col("b_to").alias("dst"), F.lit(2).alias("hops"))).unionByName(three)


@query("g4_fixed_hops", f"with {EDGES_SQL} select src, null::bigint as via_1, null::bigint as via_2, dst, 1 as hops from e union all select a.src, a.dst, null, b.dst, 2 from e a join e b on a.dst = b.src union all select a.src, a.dst, b.dst, c.dst, 3 from e a join e b on a.dst = b.src join e c on b.dst = c.src")
def fixed_hops(spark, d):
    return _fixed(edges(spark, d))


@query("g5_two_forms_agree", f"""with recursive {EDGES_SQL}, w as (select vec_id as root, vec_id as node, 0 as hops from embeddings union all select root, dst, hops + 1 from w join e on node = src where hops < 3),
  v as (select root, node, hops from w where hops > 0), f as (select src as root, dst as node, 1 as hops from e union all select a.src, b.dst, 2 from e a join e b on a.dst = b.src union all select a.src, c.dst, 3 from e a join e b on a.dst = b.src join e c on b.dst = c.src)
  select (select count(*) from (select * from v except all select * from f)) as only_walks, (select count(*) from (select * from f except all select * from v)) as only_fixed, true as same_columns""")  # fmt: skip
def two_forms_agree(spark, d):
    """Variable-length walks against the fixed-hop form, as bags of (root, node, hops)."""
    e = edges(spark, d)
    w = graph.walks(e, table(spark, d, "embeddings").select(F.col("vec_id").alias("root")), 3).select("root", "node", F.col("hops").cast("int").alias("hops"))
    f = _fixed(e).select(F.col("src").alias("root"), F.col("dst").alias("node"), "hops")
    left, right = (x.exceptAll(y).agg(F.count("*").alias(n)) for x, y, n in ((w, f, "only_walks"), (f, w, "only_fixed")))
    return left.crossJoin(F.broadcast(right)).withColumn("same_columns", F.lit(w.columns == f.columns))  # one row each


@query("g8_status_from_links", f"with {EDGES_SQL} select vec_id, case when exists (select 1 from e where kind = 'updates' and dst = vec_id and src <> vec_id) then 'superseded' else 'active' end as status from embeddings")
def status_from_links(spark, d):
    n = table(spark, d, "embeddings").select("vec_id")
    gone = edges(spark, d).where("kind = 'updates' and src <> dst").select(F.col("dst").alias("vec_id"), F.lit("superseded").alias("status")).distinct()
    return n.join(gone, "vec_id", "left").select("vec_id", F.coalesce("status", F.lit("active")).alias("status"))


@query("g9_links_across_owners", f"with {EDGES_SQL} select kind, count(*) as links, count_if(a.label <> b.label) as across from e join embeddings a on a.vec_id = src join embeddings b on b.vec_id = dst group by kind")
def links_across_owners(spark, d):
    return edges_with_nodes(spark, d).groupBy("kind").agg(F.count("*").alias("links"), F.count_if(F.col("src_label") != F.col("dst_label")).alias("across"))


@query("m6_registry_winners", "with m as (select n_regionkey as task, n_name as model, (n_nationkey * 37 % 11) / 10.0 as score, n_nationkey as run from nation), r as (select *, row_number() over (partition by task order by score desc, run desc) as place from m) select task, model, score::double as score from r where place = 1")
def registry_winners(spark, d):
    m = table(spark, d, "nation").select(F.col("n_regionkey").alias("task"), F.col("n_name").alias("model"), ((F.col("n_nationkey") * 37 % 11) / 10.0).alias("score"), F.col("n_nationkey").alias("run"))
    return m.groupBy("task").agg(F.max_by("model", F.struct("score", "run")).alias("model"), F.max("score").alias("score"))


@query("a17_macro_f1", f"with t as (select l_returnflag as c, l_linestatus as s, count_if(l_quantity > 25) as tp, count_if(l_quantity <= 25 and l_tax > 0.04) as fp, count_if(l_quantity <= 25 and l_tax <= 0.04) as fn from lineitem group by 1, 2) select count(*) as n, {MICRO.format('avg(tp / (tp + fp))')} as precision, {MICRO.format('avg(tp / (tp + fn))')} as recall, {MICRO.format('avg(2.0 * tp / (2 * tp + fp + fn))')} as f1 from t".replace(" as precision", ' as "precision"'))
def macro_f1(spark, d):
    small, taxed = F.col("l_quantity") <= 25, F.col("l_tax") > 0.04
    t = table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count_if(~small).alias("tp"), F.count_if(small & taxed).alias("fp"), F.count_if(small & ~taxed).alias("fn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return t.agg(F.count("*").alias("n"), micro(F.avg(tp / (tp + fp))).alias("precision"), micro(F.avg(tp / (tp + fn))).alias("recall"), micro(F.avg(2.0 * tp / (2 * tp + fp + fn))).alias("f1"))


@query("d2_feeds_paired", """with l as (select date_trunc('minute', ts)::timestamp as m, count(*) as n from events where event_type = 'click' group by 1), r as (select date_trunc('minute', ts)::timestamp as m, count(*) as w from events where event_type = 'view' group by 1),
  p as (select l.m, l.n, r.m as rm, r.w, row_number() over (partition by l.m order by r.m) as k from l left join r on r.m >= l.m and r.m <= l.m + interval 6 minute) select m, n, rm as paired, w as waits from p where k = 1""")  # fmt: skip
def feeds_paired(spark, d):
    """Each minute of one feed with the first of the other that comes within six tries, a minute apart; else nulls."""
    e = table(spark, d, "events")
    of = lambda kind, n: e.where(F.col("event_type") == kind).groupBy(F.date_trunc("minute", "ts").alias("m")).agg(F.count("*").alias(n))
    left, right = of("click", "n"), of("view", "w").select(F.col("m").alias("rm"), "w")
    tries = left.select("m", "n", F.explode(F.sequence("m", F.expr("m + interval 6 minutes"), F.expr("interval 1 minute"))).alias("at"))
    met = tries.join(right, F.col("at") == F.col("rm"), "left").groupBy("m", "n").agg(F.min(F.when(F.col("rm").isNotNull(), F.struct("rm", "w"))).alias("first"))
    return met.select("m", "n", F.col("first.rm").alias("paired"), F.col("first.w").alias("waits"))


GRID = [(k, limit) for k in ("click", "error", "purchase", "signup", "view") for limit in (20.0, 40.0, 60.0, 80.0, 95.0)]


@query("d26_tuning_grid", f"""with g(detector, setting) as (values {', '.join(f"('{a}', {b})" for a, b in GRID)}), s as (select detector, setting, count_if(value >= setting and user_id % 7 = 0) / count_if(user_id % 7 = 0) as tpr, count_if(value < setting and user_id % 7 <> 0) / count_if(user_id % 7 <> 0) as tnr from events join g on event_type = detector group by 1, 2),
  r as (select *, row_number() over (partition by detector order by {MICRO.format('(tpr + tnr) / 2')} desc, setting) as place from s) select detector, setting::double as setting, {MICRO.format('(tpr + tnr) / 2')} as balanced from r where place = 1""")  # fmt: skip
def tuning_grid(spark, d):
    """One pass scores all settings of all detectors; the best of each detector stays, ties to the lower."""
    g = F.broadcast(spark.createDataFrame(GRID, "detector string, setting double"))
    e = table(spark, d, "events").join(g, F.col("event_type") == F.col("detector"))
    true, flag = F.col("user_id") % 7 == 0, F.col("value") >= F.col("setting")
    s = e.groupBy("detector", "setting").agg(micro((F.count_if(flag & true) / F.count_if(true) + F.count_if(~flag & ~true) / F.count_if(~true)) / 2).alias("balanced"))
    best = s.groupBy("detector").agg(F.max(F.struct("balanced", (-F.col("setting")).alias("s"))).alias("b"))
    return best.select("detector", (-F.col("b.s")).alias("setting"), F.col("b.balanced").alias("balanced"))


@query("d30_synthetic_series", f"""with i as (select range as t from range(1440)), s as (select t, k, ('0x' || substr(md5(t::varchar || ':' || k::varchar), 1, 8))::bigint / 4294967296.0 as u, sin(2 * pi() * t / 1440.0) as load from i, range(1, 6) r(k))
  select t, k::int as signal, {MICRO.format('(50 + 10 * k * load + 4 * (u - 0.5)) * case when k = 3 and t >= 1150 then 1.3 else 1 end')} as v from s""")  # fmt: skip
def synthetic_series(spark, d):
    """A day of five signals that follow one load, with hashed noise and a drift planted in the third."""
    s = spark.range(1440).select(F.col("id").alias("t"), F.explode(F.sequence(F.lit(1), F.lit(5))).alias("k"))
    u = F.conv(F.substring(F.md5(F.concat_ws(":", F.col("t").cast("string"), F.col("k").cast("string"))), 1, 8), 16, 10).cast("long") / 4294967296.0
    v = (50 + 10 * F.col("k") * F.sin(2 * F.pi() * F.col("t") / 1440.0) + 4 * (u - 0.5)) * F.when((F.col("k") == 3) & (F.col("t") >= 1150), 1.3).otherwise(1.0)
    return s.select("t", F.col("k").alias("signal"), micro(v).alias("v"))


@query("st3_next_batch", """with m as (select date_trunc('minute', ts)::timestamp as m, count(*) as n from events group by 1), last_one as (select timestamp '2024-01-10 00:00:00' as s)
  select m, n, m <= s as context from m, last_one where m > s - interval 120 minute and m <= s + interval 1 day""")  # fmt: skip
def next_batch(spark, d):
    """What an incremental run reads: at most one day after the last scored minute, and the 120 minutes of context before it."""
    last = F.to_timestamp(F.lit("2024-01-10 00:00:00"))
    near = table(spark, d, "events").where((F.col("ts") >= last - F.expr("interval 119 minutes")) & (F.col("ts") < last + F.expr("interval 1 day 1 minute")))
    return near.groupBy(F.date_trunc("minute", "ts").alias("m")).agg(F.count("*").alias("n")).select("m", "n", (F.col("m") <= last).alias("context"))


@query("x26_hybrid", """with b as (select item_id as query_id, unnest(list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\\pL\\pN-]+'), lambda w: w <> ''))) as w from benchmark), c as (select doc_id as chunk_id, unnest(list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\\pL\\pN-]+'), lambda w: w <> ''))) as w from documents),
  k0 as (select query_id, chunk_id, count(*) as score from b join c using (w) group by 1, 2), k as (select query_id, chunk_id, row_number() over (partition by query_id order by score desc, chunk_id) as rank from k0),
  v0 as (select item_id as query_id, e.vec_id as chunk_id, 1 - list_dot_product(q.embedding::double[], e.embedding::double[]) / (sqrt(list_dot_product(q.embedding::double[], q.embedding::double[])) * sqrt(list_dot_product(e.embedding::double[], e.embedding::double[]))) as distance from benchmark join embeddings q on q.vec_id = item_id, embeddings e where e.vec_id <> item_id),
  v as (select query_id, chunk_id, row_number() over (partition by query_id order by distance, chunk_id) as rank from v0), u as (select * from k where rank <= 10 union all select * from v where rank <= 10), f as (select query_id, chunk_id, sum(1 / (rank + 60)) as score from u group by 1, 2)
  select query_id, chunk_id from (select *, row_number() over (partition by query_id order by score desc, chunk_id) as rank from f) where rank <= 5""")  # fmt: skip
def hybrid(spark, d):
    """Keyword and vector lists of each query, fused by reciprocal ranks; a document's vector has its id."""
    b, docs, e = table(spark, d, "benchmark"), table(spark, d, "documents"), table(spark, d, "embeddings")
    k = retrieval.keyword_search(b.select(F.col("item_id").alias("query_id"), "text"), docs.select(F.col("doc_id").alias("chunk_id"), "text"), 10)
    q = b.join(e, F.col("item_id") == F.col("vec_id")).select(F.col("item_id").alias("query_id"), F.col("embedding").alias("qv"))
    v = retrieval.search(q, e.select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("cv")), 11).where("chunk_id <> query_id")
    v = v.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).where("rank <= 10")
    return retrieval.fuse(k, v, 5).select("query_id", "chunk_id")





@query("x16_budgeted_k", "select size, floor(6000.0 / size + 0.5)::int as k from (values (200), (400), (800), (900), (1000), (2500), (4000)) v(size)")
def budgeted_k(spark, d):
    sizes = spark.createDataFrame([(s,) for s in (200, 400, 800, 900, 1000, 2500, 4000)], T.StructType([T.StructField("size", T.IntegerType())]))
    return sizes.select("size", F.floor(F.lit(6000.0) / F.col("size") + 0.5).cast("int").alias("k"))


@query("x35_terms_in_text", "select item_id, contains(' ' || regexp_replace(regexp_replace(lower(text), '[^\\pL\\pN]+', ' ', 'g'), '^ | $', '', 'g') || ' ', ' that ') as has_that from benchmark")
def terms_in_text(spark, d):
    return table(spark, d, "benchmark").select("item_id", text.has_term(F.lit("that"), F.col("text")).alias("has_that"))


SOURCE_SQL = "select c_custkey, c_name, c_acctbal + case when c_custkey % 3 = 0 then 1 else 0 end as c_acctbal from customer where c_custkey % 5 <> 0 union all select c_custkey + 10000000, c_name, c_acctbal from customer where c_custkey % 50 = 0"


def _target_and_source(spark, d):
    t = table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    changed = t.where("c_custkey % 5 <> 0").withColumn("c_acctbal", F.col("c_acctbal") + F.when(F.col("c_custkey") % 3 == 0, 1).otherwise(0))
    return t, changed.unionByName(t.where("c_custkey % 50 = 0").withColumn("c_custkey", F.col("c_custkey") + 10_000_000))


@query("s14_merge_upsert", f"""with s as ({SOURCE_SQL}), j as (select coalesce(s.c_custkey, t.c_custkey) as k, case when t.c_custkey is null then 'insert' when s.c_custkey is not null and (s.c_name, s.c_acctbal) is distinct from (t.c_name, t.c_acctbal) then 'update' else 'keep' end as action, coalesce(s.c_acctbal, t.c_acctbal) as v
  from customer t full join s on s.c_custkey = t.c_custkey) select action, count(*) as "count" from j group by 1""")  # fmt: skip
def merge_upsert(spark, d):
    return upserts.merge(*_target_and_source(spark, d), ["c_custkey"])[1]


@query("s14_merged_rows", f"with s as ({SOURCE_SQL}) select coalesce(s.c_custkey, t.c_custkey) as c_custkey, coalesce(s.c_name, t.c_name) as c_name, coalesce(s.c_acctbal, t.c_acctbal) as c_acctbal from customer t full join s on s.c_custkey = t.c_custkey")
def merged_rows(spark, d):
    return upserts.merge(*_target_and_source(spark, d), ["c_custkey"])[0]


@query("s15_tombstones", f"with s as ({SOURCE_SQL}) select c_custkey, case when c_custkey in (select c_custkey from s) then null else timestamp '2024-01-01' end as gone_ts from customer")
def tombstones(spark, d):
    t, s = _target_and_source(spark, d)
    marked = t.select("c_custkey", F.lit(None).cast("timestamp").alias("gone_ts"))
    return upserts.tombstone(marked, s, ["c_custkey"], F.to_timestamp(F.lit("2024-01-01")))


@query("s16_insert_missing", f"with s as ({SOURCE_SQL}) select c_custkey, c_name, c_acctbal from customer union all select c_custkey, c_name, c_acctbal from s where c_custkey not in (select c_custkey from customer)")
def insert_missing(spark, d):
    return upserts.insert_missing(*_target_and_source(spark, d), ["c_custkey"])


#: Three models score each minute with events of their users: flagged by its largest value, unscored if one signs up.
SCORES_SQL = """s as (select 'M' || (user_id % 3) as model, case user_id % 3 when 0 then 'single' when 1 then 'consecutive' else 'same_signal' end as rule, date_trunc('minute', ts) as ts,
    case when not bool_or(event_type = 'signup') then (max(value) > 45)::int end as flag, max(value) as score, list_sort(list_distinct(list(event_type))) as names from events group by 1, 2, 3),
  b as (select *, flag is not null and flag = 1 as up, row_number() over w as rn, lag(ts) over w as t1, lag(ts, 2) over w as t2, lag(flag) over w as f1, lag(flag, 2) over w as f2, lag(names) over w as n1, lag(names, 2) over w as n2 from s window w as (partition by model order by ts)),
  l as (select *, coalesce(f1 = 1 and ts - t1 <= interval 30 minute, false) as one, coalesce(f2 = 1 and t1 - t2 <= interval 30 minute, false) as two from b),
  r as (select *, case when up then list_transform(names, lambda x: {'signal': x, 'n': case when one and two and list_contains(n1, x) and list_contains(n2, x) then 3 when one and list_contains(n1, x) then 2 else 1 end}) else [] end as runs from l),
  k as (select *, coalesce(list_max(list_transform(runs, lambda x: x.n)), 0) as longest, nullif(array_to_string(list_transform(list_filter(runs, lambda x: x.n >= 3), lambda x: x.signal), ','), '') as fired from r),
  o as (select model, rule, rn, ts, score, up, longest, runs, fired, case when not up then false when rule = 'single' then true when rule = 'consecutive' then one and two else longest >= 3 end as opens from k)"""
FOUND_SQL = f"""recursive {SCORES_SQL},
  m as (select model, rn, case when opens then ts end as start_ts, case when opens then ts end as last_ts, case when opens then score end as peak, case when opens and rule = 'same_signal' then fired end as fired, 0 as u, opens::int as n, false as done, ts from o where rn = 1
    union all select o.model, o.rn, case when h then m.start_ts when opens then o.ts end, case when h and not up then m.last_ts when h or opens then o.ts end, case when h and up then greatest(m.peak, o.score) when h then m.peak when opens then o.score end,
      case when h then m.fired when opens and rule = 'same_signal' then o.fired end, case when h and not up then m.u + 1 else 0 end, m.n + case when not h and opens then 1 else 0 end, h and not up and m.u + 1 >= 10, o.ts
    from (select *, start_ts is not null and not done as h from m) m join o on o.model = m.model and o.rn = m.rn + 1),
  found as (select model, n as episode_no, start_ts, last_ts, case when done then ts end as end_ts, case when done then 'CLOSED' else 'OPEN' end as status, peak, fired from m where done or (start_ts is not null and rn = (select max(rn) from o where o.model = m.model)))"""


def minute_scores(spark, d):
    e, user = table(spark, d, "events"), F.col("user_id") % 3
    rule = F.when(user == 0, episodes.SINGLE).when(user == 1, episodes.CONSECUTIVE).otherwise(episodes.SAME_SIGNAL)
    g = e.groupBy(F.concat(F.lit("M"), user.cast("string")).alias("model"), rule.alias("rule"), F.date_trunc("minute", "ts").alias("ts"))
    flag = F.when(~F.bool_or(F.col("event_type") == "signup"), (F.max("value") > 45).cast("int"))
    return g.agg(flag.alias("flag"), F.max("value").alias("score"), F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("breached"))


@query("d19_signal_runs", f"with {SCORES_SQL} select model, ts, longest::int as longest, fired, opens, array_to_string(list_transform(runs, lambda x: x.signal || ':' || x.n), ',') as runs from o")
def signal_runs(spark, d):
    r = episodes.flagged_runs(minute_scores(spark, d), gap_s=1800, range_s=86400)
    shown = F.array_join(F.transform(F.map_entries("runs"), lambda x: F.concat_ws(":", x["key"], x["value"].cast("string"))), ",")
    return r.select("model", "ts", "longest", "fired", "opens", shown.alias("runs"))


def _found(spark, d):
    return episodes.episodes(minute_scores(spark, d), gap_s=1800, range_s=86400)


@query("d18_episodes", f"with {FOUND_SQL} select model, episode_no, start_ts, last_ts, end_ts, status, {MICRO.format('peak')} as peak, fired from found")
def alert_episodes(spark, d):
    return _found(spark, d).select("model", "episode_no", "start_ts", "last_ts", "end_ts", "status", micro(F.col("peak_score")).alias("peak"), "fired")


EPISODES_SQL = f"""{FOUND_SQL}, i as ({INCIDENTS_SQL}), e as (select model, episode_no, start_ts as opened from found),
  firsts as (select model, incident, start_ts, min(opened) as opened from e join i on opened >= start_ts and opened <= end_ts + interval 10 minute group by 1, 2, 3),
  c as (select model, count(*) as caught, median(m) as med, quantile_cont(m, 0.9) as p90 from (select model, (floor(epoch(opened)) - floor(epoch(start_ts))) / 60 as m from firsts) group by 1),
  f as (select model, count(*) as false_alarms from e where not exists (select 1 from i where opened >= start_ts and opened <= end_ts + interval 30 minute) group by 1),
  g as (select model, (select count(*) from i) as incidents, coalesce(caught, 0) as caught, med, p90, coalesce(false_alarms, 0) as false_alarms from (select distinct model from e) left join c using (model) left join f using (model))"""


def _graded(spark, d):
    return episodes.grade(materialise(_found(spark, d), "episodes-found"), incidents(spark, d), 720.0)


@query("d22_grading", f"with {EPISODES_SQL} select model, incidents, caught, {MICRO.format('med')} as median_ttd, {MICRO.format('p90')} as p90_ttd, false_alarms, {MICRO.format('false_alarms * 24 / 720.0')} as per_24h from g")
def grading(spark, d):
    return _graded(spark, d).select("model", "incidents", "caught", *(micro(F.col(c)).alias(c) for c in ("median_ttd", "p90_ttd")), "false_alarms", micro(F.col("per_24h")).alias("per_24h"))


@query("d25_best_rival", f"with {EPISODES_SQL} select model, caught, false_alarms from g where model <> 'M0' order by caught desc, false_alarms, med nulls last, model limit 1")
def best_rival(spark, d):
    return episodes.best_rival(_graded(spark, d), "M0").select("model", "caught", "false_alarms")


@query("d23_attribution", f"""with x as (select distinct l_orderkey, l_linenumber from lineitem where l_tax > 0.06), r as (select l_orderkey as incident, l_linenumber as signal, rank() over (partition by l_orderkey order by l_quantity desc) as r from lineitem),
  k as (select r.*, max(r) over (partition by incident) as edge, x.l_orderkey is not null as want from (select * from r where r <= 3) r left join x on x.l_orderkey = incident and x.l_linenumber = signal),
  g as (select incident, count_if(r < edge) as above, count_if(r = edge) as t, count_if(r < edge and want) as sure, count_if(r = edge and want) as m, 3 - count_if(r < edge) as p from k group by 1)
  select incident, sure + m > 0 as hit, {MICRO.format('case when sure > 0 then 1 when m = 0 or p <= 0 then 0 when p >= t then 1 else 1 - greatest(t - m, 0) / t * case when p > 1 then greatest(t - m - 1, 0) / (t - 1) else 1 end * case when p > 2 then greatest(t - m - 2, 0) / (t - 2) else 1 end end')} as chance from g""")  # fmt: skip
def attribution(spark, d):
    li = table(spark, d, "lineitem")
    details = li.select(F.col("l_orderkey").alias("incident"), F.col("l_linenumber").alias("signal"), F.col("l_quantity").alias("weight"))
    expected = li.where("l_tax > 0.06").select(F.col("l_orderkey").alias("incident"), F.col("l_linenumber").alias("signal")).distinct()
    return episodes.attribution(details, expected).select("incident", "hit", micro(F.col("chance")).alias("chance"))


SLOTS = [("greeting", [["that", "of"], ["the"]]), ("number", [["127", "24", "2024"]]), ("both", [["inha", "wherer", "thion"], ["and"]])]


def _slot_sql(groups) -> str:
    return " and ".join(f"regexp_matches(lower(text), '(^|[^\\w.])({'|'.join(g)})($|\\W)')" for g in groups)


@query("g6_slots_of_texts", f"""with p as ({' union all '.join(f"select doc_id, '{s}' as slot from documents where {_slot_sql(g)}" for s, g in SLOTS)}), f as (select doc_id, count(*) as n, min(slot) as one from p group by 1)
  select doc_id as memory_id, case when n = 1 then one end as slot, case when n is null then 'unmatched' when n = 1 then 'matched' else 'ambiguous' end as status from documents left join f using (doc_id)""")  # fmt: skip
def slots_of_texts(spark, d):
    slots = spark.createDataFrame(SLOTS, "slot string, groups array<array<string>>")
    return graph.match_slots(table(spark, d, "documents").select(F.col("doc_id").alias("memory_id"), "text"), slots)


@query("g7_link_scores", f"""with {EDGES_SQL}, p as (select src % 20 as thread, src * 2 + (kind = 'relates')::int as seq, src % 7 as source, dst % 7 as target, case when src % 11 = 0 then 'invalidates' else kind end as kind from e),
  gold as (select distinct src % 20 as thread, src % 7 as source, dst % 7 as target, kind from e where dst % 3 = 0), bad as (select distinct src % 20 as thread, src % 5 as lo, 5 + src % 2 as hi from e),
  n as (select p.*, row_number() over (partition by p.thread, p.source, p.target, p.kind order by seq) as nth, gold.thread is not null as good, least(p.source, p.target) as lo, greatest(p.source, p.target) as hi from p left join gold using (thread, source, target, kind)),
  q as (select n.*, exists (select 1 from gold g where g.thread = n.thread and least(g.source, g.target) = lo and greatest(g.source, g.target) = hi) as pair, exists (select 1 from bad b where b.thread = n.thread and b.lo = n.lo and b.hi = n.hi) as wrong from n),
  s as (select thread, count_if(good and nth = 1) as tp, count_if(not (good and nth = 1)) as fp, count_if(not good and kind = 'invalidates') as harmful, count_if(wrong) as distractor, count_if(pair) as pair_hits from q group by 1), w as (select thread, count(*) as want from gold group by 1)
  select thread, coalesce(tp, 0) as tp, coalesce(fp, 0) as fp, coalesce(want, 0) - coalesce(tp, 0) as fn, coalesce(harmful, 0) as harmful, coalesce(distractor, 0) as distractor, coalesce(pair_hits, 0) as pair_hits from w full join s using (thread)""")  # fmt: skip
def link_scores(spark, d):
    e = edges(spark, d)
    thread, source, target = (F.col("src") % 20).alias("thread"), (F.col("src") % 7).alias("source"), (F.col("dst") % 7).alias("target")
    seq = (F.col("src") * 2 + (F.col("kind") == "relates").cast("int")).alias("seq")
    p = e.select(thread, seq, source, target, F.when(F.col("src") % 11 == 0, "invalidates").otherwise(F.col("kind")).alias("kind"))
    gold = e.where("dst % 3 = 0").select(thread, source, target, "kind").distinct()
    bad = e.select(thread, (F.col("src") % 5).alias("a"), (5 + F.col("src") % 2).alias("b"))
    return graph.score_links(p, gold, bad)
