"""Retrieval, text, graph, JSON and statistics over the provided tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestar.functions import stats, text
from lodestar.operators import graph, ledger, metrics, ml, retrieval, series
from lodestar.plans.tables import MICRO, micro, table, views
from lodestar.registry import query

EMB = "select vec_id, embedding, label from embeddings"
TOPK_SQL = """with q as (select vec_id as query_id, label as ql, embedding as qv from embeddings where vec_id % 20 = 0),
  p as (select query_id, ql, vec_id as chunk_id, label, 1 - list_dot_product(qv::double[], embedding::double[]) / (sqrt(list_dot_product(qv::double[], qv::double[])) * sqrt(list_dot_product(embedding::double[], embedding::double[]))) as distance from q, embeddings where vec_id <> query_id),
  r as (select *, row_number() over (partition by query_id order by distance, chunk_id) as rank from p), hits as (select *, label = ql as relevant from r where rank <= 12)"""


def top_hits(spark, d, k=12):
    """Each query's nearest other vectors; queries are a stated set, relevance is an equal label."""
    e = table(spark, d, "embeddings")
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qv"))
    near = retrieval.search(q, e.select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("cv")), k + 1).where("chunk_id <> query_id")
    w = Window.partitionBy("query_id").orderBy("rank")
    near = near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    label = e.select("vec_id", "label")
    a, b = label.select(F.col("vec_id").alias("query_id"), F.col("label").alias("ql")), label.select(F.col("vec_id").alias("chunk_id"), "label")
    return near.join(a, "query_id").join(b, "chunk_id").withColumn("relevant", F.col("label") == F.col("ql"))


@query("x1_vector_topk", TOPK_SQL + " select query_id, rank, chunk_id, relevant from hits")
def vector_topk(spark, d):
    return top_hits(spark, d).select("query_id", F.col("rank").cast("long").alias("rank"), "chunk_id", "relevant")


@query("x2_vector_filtered", f"""with q as (select embedding as qv from embeddings where vec_id = 0), p as (select vec_id, label, 1 - list_dot_product(qv::double[], embedding::double[]) / (sqrt(list_dot_product(qv::double[], qv::double[])) * sqrt(list_dot_product(embedding::double[], embedding::double[]))) as dist from q, embeddings where label in (1, 2, 3))
  select vec_id, label, {MICRO.format('1 - dist')} as similarity from p order by dist, vec_id limit 20""")  # fmt: skip
def vector_filtered(spark, d):
    e = table(spark, d, "embeddings")
    q = e.where("vec_id = 0").select(F.col("embedding").alias("qv"))  # one row
    p = e.where(F.col("label").isin(1, 2, 3)).crossJoin(F.broadcast(q)).withColumn("dist", retrieval.cosine_distance(F.col("qv"), F.col("embedding")))
    return p.orderBy("dist", "vec_id").limit(20).select("vec_id", "label", micro(1 - F.col("dist")).alias("similarity"))


@query("t4_approximate_topk")
def approximate_topk(spark, d):
    e = table(spark, d, "embeddings")
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qv"))
    return retrieval.approximate_search(q, e.select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("cv")), 10)


@query("x3_chunks_per_source", "select source, count(*) as chunks, sum(n_chars)::bigint as chars from documents group by source")
def chunks_per_source(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("chunks"), F.sum("n_chars").alias("chars"))


@query("x4_hit_annotation", TOPK_SQL + " select query_id, rank, chunk_id, sha256(concat_ws(':', query_id, chunk_id)) as sha, case when relevant then 'gold' else 'other' end as evidence from hits where rank <= 3")
def hit_annotation(spark, d):
    h = top_hits(spark, d).where("rank <= 3")
    return h.select("query_id", F.col("rank").cast("long").alias("rank"), "chunk_id", F.sha2(F.concat_ws(":", F.col("query_id").cast("string"), F.col("chunk_id").cast("string")), 256).alias("sha"), F.when(F.col("relevant"), "gold").otherwise("other").alias("evidence"))


@query("x5_x6_hit_and_mrr", TOPK_SQL + f", f as (select query_id, min(case when relevant then rank end) as first from hits group by 1) select count(*) as n, {MICRO.format('avg((coalesce(first, 99) <= 1)::int)')} as hit_1, {MICRO.format('avg((coalesce(first, 99) <= 5)::int)')} as hit_5, {MICRO.format('avg(coalesce(1.0 / first, 0))')} as mrr from f")
def hit_and_mrr(spark, d):
    m = metrics.hit_and_mrr(top_hits(spark, d).select("query_id", "rank", "relevant"), (1, 5, 12))
    return m.select("n", *(micro(F.col(c)).alias(c) for c in ("hit_1", "hit_5", "mrr")))


@query("x7_retrieval_summary", TOPK_SQL + f""", f as (select query_id, ql::varchar as label, min(case when relevant then rank end) as first from hits group by 1, 2), g as (select label, count(*) as n, count(case when first <= 5 then 1 end) as hits from f group by grouping sets ((label), ())),
  w as (select coalesce(label, 'ALL') as label, n, hits, hits / n as p, 1.959963984540054 as z from g) select label, n, hits, {MICRO.format('p')} as rate, {MICRO.format('(p + z*z/(2*n) - z * sqrt(p*(1-p)/n + z*z/(4*n*n))) / (1 + z*z/n)')} as low, {MICRO.format('(p + z*z/(2*n) + z * sqrt(p*(1-p)/n + z*z/(4*n*n))) / (1 + z*z/n)')} as high from w""")  # fmt: skip
def retrieval_summary(spark, d):
    f = top_hits(spark, d).groupBy("query_id", F.col("ql").alias("label")).agg(F.min(F.when(F.col("relevant"), F.col("rank"))).alias("first"))
    return retrieval.summary(f, ["label"], 5).select("label", "n", "hits", *(micro(F.col(c)).alias(c) for c in ("rate", "low", "high")))


@query("x8_containability", "select item_id, count(distinct doc_id) as docs from benchmark b join documents d on contains(d.text, b.text) group by item_id")
def containability(spark, d):
    b, docs = table(spark, d, "benchmark"), table(spark, d, "documents")
    # anchored by the passage's first words, so that no pair of all passages and documents is made
    first = lambda c: F.array_join(F.slice(F.split(c, r"\s+"), 1, 4), " ")
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    grams = docs.select("doc_id", words.alias("w"))
    grams = grams.select("doc_id", F.explode(F.when(F.size("w") > 3, F.sequence(F.lit(0), F.size("w") - 4))).alias("i"), "w")
    grams = grams.select("doc_id", F.concat_ws(" ", *[F.get("w", F.col("i") + k) for k in range(1, 4)]).alias("g"))
    p = b.select("item_id", F.col("text").alias("passage"), F.array_join(F.slice(F.split("text", r"\s+"), 2, 3), " ").alias("pg"))
    # the item's own first word may be glued to the word before it, so the anchor starts at its second
    met = grams.join(F.broadcast(p) if p.count() < 10_000 else p, F.col("g") == F.col("pg")).select("doc_id", "item_id", "passage").distinct()
    # texts are fetched for what met an anchor only
    return met.join(docs.select("doc_id", "text"), "doc_id").where(F.contains("text", "passage")).groupBy("item_id").agg(F.countDistinct("doc_id").alias("docs"))


@query("x11_threshold_calibration", TOPK_SQL + f""", s as (select distance, count_if(relevant) as p, count_if(not relevant) as n from hits group by 1), c as (select distance, sum(p) over w as tp, sum(n) over w as fp, sum(p) over () as pp, sum(n) over () as nn from s window w as (order by distance)),
  a as (select 1 - distance as score, (tp / pp + (nn - fp) / nn) / 2 as acc from c) select {MICRO.format('score')} as threshold, {MICRO.format('acc')} as balanced_accuracy from a order by acc desc, score limit 1""")  # fmt: skip
def threshold_calibration(spark, d):
    c = retrieval.calibrate(top_hits(spark, d).select((1 - F.col("distance")).alias("score"), "relevant"))
    return c.select(micro(F.col("threshold")).alias("threshold"), micro(F.col("balanced_accuracy")).alias("balanced_accuracy"))


@query("x12_smallest_k", TOPK_SQL + ", f as (select query_id, min(case when relevant then rank end) as first from hits group by 1), rk as (select k, avg((coalesce(first, 99) <= k)::int) as rate from f, (values (1), (2), (3), (5), (8), (12)) v(k) group by k) select min(k)::int as k from rk where rate >= (select rate from rk where k = 12) - 0.02")
def smallest_k(spark, d):
    f = top_hits(spark, d).groupBy("query_id").agg(F.min(F.when(F.col("relevant"), F.col("rank"))).alias("first"))
    ks = (1, 2, 3, 5, 8, 12)
    r = f.agg(*[F.avg((F.coalesce("first", F.lit(99)) <= k).cast("double")).alias(str(k)) for k in ks]).unpivot([], [str(k) for k in ks], "k", "rate")
    return retrieval.smallest_k(r.select(F.col("k").cast("int").alias("k"), "rate"))


@query("x17_normalised_text")
def normalised_text(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(text.normalise("text"), 256).alias("sha"))


@query("x18_span_key", r"select item_id, lower(regexp_replace(regexp_replace(text, '([^0-9])\.|\.$', '\1', 'g'), '[^\pL\pN.]', '', 'g')) as key from benchmark")
def span_key(spark, d):
    return table(spark, d, "benchmark").select("item_id", text.span_key(F.col("text")).alias("key"))


@query("x21_overlap_and_run")
def overlap_and_run(spark, d):
    c = table(spark, d, "conversations")
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    p = c.withColumn("a", before).where("a is not null and text is not null")
    tokens = lambda x: F.split(F.lower(x), r"\s+")
    return p.select("conv_id", "turn", micro(text.overlap_ratio(F.col("a"), F.col("text"))).alias("overlap"), text.longest_common_run(tokens(F.col("a")), tokens(F.col("text"))).alias("run"))


@query("x23_coverage_by_language", "select lang, count(*) as n, median(n_chars) as med, quantile_disc(n_chars, 0.9)::bigint as p90 from documents group by lang")
def coverage_by_language(spark, d):
    return table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.median("n_chars").alias("med"), F.expr("percentile_disc(0.9) within group (order by n_chars)").cast("long").alias("p90"))


@query("x24_character_classes", r"select doc_id, len(regexp_extract_all(text, '[0-9]'))::bigint as digits, len(regexp_extract_all(text, '[A-Z]'))::bigint as capitals, len(regexp_extract_all(text, '[^\x00-\x7F]'))::bigint as other from documents")
def character_classes(spark, d):
    n = lambda p: F.regexp_count("text", F.lit(p)).cast("long")
    return table(spark, d, "documents").select("doc_id", n("[0-9]").alias("digits"), n("[A-Z]").alias("capitals"), n(r"[^\x00-\x7F]").alias("other"))


@query("x25_chunks", """with c as (select doc_id, text, unnest(range(0, greatest(1, ceil((length(text) - 100) / 400.0))::bigint)) as n from documents where length(text) > 0)
  select doc_id, n, length(substr(text, n * 400 + 1, 500)) as size, sha256(substr(text, n * 400 + 1, 500)) as sha from c""")  # fmt: skip
def chunked(spark, d):
    c = table(spark, d, "documents").select("doc_id", F.explode(text.chunks(F.col("text"), 500, 100)).alias("c"))
    return c.select("doc_id", F.col("c.n").cast("long").alias("n"), F.length("c.chunk").cast("long").alias("size"), F.sha2("c.chunk", 256).alias("sha"))


@query("x26_keyword", r"""with b as (select item_id as query_id, unnest(list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\pL\pN-]+'), lambda w: w <> ''))) as w from benchmark), c as (select doc_id as chunk_id, unnest(list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\pL\pN-]+'), lambda w: w <> ''))) as w from documents),
  k as (select query_id, chunk_id, count(*) as score from b join c using (w) group by 1, 2) select * from (select query_id, chunk_id, score, row_number() over (partition by query_id order by score desc, chunk_id)::int as rank from k) where rank <= 10""")  # fmt: skip
def keyword(spark, d):
    b, docs = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text"), table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    return retrieval.keyword_search(b, docs, 10)


@query("x28_token_estimate", "select conv_id, sum(greatest(1, round_even(length(text) / 3.5, 0)))::bigint as tokens from conversations group by conv_id")
def estimated_tokens(spark, d):
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.sum(text.token_estimate(F.col("text"))).cast("long").alias("tokens"))


@query("x29_recall_precision", TOPK_SQL + f" select query_id, {MICRO.format('len(list_intersect(list(chunk_id) filter (where rank <= 5), list(chunk_id) filter (where relevant))) / 5.0')} as precision_5 from hits group by query_id")
def recall_precision(spark, d):
    h = top_hits(spark, d).groupBy("query_id").agg(F.collect_list(F.when(F.col("rank") <= 5, F.col("chunk_id"))).alias("a"), F.collect_list(F.when(F.col("relevant"), F.col("chunk_id"))).alias("b"))  # 12 hits a query
    return h.select("query_id", micro(F.size(F.array_intersect("a", "b")) / 5.0).alias("precision_5"))


def _chain(column: str, rules) -> str:
    """DuckDB SQL that applies (pattern, replacement) rules in order."""
    for pattern, put in rules:
        column = "regexp_replace({}, '{}', '{}', 'g')".format(column, pattern.replace("'", "''"), put.replace("'", "''"))
    return column


@query("x33_redaction", "select doc_id, sha256(" + _chain("text", [(p, kept + f"[{k}]") for k, (p, kept) in text.HIDDEN.items()]) + ") as sha from documents")
def redaction(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(text.redact(F.col("text")), 256).alias("sha"))


@query("x35_dates_units", "select doc_id, sha256(" + _chain("lower(text)", text.rewrites()) + ") as sha from documents")
def dates_units(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(text.dates_units(F.col("text")), 256).alias("sha"))


@query("x34_failure_void", "select user_id, count_if(event_type = 'error') / count(*) > 0.2 as void from events group by user_id")
def failure_void(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg((F.count_if(F.col("event_type") == "error") / F.count("*") > 0.2).alias("void"))


@query("x38_resumable_schedule", """with q as (select item_id, row_number() over (partition by run order by sha256(run::varchar || ':' || item_id::varchar)) as pos, run from benchmark, (values (1), (2), (3)) r(run)), c as (select * from q, (values (0), (1), (2)) k(config))
  select run, item_id, pos, config, ((pos + config) % 3)::bigint as turn from c where not (run = 1 and item_id < 10)""")  # fmt: skip
def resumable_schedule(spark, d):
    runs, configs = spark.createDataFrame([(1,), (2,), (3,)], "run int"), spark.createDataFrame([(0,), (1,), (2,)], "config int")
    q = table(spark, d, "benchmark").select("item_id").crossJoin(F.broadcast(runs))
    q = q.withColumn("pos", F.row_number().over(Window.partitionBy("run").orderBy(F.sha2(F.concat_ws(":", F.col("run").cast("string"), F.col("item_id").cast("string")), 256))))
    c = q.crossJoin(F.broadcast(configs)).withColumn("turn", ((F.col("pos") + F.col("config")) % 3).cast("long"))
    done = table(spark, d, "benchmark").where("item_id < 10").select("item_id", F.lit(1).alias("run"))
    return c.join(done, ["run", "item_id"], "left_anti").select("run", "item_id", F.col("pos").cast("long").alias("pos"), "config", "turn")


def _seen(html: str) -> str:
    shown = _chain(html, [(p, " ") for p in text.UNSEEN])
    for entity, char in text.ENTITIES:
        shown = "replace({}, '{}', '{}')".format(shown, entity, char.replace("'", "''"))
    return f"trim(regexp_replace({shown}, '[ \\t\\r\\n\\f]+', ' ', 'g'), ' ')"


@query("html_to_text", f"select page_id, sha256({_seen('html')}) as sha, length({_seen('html')})::int as n from pages")
def html_to_text(spark, d):
    return table(spark, d, "pages").select("page_id", F.sha2(text.visible_text(F.col("html")), 256).alias("sha"), F.length(text.visible_text(F.col("html"))).alias("n"))


EDGES_SQL = "e as (select vec_id as src, (vec_id * 7 + 3) % n as dst, case when vec_id % 3 = 0 then 'supports' else 'updates' end as kind from embeddings, (select count(*) as n from embeddings) union all select vec_id, (vec_id * 3 + 1) % n, 'relates' from embeddings, (select count(*) as n from embeddings) where vec_id % 2 = 0)"


def edges(spark, d):
    e = table(spark, d, "embeddings").select("vec_id")
    n = e.agg(F.count("*").alias("n"))
    v = e.crossJoin(F.broadcast(n))
    a = v.select(F.col("vec_id").alias("src"), ((F.col("vec_id") * 7 + 3) % F.col("n")).alias("dst"), F.when(F.col("vec_id") % 3 == 0, "supports").otherwise("updates").alias("kind"))
    return a.unionByName(v.where("vec_id % 2 = 0").select(F.col("vec_id").alias("src"), ((F.col("vec_id") * 3 + 1) % F.col("n")).alias("dst"), F.lit("relates").alias("kind")))


@query("g1_nodes_with_degree", f"with {EDGES_SQL} select vec_id as id, (select count(*) from (select src as x from e union all select dst from e) where x = vec_id) as degree from embeddings")
def nodes_with_degree(spark, d):
    return graph.with_isolated(table(spark, d, "embeddings").select(F.col("vec_id").alias("id")), edges(spark, d))


@query("g3_walks", f"""with recursive {EDGES_SQL}, w as (select vec_id as root, vec_id as node, 0 as hops, '' as types, vec_id::varchar as path from embeddings union all
  select root, dst, hops + 1, case when types = '' then kind else types || '>' || kind end, path || '>' || dst from w join e on node = src where hops < 3) select root, node, hops, types, path from w where hops > 0""")  # fmt: skip
def walks(spark, d):
    return graph.walks(edges(spark, d), table(spark, d, "embeddings").select(F.col("vec_id").alias("root")), 3)


@query("g13_json_path_status", "select event_id, (props::json ->> '$.k')::int as k, coalesce(props::json ->> '$.missing', '(none)') as missing from events")
def json_path_status(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"), F.coalesce(F.get_json_object("props", "$.missing"), F.lit("(none)")).alias("missing"))


@query("s7_c1_json_relations", "select k, count(*) as n, count(distinct event_type) as types from (select (props::json ->> '$.k')::int as k, event_type from events) group by k")
def json_relations(spark, d):
    e = table(spark, d, "events").select(F.from_json("props", "k int").alias("p"), "event_type")
    return e.groupBy("p.k").agg(F.count("*").alias("n"), F.countDistinct("event_type").alias("types"))


@query("c2_catalogue", """with t as (select event_type as model, max(ts) as last_seen, count(distinct (props::json ->> '$.k')) as params from events group by 1), x as (select max(ts) as now from events)
  select model, params, last_seen, last_seen > now - interval 30 day as active, model = 'error' as restricted from t, x""")  # fmt: skip
def catalogue(spark, d):
    e = table(spark, d, "events")
    t = e.groupBy(F.col("event_type").alias("model")).agg(F.max("ts").alias("last_seen"), F.countDistinct(F.get_json_object("props", "$.k")).alias("params"))
    now = t.agg(F.max("last_seen").alias("now"))
    return t.crossJoin(F.broadcast(now)).select("model", "params", "last_seen", (F.col("last_seen") > F.expr("now - interval 30 days")).alias("active"), (F.col("model") == "error").alias("restricted"))


@query("c5_eligibility", "select p_partkey, case when not p_size > 5 then 'size' when not p_retailprice < 1500 then 'price' when not p_brand like '%1%' then 'brand' end as reason from part")
def eligibility(spark, d):
    return ledger.eligible(table(spark, d, "part"), [("size", "p_size > 5"), ("price", "p_retailprice < 1500"), ("brand", "p_brand like '%1%'")]).select("p_partkey", "reason")


@query("c4_reconciliation", "select side, count(*) as n from (select 'only_documents' as side from documents d anti join labels l using (doc_id) union all select 'only_labels' from labels l anti join documents d using (doc_id) union all select 'filter_broken' from labels where quality not in (0, 1)) group by side")
def reconciliation(spark, d):
    docs, lab = table(spark, d, "documents").select("doc_id"), table(spark, d, "labels")
    a = docs.join(lab, "doc_id", "left_anti").select(F.lit("only_documents").alias("side"))
    b = lab.join(docs, "doc_id", "left_anti").select(F.lit("only_labels").alias("side"))
    return a.union(b).union(lab.where(~F.col("quality").isin(0, 1)).select(F.lit("filter_broken").alias("side"))).groupBy("side").agg(F.count("*").alias("n"))


@query("c6_budget_ledger", f"""with recursive o as (select o_custkey::varchar as allotment, o_orderkey, cast(o_totalprice as decimal(28,4)) as amount, row_number() over (partition by o_custkey order by o_orderkey) as n from orders),
  b as (select allotment, cast(sum(amount) * 0.7 as decimal(28,4)) as budget from o group by 1),
  l as (select allotment, o_orderkey, n, amount <= budget as ok, cast(0 as decimal(28,4)) as before, cast(case when amount <= budget then amount else 0 end as decimal(28,4)) as spent, amount from o join b using (allotment) where n = 1
    union all select o.allotment, o.o_orderkey, o.n, l.spent + o.amount <= budget, l.spent, cast(l.spent + case when l.spent + o.amount <= budget then o.amount else 0 end as decimal(28,4)), o.amount from l join o on o.allotment = l.allotment and o.n = l.n + 1 join b on b.allotment = o.allotment)
  select allotment, 2 * o_orderkey as seq, o_orderkey::varchar as claim, 'claim' as action, case when ok then 'granted' else 'refused' end as outcome, {MICRO.format('case when ok then amount::double else 0 end')} as held, {MICRO.format('before::double')} as spent from l
  union all select allotment, 2 * o_orderkey + 1, o_orderkey::varchar, 'settle', case when ok then 'settled' else 'unknown' end, 0, {MICRO.format('spent::double')} from l""")  # fmt: skip
def budget_ledger(spark, d):
    o = table(spark, d, "orders")
    e = o.select(F.col("o_custkey").cast("string").alias("allotment"), F.col("o_orderkey").cast("string").alias("claim"), (2 * F.col("o_orderkey")).alias("seq"), F.col("o_totalprice").alias("amount"))
    both = e.withColumn("action", F.lit("claim")).unionByName(e.withColumn("action", F.lit("settle")).withColumn("seq", F.col("seq") + 1))
    budgets = e.groupBy("allotment").agg((F.sum(F.col("amount").cast("decimal(28,4)")) * F.lit("0.7").cast("decimal(1,1)")).alias("budget"))
    r = ledger.run_ledger(both, budgets)
    return r.withColumn("held", micro(F.col("held"))).withColumn("spent", micro(F.col("spent")))


@query("d24_mcnemar", """with t as (select c_custkey % 10 as b, c_nationkey % 8 as c, count(*) as n from customer group by 1, 2), i as (select *, unnest(range(0, least(b, c) + 1)) as i from t)
  select b, c, """ + MICRO.format("least(1.0, 2 * sum(factorial(b::int + c::int)::double / (factorial(i::int)::double * factorial((b + c - i)::int)::double) / power(2, b + c)))") + " as p from i group by b, c")  # fmt: skip
def mcnemar(spark, d):
    t = table(spark, d, "customer").select((F.col("c_custkey") % 10).alias("b"), (F.col("c_nationkey") % 8).alias("c")).distinct()
    return t.select("b", "c", micro(stats.mcnemar_p(F.col("b"), F.col("c"))).alias("p"))


@query("g12_holm", """with t as (select n_regionkey as fam, n_nationkey as id, (n_nationkey + 1) / 100.0 as p from nation), r as (select *, row_number() over (partition by fam order by p) as k, count(*) over (partition by fam) as m from t)
  select fam, id, """ + MICRO.format("max(least(1.0, (m - k + 1) * p)) over (partition by fam order by p)") + " as p_holm from r")  # fmt: skip
def holm(spark, d):
    t = table(spark, d, "nation").select(F.col("n_regionkey").alias("fam"), F.col("n_nationkey").alias("id"), ((F.col("n_nationkey") + 1) / 100.0).alias("p"))
    return stats.holm_adjusted(t, "p", ["fam"]).select("fam", "id", micro(F.col("p_holm")).alias("p_holm"))


@query("a17_micro_f1", f"with t as (select n_regionkey as thread, count_if(n_nationkey % 3 = 0) as tp, count_if(n_nationkey % 3 = 1) as fp, count_if(n_nationkey % 3 = 2) as fn from nation group by 1) select sum(tp)::bigint as tp, sum(fp)::bigint as fp, sum(fn)::bigint as fn, {MICRO.format('2.0 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn))')} as f1 from t")
def micro_f1(spark, d):
    k = F.col("n_nationkey") % 3
    t = table(spark, d, "nation").groupBy("n_regionkey").agg(F.count_if(k == 0).alias("tp"), F.count_if(k == 1).alias("fp"), F.count_if(k == 2).alias("fn"))
    return metrics.micro_f1(t).select("tp", "fp", "fn", micro(F.col("f1")).alias("f1"))


@query("a20_a22_majority_stability", "with r as (select l_partkey as q, l_linenumber as run, l_quantity > 25 as ok from lineitem) select q, count(*) >= 2 and count_if(ok) > count(*) / 2.0 as majority, count(distinct ok) = 1 as stable from r group by q")
def majority_stability(spark, d):
    r = table(spark, d, "lineitem").select(F.col("l_partkey").alias("q"), (F.col("l_quantity") > 25).alias("ok"))
    return r.groupBy("q").agg(((F.count("*") >= 2) & (F.count_if("ok") > F.count("*") / 2)).alias("majority"), (F.countDistinct("ok") == 1).alias("stable"))


@query("a18_a21_attribution_grid", "select l_shipdate is not null as retrieved, l_returnflag = 'A' as correct, count(*) as n, min(l_quantity) as low, max(l_quantity) as high from lineitem group by 1, 2")
def attribution_grid(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_shipdate").isNotNull().alias("retrieved"), (F.col("l_returnflag") == "A").alias("correct")).agg(F.count("*").alias("n"), F.min("l_quantity").alias("low"), F.max("l_quantity").alias("high"))


@query("m4_smoothing", f"""with recursive h as (select date_trunc('hour', ts) as t, count_if(event_type = 'click')::double as click, count_if(event_type = 'view')::double as "view", cast(sum(cast(value as decimal(18,4))) as double) as total from events group by 1),
  s as (select *, row_number() over (partition by series order by t) as i, lead(y) over (partition by series order by t) as next from h unpivot (y for series in (click, "view", total))),
  r as (select series, i, y as level, coalesce(next - y, 0.0) as trend from s where i = 1
    union all select s.series, s.i, 0.3 * y + 0.7 * (level + trend), 0.1 * (0.3 * y + 0.7 * (level + trend) - level) + 0.9 * trend from r join s on s.series = r.series and s.i = r.i + 1)
  select series, i as n, {MICRO.format('level')} as level, {MICRO.format('trend')} as trend, {MICRO.format('level + trend')} as forecast from r where i = (select max(i) from s where s.series = r.series)""")  # fmt: skip
def smoothing(spark, d):
    h = series.signals(table(spark, d, "events"))
    r = ml.smooth(series.long_form(h, "ts", ["click", "view", "total"]).select(F.col("signal").alias("series"), F.col("ts").alias("t"), F.col("val").alias("y")), "series")
    return r.select("series", "n", *(micro(F.col(c)).alias(c) for c in ("level", "trend", "forecast")))


@query("m5_rules")
def rules(spark, d):
    b = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set((F.col("l_partkey") % 20).cast("string")).alias("items"))
    return ml.recommend(b.withColumnRenamed("l_orderkey", "owner"), ml.rules(b, 0.02, 0.1), "owner")


@query("m1_classification")
def classification(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_acctbal", "c_nationkey", (F.col("c_acctbal") > 5000).cast("int").alias("rich"))
    return ml.classify(c, ["c_acctbal", "c_nationkey"], "rich", "c_custkey")


@query("m2_clustering")
def clustering(spark, d):
    return ml.cluster(table(spark, d, "part"), ["p_size", "p_retailprice"])


@query("s3_s6_generators", """select 'seq' as kind, g::varchar as item, g as pos from range(1, 8) t(g) union all select 'split', unnest(string_split('CPU,PIO,REDO', ',')), unnest(range(0, 3)) union all select 'list', unnest(['a', 'b']), unnest(range(0, 2)) union all select * from (values ('const', 'x', 1::bigint), ('const', 'y', 2)) v""")
def generators(spark, d):
    seq = spark.range(1, 8).select(F.lit("seq").alias("kind"), F.col("id").cast("string").alias("item"), F.col("id").alias("pos"))
    one = spark.range(1)
    split = one.select(F.lit("split").alias("kind"), F.posexplode(F.split(F.lit("CPU,PIO,REDO"), ",")).alias("pos", "item"))
    listed = one.select(F.lit("list").alias("kind"), F.posexplode(F.array(F.lit("a"), F.lit("b"))).alias("pos", "item"))
    const = spark.createDataFrame([("const", "x", 1), ("const", "y", 2)], "kind string, item string, pos long")
    return seq.unionByName(split).unionByName(listed).unionByName(const)


@query("scalar_functions", r"""select o_orderkey, substr(o_orderpriority, 3) as tail, instr(o_orderpriority, '-') as at, regexp_extract(o_orderpriority, '([0-9])-([A-Z]+)', 2) as word, regexp_replace(o_orderpriority, '[0-9]', '#') as masked, lpad(o_orderkey::varchar, 8, '0') as padded, translate(o_orderstatus, 'FOP', 'fop') as tr,
  concat_ws('', o_orderstatus, null, '!') as joined, date_trunc('month', o_orderdate) as month, strftime(o_orderdate, '%H:%M:%S') as hms, hour(o_orderdate) as h, abs(o_custkey - 50) as dist, ((o_custkey - 50) % 7 + 7) % 7 as pm, power(2, o_orderkey % 5)::bigint as pw, try_cast(o_orderpriority as int) as bad, greatest(o_custkey, 100) as g from orders""")  # fmt: skip
def scalar_functions(spark, d):
    p = F.col("o_orderpriority")
    return table(spark, d, "orders").select(
        "o_orderkey", F.substring(p, 3, 100).alias("tail"), F.instr(p, "-").cast("long").alias("at"), F.regexp_extract(p, "([0-9])-([A-Z]+)", 2).alias("word"), F.regexp_replace(p, "[0-9]", "#").alias("masked"),
        F.lpad(F.col("o_orderkey").cast("string"), 8, "0").alias("padded"), F.translate("o_orderstatus", "FOP", "fop").alias("tr"), F.concat_ws("", "o_orderstatus", F.lit(None).cast("string"), F.lit("!")).alias("joined"),
        F.date_trunc("month", "o_orderdate").alias("month"), F.date_format("o_orderdate", "HH:mm:ss").alias("hms"), F.hour("o_orderdate").cast("long").alias("h"), F.abs(F.col("o_custkey") - 50).alias("dist"),
        F.pmod(F.col("o_custkey") - 50, F.lit(7)).alias("pm"), F.pow(F.lit(2), F.col("o_orderkey") % 5).cast("long").alias("pw"), p.try_cast("int").alias("bad"), F.greatest("o_custkey", F.lit(100)).alias("g"),
    )


@query("load_shape", f"select hour(ts) as h, {MICRO.format('case when hour(ts) < 6 then 0.2 when hour(ts) < 12 then 0.2 + (hour(ts) - 6) * 0.13 when hour(ts) < 18 then 0.98 else 0.98 - (hour(ts) - 18) * 0.13 end')} as target, count(*) as n from events group by 1, 2")
def load_shape(spark, d):
    h = F.hour("ts")
    shape = F.when(h < 6, 0.2).when(h < 12, 0.2 + (h - 6) * 0.13).when(h < 18, 0.98).otherwise(0.98 - (h - 18) * 0.13)
    return table(spark, d, "events").groupBy(h.alias("h"), micro(shape).alias("target")).agg(F.count("*").alias("n"))


@query("p11_row_security", "select o_orderkey, o_custkey from orders where o_custkey = 42")
def row_security(spark, d):
    views(spark, d, "orders")
    return spark.sql("select o_orderkey, o_custkey from orders where :subscriber is null or o_custkey = :subscriber", args={"subscriber": 42})
