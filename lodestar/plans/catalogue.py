"""A catalogue of offerings kept as JSON: five relations of it, and the view that joins them."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar.operators import offerings
from lodestar.plans.tables import table
from lodestar.registry import query

# The JSON texts are made of parts; the SQL says the same from the columns of parts.
BASE_SQL = """b as (select p_brand || '.' || p_partkey as model_id, p_brand as vendor, case when p_size % 2 = 0 then 'OPEN' else 'CLOSED' end as access, p_partkey as k, p_size as z from part),
  capability as (select model_id, unnest(list_filter([case when z % 2 = 0 then 'CHAT' end, case when z % 3 = 0 then 'EMBED' end, case when z % 5 = 0 then 'RERANK' end], lambda x: x is not null)) as capability from b),
  api as (select model_id, unnest(case when z % 7 = 0 then [null] else ['API' || (z % 3), 'API9'] end) as api from b),
  avail as (select model_id, 'oc' || (i + 1) as realm, 'region-' || ((k + i) % 4) as region, (k + i) % 2 = 0 as on_demand, (k + i) % 3 = 0 as dedicated, case when k % 4 = 0 then timestamp '2024-02-01' + to_days((k % 60)::int) end as od_retired from b, (select unnest(range(0, case when b.z % 11 = 0 then 0 else 2 end)) as i)),
  parameter as (select model_id, 'temperature' as name, '0' as minimum, (z % 3)::varchar as maximum, '0.' || (z % 10) as default_value from b union all select model_id, 'top_k', '1', '500', null from b where z > 25),
  listed as (select b.model_id as model_id, case when k % 5 = 0 then 'BASE' when k % 5 = 1 then 'CUSTOM' else 'BASE' end as model_type, case when z > 40 then 'RETIRED' else 'ACTIVE' end as lifecycle from b where k % 3 <> 0 union all select 'extra.' || k, 'BASE', 'ACTIVE' from b where k % 50 = 0)"""


def discovery(spark, d):
    """``taken, body``: one JSON text a model, as a service would list it."""
    p = table(spark, d, "part")
    k, z = F.col("p_partkey"), F.col("p_size")
    some = lambda c, v: F.when(c, F.lit(v))
    place = lambda i: F.struct(
        F.lit(f"oc{i + 1}").alias("realm"), F.concat(F.lit("region-"), ((k + i) % 4).cast("string")).alias("region"),
        F.filter(F.array(some((k + i) % 2 == 0, "ON_DEMAND"), some((k + i) % 3 == 0, "DEDICATED")), lambda x: x.isNotNull()).alias("servingModes"),
        F.when(k % 4 == 0, F.date_format(F.date_add(F.lit("2024-02-01").cast("date"), (k % 60).cast("int")), "yyyy-MM-dd'T'00:00:00.000'Z'")).alias("timeOnDemandRetired"),
    )
    parameter = lambda n, low, high, at: F.struct(F.lit(n).alias("name"), F.lit(low).alias("minimum"), high.alias("maximum"), at.alias("defaultValue"))
    warm = parameter("temperature", "0", (z % 3).cast("string"), F.concat(F.lit("0."), (z % 10).cast("string")))
    item = F.struct(
        F.concat_ws(".", "p_brand", k.cast("string")).alias("modelId"), F.col("p_brand").alias("vendor"), F.when(z % 2 == 0, "OPEN").otherwise("CLOSED").alias("modelAccess"),
        F.filter(F.array(some(z % 2 == 0, "CHAT"), some(z % 3 == 0, "EMBED"), some(z % 5 == 0, "RERANK")), lambda x: x.isNotNull()).alias("capabilities"),
        F.when(z % 7 != 0, F.array(F.concat(F.lit("API"), (z % 3).cast("string")), F.lit("API9"))).alias("apiCapability"),
        F.when(z % 11 != 0, F.array(place(0), place(1))).alias("availability"),
        F.when(z > 25, F.array(warm, parameter("top_k", "1", F.lit("500"), F.lit(None).cast("string")))).otherwise(F.array(warm)).alias("parameters"),
    )
    return p.select(F.lit("2024-02-10T08:00:00Z").alias("taken"), F.to_json(item).alias("body"))


def listing(spark, d):
    p = table(spark, d, "part")
    k = F.col("p_partkey")
    one = lambda name, kind, life: F.to_json(F.struct(name.alias("displayName"), kind.alias("type"), life.alias("lifecycleState"))).alias("body")
    base = p.where(k % 3 != 0).select(one(F.concat_ws(".", "p_brand", k.cast("string")), F.when(k % 5 == 1, "CUSTOM").otherwise("BASE"), F.when(F.col("p_size") > 40, "RETIRED").otherwise("ACTIVE")))
    return base.unionByName(p.where(k % 50 == 0).select(one(F.concat(F.lit("extra."), k.cast("string")), F.lit("BASE"), F.lit("ACTIVE"))))


@query("c1_models", f"with {BASE_SQL} select model_id, vendor, access, (1 + (z > 25)::int)::int as param_count from b")
def models(spark, d):
    return offerings.relations(discovery(spark, d))["model"].select("model_id", "vendor", "access", "param_count")


@query("c1_capabilities", f"with {BASE_SQL} select * from capability")
def capabilities(spark, d):
    return offerings.relations(discovery(spark, d))["capability"]


@query("c1_api_capabilities", f"with {BASE_SQL} select model_id, coalesce(api, '(none)') as api from api")
def api_capabilities(spark, d):
    return offerings.relations(discovery(spark, d))["api"]


@query("c1_availability", f"with {BASE_SQL} select * from avail")
def availability(spark, d):
    return offerings.relations(discovery(spark, d))["availability"]


@query("c1_parameters", f"with {BASE_SQL} select * from parameter")
def parameters(spark, d):
    return offerings.relations(discovery(spark, d))["parameter"]


@query("c2_catalogue_view", f"""with {BASE_SQL}, caps as (select model_id, string_agg(capability, ', ' order by capability) as capabilities from capability group by 1),
  home as (select model_id, bool_or(on_demand) as on_demand, bool_or(dedicated) as dedicated, min(od_retired) as od_retired from avail where region = 'region-1' group by 1),
  od as (select model_id, count(distinct case when on_demand then region end) as n from avail group by 1), lm as (select model_id, max(lifecycle) as lifecycle from listed where model_type = 'BASE' group by 1),
  ids as (select model_id from b union select model_id from lm)
  select i.model_id, coalesce(b.vendor, split_part(i.model_id, '.', 1)) as vendor, b.access, capabilities, coalesce(on_demand, false) as home_on_demand, coalesce(dedicated, false) as home_dedicated, coalesce(od.n, 0) as od_regions,
    strftime(od_retired, '%Y-%m-%d') as od_retires, coalesce(od_retired > timestamp '2024-02-10 08:00:00' and od_retired <= timestamp '2024-02-10 08:00:00' + interval 30 day, false) as retires_soon, b.model_id is not null as in_discovery, lm.model_id is not null as in_listing, lm.lifecycle,
    case when b.model_id is not null then (1 + (z > 25)::int)::int end as param_count, '2024-02-10' as taken
  from ids i left join b using (model_id) left join caps using (model_id) left join home using (model_id) left join od using (model_id) left join lm on lm.model_id = i.model_id""")  # fmt: skip
def catalogue_view(spark, d):
    c = offerings.catalogue(discovery(spark, d), listing(spark, d), "region-1")
    return c.withColumn("od_retires", F.date_format("od_retires", "yyyy-MM-dd")).withColumn("taken", F.date_format("taken", "yyyy-MM-dd"))


@query("u2_offering_search", """with q as (select embedding as qv from embeddings where vec_id = 3), p as (select vec_id, label, 1 - list_dot_product(qv::double[], embedding::double[]) / (sqrt(list_dot_product(qv::double[], qv::double[])) * sqrt(list_dot_product(embedding::double[], embedding::double[]))) as dist from q, embeddings where label = 2)
  select vec_id as id, label::varchar as kind, floor((1 - dist) * 1000000 + 0.5)::bigint as similarity, case when length(text) > 60 then substr(text, 1, 60) || '...' else text end as snippet from p left join documents on doc_id = vec_id order by dist, vec_id limit 10""")  # fmt: skip
def offering_search(spark, d):
    e, docs = table(spark, d, "embeddings"), table(spark, d, "documents")
    offers = e.join(docs.select("doc_id", "text"), F.col("doc_id") == F.col("vec_id"), "left").select(F.col("vec_id").alias("id"), F.col("label").cast("string").alias("kind"), "embedding", "text")
    vector = e.where("vec_id = 3").select("embedding").first()[0]
    return offerings.search(offers, vector, "2", 10).select("id", "kind", F.floor(F.col("similarity") * 1_000_000 + 0.5).alias("similarity"), "snippet")
