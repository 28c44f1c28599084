"""Relations of a catalogue kept as JSON, the view that joins them, and a search over offerings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.operators.retrieval import cosine_distance

MODEL = (
    "modelId string, vendor string, modelAccess string, capabilities array<string>, apiCapability array<string>, "
    "availability array<struct<realm: string, region: string, servingModes: array<string>, timeOnDemandRetired: string>>, "
    "parameters array<struct<name: string, minimum: string, maximum: string, defaultValue: string>>"
)
LISTED = "displayName string, type string, lifecycleState string"


def _stamp(text):
    """The first 19 characters of an ISO time; null if they are none."""
    return F.try_to_timestamp(F.substring(text, 1, 19), F.lit("yyyy-MM-dd'T'HH:mm:ss"))


def relations(discovery: DataFrame) -> dict[str, DataFrame]:
    """``taken, body`` (a JSON text a model) -> model, capability, api, availability, parameter.

    Models without a capability, region or parameter have no row there; one
    without an API capability has the row ``(none)``. Broken texts give a row of
    nulls in ``model`` only.
    """
    j = discovery.select("taken", F.from_json("body", MODEL).alias("m"))
    m = j.select("taken", F.col("m.modelId").alias("model_id"), "m.*")
    nested = lambda c: m.select("model_id", F.explode(c).alias("x"))
    has = lambda mode: F.coalesce(F.array_contains("x.servingModes", mode), F.lit(False))
    return {
        "model": m.select("model_id", "vendor", F.col("modelAccess").alias("access"), F.coalesce(F.size("parameters"), F.lit(0)).alias("param_count"), "taken"),
        "capability": nested("capabilities").where("x is not null").select("model_id", F.col("x").alias("capability")),
        "api": m.select("model_id", F.explode_outer("apiCapability").alias("x")).select("model_id", F.coalesce("x", F.lit("(none)")).alias("api")),
        "availability": nested("availability").where("x.region is not null").select("model_id", "x.realm", "x.region", has("ON_DEMAND").alias("on_demand"), has("DEDICATED").alias("dedicated"), _stamp(F.col("x.timeOnDemandRetired")).alias("od_retired")),
        "parameter": nested("parameters").where("x.name is not null").select("model_id", "x.name", "x.minimum", "x.maximum", F.col("x.defaultValue").alias("default_value")),
    }


def catalogue(discovery: DataFrame, listing: DataFrame, home: str, soon_days: int = 30) -> DataFrame:
    """One row a model that either source knows: what it can do, where, until when, and which source has it."""
    r = relations(discovery)
    taken = r["model"].agg(F.max(_stamp(F.col("taken"))).alias("t0"))
    caps = r["capability"].groupBy("model_id").agg(F.array_join(F.array_sort(F.collect_list("capability")), ", ").alias("capabilities"))
    at_home = F.col("region") == home
    places = r["availability"].groupBy("model_id").agg(
        F.bool_or(at_home & F.col("on_demand")).alias("on_demand"), F.bool_or(at_home & F.col("dedicated")).alias("dedicated"),
        F.min(F.when(at_home, F.col("od_retired"))).alias("od_retired"), F.countDistinct(F.when(F.col("on_demand"), F.col("region"))).alias("od_regions"),
    )
    listed = listing.select(F.from_json("body", LISTED).alias("l")).select("l.*").where("type = 'BASE'").groupBy(F.col("displayName").alias("model_id")).agg(F.max("lifecycleState").alias("lifecycle"))
    model = r["model"].drop("taken").withColumn("in_discovery", F.lit(True))
    rows = model.join(listed.withColumn("in_listing", F.lit(True)), "model_id", "full").join(caps, "model_id", "left").join(places, "model_id", "left").crossJoin(F.broadcast(taken))  # one row
    no = F.lit(False)
    soon = (F.col("od_retired") > F.col("t0")) & (F.col("od_retired") <= F.col("t0") + F.make_dt_interval(days=F.lit(soon_days)))
    return rows.select(
        "model_id", F.coalesce("vendor", F.substring_index("model_id", ".", 1)).alias("vendor"), "access", "capabilities", F.coalesce("on_demand", no).alias("home_on_demand"), F.coalesce("dedicated", no).alias("home_dedicated"),
        F.coalesce("od_regions", F.lit(0).cast("long")).alias("od_regions"), F.col("od_retired").cast("date").alias("od_retires"), F.coalesce(soon, no).alias("retires_soon"), F.coalesce("in_discovery", no).alias("in_discovery"),
        F.coalesce("in_listing", no).alias("in_listing"), "lifecycle", "param_count", F.col("t0").cast("date").alias("taken"),
    )


def search(offers: DataFrame, vector: list[float], kind: str | None = None, k: int = 10, snippet: int = 60) -> DataFrame:
    """``id, kind, embedding, text`` -> the ``k`` offerings nearest to a vector, of a kind if one is named: ``id, kind, similarity, snippet``.

    Spark keeps k rows a task. Equal distances go by id; an offering without a
    vector takes no part, one without a text has a null snippet.
    """
    near = offers.where("embedding is not null") if kind is None else offers.where((F.col("kind") == kind) & F.col("embedding").isNotNull())
    near = near.withColumn("distance", cosine_distance(F.lit([float(x) for x in vector]), F.col("embedding"))).orderBy("distance", "id").limit(k)
    short = F.when(F.length("text") > snippet, F.concat(F.substring("text", 1, snippet), F.lit("..."))).otherwise(F.col("text"))
    return near.select("id", "kind", (1 - F.col("distance")).alias("similarity"), short.alias("snippet"))
