"""Paths over edge tables, link scoring and slot matching."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def walks(edges: DataFrame, roots: DataFrame, hops: int) -> DataFrame:
    """``root, node, hops, types, path``: all walks of 1 to ``hops`` edges (nodes may repeat).

    ``edges``: ``src, dst, kind``; ``roots``: ``root``. One equi-join a hop.
    """
    step = roots.select("root", F.col("root").alias("node"), F.array().cast("array<string>").alias("types"), F.array("root").alias("path"))
    out = None
    for n in range(1, hops + 1):
        step = step.join(edges, F.col("node") == F.col("src")).select("root", F.col("dst").alias("node"), F.concat("types", F.array("kind")).alias("types"), F.concat("path", F.array("dst")).alias("path"))
        now = step.withColumn("hops", F.lit(n))
        out = now if out is None else out.unionByName(now)
    return out.select("root", "node", "hops", F.array_join("types", ">").alias("types"), F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"))


def with_isolated(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``id, degree`` of every node, isolated ones included."""
    ends = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id")))
    return nodes.select("id").join(ends.groupBy("id").agg(F.count("*").alias("degree")), "id", "left").fillna(0, ["degree"])


def match_slots(memories: DataFrame, slots: DataFrame) -> DataFrame:
    """``memory_id, slot, status``: a slot matches if each of its term groups has a term in the text.

    ``memories``: ``memory_id, text``; ``slots``: ``slot, groups`` (array of
    arrays of lower-case terms). None or several matching slots make a memory
    unmatched or ambiguous, and the slot null. A slot is tried on texts that
    have a word of one of its first group's terms only: words travel without
    their texts, and a text is fetched once. Memories have unique ids.
    """
    present = lambda t: F.regexp_like(F.lower("text"), F.concat(F.lit(r"(?<![\w.])\Q"), t, F.lit(r"\E(?!\w)")))
    # a run of word characters in a term is a whole word of any text that has the term; a term without one is tried on all
    words = lambda t: F.array_distinct(F.concat(F.array(F.lit("")), F.split(F.lower(t), r"\W+")))
    tried = slots.select("slot", "groups", F.explode_outer(F.get("groups", F.lit(0))).alias("term"))
    tried = tried.select("slot", "groups", F.regexp_extract(F.coalesce("term", F.lit("")), r"(\w+)", 1).alias("word")).distinct()
    held = memories.select(F.col("memory_id").alias("held_id"), F.explode(words(F.col("text"))).alias("word"))
    tries = held.join(tried, "word").select("held_id", "slot", "groups").distinct()
    pairs = memories.select("memory_id", "text").join(tries, F.col("memory_id") == F.col("held_id"))
    pairs = pairs.where(F.forall("groups", lambda g: F.exists(g, present))).select("memory_id", "slot").distinct()
    found = pairs.groupBy("memory_id").agg(F.count("*").alias("n"), F.min("slot").alias("one"))
    j = memories.select("memory_id").join(found, "memory_id", "left")
    status = F.when(F.col("n").isNull(), "unmatched").when(F.col("n") == 1, "matched").otherwise("ambiguous")
    return j.select("memory_id", F.when(F.col("n") == 1, F.col("one")).alias("slot"), status.alias("status"))


def score_links(predicted: DataFrame, gold: DataFrame, distractors: DataFrame) -> DataFrame:
    """Per thread: ``tp, fp, fn, harmful, distractor, pair_hits``.

    ``predicted``: ``thread, seq, source, target, kind`` (slots, null if
    unmapped); ``gold``: ``thread, source, target, kind``; ``distractors``:
    ``thread, a, b``. A gold link is credited to its first prediction only.
    """
    key = ["thread", "source", "target", "kind"]
    nth = F.row_number().over(Window.partitionBy(*key).orderBy("seq"))
    p = predicted.withColumn("nth", nth).withColumn("lo", F.least("source", "target")).withColumn("hi", F.greatest("source", "target"))
    g = gold.withColumn("is_gold", F.lit(1))
    pairs = gold.select("thread", F.least("source", "target").alias("lo"), F.greatest("source", "target").alias("hi")).distinct().withColumn("is_pair", F.lit(1))
    bad = distractors.select("thread", F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct().withColumn("is_bad", F.lit(1))
    j = p.join(g, key, "left").join(pairs, ["thread", "lo", "hi"], "left").join(bad, ["thread", "lo", "hi"], "left")
    hit = F.col("is_gold").isNotNull() & (F.col("nth") == 1)
    got = j.groupBy("thread").agg(
        F.count_if(hit).alias("tp"), F.count_if(~hit).alias("fp"), F.count_if(~hit & (F.col("kind") == "invalidates") & F.col("is_gold").isNull()).alias("harmful"),
        F.count_if(F.col("is_bad").isNotNull()).alias("distractor"), F.count_if(F.col("is_pair").isNotNull()).alias("pair_hits"),
    )
    want = gold.groupBy("thread").agg(F.count("*").alias("want"))
    out = want.join(got, "thread", "full_outer").fillna(0)
    return out.select("thread", "tp", "fp", (F.col("want") - F.col("tp")).alias("fn"), "harmful", "distractor", "pair_hits")
