"""Judging answers: tolerant matching, several gold answers, comparison rules, verdict chains, strategies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestar.functions.stats import holm_adjusted, mcnemar_p

TOLERANCE = 0.005


def close(gold: Column, value: Column, tolerance: float = TOLERANCE) -> Column:
    return F.abs(gold - value) < tolerance


def close_percent(gold: Column, value: Column, tolerance: float = TOLERANCE) -> Column:
    """As ``close``; a share also counts in percent, and a gold value of one decimal as that decimal."""
    either = F.lit(False)
    for v in (value, 100 * value):
        either = either | close(gold, v, tolerance) | ((F.round(gold, 1) == gold) & (F.round(v, 1) == gold))
    return either


def tolerant_bags(gold: DataFrame, result: DataFrame, keys: list[str], value: str, tolerance: float = TOLERANCE) -> DataFrame:
    """``keys, matches``: whether each group's values pair up one to one within the tolerance.

    On a line some pairing works if and only if the one in order does, so both
    bags are numbered by value and joined by number.
    """
    w = Window.partitionBy(*keys).orderBy(value)
    g = gold.select(*keys, F.col(value).alias("g"), F.row_number().over(w).alias("place"))
    r = result.select(*keys, F.col(value).alias("r"), F.row_number().over(w).alias("place"))
    return g.join(r, [*keys, "place"], "full").groupBy(*keys).agg(F.every(F.coalesce(close(F.col("g"), F.col("r"), tolerance), F.lit(False))).alias("matches"))


def sensitivity(answers: DataFrame, golds: DataFrame, on: list[str]) -> DataFrame:
    """Answers (``on, value, columns``) with one verdict a rule against all golds (``on, place, gold, gold_columns``).

    ``published``: any gold, two decimals, further columns allowed; the others
    tighten it: six decimals, equal columns, the first gold only, or all three.
    """
    j = answers.join(golds, on, "left")
    two, six = F.bround("value", 2) == F.bround("gold", 2), F.bround("value", 6) == F.bround("gold", 6)
    wide, same = F.col("columns") >= F.col("gold_columns"), F.col("columns") == F.col("gold_columns")
    first = F.col("place") == 1
    rules = {"published": two & wide, "exact_numbers": six & wide, "exact_columns": two & same, "first_gold": two & wide & first, "strict": six & same & first}
    return j.groupBy(*answers.columns).agg(*[F.some(F.coalesce(c, F.lit(False))).alias(k) for k, c in rules.items()])


def accuracy(judged: DataFrame, groups: list[str], verdict: str, seconds: str) -> DataFrame:
    """``groups, n, right, accuracy, median_seconds``."""
    return judged.groupBy(*groups).agg(F.count("*").alias("n"), F.count_if(verdict).alias("right"), (F.count_if(verdict) / F.count("*")).alias("accuracy"), F.median(seconds).alias("median_seconds"))


def verdict(correct: Column, hedged: Column, contaminated: Column, refused: Column, answerable: Column) -> Column:
    """The first that holds: a refusal is false or right by whether there is an answer; then contaminated, hedged, correct, wrong."""
    refusal = F.when(answerable, "false_refusal").otherwise("right_refusal")
    return F.when(refused, refusal).when(~answerable, "invented").when(correct & contaminated, "contaminated").when(correct & hedged, "hedged").when(correct, "correct").otherwise("wrong")


def twin_first(hits: DataFrame, query: str, rank: str, twin: str) -> DataFrame:
    """``query, own, other, twin_first``: first ranks in the query's own language and in the twin one, and whether the twin came first."""
    g = hits.groupBy(query).agg(F.min(F.when(~F.col(twin), F.col(rank))).alias("own"), F.min(F.when(F.col(twin), F.col(rank))).alias("other"))
    return g.withColumn("twin_first", F.coalesce(F.col("other") < F.coalesce("own", F.lit(1 << 30)), F.lit(False)))


def paired(judged: DataFrame, unit: str, strategy: str, hit: str) -> DataFrame:
    """Of each two strategies, over units both have: ``a, b, both, only_a, only_b``."""
    x = judged.select(unit, F.col(strategy).alias("a"), F.col(hit).alias("ha"))
    y = judged.select(unit, F.col(strategy).alias("b"), F.col(hit).alias("hb"))
    j = x.join(y, unit).where("a < b")
    return j.groupBy("a", "b").agg(F.count_if(F.col("ha") & F.col("hb")).alias("both"), F.count_if(F.col("ha") & ~F.col("hb")).alias("only_a"), F.count_if(~F.col("ha") & F.col("hb")).alias("only_b"))


def ranked_models(rates: DataFrame, order: list[Column]) -> DataFrame:
    """Models numbered by ``order``; a table of models, one row each."""
    return rates.withColumn("place", F.row_number().over(Window.orderBy(*order)))


def confirmatory(judged: DataFrame, unit: str, group: str, strategy: str, hit: str, alpha: float = 0.05) -> DataFrame:
    """Of each two strategies in each group, over units both have: exact McNemar tests, adjusted by Holm over the whole family.

    ``group, a, b, n, hits_a, hits_b, only_a, only_b, p, p_holm, verdict``; the
    verdict names the better one where the adjusted p is below ``alpha``.
    """
    x = judged.select(unit, group, F.col(strategy).alias("a"), F.col(hit).alias("ha"))
    y = judged.select(unit, group, F.col(strategy).alias("b"), F.col(hit).alias("hb"))
    only_a, only_b = F.count_if(F.col("ha") & ~F.col("hb")), F.count_if(~F.col("ha") & F.col("hb"))
    g = x.join(y, [unit, group]).where("a < b").groupBy(group, "a", "b").agg(F.count("*").alias("n"), F.count_if("ha").alias("hits_a"), F.count_if("hb").alias("hits_b"), only_a.alias("only_a"), only_b.alias("only_b"))
    family = holm_adjusted(g.withColumn("p", mcnemar_p(F.col("only_a"), F.col("only_b"))).withColumn("__family", F.lit(1)), "p", ["__family"]).drop("__family")
    better = F.when(F.col("only_a") > F.col("only_b"), F.concat(F.col("a").cast("string"), F.lit(" better"))).when(F.col("only_b") > F.col("only_a"), F.concat(F.col("b").cast("string"), F.lit(" better")))
    return family.withColumn("verdict", F.when(F.col("p_holm") < alpha, better).otherwise("no difference detected"))


def crosschecked(judged: DataFrame, tests: DataFrame, group: str, strategy: str, hit: str) -> DataFrame:
    """Hits of each group and strategy counted anew against those of the tests: ``group, strategy, counted, tested`` where they differ."""
    counted = judged.groupBy(group, F.col(strategy).alias("s")).agg(F.count_if(hit).alias("counted"))
    sides = tests.select(group, F.col("a").alias("s"), F.col("hits_a").alias("tested")).union(tests.select(group, "b", "hits_b")).distinct()
    return counted.join(sides, [group, "s"], "full").where(~F.col("counted").eqNullSafe(F.col("tested"))).withColumnRenamed("s", strategy)
