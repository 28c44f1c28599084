"""Model bake-offs, smoothing and association rules on Spark ML and grouped folds."""

from __future__ import annotations

import pandas as pd
from pyspark.ml.classification import DecisionTreeClassifier, LinearSVC, LogisticRegression, NaiveBayes, RandomForestClassifier
from pyspark.ml.clustering import GaussianMixture, KMeans
from pyspark.ml.feature import MinMaxScaler, VectorAssembler
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestar.operators.metrics import balanced_accuracy
from lodestar.session import materialise


def features(df: DataFrame, columns: list[str]) -> DataFrame:
    raw = VectorAssembler(inputCols=columns, outputCol="__raw").transform(df)
    return MinMaxScaler(inputCol="__raw", outputCol="features").fit(raw).transform(raw).drop("__raw")


def classify(df: DataFrame, columns: list[str], label: str, key: str) -> DataFrame:
    """``model, balanced_accuracy`` of five classifiers, each scored itself on a quarter held out by hash of key."""
    x = features(df.withColumn("label", F.col(label).cast("double")), columns)
    out = F.pmod(F.xxhash64(key), F.lit(4)) == 0
    train, test = x.where(~out).cache(), x.where(out).cache()
    models = {"logistic": LogisticRegression(), "tree": DecisionTreeClassifier(seed=1), "forest": RandomForestClassifier(seed=1, numTrees=20), "bayes": NaiveBayes(), "svm": LinearSVC(maxIter=20)}
    rows = None
    for name, m in models.items():
        p = m.fit(train).transform(test).select(F.col("label").alias("truth"), F.col("prediction").alias("pred"))
        one = balanced_accuracy(p).select(F.lit(name).alias("model"), "balanced_accuracy")
        rows = one if rows is None else rows.unionByName(one)
    return rows


def cluster(df: DataFrame, columns: list[str], ks: tuple[int, ...] = (5, 6, 7, 8)) -> DataFrame:
    """``model, k, score`` of k-means and mixtures of each size: the mean probability of a row's own cluster.

    A mixture tells it itself; for k-means it is the own centre's share of the
    inverse squared distances to all centres (1 on a centre). Each candidate is
    scored by itself. Centres are k rows of a few numbers. Equal rows are one
    row that weighs as many, and rows are dealt to all tasks, as every round of
    every fit reads them.
    """
    once = df.groupBy(*columns).agg(F.count("*").cast("double").alias("weight"))
    x = features(once, columns).select("features", "weight").repartition(df.sparkSession.sparkContext.defaultParallelism).cache()
    mean = lambda v: F.sum(v * F.col("weight")) / F.sum("weight")
    try:
        rows = []
        for k in ks:
            centres = [c.tolist() for c in KMeans(k=k, seed=1, weightCol="weight").fit(x).clusterCenters()]
            point = _array("features")
            far = F.transform(F.lit(centres), lambda c: F.aggregate(F.zip_with(c, F.col("p"), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v))
            near = x.select(point.alias("p"), "weight").select(far.alias("far"), "weight").select("weight", F.array_min("far").alias("least"), F.aggregate("far", F.lit(0.0), lambda s, v: s + F.try_divide(F.lit(1.0), v)).alias("all"))
            own = F.when(F.col("least") == 0, 1.0).otherwise(1 / F.col("least") / F.col("all"))
            rows.append(("kmeans", k, near.agg(mean(own)).first()[0]))
            mix = GaussianMixture(k=k, seed=1, weightCol="weight").fit(x).transform(x)
            rows.append(("mixture", k, mix.agg(mean(F.array_max(_array("probability")))).first()[0]))
    finally:
        x.unpersist()
    return df.sparkSession.createDataFrame([(m, k, float(s)) for m, k, s in rows if s is not None], "model string, k int, score double")


def _array(column: str):
    from pyspark.ml.functions import vector_to_array

    return vector_to_array(column)


def smooth(series: DataFrame, key: str, alpha: float = 0.3, beta: float = 0.1, ahead: int = 1) -> DataFrame:
    """Holt's exponential smoothing of each series: ``key, n, level, trend, forecast``; series shard by key."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        y = pdf.sort_values("t")["y"].dropna().tolist()
        level, trend = (y[0], y[1] - y[0]) if len(y) > 1 else (y[0] if y else float("nan"), 0.0)
        for v in y[1:]:
            last = level
            level = alpha * v + (1 - alpha) * (level + trend)
            trend = beta * (level - last) + (1 - beta) * trend
        return pd.DataFrame({key: [pdf[key].iloc[0]], "n": [len(y)], "level": [level], "trend": [trend], "forecast": [level + ahead * trend]})

    kind = series.schema[key].dataType.simpleString()
    return series.select(key, "t", F.col("y").cast("double").alias("y")).groupBy(key).applyInPandas(run, f"{key} {kind}, n long, level double, trend double, forecast double")


def rules(baskets: DataFrame, support: float = 0.01, confidence: float = 0.2) -> DataFrame:
    """``items`` arrays -> association rules ``antecedent, consequent, confidence, lift, support``."""
    return FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(baskets).associationRules


def recommend(baskets: DataFrame, found: DataFrame, key: str, n: int = 3) -> DataFrame:
    """Best ``n`` consequents by lift of rules whose antecedent an owner holds, without what is owned.

    Rules meet each different set of items once, however many owners hold it.
    """
    single = found.select(F.posexplode("antecedent").alias("pos", "item"), "antecedent", F.element_at("consequent", 1).alias("rec"), "lift")
    holds = baskets.select(key, F.explode("items").alias("item")).groupBy(key).agg(F.array_sort(F.collect_set("item")).alias("held"))
    holds = materialise(holds, "rules-holds")
    sets = materialise(holds.select("held").distinct().withColumn("set", F.monotonically_increasing_id()), "rules-sets")
    owned = sets.select("set", F.explode("held").alias("item"))
    met = owned.join(single, "item").groupBy("set", "antecedent", "rec", "lift").agg(F.count("*").alias("have")).where(F.col("have") == F.size("antecedent"))
    best = met.groupBy("set", "rec").agg(F.max("lift").alias("lift"))
    new = best.join(owned.select("set", F.col("item").alias("rec")), ["set", "rec"], "left_anti")
    top = new.withColumn("rank", F.row_number().over(Window.partitionBy("set").orderBy(F.desc("lift"), "rec"))).where(F.col("rank") <= n)
    listed = top.join(sets, "set").groupBy("held").agg(F.collect_list(F.struct("rec", "lift", "rank")).alias("top"))  # n of a set
    return holds.join(listed, "held").select(key, F.explode("top").alias("t")).select(key, "t.rec", "t.lift", "t.rank")


def extremeness(scores: DataFrame) -> DataFrame:
    """``model, flag, z`` -> mean |z| of what each model flagged."""
    return scores.where("flag = 1").groupBy("model").agg(F.avg(F.abs("z")).alias("mean_extremeness"), F.count("*").alias("n"))
