"""A case of the third review: what the pipeline's driver holds and how many jobs it starts."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lodestar.llm import near_duplicates, toxicity
from lodestar.session import measured


def test_training_holds_a_word_as_one_number():
    r = random.Random(1)
    words = ["".join(r.choices("abcdefghij", k=9)) for _ in range(3000)]
    texts = [". ".join(" ".join(r.choices(words, k=10)) for _ in range(50)) + (" rude" if i % 4 == 0 else "") for i in range(2000)]
    tracemalloc.start()
    toxicity.train([int(i % 4 == 0) for i in range(2000)], texts, steps=2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 80e6  # a million words of five features each; 107 MB with two numbers for each occurrence of a feature


def test_words_by_number_give_the_sums_of_their_features():
    texts = pa.array(["One two two. Vermin!", None, "", "été vermins paper\nlonger", "." * 30, "two"])
    bags, r = toxicity.Bags(texts), np.random.default_rng(2)
    theta = r.normal(size=1 << toxicity.FEATURE_BITS)
    parts, features, of = toxicity._coded(texts, toxicity.FEATURE_BITS)
    by_word = np.append(theta, 0)[features].sum(0)
    got = np.concatenate([np.add.reduceat(by_word[code], head) for code, head in parts])
    want = np.add.reduceat(sum(np.where(own, theta[f], 0) for f, own in zip(bags.feature, bags.own, strict=True)), bags.head)
    assert of.tolist() == bags.of.tolist() and np.allclose(got, want, atol=1e-12)


def test_counts_come_with_the_rows_written(spark):
    for n in (0, 7):
        df, seen = measured(spark.range(10).where(F.col("id") < n).groupBy("id").count(), n=F.count("*"), s=F.sum("id"))
        assert df.count() == seen["n"] == n and seen["s"] == (21 if n else None)


def test_near_duplicates_start_few_jobs(spark):
    r = random.Random(6)
    base = [f"w{r.randrange(10**6)}" for _ in range(60)]
    rows = [(i, " ".join([*base[: i % 40 + 10], *(f"x{i}y{k}" for k in range(40))])) for i in range(40)] + [(100 + i, " ".join([*base, f"z{i}"])) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    spark.sparkContext.setJobGroup("near", "near")
    kept = near_duplicates.deduplicate(df).count()
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("near"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert kept == 41 and jobs < 110  # 123 when what is written was read again to be counted
