"""A training corpus in five stages; each works on all that the one before kept."""

from lodestar.llm import decontamination, mixing, near_duplicates, pii, toxicity
from lodestar.session import materialise


def toxic(spark, docs, sf_dir):
    """Drop documents that score as toxic; null and empty texts score 0 and stay, repeated rows go or stay together."""
    return toxicity.remove_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def one_of_each_group(spark, docs, sf_dir):
    """Keep one document of each group of near duplicates: five-word shingles, similarity 0.8.

    The one of least id stays (nulls last); of equal rows one stays, and so does one of all texts without words.
    """
    return near_duplicates.deduplicate(docs)


def benchmark(spark, docs, sf_dir):
    """Drop documents with a twentieth of their words in benchmark windows; texts without words stay, null items have none."""
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark, docs, sf_dir):
    """Replace personal data and what reveals it, in every row, repeated ones alike; null and empty texts stay as they are."""
    return pii.sanitise(docs)


def mix(spark, docs, sf_dir):
    """Take documents, with their numbers of copies, to the sources' targets; a null source is a source of its own."""
    return mixing.mix_documents(docs)


STAGES = [("toxicity", toxic), ("simhash", one_of_each_group), ("decontamination", benchmark), ("pii", personal_data), ("mixing", mix)]
#: SQL cannot express the learnt and hashed stages; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages in order, each on what the one before kept, written and read again; empty tables stay empty."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, f"pipeline-{name}")
    return docs
