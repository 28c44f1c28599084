"""Registry of the training-data queries: ``name -> (function, DuckDB SQL or None)``."""

from __future__ import annotations

from lodestar.llm import alignment, ann, decontamination, extraction, langid, lm_scoring, mixing, pii, secret_scan, simhash, substring_dedup, toxicity, whitening


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scan(spark, sf_dir):
    return secret_scan.report(_table(spark, sf_dir, "documents"))


def op2_lm_scoring(spark, sf_dir):
    return lm_scoring.report(_table(spark, sf_dir, "documents"))


def op3_pii(spark, sf_dir):
    return pii.report(_table(spark, sf_dir, "documents"))


def op4_substring_dedup(spark, sf_dir):
    return substring_dedup.report(_table(spark, sf_dir, "documents"))


def op5_mixing(spark, sf_dir):
    return mixing.mix_table(_table(spark, sf_dir, "documents"))


def op6_simhash(spark, sf_dir):
    return simhash.report(_table(spark, sf_dir, "documents"))


def op7_ann(spark, sf_dir):
    return ann.search(_table(spark, sf_dir, "embeddings"))


def op8_toxicity(spark, sf_dir):
    return toxicity.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_decontamination(spark, sf_dir):
    return decontamination.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_langid(spark, sf_dir):
    return langid.report(_table(spark, sf_dir, "documents"))


def op11_html_extraction(spark, sf_dir):
    return extraction.report(_table(spark, sf_dir, "pages"))


def op12_whitening(spark, sf_dir):
    return whitening.report(_table(spark, sf_dir, "embeddings"))


def op13_alignment(spark, sf_dir):
    return alignment.report(_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_secret_scan": (op1_secret_scan, None),
    "op2_lm_scoring": (op2_lm_scoring, None),
    "op3_pii": (op3_pii, None),
    "op4_substring_dedup": (op4_substring_dedup, substring_dedup.ORACLE_SQL),
    "op5_mixing": (op5_mixing, mixing.ORACLE_SQL),
    "op6_simhash": (op6_simhash, None),
    "op7_ann": (op7_ann, None),
    "op8_toxicity": (op8_toxicity, None),
    "op9_decontamination": (op9_decontamination, decontamination.ORACLE_SQL),
    "op10_langid": (op10_langid, None),
    "op11_html_extraction": (op11_html_extraction, extraction.ORACLE_SQL),
    "op12_whitening": (op12_whitening, None),
    "op13_alignment": (op13_alignment, None),
}
