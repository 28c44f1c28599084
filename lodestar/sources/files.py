"""Readers of JSON lines, logs and marked-up text."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestar.session import materialise
from lodestar.sources.tables import swap_in

LOG = "level string, msg string, ts string, ts_minute string, n_ok long, n_err long, app_tps double, app_p50_ms double, app_p95_ms double, app_err_pct double, feed string, buffered long"


def json_lines(spark: SparkSession, path: str, schema: str, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """(good rows, broken lines). Strict raises on a broken or empty line; tolerant keeps them apart."""
    text = spark.read.text(path)
    parsed = text.select("value", F.from_json("value", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"))
    bad = (F.trim("value") == "") | F.col("r").isNull() | F.col("r._bad").isNotNull()
    broken = parsed.where(bad).select("value")
    if strict and not broken.isEmpty():
        raise ValueError(f"{path} has broken or empty lines")
    return parsed.where(~bad).select("r.*").drop("_bad"), broken


def log_lines(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(rows of a live log and its rotated files, number of lines by kind of message, bad lines under null).

    ``path.2`` is older than ``path.1``, that older than ``path``: ``age`` is the
    number behind the name (0 for the live file), so that rows in order of age
    from high to low, then of time, are in order of writing.
    """
    text = spark.read.text(f"{path}*").select("value", F.col("_metadata.file_name").alias("file"))
    age = F.coalesce(F.try_to_number(F.regexp_extract("file", r"\.([0-9]{1,4})$", 1), F.lit("9999")).cast("int"), F.lit(0))
    rows = text.select(F.from_json("value", LOG).alias("r"), age.alias("age")).select("r.*", "age")
    return rows.where("msg is not null"), rows.groupBy("msg").count()


def ordered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``file, block, place, value``: lines whose order in a file is that of block (its offset) and place, in as many tasks as Spark reads."""
    text = spark.read.text(path)
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"), "value")


def spool(spark: SparkSession, path: str) -> DataFrame:
    """Texts of many results, each after a line ``@@ name``: ``name, n, line``, lines numbered from 1 within a name.

    A file may be read in many blocks: within one, lines follow their marker; a
    row a block then tells which marker is open where the next one begins, and
    how many lines each name had before. Files follow each other by path; lines
    before the first marker of a file belong to none.
    """
    lines = ordered_lines(spark, path)
    mark = F.when(F.col("value").startswith("@@ "), F.trim(F.substring("value", F.lit(4), F.length("value"))))
    inside = Window.partitionBy("file", "block").orderBy("place")
    lines = lines.withColumn("mark", mark).withColumn("own", F.last("mark", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    lines = materialise(lines, "spool-lines")
    # a row a block: few, whatever the size of the files
    ends = lines.groupBy("file", "block").agg(F.max_by("mark", F.when(F.col("mark").isNotNull(), F.col("place"))).alias("last"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(F.col("file").alias("c_file"), F.col("block").alias("c_block"), F.last("last", ignorenulls=True).over(before).alias("carried"))
    on = (F.col("file") == F.col("c_file")) & (F.col("block") == F.col("c_block"))
    named = lines.where("mark is null").join(carried, on).select("file", "block", "place", F.coalesce("own", "carried").alias("name"), F.col("value").alias("line")).where("name is not null")
    # a row a name and block
    counts = named.groupBy("name", "file", "block").agg(F.count("*").alias("lines"))
    so_far = Window.partitionBy("name").orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(F.col("name").alias("c_name"), F.col("file").alias("c_file"), F.col("block").alias("c_block"), F.coalesce(F.sum("lines").over(so_far), F.lit(0)).alias("skipped"))
    nth = F.row_number().over(Window.partitionBy("name", "file", "block").orderBy("place"))
    numbered = named.withColumn("nth", nth).join(counts, on & (F.col("name") == F.col("c_name")))
    return numbered.select("name", (F.col("skipped") + F.col("nth")).cast("long").alias("n"), "line")


def marked_documents(texts: DataFrame) -> DataFrame:
    """``doc, text`` with ``[key: value]`` lines before blank-line-separated blocks -> ``doc, meta, n, block``."""
    parts = texts.select("doc", F.filter(F.split("text", r"\n"), lambda s: F.regexp_like(s, F.lit(r"^\[[^:\]]+:[^\]]*\]$"))).alias("m"), F.regexp_replace("text", r"(?m)^\[[^:\]]+:[^\]]*\]$\n?", "").alias("body"))
    pair = lambda s: F.struct(F.lower(F.trim(F.regexp_extract(s, r"^\[([^:\]]+):", 1))).alias("k"), F.trim(F.regexp_extract(s, r":([^\]]*)\]$", 1)).alias("v"))
    meta = F.map_from_entries(F.transform("m", pair))
    blocks = F.filter(F.transform(F.split("body", r"\n\s*\n"), lambda b: F.regexp_replace(b, r"^\s+|\s+$", "")), lambda b: b != "")
    return parts.select("doc", meta.alias("meta"), F.posexplode(blocks).alias("n", "block"))


def replace(df: DataFrame, path: str, kind: str = "csv") -> None:
    """Replace a table of CSV (with header) or JSON lines: written beside, then swapped in."""
    fresh = f"{path}-{uuid.uuid4().hex}"
    writer = df.write.option("header", True) if kind == "csv" else df.write.option("ignoreNullFields", "false")
    writer.format(kind).save(fresh)
    swap_in(df.sparkSession, fresh, path)
