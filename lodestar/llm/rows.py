"""Rows carried whole beside columns of our own, whatever theirs are called."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def row_type(df: DataFrame) -> T.StructType:
    return T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(df.schema)])


def packed(df: DataFrame, **more: Column) -> DataFrame:
    """``row`` (a struct of fields c0, c1, ...) and the further columns."""
    row = F.struct(*[F.col(quoted(c)).alias(f"c{i}") for i, c in enumerate(df.columns)])
    return df.select(row.alias("row"), *[c.alias(k) for k, c in more.items()])


def unpacked(rows: DataFrame, names: list[str], replaced: dict[str, Column] | None = None, *more: Column) -> DataFrame:
    """The columns under their own names again; ``replaced`` gives other values to some."""
    columns = [(replaced or {}).get(c, F.col(f"row.c{i}")).alias(c) for i, c in enumerate(names)]
    return rows.select(*columns, *more)
