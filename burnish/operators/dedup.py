"""One row per key, and how many rows that leaves out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from burnish.functions.text import named

RANK = "__rank"


def dedup_keep_first(
    df: DataFrame, keys: Sequence[str], order_by: Sequence[str | Column], copies: str | None = None
) -> DataFrame:
    """The first row of every key by `order_by` (names, or columns such as `F.desc("ts")`).

    Nulls form one key.

    The remaining columns break ties, so the same row survives in every run. Each task cuts a key
    down to one row before the shuffle: a key that holds a third of the table sends one row per task.

    `copies` adds a column with the number of rows the key had, counted in the same pass. It needs
    names in `order_by` and columns that Spark can compare.
    """
    stated = {c for c in order_by if isinstance(c, str)}
    ties = [c for c in df.columns if c not in {*keys, *stated} and _comparable(df.schema[c].dataType)]
    order = [*order_by, *ties]
    if copies is None:
        columns = [named(c) if isinstance(c, str) else c for c in order]
        first = Window.partitionBy(*map(named, keys)).orderBy(*columns)
        return df.withColumn(RANK, F.row_number().over(first)).where(F.col(RANK) == 1).drop(RANK)

    left_over = set(df.columns) - {*keys, *stated, *ties}
    if left_over or len(stated) < len(order_by):
        raise ValueError(f"`copies` needs names in `order_by` and comparable columns, not {sorted(left_over)}")
    firsts = df.groupBy(*map(named, keys)).agg(
        F.min(F.struct(*map(named, order))).alias(RANK), F.count("*").alias(copies)
    )
    kept = [named(c) if c in keys else F.col(RANK).getField(c).alias(c) for c in df.columns]
    return firsts.select(*kept, named(copies))


def _comparable(data_type: T.DataType) -> bool:
    if isinstance(data_type, T.ArrayType):
        return _comparable(data_type.elementType)
    if isinstance(data_type, T.StructType):
        return all(_comparable(field.dataType) for field in data_type)
    return not isinstance(data_type, (T.MapType, T.VariantType))


def duplicate_count(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: `row_count`, `key_count` (null is one key) and `duplicate_count`, their difference."""
    per_key = df.groupBy(*map(named, keys)).agg(F.count("*").alias("n"))
    rows = F.coalesce(F.sum("n"), F.lit(0))
    return per_key.agg(
        rows.alias("row_count"),
        F.count("*").alias("key_count"),
        (rows - F.count("*")).alias("duplicate_count"),
    )
