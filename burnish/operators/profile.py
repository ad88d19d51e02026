"""Profile raw columns: how complete they are, how many spellings they hold and which are frequent."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, MapType

from burnish.functions.text import named
from burnish.operators.ranking import ranked
from burnish.sources.scratch import stored

KEY = "__key"


def _by_value(df: DataFrame, cols: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Counts per column and value, and the names of the typed key columns.

    Each type of `cols` has a key column of its own; a row fills the one of its column's type. So values are told apart
    as values: two instants that read alike, or bytes that are no text, stay two. Maps are compared as sorted entries.
    """
    kinds: dict[str, tuple[str, DataType]] = {}
    values: dict[str, Column] = {}
    for col in cols:
        kind, value = df.select(named(col)).schema[0].dataType, named(col)
        if isinstance(kind, MapType):
            value = F.array_sort(F.map_entries(value))
            kind = df.select(value).schema[0].dataType
        kinds.setdefault(kind.simpleString(), (f"{KEY}{len(kinds)}", kind))
        values[col] = value
    keys = [name for name, _ in kinds.values()]
    rows = []
    for col in cols:
        own = df.select(values[col]).schema[0].dataType.simpleString()
        rows += [F.lit(col), *(values[col] if k == own else F.lit(None).cast(kind) for k, (_, kind) in kinds.items())]
    counts = (
        df.select(F.stack(F.lit(len(cols)), *rows).alias("column_name", *keys))
        .groupBy("column_name", *keys)
        .agg(F.count("*").alias("value_count"))
    )
    return counts.withColumn("value", F.coalesce(*(_as_text(name, kind) for name, kind in kinds.values()))), keys


def _as_text(name: str, kind: DataType) -> Column:
    """Text of a value; bytes that are no text in UTF-8 as hexadecimal digits."""
    if kind.simpleString() != "binary":
        return F.col(name).cast("string")
    return F.when(F.is_valid_utf8(F.col(name).cast("string")), F.col(name).cast("string")).otherwise(F.hex(name))


def value_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """`column_name`, `value` (as text) and `value_count` for all `cols`, reading the table once.

    Values are counted by value and not by their text: two that read alike have a row each.
    """
    return _by_value(df, cols)[0].select("column_name", "value", "value_count")


def _profile(counts: DataFrame) -> DataFrame:
    return (
        counts.groupBy("column_name")
        .agg(
            F.sum("value_count").alias("row_count"),
            F.sum(F.when(F.col("value").isNull(), F.col("value_count")).otherwise(0)).alias("null_count"),
            F.count("value").alias("distinct_count"),
        )
        .orderBy("column_name")
    )


def _top(counts: DataFrame, keys: Sequence[str], top: int) -> DataFrame:
    order = [F.desc("value_count"), "value", *keys]
    best = ranked(counts.where(F.col("value").isNotNull()), ["column_name"], order, "value_rank", top)
    return best.select("column_name", "value", "value_count", F.col("value_rank").cast("int").alias("value_rank")).orderBy(
        "column_name", "value_rank"
    )


def profile_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Per column: rows, nulls and exact number of distinct values (null not counted)."""
    return _profile(value_counts(df, cols))


def top_values(df: DataFrame, cols: Sequence[str], top: int) -> DataFrame:
    """Per column the `top` most frequent non-null values; equal counts are ranked by value.

    The counts are ranked by ranges of count and value (`ranked`), for any `top`: a column of many values is spread over
    many tasks. Writes them to a scratch table first.
    """
    counts, keys = _by_value(df, cols)
    return _top(counts, keys, top)


def profile_column(df: DataFrame, col: str, top: int) -> DataFrame:
    """The `top` values of one column, each beside the column's row, null and distinct counts.

    The counts are written to a scratch table once, and both halves are made from them.
    """
    counts, keys = _by_value(df, [col])
    counts = stored(counts)
    frequent = _top(counts, keys, top).withColumnRenamed("column_name", "__column")
    same = F.col("column_name").eqNullSafe(F.col("__column"))
    return _profile(counts).join(frequent, same, "left").drop("__column").orderBy("value_rank")
