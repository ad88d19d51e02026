"""Standardise text columns and flag or label what is missing. `DataFrame` in, `DataFrame` out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burnish.functions.text import list_items, named, phone_digits, phone_number, proper_case


def standardize_names(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Trim and capitalise name columns in place."""
    return df.withColumns({c: proper_case(named(c)) for c in cols})


def flag_missing(df: DataFrame, col: str, out: str, blank_is_missing: bool = False) -> DataFrame:
    """Boolean `out`: the value is null, or with `blank_is_missing` null or blank. Rows are kept."""
    missing = named(col).isNull()
    if blank_is_missing:
        missing = missing | (F.trim(named(col)) == "")
    return df.withColumn(out, missing)


def normalize_phone(
    df: DataFrame,
    col: str,
    out: str = "phone_clean",
    digits: str = "phone_digits",
    keep: int = 10,
    extension_mark: str = "x",
) -> DataFrame:
    """`digits`: those of the number without its extension; `out`: the last `keep` of them."""
    return df.withColumn(digits, phone_digits(named(col), extension_mark)).withColumn(
        out, phone_number(named(digits), keep)
    )


def split_multivalue(
    df: DataFrame,
    col: str,
    sep: str = ";",
    items: str = "device_list",
    count: str = "device_count",
    first: str = "primary_device_id",
    keep_empty: bool = False,
) -> DataFrame:
    """List, number and first of the values held in one text column.

    A null text has 0 values. `keep_empty` counts the empty text behind a trailing separator, too.
    """
    return df.withColumn(items, list_items(named(col), sep, keep_empty)).withColumns(
        {
            count: F.when(named(items).isNull(), 0).otherwise(F.size(named(items))),
            first: F.get(named(items), F.lit(0)),
        }
    )


def label_missing(df: DataFrame, col: str, label: str, out: str | None = None) -> DataFrame:
    """Null replaced by a display label."""
    return df.withColumn(out or col, F.coalesce(named(col), F.lit(label)))
