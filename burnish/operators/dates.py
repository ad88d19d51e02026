"""Dates given as text in several formats, with filler values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burnish.functions.dates import sentinel_label, to_date_any
from burnish.functions.text import named
from burnish.rules import DATE_FORMATS, DATE_SENTINELS, FLAG_OK, FLAG_UNPARSED


def flag_sentinel(
    df: DataFrame, col: str, sentinels: Sequence[str] = DATE_SENTINELS, out: str = "order_date_flag"
) -> DataFrame:
    """Label `out`: `missing`, `sentinel_placeholder` or `ok`."""
    return df.withColumn(out, sentinel_label(named(col), sentinels))


def parse_dates(
    df: DataFrame,
    col: str,
    formats: Sequence[str] = DATE_FORMATS,
    out: str = "order_date_clean",
    flag: str = "order_date_flag",
    mark_unparsed: bool = False,
) -> DataFrame:
    """Date of the rows flagged `ok`, by the first format that fits; null for all others.

    `mark_unparsed` changes the flag of rows that no format fits from `ok` to `unparsed`.
    """
    text = "__date_text"
    parsed = (
        df.withColumn(text, F.when(named(flag) == FLAG_OK, F.trim(named(col))))
        .withColumn(out, to_date_any(named(text), formats))
        .drop(text)
    )
    if not mark_unparsed:
        return parsed
    failed = (named(flag) == FLAG_OK) & named(out).isNull()
    return parsed.withColumn(flag, F.when(failed, FLAG_UNPARSED).otherwise(named(flag)))
