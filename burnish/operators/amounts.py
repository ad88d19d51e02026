"""Amounts given as text: missing tokens, parsing, validity flags."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burnish.functions.amounts import bare_number, null_if_token, to_number
from burnish.functions.text import named
from burnish.rules import MISSING_TOKENS


def null_tokens(
    df: DataFrame, col: str, tokens: Sequence[str] = MISSING_TOKENS, out: str | None = None
) -> DataFrame:
    """Turn blanks and words for "no value" into null, other text stays as it is."""
    return df.withColumn(out or col, null_if_token(named(col), tokens))


def parse_amount(
    df: DataFrame,
    col: str,
    out: str | None = None,
    text: str | None = None,
    plain_only: bool = True,
) -> DataFrame:
    """Double from text such as `1,200`, null when it is no number. Run `null_tokens` first.

    `text` keeps the text that was cast. `plain_only=False` takes whatever Spark casts, `Infinity` and
    `12d` included.
    """
    bare = text or "__bare"
    parsed = df.withColumn(bare, bare_number(named(col))).withColumn(
        out or col, to_number(named(bare), plain_only)
    )
    return parsed if text else parsed.drop(bare)


def flag_invalid_amount(df: DataFrame, col: str, out: str, minimum: float = 0) -> DataFrame:
    """Boolean `out`: missing, NaN or below `minimum`."""
    amount = named(col)
    return df.withColumn(out, amount.isNull() | F.isnan(amount) | (amount < minimum))


def flag_missing_amount(df: DataFrame, col: str, out: str) -> DataFrame:
    """Boolean `out`: missing or NaN. Negative amounts are not flagged."""
    amount = named(col)
    return df.withColumn(out, amount.isNull() | F.isnan(amount))
