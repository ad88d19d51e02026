"""Numbers written as text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Decimal notation with an optional exponent. `Infinity`, `NaN` and Java suffixes such as `12d` are
# no amounts although a plain cast would accept them.
PLAIN_NUMBER = r"^\s*[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?\s*$"


def null_if_token(text: Column, tokens: Sequence[str]) -> Column:
    """Null for blank text and for words that stand for "no value", else the text unchanged."""
    return F.when(~F.lower(F.trim(text)).isin(["", *tokens]), text)


def is_plain_number(text: Column) -> Column:
    return text.rlike(PLAIN_NUMBER)


def bare_number(text: Column) -> Column:
    """Without outer spaces and thousands commas."""
    return F.replace(F.trim(text), F.lit(","), F.lit(""))


def to_number(bare: Column, plain_only: bool = True) -> Column:
    """Double from the text of `bare_number`, null when it is no number."""
    number = bare.try_cast("double")
    return F.when(is_plain_number(bare), number) if plain_only else number
