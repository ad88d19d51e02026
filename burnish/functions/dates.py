"""Dates written as text."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from burnish.rules import FLAG_MISSING, FLAG_OK, FLAG_SENTINEL


def sentinel_label(text: Column, sentinels: Sequence[str]) -> Column:
    """`missing` for null, `sentinel_placeholder` for a known filler value, else `ok`."""
    return (
        F.when(text.isNull(), FLAG_MISSING)
        .when(text.isin(list(sentinels)), FLAG_SENTINEL)
        .otherwise(FLAG_OK)
    )


# Digits that each field of a fixed-width format may hold. Month and day are checked by the date itself.
FIELDS = {
    "yyyy": "[0-9]{4}",
    "MM": "[0-9]{2}",
    "dd": "[0-9]{2}",
    "HH": "(?:[01][0-9]|2[0-3])",
    "mm": "[0-5][0-9]",
    "ss": "[0-5][0-9]",
}


def to_date_any(text: Column, formats: Sequence[str]) -> Column:
    """Date by the first format that fits the whole text, else null.

    Spark's pattern parser goes through a timestamp and raises and catches an exception for every text
    that does not fit. For formats of fixed width a length, a regular expression and a cast say the same
    at a fraction of the cost; other formats are left to the parser.
    """
    return F.coalesce(*[_date_of(text, fmt) for fmt in formats])


def _date_of(text: Column, date_format: str) -> Column:
    pattern, starts, width = "", {}, 0
    for token in re.finditer(r"'(?P<quoted>[^']*)'|(?P<field>(?P<letter>[A-Za-z])(?P=letter)*)|(?P<mark>.)", date_format):
        field = token["field"]
        if field is None:
            literal = token["quoted"] or token["mark"]
            pattern, width = pattern + re.escape(literal), width + len(literal)
        elif field in FIELDS or set(field) == {"S"}:
            starts[field] = width + 1
            pattern, width = pattern + FIELDS.get(field, f"[0-9]{{{len(field)}}}"), width + len(field)
        else:
            return F.try_to_date(text, date_format)
    if not {"yyyy", "MM", "dd"} <= starts.keys():
        return F.try_to_date(text, date_format)
    iso = F.concat_ws("-", *[F.substring(text, starts[f], len(f)) for f in ("yyyy", "MM", "dd")])
    return F.when((F.length(text) == width) & text.rlike(f"^{pattern}$"), iso.try_cast("date"))
