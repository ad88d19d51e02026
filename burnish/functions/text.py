"""Names, phone numbers and multi-value text fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def named(name: str) -> Column:
    """Column by its exact name, also for names such as `device_id(s)` or `a.b`."""
    return F.col("`" + name.replace("`", "``") + "`")


def proper_case(text: Column) -> Column:
    """Outer spaces removed, every word capitalised, the rest in lower case."""
    return F.initcap(F.trim(text))


def phone_digits(text: Column, extension_mark: str = "x") -> Column:
    """All digits in front of the extension."""
    return F.regexp_replace(F.substring_index(text, extension_mark, 1), "[^0-9]", "")


def phone_number(digits: Column, keep: int = 10) -> Column:
    """The last `keep` digits; all of them when there are fewer."""
    return F.right(digits, F.lit(keep))


def list_items(text: Column, sep: str = ";", keep_empty: bool = False) -> Column:
    """Items of a separated list. A trailing separator adds no item unless `keep_empty`."""
    items = F.split(text, "\\Q" + sep + "\\E")
    return items if keep_empty else F.array_remove(items, "")
