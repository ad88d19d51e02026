"""Aggregate expressions that add amounts exactly, whatever their size and order."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

MILLIONTH = Decimal("0.000001")
# Amounts below this have units that fit a 64-bit integer.
COUNTABLE = 1e18
# Units are added in two halves, so that their sum fits 64 bits for any number of rows.
HALF = 1 << 32


def percent(part: Column, whole: Column) -> Column:
    """`100 * part / whole` to two places, null when `whole` is 0."""
    return F.round(F.try_divide(F.lit(Decimal("100.0")) * part, whole), 2).cast("double")


def amount_parts(amount: Column) -> Column:
    """Aggregate of an amount that `merged_parts` can combine with those of other groups.

    Adding doubles gives another last digit for every row order. Amounts are added as whole numbers instead, units and
    millionths, at little more than the cost of adding doubles; a decimal per row costs ten times as much. What a row
    has beyond its millionths is added as a double (`rest`), and so is the whole of an amount from 10^18 on, an infinity
    or a NaN. For amounts of up to six decimals below 10^9 the rest is 0, and totals don't depend on the order.
    """
    amount = amount.cast("double")
    countable = F.abs(amount) < COUNTABLE
    units = F.when(countable, F.floor(amount)).otherwise(0)
    millionths = F.when(countable, F.floor((amount - units) * 1e6 + 0.5)).otherwise(0)
    known = F.when(F.abs(amount) < 1e9, (units * 1000000 + millionths) / F.lit(1e6)).otherwise(units + millionths / F.lit(1e6))
    high = F.floor(units / F.lit(float(HALF)))
    return F.struct(
        F.count(amount).alias("rows"),
        F.sum(high).alias("high"),
        F.sum(units - high * HALF).alias("low"),
        F.sum(millionths).alias("millionths"),
        F.sum(F.when(countable, amount - known).otherwise(amount)).alias("rest"),
    )


def merged_parts(parts: Column) -> Column:
    """Aggregate of `amount_parts` over groups: the parts of all their rows together."""
    return F.struct(*[F.sum(parts[name]).alias(name) for name in ("rows", "high", "low", "millionths", "rest")])


def _sum(parts: Column, rows: Column) -> Column:
    """Sum over `rows`, rounded to two places; null when there was no amount."""
    whole = parts["high"].cast("decimal(19,0)") * F.lit(Decimal(HALF)) + parts["low"].cast("decimal(19,0)")
    exact = (whole.cast("decimal(31,0)") + parts["millionths"].cast("decimal(20,0)") * MILLIONTH).cast("decimal(37,6)")
    # With no rest the decimal is rounded, else the double nearest to both parts.
    round_exact = F.round(F.try_divide(exact, rows), 2).cast("double")
    round_both = F.round(F.try_divide(exact.cast("double") + parts["rest"], rows.cast("double")), 2)
    return F.when(parts["rows"] > 0, F.when(parts["rest"] == 0, round_exact).otherwise(round_both))


def total_of(parts: Column) -> Column:
    """Sum to two places as double, null when there was no amount."""
    return _sum(parts, F.lit(1))


def mean_of(parts: Column) -> Column:
    """Mean to two places as double, null when there was no amount."""
    return _sum(parts, parts["rows"])


def exact_total(amount: Column) -> Column:
    return total_of(amount_parts(amount))


def exact_mean(amount: Column) -> Column:
    return mean_of(amount_parts(amount))
