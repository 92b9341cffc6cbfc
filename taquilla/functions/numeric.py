"""Arithmetic columns: shares, rounding, falsy defaults, money text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def percentage(part: Column, whole: Column, digits: int = 2) -> Column:
    """``part`` in percent of ``whole``, half away from zero; NULL where ``whole`` is 0.

    Computed in decimals, so a share on the rounding edge is exact.
    """
    divisor = F.when(whole != 0, whole).cast("decimal(20,0)")
    exact = part.cast("decimal(20,0)") * F.lit(100) / divisor
    return F.round(exact, digits).cast(f"decimal(20,{digits})")


def percentage_or_zero(part: Column, whole: Column, digits: int = 2) -> Column:
    """As ``percentage``, but 0 unless ``whole`` is positive."""
    return F.when(whole > 0, percentage(part, whole, digits)).otherwise(
        F.lit(0).cast(f"decimal(20,{digits})")
    )


def percent_text(value: Column) -> Column:
    return F.concat(value.cast("string"), F.lit("%"))


def round_half_up(value: Column) -> Column:
    """Nearest whole number, halves upwards (also below zero)."""
    return F.floor(value + F.lit(0.5).cast("decimal(2,1)")).cast("bigint")


def falsy_number(value: Column) -> Column:
    return value.isNull() | (value == 0)


def falsy_text(value: Column) -> Column:
    return value.isNull() | (value == "")


def number_or_zero(value: Column, dtype: str = "double") -> Column:
    """A number read from text or number; anything unreadable is 0."""
    return F.coalesce(value.try_cast(dtype), F.lit(0).cast(dtype))


def money_text(value: Column) -> Column:
    """Colombian peso text: ``$ 1.234.567,5`` with at most two decimals, none forced.

    The gap after the sign is a no-break space.
    """
    amount = F.round(value.cast("decimal(30,4)"), 2)
    plain = F.call_function("format_number", F.abs(amount), F.lit("#,##0.##"))
    swapped = F.translate(plain, ",.", ".,")
    return F.concat(F.when(amount < 0, F.lit("-")).otherwise(F.lit("")), F.lit("$\u00a0"), swapped)
