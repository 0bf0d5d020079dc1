"""Rounding, ratios and growth, as the reports define them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_even(value: Column, digits: int) -> Column:
    """Rounds halves to the even neighbour, which other engines and Python agree on."""
    scale = float(10**digits)
    return F.rint(value * scale) / scale


def ratio(part: Column, whole: Column, digits: int | None = None, times: float = 1.0) -> Column:
    """``part * times / whole``, null where the whole is 0."""
    value = F.try_divide(part.cast("double") * times, whole.cast("double"))
    return value if digits is None else half_even(value, digits)


def percent(part: Column, whole: Column, digits: int) -> Column:
    return ratio(part, whole, digits, 100.0)


def growth(now: Column, before: Column, digits: int = 2) -> Column:
    """Change in percent against an earlier value; null where that is 0 or missing."""
    return half_even(F.try_divide((now - before).cast("double") * 100.0, before.cast("double")), digits)
