"""Numeric expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_one(value: Column) -> Column:
    """One decimal, rounding the exact binary value (``round`` would round its decimal rendering)."""
    return F.regexp_replace(F.format_number(value, 1), ",", "").cast("double")


def round_whole(value: Column) -> Column:
    return F.bround(value, 0)


def clip(value: Column, low: float, high: float) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), value))


def above_floor(value: Column, floor: float) -> Column:
    """Rescale [floor, 1] to [0, 1], clipped."""
    return clip((value - floor) / (1.0 - floor), 0.0, 1.0)


def saturation(count: Column) -> Column:
    return 1.0 - F.exp(-count / 2.0)


def days_between(later: Column, earlier: Column) -> Column:
    """Whole calendar days, null when either side is missing."""
    return F.datediff(F.to_date(later), F.to_date(earlier))


def is_score(value: Column) -> Column:
    """Public score: finite and either the missing sentinel or within 0..100."""
    return F.coalesce(~F.isnan(value) & ((value == -1) | value.between(0, 100)), F.lit(False))


def is_probability(value: Column) -> Column:
    return F.coalesce(~F.isnan(value) & value.between(0, 1), F.lit(False))
