"""Calendar and solar-time expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def calendar(ts: Column) -> dict[str, Column]:
    """Calendar parts and daylight marks; Monday is day 0 of the week."""
    hour, weekday = F.hour(ts), F.weekday(ts)
    return {
        "hour": hour,
        "day_of_year": F.dayofyear(ts),
        "month": F.month(ts),
        "year": F.year(ts),
        "day_of_week": weekday,
        "is_daylight": hour.between(6, 18).cast("int"),
        "is_peak_sunlight": hour.between(10, 16).cast("int"),
        "is_weekend": (weekday >= 5).cast("int"),
    }


def cyclic(value: Column, period: int, name: str) -> dict[str, Column]:
    """Sine and cosine of a value that repeats with ``period``."""
    angle = value * F.lit(2.0) * F.pi() / F.lit(float(period))
    return {f"{name}_sin": F.sin(angle), f"{name}_cos": F.cos(angle)}


def solar(ts: Column) -> dict[str, Column]:
    """Hour and day of solar time with their cyclic forms."""
    hour, day = F.hour(ts), F.dayofyear(ts)
    return {
        "solar_hour": hour,
        "solar_day_of_year": day,
        **cyclic(hour, 24, "solar_hour"),
        **cyclic(day, 365, "solar_day"),
    }


def civil_cycles(ts: Column) -> dict[str, Column]:
    """Cyclic forms of hour and day of the year in civil time."""
    return {**cyclic(F.hour(ts), 24, "hour"), **cyclic(F.dayofyear(ts), 365, "day")}


def season(month: Column) -> Column:
    """1 for December to February, 2 spring, 3 summer, 4 autumn."""
    return (F.floor((month % 12) / 3) + 1).cast("int")


def ten_day_bin(day_of_year: Column) -> Column:
    return (F.floor(day_of_year / 10) * 10).cast("int")
