"""Dates of the calendars in climate data as integer expressions.

A date is columns year, month, day; only the standard calendars have timestamps for all dates.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geo import c

CALENDARS = ("standard", "gregorian", "julian", "noleap", "365_day", "360_day")
# Days before each month of a common year.
_BEFORE = (0, 31, 59, 90, 120, 151, 181, 212, 243, 273, 304, 334)


def leap(year, calendar: str = "standard") -> Column:
    y = c(year)
    if calendar in ("standard", "gregorian"):
        return (y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0))
    return y % 4 == 0 if calendar == "julian" else F.lit(False)


def day_of_year(year, month, day, calendar: str = "standard") -> Column:
    """1 for the first of January."""
    if calendar == "360_day":
        return (c(month) - 1) * 30 + c(day)
    before = F.element_at(F.array(*map(F.lit, _BEFORE)), c(month).cast("int"))
    return before + c(day) + F.when((c(month) > 2) & leap(year, calendar), 1).otherwise(0)


def day_number(year, month, day, calendar: str = "standard") -> Column:
    """Days since 1 January of year 1."""
    y = c(year).cast("long") - 1
    if calendar == "360_day":
        start = y * 360
    else:
        start = y * 365
        if calendar in ("standard", "gregorian"):
            start = start + F.floor(y / 4) - F.floor(y / 100) + F.floor(y / 400)
        elif calendar == "julian":
            start = start + F.floor(y / 4)
    return start + day_of_year(year, month, day, calendar) - 1


def seconds_between(a: tuple, b: tuple, calendar: str = "standard") -> Column:
    """Seconds from a to b; each (year, month, day, second of day)."""
    return (day_number(*b[:3], calendar) - day_number(*a[:3], calendar)) * 86400 + c(b[3]) - c(a[3])


def season(month) -> Column:
    """0 DJF, 1 MAM, 2 JJA, 3 SON."""
    return F.floor((c(month) % 12) / 3).cast("int")


def nearest_minute(seconds) -> Column:
    return F.floor((c(seconds) + 30) / 60) * 60
