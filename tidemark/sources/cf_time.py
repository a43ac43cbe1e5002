"""Times of the CF conventions: numbers since a date, and back."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.geo import c

# Seconds of the units.
_UNITS = {"day": 86400, "days": 86400, "hour": 3600, "hours": 3600, "minute": 60, "minutes": 60, "second": 1, "seconds": 1}


def _parts(units: str) -> tuple[int, str]:
    found = re.fullmatch(r"\s*(\w+)\s+since\s+(\d+)-(\d+)-(\d+)(?:[ T]+(\d+):(\d+)(?::(\d+)(?:\.\d*)?)?)?\s*Z?\s*", units)
    if not found or found[1] not in _UNITS:
        raise ValueError(f"not a time unit: {units}")
    y, mo, d, h, mi, s = (int(x or 0) for x in found.groups()[1:])
    return _UNITS[found[1]], f"{y:04d}-{mo:02d}-{d:02d} {h:02d}:{mi:02d}:{s:02d}"


def decode(value, units: str) -> Column:
    """Timestamp of the standard calendar, to the nearest minute, of "hours since 1990-01-01"."""
    scale, start = _parts(units)
    minutes = F.floor((c(value).cast("double") * scale + 30) / 60)
    return F.lit(start).cast("timestamp_ntz") + F.make_dt_interval(mins=minutes.cast("int"))


def encode(time, units: str) -> Column:
    scale, start = _parts(units)
    seconds = lambda t: F.unix_timestamp(t.cast("timestamp"))
    return (seconds(c(time)) - seconds(F.lit(start).cast("timestamp_ntz"))) / scale


def decode_characters(value) -> Column:
    """Timestamp of texts like 2001-02-03_04:05:06."""
    return F.to_timestamp_ntz(F.translate(c(value), "_", " "), F.lit("yyyy-MM-dd HH:mm:ss"))
