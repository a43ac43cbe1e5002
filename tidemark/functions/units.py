"""Conversion between units as affine column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column

from .geo import EARTH_RADIUS, GRAVITY, c

_DEG = 180 / 3.141592653589793

# Fixed values: (kind, factor, offset) so that factor * x + offset is in the kind's base unit.
UNITS = {
    "deg": ("angle", 1.0, 0.0), "rad": ("angle", _DEG, 0.0), "m": ("angle", _DEG / EARTH_RADIUS, 0.0), "km": ("angle", 1000 * _DEG / EARTH_RADIUS, 0.0),
    "K": ("temperature", 1.0, 0.0), "degC": ("temperature", 1.0, 273.15), "degF": ("temperature", 5 / 9, 459.67 * 5 / 9),
    "Pa": ("pressure", 1.0, 0.0), "hPa": ("pressure", 100.0, 0.0), "mb": ("pressure", 100.0, 0.0), "atm": ("pressure", 101325.0, 0.0),
    "sr": ("area", 1.0, 0.0), "m2": ("area", 1 / EARTH_RADIUS**2, 0.0), "km2": ("area", 1e6 / EARTH_RADIUS**2, 0.0),
    "m2/s2": ("geopotential", 1.0, 0.0), "gpm": ("geopotential", GRAVITY, 0.0),
    "kg/m2/s": ("rain", 1.0, 0.0), "mm/s": ("rain", 1.0, 0.0), "mm/day": ("rain", 1 / 86400, 0.0), "mm/hr": ("rain", 1 / 3600, 0.0), "m/s": ("rain", 1000.0, 0.0),
}


def convert(x, source: str, target: str) -> Column:
    """``x`` in ``source`` units as ``target`` units; lengths are arcs on the Earth."""
    (kind, a, b), (other, p, q) = UNITS[source], UNITS[target]
    if kind != other:
        raise ValueError(f"{source} is no unit of {other}")
    return (c(x) * a + b - q) / p


def value_and_unit(text: str) -> tuple[float, str]:
    """('5.5', 'km') of '5.5km'."""
    found = re.fullmatch(r"\s*([-+]?[\d.]+(?:[eE][-+]?\d+)?)\s*(\S*)\s*", text)
    if not found:
        raise ValueError(f"not a value: {text}")
    return float(found[1]), found[2]
