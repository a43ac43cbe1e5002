"""Field algebra: the pointwise operators as column functions. Null is missing and spreads."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geo import EARTH_RADIUS, OMEGA, c


def _all(args, value: Column) -> Column:
    """``value`` where no argument is null."""
    return F.when(reduce(lambda a, b: a & b, (c(x).isNotNull() for x in args)), value)


def vecmag(a, b) -> Column:
    return F.sqrt(c(a) * c(a) + c(b) * c(b))


def absolute(a) -> Column:
    return F.abs(c(a))


def sign(a) -> Column:
    return F.signum(c(a))


def allpos(*args) -> Column:
    """1 where every argument is above 0, else 0."""
    return _all(args, F.when(reduce(lambda a, b: a & b, (c(x) > 0 for x in args)), 1.0).otherwise(0.0))


def total(*args) -> Column:
    return reduce(lambda a, b: a + b, map(c, args))


def average(*args) -> Column:
    return total(*args) / len(args)


def diff(a, b) -> Column:
    return c(a) - c(b)


def prod(*args) -> Column:
    return reduce(lambda a, b: a * b, map(c, args))


def div(a, b) -> Column:
    """a / b in IEEE arithmetic: a field of 0 below gives an infinity, or NaN for 0 / 0."""
    x, y = c(a).cast("double"), c(b).cast("double")
    by_zero = F.when(x > 0, F.lit(float("inf"))).when(x < 0, F.lit(float("-inf"))).otherwise(F.lit(float("nan")))
    return _all((x, y), F.when(y == 0, by_zero).otherwise(F.try_divide(x, y)))


def minimum(*args) -> Column:
    return _all(args, F.least(*map(c, args)))


def maximum(*args) -> Column:
    return _all(args, F.greatest(*map(c, args)))


def cond(test, yes, no) -> Column:
    return F.when(c(test) > 0, c(yes)).when(c(test).isNotNull(), c(no))


def equals(a, b) -> Column:
    return (c(a) == c(b)).cast("double")


def root(a) -> Column:
    return F.sqrt(c(a))


def power(a, b) -> Column:
    return F.pow(c(a), c(b))


def latitude(lat="lat") -> Column:
    return c(lat)


def longitude(lon="lon") -> Column:
    return c(lon)


def area(sr="area") -> Column:
    """Cell area in square metres from steradians."""
    return c(sr) * EARTH_RADIUS**2


def coriolis(lat="lat") -> Column:
    return 2 * OMEGA * F.sin(F.radians(c(lat)))


def celsius(t, unit: str) -> Column:
    if unit == "degC":
        return c(t)
    if unit == "degF":
        return (c(t) - 32) * 5 / 9
    if unit == "K":
        return c(t) - 273.15
    raise ValueError(f"unit of temperature: {unit}")


def daily_chill_hours(tmin, tmax, unit: str) -> Column:
    """Hours of a day between 32 and 45 degF when temperature is a triangle between its extremes."""
    low, high = celsius(tmin, unit) * 9 / 5 + 32, celsius(tmax, unit) * 9 / 5 + 32
    below = lambda limit: F.when(high <= limit, 24.0).when(low >= limit, 0.0).otherwise(24 * (limit - low) / (high - low))
    return _all((tmin, tmax), below(45.0) - below(32.0))


def relative_humidity(td, ta, unit: str) -> Column:
    """Percent, from dew point and temperature."""
    d, t = celsius(td, unit), celsius(ta, unit)
    return 100 * F.exp(17.1 * d / (235 + d) - 17.1 * t / (235 + t))


def saturation_pressure(t) -> Column:
    """hPa over water at t degC."""
    return 6.1094 * F.exp(17.625 * c(t) / (c(t) + 243.04))


def vpd_from_humidity(ta, hur, unit: str) -> Column:
    """Vapour pressure deficit (hPa) from temperature and relative humidity."""
    return saturation_pressure(celsius(ta, unit)) * (1 - c(hur) / 100)


def vpd_from_specific_humidity(ta, hus, pres, unit: str) -> Column:
    """Vapour pressure deficit (hPa) from temperature, specific humidity and pressure (Pa)."""
    q = c(hus)
    return saturation_pressure(celsius(ta, unit)) - q * c(pres) / 100 / (0.6221 + 0.3779 * q)


#: Operators by the names that users know them by.
OPS = {
    "_VECMAG": vecmag, "_ABS": absolute, "_SIGN": sign, "_ALLPOS": allpos, "_SUM": total, "_AVG": average, "_DIFF": diff, "_PROD": prod,
    "_DIV": div, "_MIN": minimum, "_MAX": maximum, "_COND": cond, "_EQUALS": equals, "_SQRT": root, "_POW": power, "_LAT": latitude, "_LON": longitude,
    "_AREA": area, "_F": coriolis, "_DAILYCHILLHOURS": daily_chill_hours, "_RELHUMFROMTDTA": relative_humidity, "_VPDFROMTAHUR": vpd_from_humidity,
    "_VPDFROMTAHUSPRES": vpd_from_specific_humidity,
}
