"""Blocking by potential vorticity: its mean over the upper troposphere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .blocking import level_gradient, potential_temperature, potential_vorticity, relative_vorticity


def potential_vorticity_field(field: DataFrame, keys: list[str], dlon: float, t: str = "t", u: str = "u", v: str = "v", level: str = "lev") -> DataFrame:
    """(keys, lev, lon, lat, pv) of wind and temperature (K) on pressure levels (Pa), where the
    vorticity and the temperature's change with pressure are known."""
    at = [*keys, level, "lon", "lat"]
    turn = relative_vorticity(field, u, v, [*keys, level], dlon)
    theta = field.select(*at, potential_temperature(t, level).alias("theta"))
    change = level_gradient(theta, "theta", [*keys, "lon", "lat"], level).where("gradient IS NOT NULL")
    made = turn.join(change, at)
    return made.select(*at, potential_vorticity("vorticity", "gradient").alias("pv"))


def vertical_mean(field: DataFrame, value: str, keys: list[str], top: float, bottom: float, level: str = "lev") -> DataFrame:
    """(keys, mean): the mean over pressure between ``top`` and ``bottom`` by the trapezoidal rule.

    Values are linear between levels, so that layers the bounds cut count in part; null where
    the levels don't reach both bounds.
    """
    w = Window.partitionBy(*keys).orderBy(level)
    rows = field.where(F.col(value).isNotNull()).select(*keys, F.col(level).alias("p0"), F.col(value).alias("v0"), F.lead(level).over(w).alias("p1"), F.lead(value).over(w).alias("v1"))
    a, b = F.greatest("p0", F.lit(float(top))), F.least("p1", F.lit(float(bottom)))
    at = lambda p: F.col("v0") + (F.col("v1") - F.col("v0")) * (p - F.col("p0")) / (F.col("p1") - F.col("p0"))
    layers = rows.where(F.col("p1").isNotNull() & (F.col("p1") > top) & (F.col("p0") < bottom))
    sums = layers.groupBy(*keys).agg(F.sum((at(a) + at(b)) / 2 * (b - a)).alias("s"), F.sum(b - a).alias("d"))
    return sums.select(*keys, F.when(F.col("d") >= (bottom - top) * (1 - 1e-9), F.col("s") / F.col("d")).alias("mean"))


def blocking_pv(field: DataFrame, keys: list[str], dlon: float, top: float = 15000.0, bottom: float = 50000.0, polar: float = 10.0, **names) -> DataFrame:
    """(keys, lon, lat, vpv): potential vorticity averaged from ``bottom`` to ``top`` (Pa), 0 within
    ``polar`` degrees of the poles, where it is of no use for blocking."""
    pv = potential_vorticity_field(field, keys, dlon, **names)
    mean = vertical_mean(pv, "pv", [*keys, "lon", "lat"], top, bottom, names.get("level", "lev"))
    return mean.select(*keys, "lon", "lat", F.when(F.abs("lat") > 90 - polar, 0.0).otherwise(F.col("mean")).alias("vpv"))
