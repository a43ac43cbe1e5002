"""The blocking pipeline: gradient index, anomalies, thresholds, smoothing, trends."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.geo import OMEGA
from .climate import harmonics, period_index

# Fixed value: the radius of the Earth (m) in this part of the analysis.
RADIUS = 6_371_000.0


def gradient_index(field: DataFrame, value: str, step: float = 15.0, limit: float = -10.0) -> DataFrame:
    """(time, lon, lat, south, north, blocked): height gradients to both sides by two equi-joins.

    In the north blocked means a rise towards the equator side above 0 and one beyond below
    ``limit`` (per degree); the south mirrors it. Latitudes from 25 to 75 count.
    """
    own = field.select("time", "lon", "lat", F.col(value).alias("z0"))
    to = lambda d, name: field.select("time", "lon", (F.col("lat") + d).alias("lat"), F.col(value).alias(name))
    at = own.where(F.abs("lat").between(25, 75)).join(to(step, "zs"), ["time", "lon", "lat"]).join(to(-step, "zn"), ["time", "lon", "lat"])
    g = at.select("time", "lon", "lat", ((F.col("z0") - F.col("zs")) / step).alias("south"), ((F.col("zn") - F.col("z0")) / step).alias("north"))
    return g.withColumn("blocked", F.when(F.col("lat") > 0, (F.col("south") > 0) & (F.col("north") < limit)).otherwise((F.col("north") < 0) & (F.col("south") > -limit)))


def potential_temperature(t, p) -> Column:
    """From kelvin and pascal."""
    return F.col(t) * F.pow(100000.0 / F.col(p), 2 / 7)


def relative_vorticity(field: DataFrame, u: str, v: str, keys: list[str], dlon: float) -> DataFrame:
    """(keys, lon, lat, vorticity) by centred differences along rows and columns of lat-lon cells,
    round in longitude; none at the first and last latitude."""
    a = Window.partitionBy(*keys, "lat").orderBy("lon")
    whole = a.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    b = Window.partitionBy(*keys, "lon").orderBy("lat")
    cos = F.cos(F.radians("lat"))
    rows = field.select(*keys, "lon", "lat", u, v).withColumn("v2", F.coalesce(F.lead(v).over(a), F.first(v).over(whole))).withColumn("v1", F.coalesce(F.lag(v).over(a), F.last(v).over(whole)))
    flux = F.col(u) * cos
    rows = rows.withColumn("_f", flux).withColumn("f2", F.lead("_f").over(b)).withColumn("f1", F.lag("_f").over(b)).withColumn("y2", F.lead("lat").over(b)).withColumn("y1", F.lag("lat").over(b))
    dx = F.radians(F.lit(2 * dlon)) * RADIUS * cos
    made = (F.col("v2") - F.col("v1")) / dx - (F.col("f2") - F.col("f1")) / (F.radians(F.col("y2") - F.col("y1")) * RADIUS * cos)
    return rows.select(*keys, "lon", "lat", made.alias("vorticity")).where("vorticity IS NOT NULL")


def potential_vorticity(vorticity, dtheta_dp, lat="lat") -> Column:
    """-g (f + vorticity) d theta / d p."""
    return -9.80616 * (2 * OMEGA * F.sin(F.radians(lat)) + F.col(vorticity)) * F.col(dtheta_dp)


def level_gradient(field: DataFrame, value: str, keys: list[str], level: str = "lev") -> DataFrame:
    """(keys, level, gradient) by centred differences over levels, one-sided at the ends."""
    w = Window.partitionBy(*keys).orderBy(level)
    up, down = F.coalesce(F.lead(value).over(w), F.col(value)), F.coalesce(F.lag(value).over(w), F.col(value))
    high, low = F.coalesce(F.lead(level).over(w), F.col(level)), F.coalesce(F.lag(level).over(w), F.col(level))
    return field.select(*keys, level, F.try_divide(up - down, high - low).alias("gradient"))


def hybrid_to_pressure(field: DataFrame, value: str, keys: list[str], wanted: list[float]) -> DataFrame:
    """(keys, target, value) on pressures, from levels at hyam * 1e5 + hybm * ps."""
    from .climate import interpolate_levels

    return interpolate_levels(field.withColumn("_p", F.col("hyam") * 1e5 + F.col("hybm") * F.col("ps")), value, keys, "_p", wanted)


def _day(time: str = "time") -> Column:
    return period_index("daily", time)


def day_of_year_mean(field: DataFrame, value: str, modes: int | None = None) -> DataFrame:
    """(cell, day, mean) over years without leap days; with ``modes`` only so many harmonics."""
    rows = field.where(~((F.month("time") == 2) & (F.dayofmonth("time") == 29)))
    mean = rows.groupBy("cell", _day().alias("day")).agg(F.avg(value).alias("mean"))
    if modes is None:
        return mean
    return harmonics(mean.withColumn("k", F.col("day") - 1), "mean", "k", ["cell"], modes, 365).select("cell", (F.col("k") + 1).alias("day"), F.col("smooth").alias("mean"))


def anomalies(field: DataFrame, value: str, mean: DataFrame) -> DataFrame:
    """(time, cell, anomaly) from a day-of-year mean; leap days use 28 February's."""
    return field.withColumn("day", _day()).join(mean, ["cell", "day"]).select("time", "cell", (F.col(value) - F.col("mean")).alias("anomaly"))


def height_scale(lat="lat") -> Column:
    """sin 45 / |sin lat|, with the latitude held in [5, 85]."""
    return math.sin(math.pi / 4) / F.sin(F.radians(F.greatest(F.lit(5.0), F.least(F.lit(85.0), F.abs(F.col(lat))))))


def two_day_mean(field: DataFrame, value: str, steps: int, keys: list[str] = ["cell"]) -> DataFrame:  # noqa: B006
    """Mean over samples [t - steps, t + steps - 1]; samples without the whole window stay."""
    w = Window.partitionBy(*keys).orderBy("time")
    frame = w.rowsBetween(-steps, steps - 1)
    mean = F.when(F.count("*").over(frame) == 2 * steps, F.avg(value).over(frame)).otherwise(F.col(value))
    return field.select(*keys, "time", mean.alias("smooth"))


def running_mean(field: DataFrame, value: str, half: int, keys: list[str] = ["cell"], order: str = "day") -> DataFrame:  # noqa: B006
    """Centred mean of 2 * half + 1 samples, fewer at the ends."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-half, half)
    return field.select(*keys, order, F.avg(value).over(w).alias("smooth"))


def variable_threshold(anomaly: DataFrame, factor: float = 1.5, modes: int = 8, floor: float | None = None) -> DataFrame:
    """(cell, day, threshold): factor times the RMS anomaly by day of year, smoothed in time."""
    rms = anomaly.groupBy("cell", _day().alias("day")).agg((factor * F.sqrt(F.avg(F.col("anomaly") ** 2))).alias("t"))
    smooth = harmonics(rms.withColumn("k", F.col("day") - 1), "t", "k", ["cell"], modes, 365).select("cell", (F.col("k") + 1).alias("day"), "smooth")
    return smooth.select("cell", "day", (F.greatest("smooth", F.lit(floor)) if floor is not None else F.col("smooth")).alias("threshold"))


def smoothed_threshold(level: DataFrame, n_lon: int, n_lat: int, n_time: int, modes: tuple = (2, 2, 8), floor: float | None = None) -> DataFrame:
    """(i, j, day, threshold): a threshold t by grid place and day (from 0), of which the first
    harmonics stay along longitude, along latitude in each hemisphere, and in time, in turn."""
    east = harmonics(level, "t", "i", ["j", "day"], modes[0], n_lon).withColumnRenamed("smooth", "t")
    half = n_lat // 2
    sides = east.withColumn("south", F.col("j") < half).withColumn("row", F.when(F.col("j") < half, F.col("j")).otherwise(F.col("j") - half))
    north = harmonics(sides, "t", "row", ["south", "i", "day"], modes[1], half)
    back = north.select("i", F.when(F.col("south"), F.col("row")).otherwise(F.col("row") + half).alias("j"), "day", F.col("smooth").alias("t"))
    made = harmonics(back, "t", "day", ["i", "j"], modes[2], n_time)
    return made.select("i", "j", "day", (F.greatest("smooth", F.lit(floor)) if floor is not None else F.col("smooth")).alias("threshold"))


def normalised(anomaly: DataFrame, threshold: DataFrame, least: float, southern_sign: int = 1, northern_sign: int = 1) -> DataFrame:
    """(time, cell, level): the whole part of the signed anomaly over its threshold, 0 if below.

    ``anomaly`` has lat; 25 to 75 degrees count. Heights take sign 1 on both sides, potential
    vorticity -1 in the north.
    """
    at = anomaly.withColumn("day", _day()).join(threshold, ["cell", "day"])
    signed = F.when(F.col("lat") > 0, northern_sign).otherwise(southern_sign) * F.col("anomaly") / F.greatest("threshold", F.lit(least))
    level = F.when(F.abs("lat").between(25, 75) & (signed > 0), F.floor(signed)).otherwise(0)
    return at.select("time", "cell", level.cast("int").alias("level"))


def detrend(field: DataFrame, value: str, centre: int) -> DataFrame:
    """(time, cell, detrended): less slope * (year - centre) of the line through the years of
    each (cell, day of year)."""
    rows = field.select("time", "cell", F.col(value).alias("x"), _day().alias("day"), F.year("time").alias("y"))
    fit = rows.groupBy("cell", "day").agg(F.coalesce(F.regr_slope("x", "y"), F.lit(0.0)).alias("slope"))
    return rows.join(fit, ["cell", "day"]).select("time", "cell", (F.col("x") - F.col("slope") * (F.col("y") - centre)).alias("detrended"))


def fill_along_longitude(field: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """Missing values between known ones of a row become linear in longitude; no wrap."""
    w = Window.partitionBy(*keys).orderBy("lon")
    last = w.rowsBetween(Window.unboundedPreceding, 0)
    next_ = w.rowsBetween(0, Window.unboundedFollowing)
    here = F.when(F.col(value).isNotNull(), F.struct(F.col("lon").alias("x"), F.col(value).alias("v")))
    rows = field.withColumn("_a", F.last(here, ignorenulls=True).over(last)).withColumn("_b", F.first(here, ignorenulls=True).over(next_))
    between = F.col("_a.v") + (F.col("_b.v") - F.col("_a.v")) * F.try_divide(F.col("lon") - F.col("_a.x"), F.col("_b.x") - F.col("_a.x"))
    return rows.select(*keys, "lon", F.coalesce(F.col(value), between).alias("filled"))


def at_hour(field: DataFrame, hour: int) -> DataFrame:
    return field.where(F.hour("time") == hour)


def split_at(field: DataFrame, moment: str) -> tuple[DataFrame, DataFrame]:
    """Rows before a time, and from it on."""
    cut = F.lit(moment).cast("timestamp_ntz")
    return field.where(F.col("time") < cut), field.where(F.col("time") >= cut)


def at_level(field: DataFrame, level: float, geopotential: str | None = None) -> DataFrame:
    """Rows of one level; a geopotential column becomes a height."""
    rows = field.where(F.col("lev") == level).drop("lev")
    return rows.withColumn(geopotential, F.col(geopotential) / 9.8) if geopotential else rows
