"""Reductions over time of each cell: climatologies, accumulations, quantiles, harmonics."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.calendars import season
from .nodes import compare

PERIODS = ("daily", "monthly", "seasonal", "annual", "all")


def period_index(period: str, time: str = "time") -> Column:
    """Index of a sample's period: day of a 365-day year, month, season, or 0."""
    t = F.col(time)
    if period == "daily":
        leap = (F.year(t) % 4 == 0) & ((F.year(t) % 100 != 0) | (F.year(t) % 400 == 0))
        return F.dayofyear(t) - F.when(leap & (F.month(t) > 2), 1).otherwise(0)
    if period == "monthly":
        return F.month(t)
    return season(F.month(t)) if period == "seasonal" else F.lit(0)


def period_instance(period: str, time: str = "time") -> Column:
    """The instance that a sample is in: its year, where December counts to the next one's winter."""
    if period == "all":
        return F.lit(0)
    late = F.when(F.month(time) == 12, 1).otherwise(0) if period == "seasonal" else F.lit(0)
    return F.year(time) + late


def _prepared(field: DataFrame, value: str, period: str, leap_days: bool) -> DataFrame:
    rows = field.where(F.col(value).isNotNull())
    if not leap_days:
        rows = rows.where(~((F.month("time") == 2) & (F.dayofmonth("time") == 29)))
    return rows.select("cell", period_index(period).cast("int").alias("idx"), period_instance(period).cast("int").alias("instance"), "time", F.col(value).alias("x"))


def climatology(field: DataFrame, value: str, period: str, leap_days: bool = False) -> DataFrame:
    """(cell, idx, mean, meansq, stddev, min, max, count) by period index."""
    x = F.col("x")
    return _prepared(field, value, period, leap_days).groupBy("cell", "idx").agg(F.avg(x).alias("mean"), F.avg(x * x).alias("meansq"), F.stddev_samp(x).alias("stddev"), F.min(x).alias("min"), F.max(x).alias("max"), F.count(x).alias("count"))


def climatology_of_instances(field: DataFrame, value: str, period: str, made: dict[str, Column], leap_days: bool = False) -> DataFrame:
    """Mean over the instances of a period of what is aggregated within each: a group-by of
    (instance, period, cell), then one of (period, cell). ``made`` is over column x."""
    inner = _prepared(field, value, period, leap_days).groupBy("cell", "idx", "instance").agg(*(v.alias(k) for k, v in made.items()))
    return inner.groupBy("cell", "idx").agg(*(F.avg(k).alias(k) for k in made))


def excess(op: str, limit: float) -> Column:
    """Sum of what lies beyond a threshold, for ``threshsum``."""
    return F.sum(F.greatest((F.col("x") - limit) if op == ">" else (limit - F.col("x")), F.lit(0.0)))


def time_until(field: DataFrame, value: str, period: str, op: str, limit: float) -> DataFrame:
    """Mean over instances of the samples before the first that satisfies; all of them if none."""
    w = Window.partitionBy("cell", "idx", "instance").orderBy("time")
    rows = _prepared(field, value, period, False).withColumn("k", F.row_number().over(w) - 1)
    per = rows.groupBy("cell", "idx", "instance").agg(F.coalesce(F.min(F.when(compare("x", op, limit), F.col("k"))), F.count("*")).alias("n"))
    return per.groupBy("cell", "idx").agg(F.avg("n").alias("timeuntil"))


def longest_run(field: DataFrame, value: str, period: str, op: str, limit: float) -> DataFrame:
    """Mean over instances of the longest run of samples that satisfy."""
    by = ["cell", "idx", "instance"]
    w = Window.partitionBy(*by).orderBy("time").rowsBetween(Window.unboundedPreceding, 0)
    good = compare("x", op, limit)
    rows = _prepared(field, value, period, False).withColumn("run", F.sum(F.when(good, 0).otherwise(1)).over(w))
    runs = rows.groupBy(*by, "run").agg(F.count_if(good).alias("n"))
    return runs.groupBy(*by).agg(F.max("n").alias("n")).groupBy("cell", "idx").agg(F.avg("n").alias("maxconsec"))


def autocorrelation(field: DataFrame, value: str, period: str, lag: int) -> DataFrame:
    """Mean over instances of the lag correlation of samples within one; 1 without variance."""
    by = ["cell", "idx", "instance"]
    rows = _prepared(field, value, period, False).withColumn("y", F.lag("x", lag).over(Window.partitionBy(*by).orderBy("time"))).where("y IS NOT NULL")
    x, y = F.col("x"), F.col("y")
    s = rows.groupBy(*by).agg(F.count("*").alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(x * x).alias("sxx"), F.sum(y * y).alias("syy"), F.sum(x * y).alias("sxy"))
    n = F.col("n")
    vx, vy = n * F.col("sxx") - F.col("sx") ** 2, n * F.col("syy") - F.col("sy") ** 2
    flat = (vx <= 1e-9 * n * F.col("sxx")) | (vy <= 1e-9 * n * F.col("syy"))
    r = F.when(flat, 1.0).otherwise((n * F.col("sxy") - F.col("sx") * F.col("sy")) / F.sqrt(vx * vy))
    return s.withColumn("r", r).groupBy("cell", "idx").agg(F.avg("r").alias("autocor"))


def quantile(field: DataFrame, value: str, q: float, low: float | None = None, high: float | None = None) -> DataFrame:
    """(cell, quantile): the order statistic of rank floor((n - 1) q), without interpolation.

    Exact by a sort within cells; samples outside [low, high] don't count.
    """
    rows = field.where(F.col(value).isNotNull())
    rows = rows.where(F.col(value) >= low) if low is not None else rows
    rows = rows.where(F.col(value) <= high) if high is not None else rows
    w = Window.partitionBy("cell")
    ranked = rows.select("cell", F.col(value).alias("quantile"), (F.row_number().over(w.orderBy(value)) - 1).alias("k"), F.count("*").over(w).alias("n"))
    return ranked.where(F.col("k") == F.floor((F.col("n") - 1) * q)).select("cell", "quantile")


def quantile_approximate(field: DataFrame, value: str, q: float, accuracy: int = 10_000) -> DataFrame:
    """As :func:`quantile` within 1 / accuracy of the rank, in one pass with merged sketches."""
    return field.groupBy("cell").agg(F.percentile_approx(value, q, accuracy).alias("quantile"))


def bucket_start(freq: str, time: str = "time", offset_hours: int = 0) -> Column:
    """Start of the accumulation bucket: 1h, 3h, 6h, daily (from an hour), monthly, annual, wateryear."""
    t = F.col(time)
    if freq in ("1h", "3h", "6h"):
        n = int(freq[0])
        return F.date_trunc("day", t).cast("timestamp_ntz") + F.make_dt_interval(hours=(F.floor(F.hour(t) / n) * n).cast("int"))
    if freq == "daily":
        shift = F.make_dt_interval(hours=F.lit(offset_hours))
        return F.date_trunc("day", t - shift).cast("timestamp_ntz") + shift
    if freq == "wateryear":
        return F.make_timestamp_ntz(F.year(t) - F.when(F.month(t) < 10, 1).otherwise(0), F.lit(10), F.lit(1), F.lit(0), F.lit(0), F.lit(0))
    return F.date_trunc({"monthly": "month", "annual": "year"}[freq], t).cast("timestamp_ntz")


def accumulate(field: DataFrame, value: str, freq: str, op: str = "sum", offset_hours: int = 0) -> DataFrame:
    """(cell, bucket, value) by sum, avg, min or max of what isn't missing."""
    return field.groupBy("cell", bucket_start(freq, "time", offset_hours).alias("bucket")).agg(getattr(F, op)(value).alias("value"))


def accumulate_forecast(field: DataFrame, value: str, freq: str) -> DataFrame:
    """As :func:`accumulate` on the valid time: the initial time plus the forecast hour.

    ``field`` has initial, hour, cell; of several forecasts for a time the latest counts.
    """
    valid = field.withColumn("time", F.col("initial") + F.make_dt_interval(hours=F.col("hour").cast("int")))
    last = valid.groupBy("cell", "time").agg(F.max_by(value, "initial").alias("_v"))
    return accumulate(last, "_v", freq)


def harmonics(field: DataFrame, value: str, position: str, keys: list[str], modes: int, n: int | None = None) -> DataFrame:
    """(keys, position, smooth): the mean and the first ``modes`` - 1 harmonics of a series.

    ``position`` counts samples of a series from 0 and n is its length (all positions filled if
    None: each series's own count). Coefficients are sums by key; series come back by a join.
    """
    rows = field.select(*keys, position, F.col(value).alias("x"))
    size = F.lit(n) if n else F.count("*").over(Window.partitionBy(*keys))
    rows = rows.withColumn("_n", size)
    turn = lambda k: 2 * math.pi * k * F.col(position) / F.col("_n")
    sums = [F.sum("x").alias("a0"), F.max("_n").alias("_m")]
    for k in range(1, modes):
        sums += [F.sum(F.col("x") * F.cos(turn(k))).alias(f"a{k}"), F.sum(F.col("x") * F.sin(turn(k))).alias(f"b{k}")]
    coeff = rows.groupBy(*keys).agg(*sums)
    back = rows.join(coeff, keys)
    # at half the length a harmonic is its own mirror and counts once
    parts = [F.when(F.lit(2 * k) == F.col("_n"), 1.0).when(F.lit(2 * k) < F.col("_n"), 2.0).otherwise(0.0) * (F.col(f"a{k}") * F.cos(turn(k)) + F.col(f"b{k}") * F.sin(turn(k))) for k in range(1, modes)]
    return back.select(*keys, position, (reduce(lambda a, b: a + b, [F.col("a0"), *parts]) / F.col("_n")).alias("smooth"))


def integrate_levels(field: DataFrame, value: str, keys: list[str], level: str) -> DataFrame:
    """(keys, integral): trapezoid over the level column, between the levels that have values."""
    w = Window.partitionBy(*keys).orderBy("p")
    rows = field.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("v"), F.col(level).alias("p"))
    pair = rows.withColumn("p2", F.lead("p").over(w)).withColumn("v2", F.lead("v").over(w))
    return pair.groupBy(*keys).agg(F.sum(F.abs(F.col("p2") - F.col("p")) * (F.col("v") + F.col("v2")) / 2).alias("integral"))


def integrate_bounds(field: DataFrame, value: str, keys: list[str], lower: str, upper: str) -> DataFrame:
    """(keys, integral): sum of |upper - lower| * value, as for a * p0 + b * ps at cell bounds."""
    return field.groupBy(*keys).agg(F.sum(F.abs(F.col(upper) - F.col(lower)) * F.col(value)).alias("integral"))


def interpolate_levels(field: DataFrame, value: str, keys: list[str], level: str, wanted: list[float]) -> DataFrame:
    """(keys, target, value): linear in the level between its neighbours; none outside."""
    w = Window.partitionBy(*keys).orderBy("p")
    rows = field.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("v"), F.col(level).alias("p"))
    pair = rows.withColumn("p2", F.lead("p").over(w)).withColumn("v2", F.lead("v").over(w)).withColumn("target", F.explode(F.array(*map(F.lit, wanted))))
    inside = pair.where(((F.col("p") <= F.col("target")) & (F.col("target") < F.col("p2"))) | ((F.col("p") == F.col("target")) & F.col("p2").isNull()))
    return inside.select(*keys, "target", F.coalesce(F.col("v") + (F.col("v2") - F.col("v")) * (F.col("target") - F.col("p")) / (F.col("p2") - F.col("p")), F.col("v")).alias("value"))
