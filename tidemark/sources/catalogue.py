"""A table of which file holds which time, and lookups in it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.stitch import nearest_in_time


def build(rows: DataFrame, path: str = "path", time: str = "time") -> DataFrame:
    """(time, path, rows): one entry a time and file, from rows that carry both."""
    return rows.groupBy(F.col(time).alias("time"), F.col(path).alias("path")).agg(F.count("*").alias("rows"))


def at_time(catalogue: DataFrame, wanted: DataFrame) -> DataFrame:
    """Entries at the wanted times (time); a time in several files counts with the first path."""
    one = catalogue.groupBy("time").agg(F.min("path").alias("path"))
    return wanted.join(one, "time")


def near_time(catalogue: DataFrame, wanted: DataFrame, tolerance_s: int) -> DataFrame:
    """(id, t, t2, path): the entry nearest in time to each wanted (id, t) within a tolerance;
    times are seconds."""
    return nearest_in_time(wanted, catalogue.select(F.col("time").alias("t2"), "path").groupBy("t2").agg(F.min("path").alias("path")), tolerance_s, [])


def on_climatology(wanted: DataFrame, climatology: DataFrame) -> DataFrame:
    """Rows of a daily climatology (month, day, ..) for times; 29 February takes the 28th."""
    day = F.when((F.month("time") == 2) & (F.dayofmonth("time") == 29), 28).otherwise(F.dayofmonth("time"))
    return wanted.withColumn("month", F.month("time")).withColumn("day", day).join(climatology, ["month", "day"])
