"""Climatologies as stored states to which later data are added without reading the earlier."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .climate import _prepared


def climatology_state(field: DataFrame, value: str, period: str, leap_days: bool = False) -> DataFrame:
    """(cell, idx, n, total, squares, least, most): what a period's mean, mean square, deviation
    and extremes are made of. Sums are decimal-free doubles; missing values don't count."""
    x = F.col("x")
    return _prepared(field, value, period, leap_days).groupBy("cell", "idx").agg(F.count(x).alias("n"), F.sum(x).alias("total"), F.sum(x * x).alias("squares"), F.min(x).alias("least"), F.max(x).alias("most"))


def merge_states(*states: DataFrame) -> DataFrame:
    """One state of several, whatever order or grouping they come in."""
    rows = reduce(DataFrame.unionByName, states)
    return rows.groupBy("cell", "idx").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.sum("squares").alias("squares"), F.min("least").alias("least"), F.max("most").alias("most"))


def finish_state(state: DataFrame, least_count: int = 1) -> DataFrame:
    """(cell, idx, mean, meansq, stddev, min, max, count) of a state, as ``climatology`` has them;
    periods of fewer than ``least_count`` samples are left out."""
    n, mean = F.col("n"), F.col("total") / F.col("n")
    spread = F.sqrt(F.greatest(F.col("squares") - F.col("total") * mean, F.lit(0.0)) / (n - 1))
    made = state.where(n >= max(least_count, 1))
    return made.select("cell", "idx", mean.alias("mean"), (F.col("squares") / n).alias("meansq"), F.when(n > 1, spread).alias("stddev"), F.col("least").alias("min"), F.col("most").alias("max"), n.alias("count"))


def add_to_store(state: DataFrame, path: str, batch: str) -> None:
    """Put the state of one batch of files into the store at ``path``; a batch that is there
    already is replaced, so a job that is run again counts once."""
    spark, key = state.sparkSession, "spark.sql.sources.partitionOverwriteMode"
    before = spark.conf.get(key)
    spark.conf.set(key, "dynamic")
    try:
        state.withColumn("batch", F.lit(batch)).write.mode("overwrite").partitionBy("batch").parquet(path)
    finally:
        spark.conf.set(key, before)


def stored(spark: SparkSession, path: str, without: list[str] | None = None) -> DataFrame:
    """The merged state of a store's batches, except those named."""
    rows = spark.read.parquet(path)
    if without:
        rows = rows.where(~F.col("batch").cast("string").isin(without))
    return merge_states(rows.drop("batch"))
