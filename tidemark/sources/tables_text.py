"""Statistics as text: a table of each object, and values by shape."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _number(name: str, kind: str) -> "F.Column":
    if kind in ("double", "float"):
        # areas and sums are large, angles are not
        made = F.format_string("%1.6e" if name.endswith("area") or name.startswith("sum") else "%1.6f", F.col(name))
        return F.when(F.col(name).isNotNull(), made)
    return F.col(name).cast("string")


def write_blob_statistics(stats: DataFrame, path: str, blob: str = "object_id", time: str = "time", header: bool = True) -> None:
    """Tab-separated lines ``blob seq time columns``, a folder ``object=<id>`` each and in it one
    file in order of time; seq counts an object's times from 1.

    Rows are dealt by object, so a task writes whole objects, and Spark's committer makes a
    failed write leave nothing behind.
    """
    kinds = dict(stats.dtypes)
    own = [c for c in stats.columns if c not in (blob, time)]
    w = Window.partitionBy(blob).orderBy(time)
    line = F.concat_ws("\t", F.col(blob).cast("string"), F.row_number().over(w).cast("string"), F.concat(F.lit('"'), F.col(time).cast("string"), F.lit('"')), *(F.coalesce(_number(c, kinds[c]), F.lit("nan")) for c in own))
    rows = stats.select(F.col(blob).alias("object"), F.col(time).alias("_t"), line.alias("value"))
    if header:
        names = F.lit("\t".join(["#blob", "seq", "time", *own]))
        rows = rows.unionByName(stats.select(F.col(blob).alias("object")).distinct().select("object", F.lit(None).cast(kinds[time]).alias("_t"), names.alias("value")))
    rows.repartition("object").sortWithinPartitions("object", F.col("_t").asc_nulls_first()).drop("_t").write.partitionBy("object").text(path)


def read_blob_statistics(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """(object_id, seq, time, columns as doubles) of :func:`write_blob_statistics`'s files; lines
    that begin with # don't count."""
    parts = F.split("value", "\t")
    lines = spark.read.text(path).where("NOT startswith(value, '#') AND value <> ''")
    made = [parts[0].cast("long").alias("object_id"), parts[1].cast("int").alias("seq"), F.regexp_replace(parts[2], '"', "").alias("time")]
    value = lambda i: F.when(parts[i] != "nan", parts[i].cast("double"))
    return lines.select(*made, *(value(i + 3).alias(c) for i, c in enumerate(columns)))


def write_shape_table(values: DataFrame, path: str, value: str, time: str = "time", shape: str = "shape") -> None:
    """Comma-separated lines ``variable,time,shape,value``, a folder ``shape=<id>`` each with one
    file in order of time; a missing value is an empty field."""
    line = F.concat_ws(",", F.lit(value), F.col(time).cast("string"), F.col(shape).cast("string"), F.coalesce(F.col(value).cast("string"), F.lit("")))
    rows = values.select(F.col(shape).alias("shape"), F.col(time).alias("_t"), line.alias("value"))
    rows.repartition("shape").sortWithinPartitions("shape", "_t").drop("_t").write.partitionBy("shape").text(path)


def read_shape_table(spark: SparkSession, path: str) -> DataFrame:
    """(variable, time, shape, value) of :func:`write_shape_table`'s files."""
    parts = F.split("value", ",", -1)
    value = F.when(parts[3] != "", parts[3].cast("double"))
    return spark.read.text(path).select(parts[0].alias("variable"), parts[1].alias("time"), parts[2].cast("int").alias("shape"), value.alias("value"))
