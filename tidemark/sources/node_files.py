"""Node and track tables as text: per-time lists, track blocks and CSV."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, at, line): the lines of text files with their byte-free order within a file."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return raw.select("path", F.posexplode(F.split("value", "\r?\n")).alias("at", "line")).where("trim(line) <> '' AND NOT startswith(line, '#')")


def _moment(tokens: Column, first: int) -> Column:
    """Timestamp of year, month, day and hour tokens; an hour of five digits is seconds."""
    part = lambda i: F.element_at(tokens, first + i + 1)
    last = part(3)
    seconds = F.when(F.length(last) == 5, last.cast("int")).otherwise(last.cast("int") * 3600)
    return F.make_timestamp_ntz(part(0).cast("int"), part(1).cast("int"), part(2).cast("int"), F.lit(0), F.lit(0), F.lit(0)) + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))


def _headed(spark: SparkSession, path: str, header: Column) -> DataFrame:
    """Lines with the header line above them, carried down within a file."""
    w = Window.partitionBy("path").orderBy("at")
    rows = _lines(spark, path).withColumn("t", F.split(F.regexp_replace("line", r"^\s+|\s+$", ""), r"\s+")).withColumn("h", header)
    carried = rows.withColumn("block", F.sum(F.col("h").cast("int")).over(w)).withColumn("head", F.last(F.when(F.col("h"), F.col("t")), ignorenulls=True).over(w))
    return carried.where(~F.col("h"))


def read_candidates(spark: SparkSession, path: str, columns: list[str], index: list[str] = ["i"]) -> DataFrame:  # noqa: B006
    """(time, index.., columns..) of per-time lists: ``year month day count hour`` lines, each
    followed by indented nodes."""
    rows = _headed(spark, path, ~F.col("line").rlike(r"^\s"))
    head = F.array(*(F.col("head")[i] for i in (0, 1, 2, 4)))
    names = [*index, *columns]
    return rows.select(_moment(head, 0).alias("time"), *(F.col("t")[k].cast("int" if n in index else "double").alias(n) for k, n in enumerate(names)))


def read_tracks(spark: SparkSession, path: str, columns: list[str], index: list[str] = ["i"]) -> DataFrame:  # noqa: B006
    """(path, track_id, seq, time, index.., columns..) of track blocks: ``start n year month day
    hour`` lines, each followed by nodes that end with their time."""
    rows = _headed(spark, path, F.col("line").startswith("start"))
    names = [*index, *columns]
    seq = F.row_number().over(Window.partitionBy("path", "block").orderBy("at")) - 1
    values = (F.col("t")[k].cast("int" if n in index else "double").alias(n) for k, n in enumerate(names))
    return rows.select("path", (F.col("block") - 1).cast("long").alias("track_id"), seq.alias("seq"), _moment(F.slice("t", len(names) + 1, 4), 0).alias("time"), *values)


def read_tracks_csv(spark: SparkSession, path: str) -> DataFrame:
    """Track CSV with a header: track_id, year, month, day, hour, then columns of numbers."""
    raw = spark.read.csv(path, header=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    parts = F.array(*(F.col(c) for c in ("year", "month", "day", "hour")))
    rest = [c for c in raw.columns if c not in ("track_id", "year", "month", "day", "hour")]
    return raw.select(F.col("track_id").cast("long").alias("track_id"), _moment(parts, 0).alias("time"), *(F.col(c).cast("int" if c in ("i", "j") else "double").alias(c) for c in rest))


def write_candidates(nodes: DataFrame, path: str, columns: list[str], index: list[str] = ["i"]) -> None:  # noqa: B006
    """Per-time lists as text; times are dealt by range, so files follow each other in time.

    A time's header needs its number of nodes, which is joined from a count; no task holds
    more than a batch of lines.
    """
    count = nodes.groupBy("time").agg(F.count("*").alias("n"))
    stamp = F.concat_ws("\t", F.year("time"), F.month("time"), F.dayofmonth("time"), "n", F.hour("time"))
    heads = count.select("time", F.lit(0).alias("o"), F.lit(None).cast("int").alias("k"), stamp.alias("value"))
    cells = [*(F.col(i).cast("string") for i in index), *(F.format_string("%.6f" if c in ("lon", "lat") else "%.6e", F.col(c).cast("double")) for c in columns)]
    rows = nodes.select("time", F.lit(1).alias("o"), F.col(index[0]).cast("int").alias("k"), F.concat(F.lit("\t"), F.concat_ws("\t", *cells)).alias("value"))
    heads.unionAll(rows).repartitionByRange("time").sortWithinPartitions("time", "o", "k").select("value").write.text(path)


def write_tracks(track: DataFrame, path: str, columns: list[str], index: list[str] = ["i"]) -> None:  # noqa: B006
    """Track blocks as text, dealt by track; ``track`` has track_id, time and the columns."""
    s = track.groupBy("track_id").agg(F.count("*").alias("n"), F.min("time").alias("time"))
    when = lambda t: F.concat_ws("\t", F.year(t), F.month(t), F.dayofmonth(t), F.hour(t))
    heads = s.select("track_id", F.lit(0).alias("o"), "time", F.concat_ws("\t", F.lit("start"), "n", when("time")).alias("value"))
    cells = [*(F.col(i).cast("string") for i in index), *(F.format_string("%.6f" if c in ("lon", "lat") else "%.6e", F.col(c).cast("double")) for c in columns), when("time")]
    rows = track.select("track_id", F.lit(1).alias("o"), "time", F.concat(F.lit("\t"), F.concat_ws("\t", *cells)).alias("value"))
    heads.unionAll(rows).repartitionByRange("track_id").sortWithinPartitions("track_id", "o", "time").select("value").write.text(path)


def write_tracks_csv(track: DataFrame, path: str, columns: list[str], header: bool = True) -> None:
    out = track.select("track_id", F.year("time").alias("year"), F.month("time").alias("month"), F.dayofmonth("time").alias("day"), F.hour("time").alias("hour"), *columns)
    out.repartitionByRange("track_id").sortWithinPartitions("track_id", "year", "month", "day", "hour").write.csv(path, header=header)


def read_polygons(spark: SparkSession, path: str) -> DataFrame:
    """(number, name, corners) of ``"name",n,lon..,lat..`` lines, in the order of the file."""
    name = F.regexp_extract("line", r'^\s*"([^"]*)"', 1)
    tail = F.split(F.regexp_replace("line", r'^\s*"[^"]*"\s*,', ""), r"\s*,\s*")
    rows = _lines(spark, path).select(F.col("at").alias("number"), name.alias("name"), tail.alias("t")).withColumn("n", F.col("t")[0].cast("int"))
    corner = F.transform(F.sequence(F.lit(1), F.col("n")), lambda i: F.struct(F.element_at("t", i + 1).cast("double").alias("lon"), F.element_at("t", i + 1 + F.col("n")).cast("double").alias("lat")))
    return rows.select("number", "name", corner.alias("corners"))


def read_connectivity(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Grid (cell, lon, lat, area) and edges (cell, nbr) of a connectivity file: two header lines,
    then ``lon,lat,area,k,n1..nk`` a cell, neighbours counted from 1."""
    rows = _lines(spark, path).where("at >= 2").select((F.col("at") - 2).cast("int").alias("cell"), F.split("line", r"\s*,\s*").alias("t"))
    grid = rows.select("cell", *(F.col("t")[k].cast("double").alias(n) for k, n in enumerate(("lon", "lat", "area"))))
    edge = rows.select("cell", F.explode(F.slice("t", 5, 1_000)).alias("n")).where("trim(n) <> ''").select("cell", (F.col("n").cast("int") - 1).alias("nbr"))
    return grid, edge


def write_connectivity(grid: DataFrame, edge: DataFrame, path: str, size: str) -> None:
    """A connectivity file of one part: its rows are as many as the grid has cells."""
    near = edge.groupBy("cell").agg(F.array_sort(F.collect_list(F.col("nbr") + 1)).alias("n"))
    lines = grid.join(near, "cell", "left").select("cell", F.concat_ws(",", "lon", "lat", "area", F.size(F.coalesce("n", F.array())), F.array_join("n", ",")).alias("value"))
    heads = grid.sparkSession.createDataFrame([(-2, "connectivity"), (-1, size)], "cell int, value string")
    heads.unionAll(lines).coalesce(1).sortWithinPartitions("cell").select("value").write.text(path)
