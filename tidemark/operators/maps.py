"""Maps between grids: nearest points without a radius, and sparse weights."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from .blobs import _kept
from .grid import within


def _first_radius(points: int) -> float:
    """About the spacing of so many points spread over the sphere."""
    return min(90.0, max(1e-3, 360.0 / max(points, 1) ** 0.5 / 2))


#: Height of the tiles by which far targets are found, in degrees: about 10,300 cover the sphere.
TILE = 2.0


def _tiled(places: DataFrame) -> DataFrame:
    """``places`` (lon, lat) with the tile of each (_tile) and the tile's centre (_x, _y) and greatest
    distance from it (_r), which is that of a corner."""
    band = F.least(F.greatest(F.floor((F.col("lat") + 90) / TILE), F.lit(0)), F.lit(int(180 / TILE) - 1)).cast("int")
    low = F.col("_band") * TILE - 90
    columns = F.greatest(F.lit(1), F.ceil(360 / TILE * F.cos(F.radians(low + TILE / 2)))).cast("int")
    at = places.withColumn("_band", band).withColumn("_columns", columns)
    at = at.withColumn("_column", F.least(F.floor(geo.norm_lon("lon") / 360 * F.col("_columns")), F.col("_columns") - 1).cast("int"))
    half = F.lit(180.0) / F.col("_columns")
    at = at.withColumns({"_tile": F.col("_band") * 1000 + F.col("_column"), "_x": (2 * F.col("_column") + 1) * half, "_y": low + TILE / 2})
    corner = lambda lat: geo.great_circle(F.lit(0.0), F.col("_y"), half, lat)
    return at.withColumn("_r", F.greatest(corner(low), corner(low + TILE)) + 1e-6).drop("_band", "_columns", "_column")


def _nearest(pairs: DataFrame, target_key: str) -> DataFrame:
    """The nearest pair of each place; most pairs go before the shuffle: of consecutive ones of a
    place those within 1e-9 degrees of their nearest stay."""

    def lowest(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            lon, lat, dist = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("lon", "lat", "dist"))
            begins = np.concatenate(([0], np.flatnonzero((lon[1:] != lon[:-1]) | (lat[1:] != lat[:-1])) + 1))
            least = np.repeat(np.minimum.reduceat(dist, begins), np.diff(np.append(begins, len(dist))))
            yield batch.filter(pa.array(dist <= least + 2e-9))

    few = pairs.select("lon", "lat", target_key, "dist")
    few = few.mapInArrow(lowest, few.schema)
    best = few.groupBy("lon", "lat").agg(F.min(F.struct(F.round("dist", 9).alias("d"), F.col(target_key).alias("t"), "dist")).alias("_b"))
    return best.select("lon", "lat", F.col("_b.t").alias(target_key), F.col("_b.dist").alias("dist"))


def _far_pairs(left: DataFrame, goals: DataFrame, target_key: str, max_dist: float) -> DataFrame:
    """Pairs of places and targets among which is each place's nearest: of the targets' tiles those
    that begin no farther from the place's tile than the nearest of them ends. Tiles are compared
    all with all, whose number is bounded by :data:`TILE`, not by the data."""
    tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tile = lambda df, s: df.select(F.col("_tile").alias(f"_tile{s}"), F.col("_x").alias(f"_x{s}"), F.col("_y").alias(f"_y{s}"), F.col("_r").alias(f"_r{s}")).distinct()
    spots, ends = _tiled(left), _tiled(goals)
    there, here = tile(ends, 2), _kept(tile(spots, 1).repartition(tasks, "_tile1"))
    apart = geo.great_circle("_x1", "_y1", "_x2", "_y2")
    met = lambda df: df.join(F.broadcast(there)).withColumn("_d", apart)
    bound = met(here).groupBy("_tile1").agg(F.min(F.col("_d") + F.col("_r1") + F.col("_r2")).alias("_most"))
    close = met(here.join(bound, "_tile1")).where(F.col("_d") - F.col("_r1") - F.col("_r2") <= F.least("_most", F.lit(max_dist)))
    goal = ends.select(F.col("_tile").alias("_tile2"), target_key, F.col("lon").alias("lon2"), F.col("lat").alias("lat2"))
    around = close.select("_tile1", "_tile2").join(goal.hint("merge"), "_tile2").withColumnRenamed("_tile1", "_tile")
    pairs = spots.select("lon", "lat", "_tile").join(around.hint("merge"), "_tile")
    return pairs.withColumn("dist", geo.great_circle("lon", "lat", "lon2", "lat2")).where(F.col("dist") <= max_dist)


def nearest_map(points: DataFrame, targets: DataFrame, key: list[str], target_key: str, max_dist: float = 180.0, start: float | None = None) -> DataFrame:
    """(key, target_key, dist): the nearest of ``targets`` for each of ``points``, however far.

    Both have lon and lat; ties within 1e-9 degrees go to the smaller target. The search
    begins within ``start`` degrees (about the targets' spacing), then three times that, as joins
    on buckets of the radius. Points that have no target there meet those of the tiles that can
    hold the nearest, up to ``max_dist``, where those left have no row.
    Points or targets with a null place have no row; copies of a place are searched once.
    """
    goals = targets.where("lon IS NOT NULL AND lat IS NOT NULL").select(target_key, F.col("lon").cast("double"), F.col("lat").cast("double"))
    goals = goals.groupBy("lon", "lat").agg(F.min(target_key).alias(target_key))
    spots = points.where("lon IS NOT NULL AND lat IS NOT NULL").withColumns({c: F.col(c).cast("double") for c in ("lon", "lat")})
    left = spots.select("lon", "lat").distinct()
    radius, found = min(start or _first_radius(goals.count()), max_dist), None
    for near in (radius, min(3 * radius, max_dist)):
        made = _kept(_nearest(within(left, goals, near), target_key))
        found = made if found is None else found.unionByName(made)
        left = left.join(made.select("lon", "lat"), ["lon", "lat"], "left_anti")
        if near >= max_dist or left.isEmpty():
            break
    else:
        found = found.unionByName(_nearest(_far_pairs(_kept(left), goals, target_key, max_dist), target_key))
    return spots.select(*key, "lon", "lat").join(found, ["lon", "lat"]).select(*key, target_key, "dist")


def nearest_weights(source: DataFrame, target: DataFrame, max_dist: float = 180.0) -> DataFrame:
    """(row, col, s): a sparse map, 1-based, that gives each cell of ``target`` the value of the
    nearest cell of ``source``. Both have cell (from 0), lon, lat and may have ``mask``: a null or
    NaN there takes a cell out of the search. Targets farther than ``max_dist`` have no row."""
    keep = lambda df: df.where(F.col("mask").isNotNull() & ~F.isnan(F.col("mask").cast("double"))) if "mask" in df.columns else df
    goals = keep(source).select(F.col("cell").alias("_source"), "lon", "lat")
    found = nearest_map(keep(target).select("cell", "lon", "lat"), goals, ["cell"], "_source", max_dist)
    return found.select((F.col("cell") + 1).cast("int").alias("row"), (F.col("_source") + 1).cast("int").alias("col"), F.lit(1.0).alias("s"))


def bilinear_weights(targets: DataFrame, n_lon: int, n_lat: int, lat0: float, dlat: float) -> DataFrame:
    """(row, col, s): weights of the four cells of an even periodic grid (longitudes from 0, rows of
    latitude from ``lat0``) round each point of ``targets`` (cell, lon, lat). Beyond the outermost
    rows the nearest row counts alone, so that the weights of a row always sum to 1."""
    # counted from the grid's south side: a point on a row of cells has that row's weight alone
    up = (F.col("lat") - (lat0 - dlat / 2)) / dlat - 0.5
    x, y = geo.norm_lon("lon") / (360.0 / n_lon), F.least(F.greatest(up, F.lit(0.0)), F.lit(float(n_lat - 1)))
    at = targets.select("cell", x.alias("x"), y.alias("y")).withColumns({"i": F.floor("x").cast("int"), "j": F.least(F.floor("y").cast("int"), F.lit(max(n_lat - 2, 0)))})
    corners = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in ((0, 1) if n_lat > 1 else (0,)))))
    at = at.withColumn("c", corners)
    share = lambda side, part: F.when(side == 1, part).otherwise(1 - part)
    weight = share(F.col("c.a"), F.col("x") - F.col("i")) * share(F.col("c.b"), F.col("y") - F.col("j"))
    col = (F.col("j") + F.col("c.b")) * n_lon + F.pmod(F.col("i") + F.col("c.a"), F.lit(n_lon)) + 1
    rows = at.select((F.col("cell") + 1).cast("int").alias("row"), col.cast("int").alias("col"), weight.alias("s"))
    return rows.where("s <> 0").groupBy("row", "col").agg(F.sum("s").alias("s"))


def apply_map(field: DataFrame, weights: DataFrame, value: str, keys: list[str] = ["time"], renormalise: bool = False) -> DataFrame:  # noqa: B006
    """(keys, cell, value): the product of a sparse map (row, col, s) with each slice of a field.

    A target whose source cells aren't all known is null, or takes the known ones' weighted
    mean if ``renormalise``. Weights are joined by cell; the sum is combined before the shuffle.
    """
    rows = field.where(F.col(value).isNotNull()).select(*keys, (F.col("cell") + 1).alias("col"), F.col(value).alias("_v"))
    whole = weights.groupBy("row").agg(F.count("*").alias("_all"), F.sum("s").alias("_sum"))
    made = rows.join(weights, "col").groupBy(*keys, "row").agg(F.count("*").alias("_n"), F.sum(F.col("s") * F.col("_v")).alias("_p"), F.sum("s").alias("_s"))
    out = made.join(whole, "row")
    good = F.try_divide(F.col("_p") * F.col("_sum"), F.col("_s")) if renormalise else F.when(F.col("_n") == F.col("_all"), F.col("_p"))
    return out.select(*keys, (F.col("row") - 1).cast("int").alias("cell"), good.alias(value))


def map_report(weights: DataFrame, targets: int, tolerance: float = 1e-8) -> DataFrame:
    """One row: entries, rows, empty_rows, inconsistent rows (whose weights don't sum to 1), and
    the least and greatest weight."""
    sums = weights.groupBy("row").agg(F.count("*").alias("n"), F.sum("s").alias("sum"), F.min("s").alias("lo"), F.max("s").alias("hi"))
    off = F.count_if(F.abs(F.col("sum") - 1) > tolerance)
    return sums.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("entries"), F.count("*").alias("rows"), (targets - F.count("*")).alias("empty_rows"), off.alias("inconsistent"), F.min("lo").alias("least"), F.max("hi").alias("greatest"))


def write_map(weights: DataFrame, path: str) -> None:
    """Text lines ``row col s`` with 1-based indices, by row, in as many files as tasks."""
    ordered = weights.repartitionByRange("row").sortWithinPartitions("row", "col")
    ordered.select(F.concat_ws(" ", F.col("row").cast("string"), F.col("col").cast("string"), F.col("s").cast("string"))).write.text(path)


def read_map(spark, path: str) -> DataFrame:
    """(row, col, s) of :func:`write_map`'s files; blank lines and lines after # don't count."""
    parts = F.split(F.trim("value"), r"\s+")
    lines = spark.read.text(path).where("trim(value) <> '' AND NOT startswith(ltrim(value), '#')")
    return lines.select(parts[0].cast("int").alias("row"), parts[1].cast("int").alias("col"), parts[2].cast("double").alias("s"))
