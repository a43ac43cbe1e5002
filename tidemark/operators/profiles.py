"""What is measured round track nodes: intensity, radial profiles, masks and composites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geo
from ..functions.geo import EARTH_RADIUS, KNOTS
from .grid import within
from .shapes import points_in_shapes


def node_cells(nodes: DataFrame, field: DataFrame, grid: DataFrame, radius: float) -> DataFrame:
    """A row for each node and known cell within ``radius``: step, cand, cell, dist and the
    field's columns. ``field`` has step and cell; the search is over the grid once a place."""
    near = within(nodes.select("step", "cand", "lon", "lat"), grid.select("cell", "lon", "lat", "area"), radius)
    return near.join(field, ["step", "cell"])


def intensity(cells: DataFrame, u: str, v: str, p: str) -> DataFrame:
    """(step, cand, ace, ike, pdi, acepsl) of :func:`node_cells` rows; the cell at the node itself
    does not count. Winds in m/s, pressure in hPa."""
    speed = F.hypot(u, v)
    wind = KNOTS * 3.92 * F.pow(1016 - F.col(p), 0.644)
    rows = cells.where("dist > 1e-6")
    return rows.groupBy("step", "cand").agg(
        F.max((KNOTS * speed) ** 2 * 1e-4).alias("ace"),
        F.sum(0.5 * speed * speed * F.col("area") * EARTH_RADIUS**2).alias("ike"),
        F.max(speed**3).alias("pdi"),
        F.max(F.when(F.col(p) <= 1016, wind**2 * 1e-4)).alias("acepsl"),
    )


def extremes(cells: DataFrame, value: str) -> DataFrame:
    """(step, cand, min, max) of :func:`node_cells` rows; the node's own cell counts."""
    return cells.groupBy("step", "cand").agg(F.min(value).alias("min"), F.max(value).alias("max"))


def radial_profile(cells: DataFrame, value: str, bins: int, width: float) -> DataFrame:
    """(step, cand, profile): means by distance; a cell counts in its bin and the next, bin 0 and
    empty bins are 0."""
    at = F.floor(F.col("dist") / width)
    spread = cells.select("step", "cand", F.col(value).alias("v"), F.explode(F.array(at, at + 1)).alias("bin")).where(F.col("bin").between(1, bins - 1))
    means = spread.groupBy("step", "cand", "bin").agg(F.avg("v").alias("m"))
    return _as_array(means, bins)


def _as_array(means: DataFrame, bins: int) -> DataFrame:
    made = means.groupBy("step", "cand").agg(F.map_from_entries(F.collect_list(F.struct(F.col("bin").cast("int"), "m"))).alias("m"))
    return made.select("step", "cand", F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda i: F.coalesce(F.element_at("m", i), F.lit(0.0))).alias("profile"))


def azimuthal_wind(u: str, v: str, lon0: str = "lon", lat0: str = "lat", lon: str = "lon2", lat: str = "lat2") -> Column:
    """Wind round a centre, positive if cyclonic."""
    px, py = geo.stereographic(lon, lat, lon0, lat0)
    r = F.hypot(px, py)
    turn = F.try_divide(F.col(v) * px - F.col(u) * py, r)
    return F.when(F.col(lat0) < 0, -turn).otherwise(turn)


def quadrant_profile(cells: DataFrame, value: str, bins: int, width: float) -> DataFrame:
    """(step, cand, quadrant, profile): as :func:`radial_profile` for NE, SE, SW, NW, numbered
    0 to 3 by the signs of the stereographic place."""
    px, py = geo.stereographic("lon2", "lat2", "lon", "lat")
    quad = F.when((px >= 0) & (py >= 0), 0).when(px >= 0, 1).when(py < 0, 2).otherwise(3)
    out = None
    for number in range(4):
        own = radial_profile(cells.where(quad == number), value, bins, width).withColumn("quadrant", F.lit(number))
        out = own if out is None else out.unionAll(own)
    return out


def _limit(profile: Column, threshold) -> Column:
    if threshold == "max":
        return F.array_max(profile)
    return F.array_min(profile) if threshold == "min" else geo.c(threshold)


def first_where(profile: str, op: str, threshold, width: float, start: float = 0.0) -> Column:
    """Distance at which a profile first ``fallsbelow``, ``risesabove`` or is ``=`` a threshold,
    from a distance on; null if it doesn't."""
    p = F.col(profile)
    limit = _limit(p, threshold)
    test = {"fallsbelow": lambda v: v < limit, "risesabove": lambda v: v > limit, "=": lambda v: v == limit}[op]
    hits = F.filter(F.sequence(F.lit(0), F.size(p) - 1), lambda i: (i * width >= start) & test(F.element_at(p, (i + 1).cast("int"))))
    return F.try_element_at(hits, F.lit(1)) * width


def last_where(profile: str, op: str, threshold, width: float) -> Column:
    """Largest distance at which a profile compares so with a threshold; null if nowhere."""
    from .nodes import COMPARE

    p = F.col(profile)
    limit = _limit(p, threshold)
    hits = F.filter(F.sequence(F.lit(0), F.size(p) - 1), lambda i: COMPARE[op](F.element_at(p, (i + 1).cast("int")), limit))
    return F.try_element_at(hits, F.lit(-1)) * width


def value_at(profile: str, index) -> Column:
    """Profile at a fractional index, linear between its entries and held beyond its ends."""
    p, n = F.col(profile), F.size(profile) - 1
    x = F.least(F.greatest(geo.c(index), F.lit(0.0)), n.cast("double"))
    low = F.floor(x).cast("int")
    high = F.least(low + 1, n)
    return F.element_at(p, low + 1) * (1 - (x - low)) + F.element_at(p, high + 1) * (x - low)


def mask_near(field: DataFrame, nodes: DataFrame, grid: DataFrame, radius: float, invert: bool = False, fill: float | None = None) -> DataFrame:
    """``field`` (step, cell, x) with x replaced by ``fill`` beyond ``radius`` of every node of the
    step (within it, if ``invert``)."""
    hit = within(nodes.select("step", "lon", "lat"), grid.select("cell", "lon", "lat"), radius).select("step", "cell").distinct().withColumn("_in", F.lit(True))
    keep = F.col("_in").isNull() if invert else F.col("_in").isNotNull()
    return field.join(hit, ["step", "cell"], "left").select("step", "cell", F.when(keep, F.col("x")).otherwise(F.lit(fill).cast("double")).alias("x"))


def composite(nodes: DataFrame, field: DataFrame, grid: DataFrame, step_deg: float, half: int, reach: float, flip_south: bool = False, minus: str | None = None, centre: tuple | None = None) -> DataFrame:
    """(ix, iy, mean, min, max, count): a field sampled on a square round each node.

    Points are ``step_deg`` apart in the stereographic plane about the node; each takes the
    nearest cell within ``reach`` (ties: the smaller cell). ``flip_south`` mirrors southern nodes,
    ``minus`` is a column of the nodes to take off their values, ``centre`` a (lon, lat) for all.
    """
    if centre:
        nodes = nodes.withColumns({"lon": F.lit(float(centre[0])), "lat": F.lit(float(centre[1]))})
    one = snapshots(sample_points(nodes, step_deg, half, flip_south), field, grid, reach)
    if minus:
        one = one.join(nodes.select("step", "cand", F.col(minus).alias("_off")), ["step", "cand"]).withColumn("x", F.col("x") - F.col("_off"))
    return one.groupBy("ix", "iy").agg(F.avg("x").alias("mean"), F.min("x").alias("min"), F.max("x").alias("max"), F.count("x").alias("count"))


def sample_points(nodes: DataFrame, step_deg: float, half: int, flip_south: bool = False) -> DataFrame:
    axis = F.sequence(F.lit(-half), F.lit(half))
    p = nodes.select("step", "cand", F.col("lon").alias("lon0"), F.col("lat").alias("lat0"), F.explode(axis).alias("ix")).withColumn("iy", F.explode(axis))
    flat = lambda k: 2 * F.tan(F.radians(k * step_deg) / 2)
    y = F.when(F.col("lat0") < 0, -F.col("iy")).otherwise(F.col("iy")) if flip_south else F.col("iy")
    lon, lat = geo.stereographic_inverse(flat(F.col("ix")), flat(y), "lon0", "lat0")
    return p.select("step", "cand", "ix", "iy", lon.alias("lon"), lat.alias("lat"))


def value_histogram(values: DataFrame, value: str, offset: float, width: float) -> DataFrame:
    """(bin, count): floor((value - offset) / width)."""
    return values.where(F.col(value).isNotNull()).groupBy(F.floor((F.col(value) - offset) / width).cast("int").alias("bin")).agg(F.count("*").alias("count"))


def region_of(points: DataFrame, regions: DataFrame, key: list[str]) -> DataFrame:
    """``points`` with the name of the first region (number, name, corners) that holds them, or
    null. Regions are counted: few go to all tasks, more meet the points by tile
    (:func:`.shapes.points_in_shapes`)."""
    if regions.count() > 10_000:
        held = points_in_shapes(points.select(*key, "lon", "lat"), regions.select(F.col("number").alias("shape"), "corners"), key)
        first = held.groupBy(*key).agg(F.min("shape").alias("number"))
        return points.join(first.join(regions.select("number", F.col("name").alias("region")), "number").drop("number"), key, "left")
    hit = points.join(F.broadcast(regions), geo.in_polygon("lon", "lat", "corners")).groupBy(*key).agg(F.min_by("name", "number").alias("region"))
    return points.join(hit, key, "left")


def radial_points(nodes: DataFrame, step_deg: float, rings: int, rays: int) -> DataFrame:
    """(step, cand, ix, iy, lon, lat): points on ``rings`` circles of ``rays`` points round each node;
    ix is the ring (distance (ix + 0.5) * step_deg), iy the ray, from north clockwise."""
    p = nodes.select("step", "cand", F.col("lon").alias("lon0"), F.col("lat").alias("lat0"), F.explode(F.sequence(F.lit(0), F.lit(rings - 1))).alias("ix")).withColumn("iy", F.explode(F.sequence(F.lit(0), F.lit(rays - 1))))
    flat = 2 * F.tan(F.radians((F.col("ix") + 0.5) * step_deg) / 2)
    turn = F.radians(F.col("iy") * (360.0 / rays))
    lon, lat = geo.stereographic_inverse(flat * F.sin(turn), flat * F.cos(turn), "lon0", "lat0")
    return p.select("step", "cand", "ix", "iy", lon.alias("lon"), lat.alias("lat"))


def lon_lat_points(nodes: DataFrame, step_deg: float, half: int) -> DataFrame:
    """(step, cand, ix, iy, lon, lat): points on an even longitude-latitude square round each node;
    those beyond the poles are left out."""
    axis = F.sequence(F.lit(-half), F.lit(half))
    p = nodes.select("step", "cand", F.col("lon").alias("lon0"), F.col("lat").alias("lat0"), F.explode(axis).alias("ix")).withColumn("iy", F.explode(axis))
    return p.select("step", "cand", "ix", "iy", geo.norm_lon(F.col("lon0") + F.col("ix") * step_deg).alias("lon"), (F.col("lat0") + F.col("iy") * step_deg).alias("lat")).where("abs(lat) <= 90")


def snapshots(points: DataFrame, field: DataFrame, grid: DataFrame, reach: float) -> DataFrame:
    """(step, cand, ix, iy, x): the field at the nearest cell within ``reach`` of each point."""
    near = within(points, grid.select("cell", "lon", "lat"), reach)
    w = Window.partitionBy("step", "cand", "ix", "iy").orderBy(F.round("dist", 9), "cell")
    one = near.withColumn("_k", F.row_number().over(w)).where("_k = 1").select("step", "cand", "ix", "iy", "cell")
    return one.join(field, ["step", "cell"]).select("step", "cand", "ix", "iy", "x")
