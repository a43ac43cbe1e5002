"""Latitude-longitude grids as tables: cells, neighbours, discs and stencils.

A grid has cell, i (along longitude), j (along latitude), lon, lat, area (steradians). Its
tables depend on the grid alone, not on how many times a field has.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geo


def lat_lon_grid(spark: SparkSession, n_lat: int, n_lon: int, lat0: float = -90.0, lat1: float = 90.0, lon0: float = 0.0, lon1: float = 360.0) -> DataFrame:
    """Cell centres of an even grid over a box; cell = j * n_lon + i."""
    dlat, dlon = (lat1 - lat0) / n_lat, (lon1 - lon0) / n_lon
    ij = spark.range(n_lat * n_lon).select(F.col("id").cast("int").alias("cell"), (F.col("id") % n_lon).cast("int").alias("i"), F.floor(F.col("id") / n_lon).cast("int").alias("j"))
    placed = ij.withColumn("lon", lon0 + dlon * F.col("i") + (0 if lon0 == 0 and lon1 == 360 else dlon / 2)).withColumn("lat", lat0 + dlat * (F.col("j") + 0.5))
    up, down = F.radians(F.col("lat") + dlat / 2), F.radians(F.col("lat") - dlat / 2)
    return placed.withColumn("area", (F.sin(up) - F.sin(down)) * F.radians(F.lit(dlon)))


def grid_of_axes(lons: DataFrame, lats: DataFrame, regional: bool = False) -> DataFrame:
    """A grid of given axes (lon; lat), in order; bounds are midpoints, poles close a global one."""
    w = Window.orderBy("lat")
    half = lambda side: (F.col("lat") + side("lat", 1).over(w)) / 2
    step = F.lead("lat").over(w) - F.col("lat")
    back = F.col("lat") - F.lag("lat").over(w)
    edge = lambda own, other: own if regional else F.lit(other)
    y = lats.select("lat", (F.row_number().over(w) - 1).alias("j"), F.coalesce(half(F.lag), edge(F.col("lat") - step / 2, -90.0)).alias("south"), F.coalesce(half(F.lead), edge(F.col("lat") + back / 2, 90.0)).alias("north"))
    v = Window.orderBy("lon")
    n = lons.count()
    first, last = lons.agg(F.min("lon"), F.max("lon")).first()
    left, right = F.lag("lon").over(v), F.lead("lon").over(v)
    if not regional:
        left, right = F.coalesce(left, F.lit(last - 360)), F.coalesce(right, F.lit(first + 360))
    west = F.coalesce((F.col("lon") + left) / 2, F.col("lon") - (right - F.col("lon")) / 2)
    east = F.coalesce((F.col("lon") + right) / 2, F.col("lon") + (F.col("lon") - left) / 2)
    x = lons.select("lon", (F.row_number().over(v) - 1).alias("i"), west.alias("west"), east.alias("east"))
    joined = y.join(F.broadcast(x))
    return joined.select((F.col("j") * n + F.col("i")).cast("int").alias("cell"), F.col("i").cast("int"), F.col("j").cast("int"), "lon", "lat", ((F.sin(F.radians("north")) - F.sin(F.radians("south"))) * F.radians(F.col("east") - F.col("west"))).alias("area"))


def edges(grid: DataFrame, periodic: bool = True, diagonal: bool = False) -> DataFrame:
    """(cell, nbr): 4 neighbours of each cell, 8 if ``diagonal``; round in longitude if ``periodic``."""
    n = grid.agg(F.max("i")).first()[0] + 1
    steps = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a or b) and (diagonal or not (a and b))]
    moves = F.explode(F.array(*(F.struct(F.lit(a).alias("di"), F.lit(b).alias("dj")) for a, b in steps))).alias("m")
    out = grid.select("cell", "i", "j", moves).select("cell", (F.pmod(F.col("i") + F.col("m.di"), F.lit(n)) if periodic else F.col("i") + F.col("m.di")).alias("i"), (F.col("j") + F.col("m.dj")).alias("j"))
    return out.join(grid.select("i", "j", F.col("cell").alias("nbr")), ["i", "j"]).where("cell <> nbr").select("cell", "nbr").distinct()


def _banded(points: DataFrame, radius: float, spread: bool) -> DataFrame:
    """Bucket keys for a radius search: bands of latitude as high as the radius and, within a
    band, columns of longitude at least as wide as the radius is there. One side goes to its
    own bucket, the other (``spread``) to those round it."""
    bands = int(180 // radius) + 1
    band = F.least(F.floor((F.col("lat") + 90) / radius), F.lit(bands - 1)).cast("int")
    reach = F.explode(F.sequence(F.greatest(band - 1, F.lit(0)), F.least(band + 1, F.lit(bands - 1)))) if spread else band
    df = points.withColumn("_band", reach)
    top = F.least(F.lit(90.0), F.greatest(F.abs(F.col("_band") * radius - 90), F.abs((F.col("_band") + 1) * radius - 90)) + radius)
    # half width of the longitudes within the radius at the band's highest latitude
    wide = F.when(top < 89.0, F.degrees(F.asin(F.least(F.lit(1.0), F.sin(F.radians(F.lit(min(radius, 90.0)))) / F.cos(F.radians(top)))))).otherwise(180.0)
    columns = F.greatest(F.lit(1), F.floor(360 / F.greatest(wide, F.lit(1e-6)))).cast("int")
    df = df.withColumn("_columns", F.when(columns < 3, 1).otherwise(columns))
    own = F.least(F.floor(geo.norm_lon("lon") / 360 * F.col("_columns")), F.col("_columns") - 1).cast("int")
    around = F.explode(F.when(F.col("_columns") == 1, F.array(F.lit(0))).otherwise(F.array(*(F.pmod(own + d, F.col("_columns")) for d in (-1, 0, 1)))))
    return df.withColumn("_column", around if spread else F.when(F.col("_columns") == 1, 0).otherwise(own)).drop("_columns")


def within(left: DataFrame, right: DataFrame, radius: float, on: list[str] | None = None) -> DataFrame:
    """Pairs of rows at most ``radius`` degrees apart (and equal in ``on``), with ``dist``.

    Both sides have lon, lat; the right side's other columns must not clash, its own lon and lat
    become lon2, lat2. An equi-join on buckets of about the radius, not a cross join.
    """
    a = _banded(left, radius, True)
    b = _banded(right, radius, False).withColumnsRenamed({"lon": "lon2", "lat": "lat2"})
    joined = a.join(b, [*(on or []), "_band", "_column"]).drop("_band", "_column")
    # the law of cosines can't tell angles below about 1e-7 degrees from 0
    return joined.withColumn("dist", geo.great_circle("lon", "lat", "lon2", "lat2")).where(F.col("dist") <= radius)


def disc(grid: DataFrame, radius: float) -> DataFrame:
    """(cell, nbr, dist): all cells within ``radius`` degrees of each cell, itself included."""
    if radius == 0:
        return grid.select("cell", F.col("cell").alias("nbr"), F.lit(0.0).alias("dist"))
    own = grid.select("cell", "lon", "lat")
    return within(own, own.withColumnRenamed("cell", "nbr"), radius).select("cell", "nbr", F.when(F.col("cell") == F.col("nbr"), 0.0).otherwise(F.col("dist")).alias("dist"))


def ring_points(grid: DataFrame, n: int, dist: float) -> DataFrame:
    """(cell, k, lon, lat, east, north): n points on the circle of ``dist`` round each cell;
    (east, north) is the direction in which a point lies."""
    k = F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("k")
    turn = F.radians(F.col("k") * (360.0 / n))
    p = grid.select("cell", F.col("lon").alias("lon0"), F.col("lat").alias("lat0"), k)
    flat = 2 * F.tan(F.radians(F.lit(dist)) / 2)
    lon, lat = geo.stereographic_inverse(flat * F.sin(turn), flat * F.cos(turn), "lon0", "lat0")
    return p.select("cell", "k", lon.alias("lon"), lat.alias("lat"), F.sin(turn).alias("east"), F.cos(turn).alias("north"))


def ring_stencil(grid: DataFrame, n: int, dist: float) -> DataFrame:
    """(cell, nbr, angle, e0, n0, e1, n1): ring points moved to their nearest cells, each cell once.

    ``angle`` is the distance in degrees; (e0, n0) is the direction to the cell at the centre,
    (e1, n1) the direction away from the centre at the cell itself, (ec, nc) the latter seen
    from the centre's east and north.
    """
    points = ring_points(grid, n, dist)
    cells = grid.select(F.col("cell").alias("nbr"), "lon", "lat")
    rank = F.row_number().over(Window.partitionBy("cell", "k").orderBy(F.round("dist", 9), "nbr"))
    near = within(points.select("cell", "k", "lon", "lat"), cells, nearest_reach(grid)).withColumn("rank", rank).where("rank = 1 AND nbr <> cell")
    places = grid.select("cell", F.radians("lon").alias("x0"), F.radians("lat").alias("y0"))
    far = grid.select(F.col("cell").alias("nbr"), F.radians("lon").alias("x1"), F.radians("lat").alias("y1"))
    pairs = near.select("cell", "nbr").distinct().join(places, "cell").join(far, "nbr")
    d, sin, cos = F.col("x1") - F.col("x0"), F.sin, F.cos
    cosine = sin("y0") * sin("y1") + cos("y0") * cos("y1") * cos(d)
    east, north = cos("y1") * sin(d), sin("y1") * cos("y0") - cos("y1") * sin("y0") * cos(d)
    sine = F.hypot(east, north)
    back = cos("y0") * sin("y1") * cos(d) - sin("y0") * cos("y1")
    return pairs.select(
        "cell", "nbr", F.degrees(F.atan2(sine, cosine)).alias("angle"),
        (east / sine).alias("e0"), (north / sine).alias("n0"), (cos("y0") * sin(d) / sine).alias("e1"), (back / sine).alias("n1"),
        (cosine * east / sine).alias("ec"), (cosine * north / sine).alias("nc"),
    )


def nearest_reach(grid: DataFrame) -> float:
    """A radius within which every point of the sphere has a cell of a global grid."""
    ni, nj = grid.agg(F.max("i") + 1, F.max("j") + 1).first()
    return 1.5 * max(360 / ni, 180 / nj)


def _with_centre(ring: DataFrame, weights: dict) -> DataFrame:
    """(cell, nbr, weights): the ring's rows and one for the centre; ``weights`` has a column for
    the ring and one that the centre sums up, by name."""
    far = ring.select("cell", "nbr", *(w.alias(name) for name, (w, _) in weights.items()))
    own = ring.groupBy("cell").agg(*(F.sum(c).alias(name) for name, (_, c) in weights.items()))
    return far.unionByName(own.withColumn("nbr", F.col("cell")))


def laplacian_stencil(grid: DataFrame, n: int, dist: float) -> DataFrame:
    """(cell, nbr, weight): 4 / n of the sum of differences from the centre, each over the square
    of its own distance in radians."""
    w = 4 / n / F.radians("angle") ** 2
    return _with_centre(ring_stencil(grid, n, dist), {"weight": (w, -w)})


def gradient_stencil(grid: DataFrame, n: int, dist: float) -> DataFrame:
    """(cell, nbr, weight_e, weight_n): gradient per metre from differences between a ring's cells
    and the centre, along the directions of the cells."""
    scale = 2 / (geo.EARTH_RADIUS * n * math.radians(dist))
    e, nn = F.col("ec") * scale, F.col("nc") * scale
    return _with_centre(ring_stencil(grid, n, dist), {"weight_e": (e, -e), "weight_n": (nn, -nn)})


def mean_stencil(grid: DataFrame, dist: float) -> DataFrame:
    """(cell, nbr, weight): area weights of the cells within ``dist``; not normalised."""
    return disc(grid, dist).join(grid.select(F.col("cell").alias("nbr"), F.col("area").alias("weight")), "nbr").select("cell", "nbr", "weight")


def apply_mean(field: DataFrame, stencil: DataFrame, value: str, out: str = "mean") -> DataFrame:
    """Weighted mean over a stencil's cells that aren't missing."""
    joined = field.select("time", F.col("cell").alias("nbr"), F.col(value).alias("_v")).where("_v IS NOT NULL").join(stencil, "nbr")
    return joined.groupBy("time", "cell").agg((F.sum(F.col("weight") * F.col("_v")) / F.sum("weight")).alias(out))


def apply_sum(field: DataFrame, stencil: DataFrame, sums: dict) -> DataFrame:
    """(time, cell, sums) with ``sums`` name -> (weight column, value column); null unless the
    whole stencil has a value."""
    values = sorted({v for _, v in sums.values()})
    whole = stencil.groupBy("cell").agg(F.count("*").alias("_n"))
    rows = field.select("time", F.col("cell").alias("nbr"), *values).dropna(subset=values).join(stencil, "nbr")
    made = rows.groupBy("time", "cell").agg(F.count("*").alias("_m"), *(F.sum(F.col(w) * F.col(v)).alias(name) for name, (w, v) in sums.items()))
    return made.join(whole, "cell").select("time", "cell", *(F.when(F.col("_m") == F.col("_n"), F.col(name)).alias(name) for name in sums))


def laplacian(field: DataFrame, grid: DataFrame, value: str, n: int, dist: float) -> DataFrame:
    return apply_sum(field, laplacian_stencil(grid, n, dist), {"laplacian": ("weight", value)})


def gradient_magnitude(field: DataFrame, grid: DataFrame, value: str, n: int, dist: float) -> DataFrame:
    g = apply_sum(field, gradient_stencil(grid, n, dist), {"e": ("weight_e", value), "n": ("weight_n", value)})
    return g.select("time", "cell", F.hypot("e", "n").alias("gradient"))


def vector_dot_gradient(field: DataFrame, grid: DataFrame, u: str, v: str, value: str, n: int, dist: float) -> DataFrame:
    g = apply_sum(field, gradient_stencil(grid, n, dist), {"e": ("weight_e", value), "n": ("weight_n", value)})
    return g.join(field.select("time", "cell", F.col(u).alias("_u"), F.col(v).alias("_v")), ["time", "cell"]).select("time", "cell", (F.col("_u") * F.col("e") + F.col("_v") * F.col("n")).alias("advection"))


def curl_and_divergence(field: DataFrame, grid: DataFrame, u: str, v: str, n: int, dist: float) -> DataFrame:
    """Curl and divergence per second: circulation and flux on a ring over the circle's area.

    The azimuthal and radial wind is taken at the centre and at the ring's cells, each with its
    own directions, and interpolated (or extrapolated) to ``dist``.
    """
    scale = 2 / (geo.EARTH_RADIUS * n * math.radians(dist))
    c1 = F.lit(dist) / F.col("angle") * scale
    c0 = F.lit(scale) - c1
    parts = {"we": (c1 * F.col("e1"), c0 * F.col("e0")), "wn": (c1 * F.col("n1"), c0 * F.col("n0"))}
    weights = _with_centre(ring_stencil(grid, n, dist), parts)
    s = apply_sum(field, weights, {"ue": ("we", u), "vn": ("wn", v), "un": ("wn", u), "ve": ("we", v)})
    return s.select("time", "cell", (F.col("ve") - F.col("un")).alias("curl"), (F.col("ue") + F.col("vn")).alias("divergence"))


def nearest(points: DataFrame, targets: DataFrame, key: list[str], target_key: str, radius: float, on: list[str] | None = None) -> DataFrame:
    """For each point (rows of ``key``) the nearest target within ``radius``; ties to the smaller key."""
    near = within(points, targets, radius, on)
    return near.withColumn("_rank", F.row_number().over(Window.partitionBy(*key).orderBy("dist", target_key))).where("_rank = 1").drop("_rank")
