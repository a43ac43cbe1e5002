"""Polygonal meshes on the sphere as tables: adjacency, areas, and spectral-element nodes.

A mesh has faces (face, k, node: the corners in order) and nodes (node, x, y, z: unit vectors).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geo

# Gauss-Lobatto points of 2 to 5 nodes on [-1, 1].
GAUSS_LOBATTO = {
    2: (-1.0, 1.0),
    3: (-1.0, 0.0, 1.0),
    4: (-1.0, -math.sqrt(1 / 5), math.sqrt(1 / 5), 1.0),
    5: (-1.0, -math.sqrt(3 / 7), 0.0, math.sqrt(3 / 7), 1.0),
}


def cubed_sphere(spark: SparkSession, n: int) -> tuple[DataFrame, DataFrame]:
    """(faces, nodes) of a sphere cut into 6 * n * n equiangular faces.

    Nodes are the surface points of an (n + 1)**3 lattice on a cube, so panels share theirs:
    node = a + (n + 1) * (b + (n + 1) * c).
    """
    m = n + 1
    at = lambda v: F.tan(F.lit(math.pi / 4) * (2.0 * F.col(v) / n - 1))
    lattice = spark.range(m**3).select((F.col("id") % m).alias("a"), (F.floor(F.col("id") / m) % m).alias("b"), F.floor(F.col("id") / m**2).alias("c"), F.col("id").alias("node"))
    surface = lattice.where(f"a IN (0, {n}) OR b IN (0, {n}) OR c IN (0, {n})")
    size = F.sqrt(at("a") ** 2 + at("b") ** 2 + at("c") ** 2)
    nodes = surface.select("node", *((at(v) / size).alias(k) for v, k in zip("abc", "xyz")))
    id_ = lambda a, b, c: a + m * (b + m * c)
    i, j, panel = F.col("id") % n, F.floor(F.col("id") / n) % n, F.floor(F.col("id") / n**2)
    corner = lambda di, dj: F.when(panel == 0, id_(F.lit(0), i + dj, j + di)).when(panel == 1, id_(F.lit(n), i + di, j + dj)).when(panel == 2, id_(i + di, F.lit(0), j + dj)).when(panel == 3, id_(i + dj, F.lit(n), j + di)).when(panel == 4, id_(i + dj, j + di, F.lit(0))).otherwise(id_(i + di, j + dj, F.lit(n)))
    ring = F.array(*(F.struct(F.lit(k).alias("k"), corner(*d).alias("node")) for k, d in enumerate(((0, 0), (1, 0), (1, 1), (0, 1)))))
    faces = spark.range(6 * n * n).select(F.col("id").alias("face"), F.explode(ring).alias("c")).select("face", "c.k", "c.node")
    return faces, nodes


def _sides(faces: DataFrame) -> DataFrame:
    """(face, k, node, next): the sides of each face in order; sides of no length are left out."""
    w = Window.partitionBy("face").orderBy("k")
    first = F.first("node").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return faces.select("face", "k", "node", F.coalesce(F.lead("node").over(w), first).alias("next")).where("node <> next")


def mesh_edges(faces: DataFrame, corners: bool = False) -> DataFrame:
    """(cell, nbr): faces that share a side, or a node if ``corners``. One equi-join on the sorted
    pair of nodes; a pair is shared by few faces."""
    if corners:
        own = faces.select(F.col("face").alias("cell"), "node").distinct()
        other, on = own.withColumnRenamed("cell", "nbr"), ["node"]
    else:
        own = _sides(faces).select(F.col("face").alias("cell"), F.least("node", "next").alias("p"), F.greatest("node", "next").alias("q"))
        other, on = own.withColumnRenamed("cell", "nbr"), ["p", "q"]
    return own.join(other, on).where("cell <> nbr").select("cell", "nbr").distinct()


def _triple(a: str, b: str, c: str) -> Column:
    x, y, z = ([F.col(f"{v}.{k}") for k in "xyz"] for v in (a, b, c))
    return x[0] * (y[1] * z[2] - y[2] * z[1]) + x[1] * (y[2] * z[0] - y[0] * z[2]) + x[2] * (y[0] * z[1] - y[1] * z[0])


def _dot(a: str, b: str) -> Column:
    return sum((F.col(f"{a}.{k}") * F.col(f"{b}.{k}") for k in "yz"), F.col(f"{a}.x") * F.col(f"{b}.x"))


def mesh_cells(faces: DataFrame, nodes: DataFrame) -> DataFrame:
    """(cell, lon, lat, area): centres (of the corners' sum) and areas in steradians of the faces,
    whose sides are arcs of great circles; corners counter-clockwise seen from outside."""
    at = F.struct("x", "y", "z")
    placed = faces.join(nodes, "node").select("face", "k", at.alias("p"))
    w = Window.partitionBy("face").orderBy("k")
    fan = placed.withColumn("o", F.first("p").over(w)).withColumn("q", F.lead("p").over(w))
    # the solid angle of each triangle of a fan from the first corner
    angle = 2 * F.atan2(_triple("o", "p", "q"), 1 + _dot("o", "p") + _dot("p", "q") + _dot("q", "o"))
    s = fan.groupBy("face").agg(F.sum(F.when(F.col("q").isNotNull(), angle)).alias("area"), *(F.sum(f"p.{k}").alias(k) for k in "xyz"))
    lon, lat = geo.lon_lat("x", "y", "z")
    return s.select(F.col("face").cast("int").alias("cell"), lon.alias("lon"), lat.alias("lat"), "area")


def spectral_nodes(faces: DataFrame, nodes: DataFrame, order: int, continuous: bool = True) -> DataFrame:
    """(face, i, j, gll, lon, lat): the order * order Gauss-Lobatto nodes of each face of four
    corners, placed bilinearly between them and put on the sphere.

    With ``continuous``, nodes that faces share are one: by the mesh node at a corner, by the pair
    of mesh nodes and the place between them on a side, so that nothing depends on rounding.
    ``gll`` is a key of the node (the same for the same mesh), a string.
    """
    if order not in GAUSS_LOBATTO:
        raise ValueError(f"order must be among {sorted(GAUSS_LOBATTO)}")
    last = order - 1
    four = faces.groupBy("face").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "node"))), lambda c: c["node"]).alias("c"))
    axis = F.sequence(F.lit(0), F.lit(last))
    at = four.where("size(c) = 4").withColumn("i", F.explode(axis)).withColumn("j", F.explode(axis))
    n = [F.col("c")[k] for k in range(4)]
    key = lambda *parts: F.concat_ws(":", *(p.cast("string") for p in parts))
    side = lambda p, q, t: key(F.least(p, q), F.greatest(p, q), F.when(p < q, t).otherwise(last - t))
    i, j = F.col("i"), F.col("j")
    inner = key(F.lit("f"), F.col("face"), i, j)
    shared = (
        F.when((i == 0) & (j == 0), key(n[0])).when((i == last) & (j == 0), key(n[1])).when((i == last) & (j == last), key(n[2])).when((i == 0) & (j == last), key(n[3]))
        .when(j == 0, side(n[0], n[1], i)).when(i == last, side(n[1], n[2], j)).when(j == last, side(n[3], n[2], i)).when(i == 0, side(n[0], n[3], j))
        .otherwise(inner)
    )
    # a face becomes order * order * 4 rows, which Spark's estimate doesn't see: never by broadcast
    rows = at.select("face", "i", "j", (shared if continuous else inner).alias("gll"), F.posexplode("c").alias("k", "node")).join(nodes.hint("merge"), "node")
    points = F.array(*(F.lit((p + 1) / 2) for p in GAUSS_LOBATTO[order]))
    s, t = points[i], points[j]
    weight = F.when(F.col("k").isin(1, 2), s).otherwise(1 - s) * F.when(F.col("k").isin(2, 3), t).otherwise(1 - t)
    sums = rows.groupBy("face", "i", "j", "gll").agg(*(F.sum(weight * F.col(k)).alias(k) for k in "xyz"))
    lon, lat = geo.lon_lat("x", "y", "z")
    return sums.select("face", "i", "j", "gll", lon.alias("lon"), lat.alias("lat"))


def spectral_edges(placed: DataFrame) -> DataFrame:
    """(cell, nbr) of GLL keys that are next to each other on an element's lattice."""
    step = F.explode(F.array(F.struct(F.lit(1).alias("di"), F.lit(0).alias("dj")), F.struct(F.lit(0).alias("di"), F.lit(1).alias("dj")))).alias("m")
    ahead = placed.select("face", (F.col("i") - 1).alias("i"), "j", F.col("gll").alias("nbr")).unionAll(placed.select("face", "i", (F.col("j") - 1).alias("j"), F.col("gll").alias("nbr")))
    one = placed.select("face", "i", "j", F.col("gll").alias("cell")).join(ahead.hint("merge"), ["face", "i", "j"]).select("cell", "nbr").where("cell <> nbr").distinct()
    return one.unionAll(one.select(F.col("nbr").alias("cell"), F.col("cell").alias("nbr"))).distinct()


def mesh_of_corners(corners: DataFrame, digits: int = 10) -> tuple[DataFrame, DataFrame]:
    """(faces, nodes) from faces with a place for each corner (face, k, lon, lat), as grid files
    list them: corners at the same place (to so many digits of the unit vector) are one node,
    and repeated corners of a face count once."""
    x, y, z = geo.xyz("lon", "lat")
    # 0.0 + puts -0.0 and 0.0 together
    placed = corners.select("face", "k", *((F.round(v, digits) + F.lit(0.0)).alias(k) for v, k in ((x, "x"), (y, "y"), (z, "z"))))
    key = F.xxhash64("x", "y", "z")
    nodes = placed.select(key.alias("node"), "x", "y", "z").distinct()
    faces = placed.select("face", "k", key.alias("node")).groupBy("face", "node").agg(F.min("k").alias("k"))
    return faces.select("face", "k", "node"), nodes


def read_scrip(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(faces, nodes) of a grid file in SCRIP's layout (NetCDF classic): a row of the corners'
    longitudes and latitudes in degrees for each cell."""
    from ..sources.netcdf3 import NetCDF3

    spark.dataSource.register(NetCDF3)
    rows = spark.read.format("netcdf3").option("variables", "grid_corner_lon,grid_corner_lat").load(path)
    return mesh_of_corners(rows.select(F.col("t").cast("long").alias("face"), F.col("cell").alias("k"), F.col("grid_corner_lon").alias("lon"), F.col("grid_corner_lat").alias("lat")))
