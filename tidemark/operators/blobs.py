"""Area features: masks, connected components, objects linked in time, and their statistics."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geo


def components(mask: DataFrame, edge: DataFrame, keys: list[str] = ["time"]) -> DataFrame:  # noqa: B006
    """(keys, cell, blob): connected cells of each time slice; blob is the smallest cell.

    A slice has one row a cell at most, so it is a group of the grid's size.
    """
    near = mask.sparkSession.sparkContext.broadcast(edge.toPandas().to_numpy())

    def label(pdf: pd.DataFrame) -> pd.DataFrame:
        cells = np.unique(pdf["cell"].to_numpy())
        pairs = near.value
        have = pairs[np.isin(pairs[:, 0], cells) & np.isin(pairs[:, 1], cells)]
        a, b = np.searchsorted(cells, have[:, 0]), np.searchsorted(cells, have[:, 1])
        root = np.arange(len(cells))
        while True:
            low = root.copy()
            np.minimum.at(low, a, root[b])
            np.minimum.at(low, b, root[a])
            low = low[low]
            if (low == root).all():
                break
            root = low
        out = pdf[keys].iloc[[0] * len(cells)].reset_index(drop=True)
        return out.assign(cell=cells, blob=cells[root])

    kinds = dict(mask.dtypes)
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), "cell int", "blob int"])
    return mask.select(*keys, F.col("cell").cast("int").alias("cell")).groupBy(*keys).applyInPandas(label, schema)


def keep_blobs(blobs: DataFrame, having: Column, field: DataFrame | None = None) -> DataFrame:
    """Blobs whose cells satisfy an aggregate condition, as ``count_if`` of a field or a sum of
    areas; the condition is one group-by and a semi join."""
    rows = blobs if field is None else blobs.join(field, ["time", "cell"])
    kept = rows.groupBy("time", "blob").agg(having.alias("_keep")).where("_keep").select("time", "blob")
    return blobs.join(kept, ["time", "blob"], "left_semi").select("time", "cell", "blob")


def at_least(condition: Column, count: int) -> Column:
    return F.count_if(condition) >= count


def bounding_boxes(cells: DataFrame, grid: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, minlat, maxlat, minlon, maxlon): the smallest periodic box round cell centres.

    The box is what the largest gap between neighbouring longitudes leaves; of equal gaps that
    behind the smallest longitude counts. minlon > maxlon where the box crosses 0.
    """
    at = cells.select(*keys, "cell").join(F.broadcast(grid.select("cell", "lon", "lat")), "cell")
    lats = at.groupBy(*keys).agg(F.min("lat").alias("minlat"), F.max("lat").alias("maxlat"))
    w = Window.partitionBy(*keys).orderBy("lon")
    lons = at.select(*keys, "lon").distinct().withColumn("_next", F.lead("lon").over(w)).withColumn("_first", F.min("lon").over(Window.partitionBy(*keys)))
    gap = F.coalesce(F.col("_next") - F.col("lon"), F.col("_first") + 360 - F.col("lon"))
    widest = lons.groupBy(*keys).agg(F.min(F.struct((-gap).alias("g"), F.col("lon").alias("hi"), F.coalesce("_next", "_first").alias("lo"))).alias("b"))
    return lats.join(widest, keys).select(*keys, "minlat", "maxlat", F.col("b.lo").alias("minlon"), F.col("b.hi").alias("maxlon"))


def box_width(box_min: str = "minlon", box_max: str = "maxlon") -> Column:
    return F.when(F.col(box_max) >= F.col(box_min), F.col(box_max) - F.col(box_min)).otherwise(F.col(box_max) - F.col(box_min) + 360)


def area_fraction(blobs: DataFrame, grid: DataFrame, cell_width: float, cell_height: float) -> DataFrame:
    """(time, blob, area, fraction): area in steradians and its share of the bounding box, which
    reaches half a cell beyond the centres."""
    boxes = bounding_boxes(blobs, grid, ["time", "blob"])
    sums = blobs.join(F.broadcast(grid.select("cell", "area")), "cell").groupBy("time", "blob").agg(F.sum("area").alias("area"))
    north, south = F.radians(F.least(F.col("maxlat") + cell_height / 2, F.lit(90.0))), F.radians(F.greatest(F.col("minlat") - cell_height / 2, F.lit(-90.0)))
    whole = (F.sin(north) - F.sin(south)) * F.radians(F.least(box_width() + cell_width, F.lit(360.0)))
    return sums.join(boxes.withColumn("box", whole), ["time", "blob"]).select("time", "blob", "area", (F.col("area") / F.col("box")).alias("fraction"))


def merge_blobs(blobs: DataFrame, grid: DataFrame, dist: float) -> DataFrame:
    """Give blobs of one time that come within ``dist`` degrees of each other one label, the
    smallest, through any number of blobs between."""
    from .grid import within

    spots = blobs.join(F.broadcast(grid.select("cell", "lon", "lat")), "cell")
    pairs = within(spots.select("time", "blob", "lon", "lat"), spots.select("time", F.col("blob").alias("b2"), "lon", "lat"), dist, ["time"]).where("blob > b2").select("time", "blob", "b2").distinct()

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        root: dict = {}

        def find(v):
            while root.setdefault(v, v) != v:
                v = root[v]
            return v

        for a, b in zip(pdf["blob"].tolist(), pdf["b2"].tolist()):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
        own = sorted(root)
        return pd.DataFrame({"time": [pdf["time"].iloc[0]] * len(own), "blob": own, "label": [find(v) for v in own]})

    kinds = dict(blobs.dtypes)
    labels = pairs.groupBy("time").applyInPandas(join, f"time {kinds['time']}, blob int, label int")
    return blobs.join(labels, ["time", "blob"], "left").select("time", "cell", F.coalesce("label", "blob").alias("blob"))


def overlaps(blobs: DataFrame, steps: DataFrame, grid: DataFrame) -> DataFrame:
    """(step, blob, prev, shared, share_next, share_prev): blobs of consecutive times that share
    cells; the shares are of the current and of the earlier blob's area, in percent.

    ``steps`` (time, step) numbers the times.
    """
    cells = blobs.join(steps, "time").join(F.broadcast(grid.select("cell", "area")), "cell").select("step", "cell", "blob", "area")
    size = cells.groupBy("step", "blob").agg(F.sum("area").alias("size"))
    before = cells.select((F.col("step") + 1).alias("step"), "cell", F.col("blob").alias("prev"))
    met = cells.join(before, ["step", "cell"]).groupBy("step", "blob", "prev").agg(F.sum("area").alias("shared"))
    own = met.join(size, ["step", "blob"])
    old = size.select((F.col("step") + 1).alias("step"), F.col("blob").alias("prev"), F.col("size").alias("before"))
    return own.join(old, ["step", "prev"]).select("step", "blob", "prev", "shared", (100 * F.col("shared") / F.col("size")).alias("share_next"), (100 * F.col("shared") / F.col("before")).alias("share_prev"))


def link_components(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, component) for all ids of ``nodes`` (id) under links ``pairs`` (a, b): the smallest
    id reachable, by minimum labels over links and pointer jumping until nothing changes."""
    both = pairs.select("a", "b").unionAll(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = _kept(both)
    label = _kept(nodes.select("id", F.col("id").alias("component")))
    while True:
        seen = both.join(label.select(F.col("id").alias("b"), "component"), "b").groupBy("a").agg(F.min("component").alias("m"))
        low = label.join(seen.withColumnRenamed("a", "id"), "id", "left").select("id", F.col("component").alias("was"), F.least("component", F.coalesce("m", "component")).alias("component"))
        jump = low.select(F.col("id").alias("component"), F.col("component").alias("to"))
        after = _kept(low.join(jump, "component", "left").select("id", "was", F.coalesce("to", "component").alias("component")))
        if after.where("was <> component").isEmpty():
            return after.select("id", "component")
        label = after.select("id", "component")


def _kept(df: DataFrame) -> DataFrame:
    """Cut lineage in the session's checkpoint folder; a temporary one only where none is set, and
    that only in local mode."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        import tempfile

        folder = context.getConf().get("spark.checkpoint.dir") or df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tidemark-"))
    return df.checkpoint()


def numbered(ids: DataFrame, key: str, out: str) -> DataFrame:
    """``ids`` with their place (from 1) in the order of a distinct key, without one task that sees
    all: ranks within ranges of the key, and the numbers of rows in the ranges before."""
    dealt = _kept(ids.repartitionByRange(key).withColumn("_p", F.spark_partition_id()))
    # one row a range
    before = dealt.groupBy("_p").agg(F.count("*").alias("_n")).select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    ranked = dealt.withColumn("_k", F.row_number().over(Window.partitionBy("_p").orderBy(key)))
    return ranked.join(F.broadcast(before), "_p").select(*ids.columns, (F.col("_k") + F.col("_base")).cast("long").alias(out))


def objects(blobs: DataFrame, steps: DataFrame, grid: DataFrame, least_next: float = 0.0, least_prev: float = 0.0, most_next: float = 100.0, most_prev: float = 100.0) -> DataFrame:
    """(time, cell, blob, object_id): blobs linked over consecutive times where they overlap.

    Objects are numbered from 1 by their first time, then the smallest blob in it.
    """
    links = overlaps(blobs, steps, grid).where(F.col("share_next").between(least_next, most_next + 1e-9) & F.col("share_prev").between(least_prev, most_prev + 1e-9))
    number = lambda step, blob: F.col(step).cast("long") * 2**32 + F.col(blob)
    named = blobs.join(steps, "time").withColumn("id", number("step", "blob"))
    pairs = links.select(number("step", "blob").alias("a"), ((F.col("step") - 1).cast("long") * 2**32 + F.col("prev")).alias("b"))
    found = link_components(pairs, named.select("id").distinct())
    order = numbered(found.select("component").distinct(), "component", "object_id")
    return named.join(found, "id").join(order, "component").select("time", "cell", "blob", "object_id")


def keep_objects(tracked: DataFrame, least_times: int = 1, grid: DataFrame | None = None, region: tuple | None = None, region_times: int = 1) -> DataFrame:
    """Objects of at least so many times, of which ``region_times`` touch a (lon0, lon1, lat0,
    lat1) box; they keep their numbers."""
    at = tracked.join(F.broadcast(grid.select("cell", "lon", "lat")), "cell") if region else tracked
    made = [F.count_distinct("time").alias("n")]
    if region:
        made.append(F.count_distinct(F.when(geo.in_box("lon", "lat", *region), F.col("time"))).alias("inside"))
    good = at.groupBy("object_id").agg(*made).where(F.col("n") >= least_times)
    if region:
        good = good.where(F.col("inside") >= region_times)
    return tracked.join(good.select("object_id"), "object_id", "left_semi")


def statistics(cells: DataFrame, grid: DataFrame, keys: list[str], weight: str | None = None) -> DataFrame:
    """One row a blob: box, its middle, area-weighted centroid on the sphere, area (m2); with a
    weight column also weighted area and centroid."""
    boxes = bounding_boxes(cells, grid, keys)
    at = cells.join(F.broadcast(grid.select("cell", "lon", "lat", "area")), "cell")
    vectors = geo.xyz("lon", "lat")
    sums = [F.sum("area").alias("_a"), *(F.sum(F.col("area") * v).alias(f"_{k}") for k, v in zip("xyz", vectors))]
    if weight:
        wa = F.col("area") * F.col(weight)
        sums += [F.sum(wa).alias("_wa"), *(F.sum(wa * v).alias(f"_w{k}") for k, v in zip("xyz", vectors))]
    s = at.groupBy(*keys).agg(*sums).join(boxes, keys)
    lon, lat = geo.lon_lat("_x", "_y", "_z")
    out = [*keys, "minlat", "maxlat", "minlon", "maxlon", ((F.col("minlat") + F.col("maxlat")) / 2).alias("meanlat"), geo.norm_lon(F.col("minlon") + box_width() / 2).alias("meanlon"), lon.alias("centlon"), lat.alias("centlat"), (F.col("_a") * geo.EARTH_RADIUS**2).alias("area")]
    if weight:
        wlon, wlat = geo.lon_lat("_wx", "_wy", "_wz")
        out += [(F.col("_wa") * geo.EARTH_RADIUS**2).alias("wtarea"), wlon.alias("wtcentlon"), wlat.alias("wtcentlat")]
    return s.select(*out)


def principal_axes(cells: DataFrame, grid: DataFrame, keys: list[str], weight: str) -> DataFrame:
    """(keys, length, width): angles of the principal axes of weighted cells in the stereographic
    plane about their weighted centroid."""
    centre = statistics(cells, grid, keys, weight).select(*keys, "wtcentlon", "wtcentlat")
    at = cells.join(F.broadcast(grid.select("cell", "lon", "lat", "area")), "cell").join(centre, keys)
    px, py = geo.stereographic("lon", "lat", "wtcentlon", "wtcentlat")
    wa = F.col("area") * F.col(weight)
    p = at.select(*keys, wa.alias("m"), px.alias("px"), py.alias("py"))
    s = p.groupBy(*keys).agg(*((F.sum(F.col("m") * a) / F.sum("m")).alias(k) for k, a in (("xx", F.col("px") ** 2), ("yy", F.col("py") ** 2), ("xy", F.col("px") * F.col("py")))))
    half, root = (F.col("xx") + F.col("yy")) / 2, F.sqrt(((F.col("xx") - F.col("yy")) / 2) ** 2 + F.col("xy") ** 2)
    angle = lambda v: F.degrees(2 * F.atan(F.sqrt(F.greatest(v, F.lit(0.0)))))
    return s.select(*keys, angle(half + root).alias("length"), angle(half - root).alias("width"))


def running_ids(blobs: DataFrame) -> DataFrame:
    """(time, cell, blob_id): blobs numbered from 1 through all times, in order of time and then of
    their smallest cell, without following them from one time to the next."""
    key = F.struct("time", "blob")
    ids = numbered(blobs.select(key.alias("key")).distinct(), "key", "blob_id")
    return blobs.withColumn("key", key).join(ids, "key").select("time", "cell", "blob_id")


def flattened(tracked: DataFrame) -> DataFrame:
    """(time, cell, tag): 1 wherever any object is."""
    return tracked.select("time", "cell").distinct().withColumn("tag", F.lit(1))


def either(*masks: DataFrame) -> DataFrame:
    """(time, cell) tagged in any of the masks."""
    out = masks[0].select("time", "cell")
    for mask in masks[1:]:
        out = out.unionAll(mask.select("time", "cell"))
    return out.distinct()


def density(mask: DataFrame, times: int) -> DataFrame:
    """(cell, density): the share of all times at which a cell is tagged."""
    return mask.groupBy("cell").agg((F.count_distinct("time") / times).alias("density"))


def persistent(field: DataFrame, good: Column, least: int, key: str = "cell", order: list[str] = ["time"]) -> DataFrame:  # noqa: B006
    """Rows in runs of at least ``least`` consecutive samples of a cell that satisfy ``good``."""
    w = Window.partitionBy(key).orderBy(*order)
    marked = field.withColumn("_good", F.coalesce(good, F.lit(False))).withColumn("_run", F.sum(F.when(F.col("_good"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    long = marked.where("_good").withColumn("_n", F.count("*").over(Window.partitionBy(key, "_run")))
    return long.where(F.col("_n") >= least).drop("_good", "_run", "_n")


def ridges(field: DataFrame, value: str, least: float, least_fall: float, offset: int = 1, min_abs_lat: float = 0.0) -> DataFrame:
    """Ridge cells (time, cell, value, fall, spine): the 9-point Laplacian at an offset of cells
    falls by ``least_fall`` or more and the value is high enough; spine marks local maxima along
    the row or the column.

    ``field`` has time, cell, i, j, lat and value; neighbours are looked up by (i, j), round in i.
    """
    last = field.agg(F.max("i")).first()[0]
    n = (last or 0) + 1
    steps = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b]
    known = field.where(F.col(value).isNotNull()).select("time", "cell", "i", "j", "lat", F.col(value).alias("value"))
    moves = F.explode(F.array(*(F.struct(F.lit(a).alias("di"), F.lit(b).alias("dj")) for a, b in steps))).alias("m")
    out = known.select("time", "cell", "i", "j", "value", moves).select("time", F.pmod(F.col("i") + F.col("m.di") * offset, F.lit(n)).alias("i"), (F.col("j") + F.col("m.dj") * offset).alias("j"), "m", F.col("value").alias("v2"))
    weight = F.when((F.col("m.di") == 0) | (F.col("m.dj") == 0), 4.0).otherwise(1.0)
    s = out.groupBy("time", "i", "j").agg(F.count("*").alias("k"), F.sum(weight * F.col("v2")).alias("s"), F.max(F.when(F.col("m.dj") == 0, F.col("v2"))).alias("row"), F.max(F.when(F.col("m.di") == 0, F.col("v2"))).alias("col"))
    made = known.join(s.where("k = 8"), ["time", "i", "j"]).withColumn("fall", (F.col("s") - 20 * F.col("value")) / 6)
    kept = made.where((F.abs("lat") >= min_abs_lat) & (F.col("value") >= least) & (F.col("fall") <= -least_fall))
    return kept.select("time", "cell", "value", "fall", ((F.col("value") >= F.col("row")) | (F.col("value") >= F.col("col"))).alias("spine"))
