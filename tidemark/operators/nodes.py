"""Point features: extrema, their filters, and what is measured round them."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import lon_difference, norm_lon
from .grid import within

COMPARE = {">": lambda a, b: a > b, "<": lambda a, b: a < b, ">=": lambda a, b: a >= b, "<=": lambda a, b: a <= b, "=": lambda a, b: a == b, "!=": lambda a, b: a != b}


def compare(column, op: str, value) -> Column:
    return COMPARE[op](F.col(column) if isinstance(column, str) else column, F.lit(value))


def extrema(field: DataFrame, edge: DataFrame, value: str, largest: bool = False, where: Column | None = None) -> DataFrame:
    """(time, cell, value): cells of which no neighbour is strictly better; equals all stay.

    Missing cells never count, on either side. ``where`` restricts candidates, not neighbours.
    The neighbour table has the size of the grid and is joined to each time's cells.
    """
    known = field.where(F.col(value).isNotNull()).select("time", "cell", F.col(value).alias("value"))
    near = known.select("time", F.col("cell").alias("nbr"), F.col("value").alias("_w")).join(F.broadcast(edge), "nbr")
    best = near.groupBy("time", "cell").agg((F.max("_w") if largest else F.min("_w")).alias("_best"))
    own = known if where is None else known.where(where)
    kept = own.join(best, ["time", "cell"], "left")
    better = (F.col("_best") > F.col("value")) if largest else (F.col("_best") < F.col("value"))
    return kept.where(F.col("_best").isNull() | ~better).select("time", "cell", "value")


def merge_near(nodes: DataFrame, grid: DataFrame, dist: float, largest: bool = False, merge_equal: bool = False) -> DataFrame:
    """Nodes without a strictly better one of their time within ``dist`` degrees.

    With ``merge_equal``, of equal ones within reach of each other the smaller cells win, taken
    in order of the cell, by time: a time's nodes are one group.
    """
    placed = nodes.join(F.broadcast(grid.select("cell", "lon", "lat")), "cell")
    other = placed.select("time", F.col("cell").alias("c2"), F.col("value").alias("v2"), "lon", "lat")
    better = (F.col("v2") > F.col("value")) if largest else (F.col("v2") < F.col("value"))
    beaten = within(placed, other, dist, ["time"]).where(better).select("time", "cell").distinct()
    left = nodes.join(beaten, ["time", "cell"], "left_anti")
    if not merge_equal:
        return left
    spots = left.join(F.broadcast(grid.select("cell", "lon", "lat")), "cell")
    pairs = within(spots, spots.select("time", F.col("cell").alias("c2"), F.col("value").alias("v2"), "lon", "lat"), dist, ["time"]).where("c2 < cell AND v2 = value").select("time", "cell", "c2")

    def drop(pdf: pd.DataFrame) -> pd.DataFrame:
        gone = set()
        for cell, lower in sorted(pdf.groupby("cell")["c2"]):
            if any(x not in gone for x in lower):
                gone.add(cell)
        return pd.DataFrame({"time": [pdf["time"].iloc[0]] * len(gone), "cell": sorted(gone)})

    dropped = pairs.groupBy("time").applyInPandas(drop, pairs.select("time", "cell").schema)
    return left.join(dropped, ["time", "cell"], "left_anti")


def threshold_near(nodes: DataFrame, field: DataFrame, disc: DataFrame, value: str, op: str, limit: float) -> DataFrame:
    """Nodes with a cell in their disc (cell, nbr, dist) whose value satisfies the comparison."""
    good = field.where(compare(value, op, limit)).select("time", F.col("cell").alias("nbr"))
    hit = good.join(disc.select("cell", "nbr"), "nbr").select("time", "cell").distinct()
    return nodes.join(hit, ["time", "cell"], "left_semi")


def threshold_tree(nodes: DataFrame, field: DataFrame, discs: dict, tree) -> DataFrame:
    """Nodes for which a tree of thresholds holds.

    A leaf is (value column, op, limit, distance); ("and", ...) and ("or", ...) join subtrees.
    Leaves at distance 0 with others become one semi join each; ``discs`` has the disc table of
    each distance.
    """
    if tree[0] == "and":
        for part in tree[1:]:
            nodes = threshold_tree(nodes, field, discs, part)
        return nodes
    if tree[0] == "or":
        keys = None
        for part in tree[1:]:
            own = threshold_tree(nodes, field, discs, part).select("time", "cell")
            keys = own if keys is None else keys.unionAll(own)
        return nodes.join(keys.distinct(), ["time", "cell"], "left_semi")
    value, op, limit, distance = tree
    if distance == 0:
        return nodes.join(field.where(compare(value, op, limit)).select("time", "cell"), ["time", "cell"], "left_semi")
    return threshold_near(nodes, field, discs[distance], value, op, limit)


def in_region(nodes: DataFrame, grid: DataFrame, box: tuple | None = None, min_abs_lat: float = 0.0, max_abs_lat: float = 90.0) -> DataFrame:
    """Nodes in a (lon0, lon1, lat0, lat1) box and band of absolute latitude; a pair of equal
    bounds is no bound."""
    from ..functions.geo import in_box

    spots = grid.where(F.abs("lat").between(min_abs_lat, max_abs_lat))
    if box:
        lon0, lon1, lat0, lat1 = box
        lon = (lon0, lon1) if lon0 != lon1 else (0.0, 359.999999)
        lat = (lat0, lat1) if lat0 != lat1 else (-90.0, 90.0)
        spots = spots.where(in_box("lon", "lat", *lon, *lat))
    return nodes.join(spots.select("cell"), "cell", "left_semi")


def around(nodes: DataFrame, field: DataFrame, disc: DataFrame, value: str) -> DataFrame:
    """A row for each node and cell of its disc that isn't missing: time, cell, nbr, dist, v."""
    v = field.where(F.col(value).isNotNull()).select("time", F.col("cell").alias("nbr"), F.col(value).alias("v"))
    return nodes.select("time", "cell").join(disc, "cell").join(v, ["time", "nbr"])


def measure(nodes: DataFrame, field: DataFrame, disc: DataFrame, value: str) -> DataFrame:
    """(time, cell, max, min, avg, maxdist, mindist, maxcell, mincell) over each node's disc.

    The average is not weighted; of equal extremes the nearest counts, then the smallest cell.
    Nodes without any value in reach have nulls.
    """
    first = F.struct(F.col("dist"), F.col("nbr"))
    made = around(nodes, field, disc, value).groupBy("time", "cell").agg(
        F.max("v").alias("max"),
        F.min("v").alias("min"),
        F.avg("v").alias("avg"),
        F.min(F.struct(-F.col("v"), first)).alias("_hi"),
        F.min(F.struct(F.col("v"), first)).alias("_lo"),
    )
    out = made.select("time", "cell", "max", "min", "avg", F.col("_hi.col2.dist").alias("maxdist"), F.col("_lo.col2.dist").alias("mindist"), F.col("_hi.col2.nbr").alias("maxcell"), F.col("_lo.col2.nbr").alias("mincell"))
    return nodes.select("time", "cell").join(out, ["time", "cell"], "left")


def positive_minus_negative_area(nodes: DataFrame, field: DataFrame, disc: DataFrame, grid: DataFrame, value: str) -> DataFrame:
    """Sum of value times area over positive cells less that of absolute values over negative ones."""
    cells = grid.select(F.col("cell").alias("nbr"), "area")
    return around(nodes, field, disc, value).join(F.broadcast(cells), "nbr").groupBy("time", "cell").agg(F.sum(F.col("v") * F.col("area")).alias("wtarea"))


def max_poleward(nodes: DataFrame, field: DataFrame, grid: DataFrame, value: str, width: float) -> DataFrame:
    """Largest value poleward of each node within ``width`` degrees of its longitude.

    Nodes and values meet by time, hemisphere and columns of longitude as wide as ``width``.
    """
    columns = max(1, int(360 // width))
    place = F.least(F.floor(norm_lon("lon") / 360 * columns), F.lit(columns - 1)).cast("int")
    at = grid.select("cell", "lon", "lat", F.signum("lat").alias("half"), place.alias("column"))
    steps = F.array_distinct(F.array(*(F.pmod(F.col("column") + d, F.lit(columns)) for d in (-1, 0, 1))))
    spots = nodes.select("time", "cell").join(at, "cell").withColumn("column", F.explode(steps))
    values = field.where(F.col(value).isNotNull()).select("time", "cell", F.col(value).alias("v")).join(at, "cell")
    values = values.select("time", "half", "column", "v", F.col("lon").alias("lon2"), F.col("lat").alias("lat2"))
    near = spots.join(values, ["time", "half", "column"]).where((F.abs("lat2") >= F.abs("lat")) & (F.abs(lon_difference("lon", "lon2")) < width))
    return near.groupBy("time", "cell").agg(F.max("v").alias("maxpoleward"))


class Neighbours:
    """A neighbour table and cell places as arrays for kernels; the size of the grid."""

    def __init__(self, grid: DataFrame, edge: DataFrame):
        cells = grid.select("cell", "lon", "lat", "area").toPandas().sort_values("cell")
        pairs = edge.toPandas().sort_values(["cell", "nbr"])
        self.lon, self.lat, self.area = (np.asarray(cells[x], float) for x in ("lon", "lat", "area"))
        at = np.searchsorted(pairs["cell"], np.arange(len(cells) + 1))
        self.near = [pairs["nbr"].to_numpy()[a:b] for a, b in zip(at, at[1:])]

    def distance(self, a: int, b: int) -> float:
        x, y = np.radians(self.lat[a]), np.radians(self.lat[b])
        return float(np.degrees(np.arccos(np.clip(np.sin(x) * np.sin(y) + np.cos(x) * np.cos(y) * np.cos(np.radians(self.lon[a] - self.lon[b])), -1, 1)))) if a != b else 0.0

    def disc(self, start: int, radius: float) -> list[int]:
        """Cells connected to ``start`` through cells within ``radius``."""
        seen, out = {start}, [start]
        for cell in out:
            for other in self.near[cell]:
                if other not in seen and self.distance(start, other) <= radius:
                    seen.add(other)
                    out.append(other)
        return out


def closed(near: Neighbours, value: dict, start: int, delta: float, dist: float, search: float) -> bool:
    """Whether a contour ``delta`` from the extreme near ``start`` closes within ``dist``.

    The pivot is the smallest value (delta > 0; else the largest) within ``search`` of the start.
    The flood visits its neighbours and goes on behind those that change by less than delta; no
    visited cell, whatever its value, may be farther than ``dist`` from the pivot. Missing
    cells aren't visited.
    """
    sign = 1 if delta > 0 else -1
    pivot = _pivot(near, value, start, sign, search)
    if pivot is None:
        return False
    seen, open_ = {pivot}, [pivot]
    while open_:
        cell = open_.pop()
        if near.distance(pivot, cell) > dist:
            return False
        if sign * (value[cell] - value[pivot]) >= abs(delta):
            continue
        for other in near.near[cell]:
            if other not in seen and other in value:
                seen.add(other)
                open_.append(other)
    return True


def _pivot(near: Neighbours, value: dict, start: int, sign: int, search: float) -> int | None:
    """The smallest value (sign > 0; else the largest) near ``start``; ties to the nearer cell."""
    known = [x for x in near.disc(start, search) if x in value]
    return min(known, key=lambda x: (sign * value[x], round(near.distance(start, x), 9), x), default=None)


def largest_closed_delta(near: Neighbours, value: dict, start: int, dist: float, sign: int = 1, search: float = 0.0) -> tuple[float, float] | None:
    """(delta, value): the largest change from the extreme near ``start`` for which its contour
    stays within ``dist``, with the sign of the change, and the value on that contour.

    Cells are taken in the order of their change, of equal ones those within ``dist`` first;
    the first one at or beyond ``dist`` ends it, and the largest change before it counts. None
    if there is no value near the start.
    """
    pivot = _pivot(near, value, start, sign, search)
    if pivot is None:
        return None
    seen, heap, most = {pivot}, [(0.0, False, pivot)], 0.0
    while heap:
        change, outside, cell = heapq.heappop(heap)
        if outside:
            break
        most = max(most, change)
        for other in near.near[cell]:
            if other not in seen and other in value:
                seen.add(other)
                heapq.heappush(heap, (sign * (value[other] - value[pivot]), near.distance(pivot, other) >= dist, other))
    return sign * most, value[pivot] + sign * most


def _per_time(nodes: DataFrame, field: DataFrame, value: str, out: str, kernel) -> DataFrame:
    """Run ``kernel(values of the time, node cell)`` for each node; a time slice is a group and
    has at most one row a cell."""

    def run(key, own: pd.DataFrame, slice_: pd.DataFrame) -> pd.DataFrame:
        have = dict(zip(slice_["cell"].tolist(), slice_["v"].tolist()))
        return pd.DataFrame({"time": own["time"], "cell": own["cell"], "_r": [float(kernel(have, c)) if c in have else None for c in own["cell"].tolist()]})

    # fresh names: nodes often come from the same field
    slices = field.where(F.col(value).isNotNull()).select(F.col("time").alias("time"), F.col("cell").alias("cell"), F.col(value).cast("double").alias("v"))
    time = dict(nodes.dtypes)["time"]
    return nodes.select("time", "cell").groupBy("time").cogroup(slices.groupBy("time")).applyInPandas(run, f"time {time}, cell int, _r double").withColumnRenamed("_r", out)


def closed_contour(nodes: DataFrame, field: DataFrame, grid: DataFrame, edge: DataFrame, value: str, delta: float, dist: float, search: float = 0.0, keep_closed: bool = True) -> DataFrame:
    """Nodes with (or without) a closed contour; see :func:`closed`."""
    near = nodes.sparkSession.sparkContext.broadcast(Neighbours(grid, edge))
    found = _per_time(nodes, field, value, "closed", lambda have, c: closed(near.value, have, c, delta, dist, search))
    return nodes.join(found.where(F.col("closed") == (1.0 if keep_closed else 0.0)).select("time", "cell"), ["time", "cell"], "left_semi")


def detect(
    field: DataFrame, grid: DataFrame, edge: DataFrame, value: str, largest: bool = False, where: Column | None = None, box: tuple | None = None,
    merge: float = 0.0, discs: dict | None = None, threshold=None, closed_by: tuple = (), not_closed_by: tuple = (),
) -> DataFrame:
    """Nodes (time, cell, value) by all steps in the order that counts: extrema, then the region,
    then merging (before any threshold, so that a node that fails one still drives out its
    neighbours), then thresholds (:func:`threshold_tree`), then closed contours, then their
    absence. A contour is (column, delta, distance, search)."""
    nodes = extrema(field, edge, value, largest, where)
    if box:
        nodes = in_region(nodes, grid, box)
    if merge > 0:
        nodes = merge_near(nodes, grid, merge, largest)
    if threshold:
        nodes = threshold_tree(nodes, field, discs or {}, threshold)
    for keep, contours in ((True, closed_by), (False, not_closed_by)):
        for column, delta, dist, search in contours:
            nodes = closed_contour(nodes, field, grid, edge, column, delta, dist, search, keep_closed=keep)
    return nodes


def max_closed_contour_delta(nodes: DataFrame, field: DataFrame, grid: DataFrame, edge: DataFrame, value: str, dist: float, sign: int = 1, search: float = 0.0) -> DataFrame:
    """(time, cell, delta); see :func:`largest_closed_delta`."""
    near = nodes.sparkSession.sparkContext.broadcast(Neighbours(grid, edge))

    def delta(have, cell):
        made = largest_closed_delta(near.value, have, cell, dist, sign, search)
        return np.nan if made is None else made[0]

    return _per_time(nodes, field, value, "delta", delta)


def contour_value(nodes: DataFrame, field: DataFrame, grid: DataFrame, edge: DataFrame, value: str, dist: float, sign: int = 1, search: float = 0.0) -> DataFrame:
    """(time, cell, contour): the value on the outermost closed contour."""
    near = nodes.sparkSession.sparkContext.broadcast(Neighbours(grid, edge))

    def contour(have, cell):
        made = largest_closed_delta(near.value, have, cell, dist, sign, search)
        return np.nan if made is None else made[1]

    return _per_time(nodes, field, value, "contour", contour)
