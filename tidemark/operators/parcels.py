"""Back-trajectories of parcels in (longitude, latitude, pressure)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from .blobs import _kept
from .grid import within


def winds_at(parcels: DataFrame, winds: DataFrame, grid: DataFrame, reach: float) -> DataFrame:
    """(id, u, v, omega) at parcels (id, lon, lat, p): linear in pressure between the levels round
    a parcel, weighted over cells within ``reach`` by the inverse of the distance.

    ``winds`` has cell, lev (Pa), u, v, omega. Outside the levels the nearest one counts.
    """
    near = within(parcels, grid.select("cell", "lon", "lat"), reach).select("id", "p", "cell", "dist")
    at = near.join(winds, "cell")
    wind = F.struct("lev", "u", "v", "omega")
    below, above = F.col("lev") <= F.col("p"), F.col("lev") >= F.col("p")
    pair = at.groupBy("id", "cell", "dist", "p").agg(F.max_by(F.when(below, wind), F.when(below, F.col("lev"))).alias("a"), F.min_by(F.when(above, wind), F.when(above, F.col("lev"))).alias("b"))
    pair = pair.withColumn("a2", F.coalesce("a", "b")).withColumn("b2", F.coalesce("b", "a"))
    share = F.coalesce(F.try_divide(F.col("p") - F.col("a2.lev"), F.col("b2.lev") - F.col("a2.lev")), F.lit(0.0))
    w = 1 / F.greatest(F.col("dist"), F.lit(1e-6))
    part = lambda k: F.sum(w * (F.col(f"a2.{k}") * (1 - share) + F.col(f"b2.{k}") * share)) / F.sum(w)
    return pair.groupBy("id").agg(*(part(k).alias(k) for k in ("u", "v", "omega")))


def back_trajectories(parcels: DataFrame, winds: DataFrame, grid: DataFrame, steps: list[int], seconds: float, reach: float) -> DataFrame:
    """(id, step, lon, lat, p) of parcels (id, lon, lat, p) from the first of ``steps`` back through
    the others: against the wind of each step along a great circle, and against omega in p.

    ``winds`` has step, cell, lev, u, v, omega. Time is sequential, so steps are a loop over
    distributed joins of parcels with one step's winds; each result is checkpointed. A parcel
    without wind in reach ends.
    """
    at = _kept(parcels.select("id", "lon", "lat", "p"))
    out = at.withColumn("step", F.lit(steps[0]))
    for now, before in zip(steps, steps[1:]):
        wind = winds_at(at, winds.where(F.col("step") == now).drop("step"), grid, reach)
        speed = F.hypot("u", "v")
        flat = 2 * F.tan(speed * seconds / geo.EARTH_RADIUS / 2)
        moved = at.join(wind, "id").withColumn("px", F.when(speed > 0, -F.col("u") / speed * flat).otherwise(0.0)).withColumn("py", F.when(speed > 0, -F.col("v") / speed * flat).otherwise(0.0))
        lon, lat = geo.stereographic_inverse("px", "py", "lon", "lat")
        at = _kept(moved.select("id", lon.alias("lon"), lat.alias("lat"), (F.col("p") - F.col("omega") * seconds).alias("p")))
        out = out.unionByName(at.withColumn("step", F.lit(before)))
    return out.select("id", "step", "lon", "lat", "p")
