"""Tracks: candidates linked in time, track filters, velocity, and what depends on both."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geo
from .blobs import link_components
from .grid import within


def segments(nodes: DataFrame, reach: float, max_gap: int = 0) -> DataFrame:
    """(step, cand, next_step, next_cand, dist): for each node its nearest one at the next steps.

    Of the steps up to 1 + max_gap ahead, the first counts at which the nearest node (ties: the
    smaller number) is within ``reach`` degrees. One distance join; ``nodes`` has step, cand,
    lon, lat.
    """
    own = nodes.select("step", "cand", "lon", "lat")
    found = None
    for ahead in range(1, max_gap + 2):
        later = own.select((F.col("step") - ahead).alias("step"), F.col("cand").alias("next_cand"), "lon", "lat")
        near = within(own, later, reach, ["step"]).select("step", "cand", (F.col("step") + ahead).alias("next_step"), "next_cand", "dist")
        found = near if found is None else found.unionAll(near)
    w = Window.partitionBy("step", "cand").orderBy("next_step", "dist", "next_cand")
    return found.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def tracks(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(track_id, step, cand): paths along the links, each node's one link at most once.

    Where links meet, the path of the earliest (then smallest) start goes on and the others end
    on the shared node, as a walk in order of starts gives. Paths are found per connected group
    of links, which a task holds one at a time; groups hang together only through links.
    """
    number = lambda s, c: F.col(s).cast("long") * 2**32 + F.col(c)
    pairs = links.select(number("step", "cand").alias("a"), number("next_step", "next_cand").alias("b"))
    ids = pairs.select(F.col("a").alias("id")).unionAll(pairs.select(F.col("b").alias("id"))).distinct()
    groups = link_components(pairs, ids)
    own = pairs.join(groups.withColumnRenamed("id", "a"), "a")

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        after = dict(zip(pdf["a"].tolist(), pdf["b"].tolist()))
        out, used = [], set()
        for start in sorted(after):
            if start in used:
                continue
            path, at = [start], start
            while at in after and at not in used:
                used.add(at)
                at = after[at]
                path.append(at)
            out += [(start, x) for x in path]
        return pd.DataFrame(out, columns=["track", "id"])

    # a start that another path runs through is used by then, so a track's first node names it
    walked = own.select("component", "a", "b").groupBy("component").applyInPandas(walk, "track long, id long")
    split = lambda x: ((F.floor(F.col(x) / 2**32)).cast("int"), (F.col(x) % 2**32).cast("int"))
    step, cand = split("id")
    return walked.select(F.col("track").alias("track_id"), step.alias("step"), cand.alias("cand"))


def prioritized_segments(nodes: DataFrame, reach: float, max_gap: int, priority: str, descending: bool = False) -> DataFrame:
    """As :func:`segments`, but nodes choose in order of a column and take a target only once,
    by (gap, distance). Groups of nodes that can compete for targets are worked on one by one."""
    own = nodes.select("step", "cand", "lon", "lat", F.col(priority).alias("_p"))
    found = None
    for ahead in range(1, max_gap + 2):
        later = nodes.select((F.col("step") - ahead).alias("step"), F.col("cand").alias("next_cand"), "lon", "lat")
        near = within(own, later, reach, ["step"]).select("step", "cand", "_p", (F.col("step") + ahead).alias("next_step"), "next_cand", "dist")
        found = near if found is None else found.unionAll(near)
    number = lambda s, c: F.col(s).cast("long") * 2**32 + F.col(c)
    # competition is between sources of a target, so groups hang together through targets
    source, target = number("step", "cand") * 2, number("next_step", "next_cand") * 2 + 1
    pairs = found.select(source.alias("a"), target.alias("b"))
    ids = pairs.select(F.col("a").alias("id")).unionAll(pairs.select(F.col("b").alias("id"))).distinct()
    groups = link_components(pairs, ids)

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_p", "step", "cand", "next_step", "dist", "next_cand"], ascending=[not descending, True, True, True, True, True])
        used, done, keep = set(), set(), []
        for i, s, c, t, d in zip(pdf.index, pdf["step"], pdf["cand"], pdf["next_step"], pdf["next_cand"]):
            if (s, c) not in done and (t, d) not in used:
                done.add((s, c))
                used.add((t, d))
                keep.append(i)
        return pdf.loc[keep, ["step", "cand", "next_step", "next_cand", "dist"]]

    return found.withColumn("id", source).join(groups, "id").groupBy("component").applyInPandas(choose, "step int, cand int, next_step int, next_cand int, dist double")


def keep_tracks(track: DataFrame, least_steps: int = 1, least_end: float = 0.0, least_path: float = 0.0, having: Column | None = None) -> DataFrame:
    """Tracks long enough in steps (first to last), from end to end and along the path, for which
    an aggregate condition over their nodes holds as well."""
    w = Window.partitionBy("track_id").orderBy("step")
    rows = track.withColumn("_lon", F.lag("lon").over(w)).withColumn("_lat", F.lag("lat").over(w)).withColumn("_d", F.coalesce(geo.great_circle("_lon", "_lat", "lon", "lat"), F.lit(0.0)))
    place = F.struct("lon", "lat")
    s = rows.groupBy("track_id").agg((F.max("step") - F.min("step") + 1).alias("n"), F.sum("_d").alias("path"), F.min_by(place, "step").alias("p"), F.max_by(place, "step").alias("q"), (F.lit(True) if having is None else having).alias("ok"))
    end = geo.great_circle("p.lon", "p.lat", "q.lon", "q.lat")
    good = s.where((F.col("n") >= least_steps) & (F.col("path") >= least_path) & (end >= least_end) & F.col("ok"))
    return track.join(good.select("track_id"), "track_id", "left_semi")


def node_count(condition: Column, count: int | str) -> Column:
    """An aggregate condition: at least so many nodes satisfy, or "all", the "first", the "last"."""
    if count == "all":
        return F.coalesce(F.bool_and(condition), F.lit(False))
    if count in ("first", "last"):
        return (F.min_by if count == "first" else F.max_by)(condition, "step")
    return F.count_if(condition) >= count


def add_velocity(track: DataFrame, seconds_per_step: float) -> DataFrame:
    """Eastward and northward speed (m/s) to the next node; a track's last node repeats the one
    before it; null for tracks of one node."""
    w = Window.partitionBy("track_id").orderBy("step")
    rows = track.withColumn("_lon", F.lead("lon").over(w)).withColumn("_lat", F.lead("lat").over(w)).withColumn("_t", (F.lead("step").over(w) - F.col("step")) * seconds_per_step)
    east, north = geo.direction("lon", "lat", "_lon", "_lat")
    rows = rows.withColumn("_u", F.when(F.col("_t") > 0, east * geo.EARTH_RADIUS / F.col("_t"))).withColumn("_v", F.when(F.col("_t") > 0, north * geo.EARTH_RADIUS / F.col("_t")))
    return rows.select(*track.columns, F.coalesce("_u", F.lag("_u").over(w)).alias("u"), F.coalesce("_v", F.lag("_v").over(w)).alias("v"))


def smooth_velocity(track: DataFrame, seconds_per_step: float) -> DataFrame:
    """Velocity from the monotone cubic through a track's longitudes (unwrapped) and latitudes;
    a track is a group."""

    def slopes(t: np.ndarray, y: np.ndarray) -> np.ndarray:
        h, d = np.diff(t), np.diff(y) / np.diff(t)
        if len(d) == 1:
            return np.repeat(d, 2)
        m = np.zeros(len(t))
        both = d[:-1] * d[1:] > 0
        a, b = 2 * h[1:] + h[:-1], h[1:] + 2 * h[:-1]
        with np.errstate(divide="ignore", invalid="ignore"):
            m[1:-1] = np.where(both, (a + b) / (a / d[:-1] + b / d[1:]), 0.0)
        for end, (h0, h1, d0, d1) in ((0, (h[0], h[1], d[0], d[1])), (-1, (h[-1], h[-2], d[-1], d[-2]))):
            e = ((2 * h0 + h1) * d0 - h0 * d1) / (h0 + h1)
            m[end] = 0.0 if e * d0 <= 0 else 3 * d0 if d0 * d1 < 0 and abs(e) > 3 * abs(d0) else e
        return m

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("step")
        if len(pdf) < 2:
            return pdf.assign(u=np.nan, v=np.nan)
        t = pdf["step"].to_numpy(float) * seconds_per_step
        lon, lat = np.unwrap(np.radians(pdf["lon"].to_numpy(float))), np.radians(pdf["lat"].to_numpy(float))
        return pdf.assign(u=slopes(t, lon) * np.cos(lat) * geo.EARTH_RADIUS, v=slopes(t, lat) * geo.EARTH_RADIUS)

    return track.select("track_id", "step", "cand", "lon", "lat").groupBy("track_id").applyInPandas(fit, "track_id long, step int, cand int, lon double, lat double, u double, v double")


def at_times(track: DataFrame, times: DataFrame, columns: tuple = ()) -> DataFrame:
    """(track_id, t, lon, lat, columns): tracks at times (t) between their nodes, linear in time and
    along the shorter way round in longitude. An interval join on whole steps. A column that
    is null at either node is null between them."""
    w = Window.partitionBy("track_id").orderBy("step")
    seg = track.select("track_id", "step", "lon", "lat", *columns, F.lead("step").over(w).alias("s2"), F.lead("lon").over(w).alias("lon2"), F.lead("lat").over(w).alias("lat2"), *(F.lead(c).over(w).alias(f"_{c}") for c in columns))
    # a segment covers few whole steps: it is put in the bucket of each
    spread = seg.withColumn("bucket", F.explode(F.sequence(F.col("step"), F.coalesce(F.col("s2"), F.col("step")))))
    at = times.withColumn("bucket", F.floor("t").cast("int"))
    hit = spread.join(at, "bucket").where(((F.col("t") >= F.col("step")) & (F.col("t") < F.col("s2"))) | ((F.col("t") == F.col("step")) & F.col("s2").isNull()))
    share = F.coalesce((F.col("t") - F.col("step")) / (F.col("s2") - F.col("step")), F.lit(0.0))
    lon = geo.norm_lon(F.col("lon") + F.coalesce(share * geo.lon_difference("lon2", "lon"), F.lit(0.0)))
    between = [F.when(F.col("s2").isNull() | (share == 0), F.col(c)).otherwise(F.col(c) + share * (F.col(f"_{c}") - F.col(c))).alias(c) for c in columns]
    return hit.select("track_id", "t", lon.alias("lon"), F.coalesce(F.col("lat") + share * (F.col("lat2") - F.col("lat")), F.col("lat")).alias("lat"), *between)


def histogram(points: DataFrame, n_lon: int, n_lat: int, lon0: float = 0.0, lon1: float = 360.0, lat0: float = -90.0, lat1: float = 90.0) -> DataFrame:
    """(i, j, count) of points in even boxes; the far edges belong to the last boxes."""
    i = F.floor(n_lon * (F.col("lon") - lon0) / (lon1 - lon0))
    j = F.floor(n_lat * (F.col("lat") - lat0) / (lat1 - lat0))
    inside = points.where(F.col("lon").between(lon0, lon1) & F.col("lat").between(lat0, lat1))
    return inside.select(F.least(i, F.lit(n_lon - 1)).cast("int").alias("i"), F.least(j, F.lit(n_lat - 1)).cast("int").alias("j")).groupBy("i", "j").agg(F.count("*").alias("count"))


def ends(track: DataFrame, last: bool = False) -> DataFrame:
    """First (or last) node of each track."""
    pick = F.max_by if last else F.min_by
    return track.groupBy("track_id").agg(pick(F.struct("step", "cand", "lon", "lat"), "step").alias("x")).select("track_id", "x.*")


def nearest_in_time(left: DataFrame, right: DataFrame, tolerance: int, on: list[str]) -> DataFrame:
    """For each row of ``left`` (id, t) the row of ``right`` (t2, and others) nearest in time within
    ``tolerance``, equal in ``on``; the earlier of two as near. Bucketed by the tolerance, so
    each row meets three buckets."""
    width = max(1, tolerance)
    a = left.withColumn("_b", F.explode(F.array(*(F.floor(F.col("t") / width) + d for d in (-1, 0, 1)))))
    b = right.withColumn("_b", F.floor(F.col("t2") / width))
    gap = F.abs(F.col("t") - F.col("t2"))
    near = a.join(b, [*on, "_b"]).where(gap <= tolerance).drop("_b")
    w = Window.partitionBy("id").orderBy(gap, "t2")
    return near.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")
