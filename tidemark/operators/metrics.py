"""Comparison of objects and fields: summaries, merges, similarity, correlations, indices."""

from __future__ import annotations

import pandas as pd
import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geo

# Fixed value: the radius of the Earth (km) of the summaries.
RADIUS_KM = 6371.0


def haversine_km(lon1, lat1, lon2, lat2):
    a, b = F.radians(geo.c(lat1)), F.radians(geo.c(lat2))
    h = F.sin((b - a) / 2) ** 2 + F.cos(a) * F.cos(b) * F.sin(F.radians(geo.c(lon2) - geo.c(lon1)) / 2) ** 2
    return 2 * RADIUS_KM * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def summarize(stats: DataFrame, keys: list[str], time: str = "time") -> DataFrame:
    """One row an object: first and last time, hours between, distance and zonal speed of its
    centre (km, km/h), least, greatest and mean area. ``stats`` has centlon, centlat, area."""
    at = F.struct("centlon", "centlat")
    s = stats.groupBy(*keys).agg(F.min(time).alias("start"), F.max(time).alias("end"), F.min_by(at, time).alias("a"), F.max_by(at, time).alias("b"), F.min("area").alias("min_area"), F.max("area").alias("max_area"), F.avg("area").alias("avg_area"))
    hours = (F.unix_timestamp(F.col("end").cast("timestamp")) - F.unix_timestamp(F.col("start").cast("timestamp"))) / 3600
    dist = haversine_km("a.centlon", "a.centlat", "b.centlon", "b.centlat")
    zonal = F.radians(geo.lon_difference("b.centlon", "a.centlon")) * RADIUS_KM * F.cos(F.radians((F.col("a.centlat") + F.col("b.centlat")) / 2))
    return s.select(*keys, "start", "end", hours.alias("hours"), dist.alias("distance"), F.try_divide(zonal, hours).alias("zonal_speed"), "min_area", "max_area", "avg_area")


def merge_tables(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer merge with the side each row comes from: both, left or right."""
    x, y = a.withColumn("_a", F.lit(1)), b.withColumn("_b", F.lit(1))
    side = F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), "both").when(F.col("_a").isNotNull(), "left").otherwise("right")
    return x.join(y, keys, "full").withColumn("side", side).drop("_a", "_b")


def merge_contained(tracked: DataFrame, single: DataFrame, keys: list[str] = ["time"]) -> DataFrame:  # noqa: B006
    """(keys, blob, tracked): each ``single`` blob and the ``tracked`` one that it is or is part of.

    Both have keys, blob, area, minlat, maxlat, minlon, maxlon (boxes may cross longitude 0). Equal
    areas at a time are the same blob. What is left on both sides meets by time: a single blob
    belongs to every tracked one whose box holds its own. Others have null; a blob in several
    has a row for each.
    """
    one = single.select(*keys, "blob", "area", *(F.col(c).alias(f"_{c}") for c in ("minlat", "maxlat", "minlon", "maxlon")))
    same = one.select(*keys, "blob", "area").join(tracked.select(*keys, "area", F.col("blob").alias("tracked")), [*keys, "area"]).select(*keys, "blob", "tracked")
    # which blobs have an equal is told by their areas: the pairs, as many as areas agree, go out at once
    left = one.join(tracked.select(*keys, "area").distinct(), [*keys, "area"], "left_anti")
    open_ = tracked.join(single.select(*keys, "area").distinct(), [*keys, "area"], "left_anti").withColumnRenamed("blob", "tracked").drop("area")
    width = lambda a, b: geo.norm_lon(F.col(b) - F.col(a))
    held = (F.col("_minlat") >= F.col("minlat")) & (F.col("_maxlat") <= F.col("maxlat")) & (width("minlon", "_minlon") + width("_minlon", "_maxlon") <= width("minlon", "maxlon"))
    boxes = open_.withColumnsRenamed({k: f"_t_{k}" for k in keys})
    for k in keys:
        held = (F.col(k) == F.col(f"_t_{k}")) & held
    return same.unionByName(left.join(boxes, held, "left").select(*keys, "blob", "tracked"))


def similarity_quartiles(pairs: DataFrame, value: str = "similarity") -> DataFrame:
    """One row: pairs, and the least, quartiles and greatest of their similarity (exact)."""
    q = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    made = pairs.agg(F.count(value).alias("pairs"), F.min(value).alias("least"), q.alias("q"), F.max(value).alias("greatest"))
    return made.select("pairs", "least", *(F.col("q")[i].alias(n) for i, n in enumerate(("q25", "median", "q75"))), "greatest")


def area_intensity(cells: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """(keys, sum_area, most, index): of blocks on a grid (keys, i, j, lon, lat, value; 0 outside
    the block). Each square of four cells counts with the mean of its corners, if positive,
    and its area in km2; the index is the sum of mean times area over 1e8."""
    own = cells.select(*keys, "i", "j", "lon", "lat", F.col(value).alias("v"))
    step = lambda di, dj, name: own.select(*keys, (F.col("i") - di).alias("i"), (F.col("j") - dj).alias("j"), F.struct("lon", "lat", "v").alias(name))
    at = [*keys, "i", "j"]
    quad = own.join(step(1, 0, "e"), at).join(step(0, 1, "n"), at).join(step(1, 1, "ne"), at)
    mean = (F.col("v") + F.col("e.v") + F.col("n.v") + F.col("ne.v")) / 4
    across = (haversine_km("lon", "lat", "e.lon", "lat") + haversine_km("lon", "n.lat", "e.lon", "n.lat")) / 2
    made = quad.select(*keys, mean.alias("m"), (across * haversine_km("lon", "lat", "lon", "n.lat")).alias("a")).where("m > 0")
    sums = made.groupBy(*keys).agg(F.sum("a").alias("sum_area"), (F.sum(F.col("m") * F.col("a")) / 1e8).alias("index"))
    return own.groupBy(*keys).agg(F.max("v").alias("most")).join(sums, keys).select(*keys, "sum_area", "most", "index")


def similarity(a: DataFrame, b: DataFrame, grid: DataFrame, keys: list[str] = ["time"]) -> DataFrame:  # noqa: B006
    """(keys, x, y, similarity): Jaccard similarity, weighted by cos(lat), of blobs that share a
    cell; ``a`` and ``b`` have keys, cell, blob."""
    w = grid.select("cell", F.cos(F.radians("lat")).alias("w"))
    p = a.join(F.broadcast(w), "cell").select(*keys, "cell", F.col("blob").alias("x"), "w")
    q = b.join(F.broadcast(w), "cell").select(*keys, "cell", F.col("blob").alias("y"), F.col("w").alias("w2"))
    common = p.join(q, [*keys, "cell"]).groupBy(*keys, "x", "y").agg(F.sum("w").alias("c"))
    one, two = p.groupBy(*keys, "x").agg(F.sum("w").alias("sx")), q.groupBy(*keys, "y").agg(F.sum("w2").alias("sy"))
    return common.join(one, [*keys, "x"]).join(two, [*keys, "y"]).select(*keys, "x", "y", (F.col("c") / (F.col("sx") + F.col("sy") - F.col("c"))).alias("similarity"))


def overlap_probability(a: DataFrame, b: DataFrame) -> DataFrame:
    """Share of the blobs of ``a`` that share a cell with one of ``b`` at the same time."""
    hit = a.join(b.select("time", "cell").distinct().withColumn("_b", F.lit(1)), ["time", "cell"], "left").groupBy("time", "blob").agg(F.max("_b").alias("h"))
    return hit.agg(F.count("*").alias("blobs"), F.avg(F.coalesce("h", F.lit(0))).alias("probability"))


def pattern_correlation(field: DataFrame, x: str, y: str, grid: DataFrame) -> DataFrame:
    """(time, centred, uncentred): correlations over cells, weighted by cos(lat)."""
    w = grid.select("cell", F.cos(F.radians("lat")).alias("w"))
    known = field.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select("time", "cell", F.col(x).alias("x"), F.col(y).alias("y"))
    rows = known.join(F.broadcast(w), "cell")
    s = rows.groupBy("time").agg(F.sum("w").alias("w"), *(F.sum(F.col("w") * e).alias(n) for n, e in (("x", F.col("x")), ("y", F.col("y")), ("xx", F.col("x") ** 2), ("yy", F.col("y") ** 2), ("xy", F.col("x") * F.col("y")))))
    c = lambda p, q, pq: F.col(pq) - F.col(p) * F.col(q) / F.col("w")
    return s.select("time", F.try_divide(c("x", "y", "xy"), F.sqrt(c("x", "x", "xx") * c("y", "y", "yy"))).alias("centred"), F.try_divide(F.col("xy"), F.sqrt(F.col("xx") * F.col("yy"))).alias("uncentred"))


#: Rows of a replicate's sample.
PERMUTED = 1_000
#: Rows of samples that one task permutes, about.
SAMPLED_ROWS = 500_000


def _mixed(h: np.ndarray) -> np.ndarray:
    """64-bit finaliser of hashes."""
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return h ^ (h >> np.uint64(31))


def replicate_samples(rows: DataFrame, n: int, replicates: int) -> DataFrame:
    """(replicate, rank, x, y): for each replicate PERMUTED of all ``rows`` (h, x, y) and some to
    spare, of which those with the smallest ranks are the sample; all n if there are no more.

    A row falls on replicates like the arrivals of a Poisson process that its hash drives, so
    only what is drawn is ever made: replicates times PERMUTED rows, however many there are.
    """
    share = (PERMUTED + 10 * PERMUTED**0.5) / n
    every = share >= 1 or n <= PERMUTED
    rate = None if every else -np.log1p(-share)
    most = replicates if every else int(replicates * rate + 12 * (replicates * rate) ** 0.5 + 30)

    def draw(batches):
        for batch in batches:
            step = max(1, 2_000_000 // most)
            for at in range(0, len(batch), step):
                part = batch.iloc[at : at + step]
                h = part["h"].to_numpy().view(np.uint64)
                made = _mixed(h[:, None] + np.arange(1, most + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                if every:
                    row, number = np.repeat(np.arange(len(h)), replicates), np.tile(np.arange(replicates), len(h))
                else:
                    gap = -np.log((made >> np.uint64(11)).astype(float) * 2.0**-53 + 2.0**-54) / rate
                    place = np.floor(np.cumsum(gap, axis=1)).astype(np.int64)
                    fresh = np.diff(place, axis=1, prepend=-1) > 0
                    row, column = np.nonzero(fresh & (place < replicates))
                    number = place[row, column]
                rank = _mixed(h[row] ^ _mixed(number.astype(np.uint64) + np.uint64(77)))
                yield pd.DataFrame({"replicate": number, "rank": rank.view(np.int64), "x": part["x"].to_numpy()[row], "y": part["y"].to_numpy()[row]})

    return rows.mapInPandas(draw, "replicate long, rank long, x double, y double")


def permutations(field: DataFrame, x: str, y: str, grid: DataFrame, replicates: int, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """The weighted rows (x, y) of a field's two columns, and for each replicate (replicate, r,
    permuted_r, rmse, permuted_rmse) of a random sample before and after y is permuted.

    Values are weighted by the cosine of latitude. A replicate draws PERMUTED of all rows without
    replacement (all if there are fewer); see :func:`replicate_samples`.
    """
    w = grid.select("cell", F.cos(F.radians("lat")).alias("_w"))
    known = field.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select("time", "cell", F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    rows = known.join(F.broadcast(w), "cell").select((F.col("_x") * F.col("_w")).alias("x"), (F.col("_y") * F.col("_w")).alias("y"), F.xxhash64("time", "cell", F.lit(seed)).alias("h"))
    n = rows.count()
    groups = max(1, -(-replicates * min(n, PERMUTED) // SAMPLED_ROWS))
    drawn = replicate_samples(rows.select("h", "x", "y"), max(n, 1), replicates)

    def permute(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["replicate", "rank"])
        number, at = np.unique(pdf["replicate"].to_numpy(), return_index=True)
        out = []
        for k, a, b in zip(number, at, np.append(at[1:], len(pdf))):
            u, v = (pdf[c].to_numpy()[a : min(b, a + PERMUTED)] for c in "xy")
            other = np.random.default_rng([seed & 0xFFFFFFFF, k]).permutation(v)
            with np.errstate(invalid="ignore", divide="ignore"):
                r = [np.corrcoef(u, z)[0, 1] if len(u) > 1 else np.nan for z in (v, other)]
            out.append((k, *r, *(np.sqrt(((u - z) ** 2).mean()) for z in (v, other))))
        return pd.DataFrame(out, columns=["replicate", "r", "permuted_r", "rmse", "permuted_rmse"])

    dealt = drawn.groupBy(F.pmod("replicate", F.lit(groups)))
    return rows, dealt.applyInPandas(permute, "replicate long, r double, permuted_r double, rmse double, permuted_rmse double")


def permutation_test(field: DataFrame, x: str, y: str, grid: DataFrame, replicates: int, seed: int = 0) -> DataFrame:
    """(correlation, p): of the correlation of two columns over all rows; p is the share of
    ``replicates`` in which a permutation of y has one as large. Nulls without variance."""
    rows, made = permutations(field, x, y, grid, replicates, seed)
    r = rows.agg(F.corr("x", "y")).first()[0]
    if r is None or r != r:
        return field.sparkSession.createDataFrame([(None, None)], "correlation double, p double")
    return made.agg(F.lit(r).alias("correlation"), F.avg((F.abs("permuted_r") >= abs(r)).cast("double")).alias("p"))


def permutation_test_rmse(field: DataFrame, x: str, y: str, grid: DataFrame, replicates: int, seed: int = 0) -> DataFrame:
    """(rmse, p, low, median, high): the root mean square difference of two columns over all rows;
    p is the share of ``replicates`` whose permuted difference is as far out, in the tail on its
    side of the median. low, median and high are the samples' least, middle and greatest."""
    rows, made = permutations(field, x, y, grid, replicates, seed)
    observed = rows.agg(F.sqrt(F.avg(F.pow(F.col("x") - F.col("y"), 2)))).first()[0]
    if observed is None:
        return field.sparkSession.createDataFrame([(None,) * 5], "rmse double, p double, low double, median double, high double")
    own = F.lit(observed)
    middle = made.agg(F.median("permuted_rmse").alias("m"), F.avg((F.col("permuted_rmse") >= own).cast("double")).alias("up"), F.avg((F.col("permuted_rmse") <= own).cast("double")).alias("down"), F.min("rmse").alias("low"), F.median("rmse").alias("median"), F.max("rmse").alias("high"))
    return middle.select(own.alias("rmse"), F.when(own >= F.col("m"), F.col("up")).otherwise(F.col("down")).alias("p"), "low", "median", "high")


def block_intensity(cells: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """(keys, index): 100 * (zmax / rc - 1) with the means of the top and the bottom tenth of the
    non-zero values (one value at least), and rc their middle."""
    w = Window.partitionBy(*keys)
    rows = cells.where(F.col(value) != 0).select(*keys, F.col(value).alias("z"))
    n = F.count("*").over(w)
    ranked = rows.withColumn("up", F.row_number().over(w.orderBy("z"))).withColumn("n", n).withColumn("tenth", F.greatest(F.floor(F.col("n") / 10), F.lit(1)))
    s = ranked.groupBy(*keys).agg(F.avg(F.when(F.col("up") > F.col("n") - F.col("tenth"), F.col("z"))).alias("hi"), F.avg(F.when(F.col("up") <= F.col("tenth"), F.col("z"))).alias("lo"))
    return s.select(*keys, (100 * (F.col("hi") / ((F.col("hi") + F.col("lo")) / 2) - 1)).alias("index"))


def regrid_bilinear(field: DataFrame, value: str, targets: DataFrame, dlon: float, dlat: float, lat0: float) -> DataFrame:
    """(time, target, value) at points from the four cells round each; ``field`` has i, j at
    longitudes i * dlon (round) and latitudes lat0 + j * dlat; null unless all four have values."""
    n = round(360 / dlon)
    x, y = geo.norm_lon("lon") / dlon, (F.col("lat") - lat0) / dlat
    i, j = F.floor(x).cast("int"), F.floor(y).cast("int")
    corners = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)))
    at = targets.withColumn("c", F.explode(corners)).withColumn("fx", x - i).withColumn("fy", y - j)
    weight = F.when(F.col("c.a") == 1, F.col("fx")).otherwise(1 - F.col("fx")) * F.when(F.col("c.b") == 1, F.col("fy")).otherwise(1 - F.col("fy"))
    spots = at.select("target", F.pmod(i + F.col("c.a"), F.lit(n)).alias("i"), (j + F.col("c.b")).alias("j"), weight.alias("w"))
    known = field.where(F.col(value).isNotNull()).select("time", "i", "j", F.col(value).alias("_v"))
    made = known.join(spots, ["i", "j"]).groupBy("time", "target").agg(F.count("*").alias("n"), F.sum(F.col("w") * F.col("_v")).alias("value"))
    return made.select("time", "target", F.when(F.col("n") == 4, F.col("value")).alias("value"))


def reduce_polygons(field: DataFrame, value: str, members: DataFrame, grid: DataFrame) -> DataFrame:
    """(time, shape, mean, sum, q25, median, q75): area-weighted mean and sum, and order statistics,
    of the cells of each shape. ``members`` has shape, cell; it may have the grid's size, and Spark
    takes what comes of a few shapes for small, so it is joined by shuffles."""
    own = members.join(grid.select("cell", "area").hint("merge"), "cell")
    rows = field.where(F.col(value).isNotNull()).join(own.hint("merge"), "cell").select("time", "shape", "area", F.col(value).alias("v"))
    w = Window.partitionBy("time", "shape")
    ranked = rows.withColumn("k", F.row_number().over(w.orderBy("v")) - 1).withColumn("n", F.count("*").over(w))
    order = lambda q: F.max(F.when(F.col("k") == F.floor((F.col("n") - 1) * q), F.col("v")))
    return ranked.groupBy("time", "shape").agg((F.sum(F.col("v") * F.col("area")) / F.sum("area")).alias("mean"), F.sum(F.col("v") * F.col("area")).alias("sum"), order(0.25).alias("q25"), order(0.5).alias("median"), order(0.75).alias("q75"))
