"""Queries that compare objects and fields."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import blobs as b
from ..operators import metrics as m
from . import blob_queries as bq
from . import fixtures as x
from .climate_queries import rounded
from .node_queries import _with

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_TWO = """k2 AS (SELECT * FROM f WHERE w >= 42000),
r2(time, cell, lab) AS (SELECT time, cell, cell FROM k2 UNION SELECT r2.time, e.nbr, r2.lab FROM r2 JOIN edge e ON e.cell=r2.cell JOIN k2 ON k2.time=r2.time AND k2.cell=e.nbr WHERE r2.lab < e.nbr),
c2 AS (SELECT time, cell, min(lab) AS blob FROM r2 GROUP BY 1,2)"""


def other(spark, sf_dir):
    return b.components(x.field(spark, sf_dir).where("w >= 42000"), x.the_edges(spark))


@query(_with(x.NODES) + """, q AS (SELECT cand, min(step) AS start, max(step) AS "end", arg_min(lon, step) AS lo1, arg_min(lat, step) AS la1, arg_max(lon, step) AS lo2, arg_max(lat, step) AS la2, min(p) AS min_area, max(p) AS max_area, round(avg(p), 6) AS avg_area FROM n GROUP BY 1)
 SELECT cand, round(2*6371.0*asin(sqrt(least(1.0, pow(sin(radians(la2-la1)/2),2)+cos(radians(la1))*cos(radians(la2))*pow(sin(radians(lo2-lo1)/2),2)))), 4) AS distance, min_area, max_area, avg_area FROM q""")
def object_summary(spark, sf_dir):
    n = x.candidates(spark, sf_dir)
    stats = n.select("cand", F.make_timestamp_ntz(F.lit(2000), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)).alias("t0"), "step", F.col("lon").alias("centlon"), F.col("lat").alias("centlat"), F.col("p").alias("area"))
    stats = stats.withColumn("time", F.col("t0") + F.make_dt_interval(hours=F.col("step")))
    return rounded(rounded(m.summarize(stats, ["cand"]).select("cand", "distance", "min_area", "max_area", "avg_area"), 4, "distance"), 6, "avg_area")


@query("""WITH a AS (SELECT c_nationkey AS k, count(*) AS customers FROM customer WHERE c_nationkey % 3 > 0 GROUP BY 1), b AS (SELECT s_nationkey AS k, count(*) AS suppliers FROM supplier WHERE s_nationkey % 4 > 0 GROUP BY 1)
 SELECT k, customers, suppliers, CASE WHEN customers IS NOT NULL AND suppliers IS NOT NULL THEN 'both' WHEN customers IS NOT NULL THEN 'left' ELSE 'right' END AS side FROM a FULL JOIN b USING (k)""")
def merge_tables(spark, sf_dir):
    a = x.table(spark, sf_dir, "customer").where("c_nationkey % 3 > 0").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("customers"))
    c = x.table(spark, sf_dir, "supplier").where("s_nationkey % 4 > 0").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("suppliers"))
    return m.merge_tables(a, c, ["k"])


@query(bq.ALL + ", " + _TWO + """, p AS (SELECT time, cell, blob AS x, cos(radians(lat)) AS w FROM c JOIN g USING (cell)), q AS (SELECT time, cell, blob AS y, cos(radians(lat)) AS w FROM c2 JOIN g USING (cell)),
 cm AS (SELECT p.time, x, y, sum(p.w) AS c FROM p JOIN q ON p.time=q.time AND p.cell=q.cell GROUP BY 1,2,3), sx AS (SELECT time, x, sum(w) AS sx FROM p GROUP BY 1,2), sy AS (SELECT time, y, sum(w) AS sy FROM q GROUP BY 1,2)
 SELECT cm.time, cm.x, cm.y, round(c/(sx+sy-c), 6) AS similarity FROM cm JOIN sx USING (time, x) JOIN sy USING (time, y)""")
def similarity(spark, sf_dir):
    return rounded(m.similarity(bq.found(spark, sf_dir), other(spark, sf_dir), x.the_grid(spark)), 6, "similarity")


@query(bq.ALL + ", " + _TWO + " SELECT count(*) AS blobs, round(avg(h), 6) AS probability FROM (SELECT c.time, c.blob, CASE WHEN count(c2.cell)>0 THEN 1 ELSE 0 END AS h FROM c LEFT JOIN c2 ON c2.time=c.time AND c2.cell=c.cell GROUP BY 1,2)")
def overlap_probability(spark, sf_dir):
    return rounded(m.overlap_probability(bq.found(spark, sf_dir), other(spark, sf_dir)), 6, "probability")


@query(_with(x.GRID, x.FIELD) + """, s AS (SELECT time, sum(c) AS c, sum(c*v) AS x, sum(c*w) AS y, sum(c*v*v) AS xx, sum(c*w*w) AS yy, sum(c*v*w) AS xy FROM (SELECT f.*, cos(radians(lat)) AS c FROM f JOIN g USING (cell)) GROUP BY 1)
 SELECT time, round((xy-x*y/c)/sqrt((xx-x*x/c)*(yy-y*y/c)), 6) AS centred, round(xy/sqrt(xx*yy), 6) AS uncentred FROM s""")
def pattern_correlation(spark, sf_dir):
    return rounded(m.pattern_correlation(x.field(spark, sf_dir), "v", "w", x.the_grid(spark)), 6, "centred", "uncentred")


@query()
def permutation_test(spark, sf_dir):
    return m.permutation_test(x.field(spark, sf_dir), "v", "w", x.the_grid(spark), 10_000, 1)


@query()
def permutation_test_rmse(spark, sf_dir):
    return m.permutation_test_rmse(x.field(spark, sf_dir), "v", "w", x.the_grid(spark), 10_000, 1)


_WEIGHTED = _with(x.GRID, x.FIELD) + ", r AS (SELECT v*cos(radians(lat)) AS x, w*cos(radians(lat)) AS y FROM f JOIN g USING (cell)) "


@query(_WEIGHTED + "SELECT count(*) AS replicates, round(corr, 6) AS correlation, round(rmse, 6) AS rmse, TRUE AS near_rmse FROM range(200), (SELECT corr(x, y) AS corr, sqrt(avg(pow(x-y, 2))) AS rmse FROM r) GROUP BY ALL")
def permutation_samples(spark, sf_dir):
    """What is the same for every draw: the observed figures, the number of replicates, and that
    the samples' mean difference is within a tenth of that of all rows."""
    rows, made = m.permutations(x.field(spark, sf_dir), "v", "w", x.the_grid(spark), 200, 1)
    seen = rows.agg(F.corr("x", "y").alias("correlation"), F.sqrt(F.avg(F.pow(F.col("x") - F.col("y"), 2))).alias("rmse")).first()
    near = (F.abs(F.avg("rmse") - seen.rmse) < seen.rmse / 10).alias("near_rmse")
    return rounded(made.agg(F.count("*").alias("replicates"), F.lit(seen.correlation).alias("correlation"), F.lit(seen.rmse).alias("rmse"), near), 6, "correlation", "rmse")


@query(_with(x.FIELD) + """, r AS (SELECT time, v, row_number() OVER (PARTITION BY time ORDER BY v) AS up, count(*) OVER (PARTITION BY time) AS n FROM f WHERE v <> 0),
 s AS (SELECT time, avg(CASE WHEN up > n-greatest(floor(n/10),1) THEN v END) AS hi, avg(CASE WHEN up <= greatest(floor(n/10),1) THEN v END) AS lo FROM r GROUP BY 1) SELECT time, round(100*(hi/((hi+lo)/2)-1), 6) AS index FROM s""")
def block_intensity(spark, sf_dir):
    return rounded(m.block_intensity(x.field(spark, sf_dir), "v", ["time"]), 6, "index")


@query(_with(x.GRID, x.FIELD) + """, t AS (SELECT DISTINCT CAST(c_custkey % 50 AS INTEGER) AS target, CAST((c_custkey % 50)*7 + 3 AS DOUBLE) AS lon, CAST((c_custkey % 50) - 25 AS DOUBLE) AS lat FROM customer),
 u AS (SELECT target, floor(lon/15) AS i, floor((lat+82.5)/15) AS j, lon/15-floor(lon/15) AS fx, (lat+82.5)/15-floor((lat+82.5)/15) AS fy FROM t),
 z AS (SELECT target, (i+a)%24 AS i, j+b AS j, (CASE WHEN a=1 THEN fx ELSE 1-fx END)*(CASE WHEN b=1 THEN fy ELSE 1-fy END) AS w FROM u, (VALUES (0),(1)) AS p(a), (VALUES (0),(1)) AS q(b))
 SELECT time, target, round(CASE WHEN count(*)=4 THEN sum(z.w*f.v) END, 6) AS value FROM f JOIN g USING (cell) JOIN z ON z.i=g.i AND z.j=g.j GROUP BY 1,2""")
def regrid_bilinear(spark, sf_dir):
    k = F.col("c_custkey") % 50
    targets = x.table(spark, sf_dir, "customer").select(k.cast("int").alias("target"), (k * 7 + 3).cast("double").alias("lon"), (k - 25).cast("double").alias("lat")).distinct()
    f = x.field(spark, sf_dir).join(F.broadcast(x.the_grid(spark).select("cell", "i", "j")), "cell")
    return rounded(m.regrid_bilinear(f, "v", targets, 15.0, 15.0, -82.5), 6, "value")


@query(_with(x.GRID, x.FIELD) + """, r AS (SELECT time, cell%4 AS shape, v, area, row_number() OVER (PARTITION BY time, cell%4 ORDER BY v)-1 AS k, count(*) OVER (PARTITION BY time, cell%4) AS n FROM f JOIN g USING (cell))
 SELECT time, CAST(shape AS INTEGER) AS shape, round(sum(v*area)/sum(area), 6) AS mean, round(sum(v*area), 6) AS sum, max(CASE WHEN k=floor((n-1)*0.25) THEN v END) AS q25, max(CASE WHEN k=floor((n-1)*0.5) THEN v END) AS median, max(CASE WHEN k=floor((n-1)*0.75) THEN v END) AS q75 FROM r GROUP BY 1,2""")
def polygon_reductions(spark, sf_dir):
    grid = x.the_grid(spark)
    members = grid.select((F.col("cell") % 4).cast("int").alias("shape"), "cell")
    return rounded(m.reduce_polygons(x.field(spark, sf_dir), "v", members, grid), 6, "mean", "sum")
