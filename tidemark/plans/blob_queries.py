"""Queries of masks, blobs, objects and their statistics."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.geo import EARTH_RADIUS
from ..operators import blobs as b
from . import fixtures as x
from .node_queries import _with

QUERIES, SQL = {}, {}
LEVEL = 90


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


MASK = f"k AS (SELECT f.* FROM f WHERE v >= {LEVEL})"
LABEL = """r(time, cell, lab) AS (SELECT time, cell, cell FROM k UNION SELECT r.time, e.nbr, r.lab FROM r JOIN edge e ON e.cell=r.cell JOIN k ON k.time=r.time AND k.cell=e.nbr WHERE r.lab < e.nbr),
c AS (SELECT time, cell, min(lab) AS blob FROM r GROUP BY 1,2)"""
ALL = "WITH RECURSIVE " + ", ".join([x.GRID, x.FIELD, MASK, LABEL])
STEPS = "t AS (SELECT time, CAST(row_number() OVER (ORDER BY time) AS INTEGER) AS step FROM (SELECT DISTINCT time FROM f))"


def mask(spark, sf_dir):
    return x.field(spark, sf_dir).where(F.col("v") >= LEVEL)


def found(spark, sf_dir):
    return b.components(mask(spark, sf_dir), x.the_edges(spark))


def steps(spark, sf_dir):
    return x.field(spark, sf_dir).select("time").distinct().select("time", F.row_number().over(Window.orderBy("time")).alias("step"))


@query(_with(x.GRID, x.FIELD) + f"SELECT time, cell FROM f JOIN g USING (cell) WHERE v >= {LEVEL} AND abs(lat) <= 60")
def mask_detect(spark, sf_dir):
    at = x.the_grid(spark).where("abs(lat) <= 60").select("cell")
    return mask(spark, sf_dir).join(F.broadcast(at), "cell", "left_semi").select("time", "cell")


@query(ALL + " SELECT * FROM c")
def components(spark, sf_dir):
    return found(spark, sf_dir)


@query(ALL + " SELECT c.* FROM c JOIN (SELECT time, blob FROM c JOIN f USING (time, cell) GROUP BY 1,2 HAVING count(*) FILTER (WHERE v > 100) >= 2) USING (time, blob)")
def blob_filter(spark, sf_dir):
    return b.keep_blobs(found(spark, sf_dir), b.at_least(F.col("v") > 100, 2), x.field(spark, sf_dir).select("time", "cell", "v"))


BOX = """o AS (SELECT DISTINCT time, blob, lon FROM c JOIN g USING (cell)),
gap AS (SELECT time, blob, lon, lead(lon) OVER w AS nx, min(lon) OVER (PARTITION BY time, blob) AS fst FROM o WINDOW w AS (PARTITION BY time, blob ORDER BY lon)),
lonbox AS (SELECT time, blob, arg_min(coalesce(nx, fst), (-(coalesce(nx, fst+360)-lon), lon)) AS minlon, arg_min(lon, (-(coalesce(nx, fst+360)-lon), lon)) AS maxlon FROM gap GROUP BY 1,2),
box AS (SELECT time, blob, min(lat) AS minlat, max(lat) AS maxlat, any_value(minlon) AS minlon, any_value(maxlon) AS maxlon, sum(area) AS sr,
  sum(area*cos(radians(lon))*cos(radians(lat))) AS sx, sum(area*sin(radians(lon))*cos(radians(lat))) AS sy, sum(area*sin(radians(lat))) AS sz
  FROM c JOIN g USING (cell) JOIN lonbox USING (time, blob) GROUP BY 1,2)"""
WIDTH = "(CASE WHEN maxlon >= minlon THEN maxlon-minlon ELSE maxlon-minlon+360 END)"


@query(ALL + ", " + BOX + f" SELECT time, blob, round(sr, 6) AS area, round(sr/((sin(radians(maxlat+7.5))-sin(radians(minlat-7.5)))*radians(least({WIDTH}+15, 360.0))), 6) AS fraction FROM box WHERE sr/((sin(radians(maxlat+7.5))-sin(radians(minlat-7.5)))*radians(least({WIDTH}+15, 360.0))) < 0.8")
def geo_filter(spark, sf_dir):
    made = b.area_fraction(found(spark, sf_dir), x.the_grid(spark), 15.0, 15.0).where("fraction < 0.8")
    return made.select("time", "blob", F.round("area", 6).alias("area"), F.round("fraction", 6).alias("fraction"))


@query(ALL + ", " + BOX + f""" SELECT time, blob, minlat, maxlat, minlon, maxlon, (minlat+maxlat)/2 AS meanlat, (minlon+{WIDTH}/2) % 360 AS meanlon,
  round((degrees(atan2(sy, sx))+360) % 360, 4) AS centlon, round(degrees(asin(sz/sqrt(sx*sx+sy*sy+sz*sz))), 5) AS centlat, round(sr*{EARTH_RADIUS}*{EARTH_RADIUS}/1e9, 5) AS area FROM box""")
def blob_statistics(spark, sf_dir):
    s = b.statistics(found(spark, sf_dir), x.the_grid(spark), ["time", "blob"])
    return s.select("time", "blob", "minlat", "maxlat", "minlon", "maxlon", "meanlat", "meanlon", F.round("centlon", 4).alias("centlon"), F.round("centlat", 5).alias("centlat"), F.round(F.col("area") / 1e9, 5).alias("area"))


@query(ALL + f""", q AS (SELECT time, blob, v*area AS m, radians(lon) AS x, radians(lat) AS y FROM c JOIN g USING (cell) JOIN f USING (time, cell)),
 ct AS (SELECT time, blob, sum(m) AS m, sum(m*cos(x)*cos(y)) AS a, sum(m*sin(x)*cos(y)) AS b2, sum(m*sin(y)) AS z FROM q GROUP BY 1,2),
 ce AS (SELECT *, atan2(b2, a) AS x0, asin(z/sqrt(a*a+b2*b2+z*z)) AS y0 FROM ct),
 pl AS (SELECT time, blob, q.m, 2*cos(y)*sin(x-x0)/(1+sin(y0)*sin(y)+cos(y0)*cos(y)*cos(x-x0)) AS px, 2*(cos(y0)*sin(y)-sin(y0)*cos(y)*cos(x-x0))/(1+sin(y0)*sin(y)+cos(y0)*cos(y)*cos(x-x0)) AS py FROM q JOIN ce USING (time, blob)),
 cv AS (SELECT time, blob, sum(m*px*px)/sum(m) AS xx, sum(m*py*py)/sum(m) AS yy, sum(m*px*py)/sum(m) AS xy, count(*) AS k FROM pl GROUP BY 1,2)
 SELECT time, blob, round(wt, 5) AS wtarea, round(degrees(2*atan(sqrt((xx+yy)/2+sqrt(((xx-yy)/2)*((xx-yy)/2)+xy*xy)))), 5) AS length,
  round(degrees(2*atan(sqrt(greatest(0.0, (xx+yy)/2-sqrt(((xx-yy)/2)*((xx-yy)/2)+xy*xy))))), 3) AS width, round(wlon, 4) AS wtcentlon, round(degrees(y0), 5) AS wtcentlat FROM cv JOIN (SELECT time, blob, m*{EARTH_RADIUS}*{EARTH_RADIUS}/1e12 AS wt, y0, (degrees(x0)+360) % 360 AS wlon FROM ce) USING (time, blob) WHERE k >= 3""")
def blob_axes(spark, sf_dir):
    weighted = found(spark, sf_dir).join(x.field(spark, sf_dir).select("time", "cell", "v"), ["time", "cell"])
    big = weighted.groupBy("time", "blob").count().where("count >= 3").select("time", "blob")
    rows = weighted.join(big, ["time", "blob"], "left_semi")
    axes = b.principal_axes(rows, x.the_grid(spark), ["time", "blob"], "v")
    sums = b.statistics(rows, x.the_grid(spark), ["time", "blob"], "v")
    return axes.join(sums, ["time", "blob"]).select("time", "blob", F.round(F.col("wtarea") / 1e12, 5).alias("wtarea"), F.round("length", 5).alias("length"), F.round("width", 3).alias("width"), F.round("wtcentlon", 4).alias("wtcentlon"), F.round("wtcentlat", 5).alias("wtcentlat"))


LINKS = STEPS + """, z AS (SELECT t.step, c.cell, c.blob, g.area FROM c JOIN t USING (time) JOIN g USING (cell)), size AS (SELECT step, blob, sum(area) AS size FROM z GROUP BY 1,2),
l AS (SELECT a.step, a.blob, p.blob AS prev, sum(a.area) AS shared FROM z a JOIN z p ON a.step=p.step+1 AND a.cell=p.cell GROUP BY 1,2,3),
ov AS (SELECT l.*, 100*shared/s.size AS share_next, 100*shared/q.size AS share_prev FROM l JOIN size s ON s.step=l.step AND s.blob=l.blob JOIN size q ON q.step=l.step-1 AND q.blob=l.prev)"""


@query(ALL + ", " + LINKS + " SELECT step, blob, prev, round(shared, 6) AS shared, round(share_next, 6) AS share_next, round(share_prev, 6) AS share_prev FROM ov")
def blob_overlap(spark, sf_dir):
    made = b.overlaps(found(spark, sf_dir), steps(spark, sf_dir), x.the_grid(spark))
    return made.withColumns({k: F.round(k, 6) for k in ("shared", "share_next", "share_prev")})


OBJECTS = LINKS + """, ids AS (SELECT DISTINCT CAST(step AS BIGINT)*4294967296+blob AS id FROM z),
pr AS (SELECT CAST(step AS BIGINT)*4294967296+blob AS a, CAST(step-1 AS BIGINT)*4294967296+prev AS b FROM ov WHERE share_next>=30), bo AS (SELECT a, b FROM pr UNION SELECT b, a FROM pr),
rr(id, lab) AS (SELECT id, id FROM ids UNION SELECT bo.b, rr.lab FROM rr JOIN bo ON bo.a=rr.id WHERE rr.lab < bo.b),
co AS (SELECT id, min(lab) AS comp FROM rr GROUP BY 1), nu AS (SELECT id, CAST(dense_rank() OVER (ORDER BY comp) AS BIGINT) AS object_id FROM co),
ob AS (SELECT c.time, c.cell, c.blob, nu.object_id FROM c JOIN t USING (time) JOIN nu ON nu.id=CAST(t.step AS BIGINT)*4294967296+c.blob)"""


@query(ALL + ", " + OBJECTS + " SELECT * FROM ob")
def objects(spark, sf_dir):
    return b.objects(found(spark, sf_dir), steps(spark, sf_dir), x.the_grid(spark), least_next=30.0)


@query(ALL + ", " + OBJECTS + " SELECT ob.* FROM ob JOIN (SELECT object_id FROM ob JOIN g USING (cell) GROUP BY 1 HAVING count(DISTINCT time) >= 3 AND count(DISTINCT CASE WHEN (lon>=300 OR lon<=90) AND lat BETWEEN 0 AND 60 THEN time END) >= 2) USING (object_id)")
def objects_restrict(spark, sf_dir):
    tracked = b.objects(found(spark, sf_dir), steps(spark, sf_dir), x.the_grid(spark), least_next=30.0)
    return b.keep_objects(tracked, 3, x.the_grid(spark), (300.0, 90.0, 0.0, 60.0), 2)


@query(ALL + f""", nr AS (SELECT DISTINCT a.time, a.blob AS x, d.blob AS y FROM c a JOIN g p ON p.cell=a.cell JOIN c d ON d.time=a.time AND d.blob<>a.blob JOIN g q ON q.cell=d.cell WHERE {x.gcd('p.lon', 'p.lat', 'q.lon', 'q.lat')} <= 16),
 mr(time, blob, lab) AS (SELECT DISTINCT time, blob, blob FROM c UNION SELECT mr.time, nr.y, mr.lab FROM mr JOIN nr ON nr.time=mr.time AND nr.x=mr.blob WHERE mr.lab < nr.y)
 SELECT c.time, c.cell, m2.lab AS blob FROM c JOIN (SELECT time, blob, min(lab) AS lab FROM mr GROUP BY 1,2) m2 USING (time, blob)""")
def blob_merge(spark, sf_dir):
    return b.merge_blobs(found(spark, sf_dir), x.the_grid(spark), 16.0)


@query(_with(x.FIELD) + f"SELECT DISTINCT time, cell FROM f WHERE v >= {LEVEL} OR w >= 40000")
def mask_or(spark, sf_dir):
    return b.either(mask(spark, sf_dir), x.field(spark, sf_dir).where("w >= 40000"))


@query(_with(x.FIELD) + f"SELECT cell, round(count(*) / (SELECT count(DISTINCT time) FROM f), 6) AS density FROM f WHERE v >= {LEVEL} GROUP BY 1")
def density(spark, sf_dir):
    times = x.field(spark, sf_dir).select("time").distinct().count()
    return b.density(mask(spark, sf_dir), times).withColumn("density", F.round("density", 6))


@query(_with(x.SERIES) + ", a AS (SELECT *, sum(CASE WHEN x>50 THEN 0 ELSE 1 END) OVER (PARTITION BY cell ORDER BY time, event_id ROWS UNBOUNDED PRECEDING) AS r FROM s), b AS (SELECT *, count(*) OVER (PARTITION BY cell, r) AS n FROM a WHERE x>50) SELECT cell, time, x, event_id FROM b WHERE n >= 3")
def persistence(spark, sf_dir):
    return b.persistent(x.series(spark, sf_dir), F.col("x") > 50, 3, order=["time", "event_id"])


_RIDGE = """z AS (SELECT f.time, f.cell, g.i, g.j, g.lat, f.v FROM f JOIN g USING (cell)), w AS (SELECT max(i)+1 AS n FROM z),
nb AS (SELECT a.time, a.cell, a.lat, a.v, b.v AS v2, b.j=a.j AS beside, b.i=a.i AS above FROM z a JOIN z b ON b.time=a.time AND b.cell<>a.cell AND abs(b.j-a.j)<=1 AND ((a.i-b.i+1)%(SELECT n FROM w)+(SELECT n FROM w))%(SELECT n FROM w)<=2),
su AS (SELECT time, cell, lat, v, count(*) AS k, (sum(CASE WHEN beside OR above THEN 4.0 ELSE 1.0 END*v2)-20*v)/6 AS fall, max(v2) FILTER (WHERE beside) AS r, max(v2) FILTER (WHERE above) AS c FROM nb GROUP BY 1, 2, 3, 4)"""


@query(_with(x.GRID, x.FIELD) + f", {_RIDGE} SELECT time, cell, v AS value, round(fall, 6) AS fall, v>=r OR v>=c AS spine FROM su WHERE k=8 AND abs(lat)>=15 AND v>=60 AND fall<=-20")
def ridge_spines(spark, sf_dir):
    at = x.the_grid(spark).select("cell", "i", "j", "lat")
    return b.ridges(x.field(spark, sf_dir).join(F.broadcast(at), "cell"), "v", 60.0, 20.0, 1, 15.0).withColumn("fall", F.round("fall", 6))
