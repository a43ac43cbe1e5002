"""Queries of meshes, stored climatologies and potential vorticity."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import climate_state as cs
from ..operators import mesh as m
from ..operators import pv
from . import fixtures as x
from .climate_queries import rounded

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def face_count(spark, sf_dir) -> int:
    """Faces along a panel's side: the mesh grows with the customers."""
    return max(2, int((x.table(spark, sf_dir, "customer").count() / 150) ** 0.5))


def sphere(spark, sf_dir):
    return m.cubed_sphere(spark, face_count(spark, sf_dir))


_ID = lambda a, b, c: f"({a}) + (n+1)*(({b}) + (n+1)*({c}))"
_CORNER = f"""CASE p WHEN 0 THEN {_ID('0', 'i+dj', 'j+di')} WHEN 1 THEN {_ID('n', 'i+di', 'j+dj')} WHEN 2 THEN {_ID('i+di', '0', 'j+dj')}
 WHEN 3 THEN {_ID('i+dj', 'n', 'j+di')} WHEN 4 THEN {_ID('i+dj', 'j+di', '0')} ELSE {_ID('i+di', 'j+dj', 'n')} END"""
MESH = f"""nn AS (SELECT greatest(2, CAST(floor(sqrt(count(*)/150)) AS INTEGER)) AS n FROM customer),
lt AS (SELECT {_ID('a', 'b', 'c')} AS node, tan(pi()/4*(2.0*a/n-1)) AS x, tan(pi()/4*(2.0*b/n-1)) AS y, tan(pi()/4*(2.0*c/n-1)) AS z
 FROM nn, unnest(range(n+1)) q(a), unnest(range(n+1)) r(b), unnest(range(n+1)) s(c) WHERE a IN (0, n) OR b IN (0, n) OR c IN (0, n)),
nd AS (SELECT node, x/sqrt(x*x+y*y+z*z) AS x, y/sqrt(x*x+y*y+z*z) AS y, z/sqrt(x*x+y*y+z*z) AS z FROM lt),
fc AS (SELECT p*n*n+j*n+i AS face, k, {_CORNER} AS node FROM nn, unnest(range(6)) q(p), unnest(range(n)) r(j), unnest(range(n)) s(i), (VALUES (0,0,0),(1,1,0),(2,1,1),(3,0,1)) AS t(k, di, dj)),
sd AS (SELECT a.face, a.k, a.node AS p, b.node AS q FROM fc a JOIN fc b ON a.face=b.face AND b.k=(a.k+1)%4)"""


@query(f"WITH {MESH} SELECT a.face AS cell, b.face AS nbr FROM sd a JOIN sd b ON a.p=b.q AND a.q=b.p")
def mesh_edges(spark, sf_dir):
    return m.mesh_edges(sphere(spark, sf_dir)[0])


@query(f"WITH {MESH} SELECT DISTINCT a.face AS cell, b.face AS nbr FROM fc a JOIN fc b ON a.node=b.node AND a.face<>b.face")
def mesh_edges_corners(spark, sf_dir):
    return m.mesh_edges(sphere(spark, sf_dir)[0], corners=True)


_ARC = lambda p, q: f"acos(least(1.0, {p}.x*{q}.x+{p}.y*{q}.y+{p}.z*{q}.z))"


@query(f"""WITH {MESH}, tr AS (SELECT o.face, {_ARC('po', 'pp')} AS a, {_ARC('pp', 'pq')} AS b, {_ARC('pq', 'po')} AS c FROM fc o JOIN sd s ON s.face=o.face AND o.k=0 AND s.k IN (1, 2)
 JOIN nd po ON po.node=o.node JOIN nd pp ON pp.node=s.p JOIN nd pq ON pq.node=s.q),
 ar AS (SELECT face, sum(4*atan(sqrt(greatest(0.0, tan((a+b+c)/4)*tan((b+c-a)/4)*tan((a+c-b)/4)*tan((a+b-c)/4))))) AS area FROM tr GROUP BY 1)
 SELECT CAST(face AS INTEGER) AS cell, round(degrees(asin(z/sqrt(x*x+y*y+z*z))), 6) AS lat, round(area, 6) AS area FROM ar JOIN (SELECT face, sum(x) AS x, sum(y) AS y, sum(z) AS z FROM fc JOIN nd USING (node) GROUP BY 1) USING (face)""")
def mesh_areas(spark, sf_dir):
    return rounded(m.mesh_cells(*sphere(spark, sf_dir)).select("cell", "lat", "area"), 6, "lat", "area")


@query(f"""WITH {MESH} SELECT CAST(p AS INTEGER) AS "order", 6*(n*(p-1))*(n*(p-1))+2 AS continuous, 6*n*n*p*p AS discontinuous, 24*(n*(p-1))*(n*(p-1)) AS edges FROM nn, unnest(range(2, 6)) q(p)""")
def spectral_counts(spark, sf_dir):
    """Nodes of continuous and discontinuous elements of each order, and links between the former."""
    faces, nodes = sphere(spark, sf_dir)
    out = None
    for order in m.GAUSS_LOBATTO:
        placed = m.spectral_nodes(faces, nodes, order)
        own = m.spectral_nodes(faces, nodes, order, continuous=False).agg(F.count_distinct("gll").alias("discontinuous"))
        made = placed.agg(F.count_distinct("gll").alias("continuous")).join(own).join(m.spectral_edges(placed).agg(F.count("*").alias("edges")))
        made = made.select(F.lit(order).alias("order"), "continuous", "discontinuous", "edges")
        out = made if out is None else out.unionAll(made)
    return out


_GLL = "[0.0, (1-sqrt(0.2))/2, (1+sqrt(0.2))/2, 1.0]"


@query(f"""WITH {MESH}, pl AS (SELECT face, i, j, sum(w*x) AS x, sum(w*y) AS y, sum(w*z) AS z FROM (
  SELECT face, i, j, x, y, z, (CASE WHEN k IN (1, 2) THEN {_GLL}[i+1] ELSE 1-{_GLL}[i+1] END)*(CASE WHEN k IN (2, 3) THEN {_GLL}[j+1] ELSE 1-{_GLL}[j+1] END) AS w
  FROM fc JOIN nd USING (node), unnest(range(4)) q(i), unnest(range(4)) r(j)) GROUP BY 1, 2, 3),
 un AS (SELECT face, i, j, x/sqrt(x*x+y*y+z*z) AS x, y/sqrt(x*x+y*y+z*z) AS y, z/sqrt(x*x+y*y+z*z) AS z FROM pl)
 SELECT face, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, round(degrees(asin(z)), 6) AS lat, count(*) OVER (PARTITION BY round(x+1e-12, 8)+0.0, round(y+1e-12, 8)+0.0, round(z+1e-12, 8)+0.0) AS faces FROM un""")
def spectral_nodes(spark, sf_dir):
    placed = m.spectral_nodes(*sphere(spark, sf_dir), 4)
    shared = placed.groupBy("gll").agg(F.count("*").alias("faces"))
    return rounded(placed.join(shared, "gll").select("face", "i", "j", "lat", "faces"), 6, "lat")


# ---- states of climatologies
@query(f"WITH {x.SERIES} SELECT cell, CAST(0 AS INTEGER) AS idx, round(avg(x)+1e-9, 6) AS mean, round(avg(x*x)+1e-9, 6) AS meansq, round(stddev_samp(x), 6) AS stddev, min(x) AS min, max(x) AS max, count(*) AS count FROM s WHERE NOT (month(time)=2 AND day(time)=29) GROUP BY 1")
def climatology_merged(spark, sf_dir):
    """States of three parts, two of them merged before, against the climatology of the whole."""
    series = x.series(spark, sf_dir)
    part = [cs.climatology_state(series.where(F.col("event_id") % 3 == k), "x", "all") for k in range(3)]
    made = cs.finish_state(cs.merge_states(part[0], cs.merge_states(part[1], part[2])))
    # prices are whole cents: a mean may lie just between two rounded figures
    moved = made.withColumns({c: F.col(c) + 1e-9 for c in ("mean", "meansq")})
    return rounded(moved, 6, "mean", "meansq", "stddev")


@query(f"WITH {x.DAILY} SELECT cell, CAST(month(time) AS INTEGER) AS idx, round(avg(x)+1e-7, 4) AS mean, round(stddev_samp(x), 2) AS stddev, min(x) AS min, max(x) AS max, count(*) AS count FROM d WHERE NOT (month(time)=2 AND day(time)=29) GROUP BY 1, 2 HAVING count(*) >= 5")
def climatology_merged_monthly(spark, sf_dir):
    daily = x.daily(spark, sf_dir)
    years = [cs.climatology_state(daily.where(F.year("time") % 4 == k), "x", "monthly") for k in range(4)]
    made = cs.finish_state(cs.merge_states(*years), 5).drop("meansq").withColumn("mean", F.col("mean") + 1e-7)
    return rounded(rounded(made, 4, "mean"), 2, "stddev")


# ---- potential vorticity: winds and temperatures on five levels by year
LEVELS = (10000, 20000, 30000, 45000, 70000)
_LEV = f"{list(LEVELS)}[CAST((l_linenumber+l_orderkey)%5 AS INTEGER)+1]"
_PV3D = f"""pf AS (SELECT CAST(year(l_shipdate) AS INTEGER) AS time, CAST({_LEV} AS DOUBLE) AS lev, CAST((l_partkey*7+l_linenumber*5)%24*15 AS DOUBLE) AS lon, CAST(l_suppkey%12 AS DOUBLE)*15-82.5 AS lat,
 200+sum(l_quantity)/count(*) AS t, sum(CAST(round(l_discount*100) AS BIGINT))/count(*)*4-20 AS u, sum(CAST(round(l_tax*100) AS BIGINT))/count(*)*4-16 AS v FROM lineitem GROUP BY 1,2,3,4)"""
_EARTH = 6_371_000.0


def vorticity_sql(table: str, keys: str) -> str:
    """CTE vo: relative vorticity of (keys, lon, lat, u, v)."""
    return f"""vw AS (SELECT *, coalesce(lead(v) OVER a, first_value(v) OVER aw)-coalesce(lag(v) OVER a, last_value(v) OVER aw) AS dv, lead(u*cos(radians(lat))) OVER b-lag(u*cos(radians(lat))) OVER b AS df, lead(lat) OVER b-lag(lat) OVER b AS dy FROM {table}
 WINDOW a AS (PARTITION BY {keys}, lat ORDER BY lon), aw AS (PARTITION BY {keys}, lat ORDER BY lon ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), b AS (PARTITION BY {keys}, lon ORDER BY lat)),
vo AS (SELECT {keys}, lon, lat, dv/(radians(30.0)*{_EARTH}*cos(radians(lat))) - df/(radians(dy)*{_EARTH}*cos(radians(lat))) AS vorticity FROM vw WHERE df IS NOT NULL)"""


_MEAN = """th AS (SELECT time, lev, lon, lat, t*pow(100000.0/lev, 2.0/7) AS theta FROM pf),
gr AS (SELECT time, lev, lon, lat, (coalesce(lead(theta) OVER w, theta)-coalesce(lag(theta) OVER w, theta))/nullif(coalesce(lead(lev) OVER w, lev)-coalesce(lag(lev) OVER w, lev), 0) AS g FROM th WINDOW w AS (PARTITION BY time, lon, lat ORDER BY lev)),
pv AS (SELECT time, lev, lon, lat, -9.80616*(2*7.2921e-5*sin(radians(lat))+vorticity)*g AS pv FROM vo JOIN gr USING (time, lev, lon, lat) WHERE g IS NOT NULL),
ly AS (SELECT time, lon, lat, lev AS p0, pv AS v0, lead(lev) OVER w AS p1, lead(pv) OVER w AS v1 FROM pv WINDOW w AS (PARTITION BY time, lon, lat ORDER BY lev)),
cu AS (SELECT time, lon, lat, p0, v0, (v1-v0)/(p1-p0) AS s, greatest(p0, 15000.0) AS a, least(p1, 50000.0) AS b FROM ly WHERE p1 > 15000 AND p0 < 50000),
vm AS (SELECT time, lon, lat, sum((2*v0+s*(a-p0)+s*(b-p0))/2*(b-a)) AS s, sum(b-a) AS d FROM cu GROUP BY 1,2,3)"""


def upper_air(spark, sf_dir):
    items = x.table(spark, sf_dir, "lineitem")
    level = F.array(*(F.lit(float(v)) for v in LEVELS))[((F.col("l_linenumber") + F.col("l_orderkey")) % 5).cast("int")]
    lon, lat = ((F.col("l_partkey") * 7 + F.col("l_linenumber") * 5) % 24 * 15).cast("double"), (F.col("l_suppkey") % 12).cast("double") * 15 - 82.5
    mean = lambda c: F.sum(F.round(F.col(c) * 100).cast("long")) / F.count("*") * 4
    by = [F.year("l_shipdate").alias("time"), level.alias("lev"), lon.alias("lon"), lat.alias("lat")]
    return items.groupBy(*by).agg((200 + F.sum("l_quantity") / F.count("*")).alias("t"), (mean("l_discount") - 20).alias("u"), (mean("l_tax") - 16).alias("v"))


@query(f"WITH {_PV3D}, {vorticity_sql('pf', 'time, lev')}, {_MEAN} SELECT time, lon, lat, round(1e9*CASE WHEN abs(lat) > 80 THEN 0.0 WHEN d >= 35000*(1-1e-9) THEN s/d END, 5) AS vpv FROM vm")
def blocking_pv(spark, sf_dir):
    made = pv.blocking_pv(upper_air(spark, sf_dir), ["time"], 15.0)
    return made.select("time", "lon", "lat", F.round(1e9 * F.col("vpv"), 5).alias("vpv"))
