"""Queries of tracks and of what is measured round them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import profiles as p
from ..operators import stitch as s
from . import fixtures as x
from .climate_queries import rounded
from .node_queries import _with

QUERIES, SQL = {}, {}
REACH = 12.0


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_D = x.gcd("a.lon", "a.lat", "b.lon", "b.lat")
SEG = f"""sg AS (SELECT * FROM (SELECT a.step, a.cand, b.step AS next_step, b.cand AS next_cand, {_D} AS dist, row_number() OVER (PARTITION BY a.step, a.cand ORDER BY b.step, {_D}, b.cand) AS k
 FROM n a JOIN n b ON b.step BETWEEN a.step+1 AND a.step+2 AND {_D} <= {REACH}) WHERE k = 1)"""
TRACK = """rr(track, step, cand) AS (SELECT CAST(step AS BIGINT)*4294967296+cand, step, cand FROM sg WHERE NOT EXISTS (SELECT 1 FROM sg o WHERE o.next_step=sg.step AND o.next_cand=sg.cand)
 UNION SELECT rr.track, sg.next_step, sg.next_cand FROM rr JOIN sg ON sg.step=rr.step AND sg.cand=rr.cand),
ow AS (SELECT step, cand, min(track) AS track FROM rr JOIN sg USING (step, cand) GROUP BY 1,2),
tr AS (SELECT track AS track_id, step, cand FROM ow UNION SELECT ow.track, sg.next_step, sg.next_cand FROM ow JOIN sg USING (step, cand)),
tn AS (SELECT tr.*, n.lon, n.lat, n.p FROM tr JOIN n USING (step, cand))"""
HEAD = "WITH RECURSIVE " + ", ".join([x.NODES, SEG, TRACK])


def links(spark, sf_dir):
    return s.segments(x.candidates(spark, sf_dir), REACH, 1)


def walked(spark, sf_dir):
    nodes = x.candidates(spark, sf_dir)
    return s.tracks(nodes, links(spark, sf_dir)).join(nodes, ["step", "cand"])


@query(_with(x.NODES, SEG) + "SELECT step, cand, next_step, next_cand, round(dist, 5) AS dist FROM sg")
def stitch_segments(spark, sf_dir):
    return rounded(links(spark, sf_dir), 5, "dist")


@query(HEAD + " SELECT track_id, step, cand FROM tr")
def stitch_tracks(spark, sf_dir):
    return s.tracks(x.candidates(spark, sf_dir), links(spark, sf_dir))


@query()
def stitch_priority(spark, sf_dir):
    return s.prioritized_segments(x.candidates(spark, sf_dir), REACH, 1, "p", descending=True)


@query(HEAD + f""", w AS (SELECT *, lag(lon) OVER v AS lo, lag(lat) OVER v AS la FROM tn WINDOW v AS (PARTITION BY track_id ORDER BY step)),
 ok AS (SELECT track_id FROM w GROUP BY 1 HAVING max(step)-min(step)+1 >= 3 AND sum(coalesce({x.gcd('lo', 'la', 'lon', 'lat')}, 0)) >= 5 AND count(*) FILTER (WHERE p > 100) >= 2
  AND {x.gcd('arg_min(lon, step)', 'arg_min(lat, step)', 'arg_max(lon, step)', 'arg_max(lat, step)')} >= 2) SELECT track_id, step, cand FROM tn JOIN ok USING (track_id)""")
def track_filters(spark, sf_dir):
    return s.keep_tracks(walked(spark, sf_dir), 3, 2.0, 5.0, s.node_count(F.col("p") > 100, 2)).select("track_id", "step", "cand")


_R = 6.37122e6
_E = "cos(radians(la2))*sin(radians(lo2-lon))"
_N = "cos(radians(lat))*sin(radians(la2))-sin(radians(lat))*cos(radians(la2))*cos(radians(lo2-lon))"


@query(HEAD + f""", w AS (SELECT *, lead(lon) OVER v AS lo2, lead(lat) OVER v AS la2, (lead(step) OVER v - step)*2592000.0 AS dt FROM tn WINDOW v AS (PARTITION BY track_id ORDER BY step)),
 e AS (SELECT *, {_E} AS ea, {_N} AS no, radians({x.gcd('lon', 'lat', 'lo2', 'la2')}) AS arc FROM w),
 u AS (SELECT *, CASE WHEN dt>0 THEN CASE WHEN sqrt(ea*ea+no*no)>1e-12 THEN arc*ea/sqrt(ea*ea+no*no) ELSE 0 END*{_R}/dt END AS u0, CASE WHEN dt>0 THEN CASE WHEN sqrt(ea*ea+no*no)>1e-12 THEN arc*no/sqrt(ea*ea+no*no) ELSE 0 END*{_R}/dt END AS v0 FROM e)
 SELECT track_id, step, cand, round(coalesce(u0, lag(u0) OVER v), 5) AS u, round(coalesce(v0, lag(v0) OVER v), 5) AS v FROM u WINDOW v AS (PARTITION BY track_id ORDER BY step)""")
def track_velocity(spark, sf_dir):
    return rounded(s.add_velocity(walked(spark, sf_dir), 2592000.0).select("track_id", "step", "cand", "u", "v"), 5, "u", "v")


def _slopes(value: str) -> str:
    """SQL: slope at each node of the monotone cubic through ``value`` over tt, by track."""
    end = lambda h0, h1, d0, d1: f"""CASE WHEN {d1} IS NULL THEN {d0} WHEN ((2*{h0}+{h1})*{d0}-{h0}*{d1})/({h0}+{h1})*{d0} <= 0 THEN 0
      WHEN {d0}*{d1} < 0 AND abs(((2*{h0}+{h1})*{d0}-{h0}*{d1})/({h0}+{h1})) > 3*abs({d0}) THEN 3*{d0} ELSE ((2*{h0}+{h1})*{d0}-{h0}*{d1})/({h0}+{h1}) END"""  # noqa: E731
    return f"""h_{value} AS (SELECT track_id, step, lead(tt) OVER v-tt AS h, (lead({value}) OVER v-{value})/(lead(tt) OVER v-tt) AS d FROM un WINDOW v AS (PARTITION BY track_id ORDER BY step)),
g_{value} AS (SELECT *, lag(h) OVER v AS hb, lag(d) OVER v AS db, lead(h) OVER v AS ha, lead(d) OVER v AS da, lag(h, 2) OVER v AS hb2, lag(d, 2) OVER v AS db2 FROM h_{value} WINDOW v AS (PARTITION BY track_id ORDER BY step)),
s_{value} AS (SELECT track_id, step, CASE WHEN h IS NULL AND hb IS NULL THEN NULL WHEN hb IS NULL THEN {end('h', 'ha', 'd', 'da')} WHEN h IS NULL THEN {end('hb', 'hb2', 'db', 'db2')}
 WHEN d*db > 0 THEN (3*h+3*hb)/((2*h+hb)/db+(h+2*hb)/d) ELSE 0 END AS {value} FROM g_{value})"""


_UNWRAPPED = """df AS (SELECT track_id, step, cand, lon, lat, ((lon-lag(lon) OVER v+540)%360)-180 AS dl FROM tn WINDOW v AS (PARTITION BY track_id ORDER BY step)),
un AS (SELECT track_id, step, step*2592000.0 AS tt, radians(lat) AS y, radians(first_value(lon) OVER v+coalesce(sum(dl) OVER v, 0)) AS x FROM df WINDOW v AS (PARTITION BY track_id ORDER BY step ROWS UNBOUNDED PRECEDING))"""


@query(HEAD + f", {_UNWRAPPED}, {_slopes('x')}, {_slopes('y')} SELECT track_id, step, cand, lon, lat, round(x*cos(radians(lat))*{6.37122e6}, 6) AS u, round(y*{6.37122e6}, 6) AS v FROM tn JOIN s_x USING (track_id, step) JOIN s_y USING (track_id, step)")
def track_smooth_velocity(spark, sf_dir):
    made = s.smooth_velocity(walked(spark, sf_dir), 2592000.0)
    return made.withColumns({c: F.round(F.when(~F.isnan(c), F.col(c)), 6) + 0.0 for c in "uv"})


@query(HEAD + """, q AS (SELECT track_id, step, lon, lat, lead(step) OVER v AS s2, lead(lon) OVER v AS lo2, lead(lat) OVER v AS la2 FROM tn WINDOW v AS (PARTITION BY track_id ORDER BY step)),
 t AS (SELECT DISTINCT step + 0.25 AS t FROM n)
 SELECT track_id, CAST(t AS DOUBLE) AS t, round((lon + (t-step)/(s2-step)*((((lo2-lon+180)%360+360)%360)-180) + 360) % 360, 5) AS lon, round(lat+(t-step)/(s2-step)*(la2-lat), 5) AS lat FROM q JOIN t ON t>=step AND t<s2""")
def track_at_times(spark, sf_dir):
    times = x.candidates(spark, sf_dir).select((F.col("step") + 0.25).cast("double").alias("t")).distinct()
    return rounded(s.at_times(walked(spark, sf_dir), times), 5, "lon", "lat")


@query(_with(x.NODES) + "SELECT CAST(least(floor(12*lon/360), 11) AS INTEGER) AS i, CAST(least(floor(6*(lat+90)/180), 5) AS INTEGER) AS j, count(*) AS count FROM n GROUP BY 1,2")
def node_histogram(spark, sf_dir):
    return s.histogram(x.candidates(spark, sf_dir), 12, 6)


@query(HEAD + " SELECT CAST(least(floor(12*lon/360), 11) AS INTEGER) AS i, CAST(least(floor(6*(lat+90)/180), 5) AS INTEGER) AS j, count(*) AS count FROM (SELECT track_id, arg_min(lon, step) AS lon, arg_min(lat, step) AS lat FROM tn GROUP BY 1) GROUP BY 1,2")
def genesis_histogram(spark, sf_dir):
    return s.histogram(s.ends(walked(spark, sf_dir)), 12, 6)


@query(HEAD + " SELECT CAST(least(floor(12*lon/360), 11) AS INTEGER) AS i, CAST(least(floor(6*(lat+90)/180), 5) AS INTEGER) AS j, count(*) AS count FROM (SELECT track_id, arg_max(lon, step) AS lon, arg_max(lat, step) AS lat FROM tn GROUP BY 1) GROUP BY 1,2")
def termination_histogram(spark, sf_dir):
    return s.histogram(s.ends(walked(spark, sf_dir), last=True), 12, 6)


@query("""WITH l AS (SELECT event_id AS id, CAST(floor(epoch(ts)) AS BIGINT) AS t, user_id AS u FROM events WHERE event_type='click'), r AS (SELECT DISTINCT CAST(floor(epoch(ts)) AS BIGINT) AS t2, user_id AS u FROM events WHERE event_type='purchase')
 SELECT id, t, t2 FROM (SELECT id, t, t2, row_number() OVER (PARTITION BY id ORDER BY abs(t-t2), t2) AS k FROM l JOIN r ON l.u=r.u AND abs(t-t2) <= 43200) WHERE k = 1""")
def nearest_in_time(spark, sf_dir):
    e = x.table(spark, sf_dir, "events").withColumn("t", F.unix_timestamp(F.col("ts").cast("timestamp")))
    left = e.where("event_type = 'click'").select(F.col("event_id").alias("id"), "t", F.col("user_id").alias("u"))
    right = e.where("event_type = 'purchase'").select(F.col("t").alias("t2"), F.col("user_id").alias("u")).distinct()
    return s.nearest_in_time(left, right, 43200, ["u"]).select("id", "t", "t2")


# ---- round the nodes
_STEPFIELD = "sf AS (SELECT CAST(year(time)*12+month(time) AS INTEGER) AS step, cell, v AS x, (v-40)/4 AS u, (w-35000)/2000 AS vv, 1016 - v/4 AS ps FROM f)"
_CELLS = f"ce AS (SELECT n.step, n.cand, n.lon, n.lat, g.cell, g.lon AS lon2, g.lat AS lat2, g.area, {x.gcd('n.lon', 'n.lat', 'g.lon', 'g.lat')} AS dist, sf.x, sf.u, sf.vv, sf.ps FROM n JOIN g ON {x.gcd('n.lon', 'n.lat', 'g.lon', 'g.lat')} <= 30 JOIN sf ON sf.step=n.step AND sf.cell=g.cell)"
NEAR = _with(x.GRID, x.FIELD, x.NODES, _STEPFIELD, _CELLS)


def step_field(spark, sf_dir):
    f = x.field(spark, sf_dir)
    return f.select((F.year("time") * 12 + F.month("time")).cast("int").alias("step"), "cell", F.col("v").alias("x"), ((F.col("v") - 40) / 4).alias("u"), ((F.col("w") - 35000) / 2000).alias("vv"), (1016 - F.col("v") / 4).alias("ps"))


def near_cells(spark, sf_dir):
    return p.node_cells(x.candidates(spark, sf_dir), step_field(spark, sf_dir), x.the_grid(spark), 30.0)


@query(NEAR + f"SELECT step, cand, round(max(pow(1.94384*sqrt(u*u+vv*vv),2)*1e-4), 5) AS ace, round(sum(0.5*(u*u+vv*vv)*area*{_R}*{_R})/1e15, 5) AS ike, round(max(pow(sqrt(u*u+vv*vv),3)), 3) AS pdi, round(max(CASE WHEN ps<=1016 THEN pow(1.94384*3.92*pow(1016-ps,0.644),2)*1e-4 END), 5) AS acepsl FROM ce WHERE dist>1e-6 GROUP BY 1,2")
def intensity(spark, sf_dir):
    made = p.intensity(near_cells(spark, sf_dir), "u", "vv", "ps").withColumn("ike", F.col("ike") / 1e15)
    return rounded(rounded(made, 5, "ace", "ike", "acepsl"), 3, "pdi")


_BINS = "bi AS (SELECT step, cand, b, avg(x) AS m FROM (SELECT step, cand, x, unnest([floor(dist/10), floor(dist/10)+1]) AS b FROM ce) WHERE b BETWEEN 1 AND 3 GROUP BY 1,2,3), pf AS (SELECT step, cand, max(CASE WHEN b=1 THEN m END) AS b1, max(CASE WHEN b=2 THEN m END) AS b2, max(CASE WHEN b=3 THEN m END) AS b3 FROM bi GROUP BY 1,2)"


def profiles(spark, sf_dir):
    return p.radial_profile(near_cells(spark, sf_dir), "x", 4, 10.0)


@query(NEAR + f", {_BINS} SELECT step, cand, round(coalesce(b1,0), 6) AS b1, round(coalesce(b2,0), 6) AS b2, round(coalesce(b3,0), 6) AS b3, round((coalesce(b1,0)+coalesce(b2,0))/2, 6) AS mid FROM pf")
def radial_profile(spark, sf_dir):
    made = profiles(spark, sf_dir).select("step", "cand", *(F.col("profile")[i].alias(f"b{i}") for i in (1, 2, 3)), p.value_at("profile", 1.5).alias("mid"))
    return rounded(made, 6, "b1", "b2", "b3", "mid")


@query(NEAR + f", {_BINS} SELECT step, cand, CASE WHEN coalesce(b1,0)<40 THEN 10.0 WHEN coalesce(b2,0)<40 THEN 20.0 WHEN coalesce(b3,0)<40 THEN 30.0 END AS first, CASE WHEN coalesce(b3,0)>=40 THEN 30.0 WHEN coalesce(b2,0)>=40 THEN 20.0 WHEN coalesce(b1,0)>=40 THEN 10.0 END AS last FROM pf")
def profile_where(spark, sf_dir):
    made = profiles(spark, sf_dir)
    return made.select("step", "cand", p.first_where("profile", "fallsbelow", 40.0, 10.0, 10.0).alias("first"), p.last_where("profile", ">=", 40.0, 10.0).alias("last"))


_PLANE = """pp AS (SELECT step, cand, dist, u, vv, lat, 2*cos(radians(lat2))*sin(radians(lon2-lon))/(1+sin(radians(lat))*sin(radians(lat2))+cos(radians(lat))*cos(radians(lat2))*cos(radians(lon2-lon))) AS px,
  2*(cos(radians(lat))*sin(radians(lat2))-sin(radians(lat))*cos(radians(lat2))*cos(radians(lon2-lon)))/(1+sin(radians(lat))*sin(radians(lat2))+cos(radians(lat))*cos(radians(lat2))*cos(radians(lon2-lon))) AS py FROM ce),
wn AS (SELECT step, cand, floor(dist/10) AS b, CASE WHEN px>=0 AND py>=0 THEN 0 WHEN px>=0 THEN 1 WHEN py<0 THEN 2 ELSE 3 END AS quadrant, (CASE WHEN lat<0 THEN -1 ELSE 1 END)*(vv*px-u*py)/nullif(sqrt(px*px+py*py), 0) AS wind FROM pp),
mw AS (SELECT step, cand, quadrant, b, avg(wind) AS m FROM (SELECT step, cand, quadrant, wind, b+d AS b FROM wn, (VALUES (0),(1)) AS t(d)) WHERE b BETWEEN 1 AND 3 GROUP BY 1,2,3,4)"""
_BINS = ", ".join(f"round(coalesce(max(m) FILTER (WHERE b={k}), 0), 6)" for k in (1, 2, 3))


@query(NEAR.rstrip() + f", {_PLANE} SELECT step, cand, CAST(quadrant AS INTEGER) AS quadrant, [0.0, {_BINS}] AS profile FROM mw GROUP BY 1, 2, 3")
def quadrant_wind_profile(spark, sf_dir):
    cells = near_cells(spark, sf_dir).withColumn("wind", p.azimuthal_wind("u", "vv"))
    made = p.quadrant_profile(cells, "wind", 4, 10.0)
    return made.withColumn("profile", F.transform("profile", lambda v: F.round(v, 6)))


@query(NEAR + f"SELECT sf.step, sf.cell, CASE WHEN EXISTS (SELECT 1 FROM n JOIN g ON g.cell=sf.cell WHERE n.step=sf.step AND {x.gcd('n.lon', 'n.lat', 'g.lon', 'g.lat')} <= 20) THEN x ELSE -1.0 END AS x FROM sf")
def mask_by_distance(spark, sf_dir):
    return p.mask_near(step_field(spark, sf_dir), x.candidates(spark, sf_dir), x.the_grid(spark), 20.0, fill=-1.0)


def _inverse(px: str, py: str) -> str:
    """SQL of the point (lon, lat) whose stereographic plane coordinates about (lon0, lat0) these are."""
    rho = f"sqrt(({px})*({px})+({py})*({py}))"
    arc = f"2*atan({rho}/2)"
    lat = f"CASE WHEN {rho}=0 THEN lat0 ELSE degrees(asin(greatest(-1.0, least(1.0, cos({arc})*sin(radians(lat0))+({py})*sin({arc})*cos(radians(lat0))/{rho})))) END"
    lon = f"CASE WHEN {rho}=0 THEN lon0 ELSE lon0+degrees(atan2(({px})*sin({arc}), {rho}*cos(radians(lat0))*cos({arc})-({py})*sin(radians(lat0))*sin({arc}))) END"
    return f"{lon} AS lon, {lat} AS lat"


def _sampled(points: str) -> str:
    """SQL: CTEs of points (step, cand, ix, iy, lon, lat) and the field at their nearest cells."""
    d = x.gcd("pt.lon", "pt.lat", "g.lon", "g.lat")
    return _with(x.GRID, x.FIELD, x.NODES, _STEPFIELD) + f""", pt AS ({points}),
 sm AS (SELECT step, cand, ix, iy, cell FROM (SELECT step, cand, ix, iy, cell, row_number() OVER (PARTITION BY step, cand, ix, iy ORDER BY round(dist, 9), cell) AS k
  FROM (SELECT step, cand, ix, iy, g.cell, {d} AS dist FROM pt, g) WHERE dist <= 22) WHERE k = 1) """


_AXES = "(VALUES (-2),(-1),(0),(1),(2)) AS a(ix), (VALUES (-2),(-1),(0),(1),(2)) AS b(iy)"
_FLAT = lambda k: f"2*tan(radians(({k})*10.0)/2)"
_SQUARE = f"SELECT step, cand, ix, iy, {_inverse(_FLAT('ix'), _FLAT('CASE WHEN lat0<0 THEN -iy ELSE iy END'))} FROM (SELECT step, cand, lon AS lon0, lat AS lat0, CAST(ix AS INTEGER) AS ix, CAST(iy AS INTEGER) AS iy FROM n, {_AXES})"


@query(_sampled(_SQUARE) + "SELECT ix, iy, round(avg(x), 6) AS mean, min(x) AS min, max(x) AS max, count(x) AS count FROM sm JOIN sf USING (step, cell) GROUP BY 1, 2")
def composite(spark, sf_dir):
    made = p.composite(x.candidates(spark, sf_dir), step_field(spark, sf_dir), x.the_grid(spark), 10.0, 2, 22.0, flip_south=True)
    return rounded(made, 6, "mean")


@query(NEAR + "SELECT CAST(floor((x-5)/20) AS INTEGER) AS bin, count(*) AS count FROM ce GROUP BY 1")
def composite_histogram(spark, sf_dir):
    return p.value_histogram(near_cells(spark, sf_dir), "x", 5.0, 20.0)


@query(_with(x.NODES) + "SELECT step, cand, CASE WHEN lon>20 AND lon<100 AND lat>-40 AND lat<30 THEN 'east' WHEN (lon>340 OR lon<50) AND lat>0 AND lat<50 THEN 'zero' END AS region FROM n")
def region_name(spark, sf_dir):
    corner = lambda *v: [{"lon": float(a) + 1e-7, "lat": float(b) + 1e-7} for a, b in v]
    shapes = [(1, "east", corner((20, -40), (100 - 2e-7, -40), (100 - 2e-7, 30 - 2e-7), (20, 30 - 2e-7))), (2, "zero", corner((340, 0), (50 - 2e-7, 0), (50 - 2e-7, 50 - 2e-7), (340, 50 - 2e-7)))]
    regions = spark.createDataFrame(shapes, "number int, name string, corners array<struct<lon: double, lat: double>>")
    return p.region_of(x.candidates(spark, sf_dir), regions, ["step", "cand"]).select("step", "cand", "region")


@query(_with(x.GRID, x.NODES) + f"SELECT step, cand, cell, round(dist, 6) AS dist FROM (SELECT n.step, n.cand, g.cell, {x.gcd('n.lon', 'n.lat', 'g.lon', 'g.lat')} AS dist, row_number() OVER (PARTITION BY step, cand ORDER BY round({x.gcd('n.lon', 'n.lat', 'g.lon', 'g.lat')}, 9), cell) AS k FROM n JOIN g ON {x.gcd('n.lon', 'n.lat', 'g.lon', 'g.lat')} <= 22) WHERE k = 1")
def nearest_cell(spark, sf_dir):
    from pyspark.sql.window import Window

    from ..operators.grid import within

    near = within(x.candidates(spark, sf_dir), x.the_grid(spark).select("cell", "lon", "lat"), 22.0)
    w = Window.partitionBy("step", "cand").orderBy(F.round("dist", 9), "cell")
    return near.withColumn("k", F.row_number().over(w)).where("k = 1").select("step", "cand", "cell", F.round("dist", 6).alias("dist"))


_RAYS = f"""SELECT step, cand, ix, iy, {_inverse(_FLAT('ix+0.5') + '*sin(radians(iy*45.0))', _FLAT('ix+0.5') + '*cos(radians(iy*45.0))')}
 FROM (SELECT step, cand, lon AS lon0, lat AS lat0, CAST(ix AS INTEGER) AS ix, CAST(iy AS INTEGER) AS iy FROM n, range(3) AS a(ix), range(8) AS b(iy))"""


@query(_sampled(_RAYS) + "SELECT sm.step, sm.cand, ix, iy, x FROM sm JOIN sf USING (step, cell)")
def composite_radial(spark, sf_dir):
    points = p.radial_points(x.candidates(spark, sf_dir), 10.0, 3, 8)
    return p.snapshots(points, step_field(spark, sf_dir), x.the_grid(spark), 22.0)


_EVEN = f"SELECT * FROM (SELECT step, cand, CAST(ix AS INTEGER) AS ix, CAST(iy AS INTEGER) AS iy, lon+ix*10.0 AS lon, lat+iy*10.0 AS lat FROM n, {_AXES}) WHERE abs(lat) <= 90"


@query(_sampled(_EVEN) + "SELECT ix, iy, round(avg(x), 6) AS mean, count(x) AS count FROM sm JOIN sf USING (step, cell) GROUP BY 1, 2")
def composite_lon_lat(spark, sf_dir):
    points = p.lon_lat_points(x.candidates(spark, sf_dir), 10.0, 2)
    made = p.snapshots(points, step_field(spark, sf_dir), x.the_grid(spark), 22.0).groupBy("ix", "iy")
    return rounded(made.agg(F.avg("x").alias("mean"), F.count("x").alias("count")), 6, "mean")


@query()
def back_trajectories(spark, sf_dir):
    from ..operators.parcels import back_trajectories as run

    items = x.table(spark, sf_dir, "lineitem")
    step = (F.year("l_shipdate") * 12 + F.month("l_shipdate")).cast("int")
    cell = ((F.col("l_suppkey") % 12) * 24 + (F.col("l_partkey") * 7 + F.col("l_linenumber") * 5) % 24).cast("int")
    winds = items.groupBy(step.alias("step"), cell.alias("cell"), ((F.col("l_linenumber") % 3) * 30000 + 20000).cast("double").alias("lev")).agg(F.avg(F.col("l_quantity") - 25).alias("u"), F.avg(F.col("l_discount") * 100 - 5).alias("v"), F.avg(F.col("l_tax") - 0.04).alias("omega"))
    last = 1998 * 12 + 6
    parcels = x.candidates(spark, sf_dir).where(F.col("step") == last).select(F.col("cand").alias("id"), "lon", "lat", F.lit(50000.0).alias("p"))
    return run(parcels, winds, x.the_grid(spark), list(range(last, last - 6, -1)), 43200.0, 22.0)
