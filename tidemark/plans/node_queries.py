"""Queries of grids, field algebra, point features and their filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fields as fn
from ..functions import geo, units
from ..functions.geo import EARTH_RADIUS, OMEGA
from ..operators import grid as g
from ..operators import nodes as n
from . import fixtures as x

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _with(*parts: str) -> str:
    return "WITH " + ", ".join(parts) + " "


# ---- field algebra: name -> (column, SQL expression) over v, w, lat, lon, area
_T = "(w/2000-10)"
_EXPR = {
    "vecmag": (lambda: fn.vecmag("v", "w"), "sqrt(v*v+w*w)"),
    "abs": (lambda: fn.absolute(F.col("v") - 40), "abs(v-40)"),
    "sign": (lambda: fn.sign(F.col("v") - 40), "CAST(sign(v-40) AS DOUBLE)"),
    "allpos": (lambda: fn.allpos(F.col("v") - 40, "w"), "CASE WHEN v-40>0 AND w>0 THEN 1.0 ELSE 0.0 END"),
    "sum": (lambda: fn.total("v", "w", 3.5), "v+w+3.5"),
    "avg": (lambda: fn.average("v", "w"), "(v+w)/2"),
    "diff": (lambda: fn.diff("w", "v"), "w-v"),
    "prod": (lambda: fn.prod("v", "w", 2.0), "v*w*2.0"),
    "div": (lambda: fn.div("w", F.col("v") + 1), "w/(v+1)"),
    "min": (lambda: fn.minimum("v", F.lit(40.0)), "least(v,40.0)"),
    "max": (lambda: fn.maximum("v", F.lit(40.0)), "greatest(v,40.0)"),
    "cond": (lambda: fn.cond(F.col("v") - 40, "w", 0.0), "CASE WHEN v-40>0 THEN w ELSE 0.0 END"),
    "equals": (lambda: fn.equals("v", 40.0), "CASE WHEN v=40 THEN 1.0 ELSE 0.0 END"),
    "sqrt": (lambda: fn.root("v"), "sqrt(v)"),
    "pow": (lambda: fn.power(F.col("v") / 100, 1.5), "pow(v/100,1.5)"),
    "lat": (lambda: fn.latitude(), "lat"),
    "lon": (lambda: fn.longitude(), "lon"),
    "area": (lambda: fn.area() / 1e9, f"area*{EARTH_RADIUS}*{EARTH_RADIUS}/1e9"),
    "coriolis": (lambda: fn.coriolis() * 1e4, f"2*{OMEGA}*sin(radians(lat))*1e4"),
    "chill_hours": (lambda: fn.daily_chill_hours(F.col("w") / 2000 - 10, F.col("w") / 2000 + 5, "degC"), None),
    "relative_humidity": (lambda: fn.relative_humidity(F.col("w") / 2000 - 15, F.col("w") / 2000 - 10, "degC"), "100*exp(17.1*(w/2000-15)/(235+w/2000-15) - 17.1*(w/2000-10)/(235+w/2000-10))"),
    "vpd_humidity": (lambda: fn.vpd_from_humidity(F.col("w") / 2000 - 10, F.col("v") % 100, "degC"), f"6.1094*exp(17.625*{_T}/({_T}+243.04))*(1-(v%100)/100)"),
    "vpd_specific": (lambda: fn.vpd_from_specific_humidity(F.col("w") / 2000 - 10, F.col("v") / 1e5, 1e5, "degC"), f"6.1094*exp(17.625*{_T}/({_T}+243.04)) - (v/1e5)*1e5/100/(0.6221+0.3779*v/1e5)"),
}
_LO, _HI = "((w/2000-10)*9/5+32)", "((w/2000+5)*9/5+32)"
_BELOW = lambda t: f"(CASE WHEN {_HI}<={t} THEN 24.0 WHEN {_LO}>={t} THEN 0.0 ELSE 24*({t}-{_LO})/({_HI}-{_LO}) END)"
_EXPR["chill_hours"] = (_EXPR["chill_hours"][0], f"{_BELOW(45.0)}-{_BELOW(32.0)}")


def _algebra(make):
    def run(spark, sf_dir):
        at = x.the_grid(spark).select("cell", "lat", "lon", "area")
        return x.field(spark, sf_dir).join(F.broadcast(at), "cell").select("time", "cell", F.round(make(), 6).alias("y"))

    return run


for _name, (_make, _sql) in _EXPR.items():
    QUERIES[f"expr_{_name}"] = _algebra(_make)
    SQL[f"expr_{_name}"] = _with(x.GRID, x.FIELD) + f"SELECT time, cell, round({_sql}, 6) AS y FROM f JOIN g USING (cell)"


# ---- geometry, on places of the nodes
@query(_with(x.NODES) + f"SELECT a.step, a.cand, b.cand AS cand2, round({x.gcd('a.lon', 'a.lat', 'b.lon', 'b.lat')}, 6) AS dist FROM n a JOIN n b ON a.step=b.step AND a.cand<b.cand AND {x.gcd('a.lon', 'a.lat', 'b.lon', 'b.lat')} <= 30")
def node_pairs_within(spark, sf_dir):
    nodes = x.candidates(spark, sf_dir).select("step", "cand", "lon", "lat")
    return g.within(nodes, nodes.withColumnRenamed("cand", "cand2"), 30.0, ["step"]).where("cand < cand2").select("step", "cand", "cand2", F.round("dist", 6).alias("dist"))


@query(_with(x.NODES) + """SELECT step, cand, round(2*cos(radians(lat))*sin(radians(lon-200))/k, 6) AS px,
  round(2*(cos(radians(20.0))*sin(radians(lat))-sin(radians(20.0))*cos(radians(lat))*cos(radians(lon-200)))/k, 6) AS py, lon, lat
  FROM (SELECT *, 1+sin(radians(20.0))*sin(radians(lat))+cos(radians(20.0))*cos(radians(lat))*cos(radians(lon-200)) AS k FROM n)""")
def stereographic_there_and_back(spark, sf_dir):
    nodes = x.candidates(spark, sf_dir)
    px, py = geo.stereographic("lon", "lat", 200.0, 20.0)
    flat = nodes.select("step", "cand", px.alias("px"), py.alias("py"))
    lon, lat = geo.stereographic_inverse("px", "py", 200.0, 20.0)
    return flat.select("step", "cand", F.round("px", 6).alias("px"), F.round("py", 6).alias("py"), (F.round(lon, 6) % 360).alias("lon"), F.round(lat, 6).alias("lat"))


@query(_with(x.NODES) + f"SELECT step, cand, round(degrees(radians(lon)), 6) AS lon, round(lat, 6) AS lat, round(2*sin(radians(lat+60)/2), 6) AS chord, round(radians(lat)*{EARTH_RADIUS}/1000, 6) AS km FROM n")
def cartesian_there_and_back(spark, sf_dir):
    nodes = x.candidates(spark, sf_dir)
    lon, lat = geo.lon_lat(*geo.xyz("lon", "lat"))
    return nodes.select("step", "cand", (F.round(lon, 6) % 360).alias("lon"), F.round(lat, 6).alias("lat"), F.round(geo.chord_of_angle(F.col("lat") + 60), 6).alias("chord"), F.round(units.convert("lat", "deg", "km"), 6).alias("km"))


@query(_with(x.GRID, x.FIELD) + "SELECT time, count(*) AS cells, round(sum(v*area)/sum(area), 6) AS mean, sum(k) AS neighbours FROM f JOIN g USING (cell) JOIN (SELECT cell, count(*) AS k FROM edge GROUP BY 1) USING (cell) GROUP BY 1")
def area_mean(spark, sf_dir):
    near = x.the_edges(spark).groupBy("cell").agg(F.count("*").alias("k"))
    at = x.the_grid(spark).select("cell", "area").join(near, "cell")
    return x.field(spark, sf_dir).join(F.broadcast(at), "cell").groupBy("time").agg(F.count("*").alias("cells"), F.round(F.sum(F.col("v") * F.col("area")) / F.sum("area"), 6).alias("mean"), F.sum("k").alias("neighbours"))


# ---- stencils
@query(_with(x.GRID, x.FIELD, x.disc(20)) + "SELECT f.time, disc.cell, round(sum(v*area)/sum(area), 6) AS mean FROM f JOIN disc ON f.cell=disc.nbr GROUP BY 1,2")
def stencil_mean(spark, sf_dir):
    return g.apply_mean(x.field(spark, sf_dir), g.mean_stencil(x.the_grid(spark), 20.0), "v").withColumn("mean", F.round("mean", 6))


#: Ring of 8 points at 15 degrees: nearest cells once each, their angles and directions.
RING = f"""ring AS (SELECT cell, k, lat2 AS lat, lon + degrees(atan2(sin(t)*sin(d)*cos(y), cos(d)-sin(y)*sin(radians(lat2)))) AS lon FROM (
      SELECT cell, lon, k, radians(lat) AS y, radians(15.0) AS d, radians(45.0*k) AS t, degrees(asin(sin(radians(lat))*cos(radians(15.0)) + cos(radians(lat))*sin(radians(15.0))*cos(radians(45.0*k)))) AS lat2
      FROM g, range(0,8) p(k))),
near AS (SELECT DISTINCT cell, nbr FROM (
      SELECT r.cell, r.k, arg_min(g.cell, (round({x.gcd('r.lon', 'r.lat', 'g.lon', 'g.lat')}, 9), g.cell)) AS nbr FROM ring r, g GROUP BY 1, 2) WHERE cell <> nbr),
part AS (SELECT a.cell, nbr, radians(a.lat) AS y0, radians(b.lat) AS y1, radians(b.lon-a.lon) AS d FROM near JOIN g a USING (cell) JOIN g b ON b.cell=nbr),
dirs AS (SELECT *, cos(y1)*sin(d) AS e, sin(y1)*cos(y0)-cos(y1)*sin(y0)*cos(d) AS n, sin(y0)*sin(y1)+cos(y0)*cos(y1)*cos(d) AS c FROM part),
st AS (SELECT cell, nbr, c, atan2(sqrt(e*e+n*n), c) AS a, e/sqrt(e*e+n*n) AS e0, n/sqrt(e*e+n*n) AS n0,
      cos(y0)*sin(d)/sqrt(e*e+n*n) AS e1, (cos(y0)*sin(y1)*cos(d)-sin(y0)*cos(y1))/sqrt(e*e+n*n) AS n1 FROM dirs),
known AS (SELECT f.time, f.cell, f.v AS v0, f.w AS w0, o.v AS v1, o.w AS w1, st.*EXCLUDE(cell), count(*) OVER (PARTITION BY f.time, f.cell) AS m
      FROM f JOIN st ON st.cell=f.cell JOIN f o ON o.time=f.time AND o.cell=st.nbr),
whole AS (SELECT k.* FROM known k JOIN (SELECT cell, count(*) AS m FROM st GROUP BY 1) USING (cell, m)),
slots AS (SELECT f.time, g.cell, {2 / (EARTH_RADIUS * 8)} / radians(15.0) AS s FROM (SELECT DISTINCT time FROM f) f, g)"""


def _ring_sql(made: str, name: str) -> str:
    """``made`` for each cell that a full ring surrounds; null at times where part of it is missing
    but some cell of the stencil has a value."""
    some = "SELECT DISTINCT time, cell FROM (SELECT f.time, st.cell FROM f JOIN st ON st.nbr=f.cell UNION SELECT time, cell FROM f)"
    return _with(x.GRID, x.FIELD, RING) + f"SELECT p.time, p.cell, {name} FROM ({some}) p LEFT JOIN (SELECT time, cell, {made} FROM whole JOIN slots USING (time, cell) GROUP BY 1, 2) q ON q.time=p.time AND q.cell=p.cell"


@query(_ring_sql("round(sum(4.0/8/(a*a)*(v1-v0)), 6) AS laplacian", "laplacian"))
def stencil_laplacian(spark, sf_dir):
    made = g.laplacian(x.field(spark, sf_dir), x.the_grid(spark), "v", 8, 15.0)
    return made.withColumn("laplacian", F.round("laplacian", 6))


@query(_ring_sql("round(1e6*sqrt(sum(s*c*e0*(v1-v0))**2 + sum(s*c*n0*(v1-v0))**2), 6) AS gradient", "gradient"))
def stencil_gradient(spark, sf_dir):
    made = g.gradient_magnitude(x.field(spark, sf_dir), x.the_grid(spark), "v", 8, 15.0)
    return made.withColumn("gradient", F.round(1e6 * F.col("gradient"), 6))


@query(
    _with(x.GRID, x.FIELD, RING) + """SELECT f.time, f.cell, round(1e6*adv, 6) AS advection FROM f LEFT JOIN (
      SELECT time, cell, any_value(v0)*(sum(s*c*e0*(w1-w0)) + sum(s*c*n0*(w1-w0))) AS adv FROM whole JOIN slots USING (time, cell) GROUP BY 1, 2) q ON q.time=f.time AND q.cell=f.cell"""
)
def stencil_advection(spark, sf_dir):
    made = g.vector_dot_gradient(x.field(spark, sf_dir), x.the_grid(spark), "v", "v", "w", 8, 15.0)
    return made.withColumn("advection", F.round(1e6 * F.col("advection"), 6))


_C0, _C1 = "(1-radians(15.0)/a)", "(radians(15.0)/a)"


@query(
    _ring_sql(
        f"round(1e6*sum(s*({_C0}*(-v0*n0+w0*e0) + {_C1}*(-v1*n1+w1*e1))), 6) AS curl, round(1e6*sum(s*({_C0}*(v0*e0+w0*n0) + {_C1}*(v1*e1+w1*n1))), 6) AS divergence",
        "curl, divergence",
    )
)
def stencil_curl_divergence(spark, sf_dir):
    made = g.curl_and_divergence(x.field(spark, sf_dir), x.the_grid(spark), "v", "w", 8, 15.0)
    return made.select("time", "cell", F.round(1e6 * F.col("curl"), 6).alias("curl"), F.round(1e6 * F.col("divergence"), 6).alias("divergence"))


# ---- nodes
@query(_with(x.GRID, x.FIELD, x.MINIMA) + "SELECT * FROM m")
def minima(spark, sf_dir):
    return x.minima(spark, sf_dir)


@query(_with(x.GRID, x.FIELD) + "SELECT f.time, f.cell, f.v AS value FROM f WHERE NOT EXISTS (SELECT 1 FROM edge e JOIN f o ON o.time=f.time AND o.cell=e.nbr WHERE e.cell=f.cell AND o.v > f.v)")
def maxima(spark, sf_dir):
    return n.extrema(x.field(spark, sf_dir), x.the_edges(spark), "v", largest=True)


_PLACED = "p AS (SELECT m.*, g.lon, g.lat FROM m JOIN g USING (cell))"
_BEATEN = f"SELECT 1 FROM p o WHERE o.time=p.time AND o.value<p.value AND {x.gcd('p.lon', 'p.lat', 'o.lon', 'o.lat')} <= 32"


@query(_with(x.GRID, x.FIELD, x.MINIMA, _PLACED) + f"SELECT time, cell, value FROM p WHERE NOT EXISTS ({_BEATEN})")
def merge_distance(spark, sf_dir):
    return n.merge_near(x.minima(spark, sf_dir), x.the_grid(spark), 32.0)


_GREEDY = f"""l AS (SELECT * FROM p WHERE NOT EXISTS ({_BEATEN})),
lo AS (SELECT p.time, p.cell, list(o.cell) FILTER (WHERE o.cell IS NOT NULL) AS lower FROM l p LEFT JOIN l o ON o.time=p.time AND o.cell<p.cell AND o.value=p.value AND {x.gcd('p.lon', 'p.lat', 'o.lon', 'o.lat')} <= 32 GROUP BY 1, 2),
sq AS (SELECT *, row_number() OVER (PARTITION BY time ORDER BY cell) AS k FROM lo),
st(time, k, kept) AS (SELECT DISTINCT time, CAST(0 AS BIGINT), CAST([] AS INTEGER[]) FROM l UNION ALL
 SELECT st.time, sq.k, CASE WHEN list_has_any(st.kept, coalesce(sq.lower, CAST([] AS INTEGER[]))) THEN st.kept ELSE list_append(st.kept, sq.cell) END FROM st JOIN sq ON sq.time=st.time AND sq.k=st.k+1),
en AS (SELECT time, unnest(arg_max(kept, k)) AS cell FROM st GROUP BY 1)"""


@query(_with(x.GRID, x.FIELD, x.MINIMA, _PLACED).replace("WITH ", "WITH RECURSIVE ", 1) + f", {_GREEDY} SELECT l.time, l.cell, l.value FROM l JOIN en USING (time, cell)")
def merge_distance_equal(spark, sf_dir):
    return n.merge_near(x.minima(spark, sf_dir), x.the_grid(spark), 32.0, merge_equal=True)


@query(_with(x.GRID, x.FIELD, x.MINIMA, x.disc(16)) + "SELECT * FROM m WHERE EXISTS (SELECT 1 FROM disc d JOIN f o ON o.cell=d.nbr AND o.time=m.time WHERE d.cell=m.cell AND o.w > 40000)")
def threshold_within_distance(spark, sf_dir):
    return n.threshold_near(x.minima(spark, sf_dir), x.field(spark, sf_dir), g.disc(x.the_grid(spark), 16.0), "w", ">", 40000)


@query(_with(x.GRID, x.FIELD, x.MINIMA, x.disc(16)) + "SELECT m.* FROM m JOIN f USING (time, cell) WHERE f.v<60 AND (f.w>=39000 OR EXISTS (SELECT 1 FROM disc d JOIN f o ON o.cell=d.nbr AND o.time=m.time WHERE d.cell=m.cell AND o.w < 20000))")
def threshold_and_or(spark, sf_dir):
    tree = ("and", ("v", "<", 60, 0), ("or", ("w", ">=", 39000, 0), ("w", "<", 20000, 16.0)))
    return n.threshold_tree(x.minima(spark, sf_dir), x.field(spark, sf_dir), {16.0: g.disc(x.the_grid(spark), 16.0)}, tree)


@query(_with(x.GRID, x.FIELD, x.MINIMA) + "SELECT m.* FROM m JOIN g USING (cell) WHERE (lon>=300 OR lon<=60) AND lat BETWEEN -50 AND 50 AND abs(lat)>=10")
def region_box(spark, sf_dir):
    return n.in_region(x.minima(spark, sf_dir), x.the_grid(spark), (300.0, 60.0, -50.0, 50.0), 10.0)


@query(_with(x.GRID, x.FIELD, x.MINIMA) + "SELECT m.* FROM m WHERE strftime(time, '%Y-%m-%d %H:%M:%S') ~ '^199[67]-0[1-6]'")
def time_filter(spark, sf_dir):
    return x.minima(spark, sf_dir).where(F.date_format("time", "yyyy-MM-dd HH:mm:ss").rlike("^199[67]-0[1-6]"))


@query(_with(x.GRID, x.FIELD, x.MINIMA) + "SELECT time, cell, value FROM (SELECT m.*, dense_rank() OVER (ORDER BY time) - 1 AS k FROM m) WHERE k % 4 = 0")
def time_stride(spark, sf_dir):
    nodes = x.minima(spark, sf_dir)
    from pyspark.sql.window import Window

    steps = nodes.select("time").distinct().withColumn("k", F.row_number().over(Window.orderBy("time")) - 1).where("k % 4 = 0")
    return nodes.join(F.broadcast(steps.select("time")), "time", "left_semi").select("time", "cell", "value")


_AROUND = "r AS (SELECT m.time, m.cell, d.nbr, d.dist, d.area, o.v FROM m JOIN disc d ON d.cell=m.cell JOIN f o ON o.time=m.time AND o.cell=d.nbr)"


@query(_with(x.GRID, x.FIELD, x.MINIMA, x.disc(20), _AROUND) + """SELECT time, cell, max(v) AS max, min(v) AS min, round(avg(v), 6) AS avg,
  round(arg_min(dist, (-v, round(dist, 9), nbr)), 6) AS maxdist, round(arg_min(dist, (v, round(dist, 9), nbr)), 6) AS mindist,
  arg_min(nbr, (-v, round(dist, 9), nbr)) AS maxcell, arg_min(nbr, (v, round(dist, 9), nbr)) AS mincell FROM r GROUP BY 1,2""")
def minima_with_output(spark, sf_dir):
    disc = g.disc(x.the_grid(spark), 20.0).withColumn("dist", F.round("dist", 9))
    made = n.measure(x.minima(spark, sf_dir), x.field(spark, sf_dir), disc, "v")
    return made.withColumns({k: F.round(k, 6) for k in ("avg", "maxdist", "mindist")})


@query(_with(x.GRID, x.FIELD, x.MINIMA, x.disc(20)) + "SELECT m.time, m.cell, round(sum((o.v-40)*d.area), 6) AS wtarea FROM m JOIN disc d ON d.cell=m.cell JOIN f o ON o.time=m.time AND o.cell=d.nbr GROUP BY 1,2")
def positive_minus_negative(spark, sf_dir):
    f = x.field(spark, sf_dir)
    grid = x.the_grid(spark)
    return n.positive_minus_negative_area(x.minima(spark, sf_dir), f.withColumn("a", F.col("v") - 40), g.disc(grid, 20.0), grid, "a").withColumn("wtarea", F.round("wtarea", 6))


@query(_with(x.GRID, x.FIELD, x.MINIMA) + "SELECT m.time, m.cell, max(o.v) AS maxpoleward FROM m JOIN g a ON a.cell=m.cell JOIN g b ON sign(a.lat)=sign(b.lat) AND abs(b.lat)>=abs(a.lat) AND least((a.i-b.i+24)%24, (b.i-a.i+24)%24)<=1 JOIN f o ON o.time=m.time AND o.cell=b.cell GROUP BY 1,2")
def max_poleward(spark, sf_dir):
    return n.max_poleward(x.minima(spark, sf_dir), x.field(spark, sf_dir), x.the_grid(spark), "v", 20.0)


def _contour_sql(rest: str) -> str:
    """Minima m, their pivots (smallest value of the connected cells within 16 degrees) and the
    flood ``rest`` from those."""
    near = f"ang AS (SELECT a.cell, b.cell AS nbr, round({x.gcd('a.lon', 'a.lat', 'b.lon', 'b.lat')}, 9)*CAST(a.cell<>b.cell AS INTEGER) AS dist FROM g a, g b)"
    disc_ = """reached(start, cell) AS (SELECT cell, cell FROM g UNION
      SELECT r.start, e.nbr FROM reached r JOIN edge e ON e.cell=r.cell JOIN ang a ON a.cell=r.start AND a.nbr=e.nbr WHERE a.dist <= 16.0)"""
    origin = """origin AS (SELECT m.time, m.cell AS node, arg_min(f.cell, (f.v, a.dist, f.cell)) AS cell, min(f.v) AS v0
      FROM m JOIN reached r ON r.start=m.cell JOIN ang a ON a.cell=m.cell AND a.nbr=r.cell JOIN f ON f.time=m.time AND f.cell=r.cell GROUP BY 1, 2)"""
    return "WITH RECURSIVE " + ", ".join((x.GRID, x.FIELD, x.MINIMA, near, disc_, origin)) + ", " + rest


_FLOOD = """flood(time, node, origin, v0, cell, v) AS (SELECT time, node, cell, v0, cell, v0 FROM origin UNION
      SELECT t.time, t.node, t.origin, t.v0, f.cell, f.v FROM flood t JOIN ang a ON a.cell=t.origin AND a.nbr=t.cell
      JOIN edge e ON e.cell=t.cell JOIN f ON f.time=t.time AND f.cell=e.nbr WHERE t.v-t.v0 < 30 AND a.dist <= 35.0),
far AS (SELECT DISTINCT t.time, t.node FROM flood t JOIN ang a ON a.cell=t.origin AND a.nbr=t.cell WHERE a.dist > 35.0)"""


@query(_contour_sql(_FLOOD) + " SELECT m.time, m.cell, m.value FROM m ANTI JOIN far ON far.time=m.time AND far.node=m.cell")
def closed_contour(spark, sf_dir):
    return n.closed_contour(x.minima(spark, sf_dir), x.field(spark, sf_dir), x.the_grid(spark), x.the_edges(spark), "v", 30.0, 35.0, 16.0)


@query(_contour_sql(_FLOOD) + " SELECT m.time, m.cell, m.value FROM m SEMI JOIN far ON far.time=m.time AND far.node=m.cell")
def no_closed_contour(spark, sf_dir):
    return n.closed_contour(x.minima(spark, sf_dir), x.field(spark, sf_dir), x.the_grid(spark), x.the_edges(spark), "v", 30.0, 35.0, 16.0, keep_closed=False)


def _delta_sql(made: str) -> str:
    """The largest change at which the flood from a pivot is still within 35 degrees: of cells
    inside, those whose paths change no more than the least of any path to a cell outside."""
    levels = """level(time, node, origin, v0, cell, up, out) AS (SELECT time, node, cell, v0, cell, CAST(0 AS DOUBLE), 0 FROM origin UNION
      SELECT t.time, t.node, t.origin, t.v0, f.cell, greatest(t.up, f.v-t.v0), CAST(a.dist >= 35.0 AS INTEGER) FROM level t
      JOIN edge e ON e.cell=t.cell JOIN f ON f.time=t.time AND f.cell=e.nbr JOIN ang a ON a.cell=t.origin AND a.nbr=e.nbr WHERE t.out = 0),
least AS (SELECT time, node, v0, cell, out, min(up) AS up FROM level GROUP BY ALL),
edge_of AS (SELECT time, node, min(up) AS bound FROM least WHERE out = 1 GROUP BY 1, 2)"""
    return _contour_sql(levels) + f" SELECT l.time, l.node AS cell, {made} FROM least l LEFT JOIN edge_of b ON b.time=l.time AND b.node=l.node WHERE out = 0 AND (bound IS NULL OR up <= bound) GROUP BY 1, 2"


@query(_delta_sql("max(up) AS delta"))
def max_contour_delta(spark, sf_dir):
    return n.max_closed_contour_delta(x.minima(spark, sf_dir), x.field(spark, sf_dir), x.the_grid(spark), x.the_edges(spark), "v", 35.0, search=16.0)


@query(_delta_sql("any_value(v0) + max(up) AS contour"))
def outermost_contour(spark, sf_dir):
    return n.contour_value(x.minima(spark, sf_dir), x.field(spark, sf_dir), x.the_grid(spark), x.the_edges(spark), "v", 35.0, search=16.0)
