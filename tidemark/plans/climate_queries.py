"""Queries of climatologies, accumulations, quantiles, harmonics and the blocking pipeline."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import blocking as k
from ..operators import climate as c
from . import fixtures as x
from .node_queries import _with

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def rounded(df, digits=6, *names):
    return df.withColumns({n: F.round(n, digits) for n in names})


_LEAP = "(year(time)%4=0 AND (year(time)%100<>0 OR year(time)%400=0))"
_IDX = {
    "daily": f"CAST(dayofyear(time) - CASE WHEN {_LEAP} AND month(time)>2 THEN 1 ELSE 0 END AS INTEGER)",
    "monthly": "CAST(month(time) AS INTEGER)",
    "seasonal": "CAST(floor((month(time)%12)/3) AS INTEGER)",
    "annual": "0",
    "all": "0",
}
_INST = {"daily": "year(time)", "monthly": "year(time)", "seasonal": "year(time)+CASE WHEN month(time)=12 THEN 1 ELSE 0 END", "annual": "year(time)", "all": "0"}


def _base(period: str, source: str, value: str) -> str:
    """CTE b (cell, idx, instance, time, x) without leap days."""
    return f"b AS (SELECT cell, {_IDX[period]} AS idx, CAST({_INST[period]} AS INTEGER) AS instance, time, {value} AS x FROM {source} WHERE NOT (month(time)=2 AND day(time)=29))"


def _climatology(period):
    def run(spark, sf_dir):
        made = c.climatology(x.daily(spark, sf_dir) if period == "daily" else x.field(spark, sf_dir), "x" if period == "daily" else "v", period)
        square = F.col("meansq") / 1e6 if period == "daily" else F.col("meansq")
        return made.select("cell", "idx", F.round("mean", 4).alias("mean"), F.round(square, 4).alias("meansq"), F.round("stddev", 3).alias("stddev"), "min", "max", "count")

    return run


for _period in c.PERIODS:
    _source, _value, _cte = ("d", "x", x.DAILY) if _period == "daily" else ("f", "v", x.FIELD)
    QUERIES[f"climatology_{_period}"] = _climatology(_period)
    SQL[f"climatology_{_period}"] = _with(_cte, _base(_period, _source, _value)) + f"SELECT cell, idx, round(avg(x), 4) AS mean, round(avg(x*x){'/1e6' if _period == 'daily' else ''}, 4) AS meansq, round(stddev_samp(x), 3) AS stddev, min(x) AS min, max(x) AS max, count(*) AS count FROM b GROUP BY 1,2"


@query(_with(x.FIELD, _base("seasonal", "f", "v")) + """SELECT cell, idx, round(avg(s), 6) AS sum, round(avg(lo), 6) AS avgmin, round(avg(hi), 6) AS avgmax, round(avg(n), 6) AS avgcount, round(avg(e), 6) AS threshsum
 FROM (SELECT cell, idx, instance, sum(x) AS s, min(x) AS lo, max(x) AS hi, count(*) FILTER (WHERE x>=60) AS n, sum(greatest(x-50, 0)) AS e FROM b GROUP BY 1,2,3) GROUP BY 1,2""")
def climatology_of_instances(spark, sf_dir):
    made = {"sum": F.sum("x"), "avgmin": F.min("x"), "avgmax": F.max("x"), "avgcount": F.count_if(F.col("x") >= 60), "threshsum": c.excess(">", 50.0)}
    return rounded(c.climatology_of_instances(x.field(spark, sf_dir), "v", "seasonal", made), 6, *made)


@query(_with(x.FIELD, _base("annual", "f", "v")) + ", k AS (SELECT *, row_number() OVER (PARTITION BY cell, idx, instance ORDER BY time)-1 AS k FROM b) SELECT cell, idx, round(avg(n), 6) AS timeuntil FROM (SELECT cell, idx, instance, coalesce(min(CASE WHEN x>70 THEN k END), count(*)) AS n FROM k GROUP BY 1,2,3) GROUP BY 1,2")
def climatology_time_until(spark, sf_dir):
    return rounded(c.time_until(x.field(spark, sf_dir), "v", "annual", ">", 70), 6, "timeuntil")


@query(_with(x.FIELD, _base("annual", "f", "v")) + """, r AS (SELECT *, sum(CASE WHEN x>60 THEN 0 ELSE 1 END) OVER (PARTITION BY cell, idx, instance ORDER BY time ROWS UNBOUNDED PRECEDING) AS r FROM b)
 SELECT cell, idx, round(avg(n), 6) AS maxconsec FROM (SELECT cell, idx, instance, max(n) AS n FROM (SELECT cell, idx, instance, r, count(*) FILTER (WHERE x>60) AS n FROM r GROUP BY 1,2,3,4) GROUP BY 1,2,3) GROUP BY 1,2""")
def climatology_longest_run(spark, sf_dir):
    return rounded(c.longest_run(x.field(spark, sf_dir), "v", "annual", ">", 60), 6, "maxconsec")


@query(_with(x.FIELD, _base("annual", "f", "v")) + """, l AS (SELECT * FROM (SELECT *, lag(x, 2) OVER (PARTITION BY cell, idx, instance ORDER BY time) AS y FROM b) WHERE y IS NOT NULL),
 q AS (SELECT cell, idx, instance, CAST(count(*) AS DOUBLE) AS n, sum(x) AS sx, sum(y) AS sy, sum(x*x) AS sxx, sum(y*y) AS syy, sum(x*y) AS sxy FROM l GROUP BY 1,2,3)
 SELECT cell, idx, round(avg(CASE WHEN n*sxx-sx*sx <= 1e-9*n*sxx OR n*syy-sy*sy <= 1e-9*n*syy THEN 1.0 ELSE (n*sxy-sx*sy)/sqrt((n*sxx-sx*sx)*(n*syy-sy*sy)) END), 6) AS autocor FROM q GROUP BY 1,2""")
def climatology_autocorrelation(spark, sf_dir):
    return rounded(c.autocorrelation(x.field(spark, sf_dir), "v", "annual", 2), 6, "autocor")


@query(_with(x.FIELD) + "SELECT cell, v AS quantile FROM (SELECT cell, v, row_number() OVER (PARTITION BY cell ORDER BY v)-1 AS k, count(*) OVER (PARTITION BY cell) AS n FROM f WHERE v>=5) WHERE k = floor((n-1)*0.95)")
def quantile_exact(spark, sf_dir):
    return c.quantile(x.field(spark, sf_dir), "v", 0.95, low=5)


@query()
def quantile_approximate(spark, sf_dir):
    return c.quantile_approximate(x.field(spark, sf_dir), "v", 0.95)


_BUCKET = {
    "1h": "date_trunc('hour', time)",
    "3h": "date_trunc('day', time) + to_hours(CAST(floor(hour(time)/3)*3 AS INTEGER))",
    "6h": "date_trunc('day', time) + to_hours(CAST(floor(hour(time)/6)*6 AS INTEGER))",
    "daily": "date_trunc('day', time - INTERVAL 6 HOUR) + INTERVAL 6 HOUR",
    "monthly": "date_trunc('month', time)",
    "annual": "date_trunc('year', time)",
    "wateryear": "make_timestamp(year(time) - CASE WHEN month(time)<10 THEN 1 ELSE 0 END, 10, 1, 0, 0, 0.0)",
}


def _accumulate(freq, op):
    def run(spark, sf_dir):
        source = x.field(spark, sf_dir) if freq in ("annual", "wateryear") else x.series(spark, sf_dir)
        made = c.accumulate(source, "v" if freq in ("annual", "wateryear") else "x", freq, op, 6 if freq == "daily" else 0)
        return made.select("cell", F.date_format("bucket", "yyyy-MM-dd HH:mm").alias("bucket"), F.round("value", 5).alias("value"))

    return run


for _freq, _op in (("1h", "sum"), ("3h", "max"), ("6h", "avg"), ("daily", "sum"), ("monthly", "min"), ("annual", "sum"), ("wateryear", "avg")):
    QUERIES[f"accumulate_{_freq}_{_op}"] = _accumulate(_freq, _op)
    _src, _val, _cte = ("f", "v", x.FIELD) if _freq in ("annual", "wateryear") else ("s", "x", x.SERIES)
    SQL[f"accumulate_{_freq}_{_op}"] = _with(_cte) + f"SELECT cell, strftime({_BUCKET[_freq]}, '%Y-%m-%d %H:%M') AS bucket, round({_op}({_val}), 5) AS value FROM {_src} GROUP BY 1, 2"


@query("""WITH s AS (SELECT CAST(user_id AS INTEGER) AS cell, date_trunc('day', ts) AS initial, hour(ts) AS hour, max(value) AS x FROM events GROUP BY 1,2,3),
 v AS (SELECT cell, initial + to_hours(CAST(hour AS INTEGER)) AS time, arg_max(x, initial) AS x FROM s GROUP BY 1,2)
 SELECT cell, strftime(date_trunc('day', time), '%Y-%m-%d') AS bucket, round(sum(x), 5) AS value FROM v GROUP BY 1,2""")
def accumulate_forecast(spark, sf_dir):
    s = x.series(spark, sf_dir).groupBy("cell", F.date_trunc("day", "time").cast("timestamp_ntz").alias("initial"), F.hour("time").alias("hour")).agg(F.max("x").alias("x"))
    return c.accumulate_forecast(s, "x", "daily").select("cell", F.date_format("bucket", "yyyy-MM-dd").alias("bucket"), F.round("value", 5).alias("value"))


_SERIES24 = "z AS (SELECT CAST(user_id AS INTEGER) AS cell, hour(ts) AS k, sum(value) AS y FROM events GROUP BY 1,2)"


@query(f"""WITH {_SERIES24}, co AS (SELECT cell, sum(y) AS a0, sum(y*cos(2*pi()*k/24)) AS a1, sum(y*sin(2*pi()*k/24)) AS b1, sum(y*cos(4*pi()*k/24)) AS a2, sum(y*sin(4*pi()*k/24)) AS b2 FROM z GROUP BY 1)
 SELECT cell, CAST(k AS INTEGER) AS k, round((a0+2*(a1*cos(2*pi()*k/24)+b1*sin(2*pi()*k/24))+2*(a2*cos(4*pi()*k/24)+b2*sin(4*pi()*k/24)))/24, 5) AS smooth FROM z JOIN co USING (cell)""")
def fourier_filter(spark, sf_dir):
    s = x.series(spark, sf_dir).groupBy("cell", F.hour("time").alias("k")).agg(F.sum("x").alias("y"))
    return rounded(c.harmonics(s, "y", "k", ["cell"], 3, 24), 5, "smooth")


_LEVELS = "z AS (SELECT CAST(l_suppkey%12 AS INTEGER) AS cell, CAST(l_linenumber*100 AS DOUBLE) AS p, sum(l_quantity) AS v, l_returnflag AS flag FROM lineitem GROUP BY 1,2,4)"


def _levels(spark, sf_dir):
    return x.table(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") % 12).cast("int").alias("cell"), (F.col("l_linenumber") * 100).cast("double").alias("p"), F.col("l_returnflag").alias("flag")).agg(F.sum("l_quantity").alias("v"))


@query(f"WITH {_LEVELS}, q AS (SELECT *, lead(p) OVER w AS p2, lead(v) OVER w AS v2 FROM z WINDOW w AS (PARTITION BY cell, flag ORDER BY p)) SELECT cell, flag, round(sum(abs(p2-p)*(v+v2)/2), 5) AS integral FROM q GROUP BY 1,2")
def vertical_integral(spark, sf_dir):
    return rounded(c.integrate_levels(_levels(spark, sf_dir), "v", ["cell", "flag"], "p"), 5, "integral")


@query(f"WITH {_LEVELS} SELECT cell, flag, round(sum(abs((p+50)-(p-50)*0.9)*v), 5) AS integral FROM z GROUP BY 1,2")
def vertical_integral_bounds(spark, sf_dir):
    bounds = _levels(spark, sf_dir).withColumn("a", F.col("p") + 50).withColumn("b", (F.col("p") - 50) * 0.9)
    return rounded(c.integrate_bounds(bounds, "v", ["cell", "flag"], "b", "a"), 5, "integral")


@query(f"""WITH {_LEVELS}, q AS (SELECT *, lead(p) OVER w AS p2, lead(v) OVER w AS v2 FROM z WINDOW w AS (PARTITION BY cell, flag ORDER BY p))
 SELECT cell, flag, t AS target, round(coalesce(v+(v2-v)*(t-p)/(p2-p), v), 6) AS value FROM q JOIN (VALUES (150.0::DOUBLE), (300.0::DOUBLE), (420.0::DOUBLE)) AS w(t) ON (p<=t AND t<p2) OR (p=t AND p2 IS NULL)""")
def level_interpolation(spark, sf_dir):
    return rounded(c.interpolate_levels(_levels(spark, sf_dir), "v", ["cell", "flag"], "p", [150.0, 300.0, 420.0]), 6, "value")


# ---- blocking
_LONLAT = "h AS (SELECT f.time, g.lon, g.lat, f.v AS z FROM f JOIN g USING (cell))"


def _heights(spark, sf_dir):
    return x.field(spark, sf_dir).join(F.broadcast(x.the_grid(spark).select("cell", "lon", "lat")), "cell").select("time", "lon", "lat", F.col("v").alias("z"), "cell")


@query(_with(x.GRID, x.FIELD, _LONLAT) + """SELECT time, lon, lat, round(south, 6) AS south, round(north, 6) AS north, CASE WHEN lat>0 THEN south>0 AND north < -1 ELSE north<0 AND south>1 END AS blocked FROM (
 SELECT a.time, a.lon, a.lat, (a.z-s.z)/15 AS south, (n.z-a.z)/15 AS north FROM h a JOIN h s ON s.time=a.time AND s.lon=a.lon AND s.lat=a.lat-15 JOIN h n ON n.time=a.time AND n.lon=a.lon AND n.lat=a.lat+15 WHERE abs(a.lat) BETWEEN 25 AND 75)""")
def gradient_index(spark, sf_dir):
    return rounded(k.gradient_index(_heights(spark, sf_dir), "z", 15.0, -1.0), 6, "south", "north")


_TURNS = """vw AS (SELECT time, lon, lat, coalesce(lead(w) OVER a, first_value(w) OVER aw)-coalesce(lag(w) OVER a, last_value(w) OVER aw) AS dw,
 lead(v*cos(radians(lat))) OVER b-lag(v*cos(radians(lat))) OVER b AS df, lead(lat) OVER b-lag(lat) OVER b AS dy FROM f JOIN g USING (cell) WINDOW a AS (PARTITION BY time, lat ORDER BY lon),
 aw AS (PARTITION BY time, lat ORDER BY lon ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), b AS (PARTITION BY time, lon ORDER BY lat))"""


@query(_with(x.GRID, x.FIELD, _TURNS) + "SELECT time, lon, lat, round(1e6*(dw/(radians(30.0)*6371000*cos(radians(lat)))-df/(radians(dy)*6371000*cos(radians(lat)))), 6) AS vorticity FROM vw WHERE df IS NOT NULL")
def vorticity(spark, sf_dir):
    f = x.field(spark, sf_dir).join(F.broadcast(x.the_grid(spark).select("cell", "lon", "lat")), "cell")
    made = k.relative_vorticity(f, "v", "w", ["time"], 15.0)
    return made.withColumn("vorticity", F.round(1e6 * F.col("vorticity"), 6))


_DOY = _IDX["daily"]
_MEAN = f"mn AS (SELECT cell, {_DOY} AS day, avg(x) AS mean FROM d WHERE NOT (month(time)=2 AND day(time)=29) GROUP BY 1,2)"
_ANOM = f"an AS (SELECT d.time, d.cell, d.x - mn.mean AS anomaly, mn.day FROM (SELECT *, {_DOY} AS day FROM d) d JOIN mn ON mn.cell=d.cell AND mn.day=d.day)"


@query(_with(x.DAILY, _MEAN) + "SELECT cell, day, round(mean, 4) AS mean FROM mn")
def day_of_year_mean(spark, sf_dir):
    return rounded(k.day_of_year_mean(x.daily(spark, sf_dir), "x"), 4, "mean")


@query(_with(x.DAILY, _MEAN, _ANOM) + "SELECT time, cell, round(anomaly, 4) AS anomaly FROM an")
def day_of_year_anomaly(spark, sf_dir):
    d = x.daily(spark, sf_dir)
    return rounded(k.anomalies(d, "x", k.day_of_year_mean(d, "x")), 4, "anomaly")


@query(_with(x.DAILY) + "SELECT time, cell, round(CASE WHEN count(*) OVER w = 4 THEN avg(x) OVER w ELSE x END, 4) AS smooth FROM d WINDOW w AS (PARTITION BY cell ORDER BY time ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING)")
def two_day_mean(spark, sf_dir):
    return rounded(k.two_day_mean(x.daily(spark, sf_dir), "x", 2), 4, "smooth").select("time", "cell", "smooth")


@query(_with(x.DAILY, _MEAN) + "SELECT cell, day, round(avg(mean) OVER (PARTITION BY cell ORDER BY day ROWS BETWEEN 30 PRECEDING AND 30 FOLLOWING), 6) AS smooth FROM mn")
def running_mean_61_days(spark, sf_dir):
    return rounded(k.running_mean(k.day_of_year_mean(x.daily(spark, sf_dir), "x"), "mean", 30), 6, "smooth")


@query(_with(x.DAILY, _MEAN, _ANOM) + """, rm AS (SELECT cell, day, 1.5*sqrt(avg(anomaly*anomaly)) AS t FROM an GROUP BY 1,2),
 co AS (SELECT cell, sum(t) AS a0, sum(t*cos(2*pi()*(day-1)/365)) AS a1, sum(t*sin(2*pi()*(day-1)/365)) AS b1 FROM rm GROUP BY 1)
 SELECT cell, day, round(greatest((a0+2*(a1*cos(2*pi()*(day-1)/365)+b1*sin(2*pi()*(day-1)/365)))/365, 100.0), 4) AS threshold FROM rm JOIN co USING (cell)""")
def variable_threshold(spark, sf_dir):
    d = x.daily(spark, sf_dir)
    return rounded(k.variable_threshold(k.anomalies(d, "x", k.day_of_year_mean(d, "x")), 1.5, 2, 100.0), 4, "threshold")


@query(_with(x.GRID, x.FIELD) + """, mn AS (SELECT cell, dayofyear(time) - CASE WHEN (year(time)%4=0) AND month(time)>2 THEN 1 ELSE 0 END AS day, avg(v) AS mean FROM f GROUP BY 1,2)
 SELECT f.time, f.cell, CAST(CASE WHEN abs(lat) BETWEEN 25 AND 75 AND v-mean > 0 THEN floor((v-mean)/greatest(0.3*mean, 5)) ELSE 0 END AS INTEGER) AS level
 FROM f JOIN g USING (cell) JOIN mn ON mn.cell=f.cell AND mn.day=dayofyear(f.time) - CASE WHEN (year(f.time)%4=0) AND month(f.time)>2 THEN 1 ELSE 0 END""")
def normalised_anomaly(spark, sf_dir):
    f = x.field(spark, sf_dir)
    mean = k.day_of_year_mean(f, "v")
    anomaly = k.anomalies(f, "v", mean).join(F.broadcast(x.the_grid(spark).select("cell", "lat")), "cell")
    return k.normalised(anomaly, mean.select("cell", "day", (F.col("mean") * 0.3).alias("threshold")), 5.0)


@query(_with(x.DAILY) + f", y AS (SELECT *, {_DOY} AS day, year(time) AS y FROM d), fit AS (SELECT cell, day, CASE WHEN count(DISTINCT y)>1 THEN regr_slope(x, y) ELSE 0 END AS slope FROM y GROUP BY 1,2) SELECT time, cell, round(x - slope*(y-1998), 3) AS detrended FROM y JOIN fit USING (cell, day)")
def detrended(spark, sf_dir):
    return rounded(k.detrend(x.daily(spark, sf_dir), "x", 1998), 3, "detrended")


@query(_with(x.GRID, x.FIELD) + """, h AS (SELECT time, lat, lon, CASE WHEN v<40 THEN NULL ELSE v END AS v FROM f JOIN g USING (cell)),
 q AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN lon END IGNORE NULLS) OVER a AS x1, last_value(v IGNORE NULLS) OVER a AS v1, first_value(CASE WHEN v IS NOT NULL THEN lon END IGNORE NULLS) OVER b AS x2, first_value(v IGNORE NULLS) OVER b AS v2
  FROM h WINDOW a AS (PARTITION BY time, lat ORDER BY lon ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), b AS (PARTITION BY time, lat ORDER BY lon ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
 SELECT time, lat, lon, round(coalesce(v, v1+(v2-v1)*(lon-x1)/(x2-x1)), 6) AS filled FROM q""")
def fill_along_longitude(spark, sf_dir):
    h = _heights(spark, sf_dir).withColumn("v", F.when(F.col("z") >= 40, F.col("z")))
    return rounded(k.fill_along_longitude(h, "v", ["time", "lat"]), 6, "filled")


@query(_with(x.SERIES) + "SELECT * FROM s WHERE hour(time) = 12 AND time >= TIMESTAMP '2024-01-10 00:00:00'")
def hour_of_later_part(spark, sf_dir):
    return k.at_hour(k.split_at(x.series(spark, sf_dir), "2024-01-10 00:00:00")[1], 12)


@query("SELECT CAST(l_suppkey%12 AS INTEGER) AS cell, l_returnflag AS flag, sum(l_quantity)/9.8 AS z FROM lineitem WHERE l_linenumber = 5 GROUP BY 1,2")
def level_height(spark, sf_dir):
    return k.at_level(_levels(spark, sf_dir).withColumnsRenamed({"p": "lev", "v": "z"}), 500.0, "z").select("cell", "flag", "z")
