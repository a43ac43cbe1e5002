"""Queries of whole detection plans and of what rounds the other modules off."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import blobs as b
from ..operators import blocking as k
from ..operators import grid as g
from ..operators import metrics as m
from ..operators import nodes as n
from ..operators import profiles as p
from ..operators import stitch as s
from . import blob_queries as bq
from . import fixtures as x
from . import metric_queries as mq
from . import track_queries as tq
from .climate_queries import rounded
from .node_queries import _BEATEN, _FLOOD, _PLACED, _contour_sql, _with

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_STEPS = f"""{_PLACED}, mg AS (SELECT time, cell, value FROM p WHERE lat BETWEEN -70 AND 70 AND NOT EXISTS ({_BEATEN} AND o.lat BETWEEN -70 AND 70)), {x.disc(16)},
th AS (SELECT mg.* FROM mg WHERE EXISTS (SELECT 1 FROM disc d JOIN f o ON o.cell=d.nbr AND o.time=mg.time WHERE d.cell=mg.cell AND o.w > 36000)), {_FLOOD}"""


def _detected(spark, sf_dir, **contours):
    grid = x.the_grid(spark)
    discs = {16.0: g.disc(grid, 16.0)}
    return n.detect(
        x.field(spark, sf_dir), grid, x.the_edges(spark), "v", where=F.col("value") > 5, box=(0.0, 0.0, -70.0, 70.0), merge=32.0, discs=discs,
        threshold=("w", ">", 36000, 16.0), **contours,
    )


@query(_contour_sql(_STEPS) + " SELECT th.time, th.cell, th.value FROM th ANTI JOIN far ON far.time=th.time AND far.node=th.cell")
def detect_closed(spark, sf_dir):
    return _detected(spark, sf_dir, closed_by=(("v", 30.0, 35.0, 16.0),))


@query(_contour_sql(_STEPS) + " SELECT th.time, th.cell, th.value FROM th SEMI JOIN far ON far.time=th.time AND far.node=th.cell")
def detect_not_closed(spark, sf_dir):
    return _detected(spark, sf_dir, not_closed_by=(("v", 30.0, 35.0, 16.0),))


@query(tq.HEAD + """, q AS (SELECT track_id, step, p, lead(step) OVER v AS s2, lead(p) OVER v AS p2 FROM tn WINDOW v AS (PARTITION BY track_id ORDER BY step)), t AS (SELECT DISTINCT step + 0.25 AS t FROM n UNION SELECT DISTINCT step FROM n)
 SELECT track_id, CAST(t AS DOUBLE) AS t, round(CASE WHEN t=step THEN p ELSE p+(t-step)/(s2-step)*(p2-p) END, 5) AS p FROM q JOIN t ON (t>=step AND t<s2) OR (t=step AND s2 IS NULL)""")
def track_columns_at_times(spark, sf_dir):
    steps = x.candidates(spark, sf_dir).select(F.explode(F.array(F.col("step").cast("double"), F.col("step") + 0.25)).alias("t")).distinct()
    return rounded(s.at_times(tq.walked(spark, sf_dir), steps, ("p",)).select("track_id", "t", "p"), 5, "p")


@query(tq.NEAR + "SELECT step, cand, min(x) AS min, max(x) AS max FROM ce GROUP BY 1, 2")
def node_extremes(spark, sf_dir):
    return p.extremes(tq.near_cells(spark, sf_dir), "x")


@query(tq._sampled(tq._SQUARE) + "SELECT ix, iy, round(avg(x-p), 6) AS mean, min(x-p) AS min, max(x-p) AS max, count(x) AS count FROM sm JOIN sf USING (step, cell) JOIN n USING (step, cand) GROUP BY 1, 2")
def composite_minus(spark, sf_dir):
    made = p.composite(x.candidates(spark, sf_dir), tq.step_field(spark, sf_dir), x.the_grid(spark), 10.0, 2, 22.0, flip_south=True, minus="p")
    return rounded(made, 6, "mean")


@query(tq._sampled(tq._SQUARE.replace("lon AS lon0, lat AS lat0", "100.25 AS lon0, 20.5 AS lat0")) + "SELECT ix, iy, round(avg(x), 6) AS mean, min(x) AS min, max(x) AS max, count(x) AS count FROM sm JOIN sf USING (step, cell) GROUP BY 1, 2")
def composite_fixed_centre(spark, sf_dir):
    return rounded(p.composite(x.candidates(spark, sf_dir), tq.step_field(spark, sf_dir), x.the_grid(spark), 10.0, 2, 22.0, centre=(100.25, 20.5)), 6, "mean")


@query(bq.ALL + " SELECT time, cell, CAST(dense_rank() OVER (ORDER BY time, blob) AS BIGINT) AS blob_id FROM c")
def blob_running_ids(spark, sf_dir):
    return b.running_ids(bq.found(spark, sf_dir))


@query(bq.ALL + " SELECT DISTINCT time, cell, CAST(1 AS INTEGER) AS tag FROM c")
def blob_flattened(spark, sf_dir):
    return b.flattened(bq.found(spark, sf_dir))


@query(mq.SQL["similarity"].replace("SELECT cm.time, cm.x, cm.y, round(c/(sx+sy-c), 6) AS similarity", ", sq AS (SELECT c/(sx+sy-c) AS similarity")
       + ") SELECT count(*) AS pairs, round(min(similarity), 6) AS least, round(quantile_cont(similarity, 0.25), 6) AS q25, round(median(similarity), 6) AS median, round(quantile_cont(similarity, 0.75), 6) AS q75, round(max(similarity), 6) AS greatest FROM sq")
def similarity_quartiles(spark, sf_dir):
    pairs = m.similarity(bq.found(spark, sf_dir), mq.other(spark, sf_dir), x.the_grid(spark))
    return rounded(m.similarity_quartiles(pairs), 6, "least", "q25", "median", "q75", "greatest")


# ---- tracked boxes by day, and single ones of which some are parts of them
_BOXES = """tr AS (SELECT CAST(c_custkey % 40 AS INTEGER) AS time, CAST(c_custkey AS INTEGER) AS blob, CAST(c_custkey*7%50 AS DOUBLE) AS area, CAST(c_custkey*13%60-40 AS DOUBLE) AS minlat, CAST(c_custkey*13%60-40+20 AS DOUBLE) AS maxlat,
 CAST(c_custkey*37%360 AS DOUBLE) AS minlon, CAST((c_custkey*37+60)%360 AS DOUBLE) AS maxlon FROM customer WHERE c_custkey % 3 = 0),
sg AS (SELECT CAST(c_custkey % 40 AS INTEGER) AS time, CAST(c_custkey AS INTEGER) AS blob, CAST(c_custkey*11%70 AS DOUBLE) AS area, CAST(c_custkey*17%60-35 AS DOUBLE) AS minlat, CAST(c_custkey*17%60-35+8 AS DOUBLE) AS maxlat,
 CAST(c_custkey*29%360 AS DOUBLE) AS minlon, CAST((c_custkey*29+15)%360 AS DOUBLE) AS maxlon FROM customer WHERE c_custkey % 3 > 0)"""


@query(f"""WITH {_BOXES}, sm AS (SELECT sg.time, sg.blob, tr.blob AS tracked FROM sg JOIN tr USING (time, area)),
 pt AS (SELECT s.time, s.blob, t.blob AS tracked FROM sg s JOIN tr t ON s.time=t.time WHERE s.minlat>=t.minlat AND s.maxlat<=t.maxlat AND (s.minlon-t.minlon+360)%360+(s.maxlon-s.minlon+360)%360 <= (t.maxlon-t.minlon+360)%360
  AND NOT EXISTS (SELECT 1 FROM sm WHERE sm.time=s.time AND sm.blob=s.blob) AND NOT EXISTS (SELECT 1 FROM sm WHERE sm.time=t.time AND sm.tracked=t.blob))
 SELECT sg.time, sg.blob, u.tracked FROM sg LEFT JOIN (SELECT * FROM sm UNION ALL SELECT * FROM pt) u USING (time, blob)""")
def merge_contained(spark, sf_dir):
    key = F.col("c_custkey")

    def boxes(rows, area, mod, south, lat, high, lon, wide):
        low, west = key * lat % 60 + south, key * lon % 360
        made = [(key % 40).cast("int").alias("time"), key.cast("int").alias("blob"), (key * area % mod).cast("double").alias("area"), low.cast("double").alias("minlat"), (low + high).cast("double").alias("maxlat")]
        return rows.select(*made, west.cast("double").alias("minlon"), ((key * lon + wide) % 360).cast("double").alias("maxlon"))

    customers = x.table(spark, sf_dir, "customer")
    tracked = boxes(customers.where(key % 3 == 0), 7, 50, -40, 13, 20, 37, 60)
    single = boxes(customers.where(key % 3 > 0), 11, 70, -35, 17, 8, 29, 15)
    return m.merge_contained(tracked, single)


_KM = lambda lo1, la1, lo2, la2: f"(2*6371.0*asin(sqrt(least(1.0, pow(sin(radians({la2}-{la1})/2),2)+cos(radians({la1}))*cos(radians({la2}))*pow(sin(radians({lo2}-{lo1})/2),2)))))"


@query(_with(x.GRID, x.FIELD) + f""", z AS (SELECT time, i, j, lon, lat, v-40 AS v FROM f JOIN g USING (cell)),
 q AS (SELECT a.time, (a.v+e.v+o.v+d.v)/4 AS m, ({_KM('a.lon', 'a.lat', 'e.lon', 'a.lat')}+{_KM('a.lon', 'o.lat', 'e.lon', 'o.lat')})/2*{_KM('a.lon', 'a.lat', 'a.lon', 'o.lat')} AS s
  FROM z a JOIN z e ON e.time=a.time AND e.i=a.i+1 AND e.j=a.j JOIN z o ON o.time=a.time AND o.i=a.i AND o.j=a.j+1 JOIN z d ON d.time=a.time AND d.i=a.i+1 AND d.j=a.j+1)
 SELECT q.time, round(sum(s), 3) AS sum_area, any_value(most) AS most, round(sum(m*s)/1e8, 6) AS index FROM q JOIN (SELECT time, max(v) AS most FROM z GROUP BY 1) USING (time) WHERE m > 0 GROUP BY 1""")
def area_intensity(spark, sf_dir):
    f = x.field(spark, sf_dir).join(F.broadcast(x.the_grid(spark).select("cell", "i", "j", "lon", "lat")), "cell").withColumn("v", F.col("v") - 40)
    return rounded(rounded(m.area_intensity(f, "v", ["time"]), 3, "sum_area"), 6, "index")


def _first(table: str, keys: str, position: str, n: str, out: str) -> str:
    """SQL: the mean and the first harmonic of a series, added up by keys."""
    turn = f"2*pi()*{position}/{n}"
    return f"""{out}c AS (SELECT {keys}, sum(t) AS a0, sum(t*cos({turn})) AS a1, sum(t*sin({turn})) AS b1 FROM {table} GROUP BY ALL),
{out} AS (SELECT {table}.* EXCLUDE (t), (a0+2*(a1*cos({turn})+b1*sin({turn})))/{n} AS t FROM {table} JOIN {out}c USING ({keys}))"""


@query(_with(x.GRID, x.FIELD) + f""", l0 AS (SELECT i, j, month(time)-1 AS day, j<6 AS south, j%6 AS r, sqrt(avg((v-40)*(v-40))) AS t FROM f JOIN g USING (cell) GROUP BY ALL),
 {_first('l0', 'j, day, south, r', 'i', '24', 'l1')}, {_first('l1', 'i, day, south', 'r', '6', 'l2')}, {_first('l2', 'i, j, south, r', 'day', '12', 'l3')}
 SELECT i, j, CAST(day AS INTEGER) AS day, round(greatest(t, 20.0), 6) AS threshold FROM l3""")
def smoothed_threshold(spark, sf_dir):
    f = x.field(spark, sf_dir).join(F.broadcast(x.the_grid(spark).select("cell", "i", "j")), "cell")
    level = f.groupBy("i", "j", (F.month("time") - 1).alias("day")).agg(F.sqrt(F.avg((F.col("v") - 40) ** 2)).alias("t"))
    return rounded(k.smoothed_threshold(level, x.N_LON, x.N_LAT, 12, (2, 2, 2), 20.0), 6, "threshold")
