"""Gridded fields, series and nodes derived from the driver's tables, in Spark and as SQL.

The field has 24 x 12 cells and months of the line items: v is a sum of quantities, w a mean
price, both exact in either engine. SQL texts are CTEs for DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import grid as g

N_LON, N_LAT = 24, 12


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def field(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    cell = (F.col("l_suppkey") % 12) * 24 + (F.col("l_partkey") * 7 + F.col("l_linenumber") * 5) % 24
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    return items.groupBy(F.date_trunc("month", "l_shipdate").cast("timestamp_ntz").alias("time"), cell.cast("int").alias("cell")).agg(F.sum("l_quantity").alias("v"), (F.sum(cents).cast("double") / F.count("*") / 100).alias("w"))


def the_grid(spark: SparkSession) -> DataFrame:
    return g.lat_lon_grid(spark, N_LAT, N_LON)


def the_edges(spark: SparkSession) -> DataFrame:
    return g.edges(the_grid(spark))


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cell, time, x): events as a series for each user."""
    return table(spark, sf_dir, "events").select(F.col("user_id").cast("int").alias("cell"), F.col("ts").alias("time"), F.col("value").alias("x"), "event_id")


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(time, cell, x): whole cents of orders by day, for 5 cells."""
    orders = table(spark, sf_dir, "orders")
    return orders.groupBy(F.date_trunc("day", "o_orderdate").cast("timestamp_ntz").alias("time"), (F.col("o_custkey") % 5).cast("int").alias("cell")).agg(F.sum(F.round("o_totalprice").cast("long")).cast("double").alias("x"))


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(step, cand, lon, lat, p): a node a month and supplier group, drifting with the month."""
    items = table(spark, sf_dir, "lineitem")
    step = (F.year("l_shipdate") * 12 + F.month("l_shipdate")).cast("int")
    sums = items.groupBy(step.alias("step"), (F.col("l_suppkey") % 10).cast("int").alias("cand")).agg(F.sum("l_quantity").cast("long").alias("q"))
    return sums.select("step", "cand", F.pmod(F.col("cand") * 36 + F.col("step") * 2 + F.col("q") % 7, F.lit(360)).cast("double").alias("lon"), (((F.col("cand") * 13 + F.col("q") % 5) % 120) - 60).cast("double").alias("lat"), F.col("q").cast("double").alias("p"))


GRID = """g AS (SELECT CAST(j*24+i AS INTEGER) AS cell, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, 15.0*i AS lon, -82.5+15.0*j AS lat,
      (sin(radians(-75.0+15.0*j)) - sin(radians(-90.0+15.0*j)))*radians(15.0) AS area FROM range(0,24) a(i), range(0,12) b(j)),
edge AS (SELECT a.cell, b.cell AS nbr FROM g a JOIN g b ON (a.j=b.j AND (b.i=(a.i+1)%24 OR b.i=(a.i+23)%24)) OR (a.i=b.i AND (b.j=a.j+1 OR b.j=a.j-1)))"""
FIELD = """f AS (SELECT date_trunc('month', l_shipdate) AS time, CAST((l_suppkey%12)*24 + (l_partkey*7+l_linenumber*5)%24 AS INTEGER) AS cell,
      sum(l_quantity) AS v, CAST(sum(CAST(round(l_extendedprice*100) AS BIGINT)) AS DOUBLE)/count(*)/100 AS w FROM lineitem GROUP BY 1,2)"""
SERIES = "s AS (SELECT CAST(user_id AS INTEGER) AS cell, ts AS time, value AS x, event_id FROM events)"
DAILY = """d AS (SELECT date_trunc('day', o_orderdate) AS time, CAST(o_custkey%5 AS INTEGER) AS cell, CAST(sum(CAST(round(o_totalprice) AS BIGINT)) AS DOUBLE) AS x FROM orders GROUP BY 1,2)"""
NODES = """n AS (SELECT step, cand, CAST((cand*36+step*2+q%7)%360 AS DOUBLE) AS lon, CAST(((cand*13+q%5)%120)-60 AS DOUBLE) AS lat, CAST(q AS DOUBLE) AS p FROM (
      SELECT CAST(year(l_shipdate)*12+month(l_shipdate) AS INTEGER) AS step, CAST(l_suppkey%10 AS INTEGER) AS cand, CAST(sum(l_quantity) AS BIGINT) AS q FROM lineitem GROUP BY 1,2))"""


def scale(spark: SparkSession, sf_dir: str) -> int:
    """How many times finer than 24 x 12 the growing grid is: cells grow with the line items."""
    return max(1, int((table(spark, sf_dir, "lineitem").count() / 60000) ** 0.5))


def fine_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = scale(spark, sf_dir)
    return g.lat_lon_grid(spark, N_LAT * k, N_LON * k)


def fine_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(step, cell, x): quantities by month on the growing grid."""
    k = scale(spark, sf_dir)
    step = (F.year("l_shipdate") * 12 + F.month("l_shipdate")).cast("int")
    cell = (F.col("l_suppkey") * 31 + F.col("l_partkey")) % (N_LAT * k) * (N_LON * k) + (F.col("l_partkey") * 7 + F.col("l_linenumber") * 5) % (N_LON * k)
    return table(spark, sf_dir, "lineitem").groupBy(step.alias("step"), cell.cast("int").alias("cell")).agg(F.sum("l_quantity").alias("x"))


def fine_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(step, cand, lon, lat, p): nodes by month, as many as the grid is fine."""
    k = scale(spark, sf_dir)
    step = (F.year("l_shipdate") * 12 + F.month("l_shipdate")).cast("int")
    cand = (F.col("l_suppkey") % (10 * k * k)).cast("int")
    sums = table(spark, sf_dir, "lineitem").groupBy(step.alias("step"), cand.alias("cand")).agg(F.sum("l_quantity").cast("long").alias("q"))
    lon, lat = (F.col("cand") * 37 + F.col("step") * 2 + F.col("q") % 7) % 360 + 0.25, (F.col("cand") * 13 + F.col("q") % 5) % 150 - 75 + 0.125
    return sums.select("step", "cand", lon.cast("double").alias("lon"), lat.cast("double").alias("lat"), F.col("q").cast("double").alias("p"))


FINE = """kk AS (SELECT greatest(1, CAST(floor(sqrt(count(*)/60000.0)) AS INTEGER)) AS k FROM lineitem),
g AS (SELECT CAST(j*24*k+i AS INTEGER) AS cell, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, i*(15.0/k) AS lon, -90.0+(j+0.5)*(15.0/k) AS lat,
      (sin(radians(-90.0+(j+1)*(15.0/k))) - sin(radians(-90.0+j*(15.0/k))))*radians(15.0/k) AS area
      FROM kk, unnest(range(24*kk.k)) a(i), unnest(range(12*kk.k)) b(j)),
edge AS (SELECT a.cell, b.cell AS nbr FROM g a JOIN g b ON a.j=b.j AND (b.i=(a.i+1)%(24*(SELECT k FROM kk)) OR a.i=(b.i+1)%(24*(SELECT k FROM kk)))
      UNION ALL SELECT a.cell, b.cell FROM g a JOIN g b ON a.i=b.i AND abs(a.j-b.j)=1),
sf AS (SELECT CAST(year(l_shipdate)*12+month(l_shipdate) AS INTEGER) AS step, CAST((l_suppkey*31+l_partkey)%(12*k)*(24*k) + (l_partkey*7+l_linenumber*5)%(24*k) AS INTEGER) AS cell,
      sum(l_quantity) AS x FROM lineitem, kk GROUP BY 1,2),
n AS (SELECT step, cand, CAST((cand*37+step*2+q%7)%360 AS DOUBLE)+0.25 AS lon, CAST((cand*13+q%5)%150-75 AS DOUBLE)+0.125 AS lat, CAST(q AS DOUBLE) AS p FROM (
      SELECT CAST(year(l_shipdate)*12+month(l_shipdate) AS INTEGER) AS step, CAST(l_suppkey%(10*k*k) AS INTEGER) AS cand, CAST(sum(l_quantity) AS BIGINT) AS q FROM lineitem, kk GROUP BY 1,2))"""


def gcd(lon1: str, lat1: str, lon2: str, lat2: str) -> str:
    """SQL of the great-circle distance in degrees."""
    return f"degrees(acos(greatest(-1.0, least(1.0, sin(radians({lat1}))*sin(radians({lat2})) + cos(radians({lat1}))*cos(radians({lat2}))*cos(radians(({lon2})-({lon1})))))))"


def disc(radius: float) -> str:
    return f"disc AS (SELECT a.cell, b.cell AS nbr, CASE WHEN a.cell=b.cell THEN 0.0 ELSE {gcd('a.lon', 'a.lat', 'b.lon', 'b.lat')} END AS dist, b.area FROM g a JOIN g b ON a.cell=b.cell OR {gcd('a.lon', 'a.lat', 'b.lon', 'b.lat')} <= {radius})"


MINIMA = "m AS (SELECT f.time, f.cell, f.v AS value FROM f WHERE f.v > 5 AND NOT EXISTS (SELECT 1 FROM edge e JOIN f o ON o.time=f.time AND o.cell=e.nbr WHERE e.cell=f.cell AND o.v < f.v))"


def minima(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.nodes import extrema

    return extrema(field(spark, sf_dir), the_edges(spark), "v", where=F.col("value") > 5)
