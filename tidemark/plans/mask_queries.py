"""Queries of masks round nodes, on a grid that grows with the tables."""

from __future__ import annotations

from ..operators import grid as g
from ..operators import masks as m
from . import fixtures as x

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def inputs(spark, sf_dir):
    grid = x.fine_grid(spark, sf_dir)
    return x.fine_nodes(spark, sf_dir), x.fine_field(spark, sf_dir), grid, g.edges(grid)


_D = x.gcd("n.lon", "n.lat", "g.lon", "g.lat")
_NEAREST = f"""ang AS (SELECT n.step, n.cand, g.cell, {_D} AS dist FROM n, g),
c0 AS (SELECT step, cand, arg_min(cell, (round(dist, 9), cell)) AS centre FROM ang GROUP BY 1, 2)"""
_REACHED = """r(step, cand, cell) AS (SELECT step, cand, cell FROM ok WHERE seed
 UNION SELECT r.step, r.cand, e.nbr FROM r JOIN edge e ON e.cell=r.cell JOIN ok ON ok.step=r.step AND ok.cand=r.cand AND ok.cell=e.nbr)"""
_CONTOUR = "WITH RECURSIVE " + ", ".join((x.FINE, _NEAREST, f"""o AS (SELECT c.step, c.cand, arg_min(f.cell, (f.x, round({x.gcd('a.lon', 'a.lat', 'b.lon', 'b.lat')}, 9)*CAST(a.cell<>b.cell AS INTEGER), f.cell)) AS origin, min(f.x) AS x0
 FROM c0 c JOIN g a ON a.cell=c.centre JOIN g b ON a.cell=b.cell OR {x.gcd('a.lon', 'a.lat', 'b.lon', 'b.lat')} <= 16 JOIN sf f ON f.step=c.step AND f.cell=b.cell GROUP BY 1, 2),
ok AS (SELECT g.step, g.cand, g.cell, g.cell=o.origin AS seed FROM ang g JOIN o USING (step, cand) JOIN sf f ON f.step=g.step AND f.cell=g.cell WHERE g.dist <= 35 AND f.x-o.x0 < 90)""", _REACHED))


@query(_CONTOUR + " SELECT step, cand, cell FROM r")
def contour_cells(spark, sf_dir):
    return m.contour_cells(*inputs(spark, sf_dir), "x", 90.0, 35.0, 16.0)


@query(_CONTOUR + " SELECT sf.step, sf.cell, CASE WHEN (sf.step, sf.cell) IN (SELECT (step, cell) FROM r) THEN x ELSE -1.0 END AS x FROM sf")
def mask_contour(spark, sf_dir):
    nodes, field, grid, edge = inputs(spark, sf_dir)
    return m.apply_mask(field, m.contour_cells(nodes, field, grid, edge, "x", 90.0, 35.0, 16.0, union=True), "x", fill=-1.0)


_BLOBS = "WITH RECURSIVE " + ", ".join((x.FINE, _NEAREST, """ok AS (SELECT a.step, a.cand, a.cell, a.dist <= 20 OR a.cell=c.centre AS seed FROM ang a JOIN c0 c USING (step, cand)
 JOIN sf f ON f.step=a.step AND f.cell=a.cell WHERE f.x >= 60 AND (a.dist <= 50 OR a.cell=c.centre))""", _REACHED))


@query(_BLOBS + " SELECT step, cand, cell FROM r")
def nearby_blob_cells(spark, sf_dir):
    return m.nearby_blob_cells(*inputs(spark, sf_dir), "x", 20.0, ">=", 60.0, 50.0)


@query(_BLOBS + " SELECT sf.step, sf.cell, CASE WHEN (sf.step, sf.cell) IN (SELECT (step, cell) FROM r) THEN NULL ELSE x END AS x FROM sf")
def mask_nearbyblobs(spark, sf_dir):
    nodes, field, grid, edge = inputs(spark, sf_dir)
    return m.apply_mask(field, m.nearby_blob_cells(nodes, field, grid, edge, "x", 20.0, ">=", 60.0, 50.0, union=True), "x", invert=True)
