"""Meshes, stored climatologies, vertical means and text tables beside what the queries test."""

import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import climate, climate_state, mesh, pv
from tidemark.sources import tables_text


def test_areas_cover_the_sphere_and_adjacency_is_mutual(spark):
    faces, nodes = mesh.cubed_sphere(spark, 4)
    cells = mesh.mesh_cells(faces, nodes)
    assert cells.agg(F.sum("area")).first()[0] == pytest.approx(4 * math.pi)
    assert cells.agg(F.min("area")).first()[0] > 0
    edge = mesh.mesh_edges(faces)
    assert edge.groupBy("cell").count().where("count <> 4").isEmpty()
    assert edge.join(edge.toDF("nbr", "cell"), ["cell", "nbr"], "left_anti").isEmpty()


def test_polygons_of_any_size_with_repeated_corners(spark):
    """An octant as a triangle, a cap's hexagon, and a triangle given as a quadrilateral."""
    hexagon = [(60.0 * k, 80.0) for k in range(6)]
    shapes = {0: [(0, 0), (90, 0), (0, 90)], 1: hexagon, 2: [(90, 0), (180, 0), (0, 90), (0, 90)]}
    rows = [(f, k, float(a), float(b)) for f, corners in shapes.items() for k, (a, b) in enumerate(corners)]
    faces, nodes = mesh.mesh_of_corners(spark.createDataFrame(rows, "face long, k int, lon double, lat double"))
    area = {r.cell: r.area for r in mesh.mesh_cells(faces, nodes).collect()}
    assert area[0] == pytest.approx(math.pi / 2) and area[2] == pytest.approx(math.pi / 2)
    p = [np.array([math.cos(math.radians(a)) * math.cos(math.radians(b)), math.sin(math.radians(a)) * math.cos(math.radians(b)), math.sin(math.radians(b))]) for a, b in hexagon]
    inner = 0.0
    for k in range(6):
        u, v = np.cross(p[k], p[k - 1]), np.cross(p[k], p[(k + 1) % 6])
        inner += math.acos(u @ v / np.linalg.norm(u) / np.linalg.norm(v))
    assert area[1] == pytest.approx(inner - 4 * math.pi)
    assert {tuple(r) for r in mesh.mesh_edges(faces).collect()} == {(0, 2), (2, 0)}
    assert nodes.count() == 10


def classic_file(dims: dict, variables: dict) -> bytes:
    """A NetCDF classic file of double variables name -> (dimensions, array), without attributes."""
    name = lambda t: struct.pack(">i", len(t)) + t.encode() + b"\0" * (-len(t) % 4)
    none = struct.pack(">ii", 0, 0)
    head = b"CDF\x01" + struct.pack(">i", 0) + struct.pack(">ii", 10, len(dims)) + b"".join(name(k) + struct.pack(">i", n) for k, n in dims.items()) + none

    def table(at: int) -> bytes:
        out = struct.pack(">ii", 11, len(variables))
        for k, (own, data) in variables.items():
            out += name(k) + struct.pack(">i", len(own)) + b"".join(struct.pack(">i", list(dims).index(d)) for d in own) + none + struct.pack(">iii", 6, 8 * data.size, at)
            at += 8 * data.size
        return out

    return head + table(len(head) + len(table(0))) + b"".join(data.astype(">f8").tobytes() for _, data in variables.values())


def test_scrip_file(spark, tmp_path):
    lons, lats = np.array([[0, 90, 0], [90, 180, 0]], float), np.array([[0, 0, 90], [0, 0, 90]], float)
    own = ["grid_size", "grid_corners"]
    (tmp_path / "mesh.nc").write_bytes(classic_file({"grid_size": 2, "grid_corners": 3}, {"grid_corner_lon": (own, lons), "grid_corner_lat": (own, lats)}))
    faces, nodes = mesh.read_scrip(spark, str(tmp_path / "mesh.nc"))
    assert nodes.count() == 4 and faces.count() == 6
    assert {tuple(r) for r in mesh.mesh_edges(faces).collect()} == {(0, 1), (1, 0)}


def test_spectral_order_must_be_known(spark):
    with pytest.raises(ValueError):
        mesh.spectral_nodes(*mesh.cubed_sphere(spark, 2), 9)


def test_store_replaces_a_batch_and_merges(spark, tmp_path):
    rows = [(k % 3, f"2001-0{1 + k % 9}-10 00:00:00", float((k * 7) % 11) if k % 5 else None) for k in range(60)]
    field = spark.createDataFrame(rows, "cell int, t string, x double").select("cell", F.to_timestamp("t").alias("time"), "x")
    path = f"file://{tmp_path}/store"
    first, second = field.where("cell < 2"), field.where("cell >= 1")
    climate_state.add_to_store(climate_state.climatology_state(second, "x", "monthly"), path, "a")
    climate_state.add_to_store(climate_state.climatology_state(first, "x", "monthly"), path, "a")
    climate_state.add_to_store(climate_state.climatology_state(field.where("cell = 2"), "x", "monthly"), path, "b")
    got = climate_state.finish_state(climate_state.stored(spark, path)).select("cell", "idx", "mean", "meansq", "stddev", "min", "max", "count")
    want = climate.climatology(field, "x", "monthly").select(got.columns)
    close = lambda df: {(r.cell, r.idx): [pytest.approx(v) if v is not None else None for v in r[2:]] for r in df.collect()}
    assert close(got) == {k: v for k, v in close(want).items()} and got.count() == want.count()
    assert climate_state.stored(spark, path, without=["b"]).where("cell = 2").isEmpty()


def test_vertical_mean_cuts_layers(spark):
    """A linear profile has its middle as the mean, whichever levels it is given on."""
    rows = [(1, float(p), p * 2.0 + 5) for p in (10000, 20000, 30000, 60000)] + [(2, 20000.0, 1.0), (2, 40000.0, 3.0)] + [(3, 15000.0, 4.0), (3, 30000.0, None), (3, 50000.0, 4.0)]
    got = {r.k: r["mean"] for r in pv.vertical_mean(spark.createDataFrame(rows, "k int, lev double, v double"), "v", ["k"], 15000, 50000).collect()}
    assert got == {1: pytest.approx(65005.0), 2: None, 3: pytest.approx(4.0)}


def test_text_tables_round_trip(spark, tmp_path):
    rows = [(7, "2001-01-02", 10.5, 3.2e12, None), (7, "2001-01-01", -4.25, 1e11, 2.0), (9, "2001-01-01", 0.125, 5e10, 1.0)]
    stats = spark.createDataFrame(rows, "object_id long, time string, centlat double, area double, sumv double")
    tables_text.write_blob_statistics(stats, f"file://{tmp_path}/blobs")
    assert sorted(p.name for p in (tmp_path / "blobs").glob("object=*")) == ["object=7", "object=9"]
    files = list((tmp_path / "blobs" / "object=7").glob("*.txt"))
    assert len(files) == 1 and files[0].read_text().splitlines()[:2] == ["#blob\tseq\ttime\tcentlat\tarea\tsumv", '7\t1\t"2001-01-01"\t-4.250000\t1.000000e+11\t2.000000e+00']
    back = tables_text.read_blob_statistics(spark, f"file://{tmp_path}/blobs", ["centlat", "area", "sumv"])
    assert sorted(map(tuple, back.drop("seq").collect()), key=repr) == sorted(rows, key=repr)
    values = spark.createDataFrame([(1, "2001", 0.5), (2, "2001", None), (1, "2000", 2.0)], "shape int, time string, mean double")
    tables_text.write_shape_table(values, f"file://{tmp_path}/shapes", "mean")
    got = {(r.variable, r.time, r["shape"], r["value"]) for r in tables_text.read_shape_table(spark, f"file://{tmp_path}/shapes").collect()}
    assert got == {("mean", "2001", 1, 0.5), ("mean", "2001", 2, None), ("mean", "2000", 1, 2.0)}


def test_axis_names():
    from tidemark.sources.netcdf3 import axis_names

    assert axis_names(["time", "XLAT", "XLONG", "T"]) == ("XLAT", "XLONG")
    assert axis_names(["latitude", "lat", "lon", "rlon"]) == ("lat", "lon")
    assert axis_names(["rlat", "lon"], latitude="rlat") == ("rlat", "lon")
    with pytest.raises(ValueError):
        axis_names(["lat"])


def test_spectral_nodes_and_edges_are_not_joined_by_broadcast(spark):
    """A few faces become many nodes; their number isn't in Spark's estimate."""
    placed = mesh.spectral_nodes(*mesh.cubed_sphere(spark, 2), 3)
    for df in (placed, mesh.spectral_edges(placed)):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
