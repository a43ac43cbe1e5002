"""Masks, shapes and maps: cases that their queries don't have."""

import math

import pytest

from tidemark.operators import grid as g
from tidemark.operators import maps, masks, profiles, shapes


def small_grid(spark):
    grid = g.lat_lon_grid(spark, 6, 12)
    return grid, g.edges(grid)


def field_of(spark, values, step=1):
    return spark.createDataFrame([(step, c, float(v)) for c, v in values.items() if v is not None], "step int, cell int, x double")


def test_contour_cells_by_hand(spark):
    """A bowl of 2 x 2 cells whose rim is missing on one side; the way round it is too far."""
    grid, edge = small_grid(spark)
    values = {c: 9.0 for c in range(72)}
    values |= {24: 0.0, 25: 1.0, 36: 1.0, 37: 2.0, 26: None, 30: 0.0}
    nodes = spark.createDataFrame([(1, 0, 2.0, -14.0), (2, 1, 2.0, -14.0)], "step int, cand int, lon double, lat double")
    cells = lambda **k: sorted(r.cell for r in masks.contour_cells(nodes, field_of(spark, values), grid, edge, "x", 5.0, 60.0, **k).collect())
    assert cells() == [24, 25, 36, 37]
    assert cells(search=40.0) == [24, 25, 36, 37]
    low = {**values, 24: None}
    assert masks.contour_cells(nodes, field_of(spark, low), grid, edge, "x", 5.0, 60.0).collect() == []
    high = {c: -v if v is not None else None for c, v in values.items()}
    assert sorted(r.cell for r in masks.contour_cells(nodes, field_of(spark, high), grid, edge, "x", -5.0, 60.0).collect()) == [24, 25, 36, 37]


def test_nearby_blobs_end_at_the_greatest_distance(spark):
    grid, edge = small_grid(spark)
    nodes = spark.createDataFrame([(1, 0, 0.0, -15.0)], "step int, cand int, lon double, lat double")
    row = {c: 1.0 for c in range(24, 36)}  # a ring of cells at latitude -15
    near = lambda most: sorted(r.cell for r in masks.nearby_blob_cells(nodes, field_of(spark, row), grid, edge, "x", 10.0, ">", 0.5, most).collect())
    assert near(180.0) == list(range(24, 36))
    assert near(65.0) == [24, 25, 26, 34, 35]
    # a blob beyond a gap is only taken if one of its own cells is near enough
    assert sorted(r.cell for r in masks.nearby_blob_cells(nodes, field_of(spark, {24: 1.0, 26: 1.0}), grid, edge, "x", 10.0, ">", 0.5).collect()) == [24]
    with pytest.raises(ValueError):
        masks.nearby_blob_cells(nodes, field_of(spark, row), grid, edge, "x", 10.0, ">", 0.5, 5.0)


def ring(*corners):
    return [{"lon": float(a), "lat": float(b)} for a, b in corners]


def test_shapes_with_holes_date_line_and_tiles_of_any_size(spark):
    rows = [
        (1, ring((350, -10), (20, -10), (20, 30), (350, 30))),
        (1, ring((355, 0), (5, 0), (5, 10), (355, 10))),  # its hole
        (2, ring((-30, 40), (-10, 40), (-20, 70))),
        (3, ring((100, 0), (140, 0), (140, 40), (120, 10), (100, 40))),
        (4, ring((0, 0), (1, 1))),
    ]
    known = spark.createDataFrame(rows, "shape int, corners array<struct<lon:double,lat:double>>")
    points = {1: (0, -5), 2: (0.5, 5), 3: (359.5, 25), 4: (340, 50), 5: (-20, 69), 6: (120, 20), 7: (105, 20), 8: (719, -5), 9: (120, 9.5), 10: (200, 0), 11: (340, 71)}
    spots = spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in points.items()] + [(12, None, 1.0)], "k int, lon double, lat double")
    want = [(1, 1), (3, 1), (4, 2), (5, 2), (7, 3), (8, 1), (9, 3)]
    for tile in (0.7, 2.0, 37.0, 400.0):
        assert sorted(map(tuple, shapes.points_in_shapes(spots, known, ["k"], tile).collect())) == want
    first = {r.k: r.shape for r in shapes.first_shape(spots, known.unionAll(known.where("shape = 2").selectExpr("shape - 2", "corners")), ["k"]).collect()}
    assert first[5] == 0 and first[1] == 1 and first[12] is None and len(first) == 12
    assert shapes.points_in_shapes(spots, known.limit(0), ["k"]).collect() == []


def test_many_regions_meet_points_by_tile(spark):
    """More regions than go to all tasks give the names that few of them give."""
    n = 10_100
    known = spark.range(n).selectExpr("CAST(id AS INT) AS number", "concat('r', id) AS name", "(id % 180) * 2.0 + 0.1 AS x", "CAST(id / 180 AS INT) * 3.0 - 85.05 AS y")
    corners = "array(named_struct('lon', x, 'lat', y), named_struct('lon', x + 3, 'lat', y), named_struct('lon', x + 3, 'lat', y + 3.5), named_struct('lon', x, 'lat', y + 3.5)) AS corners"
    known = known.selectExpr("number", "name", corners)
    spots = spark.range(300).selectExpr("id AS k", "(id * 37 % 360) + 0.5 AS lon", "(id * 53 % 170) - 84.3 AS lat")
    many = {r.k: r.region for r in profiles.region_of(spots, known, ["k"]).collect()}
    few = {r.k: r.region for r in profiles.region_of(spots, known.where("number < 9000"), ["k"]).collect()}
    assert {k: v for k, v in many.items() if few[k]} == {k: v for k, v in few.items() if v} and sum(v is not None for v in few.values()) > 200


def test_nearest_map_far_equal_and_none(spark):
    targets = spark.createDataFrame([(1, 10.0, 0.0), (2, 190.0, 0.0), (3, 10.0, 0.0), (4, None, 0.0)], "t int, lon double, lat double")
    points = spark.createDataFrame([(1, 10.0, 0.0), (2, 100.0, 89.0), (3, 185.0, -80.0), (4, 280.0, 1.0), (5, None, None)], "p int, lon double, lat double")
    got = {r.p: (r.t, round(r.dist, 6)) for r in maps.nearest_map(points, targets, ["p"], "t", start=0.5).collect()}
    assert set(got) == {1, 2, 3, 4} and got[1] == (1, 0.0) and got[3][0] == 2 and got[2][0] == 1
    assert {r.p for r in maps.nearest_map(points, targets, ["p"], "t", max_dist=30.0, start=0.5).collect()} == {1}
    assert maps.nearest_map(points, targets.limit(0), ["p"], "t").collect() == []


def test_map_file_round_trip_and_report(spark, tmp_path):
    weights = spark.createDataFrame([(1, 3, 0.25), (1, 1, 0.75), (4, 2, 1 / 3)], "row int, col int, s double")
    maps.write_map(weights, f"file://{tmp_path}/map")
    assert sorted(map(tuple, maps.read_map(spark, f"file://{tmp_path}/map").collect())) == sorted(map(tuple, weights.collect()))
    assert tuple(maps.map_report(weights, 5).first()) == (3, 2, 3, 1, 0.25, 0.75)
    field = spark.createDataFrame([(1, 0, 8.0), (1, 2, 4.0), (2, 0, 8.0), (2, 1, 3.0)], "time int, cell int, v double")
    value = lambda **k: sorted((r.time, r.cell, r.v) for r in maps.apply_map(field, weights, "v", **k).collect())
    assert value() == [(1, 0, 7.0), (2, 0, None), (2, 3, 1.0)]
    assert value(renormalise=True) == [(1, 0, 7.0), (2, 0, 8.0), (2, 3, 1.0)]


def test_bilinear_rows_sum_to_one_beyond_the_last_latitude(spark):
    targets = spark.createDataFrame([(k, k * 36.7, -90.0 + k * 20) for k in range(10)], "cell int, lon double, lat double")
    rows = maps.bilinear_weights(targets, 24, 12, -82.5, 15.0)
    assert all(math.isclose(r.s, 1.0) for r in rows.groupBy("row").sum("s").toDF("row", "s").collect())


def test_bilinear_points_on_a_row_of_cells_have_one_row(spark):
    """Rows of a grid 7 times finer lie at no round latitudes; the points on them do."""
    lats = [-90 + (j + 0.5) * 15 / 7 for j in range(3, 84, 7)]
    targets = spark.createDataFrame([(k, 0.0, round(v, 2)) for k, v in enumerate(lats)], "cell int, lon double, lat double")
    rows = maps.bilinear_weights(targets, 168, 84, -90.0 + 7.5 / 7, 15.0 / 7)
    assert all(math.isclose(a, round(a, 2)) for a in lats)
    assert sorted((r.row, r.col, r.s) for r in rows.collect()) == [(k + 1, j * 168 + 1, 1.0) for k, j in enumerate(range(3, 84, 7))]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_points_on_an_edge_come_along_within_a_margin(spark):
    """The sides of a square and of its hole, a point a little off, and a side on longitude 0."""
    known = spark.createDataFrame([(1, ring((0, 0), (10, 0), (10, 10), (0, 10))), (1, ring((4, 4), (6, 4), (6, 6), (4, 6)))], "shape int, corners array<struct<lon:double,lat:double>>")
    points = {1: (0, 5), 2: (10, 5), 3: (5, 4), 4: (5, 6), 5: (3, 3), 6: (10 + 5e-10, 5), 7: (10 + 1e-5, 5), 8: (5, 5), 9: (0, 0), 10: (360 - 5e-10, 5), 11: (5, -5e-10)}
    spots = spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in points.items()], "k int, lon double, lat double")
    for tile in (2.0, 5.0):
        got = {r.k: r.on_edge for r in shapes.points_in_shapes(spots, known, ["k"], tile, margin=1e-9).collect()}
        assert got == {1: True, 2: True, 3: True, 4: True, 5: False, 6: True, 9: True, 10: True, 11: True}
    with pytest.raises(ValueError):
        shapes.points_in_shapes(spots, known, ["k"], margin=0.1)


def test_suppliers_on_an_edge_as_in_sql(spark):
    """Points on the tips and sides of a supplier's rhombus and its hole, as its SQL has them."""
    from tests.compare import DATA, database
    from tidemark.plans import map_queries as mq

    db = database()
    at = "SELECT shape*1000+j*10+i AS k, cx+x*r*1.7*p AS lon, cy+y*r*p AS lat FROM sh, (VALUES (0, 1.0, 0.0), (1, 0.5, 0.5), (2, -0.25, 0.75), (3, 0.0, -1.0)) v(i, x, y), (VALUES (0, 0.4), (1, 1.0)) w(j, p) WHERE cx BETWEEN 40 AND 320"
    want = f"WITH {mq._IN_SHAPES}, pk AS ({at}) SELECT k, shape FROM (SELECT k, shape, {mq._taxi('lon', 'lat')} AS t FROM pk, sh) WHERE t < 1 AND t >= 0.4"
    spots = spark.createDataFrame(db.sql(f"WITH {mq._IN_SHAPES} {at}").fetchall(), "k long, lon double, lat double")
    assert sorted(map(tuple, mq.held(spark, DATA, spots, "k").collect())) == sorted(db.sql(want).fetchall())


def test_tiles_of_few_shapes_are_not_broadcast(spark):
    known = spark.range(3).selectExpr("CAST(id AS INT) AS shape", "array(named_struct('lon', 0D, 'lat', 0D), named_struct('lon', 9D, 'lat', 0D), named_struct('lon', 9D, 'lat', 9D)) AS corners")
    spots = spark.range(30).selectExpr("id AS k", "CAST(id AS DOUBLE) AS lon", "CAST(id AS DOUBLE) AS lat")
    assert "Broadcast" not in plan_of(shapes.first_shape(spots, known, ["k"]))


def test_members_of_few_shapes_meet_the_field_by_merge(spark):
    from tidemark.operators import metrics

    grid, _ = small_grid(spark)
    members = spark.range(2).selectExpr("CAST(id AS INT) AS shape", "explode(sequence(0, 40)) AS cell")
    made = metrics.reduce_polygons(field_of(spark, {c: c for c in range(72)}).withColumnRenamed("step", "time"), "x", members, grid)
    assert "Broadcast" not in plan_of(made)
    assert sorted((r.shape, r["sum"] > 0, r["median"]) for r in made.collect()) == [(0, True, 20.0), (1, True, 20.0)]


def test_mask_shapes_has_no_broadcast(spark):
    from tidemark.plans import map_queries as mq

    assert "Broadcast" not in plan_of(mq.mask_shapes(spark, "/root/testdata/sf0.001"))


def test_far_nearest_is_that_of_all_pairs(spark):
    """Targets on one side of the sphere, points everywhere: most have none within three spacings."""
    from tidemark.functions import geo

    targets = spark.range(400).selectExpr("CAST(id AS INT) AS t", "id * 7919 % 36000 / 100D AS lon", "id * 104729 % 3000 / 100D + 40 AS lat")
    targets = targets.unionAll(targets.selectExpr("t + 1000 AS t", "lon", "lat"))
    points = spark.range(600).selectExpr("CAST(id AS INT) AS p", "id * 6131 % 36000 / 100D - 180 AS lon", "id * 10007 % 18001 / 100D - 90 AS lat")
    pairs = points.crossJoin(targets.toDF("t", "lon2", "lat2")).withColumn("d", geo.great_circle("lon", "lat", "lon2", "lat2"))
    want = {r.p: r.t for r in pairs.selectExpr("p", "struct(round(d, 9) AS d, t) AS b").groupBy("p").agg({"b": "min"}).toDF("p", "b").selectExpr("p", "b.t AS t").collect()}
    assert {r.p: r.t for r in maps.nearest_map(points, targets, ["p"], "t").collect()} == want and len(want) == 600
    near = {r.p for r in maps.nearest_map(points, targets, ["p"], "t", max_dist=50.0).collect()}
    assert near == {r.p for r in pairs.where("d <= 50").select("p").distinct().collect()}


def test_far_places_are_held_against_few_targets(spark):
    """A place meets the targets of the tiles that may be nearest, not all of its hemisphere."""
    goals = spark.range(5000).selectExpr("CAST(id AS INT) AS t", "id * 7919 % 36000 / 100D AS lon", "id * 104729 % 6000 / 100D AS lat")
    left = spark.range(100).selectExpr("id * 3.6D AS lon", "-30D AS lat")
    assert 0 < maps._far_pairs(left, goals, "t", 180.0).count() < 100 * 500


def test_union_of_floods_is_that_of_all_floods(spark):
    """Pockets that a first node's flood leaves out and a later one's takes; nodes in many blocks."""
    grid = g.lat_lon_grid(spark, 12, 24)
    edge = g.edges(grid)
    field = spark.range(288 * 2).selectExpr("CAST(id / 288 AS INT) AS step", "CAST(id % 288 AS INT) AS cell", "CAST(id * 7919 % 101 AS DOUBLE) AS x")
    nodes = spark.range(80).selectExpr("CAST(id % 2 AS INT) AS step", "CAST(id AS INT) AS cand", "id * 37 % 360 + 0.25D AS lon", "id * 13 % 150 - 75 + 0.125D AS lat")
    for f, args in ((masks.contour_cells, ("x", 60.0, 50.0, 20.0)), (masks.nearby_blob_cells, ("x", 20.0, ">=", 45.0, 60.0))):
        pairs = f(nodes, field, grid, edge, *args)
        assert "Generate explode" not in plan_of(pairs).split("MapInArrow")[0]
        want = {tuple(r) for r in pairs.select("step", "cell").distinct().collect()}
        assert want and {tuple(r) for r in f(nodes, field, grid, edge, *args, union=True).collect()} == want


def test_contained_blobs_shuffle_no_pairs(spark):
    from tidemark.operators import metrics

    columns = "time int, blob int, area double, minlat double, maxlat double, minlon double, maxlon double"
    tracked = spark.createDataFrame([(1, 1, 5.0, 0.0, 9.0, 0.0, 9.0), (1, 2, 5.0, 0.0, 9.0, 0.0, 9.0), (1, 3, 6.0, 0.0, 9.0, 355.0, 9.0), (2, 4, 7.0, 0.0, 9.0, 0.0, 9.0)], columns)
    single = spark.createDataFrame([(1, 1, 5.0, 1.0, 2.0, 1.0, 2.0), (1, 2, 1.0, 1.0, 2.0, 358.0, 2.0), (1, 3, 1.0, 1.0, 12.0, 1.0, 2.0), (3, 4, 7.0, 1.0, 2.0, 1.0, 2.0), (None, 5, 7.0, 1.0, 2.0, 1.0, 2.0)], columns)
    made = metrics.merge_contained(tracked, single)
    assert sorted(map(tuple, made.collect()), key=repr) == sorted([(1, 1, 1), (1, 1, 2), (1, 2, 3), (1, 3, None), (3, 4, None), (None, 5, None)], key=repr)
    # both joins that make pairs end the plan: nothing is dealt out after them
    assert "Exchange" not in plan_of(made).split("Join")[0]
