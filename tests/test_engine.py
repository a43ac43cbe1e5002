"""Every SQL-expressible query against DuckDB, kernels against brute force, sources both ways."""

import struct

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tests.compare import DATA, database, same
from tidemark.functions import calendars, geo, units
from tidemark.functions import fields as fn
from tidemark.operators import blobs, blocking, climate, grid, metrics, nodes, profiles, stitch
from tidemark.plans import catalogue, fixtures
from tidemark.sources import netcdf3, node_files
from tidemark.sources import catalogue as files
from tidemark.streaming import accumulate as streaming


@pytest.fixture(scope="module")
def db():
    return database()


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_query_without_sql_runs(spark, name):
    assert catalogue.QUERIES[name](spark, DATA).count() > 0


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_sql(spark, db, name):
    same(catalogue.QUERIES[name](spark, DATA), db, catalogue.SQL[name])


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.fixture(scope="module")
def world(spark):
    g = grid.lat_lon_grid(spark, 6, 8).cache()
    return g, grid.edges(g).cache()


def random_field(spark, seed, times=4, cells=48, missing=0.1, top=30):
    rng = np.random.default_rng(seed)
    rows = [(t, c, float(rng.integers(0, top))) for t in range(times) for c in range(cells) if rng.random() > missing]
    return spark.createDataFrame(rows, "time int, cell int, v double"), {(t, c): v for t, c, v in rows}


def neighbours(world):
    g, e = world
    near = {}
    for a, b in e.collect():
        near.setdefault(a, set()).add(b)
    return near, {r.cell: (r.lon, r.lat) for r in g.collect()}


def distance(p, q):
    if p == q:
        return 0.0
    a, b = np.radians(p[1]), np.radians(q[1])
    return float(np.degrees(np.arccos(np.clip(np.sin(a) * np.sin(b) + np.cos(a) * np.cos(b) * np.cos(np.radians(q[0] - p[0])), -1, 1))))


def test_closed_contours(spark, world):
    f, v = random_field(spark, 1)
    near, at = neighbours(world)
    found = nodes.extrema(f, world[1], "v")
    got = set(map(tuple, nodes.closed_contour(found, f, *world, "v", 8.0, 70.0, 45.0).select("time", "cell").collect()))
    other = set(map(tuple, nodes.closed_contour(found, f, *world, "v", 8.0, 70.0, 45.0, keep_closed=False).select("time", "cell").collect()))
    want = set()
    for t, c in found.select("time", "cell").collect():
        reach, grow = {c}, True
        while grow:
            grow = {y for x in reach for y in near[x] if distance(at[c], at[y]) <= 45} - reach
            reach |= grow
        pivot = min((x for x in reach if (t, x) in v), key=lambda x: (v[t, x], round(distance(at[c], at[x]), 9), x))
        flood, grow = {pivot}, True
        while grow:  # a visited cell counts whatever its value; the flood goes on behind small changes
            grow = {y for x in flood if v[t, x] - v[t, pivot] < 8 for y in near[x] if (t, y) in v} - flood
            flood |= grow
        if all(distance(at[pivot], at[x]) <= 70 for x in flood):
            want.add((t, c))
    assert got == want and got | other == set(map(tuple, found.select("time", "cell").collect())) and not got & other


@pytest.mark.parametrize("sign", [1, -1])
def test_contour_delta_is_the_largest_change_inside(spark, world, sign):
    f, v = random_field(spark, 2, times=2)
    found = nodes.extrema(f, world[1], "v", largest=sign < 0)
    deltas = {(r.time, r.cell): r.delta for r in nodes.max_closed_contour_delta(found, f, *world, "v", 60.0, sign).collect()}
    values = {(r.time, r.cell): r.contour for r in nodes.contour_value(found, f, *world, "v", 60.0, sign).collect()}
    near, at = neighbours(world)
    assert deltas and all(sign * d >= 0 and values[k] == v[k] + d for k, d in deltas.items())
    for (t, c), delta in deltas.items():
        change = lambda x: sign * (v[t, x] - v[t, c])
        inside = {x for x in at if (t, x) in v and distance(at[c], at[x]) < 60}
        # cells inside by the least bound that reaches them; the least that reaches a cell outside
        best, ends = {c: 0.0}, float("inf")
        for bound in sorted({max(change(x), 0.0) for x in at if (t, x) in v}):
            flood, grow = {c}, True
            while grow:
                grow = {y for x in flood & inside for y in near[x] if (t, y) in v and change(y) <= bound} - flood
                flood |= grow
            if flood - inside:
                ends = min(ends, bound)
            for x in flood & inside:
                best.setdefault(x, bound)
        assert sign * delta == max(b for b in best.values() if b <= ends)


def test_merge_equal_is_greedy_by_cell(spark, world):
    f, _ = random_field(spark, 3, top=3, missing=0)
    found = nodes.extrema(f, world[1], "v")
    _, at = neighbours(world)
    left = nodes.merge_near(found, world[0], 50.0)
    got = set(map(tuple, nodes.merge_near(found, world[0], 50.0, merge_equal=True).select("time", "cell").collect()))
    want = {}
    for t, c, v in sorted(map(tuple, left.collect())):
        if not any(tt == t and vv == v and distance(at[c], at[x]) <= 50 for (tt, x), vv in want.items()):
            want[t, c] = v
    assert got == set(want)


def test_components_relabel_and_wrap(spark, world):
    f, v = random_field(spark, 4)
    near, _ = neighbours(world)
    got = {(r.time, r.cell): r.blob for r in blobs.components(f.where("v > 10"), world[1]).collect()}
    for (t, c), blob in got.items():
        flood, grow = {c}, True
        while grow:
            grow = {y for x in flood for y in near[x] if v.get((t, y), 0) > 10} - flood
            flood |= grow
        assert blob == min(flood)
    moved = f.where("v > 10").withColumn("cell", (F.floor(F.col("cell") / 8) * 8 + (F.col("cell") % 8 + 3) % 8).cast("int"))
    assert blobs.components(moved, world[1]).select("time", "blob").distinct().count() == len({(t, b) for (t, _), b in got.items()})


def test_stencils_of_known_fields(spark):
    g = grid.lat_lon_grid(spark, 36, 72)
    one = g.select(F.lit(0).alias("time"), "cell", F.lit(7.0).alias("c"), F.sin(F.radians("lat")).alias("s"))
    lap = {r.cell: r.laplacian for r in grid.laplacian(one, g, "c", 8, 10.0).collect()}
    assert len(lap) == 36 * 72 and max(map(abs, lap.values())) < 1e-6
    # the Laplacian of sin(lat) on the unit sphere is -2 sin(lat); cells off the ring add an error
    # that is first order in their offset, so the ring is wide against the grid
    rows = grid.laplacian(one, g, "s", 12, 30.0).join(g, "cell").where("abs(lat) BETWEEN 20 AND 60").toPandas()
    assert np.corrcoef(rows.laplacian, -2 * np.sin(np.radians(rows.lat)))[0, 1] > 0.97
    grad = grid.gradient_magnitude(one, g, "s", 12, 10.0).join(g, "cell").where("abs(lat) < 60").toPandas()
    assert np.allclose(grad.gradient * geo.EARTH_RADIUS, np.cos(np.radians(grad.lat)), atol=0.1)
    # solid rotation u = cos(lat): its curl is 2 sin(lat) / R, its divergence 0
    wind = g.select(F.lit(0).alias("time"), "cell", F.cos(F.radians("lat")).alias("u"), F.lit(0.0).alias("v"))
    cd = grid.curl_and_divergence(wind, g, "u", "v", 12, 10.0).join(g, "cell").where("abs(lat) < 60").toPandas()
    assert np.allclose(cd.divergence * geo.EARTH_RADIUS, 0, atol=0.1) and np.corrcoef(cd.curl, np.sin(np.radians(cd.lat)))[0, 1] > 0.97


@pytest.mark.parametrize("n, dist", [(8, 15.0), (12, 16.0), (5, 20.0)])
def test_a_constant_field_has_no_gradient(spark, n, dist):
    g = grid.lat_lon_grid(spark, 12, 24)
    one = g.select(F.lit(0).alias("time"), "cell", F.lit(100.0).alias("c"))
    rows = grid.gradient_magnitude(one, g, "c", n, dist).collect()
    assert len(rows) == 288 and max(r.gradient for r in rows) < 1e-15
    rows = grid.laplacian(one, g, "c", n, dist).collect()
    assert len(rows) == 288 and max(abs(r.laplacian) for r in rows) < 1e-9


def test_stencils_against_vectors(spark):
    """Every weight against vectors on the sphere: differences over the squares of their distances,
    directions at cell and centre, winds interpolated to the ring."""
    n, dist = 12, 16.0
    g = grid.lat_lon_grid(spark, 12, 24)
    cells = g.orderBy("cell").toPandas()
    lon, lat = np.radians(cells.lon.to_numpy()), np.radians(cells.lat.to_numpy())
    p = np.stack([np.cos(lat) * np.cos(lon), np.cos(lat) * np.sin(lon), np.sin(lat)], 1)
    east = np.stack([-np.sin(lon), np.cos(lon), 0 * lon], 1)
    north = np.cross(p, east)
    rng = np.random.default_rng(8)
    s, u, v = rng.normal(size=(3, 288))
    f = spark.createDataFrame([(0, i, float(s[i]), float(u[i]), float(v[i])) for i in range(288)], "time int, cell int, s double, u double, v double")
    d = np.radians(dist)
    lap, grad, curl, div = np.zeros(288), np.zeros((288, 3)), np.zeros(288), np.zeros(288)
    for i in range(288):
        turn = 2 * np.pi * np.arange(n) / n
        ring = np.cos(d) * p[i] + np.sin(d) * (np.sin(turn)[:, None] * east[i] + np.cos(turn)[:, None] * north[i])
        angle = np.round(np.degrees(np.arccos(np.clip(ring @ p.T, -1, 1))), 9)
        for k in sorted({int(row.argmin()) for row in angle} - {i}):
            far = np.arccos(p[i] @ p[k])
            here, there = (p[k] - np.cos(far) * p[i]) / np.sin(far), (np.cos(far) * p[k] - p[i]) / np.sin(far)
            lap[i] += 4 / n * (s[k] - s[i]) / far**2
            grad[i] += 2 / n / d / geo.EARTH_RADIUS * (s[k] - s[i]) * there
            wind = [u[j] * east[j] + v[j] * north[j] for j in (i, k)]
            share = [1 - d / far, d / far]
            div[i] += 2 / n / d / geo.EARTH_RADIUS * sum(c * (w @ r) for c, w, r in zip(share, wind, (here, there)))
            curl[i] += 2 / n / d / geo.EARTH_RADIUS * sum(c * (w @ np.cross(p[j], r)) for c, w, r, j in zip(share, wind, (here, there), (i, k)))
    rows = grid.laplacian(f, g, "s", n, dist).orderBy("cell").toPandas()
    assert np.allclose(rows.laplacian, lap, rtol=1e-9)
    rows = grid.gradient_magnitude(f, g, "s", n, dist).orderBy("cell").toPandas()
    want = np.hypot((grad * east).sum(1), (grad * north).sum(1))
    assert np.allclose(rows.gradient, want, rtol=1e-9)
    rows = grid.vector_dot_gradient(f, g, "u", "v", "s", n, dist).orderBy("cell").toPandas()
    assert np.allclose(rows.advection, u * (grad * east).sum(1) + v * (grad * north).sum(1), rtol=1e-8, atol=1e-16)
    rows = grid.curl_and_divergence(f, g, "u", "v", n, dist).orderBy("cell").toPandas()
    assert np.allclose(rows.divergence, div, rtol=1e-8, atol=1e-16) and np.allclose(rows.curl, curl, rtol=1e-8, atol=1e-16)


def test_permutation_test(spark):
    rng = np.random.default_rng(3)
    g = grid.lat_lon_grid(spark, 12, 24)
    x = rng.normal(size=288)
    rows = [(0, i, float(x[i]), float(x[i] + rng.normal()), float(rng.normal())) for i in range(288)]
    f = spark.createDataFrame(rows, "time int, cell int, x double, y double, z double")
    near, far = (metrics.permutation_test(f, "x", c, g, 500, 1).first() for c in "yz")
    w = {r.cell: np.cos(np.radians(r.lat)) for r in g.collect()}
    want = np.corrcoef([r[2] * w[r[1]] for r in rows], [r[3] * w[r[1]] for r in rows])[0, 1]
    assert near.correlation == pytest.approx(want) and near.p == 0 and far.p > 0.02
    assert metrics.permutation_test(f.where("false"), "x", "y", g, 10).first().p is None
    rmse = [metrics.permutation_test_rmse(f.withColumnRenamed("z", "w"), "x", c, g, 500, 1).first() for c in "yw"]
    want = [np.sqrt(np.mean([(w[r[1]] * (r[2] - r[k])) ** 2 for r in rows])) for k in (3, 4)]
    assert [r.rmse for r in rmse] == pytest.approx(want) and rmse[0].p == 0 and rmse[1].p > 0.02
    assert metrics.permutation_test_rmse(f.where("false"), "x", "y", g, 10).first().p is None


def test_replicates_sample_all_rows_alike(spark):
    """Each replicate has PERMUTED distinct rows, and no row is drawn more often than chance has it."""
    n, k = 20_000, 300
    rows = spark.range(n).selectExpr("xxhash64(id, 5) AS h", "CAST(id AS DOUBLE) AS x", "CAST(id AS DOUBLE) AS y")
    drawn = metrics.replicate_samples(rows, n, k).toPandas().sort_values(["replicate", "rank"]).groupby("replicate").head(metrics.PERMUTED)
    assert drawn.groupby("replicate").size().tolist() == [metrics.PERMUTED] * k
    assert not drawn.duplicated(["replicate", "x"]).any()
    often = np.bincount(drawn["x"].astype(int), minlength=n)
    expected = k * metrics.PERMUTED / n
    assert abs(often.mean() - expected) < 1e-9 and 0.9 < often.var() / expected < 1.1
    assert abs(np.corrcoef(np.arange(n), often)[0, 1]) < 0.03


def test_distance_join_equals_all_pairs(spark):
    rng = np.random.default_rng(5)
    a, b = ([(i, float(x), float(y)) for i, (x, y) in enumerate(zip(rng.uniform(0, 360, 150), np.degrees(np.arcsin(rng.uniform(-1, 1, 150)))))] for _ in range(2))
    a += [(900, 0.0, 90.0), (901, 359.9, 0.0)]
    b += [(900, 180.0, 89.0), (901, 0.05, 0.0)]
    for radius in (0.5, 7.0, 40.0, 100.0):
        got = {(r.i, r.k) for r in grid.within(spark.createDataFrame(a, "i int, lon double, lat double"), spark.createDataFrame(b, "k int, lon double, lat double"), radius).collect()}
        assert got == {(p[0], q[0]) for p in a for q in b if distance(p[1:], q[1:]) <= radius}


def test_priority_stitching(spark):
    rows = [(1, 0, 10.0, 0.0, 5.0), (1, 1, 12.0, 0.0, 9.0), (2, 0, 11.0, 0.0, 1.0), (2, 1, 16.0, 0.0, 1.0), (3, 0, 10.0, 0.0, 2.0)]
    n = spark.createDataFrame(rows, "step int, cand int, lon double, lat double, p double")
    got = {(r.step, r.cand): (r.next_step, r.next_cand) for r in stitch.prioritized_segments(n, 8.0, 1, "p", descending=True).collect()}
    assert got == {(1, 1): (2, 0), (1, 0): (2, 1), (2, 0): (3, 0)}


def test_smooth_velocity_of_a_straight_track(spark):
    t = spark.createDataFrame([(1, s, 0, 350.0 + 5 * s, 0.0) for s in range(6)] + [(2, 0, 0, 1.0, 1.0)], "track_id long, step int, cand int, lon double, lat double")
    got = stitch.smooth_velocity(t, 3600.0).toPandas()
    assert np.allclose(got[got.track_id == 1].u, np.radians(5) * geo.EARTH_RADIUS / 3600) and got[got.track_id == 2].u.isna().all()


def test_pointwise_edges(spark):
    df = spark.createDataFrame([(1.0, 0.0, None), (-1.0, 0.0, 2.0), (0.0, 0.0, 3.0)], "a double, b double, c double")
    r = df.select(fn.div("a", "b"), fn.minimum("a", "c"), fn.cond("a", "b", "c"), fn.allpos("a", "c"), fn.power(F.lit(2.0), "a")).collect()
    assert r[0][0] == float("inf") and r[1][0] == float("-inf") and np.isnan(r[2][0]) and [x[1] for x in r] == [None, -1.0, 0.0]
    assert [x[2] for x in r] == [0.0, 2.0, 3.0] and [x[3] for x in r] == [None, 0.0, 0.0] and r[1][4] == 0.5


def test_units_and_calendars(spark):
    one = spark.range(1)
    pick = lambda c: one.select(c).first()[0]
    assert pick(units.convert(F.lit(50.0), "degF", "degC")) == pytest.approx(10) and pick(units.convert(F.lit(1.0), "atm", "hPa")) == pytest.approx(1013.25)
    assert units.value_and_unit("5.5km") == (5.5, "km")
    with pytest.raises(ValueError):
        units.convert(F.lit(1.0), "K", "Pa")
    day = lambda y, m, d, cal: pick(calendars.day_number(F.lit(y), F.lit(m), F.lit(d), cal))
    assert day(2000, 3, 1, "standard") - day(2000, 2, 28, "standard") == 2 and day(2000, 3, 1, "noleap") - day(2000, 2, 28, "noleap") == 1
    assert day(1900, 3, 1, "julian") - day(1900, 2, 28, "julian") == 2 and day(1900, 3, 1, "standard") - day(1900, 2, 28, "standard") == 1
    assert day(2001, 3, 1, "360_day") - day(2001, 2, 30, "360_day") == 1 and day(1970, 1, 1, "standard") == 719162


def test_boxes_and_polygons(spark):
    one = spark.range(1)
    pick = lambda c: one.select(c).first()[0]
    assert pick(geo.in_box(F.lit(350.0), F.lit(0.0), 340, 20, -5, 5)) and not pick(geo.in_box(F.lit(30.0), F.lit(0.0), 340, 20, -5, 5))
    boxes = lambda a, b: pick(geo.boxes_overlap(tuple(map(F.lit, a)), tuple(map(F.lit, b))))
    assert boxes((350.0, 10.0, 0.0, 5.0), (5.0, 20.0, 4.0, 9.0)) and not boxes((350.0, 10.0, 0.0, 5.0), (15.0, 20.0, 4.0, 9.0))
    assert pick(geo.mid_lon(F.lit(350.0), F.lit(20.0))) == pytest.approx(5)
    cells = spark.createDataFrame([(1, c) for c in (0, 7, 8)] + [(2, 3)], "blob int, cell int")
    got = {r.blob: (r.minlon, r.maxlon) for r in blobs.bounding_boxes(cells, grid.lat_lon_grid(spark, 6, 8), ["blob"]).collect()}
    assert got == {1: (315.0, 0.0), 2: (135.0, 135.0)}


def test_harmonics_give_back_what_they_keep(spark):
    k = np.arange(24)
    x = 3 + 2 * np.cos(2 * np.pi * k / 24) + np.sin(4 * np.pi * k / 24)
    s = spark.createDataFrame([(1, int(i), float(v + 5 * np.cos(2 * np.pi * 9 * i / 24))) for i, v in enumerate(x)], "cell int, k int, y double")
    got = climate.harmonics(s, "y", "k", ["cell"], 3).orderBy("k").toPandas().smooth
    assert np.allclose(got, x)
    assert np.allclose(climate.harmonics(s, "y", "k", ["cell"], 13).orderBy("k").toPandas().smooth, s.orderBy("k").toPandas().y)


def test_approximate_quantile_is_near(spark):
    rows = spark.range(4000).select((F.col("id") % 3).cast("int").alias("cell"), (F.col("id") * 7919 % 4000).cast("double").alias("v"))
    exact = {r.cell: r.quantile for r in climate.quantile(rows, "v", 0.95).collect()}
    near = {r.cell: r.quantile for r in climate.quantile_approximate(rows, "v", 0.95).collect()}
    assert exact.keys() == near.keys() and all(abs(exact[c] - near[c]) <= 12 for c in exact)


def test_ridges(spark, world):
    f = world[0].select(F.lit(0).alias("time"), "cell", "i", "j", "lat", F.when(F.col("j") == 3, 10.0).otherwise(0.0).alias("v"))
    got = blobs.ridges(f, "v", 5.0, 1.0).collect()
    assert {r.cell // 8 for r in got} == {3} and all(r.spine and r.fall == pytest.approx((4 * 20 - 200) / 6) for r in got)


def test_persistence_on_hand(spark):
    rows = [(1, t, v) for t, v in enumerate([9, 9, 1, 9, 9, 9, None, 9, 9, 9, 9])]
    got = blobs.persistent(spark.createDataFrame(rows, "cell int, time int, x int"), F.col("x") > 5, 3)
    assert sorted(r.time for r in got.collect()) == [3, 4, 5, 7, 8, 9, 10]


def test_vorticity_of_solid_rotation(spark):
    g = grid.lat_lon_grid(spark, 36, 72)
    f = g.select(F.lit(0).alias("time"), "lon", "lat", (blocking.RADIUS * F.cos(F.radians("lat"))).alias("u"), F.lit(0.0).alias("v"))
    got = blocking.relative_vorticity(f, "u", "v", ["time"], 5.0).where("abs(lat) < 80").toPandas()
    assert np.allclose(got.vorticity, 2 * np.sin(np.radians(got.lat)), atol=0.02)


def test_profiles_on_hand(spark):
    df = spark.createDataFrame([([0.0, 9.0, 7.0, 3.0, 4.0],)], "p array<double>")
    r = df.select(profiles.first_where("p", "fallsbelow", 5.0, 10.0, 10.0), profiles.last_where("p", ">=", 4.0, 10.0), profiles.last_where("p", "=", "max", 10.0), profiles.value_at("p", 1.25), profiles.value_at("p", 99.0), profiles.first_where("p", "risesabove", 99.0, 10.0)).first()
    assert list(r) == [30.0, 40.0, 10.0, 8.5, 4.0, None]


def test_node_files(spark, tmp_path):
    track = spark.createDataFrame([(0, 0, 10.5, -5.0, 3.0), (0, 1, 11.0, -4.0, 2.0), (1, 0, 20.0, 8.0, 1.5)], "track_id long, h int, lon double, lat double, p double")
    track = track.select("track_id", (F.lit("2001-02-03").cast("timestamp_ntz") + F.make_dt_interval(hours=F.col("h") * 6)).alias("time"), F.col("h").alias("i"), "lon", "lat", "p")
    names = ["lon", "lat", "p"]
    node_files.write_tracks(track, str(tmp_path / "t"), names)
    got = node_files.read_tracks(spark, str(tmp_path / "t"), names).select("time", "i", *names)
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(got) == key(track.select("time", "i", *names))
    node_files.write_candidates(track, str(tmp_path / "c"), names)
    assert key(node_files.read_candidates(spark, str(tmp_path / "c"), names)) == key(track.select("time", "i", *names))
    node_files.write_tracks_csv(track, str(tmp_path / "v"), ["i", *names])
    assert key(node_files.read_tracks_csv(spark, str(tmp_path / "v"))) == key(track.select("track_id", "time", "i", *names))


def test_polygons_and_connectivity(spark, tmp_path, world):
    (tmp_path / "p.dat").write_text('# shapes\n"NA",3,0,10,10,0,0,10\n"B",4,350,10,10,350,-5,-5,5,5\n')
    got = node_files.read_polygons(spark, str(tmp_path / "p.dat"))
    hit = profiles.region_of(spark.createDataFrame([(1, 9.0, 2.0), (2, 355.0, 0.0), (3, 100.0, 0.0)], "id int, lon double, lat double"), got, ["id"])
    assert {r.id: r.region for r in hit.collect()} == {1: "NA", 2: "B", 3: None}
    node_files.write_connectivity(*world, str(tmp_path / "w"), "2,6,8")
    g, e = node_files.read_connectivity(spark, str(tmp_path / "w"))
    assert sorted(map(tuple, e.collect())) == sorted(map(tuple, world[1].collect())) and g.count() == 48


def test_netcdf(spark, tmp_path):
    name = lambda s: struct.pack(">i", len(s)) + s.encode() + bytes(-len(s) % 4)
    data = np.arange(12, dtype=">f4").reshape(2, 6)
    data[1, 2] = -999
    dims = struct.pack(">ii", 10, 2) + name("time") + struct.pack(">i", 0) + name("ncol") + struct.pack(">i", 6)
    fill = struct.pack(">ii", 12, 1) + name("_FillValue") + struct.pack(">iif", 5, 1, -999)

    def head(a, b):
        one = name("time") + struct.pack(">ii", 1, 0) + struct.pack(">ii", 0, 0) + struct.pack(">iii", 6, 8, a)
        two = name("u") + struct.pack(">iii", 2, 0, 1) + fill + struct.pack(">iii", 5, 24, b)
        return b"CDF\x01" + struct.pack(">i", 2) + dims + struct.pack(">ii", 0, 0) + struct.pack(">ii", 11, 2) + one + two

    at = len(head(0, 0))
    body = b"".join(struct.pack(">d", 6.0 * t) + data[t].tobytes() for t in range(2))
    (tmp_path / "a.nc").write_bytes(head(at, at + 8) + body)
    spark.dataSource.register(netcdf3.NetCDF3)
    got = spark.read.format("netcdf3").option("variables", "u").load(str(tmp_path / "a.nc")).orderBy("t", "cell").collect()
    assert [r.u for r in got] == [float(x) if x >= 0 else None for x in data.reshape(-1)] and got[-1].time == 6.0
    entries = files.build(spark.read.format("netcdf3").option("variables", "u").load(str(tmp_path / "a.nc")))
    near = files.near_time(entries.withColumn("time", F.col("time").cast("long")), spark.createDataFrame([(1, 4), (2, 40)], "id int, t long"), 3)
    assert [(r.id, r.t2) for r in near.collect()] == [(1, 6)]


def test_streams_give_what_batches_give(spark, tmp_path):
    events = fixtures.series(spark, DATA).withColumn("time", F.col("time").cast("timestamp")).where("cell < 6").dropDuplicates(["cell", "time"])
    events.select("cell", "time", "x").coalesce(1).write.parquet(str(tmp_path / "in"))
    source = lambda: spark.readStream.schema("cell int, time timestamp, x double").parquet(str(tmp_path / "in"))

    def drain(stream, name):
        q = stream.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
        return spark.table(name)

    got = drain(streaming.persistent(source(), "x", 50.0, 2), "runs")
    want = blobs.persistent(events, F.col("x") > 50, 2)
    assert sorted((r.cell, r.time) for r in got.collect()) == sorted((r.cell, r.time) for r in want.collect())
    got = {(r.cell, r.bucket): round(r.value, 6) for r in drain(streaming.accumulate(source(), "x", "1 day", "1 hour"), "days").collect()}
    want = {(r.cell, pd.Timestamp(r.bucket)): round(r.value, 6) for r in climate.accumulate(events, "x", "daily").collect()}
    assert got and all(want[k[0], pd.Timestamp(k[1])] == v for k, v in got.items())


def test_parcels_go_back_along_the_equator(spark):
    from tidemark.operators.parcels import back_trajectories

    g = grid.lat_lon_grid(spark, 18, 36)
    levels = spark.createDataFrame([(s, lev, 10.0 * (1 + lev / 1e5), 0.1) for s in (5, 4, 3) for lev in (2e4, 8e4)], "step int, lev double, u double, omega double")
    winds = g.select("cell").join(levels).select("step", "cell", "lev", "u", F.lit(0.0).alias("v"), "omega")
    start = spark.createDataFrame([(1, 2.0, 0.0, 5e4)], "id int, lon double, lat double, p double")
    got = back_trajectories(start, winds, g, [5, 4, 3], 3600.0, 15.0).orderBy("step", ascending=False).collect()
    step = np.degrees(15.0 * 3600 / geo.EARTH_RADIUS)
    assert [r.step for r in got] == [5, 4, 3] and got[1].lon == pytest.approx((2.0 - step) % 360) and got[1].p == pytest.approx(5e4 - 360)
    assert all(abs(r.lat) < 1e-9 for r in got)


def test_cf_time(spark):
    from tidemark.sources import cf_time

    df = spark.createDataFrame([(36.0, "2001-02-03_04:05:06")], "x double, s string")
    r = df.select(cf_time.decode("x", "hours since 1990-01-01 06:00").alias("t"), cf_time.decode_characters("s").alias("c")).withColumn("back", cf_time.encode("t", "days since 1990-01-01")).first()
    assert str(r.t) == "1990-01-02 18:00:00" and str(r.c) == "2001-02-03 04:05:06" and r.back == pytest.approx(1.75)
    with pytest.raises(ValueError):
        cf_time.decode("x", "fortnights since 1990-01-01")


def test_shapefile(spark, tmp_path):
    from tidemark.sources import shapes

    def polygon(number, parts):
        points = [p for part in parts for p in part]
        starts = np.cumsum([0, *(len(part) for part in parts[:-1])]).astype("<i4").tobytes()
        body = struct.pack("<i4dii", 5, 0, 0, 1, 1, len(parts), len(points)) + starts + np.array(points, "<f8").tobytes()
        return struct.pack(">ii", number, len(body) // 2) + body

    square = lambda x: [(x, 0), (x, 1), (x + 1, 1), (x + 1, 0), (x, 0)]
    records = polygon(1, [square(10.0)]) + polygon(2, [square(20.0), square(30.0)]) + struct.pack(">ii", 3, 2) + struct.pack("<i", 0)
    (tmp_path / "a.shp").write_bytes(struct.pack(">i", 9994) + bytes(96) + records)
    got = shapes.read_shapes(spark, str(tmp_path / "a.shp")).orderBy("number", "part").collect()
    assert [(r.number, r.part, r.corners[0].lon, len(r.corners)) for r in got] == [(1, 0, 10.0, 5), (2, 0, 20.0, 5), (2, 1, 30.0, 5)]
    (tmp_path / "b.shp").write_bytes(bytes(200))
    with pytest.raises(Exception, match="not a shapefile"):
        shapes.read_shapes(spark, str(tmp_path / "b.shp")).collect()
