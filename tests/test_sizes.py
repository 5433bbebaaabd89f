"""What must not grow: rows by the driver, rows per pair, tasks that hold all."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cloudloom.functions import quantiles
from cloudloom.operators import bridges, fitting, graph, holes, mesh, parts, points, registration, repair, scene, search, series, shapes, textures
from cloudloom.plans import surface_queries


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def cloud(spark, n, seed=3):
    rng = np.random.default_rng(seed)
    return spark.createDataFrame([(k, *map(float, p)) for k, p in enumerate(rng.random((n, 3)) * 4)], "pid long, x double, y double, z double")


@pytest.mark.parametrize(("inclusive", "batch"), [(True, 10_000), (False, 7)])
def test_pairs_of_a_dense_cell_are_made_in_blocks(spark, monkeypatch, inclusive, batch):
    monkeypatch.setattr(points, "BLOCK_POINTS", 16)
    monkeypatch.setattr(points, "MEETING", 500)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        p = spark.range(300).select(F.col("id").alias("pid"), *[(F.col("id") * m % 101 % 9 / 16.0 - 0.25).alias(c) for c, m in zip("xyz", (7, 13, 29), strict=True)])
        odd = spark.createDataFrame([(-1, float("nan"), 0.0, 0.0), (-2, None, 0.0, 0.0), (-3, float("inf"), 0.0, 0.0), (None, 0.0, 0.0, 0.0)], "pid long, x double, y double, z double")
        left = p.where("pid % 3 > 0").select(F.struct("pid").alias("pid"), "x", "y", "z")
        made = points.radius_pairs(left, p.unionByName(odd), 0.25, inclusive)
        got = sorted((r["pid"]["pid"], -9 if r["nid"] is None else r["nid"], r["d2"]) for r in made.collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    at = {r["pid"]: np.array(r[1:]) for r in p.collect()}
    d2 = {(i, j): float(((at[i] - y) ** 2).sum()) for i in at if i % 3 for j, y in [*at.items(), (-9, np.zeros(3))]}
    assert got == sorted((i, j, d) for (i, j), d in d2.items() if d < 1 / 16 or inclusive and d == 1 / 16)
    assert "Broadcast" not in plan(made) and len(got) > 1_000


def test_pairs_keep_few_bytes_in_files(spark, tmp_path):
    p = cloud(spark, 2_000).withColumns({c: F.col(c) / 8 for c in "xyz"})
    pairs = points.radius_pairs(p, p, 0.25)
    pairs.withColumn("d2", F.round("d2", 6)).coalesce(1).write.parquet(str(tmp_path / "pairs"))
    files = list((tmp_path / "pairs").glob("*.parquet"))
    assert sum(f.stat().st_size for f in files) < 6 * pairs.count()


@pytest.mark.parametrize("few", [0, 64])
def test_moments_of_neighbours_are_summed_in_their_blocks(spark, monkeypatch, few):
    monkeypatch.setattr(points, "FEW", few)
    p = cloud(spark, 400)
    got = {r["pid"]: r for r in points.knn(p, p, 9, 0.5, summed=True).collect()}
    at = np.array([r[1:] for r in p.orderBy("pid").collect()])
    for k in range(400):
        near = at[np.argsort(((at - at[k]) ** 2).sum(axis=1), kind="stable")[:9]]
        c = np.cov(near.T, bias=True)
        r = got[k]
        assert r["n"] == 9 and np.allclose([r["mx"], r["my"], r["mz"]], near.mean(axis=0))
        assert np.allclose([r["cxx"], r["cxy"], r["cxz"], r["cyy"], r["cyz"], r["czz"]], [c[0, 0], c[0, 1], c[0, 2], c[1, 1], c[1, 2], c[2, 2]])


def test_colours_come_without_a_broadcast(spark):
    p = cloud(spark, 600).withColumns({c: F.lit(7) for c in "rgb"})
    made = points.transfer_colors(p.where("pid % 4 <> 0").select("pid", "x", "y", "z"), p.where("pid % 4 = 0"), 0.5, 0.5)
    assert "Broadcast" not in plan(made)
    at = np.array([r[1:4] for r in p.orderBy("pid").collect()])
    own = np.arange(600) % 4 == 0
    near = np.sqrt(((at[~own][:, None] - at[own][None]) ** 2).sum(axis=2)).min(axis=1) <= 0.5
    assert [r["hit"] for r in made.orderBy("pid").collect()] == near.tolist()


def test_segments_meet_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(fitting, "BLOCK", 8)
    rng = np.random.default_rng(5)
    rows = [(k, *map(float, rng.random(6))) for k in range(40)]
    made = fitting.segment_distances(spark.createDataFrame(rows, "sid long, px double, py double, pz double, qx double, qy double, qz double"))
    assert "Broadcast" not in plan(made) and made.rdd.getNumPartitions() == 25
    got = {(r["i"], r["j"]) for r in made.collect()}
    assert got == {(i, j) for i in range(40) for j in range(i + 1, 40)}


def test_gears_meet_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(fitting, "BLOCK", 8)
    rows = [(k, float(k), 0.0, 0.0, 0.0, 0.0, 1.0, 1.0, 10.0 + k) for k in range(40)]
    made = series.gear_stages(spark.createDataFrame(rows, "gid long, x double, y double, z double, ax double, ay double, az double, diameter double, teeth double"))
    assert "Broadcast" not in plan(made) and made.rdd.getNumPartitions() == 25
    assert {(r["a_gid"], r["b_gid"]) for r in made.collect()} == {(k, k + 1) for k in range(39)}


def test_profiles_are_matched_where_the_rows_lie(spark):
    catalog = spark.createDataFrame([("I", "a", 0.1, 0.05), ("I", "b", 0.2, 0.1), ("H", "c", 0.1, 0.1)], "family string, profile string, h double, b double")
    rows = [(1, "I", 0.102, 0.05), (2, "I", 0.3, 0.1), (3, "X", 0.1, 0.1), (4, None, 0.1, 0.1), (5, "H", None, None)]
    made = series.match_profiles(spark.createDataFrame(rows, "part int, family string, height double, width double"), catalog)
    # the only exchange is that of the catalog
    assert plan(made.select("part")).count("Exchange") <= 2 and "HashAggregate(keys=[part" not in plan(made)
    got = {r["part"]: (r["profile"], r["deviation"] and round(r["deviation"], 6)) for r in made.collect()}
    assert got == {1: ("a", 0.02), 2: (None, 0.5), 3: (None, None), 4: (None, None), 5: (None, None)}


def test_rays_on_the_border_of_two_cells_are_those_of_the_c_library(spark):
    # differences of hundredths: diagonals that miss 45 degrees by a last bit
    k = np.arange(1, 10_007)
    at = np.concatenate([np.column_stack([k / 1e2, (sign * k + shift) / 1e2, np.full(len(k), 1.0)]) for sign, shift in ((1, 0), (-1, 10_000), (-1, 9_406), (1, 1_337))])
    view = np.array([50.0, 50.0, 1.5])
    for place, az, el in ((view, 64, 20), (np.array([43.7, 50.37, 1.52]), 512, 160), (np.array([13.37, 26.74, 1.5]), 512, 160)):
        r, a, e = scene._rays(at, place, az, el)
        d = at - place
        want = [min(math.floor((math.atan2(y, x) + math.pi) / (2 * math.pi) * az), az - 1) for x, y, _ in d.tolist()]
        assert a.tolist() == want
        rise = [min(math.floor((math.asin(z / f) + math.pi / 2) / math.pi * el), el - 1) for (_, _, z), f in zip(d.tolist(), r.tolist(), strict=True)]
        assert e.tolist() == rise


def test_a_line_through_some_clumps_is_no_cable(spark):
    rng = np.random.default_rng(11)
    clumps = np.concatenate([np.column_stack([np.full(200, x), np.zeros(200), np.full(200, 5.0)]) for x in (0.0, 10.0, 20.0)]) + rng.uniform(-0.1, 0.1, (600, 3))
    cable = np.column_stack([rng.random(600) * 20, np.full(600, 30.0), np.full(600, 5.0)]) + rng.uniform(-0.1, 0.1, (600, 3))
    p = spark.createDataFrame([(k, *map(float, x)) for k, x in enumerate(np.concatenate([clumps, cable]))], "pid long, x double, y double, z double")
    found = bridges.cables(p, 0.3, 5.0, 0.5, 2.0).collect()
    assert [(r["n"], round(r["sy"])) for r in found] == [(600, 30)]


def test_normals_of_a_cloud_closer_than_its_noise(spark):
    rng = np.random.default_rng(12)
    at = np.column_stack([rng.random((20_000, 2)) * 0.4, rng.uniform(-0.008, 0.008, 20_000)])
    p = spark.createDataFrame([(k, *map(float, x)) for k, x in enumerate(at)], "pid long, x double, y double, z double")
    got = points.steady_normals(p, 12, 0.01)
    assert got.count() == 20_000 and got.where("abs(nz) > 0.95").count() > 19_000
    assert points.estimate_normals(p, 12, 0.01).where("abs(nz) > 0.95").count() < 10_000
    # a cloud with flat neighbourhoods keeps the normals of its own
    calm = p.withColumn("z", F.col("z") / 1000)
    own = points.estimate_normals(calm, 12, 0.01).join(points.steady_normals(calm, 12, 0.01).withColumnsRenamed({c: f"s{c}" for c in ("nx", "ny", "nz")}), "pid")
    assert own.where("nx = snx and ny = sny and nz = snz").count() == 20_000


def test_a_face_of_tilted_normals_is_one_plane(spark):
    rng = np.random.default_rng(16)
    at = np.column_stack([rng.random((4_000, 2)) * (4, 3) + 1_000, rng.normal(0, 0.004, 4_000)])
    # the plane through any point with its normal leaves the face 0.7 m to either side
    rows = [(k, *map(float, p), 0.03 * (-1) ** k, 0.0, math.sqrt(1 - 0.03**2)) for k, p in enumerate(at)]
    p = spark.createDataFrame(rows, "pid long, x double, y double, z double, nx double, ny double, nz double")
    found, _ = search.detect(p, 0.02, min_inliers=400, radius=0.3, hypotheses=16, dry=1)
    (r,) = found.collect()
    assert abs(r["nz"]) > 0.99999 and abs(r["mz"]) < 1e-3 and round(r["rms"], 3) == 0.004 and r["n"] > 3_990


def test_registration_counts_every_point(spark, data, monkeypatch):
    own = registration.saved

    def seen(df, tag):
        if tag == "source":
            raise InterruptedError(df.agg(F.sum("w") if "w" in df.columns else F.count("pid")).first()[0])
        return own(df, tag)

    monkeypatch.setattr(registration, "saved", seen)
    with pytest.raises(InterruptedError) as all_:
        surface_queries.registration_matrix(spark, data)
    assert all_.value.args == (spark.read.parquet(f"{data}/orders.parquet").count(),)


def grid(spark, n=12):
    rows = [(i * n + j, float(j), float(i), float((i * j) % 3)) for i in range(n) for j in range(n)]
    quads = [i * n + j for i in range(n - 1) for j in range(n - 1)]
    faces = [f for q in quads for f in ((2 * q, q, q + 1, q + n, 0), (2 * q + 1, q + 1, q + n + 1, q + n, 0))]
    return spark.createDataFrame(faces, "fid long, a long, b long, c long, group_id int"), spark.createDataFrame(rows, "vid long, x double, y double, z double")


def test_creases_deal_edges_before_they_are_summed(spark):
    faces, vertices = grid(spark)
    made = plan(mesh.crease_edges(mesh.corners(faces, vertices)))
    assert "Broadcast" not in made and "REPARTITION_BY_COL" in made


def test_regions_are_contracted_where_they_meet(spark, monkeypatch):
    boxes = spark.range(200).selectExpr("id bid", "0d x0", "1d x1", "0d y0", "1d y1", "0d z0", "1d z1", "1L weight")
    seen = []
    monkeypatch.setattr(repair, "components", lambda nodes, links: seen.append(links.count()) or graph.components(nodes, links))
    assert [(r["root"], r["n"]) for r in repair.merge_regions(boxes).collect()] == [(0, 200)]
    # a link for every two boxes, once per cell they share, were 19,900 at least
    assert seen[0] <= 8 * 200


def test_faces_are_turned_without_a_broadcast(spark):
    faces, vertices = grid(spark)
    assert "Broadcast" not in plan(repair.oriented_faces(faces, vertices))


def test_components_send_no_nodes_through_the_driver(spark):
    nodes = spark.range(100).select(F.col("id").alias("node"))
    made = graph.components(nodes, spark.range(1, 100).select(F.col("id").alias("a"), (F.col("id") - 1).alias("b")))
    assert "Broadcast" not in plan(made) and made.where("root = 0").count() == 100


def test_loops_send_no_vertices_through_the_driver(spark):
    faces, _ = grid(spark)
    made = holes.loops(faces)
    assert "Broadcast" not in plan(made) and made.count() == 44


def test_charts_send_no_faces_through_the_driver(spark):
    faces, vertices = grid(spark)
    places = textures.chart_places(textures.charts(faces, vertices), faces, vertices)
    assert "Broadcast" not in plan(places) and "Broadcast" not in plan(textures.packed(places, 0.1, 256))


def test_registration_tells_the_size_of_cells_once(spark, monkeypatch):
    p = cloud(spark, 500).withColumns({"nx": F.lit(0.0), "ny": F.lit(0.0), "nz": F.lit(1.0)})
    told, tried, own = [], [], points._cell_size
    monkeypatch.setattr(registration, "_cell_size", lambda df, cell, k: told.append(1) or (0.125, 1.0))
    monkeypatch.setattr(registration, "knn", lambda a, b, k, cell: tried.append(cell) or points.knn(a, b, k, cell))
    registration.register(p.select("pid", "x", "y", "z"), p, 1.0, steps=2, most=1.0)
    assert len(told) == 1 and tried == [0.125] * len(tried) and own is points._cell_size


def test_points_of_a_cylinder_leave_without_a_broadcast(spark, monkeypatch):
    rng = np.random.default_rng(4)
    t, s = rng.random(600) * 2 * np.pi, rng.random(600) * 3
    rows = [(k, math.cos(a) / 2, math.sin(a) / 2, float(z), math.cos(a), math.sin(a), 0.0) for k, (a, z) in enumerate(zip(t.tolist(), s.tolist(), strict=True))]
    plans, own = [], parts.saved
    monkeypatch.setattr(parts, "saved", lambda df, tag: (plans.append(plan(df)) if tag == "left" else None, own(df, tag))[1])
    found, _ = parts.detect_cylinders(spark.createDataFrame(rows, "pid long, x double, y double, z double, nx double, ny double, nz double"), 0.02, 200)
    assert found.count() == 1 and len(plans) > 1 and not any("Broadcast" in p for p in plans)


def test_polygons_of_many_corners_are_swept(spark, monkeypatch):
    monkeypatch.setattr(shapes, "_clipped", lambda p: pytest.fail("clipped ear by ear"), raising=False)
    rng = np.random.default_rng(9)
    star = lambda n, size=1.0, at=(0.0, 0.0): (1 + rng.integers(0, 101, n) / 100)[:, None] * size * np.column_stack([f(2 * np.pi * np.arange(n) / n) for f in (np.cos, np.sin)]) + at
    loops = [(1, star(20_000), []), (2, star(500, 4.0), [star(200, 0.3, (1.0, 1.0)), star(300, 0.3, (-1.0, 0.5))[::-1]]), (3, np.array([[0, 0], [1, 0], [2, 0], [2, 2], [1, 2], [0, 2.0]]), [])]
    told = lambda p: [(float(a), float(b)) for a, b in p]
    made = shapes.triangles(spark.createDataFrame([(k, told(p), [told(h) for h in holes]) for k, p, holes in loops], f"poly long, loop {shapes.LOOP}, holes array<{shapes.LOOP}>"))
    twice = (F.col("b_u") - F.col("a_u")) * (F.col("c_v") - F.col("a_v")) - (F.col("b_v") - F.col("a_v")) * (F.col("c_u") - F.col("a_u"))
    got = {r["poly"]: r for r in made.groupBy("poly").agg(F.count("k").alias("n"), F.max("k").alias("k"), F.sum(twice / 2).alias("area"), F.min(twice).alias("least")).collect()}
    for poly, p, holes in loops:
        want = abs(shapes.signed_area(p)) - sum(abs(shapes.signed_area(h)) for h in holes)
        r = got[poly]
        assert r["n"] == r["k"] + 1 == len(p) + sum(len(h) + 2 for h in holes) - 2 and r["area"] == pytest.approx(want) and r["least"] > 0


def test_crossing_loops_are_clipped_still():
    bow = np.array([[0, 0], [2, 2], [2, 0], [0, 2.0]])
    assert shapes.swept(bow, [4]) is None and len(shapes.triangulated(bow)) == 2


def test_points_amid_others_need_no_circles(monkeypatch):
    rng = np.random.default_rng(13)
    p = rng.uniform(0, 100, (10_000, 2))
    inner = (np.abs(p - 50) < 30).all(axis=1)
    asked, own = [], np.sqrt
    monkeypatch.setattr(shapes.np, "sqrt", lambda x: (asked.append(1), own(x))[1])
    assert shapes.tile_edges(*p.T, inner, 4.0) == []
    # a pair of circles for each of its near points, once per point that is asked for
    assert len(asked) < inner.sum() / 20


def test_percentiles_are_spark_s_own_and_hold_no_group(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "BINS", 16)
    monkeypatch.setattr(quantiles, "FEW", 8)
    rng = np.random.default_rng(14)
    rows = [(k % 3, float(a), float(round(b, 1)), c) for k, (a, b, c) in enumerate(zip(rng.normal(0, 1e6, 3000), rng.random(3000), [1e300, -1e300, 5e-324, float("inf"), float("-inf"), float("nan"), None, 0.0] * 375, strict=True))]
    p = spark.createDataFrame([*rows, (4, 2.5, 1.0, 1.0), (5, None, 1.0, None)], "g long, a double, b double, c double").repartition(5)
    asked = {"a": [0.005, 0.5, 0.995], "b": [0.0, 0.33, 1.0], "c": [0.1, 0.4, 0.9]}
    want = {r["g"]: r for r in p.groupBy("g").agg(*[F.percentile(c, F.lit(q)).alias(c) for c, q in asked.items()]).collect()}
    got = quantiles.percentiles(p, "g", asked)
    for g, r in want.items():
        for c in asked:
            assert str(got[g].get(c)) == str(r[c])
    assert quantiles.percentiles(p, None, {"a": [0.5]})[0]["a"][0] == p.agg(F.percentile("a", 0.5)).first()[0] and quantiles.percentiles(p.limit(0), None, {"a": [0.5]}) == {}


def test_decks_are_measured_without_a_task_that_holds_a_plane(spark, monkeypatch):
    rng = np.random.default_rng(15)
    p = spark.createDataFrame([(1, float(x), float(y), 5.0) for x, y in rng.random((2_000, 2)) * (40, 6)], "plane_id long, x double, y double, z double")
    monkeypatch.setattr(bridges.F, "percentile", lambda *_: pytest.fail("a task would hold the plane"))
    found = bridges.deck(p)
    assert 38 < found.length < 40 and 5.7 < found.width < 6 and found.elevation == 5


@pytest.mark.parametrize("few", [0, 64])
def test_spacings_are_summed_where_neighbours_meet(spark, monkeypatch, few):
    monkeypatch.setattr(points, "FEW", few)
    rows, own = [], points.saved
    monkeypatch.setattr(points, "saved", lambda df, tag: (x := own(df, tag), rows.append(x.count()) if tag == "knn" else None)[0])
    p = cloud(spark, 400)
    got = {r["pid"]: r["spacing"] for r in points.local_spacing(p, 8, 0.5).collect()}
    # a row per query, not per neighbour
    assert rows and max(rows) <= 400
    at = np.array([r[1:] for r in p.orderBy("pid").collect()])
    far = np.sort(np.sqrt(((at[:, None] - at[None]) ** 2).sum(axis=2)), axis=1)[:, 1:9].mean(axis=1)
    assert np.allclose([got[k] for k in range(400)], far)
    monkeypatch.setattr(points.F, "percentile", lambda *_: pytest.fail("a task would hold all spacings"))
    assert points.median_spacing(p, 0.5).first()[0] == pytest.approx(np.median(np.sort(((at[:, None] - at[None]) ** 2).sum(axis=2), axis=1)[:, 1] ** 0.5))
