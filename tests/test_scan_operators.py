"""Scan operators: known truths, file round trips, and the contract's registry."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from cloudloom.operators import graph, mesh, planes, points, scene, series
from cloudloom.plans import queries
from cloudloom.sources import clouds, writers


@pytest.fixture(scope="module")
def cube(spark):
    """A unit cube of 12 faces, outward normals."""
    v = spark.createDataFrame([(i, float(i & 1), float(i >> 1 & 1), float(i >> 2)) for i in range(8)], "vid long, x double, y double, z double")
    quads = [(0, 2, 3, 1), (4, 5, 7, 6), (0, 1, 5, 4), (2, 6, 7, 3), (0, 4, 6, 2), (1, 3, 7, 5)]
    f = [(2 * k + h, *((a, b, c) if h == 0 else (a, c, d)), k) for k, (a, b, c, d) in enumerate(quads) for h in (0, 1)]
    return spark.createDataFrame(f, "fid long, a long, b long, c long, group_id int"), v


def test_cube(cube, spark):
    tri = mesh.corners(*cube)
    assert mesh.signed_volume(tri).first()[0] == pytest.approx(1)
    assert mesh.area(tri).first()["area"] == pytest.approx(6)
    assert tuple(mesh.edge_stats(cube[0]).first()) == (18, 0, 18, 0)
    assert mesh.crease_edges(tri).count() == 12
    assert mesh.slice_z(tri, 0.5).count() == 8
    p = spark.createDataFrame([(1, 0.5, 0.5, 1.3), (2, 0.5, 0.5, 0.6), (3, 1.2, 0.5, 0.5)], "pid long, x double, y double, z double")
    d = {r["pid"]: r["d"] for r in mesh.signed_distance(p, tri).collect()}
    assert d == pytest.approx({1: 0.3, 2: -0.4, 3: 0.2})
    f, v = mesh.merge([cube, cube])
    assert f.count() == 24 and mesh.edge_stats(f).first()["boundary"] == 0
    assert mesh.edge_stats(mesh.weld(f, v, 1e-6)[0]).first()["non_manifold"] == 18


def test_room(spark, data):
    room = queries.box(spark, data)
    fit = planes.fit_planes(room)
    assert fit.count() == 6 and fit.agg(F.max("rms")).first()[0] < 0.006
    skew = planes.pairs(fit).where("abs(a_nx * b_nx + a_ny * b_ny + a_nz * b_nz) <= 0.97")
    corner = planes.corner_points(fit, skew.select(F.col("a_plane_id").alias("i"), F.col("b_plane_id").alias("j"))).collect()
    want = {(x, y, z) for x in (0, 4) for y in (0, 3) for z in (0, 2.5)}
    assert len(corner) == 8 and all(any(np.hypot.reduce(np.array([c["x"], c["y"], c["z"]]) - w) < 0.03 for w in want) for c in corner)
    classes = {r["plane_id"]: r["class"] for r in planes.classify(fit.withColumn("mean_z", F.col("mz"))).collect()}
    assert classes == {1: "floor", 2: "ceiling", 3: "wall", 4: "wall", 5: "wall", 6: "wall"}
    assert {r["class"] for r in queries.flagship(spark, data).collect()} == {None, "floor", "ceiling", "wall"}


def test_overlaps_snaps_and_spacing(spark):
    grid = [(float(x), float(y)) for x in range(5) for y in range(5)]
    # 0 and 1: parallel, half over each other; 2: beside both
    rows = [(k, x + shift, y, z) for k, (shift, z) in enumerate([(0.0, 0.0), (2.0, 1.0), (9.0, 0.0)]) for x, y in grid]
    p = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "pid long, plane_id int, x double, y double, z double")
    flat = spark.createDataFrame([(k, 0.0, 0.0, 1.0, -float(k == 1)) for k in range(3)], "plane_id int, nx double, ny double, nz double, d double")
    got = {(r["i"], r["j"]): (r["share"], r["overlaps"]) for r in planes.footprint_overlaps(p, flat).collect()}
    assert got == {(0, 1): (pytest.approx(0.5), True), (0, 2): (0.0, False), (1, 2): (0.0, False)}
    assert not planes.footprint_overlaps(p, flat, 0.6).where("overlaps").count()
    few = spark.createDataFrame([(1, 0.1, 0.0, 0.0), (2, 0.8, 0.0, 0.0), (3, 5.0, 0.0, 0.0)], "pid long, x double, y double, z double")
    corners = spark.createDataFrame([(0, 1, 2, 0.0, 0.0, 0.0), (0, 1, 3, 1.0, 0.0, 0.0)], "i int, j int, k int, x double, y double, z double")
    assert {r["pid"]: (r["x"], r["snapped"]) for r in planes.snap_to_corners(few, corners, 0.5).collect()} == {1: (0.0, True), 2: (1.0, True), 3: (5.0, False)}
    assert not planes.snap_to_corners(few, corners.limit(0), 0.5).where("snapped").count() and planes.snap_to_corners(few, corners.limit(0), 0.5).count() == 3
    # 1-NN distances 0.7, 0.7 and 4.2
    assert points.median_spacing(few).first()[0] == pytest.approx(0.7) and points.median_spacing(few.limit(1)).first()[0] == 0


def test_knn_is_exact_for_any_cell(spark):
    r = np.random.default_rng(3)
    xyz = np.concatenate([r.normal(size=(60, 3)), r.normal(size=(3, 3)) + 40])
    p = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(xyz)], "pid long, x double, y double, z double")
    d = ((xyz[:, None] - xyz) ** 2).sum(2)
    for cell in (0.3, 5.0):
        got = {(x["pid"], x["nid"]) for x in points.knn(p, p, 4, cell, skip_self=True).collect()}
        assert got == {(i, j) for i in range(63) for j in np.argsort(d[i], kind="stable")[1:5].tolist()}
    assert points.knn(p, p, 100, 1.0).count() == 63 * 63
    assert points.voxel_downsample(p, 0).count() == 63 and points.voxel_downsample(p, 1e3).count() == 1


def test_components_and_levels(spark):
    p = spark.createDataFrame([(i, i * 0.4, 0.0, 0.0) for i in range(20)] + [(90 + i, 50 + i * 0.4, 0.0, 0.0) for i in range(5)], "pid long, x double, y double, z double")
    assert graph.grid_components(p, 1.0).groupBy("label").count().count() == 2
    assert graph.largest_component(p, 1.0).count() == 20
    z = spark.createDataFrame([(x,) for x in (0.0, 0.02, 2.6, 2.61, 5.2)], "z double")
    assert [round(r["height"], 2) for r in series.storeys(z).orderBy("k").collect()] == [2.6, 2.6]
    plates = spark.createDataFrame([(0.0079,), (0.0061,), (0.06,)], "t double")
    assert [r["stock"] for r in series.nearest_stock(plates, queries.STOCK).collect()] == [0.008, 0.006, None]
    assert [r["span"] for r in series.spans(spark.createDataFrame([(10.0,), (20.0,)], "station double"), 0.0, 30.0).collect()] == [10, 10, 10]
    flat = spark.createDataFrame([(i, (i % 10) * 0.5, (i // 10) * 0.5, 0.0) for i in range(100)] + [(999, 2.0, 2.0, 3.0)], "pid long, x double, y double, z double")
    up = {r["pid"]: r["height"] for r in scene.height_above(flat, scene.terrain(flat)).collect()}
    assert up[999] == 3.0 and up[0] == 0.0


def test_files(spark, cube, tmp_path):
    f, v = cube
    writers.write_ply(f, v, str(tmp_path / "c.ply"))
    back = clouds.read_cloud(spark, str(tmp_path / "c.ply"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, v.collect()))
    writers.write_obj(f, v, str(tmp_path / "c.obj"))
    assert (tmp_path / "c.obj").read_text().count("\nf ") == 12
    writers.write_stl(f, v, str(tmp_path / "c.stl"))
    assert (tmp_path / "c.stl").stat().st_size == 84 + 50 * 12
    writers.write_dxf_lines(mesh.slice_z(mesh.corners(f, v), 0.5), str(tmp_path / "c.dxf"))
    assert (tmp_path / "c.dxf").read_text().count("LINE") == 8
    writers.write_xyz(v, str(tmp_path / "c.xyz"))
    assert clouds.read_cloud(spark, str(tmp_path / "c.xyz")).count() == 8
    (tmp_path / "p.pts").write_text("3\n1 2 3 7 10 20 30\n4 5 6 8 40 50 60\n7 8 9 9 70 80 90\n")
    assert clouds.read_cloud(spark, str(tmp_path / "p.pts")).select("x", "b").orderBy("x").collect()[2] == (7.0, 90.0)
    (tmp_path / "a.ply").write_text("ply\nformat ascii 1.0\nelement vertex 2\nproperty float x\nproperty float y\nproperty float z\nproperty uchar red\nproperty uchar green\nproperty uchar blue\nend_header\n1 2 3 4 5 6\n7 8 9 10 11 12\n")
    assert [tuple(r) for r in clouds.read_cloud(spark, str(tmp_path / "a.ply")).orderBy("pid").collect()] == [(0, 1, 2, 3, 4, 5, 6), (1, 7, 8, 9, 10, 11, 12)]
    head = "VERSION .7\nFIELDS x y z rgb\nSIZE 4 4 4 4\nTYPE F F F U\nCOUNT 1 1 1 1\nWIDTH 2\nHEIGHT 1\nPOINTS 2\nDATA binary\n"
    (tmp_path / "b.pcd").write_bytes(head.encode() + struct.pack("<3fI3fI", 1, 2, 3, 0x0A141E, 4, 5, 6, 0xFFFFFF))
    assert [tuple(r) for r in clouds.read_cloud(spark, str(tmp_path / "b.pcd")).orderBy("pid").collect()] == [(0, 1, 2, 3, 10, 20, 30), (1, 4, 5, 6, 255, 255, 255)]
    las = bytearray(227)
    las[:4], las[24], las[25], las[104] = b"LASF", 1, 2, 3
    struct.pack_into("<I", las, 96, 227)
    struct.pack_into("<HI", las, 105, 34, 5)
    struct.pack_into("<6d", las, 131, 0.01, 0.01, 0.01, 100, 0, 0)
    rows = b"".join(struct.pack("<3iH6xdHHH", i, 2 * i, 3 * i, i, i + 0.5, i, i, i) for i in range(5))
    (tmp_path / "l.las").write_bytes(bytes(las) + rows)
    clouds.register(spark)
    got = spark.read.format("cloud-las").option("rows", 2).load(str(tmp_path / "l.las")).orderBy("pid").collect()
    assert len(got) == 5 and got[3]["x"] == pytest.approx(100.03) and got[3]["t"] == 3.5 and got[4]["r"] == 4


def test_registry():
    import __spark_entry__ as e

    assert set(queries.SQL) <= set(queries.QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
