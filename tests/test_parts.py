"""Scene classes, terrain meshes, seams, unfolding, snapping and panes."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cloudloom.operators import mesh, parts, repair, scene


def test_gaps_are_closed(spark):
    there = {(i, j) for i in range(8) for j in range(8)} - {(3, 3), (3, 4), (7, 7)} | {(20, 20)}
    got = {(r["cx"], r["cy"]) for r in scene.closed_cells(spark.createDataFrame(list(there), "cx long, cy long")).collect()}
    assert {(3, 3), (3, 4), (20, 20)} <= got and there <= got
    assert scene.closed_cells(spark.createDataFrame([], "cx long, cy long")).count() == 0


def test_terrain_mesh_is_a_closed_grid(spark):
    r = np.random.default_rng(1)
    p = r.uniform(0, 4, (2_000, 2))
    rows = [(i, float(x), float(y), float(0.1 * x)) for i, (x, y) in enumerate(p)]
    faces, vertices = scene.terrain_mesh(spark.createDataFrame(rows, "pid long, x double, y double, z double"), 0.5)
    assert faces.count() == 128 and vertices.count() == 81
    stats = mesh.edge_stats(faces).first()
    assert stats["boundary"] == 32 and stats["non_manifold"] == 0
    assert mesh.area(mesh.corners(faces, vertices)).first()["area"] == pytest.approx(16, rel=0.05)


def bent(t=0.003):
    base = np.array([[0, 0, 0], [0.3, 0, 0], [0.3, 0.2, 0], [0, 0.2, 0.0]])
    flange = np.array([[0, 0.2, 0], [0.3, 0.2, 0], [0.3, 0.2, 0.15], [0, 0.2, 0.15]])
    plates = [
        {"id": 0, "outline": base, "thickness": t, "normal": np.array([0, 0, 1.0]), "area": 0.06},
        {"id": 1, "outline": flange, "thickness": t, "normal": np.array([0, 1.0, 0]), "area": 0.045},
    ]
    return plates, [{"i": 0, "j": 1, "a": np.array([0, 0.2, 0.0]), "b": np.array([0.3, 0.2, 0.0])}]


def test_a_bent_plate_unfolds_to_its_length():
    plates, found = bent()
    assert parts.junctions(plates, found) == ["corner"]
    (part,) = parts.unfold(plates, found)
    points = np.vstack(part["loops"])
    assert sorted(np.ptp(points, axis=0)) == pytest.approx([0.3, 0.2 + math.pi / 2 * 0.003 * 1.44 + 0.15])
    assert part["angles"] == [pytest.approx(90)] and len(part["bends"]) == 1 and part["ids"] == [0, 1]


def test_tees_and_unlike_gauges_stay_apart():
    plates, found = bent()
    plates[1]["thickness"] = 0.006
    assert len(parts.unfold(plates, found)) == 2
    plates, _ = bent()
    plates[1]["outline"] = plates[1]["outline"] - [0, 0.1, 0]
    tee = [{"i": 0, "j": 1, "a": np.array([0.1, 0.1, 0]), "b": np.array([0.2, 0.1, 0])}]
    assert parts.junctions(plates, tee) == ["tee"] and len(parts.unfold(plates, tee)) == 2


def test_seams_of_a_bent_plate(spark):
    r = np.random.default_rng(2)
    rows = [(0, float(x), float(y), 0.0) for x, y in r.uniform(0, 1, (4_000, 2)) * [0.3, 0.2]]
    rows += [(1, float(x), 0.2, float(z)) for x, z in r.uniform(0, 1, (4_000, 2)) * [0.3, 0.15]]
    rows += [(2, float(x), float(y), 1.0) for x, y in r.uniform(0, 1, (100, 2))]
    points = spark.createDataFrame(rows, "plane_id long, x double, y double, z double")
    plates = spark.createDataFrame([(0, 0.0, 0.0, 1.0, 0.0), (1, 0.0, 1.0, 0.0, -0.2), (2, 0.0, 0.0, 1.0, -1.0)], "plane_id long, nx double, ny double, nz double, d double")
    (seam,) = parts.seams(points, plates, 0.01).collect()
    assert (seam["i"], seam["j"]) == (0, 1) and seam["length"] == pytest.approx(0.3, abs=0.01)
    assert seam["ay"] == pytest.approx(0.2) and seam["bz"] == pytest.approx(0)


def test_vertices_snap_to_planes_lines_and_cylinders(spark):
    vertices = spark.createDataFrame([(0, 1.0, 1.0, 0.02), (1, 0.02, 1.0, 0.03), (2, 1.0, 1.0, 0.5), (3, 1.0, 1.2, 0.02)], "vid long, x double, y double, z double")
    normals = spark.createDataFrame([(0, 0.0, 0.0, 1.0), (1, 0.7, 0.0, 0.7), (2, 0.0, 0.0, 1.0), (3, 1.0, 0.0, 0.0)], "vid long, nx double, ny double, nz double")
    planes = spark.createDataFrame(
        [(0, 0.0, 0.0, 1.0, 0.0, 0.0, 2.0, 0.0, 2.0, 0.0, 0.0), (1, 1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 2.0, 0.0, 2.0)],
        "plane_id long, nx double, ny double, nz double, d double, x0 double, x1 double, y0 double, y1 double, z0 double, z1 double",
    )
    got = {r["vid"]: (round(r["x"], 9), round(r["z"], 9), r["snapped"]) for r in repair.snapped_to_planes(vertices, normals, planes, 0.05).collect()}
    assert got == {0: (1.0, 0.0, True), 1: (0.0, 0.0, True), 2: (1.0, 0.5, False), 3: (1.0, 0.02, False)}
    rod = spark.createDataFrame([(0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0, 1.0, 4.0)], "cyl_id long, px double, py double, pz double, ax double, ay double, az double, radius double, length double")
    round_ = spark.createDataFrame([(0, 1.03, 0.0, 1.0), (1, 0.0, 0.97, 5.0), (2, 0.0, 0.5, 0.0)], "vid long, x double, y double, z double")
    got = {r["vid"]: (round(r["x"], 9), round(r["y"], 9)) for r in repair.snapped_to_cylinders(round_, rod, 0.05).collect()}
    assert got == {0: (1.0, 0.0), 1: (0.0, 0.97), 2: (0.0, 0.5)}


def test_panes_fill_openings(spark):
    loop = [{"x": 0.0, "y": 0.0, "z": 1.0}, {"x": 1.0, "y": 0.0, "z": 1.0}, {"x": 1.0, "y": 0.0, "z": 2.0}, {"x": 0.0, "y": 0.0, "z": 2.0}]
    holes = spark.createDataFrame([(0, 0.0, -1.0, 0.0, 1.0, loop), (1, 0.0, -1.0, 0.0, 0.01, loop)], "hole long, nx double, ny double, nz double, area double, loop array<struct<x:double,y:double,z:double>>")
    tri = repair.panes(holes)
    assert tri.count() == 4 and mesh.area(tri).first()["area"] == pytest.approx(1) and tri.agg(F.min("ay"), F.max("cy")).first() == (0.04, 0.04)
