"""Plane search, outlines, registration, repair and parts against brute force and known scenes."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cloudloom.operators import parts, registration, repair, search, shapes, solids
from cloudloom.operators.mesh import corners

XYZ = ("x", "y", "z")


def cloud(spark, xyz, normals=None):
    cols = "pid long, x double, y double, z double" + (", nx double, ny double, nz double" if normals is not None else "")
    rows = [(i, *map(float, p), *(map(float, normals[i]) if normals is not None else ())) for i, p in enumerate(xyz)]
    return spark.createDataFrame(rows, cols)


# ------------------------------------------------------------ planes


def test_planes_of_a_noisy_corner(spark):
    r = np.random.default_rng(1)
    faces = []
    for axis in range(3):
        p = r.uniform(0, 2, (600, 3))
        p[:, axis] = r.normal(0, 0.003, 600)
        faces.append((p, np.tile(np.eye(3)[axis], (600, 1))))
    noise = r.uniform(0, 2, (150, 3))
    xyz = np.vstack([*[p for p, _ in faces], noise])
    normals = np.vstack([*[n for _, n in faces], r.normal(size=(150, 3))])
    normals /= np.linalg.norm(normals, axis=1, keepdims=True)
    points = cloud(spark, xyz, normals)
    odd = spark.createDataFrame([(10_000, None, 1.0, 1.0, 0.0, 0.0, 1.0)], points.schema)
    found, owner = search.detect(points.unionByName(odd), 0.012, min_inliers=200, radius=0.5)
    rows = found.collect()
    assert sorted(int(np.argmax(np.abs([x["nx"], x["ny"], x["nz"]]))) for x in rows) == [0, 1, 2]
    assert all(x["rms"] < 0.006 and abs(x["d"]) < 0.002 for x in rows)
    own = {x["pid"]: x["plane_id"] for x in owner.collect()}
    axis_of = {x["plane_id"]: int(np.argmax(np.abs([x["nx"], x["ny"], x["nz"]]))) for x in rows}
    assert np.mean([axis_of.get(own.get(i, -1)) == i // 600 for i in range(1_800)]) > 0.97
    assert len(own) == owner.count() and 10_000 not in own


def test_no_planes_in_noise_or_nothing(spark):
    r = np.random.default_rng(2)
    n = r.normal(size=(400, 3))
    noise = cloud(spark, r.uniform(0, 1, (400, 3)), n / np.linalg.norm(n, axis=1, keepdims=True))
    for points in (noise, noise.limit(0)):
        found, owner = search.detect(points, 0.05, min_inliers=100)
        assert found.count() == 0 and owner.count() == 0


def test_directions_become_square():
    tilt = math.radians(4)
    n = np.array([[1, 0, 0], [math.cos(tilt), math.sin(tilt), 0], [math.sin(tilt), math.cos(tilt), 0], [0, 0, 1], [0, 0.6, 0.8]])
    group, dirs = search.directions(n, np.array([10.0, 5, 4, 3, 2]))
    assert group.tolist() == [0, 0, 1, 2, 3]
    assert abs(dirs[0] @ dirs[1]) < 1e-12 and abs(dirs[0] @ dirs[2]) < 1e-12 and abs(dirs[3] @ dirs[2]) > 0.5


def test_regularised_duplicates_become_one(spark):
    r = np.random.default_rng(3)
    rows = []
    for k, (z, x0) in enumerate([(0.0, 0.0), (0.02, 0.2), (0.02, 5.0), (1.0, 0.0)]):
        for i in range(200):
            rows.append((k * 1_000 + i, k, x0 + r.uniform(0, 1), r.uniform(0, 1), z + 0.002 * r.normal()))
    points = spark.createDataFrame(rows, "pid long, plane_id long, x double, y double, z double")
    from cloudloom.operators.planes import fit_planes

    new, to = search.regularise(points, fit_planes(points))
    # the second overlaps the first and is near; the third lies beside it, the fourth above
    assert {r["plane_id"]: r["to"] for r in to.collect()} == {0: 0, 1: 0, 2: 2, 3: 3}
    first = new.where("plane_id = 0").first()
    assert first["n"] == 400 and abs(abs(first["d"]) - 0.01) < 0.002 and 0.008 < first["rms"] < 0.013


def test_alignment_turns_up_and_level(spark):
    a = math.radians(10)
    rows = [(100, 0.0, math.sin(a), math.cos(a)), (60, 1.0, 0.0, 0.0)]
    m = np.array(search.alignment(spark.createDataFrame(rows, "n long, nx double, ny double, nz double"))).reshape(3, 3)
    assert np.allclose(m @ m.T, np.eye(3)) and np.linalg.det(m) > 0.99
    assert np.allclose(m @ np.array(rows[0][1:]), [0, 0, 1]) and np.allclose(np.abs(m @ np.array(rows[1][1:])), [1, 0, 0])


# ------------------------------------------------------------ outlines


def test_triangles_cover_polygons_with_holes():
    outer = np.array([[0, 0], [4, 0], [4, 3], [2, 2.5], [0, 3.0]])
    holes = [np.array([[1, 1], [1.5, 1], [1.5, 1.5], [1, 1.5]]), np.array([[2.5, 0.5], [3.5, 0.5], [3, 1.5]])]
    p = shapes.bridged(outer, holes)
    t = shapes.triangulated(p)
    want = shapes.signed_area(outer) - sum(shapes.signed_area(h) for h in holes)
    each = [shapes.signed_area(p[list(x)]) for x in t]
    assert sum(each) == pytest.approx(want) and min(each) > -1e-12
    middle = np.array([p[list(x)].mean(axis=0) for x in t])
    assert not ((middle[:, 0] > 1) & (middle[:, 0] < 1.5) & (middle[:, 1] > 1) & (middle[:, 1] < 1.5)).any()


def test_loops_are_simplified_straightened_and_cleaned():
    r = np.random.default_rng(4)
    side = np.linspace(0, 1, 20, endpoint=False)
    raw = np.vstack([np.c_[4 * side, 0 * side], np.c_[4 + 0 * side, 3 * side], np.c_[4 - 4 * side, 3 + 0 * side], np.c_[0 * side, 3 - 3 * side]])
    noisy = raw + r.normal(0, 0.01, raw.shape)
    few = shapes.simplified(noisy, 0.05)
    assert len(few) <= 8
    square = shapes.cleaned(shapes.straightened(few))
    assert len(square) == 4 and shapes.signed_area(square) == pytest.approx(12, rel=0.02)
    a = np.roll(square, -1, axis=0) - square
    assert max(abs((a * np.roll(a, -1, axis=0)).sum(axis=1))) < 1e-9
    assert len(shapes.cleaned(np.array([[0, 0], [1, 0], [1, 0], [2, 0], [2, 2], [0, 2.0]]))) == 4


def slow_boundary(p, alpha):
    """Edges of which exactly one of the two circles of radius alpha is empty."""
    out = set()
    for i in range(len(p)):
        for j in range(i + 1, len(p)):
            d = p[j] - p[i]
            l2 = d @ d
            if not 0 < l2 < 4 * alpha * alpha:
                continue
            h = math.sqrt(alpha * alpha / l2 - 0.25)
            free = [all(np.hypot(*(p[k] - c)) >= alpha - 1e-9 for k in range(len(p)) if k not in (i, j)) for s in (1, -1) for c in [p[i] + d / 2 + s * h * np.array([-d[1], d[0]])]]
            if free[0] != free[1]:
                out.add((i, j))
    return out


def test_boundary_by_tiles_equals_all_pairs(spark):
    r = np.random.default_rng(5)
    p = r.uniform(0, 3, (160, 2))
    p = p[np.hypot(*(p - 1.5).T) > 0.6]
    place = {tuple(x): i for i, x in enumerate(p)}
    points = spark.createDataFrame([(7, float(u), float(v)) for u, v in p] + [(7, float(p[0][0]), float(p[0][1])), (7, None, 1.0)], "plane_id long, u double, v double")
    got = {tuple(sorted((place[x["a_u"], x["a_v"]], place[x["b_u"], x["b_v"]]))) for x in shapes.boundary_edges(points, 0.4, tile=0.9).collect()}
    assert got == slow_boundary(p, 0.4)


def test_surface_with_an_opening(spark):
    g = np.stack(np.meshgrid(np.arange(0, 4.01, 0.05), np.arange(0, 3.01, 0.05)), -1).reshape(-1, 2)
    g = g[~((g[:, 0] > 1.02) & (g[:, 0] < 2.48) & (g[:, 1] > 0.92) & (g[:, 1] < 2.08))] + np.random.default_rng(6).normal(0, 0.002, (1, 2))
    g = g + np.random.default_rng(7).uniform(-0.004, 0.004, g.shape)
    points = spark.createDataFrame([(1, float(u), float(v)) for u, v in g], "plane_id long, u double, v double")
    row = shapes.surfaces(points, 0.05).first()
    assert row["area"] == pytest.approx(12, rel=0.03) and len(row["holes"]) == 1 and len(row["loop"]) == 4
    assert shapes.surfaces(points.limit(2), 0.05).count() == 0 and shapes.surfaces(points.limit(0), 0.05).count() == 0


# ------------------------------------------------------------ registration


def test_motion_is_found_again(spark):
    r = np.random.default_rng(8)
    xyz, normals = [], []
    for axis in range(3):
        p = r.uniform(0, 2, (150, 3))
        p[:, axis] = 0
        xyz.append(p)
        normals.append(np.tile(np.eye(3)[axis], (150, 1)))
    xyz, normals = np.vstack(xyz), np.vstack(normals)
    turn, shift = registration.rotation(np.array([0.02, -0.01, 0.015])), np.array([0.02, 0.01, -0.015])
    source = cloud(spark, (xyz - shift) @ turn)
    found = registration.register(source, cloud(spark, xyz, normals), 0.3, steps=12, most=1.0)
    m = np.array(found.matrix).reshape(3, 4)
    assert np.abs(m[:, :3] - turn).max() < 2e-3 and np.abs(m[:, 3] - shift).max() < 4e-3 and found.rmse < 2e-3
    few = registration.register(source.limit(10), cloud(spark, xyz, normals), 0.3, most=1.0)
    assert not few.converged and few.matrix[:4] == (1.0, 0.0, 0.0, 0.0)


def test_similarity_of_mirrored_points_is_a_rotation(spark):
    r = np.random.default_rng(9)
    s = r.normal(size=(40, 3))
    t = 1.7 * s @ registration.rotation(np.array([0.4, 1.1, -0.3])).T + [1, 2, 3]
    rows = [tuple(map(float, (*a, *b))) for a, b in zip(s, t, strict=True)]
    pairs = spark.createDataFrame(rows, "sx double, sy double, sz double, tx double, ty double, tz double")
    fit = registration.similarity(pairs)
    assert fit[0] == pytest.approx(1.7) and np.linalg.det(fit[1]) == pytest.approx(1)
    assert registration.residuals(pairs, fit).agg(F.max("residual")).first()[0] < 1e-9
    mirrored = pairs.withColumn("tx", -F.col("tx"))
    assert np.linalg.det(registration.similarity(mirrored)[1]) == pytest.approx(1)


# ------------------------------------------------------------ repair


def strip(spark, cells, first=0, fid=0):
    """A strip of ``cells`` squares, two faces each."""
    vertices = [(first + 2 * i + j, float(i), float(j), 0.0) for i in range(cells + 1) for j in (0, 1)]
    faces = []
    for i in range(cells):
        a = first + 2 * i
        faces += [(fid + 2 * i, a, a + 2, a + 1, 0), (fid + 2 * i + 1, a + 1, a + 2, a + 3, 0)]
    return spark.createDataFrame(faces, "fid long, a long, b long, c long, group_id int"), spark.createDataFrame(vertices, "vid long, x double, y double, z double")


def test_islands_floaters_and_clutter(spark):
    f1, v1 = strip(spark, 30)
    f2, v2 = strip(spark, 4, 1_000, 500)
    f3, v3 = strip(spark, 3, 2_000, 900)
    faces = f1.unionByName(f2).unionByName(f3)
    vertices = v1.unionByName(v2.withColumn("z", F.lit(0.5))).unionByName(v3.withColumn("z", F.lit(9.0)))
    ids = lambda df: {r["fid"] for r in df.collect()}
    assert ids(repair.drop_islands(faces, 8)) == set(range(60)) | set(range(500, 508))
    assert ids(repair.strip_floaters(faces, vertices, 0.8, 20)) == set(range(60)) | set(range(500, 508))
    kept, boxes = repair.strip_clutter(faces, vertices, 7, 0.0, 5)
    assert ids(kept) == set(range(60)) | set(range(500, 508)) and [(r["weight"], r["z0"], r["z1"]) for r in boxes.collect()] == [(6, 9.0, 9.0)]
    none = faces.limit(0)
    assert repair.drop_islands(none).count() == 0 and repair.strip_floaters(none, vertices).count() == 0


def test_flipped_faces_of_a_box_are_turned_back(spark):
    items = spark.createDataFrame([(0, 0.0, 0.0, 0.0, 1.0, 2.0, 3.0)], "item long, x0 double, y0 double, z0 double, x1 double, y1 double, z1 double")
    faces, vertices = solids.boxes(items)
    odd = F.col("fid") % 5 < 3
    mixed = faces.select("fid", "a", F.when(odd, F.col("c")).otherwise(F.col("b")).alias("b"), F.when(odd, F.col("b")).otherwise(F.col("c")).alias("c"), "group_id")
    out = repair.oriented_faces(mixed, vertices)
    assert {(r["fid"], r["turned"]) for r in out.collect()} == {(k, int(k % 5 < 3)) for k in range(12)}
    from cloudloom.operators.mesh import signed_volume

    assert signed_volume(corners(out, vertices)).first()["volume"] == pytest.approx(6)


def test_replaced_regions_and_plain_merge(spark):
    faces, vertices = strip(spark, 10)
    box = spark.createDataFrame([(2.0, 4.0, -1.0, 2.0, -1.0, 1.0)], "x0 double, x1 double, y0 double, y1 double, z0 double, z1 double")
    left = repair.replace_regions(faces, vertices, box)
    assert left.count() == 16
    both = repair.plain_merge([vertices.withColumns({c: F.lit(7) for c in "rgb"}), vertices])
    assert {r["r"] for r in both.collect()} == {7, 180}


# ------------------------------------------------------------ parts


def test_cylinders_shafts_and_clusters(spark):
    r = np.random.default_rng(11)
    xyz, normals = [], []
    for radius, low, high in ((0.3, 0.0, 1.0), (0.5, 1.2, 3.0)):
        t, s = r.uniform(0, 2 * math.pi, 700), r.uniform(low, high, 700)
        n = np.c_[np.cos(t), np.sin(t), 0 * t]
        xyz.append(n * (radius + r.normal(0, 0.002, (700, 1))) + np.c_[0 * s, 0 * s, s])
        normals.append(n)
    points = cloud(spark, np.vstack(xyz), np.vstack(normals))
    found, owner = parts.detect_cylinders(points, 0.02, min_inliers=300, radius=0.4)
    assert sorted(round(x["radius"], 2) for x in found.collect()) == [0.3, 0.5] and owner.count() > 1_350
    steps = parts.shafts(found).orderBy("step").collect()
    assert {s["shaft"] for s in steps} == {0} and len(steps) == 2 and steps[1]["start"] > steps[0]["end"]
    clusters = parts.radius_clusters(points, 0.15)
    assert clusters.count() == 1_400 and clusters.select("cluster").distinct().count() == 2


def test_radius_clusters_equal_brute_force(spark):
    r = np.random.default_rng(12)
    p = np.vstack([r.uniform(0, 1, (120, 3)), np.repeat([[0.5, 0.5, 0.5]], 5, axis=0)])
    root = list(range(len(p)))
    for _ in range(len(p)):
        for i in range(len(p)):
            near = np.flatnonzero(np.linalg.norm(p - p[i], axis=1) <= 0.13)
            root[i] = min(root[j] for j in near)
    got = {x["pid"]: x["cluster"] for x in parts.radius_clusters(cloud(spark, p), 0.13).collect()}
    assert got == dict(enumerate(root))


def test_projection_and_back(spark):
    rows = spark.createDataFrame([(1, 0.3, -0.2, 2.0), (2, -1.0, 0.5, 4.0)], "pid long, cx double, cy double, cz double")
    for name, v in (("fx", 500.0), ("fy", 510.0), ("ox", 320.0), ("oy", 240.0), ("k1", -0.05)):
        rows = rows.withColumn(name, F.lit(v))
    for r in solids.unprojected(solids.pinhole(rows), 8).collect():
        want = np.array([r["cx"], r["cy"], r["cz"]]) / np.linalg.norm([r["cx"], r["cy"], r["cz"]])
        assert np.allclose([r["dx"], r["dy"], r["dz"]], want, atol=1e-6)


# ------------------------------------------------------------ searches that change their way with the size


@pytest.mark.parametrize("few", [0, 30, 2_048])
def test_nearest_neighbours_either_way(spark, monkeypatch, few):
    from cloudloom.operators import points

    monkeypatch.setattr(points, "FEW", few)
    r = np.random.default_rng(13)
    p = np.vstack([r.normal(0, 0.1, (200, 3)), r.uniform(-3, 3, (60, 3)), [[0.0, 0, 0]] * 3])
    d = ((p[:, None] - p[None]) ** 2).sum(axis=2)
    np.fill_diagonal(d, np.inf)
    want = {(i, int(j)): k + 1 for i in range(len(p)) for k, j in enumerate(np.lexsort((np.arange(len(p)), d[i]))[:5])}
    own = cloud(spark, p)
    got = {(x["pid"], x["nid"]): x["rk"] for x in points.knn(own, own, 5, 0.2, skip_self=True).collect()}
    assert got == want
    assert points.knn(own.limit(0), own, 5, 0.2).count() == 0 and points.knn(own.limit(2), own.limit(0), 5, 0.2).count() == 0


@pytest.mark.parametrize("few", [0, 2_048])
def test_distance_to_faces_either_way(spark, monkeypatch, few):
    from cloudloom.operators import mesh

    monkeypatch.setattr(mesh, "FEW", few)
    items = spark.createDataFrame([(0, 0.0, 0.0, 0.0, 1.0, 1.0, 1.0), (1, 4.0, 0.0, 0.0, 5.0, 1.0, 1.0)], "item long, x0 double, y0 double, z0 double, x1 double, y1 double, z1 double")
    faces, vertices = solids.boxes(items)
    r = np.random.default_rng(14)
    p = r.uniform(-1, 6, (80, 3))

    def away(q, low):
        inside = np.minimum(q - [low, 0, 0], [low + 1, 1, 1] - q)
        out = np.maximum(-inside, 0)
        return -inside.min() if (inside > 0).all() else np.linalg.norm(out)

    got = {x["pid"]: x["d"] for x in mesh.signed_distance(cloud(spark, p), corners(faces, vertices)).collect()}
    for i, q in enumerate(p):
        want = min((away(q, low) for low in (0.0, 4.0)), key=abs)
        assert abs(got[i]) == pytest.approx(abs(want), abs=1e-9) and (want > 0 or got[i] <= 0)
    assert mesh.signed_distance(cloud(spark, p).limit(0), corners(faces, vertices)).count() == 0


# ------------------------------------------------------------ end to end


def test_a_box_is_rebuilt_closed(spark):
    from cloudloom.operators import mesh
    from cloudloom.plans import reconstruct

    r = np.random.default_rng(21)
    size, rows = np.array([4.0, 3.0, 2.5]), []
    for axis in range(3):
        for side in (0, 1):
            rest = [k for k in range(3) if k != axis]
            # a scanner's even grid, jittered
            grid = np.stack(np.meshgrid(*[np.arange(0.05, size[k], 0.1) for k in rest]), -1).reshape(-1, 2)
            p = np.zeros((len(grid), 3))
            p[:, rest] = grid + r.uniform(-0.03, 0.03, grid.shape)
            p[:, axis] = side * size[axis] + r.normal(0, 0.004, len(grid))
            rows.append(p)
    points = cloud(spark, np.vstack(rows))
    found, _, spacing = reconstruct.surfaces(points, reconstruct.settings(voxel_size=0.0, distance_threshold=0.02, edge_artifact_filter=False))
    assert sorted(x["class"] for x in found.collect()) == ["ceiling", "floor", "wall", "wall", "wall", "wall"]
    tri = reconstruct.surface_mesh(found)
    assert mesh.signed_volume(tri).first()["volume"] == pytest.approx(30, rel=0.01)
    ends = {tuple(round(v, 6) for v in e) for x in tri.collect() for e in ((x["ax"], x["ay"], x["az"]), (x["bx"], x["by"], x["bz"]), (x["cx"], x["cy"], x["cz"]))}
    true = np.array(list(np.ndindex(2, 2, 2))) * size
    # eight corners, each within 3 cm, shared exactly by the faces that meet there
    assert len(ends) == 8 and all(np.linalg.norm(true - e, axis=1).min() < 0.03 for e in np.array(sorted(ends)))
    name, scores = reconstruct.tune(points, {"fine": reconstruct.settings(voxel_size=0.0, distance_threshold=0.02, edge_artifact_filter=False)})
    assert name == "fine" and scores["fine"]["unexplained"] < 0.02 and scores["fine"]["surfaces"] == 6
