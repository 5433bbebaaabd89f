"""Minimum cuts, closed models, skins, budget thinning, carving: against brute force and known scenes."""

import itertools
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cloudloom.operators import flow, holes, mesh, parts, planes, points, scene, skin, thinning, visibility, watertight
from cloudloom.operators.points import XYZ

CLOUD = "pid long, x double, y double, z double"


# ------------------------------------------------------------ minimum cuts


def least_cost(nodes, edges):
    """Cost of the best of all ways to put nodes inside, and the fewest inside among them."""
    best = None
    for inside in itertools.product((False, True), repeat=len(nodes)):
        on = dict(zip(nodes, inside, strict=True))
        cost = sum(g if g > 0 and not on[n] else -g if g < 0 and on[n] else 0 for n, g in nodes.items())
        cost += sum(c for a, b, c in edges if on[a] != on[b])
        best = min(best or (cost, sum(inside)), (cost, sum(inside)))
    return best


@pytest.mark.parametrize("seed", range(4))
def test_cuts_cost_least(spark, seed):
    r = random.Random(seed)
    names = [f"n{i}" for i in range(9)]
    nodes = {n: r.choice([0, 0, r.randint(-9, 9), r.randint(-30, 30)]) for n in names}
    edges = [(*r.sample(names, 2), r.randint(1, 9)) for _ in range(16)]
    rows = spark.createDataFrame(list(nodes.items()), "node string, gain long")
    got = flow.min_cut(rows, spark.createDataFrame([*edges, (None, "n1", 5), ("n1", "n1", 5), ("n2", "n3", 0)], "a string, b string, capacity long")).collect()
    on = {x["node"]: x["inside"] for x in got}
    cost = sum(g if g > 0 and not on[n] else -g if g < 0 and on[n] else 0 for n, g in nodes.items()) + sum(c for a, b, c in edges if on[a] != on[b])
    assert set(on) == set(names) and (cost, sum(on.values())) == least_cost(nodes, edges)


def test_cuts_of_nothing(spark):
    none = spark.createDataFrame([], "a string, b string, capacity long")
    assert flow.min_cut(spark.createDataFrame([], "node string, gain long"), none).collect() == []
    got = flow.min_cut(spark.createDataFrame([("a", 3), ("b", -1), ("c", 0)], "node string, gain long"), none).collect()
    assert {r["node"]: r["inside"] for r in got} == {"a": True, "b": False, "c": False}


# ------------------------------------------------------------ closed models


def wall(r, plane_id, corner, u, v, n):
    """Points of a rectangle with noise across it."""
    across = np.cross(u, v)
    across = across / np.linalg.norm(across)
    return [(plane_id, *map(float, np.array(corner) + r.random() * np.array(u) + r.random() * np.array(v) + r.gauss(0, 0.002) * across)) for _ in range(n)]


def test_an_l_shaped_room_closes_without_a_wall_and_half_its_ceiling(spark):
    """The reentrant corner, where the middle of the room says nothing about the inside; area and volume of the model."""
    r = random.Random(2)
    outline = [(0, 0), (4, 0), (4, 1.5), (2, 1.5), (2, 3), (0, 3)]
    rows, k = [], 0
    for (x0, y0), (x1, y1) in zip(outline, outline[1:] + outline[:1], strict=True):
        rows += wall(r, k, (x0, y0, 0), (x1 - x0, y1 - y0, 0), (0, 0, 2.5), 500)
        k += 1
    for z in (0.0, 2.5):
        rows += wall(r, k, (0, 0, z), (4, 0, 0), (0, 1.5, 0), 500 if z == 0 else 250)
        rows += wall(r, k, (0, 1.5, z), (2, 0, 0), (0, 1.5, 0), 300 if z == 0 else 0)
        k += 1
    df = spark.createDataFrame([*rows, (0, None, 1.0, 1.0), (None, 1.0, 1.0, 1.0)], "plane_id long, x double, y double, z double")
    facets, cells = watertight.close(df.dropna(), planes.fit_planes(df.dropna()), 0.25)
    faces, vertices = watertight.as_mesh(facets)
    assert mesh.edge_stats(faces).first()["boundary"] == 0
    assert mesh.signed_volume(mesh.corners(faces, vertices)).first()["volume"] == pytest.approx(9 * 2.5, rel=1e-3)
    assert facets.groupBy("plane_id").count().count() == 8
    area = {x["plane_id"]: x["a"] for x in facets.groupBy("plane_id").agg(F.sum("area").alias("a")).collect()}
    assert area[7] == pytest.approx(9, rel=1e-3) and area[2] == pytest.approx(2 * 2.5, rel=1e-2)
    assert cells.where("inside").count() >= 2


def test_arrangements_fill_their_box(spark):
    """Facets of a plane cover its section of the box; planes through one place are shifted apart."""
    r = random.Random(5)
    pts = spark.createDataFrame([(i, *[r.uniform(-1, 1) for _ in range(3)]) for i in range(50)], CLOUD)
    rows = [(0, 1.0, 0.0, 0.0, 0.0), (1, 0.0, 1.0, 0.0, 0.0), (2, 0.0, 0.0, 1.0, 0.0), (3, *[1 / math.sqrt(3)] * 3, 0.0), (4, 0.6, 0.8, 0.0, 0.1)]
    room = watertight.arrange(pts, spark.createDataFrame(rows, "plane_id long, nx double, ny double, nz double, d double"))
    box = points.extent(pts).first()
    grow = 0.05 * math.sqrt(sum((box[f"{c}_max"] - box[f"{c}_min"]) ** 2 for c in XYZ))
    side = {c: box[f"{c}_max"] - box[f"{c}_min"] + 2 * grow for c in XYZ}
    area = {x["plane_id"]: x["a"] for x in room.facets.groupBy("plane_id").agg(F.sum("area").alias("a")).collect()}
    assert area[0] == pytest.approx(side["y"] * side["z"], rel=1e-4) and area[1] == pytest.approx(side["x"] * side["z"], rel=1e-4)
    # cells of an arrangement in general position: all sides that some place of the box has
    grid = np.stack(np.meshgrid(*[np.linspace(box[f"{c}_min"] - grow, box[f"{c}_max"] + grow, 60)[1:-1] for c in XYZ]), -1).reshape(-1, 3)
    seen = {"".join("1" if grid[k] @ np.array(p[1:4]) + p[4] > 0 else "0" for p in room.planes) for k in range(len(grid))}
    assert seen <= {x["name"] for x in room.cells.collect()}


def test_too_few_or_too_many_planes(spark):
    pts = spark.createDataFrame([(0, 0.0, 0.0, 0.0)], CLOUD)
    few = spark.createDataFrame([(i, 1.0, 0.0, 0.0, float(i)) for i in range(40)], "plane_id long, nx double, ny double, nz double, d double")
    for n in (3, 40):
        with pytest.raises(ValueError):
            watertight.arrange(pts, few.limit(n))


# ------------------------------------------------------------ thinning


def test_cells_of_all_levels_and_the_points_they_keep(spark):
    r = random.Random(8)
    rows = [(i, r.gauss(0, 1), r.gauss(0, 0.2), r.choice([0.0, 1.0]) + r.random() * 0.01) for i in range(3_000)]
    rows += [(5_000 + i, *rows[i][1:]) for i in range(500)] + [(9_000, None, 0.0, 0.0), (None, *rows[7][1:])]
    df = spark.createDataFrame([(*x, "t") for x in rows], CLOUD + ", __cell string").repartition(7)
    at = thinning.cube(df.dropna(subset=list(XYZ)))
    coded = df.dropna(subset=list(XYZ)).select(*XYZ, thinning.morton(df, *at).alias("code"))
    codes = [x["code"] for x in coded.collect()]
    low, size = at
    for x in coded.collect():
        cells = [min(int((x[c] - a) / size * (1 << 21)), (1 << 21) - 1) for c, a in zip(XYZ, low, strict=True)]
        assert x["code"] == sum(((cells[a] >> b) & 1) << (3 * b + 2 - a) for a in range(3) for b in range(21))
    want = [len({c >> (63 - k) for c in codes}) for k in range(64)]
    assert thinning.cells_by_level(coded.select("code")) == want
    for target in (1, 10, 300, 1_000, 2_500):
        got = thinning.budget_points(df, target)
        kept = got.collect()
        assert got.columns == df.columns and 0.7 * target <= len(kept) <= target
        assert len({tuple(x) for x in kept}) == len(kept) and {tuple(x) for x in kept} <= {(*x, "t") for x in rows}
    assert thinning.budget_points(df, 10_000).count() == want[-1]
    assert thinning.budget_points(df, 0).count() == thinning.budget_points(df.where("false"), 5).count() == 0
    assert thinning.budget_points(df.where("pid = 3"), 5).count() == 1


# ------------------------------------------------------------ skins


def sphere(n, radius=1.0, seed=1):
    r = random.Random(seed)
    out = []
    for i in range(n):
        v = [r.gauss(0, 1) for _ in range(3)]
        s = math.sqrt(sum(x * x for x in v))
        out.append((i, *[radius * x / s for x in v]))
    return out


def edge_counts(faces):
    n = Counter()
    for f in faces:
        for a, b in ((f["a"], f["b"]), (f["b"], f["c"]), (f["c"], f["a"])):
            n[min(a, b), max(a, b)] += 1
    return n


def test_the_skin_of_a_closed_cloud_has_two_faces_at_every_edge(spark):
    df = spark.createDataFrame([*sphere(9_000), *[(20_000 + i, 5.0 + 0.001 * i, 0.0, 0.0) for i in range(40)], (30_000, None, 1.0, 1.0)], CLOUD)
    faces, vertices, facts = skin.free_form(df, 0.03)
    assert facts["pieces"] == 1 and set(edge_counts(faces.collect()).values()) == {2}
    at = {v["vid"]: np.array([v["x"], v["y"], v["z"]]) for v in vertices.collect()}
    # drawn to the scan: a shell about as thick as a voxel around the sphere
    off = [abs(np.linalg.norm(p) - 1) for p in at.values()]
    assert max(off) < 1.5 * facts["voxel"] and np.mean(off) < 0.5 * facts["voxel"]


def test_edges_that_cells_share_alone_are_filled(spark):
    r = random.Random(3)
    cells = {tuple(r.randrange(5) for _ in range(3)) for _ in range(45)}
    df = spark.createDataFrame(sorted(cells), "cx long, cy long, cz long")
    filled = skin.joined_edges(df)
    faces, vertices = skin.shell(filled, 1.0)
    assert set(edge_counts(faces.collect()).values()) == {2}
    got = {tuple(x) for x in filled.select("cx", "cy", "cz").collect()}
    assert cells <= got and mesh.signed_volume(mesh.corners(faces, vertices)).first()["volume"] == pytest.approx(len(got))
    plain = edge_counts(skin.shell(df, 1.0)[0].collect())
    assert set(plain.values()) <= {2, 4} and 4 in plain.values()
    assert skin.shell(df.where("false"), 1.0)[0].count() == 0


# ------------------------------------------------------------ carving


def slow_carved(pts, views, least=3):
    """Votes view by view and point by point."""
    passed, held = Counter(), Counter()
    span = math.log(120.0) - math.log(0.8)
    for v in views:
        cells = defaultdict(list)
        for pid, *p in pts:
            d = [a - b for a, b in zip(p, v, strict=True)]
            r = math.sqrt(sum(x * x for x in d))
            if 0.8 < r < 120:
                az = min(int((math.atan2(d[1], d[0]) + math.pi) / (2 * math.pi) * 512), 511)
                el = min(int((math.asin(max(-1, min(1, d[2] / r))) + math.pi / 2) / math.pi * 160), 159)
                cells[az, el].append((min(int((math.log(r) - math.log(0.8)) / span * 96), 95), r, pid))
        for own in cells.values():
            if len(own) >= 6:
                bucket = sorted(b for b, _, _ in own)[max(0, int(len(own) * 0.6) - 1)]
                far = math.exp(math.log(0.8) + bucket / 96 * span)
                for _, r, pid in own:
                    passed[pid] += r < far - max(0.25, 0.05 * far)
                    held[pid] += abs(r - far) <= max(0.1 + 0.02 * far, 0.12)
    return {pid: (passed[pid], held[pid], passed[pid] >= least and passed[pid] > 2 * held[pid]) for pid, *_ in pts}


def test_points_that_many_views_pass_are_ghosts(spark):
    r = random.Random(4)
    # a wall seen from a track, and a ghost that hangs before it
    pts = [(i, 10.0 + r.gauss(0, 0.01), r.uniform(-4, 4), r.uniform(-1, 1)) for i in range(9_000)] + [(9_000 + i, 6.0, r.uniform(0, 0.4), 0.3) for i in range(12)]
    track = [(k, 0.0, -3 + 0.05 * k, 0.0) for k in range(130)]
    df, way = spark.createDataFrame([*pts, (1 << 40, None, 0.0, 0.0)], CLOUD).repartition(5), spark.createDataFrame(track, CLOUD).repartition(3)
    views = scene.spread_views(way)
    assert views == [tuple(track[int(k * 129 / 109)][1:]) for k in range(110)]
    got = {x["pid"]: (x["passed"], x["held"], x["ghost"]) for x in scene.carve_views(df, way).collect()}
    assert got == slow_carved(pts, views)
    assert all(got[9_000 + i][2] for i in range(12)) and sum(g for *_, g in got.values()) < 20
    assert not any(x["ghost"] for x in scene.carve_views(df, way.where("false")).collect())


# ------------------------------------------------------------ nearest neighbours


def test_neighbours_where_a_cell_holds_most_points(spark):
    """A dense clump, lone points far off, equal places, fewer points than asked for."""
    r = random.Random(6)
    rows = [(i, r.gauss(0, 0.01), r.gauss(0, 0.01), r.gauss(0, 0.01)) for i in range(1_500)]
    rows += [(2_000 + i, r.uniform(-50, 50), r.uniform(-50, 50), r.uniform(0, 3)) for i in range(300)] + [(3_000 + i, 1.0, 1.0, 1.0) for i in range(40)]
    df = spark.createDataFrame([*rows, (9_999, float("nan"), 0.0, 0.0), (9_998, None, 0.0, 0.0)], CLOUD)
    at, ids = np.array([x[1:] for x in rows]), np.array([x[0] for x in rows])
    got = defaultdict(list)
    for x in points.knn(df, df, 5, 1.0, skip_self=True).collect():
        got[x["pid"]].append((x["rk"], x["nid"], x["d2"]))
    assert set(got) == set(ids.tolist())
    for k, pid in enumerate(ids.tolist()):
        d = at - at[k]
        d2 = d[:, 0] * d[:, 0] + d[:, 1] * d[:, 1] + d[:, 2] * d[:, 2]
        d2[k] = np.inf
        order = np.lexsort((ids, d2))[:5]
        assert [(n, nid) for n, nid, _ in sorted(got[pid])] == [(n + 1, ids[o]) for n, o in enumerate(order.tolist())]
    few = df.where("pid in (2000, 2001, 3000)")
    assert points.knn(df.where("pid >= 2000 and pid < 2100"), few, 9, 1.0).groupBy("pid").count().where("count <> 3").count() == 0


# ------------------------------------------------------------ cameras, loops, cones


def looking_down(cam_id, x, y, z):
    """A camera at a place that looks straight down, 200 x 150 pixels."""
    return (cam_id, 1.0, 0.0, 0.0, 0.0, -1.0, 0.0, 0.0, 0.0, -1.0, -x, y, z, 60.0, 60.0, 100.0, 75.0, 0.0, 200, 150)


CAMERA = ", ".join(f"{c} {'long' if c == 'cam_id' else 'int' if c in ('width', 'height') else 'double'}" for c in visibility.COLUMNS)


def sheet(first, x0, x1, z, step=0.25):
    """A level sheet of triangles from x0 to x1, 4 deep."""
    nx, ny = round((x1 - x0) / step), round(4 / step)
    v = [(first + j * (nx + 1) + i, x0 + i * step, j * step, z) for j in range(ny + 1) for i in range(nx + 1)]
    f = []
    for j in range(ny):
        for i in range(nx):
            a = first + j * (nx + 1) + i
            f += [(a, a + 1, a + nx + 2), (a, a + nx + 2, a + nx + 1)]
    return v, f


def test_hidden_faces_get_another_camera(spark):
    """A roof hides the floor below it from the camera above; the camera at its side sees under it."""
    v0, f0 = sheet(0, 0.0, 8.0, 0.0)
    v1, f1 = sheet(10_000, 2.0, 6.0, 3.0)
    vertices = spark.createDataFrame([*v0, *v1], "vid long, x double, y double, z double")
    faces = spark.createDataFrame([(k, *f, 0) for k, f in enumerate(f0 + f1)], "fid long, a long, b long, c long, group_id int")
    cams = spark.createDataFrame([looking_down(1, 4.0, 2.0, 8.0), looking_down(2, 1.0, 2.0, 2.0)], CAMERA)
    centres = visibility.face_centres(faces, vertices)
    seen = {r["id"]: (r["cam_id"], r["score"]) for r in visibility.seen_by(centres, vertices, cams, wide=20).collect()}
    at = {r["id"]: r for r in centres.collect()}
    assert len(seen) == len(f0 + f1)
    assert all(seen[k][0] == 1 for k in range(len(f0), len(f0 + f1)))
    under = [k for k in range(len(f0)) if 2.6 < at[k]["x"] < 5.4]
    assert under and all(seen[k][0] != 1 for k in under) and any(seen[k][0] == 2 for k in under) and any(seen[k] == (None, None) for k in under)
    assert all(seen[k][0] is not None for k in range(len(f0)) if at[k]["x"] < 0.9)
    one = visibility.seen_by(centres, vertices, cams, wide=20, most_used=1).groupBy("cam_id").count().collect()
    assert len([r for r in one if r["cam_id"] is not None]) == 1
    none = visibility.seen_by(centres, vertices, cams.where("false"), wide=20)
    assert none.where("cam_id is not null or score is not null").count() == 0 and none.count() == len(seen)
    # a lone face among others takes theirs
    choice = spark.createDataFrame([(k, None if k == 5 else 2 if k == 40 else 1) for k in range(len(f0))], "id long, cam_id long")
    got = {r["id"]: r["cam_id"] for r in visibility.voted(faces.where(F.col("fid") < len(f0)), choice).collect()}
    assert got[40] == 1 and got[5] is None and len(got) == len(f0)


def test_buffers_sent_in_parts_see_the_same(spark, monkeypatch):
    v0, f0 = sheet(0, 0.0, 8.0, 0.0)
    vertices = spark.createDataFrame(v0, "vid long, x double, y double, z double")
    faces = spark.createDataFrame([(k, *f, 0) for k, f in enumerate(f0)], "fid long, a long, b long, c long, group_id int")
    cams = spark.createDataFrame([looking_down(k, 0.5 * k, 2.0, 3.0 + k % 3) for k in range(7)], CAMERA)
    centres = visibility.face_centres(faces, vertices)
    whole = sorted(tuple(r) for r in visibility.seen_by(centres, vertices, cams, wide=20).collect())
    monkeypatch.setattr(visibility, "MOST_PIXELS", 700)
    assert sorted(tuple(r) for r in visibility.seen_by(centres, vertices, cams, wide=20).collect()) == whole


def test_loops_of_any_length_and_what_breaks_them(spark):
    v, f = sheet(0, 0.0, 8.0, 0.0)
    r = random.Random(4)
    # a hole of one square, one of two, two that touch in a corner, and the rim
    gone = {(3, 3), (8, 8), (9, 8), (20, 5), (21, 6)}
    kept = [t for k, t in enumerate(f) if (k // 2 % 32, k // 64) not in gone]
    faces = spark.createDataFrame([(k, *t) for k, t in enumerate(r.sample(kept, len(kept)))], "fid long, a long, b long, c long")
    rows = holes.loops(faces).collect()
    rings = {}
    for x in sorted(rows, key=lambda x: x["place"]):
        rings.setdefault(x["loop"], []).append(x["vid"])
        assert x["n"] == sum(y["loop"] == x["loop"] for y in rows)
    assert sorted(map(len, rings.values())) == [4, 6, 96]
    sides = {(b, a) for t in kept for a, b in ((t[0], t[1]), (t[1], t[2]), (t[2], t[0]))}
    for loop, ring in rings.items():
        assert ring[0] == loop == min(ring) and all((a, b) in sides for a, b in zip(ring, ring[1:] + ring[:1], strict=True))
    level = spark.createDataFrame([(0, 0.0, 0.0, 1.0, 0.0, 0.0, 8.0, 0.0, 4.0, 0.0, 0.0)], "plane_id long, nx double, ny double, nz double, d double, x0 double, x1 double, y0 double, y1 double, z0 double, z1 double")
    vertices = spark.createDataFrame(v, "vid long, x double, y double, z double")
    fans, middles, closed = holes.close_planar(faces, vertices, level)
    assert closed.count() == 2 and fans.count() == 10 and sorted(x["vid"] for x in middles.collect()) == [max(x[0] for x in v) + 1, max(x[0] for x in v) + 2]
    whole = faces.select("a", "b", "c").unionByName(fans.select("a", "b", "c"))
    assert holes.loops(whole).groupBy("loop").count().count() == 1
    # the fans turn as the mesh does: an edge runs once in either direction
    half = Counter((p, q) for t in whole.collect() for p, q in ((t[0], t[1]), (t[1], t[2]), (t[2], t[0])))
    assert set(half.values()) == {1}
    assert holes.loops(faces.where("false")).count() == 0


def test_cones_from_points_and_normals(spark):
    r = random.Random(3)
    rows = []
    for k in range(2_400):
        h, t, half = r.uniform(1, 3), r.uniform(0, 2 * math.pi), math.radians(25)
        q = h * math.tan(half)
        rows.append((k, q * math.cos(t), q * math.sin(t), -h + r.gauss(0, 0.001), math.cos(half) * math.cos(t), math.cos(half) * math.sin(t), math.sin(half)))
    rows += [(5_000 + k, r.uniform(-3, 3), r.uniform(-3, 3), -5.0, 0.0, 0.0, 1.0) for k in range(900)] + [(9_000, None, 0.0, 0.0, 0.0, 0.0, 1.0)]
    df = spark.createDataFrame(rows, CLOUD + ", nx double, ny double, nz double")
    found, owners = parts.detect_cones(df, 0.01, min_inliers=600, radius=0.4)
    (c,) = found.collect()
    assert abs(c["az"]) == pytest.approx(1, abs=1e-4) and c["half_deg"] == pytest.approx(25, abs=0.1) and abs(c["pz"]) < 0.01
    assert c["r_min"] == pytest.approx(math.tan(math.radians(25)), abs=0.02) and c["r_max"] == pytest.approx(3 * math.tan(math.radians(25)), abs=0.02)
    assert {x["pid"] for x in owners.collect()} <= set(range(2_400)) and owners.count() > 2_300
    assert parts.detect_cones(df.where("pid >= 5000"), 0.01, min_inliers=600)[0].count() == 0
