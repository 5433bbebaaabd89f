"""Charts, pages, texels and gains on small scenes, and their edge cases."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cloudloom.operators import textures

FACES = "fid long, a long, b long, c long, group_id int"


def strip(n, bend):
    """A strip of squares along x; after ``bend`` squares it rises straight up."""
    v, f = [], []
    for i in range(n + 1):
        x, z = (float(i), 0.0) if i <= bend else (float(bend), float(i - bend))
        v += [(2 * i, x, 0.0, z), (2 * i + 1, x, 1.0, z)]
    for i in range(n):
        a = 2 * i
        f += [(2 * i, a, a + 2, a + 3, 0), (2 * i + 1, a, a + 3, a + 1, 0)]
    return v, f


def test_small_charts_join_the_neighbour_of_the_longest_border(spark):
    v, f = strip(40, 36)
    vertices, faces = spark.createDataFrame(v, "vid long, x double, y double, z double"), spark.createDataFrame(f, FACES)
    apart = {r["fid"]: (r["chart"], r["bin"]) for r in textures.charts(faces, vertices, smooth=0, least=4).collect()}
    assert Counter(c for c, _ in apart.values()) == {0: 72, 72: 8} and {b for c, b in apart.values() if c == 0} == {4}
    assert {b for c, b in apart.values() if c == 72} == {1}
    joined = {r["fid"]: (r["chart"], r["bin"]) for r in textures.charts(faces, vertices, smooth=0, least=24).collect()}
    assert set(joined.values()) == {(0, 4)}
    # nothing to join where every chart is small
    assert len({r["chart"] for r in textures.charts(faces, vertices, smooth=0, least=1_000).collect()}) == 2
    assert textures.charts(faces.where("false"), vertices).count() == 0
    places = {r["chart"]: r for r in textures.chart_places(textures.charts(faces, vertices, 0, 4), faces, vertices).collect()}
    assert (places[0]["width"], places[0]["height"], places[0]["u0"]) == (36, 1, 0) and (places[72]["width"], places[72]["height"], places[72]["u0"]) == (1, 4, -1)


def test_charts_on_pages_never_overlap(spark):
    r = random.Random(3)
    rows = [(k, r.choice([r.uniform(0, 3), r.uniform(0, 40)]), r.choice([r.uniform(0, 2), r.uniform(0, 30)])) for k in range(400)] + [(900, 1e6, 1.0), (901, 0.0, 0.0)]
    df = spark.createDataFrame([*rows, (None, 1.0, 1.0), (902, None, 1.0)], "chart long, width double, height double")
    page, gutter = 256, 4
    got = textures.packed(df, 0.25, page, gutter).collect()
    assert len(got) == len(rows)
    used = defaultdict(lambda: np.zeros((page, page), int))
    for x in got:
        assert x["px"] >= gutter and x["py"] >= gutter and x["px"] + x["w"] + gutter <= page and x["py"] + x["h"] + gutter <= page
        used[x["page"]][x["py"] - gutter : x["py"] + x["h"] + gutter, x["px"] - gutter : x["px"] + x["w"] + gutter] += 1
    assert all(u.max() == 1 for u in used.values())
    assert next(x["w"] for x in got if x["chart"] == 900) == page - 2 * gutter
    assert textures.packed(df.where("false"), 0.25, page).count() == 0


def test_texels_of_a_face(spark):
    r = random.Random(1)
    rows = [(k, *[r.uniform(-3, 23) for _ in range(6)]) for k in range(40)] + [(100, 1.0, 1.0, 5.0, 5.0, 9.0, 9.0), (101, None, 1.0, 2.0, 2.0, 3.0, 1.0)]
    tri = spark.createDataFrame(rows, "fid long, au double, av double, bu double, bv double, cu double, cv double")
    got = defaultdict(dict)
    for x in textures.face_texels(tri, 20, 18).collect():
        got[x["fid"]][x["ix"], x["iy"]] = (x["b0"], x["b1"], x["b2"])
    for fid, au, av, bu, bv, cu, cv in rows[:40]:
        want = {}
        for iy in range(max(0, min(17, int(np.floor(min(av, bv, cv))))), max(0, min(17, int(np.ceil(max(av, bv, cv))))) + 1):
            for ix in range(max(0, min(19, int(np.floor(min(au, bu, cu))))), max(0, min(19, int(np.ceil(max(au, bu, cu))))) + 1):
                b1, b2 = np.linalg.solve([[bu - au, cu - au], [bv - av, cv - av]], [ix + 0.5 - au, iy + 0.5 - av])
                b = np.array([1 - b1 - b2, b1, b2])
                if b.min() >= -0.35:
                    b = b.clip(0, 1)
                    want[ix, iy] = tuple(b / b.sum())
        assert set(got[fid]) == set(want) and all(got[fid][k] == pytest.approx(want[k], abs=1e-6) for k in want)
    assert 100 not in got and 101 not in got


def test_colours_of_clouds_and_gains_of_cameras(spark):
    points = [(0.1, 0.1, 0.02, 10, 20, 30), (0.2, 0.3, -0.02, 30, 40, 50), (0.1, 0.1, 5.0, 1, 1, 1), (0.9, 0.9, 0.0, None, 1, 1), (1.5, 0.5, 0.0, 7, 8, 9), (9.0, 0.0, 0.0, 1, 1, 1)]
    df = spark.createDataFrame(points, "x double, y double, z double, r int, g int, b int")
    flat = spark.createDataFrame([(3, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 2.0, 1.0)], "plane_id long, ox double, oy double, oz double, ux double, uy double, uz double, vx double, vy double, vz double, u0 double, v0 double, u1 double, v1 double")
    got = sorted(tuple(x) for x in textures.cloud_texels(df, flat, 0.5, 0.1).collect())
    assert got == [(3, 0, 0, 2, 20.0, 30.0, 40.0), (3, 3, 1, 1, 7.0, 8.0, 9.0)]
    assert textures.cloud_texels(df, flat.where("false"), 0.5, 0.1).count() == 0
    shades = [(cam, 100, 100, 100, 100 * k, 100.0, None if i == 0 else 100.0) for cam, k in ((1, 0.5), (2, 1.0), (3, 4.0)) for i in range(50)] + [(4, 1, 1, 1, 1.0, 1.0, 1.0)]
    rows = {x["cam_id"]: x for x in textures.gains(spark.createDataFrame(shades, "cam_id long, r int, g int, b int, pr double, pg double, pb double")).collect()}
    assert set(rows) == {1, 2, 3} and rows[2]["r"] == 1 and rows[1]["r"] == 1.6 and rows[3]["r"] == 0.6 and rows[1]["g"] == 1
    alone = spark.createDataFrame([x for x in shades if x[0] == 1], "cam_id long, r int, g int, b int, pr double, pg double, pb double")
    assert textures.gains(alone).count() == 0


def test_texel_size_follows_the_nearest_cameras(spark):
    vertices = spark.createDataFrame([(k, float(k), 0.0, 0.0) for k in range(9)], "vid long, x double, y double, z double")
    centres = spark.createDataFrame([(0, 0.0, 0.0, 6.0)], "pid long, x double, y double, z double")
    far = float(np.percentile([np.hypot(k, 6.0) for k in range(9)], 25))
    assert textures.target_texel(vertices, centres, 500.0, 1.0) == pytest.approx(0.75 * far / 500)
    assert textures.target_texel(vertices, centres.where(F.lit(False)), 500.0, 1.0) == 0.01
    assert textures.target_texel(vertices, centres, 1.0, 1.0) == 0.025
