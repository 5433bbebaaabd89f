"""Long tracks, matched walks, pylons and cables against numpy and known scenes."""

import math
import random

import numpy as np
import pytest

from cloudloom.operators import bridges, paths

TRACK = "t double, x double, y double, z double"


def test_values_between_rows_of_a_cut_track(spark):
    r = random.Random(2)
    times = sorted({round(r.uniform(0, 1_000), 3) for _ in range(400)} - {x / 10 for x in range(3_000, 5_000)})
    rows = [(t, math.sin(t), r.random()) for t in times if not 300 < t < 500]
    asked = [r.uniform(-50, 1_050) for _ in range(300)] + [rows[0][0], rows[-1][0], rows[40][0], rows[40][0], 400.0]
    track = spark.createDataFrame([*rows, (None, 1.0, 1.0), (700.0, None, 1.0)], "t double, a double, b double").repartition(5)
    at = spark.createDataFrame([(k, t, "x") for k, t in enumerate(asked)], "id long, t double, __k string")
    for cut in (7.0, 100.0, 1e6):
        got = {x["id"]: x for x in paths.between(track, at, ["a", "b"], cut).collect()}
        assert len(got) == len(asked) and all(x["__k"] == "x" for x in got.values())
        for i, c in ((1, "a"), (2, "b")):
            want = np.interp(asked, [x[0] for x in rows], [x[i] for x in rows])
            assert [got[k][c] for k in range(len(asked))] == pytest.approx(want.tolist(), abs=1e-9)
    none = paths.between(track.where("false"), at, ["a", "b"], 5.0).collect()
    assert len(none) == len(asked) and all(x["a"] is None for x in none)


def test_lengths_along_a_cut_track(spark):
    r = random.Random(3)
    rows = sorted((r.choice([r.uniform(0, 100), float(r.randint(0, 20))]), r.random(), r.random()) for _ in range(500))
    track = spark.createDataFrame(rows, "t double, x double, y double").repartition(6)
    at = np.array(rows)[:, 1:]
    want = np.concatenate(([0], np.cumsum(np.sqrt((np.diff(at, axis=0) ** 2).sum(axis=1)))))
    for cut in (3.0, 1e6):
        got = sorted((x["t"], x["x"], x["y"], x["s"]) for x in paths.lengths(track, ["x", "y"], cut).collect())
        assert [x[:3] for x in got] == rows and [x[3] for x in got] == pytest.approx(want.tolist())
    assert paths.lengths(track.where("false"), ["x", "y"], 3.0).count() == 0


def walk(t):
    return 30 * math.cos(t / 40) + t / 8, 20 * math.sin(t / 23), 1 + math.sin(t / 11)


@pytest.mark.parametrize(("label", "move", "scale"), [("time", 0.0, 1.0), ("time from start, scaled", -77.0, 0.5), ("way backwards", None, 1.0)])
def test_the_pairing_that_fits_is_found(spark, label, move, scale):
    track = [(float(t), *walk(t)) for t in range(0, 300)]
    way = [walk(t) for t in range(0, 300)]
    photos = []
    for k in range(0, 300, 4):
        x, y, z = way[k]
        # turned by 90 degrees about z, moved, and scaled
        spot = (100 + y * scale, -x * scale, 7 + z * scale)
        photos.append((k + move if move is not None else float(900 - 3 * k), *spot))
    if move is None:  # the last photo stands where the walk begins, and the ends of both are the same
        x, y, z = way[299]
        photos.append((900.0 - 3 * 299, 100 + y, -x, 7 + z))
    found = paths.match(spark.createDataFrame(photos, TRACK), spark.createDataFrame(track, TRACK), 40.0)
    # lengths of a walk told by fewer photos are a little shorter, so the scaled fit may be the better one
    assert found.label.removesuffix(", scaled") == label.removesuffix(", scaled")
    assert found.applied and found.residual < 0.15 and found.scale == pytest.approx(1 / scale, rel=1e-2)
    assert len(found.residuals) >= 4 and min(found.residuals.values()) == found.residual
    moved = found.scale * found.turn @ np.array(photos[5][1:]) + found.shift
    assert moved == pytest.approx(way[20], abs=0.3)


def test_walks_that_do_not_match(spark):
    r = random.Random(1)
    track = spark.createDataFrame([(float(t), *walk(t)) for t in range(300)], TRACK)
    noise = spark.createDataFrame([(float(t), r.uniform(0, 50), r.uniform(0, 50), r.uniform(0, 50)) for t in range(60)], TRACK)
    found = paths.match(noise, track, 40.0)
    assert found is not None and not found.applied
    assert paths.match(noise.limit(3), track, 40.0) is None and paths.match(noise, track.where("false"), 40.0) is None


def test_pylons_stand_apart_from_cables(spark):
    r = random.Random(5)
    rows = []
    for x0 in (0.0, 30.0):
        for _ in range(3_000):
            u, side = r.uniform(-0.7, 0.7), r.choice([-0.7, 0.7])
            x, y = (x0 + side, u) if r.random() < 0.5 else (x0 + u, side)
            rows.append((x, y, r.uniform(0, 15)))
    ends = [((2.0, 0.0, 14.0), (12.0, 0.0, 1.0)), ((28.0, 0.0, 14.0), (18.0, 0.0, 1.0)), ((-2.0, 0.2, 14.0), (-12.0, 0.2, 1.0))]
    for a, b in ends:
        rows += [tuple(p + s * (q - p) + r.gauss(0, 0.01) for p, q in zip(a, b, strict=True)) for s in (r.random() for _ in range(400))]
    rows += [(r.uniform(-15, 45), r.uniform(-5, 5), r.gauss(0, 0.05)) for _ in range(800)]
    df = spark.createDataFrame([(k, *x) for k, x in enumerate(rows)] + [(-1, None, 1.0, 1.0)], "pid long, x double, y double, z double")
    found, cells = bridges.pylons(df, 0.5, 10.0)
    got = sorted(found.collect(), key=lambda x: x["x"])
    assert [round(x["x"]) for x in got] == [0, 30] and all(x["z1"] - x["z0"] > 14 and x["cells"] >= 8 for x in got)
    lines = bridges.cables(bridges.beside(df, cells, 0.5), 0.1, 4.0, 0.4, 1.0).collect()
    assert len(lines) == 3 and {min(range(3), key=lambda k: abs((x["sx"] + x["ex"]) / 2 - (ends[k][0][0] + ends[k][1][0]) / 2)) for x in lines} == {0, 1, 2}
    tilt = math.degrees(math.atan2(10, 13))
    assert all(x["inclination_deg"] == pytest.approx(tilt, abs=0.5) and x["n"] > 380 and x["length"] == pytest.approx(0.98 * math.hypot(10, 13), abs=0.3) for x in lines)
    assert bridges.pylons(df.where("z < 1"), 0.5, 10.0)[0].count() == 0 and bridges.cables(df.where("pid < 5"), 0.1, 4.0, 0.4, 1.0).count() == 0


def test_supports_in_the_frame_of_a_turned_deck(spark):
    """A deck turned by 30 degrees over two piers and an abutment, above a wide embankment; stations run along it."""
    r = random.Random(8)
    c, s = math.cos(math.radians(30)), math.sin(math.radians(30))
    rows = [(0, r.uniform(-30, 30), r.uniform(-3, 3), 10 + r.gauss(0, 0.01)) for _ in range(4_000)]
    rows += [(1, r.uniform(-8, 8), r.uniform(-8, 8), 30.0) for _ in range(900)]  # level, but not long
    for k, (x, wide) in enumerate(((-10.0, 1.0), (10.0, 1.0), (29.0, 2.5))):
        rows += [(2 + k, x + r.uniform(-0.4, 0.4), r.uniform(-wide, wide), r.uniform(0, 8.5)) for _ in range(1_500)]
    df = spark.createDataFrame([(7, p, c * x - s * y, s * x + c * y, z) for p, x, y, z in rows] + [(7, 0, None, 1.0, 1.0)], "pid long, plane_id long, x double, y double, z double")
    found = bridges.deck(df)
    assert found.plane_id == 0 and found.length == pytest.approx(60, abs=1) and found.width == pytest.approx(6, abs=0.3) and found.elevation == pytest.approx(10, abs=0.05)
    assert abs(found.axis[0] * c + found.axis[1] * s) == pytest.approx(1, abs=1e-3)
    got = sorted(bridges.substructure(df, found, 0.15).collect(), key=lambda x: abs(x["station"]))
    assert [x["kind"] for x in got] == ["pier", "pier", "abutment"] and sorted(round(x["station"]) for x in got[:2]) == [-10, 10]
    assert all(x["height"] == pytest.approx(8.5, abs=0.1) and x["bearing_z"] > 7.9 for x in got)
    spans = sorted(x["span"] for x in bridges.fields(bridges.substructure(df, found, 0.15), found).collect())
    assert spans == pytest.approx([20, 20, 20], abs=1.2)
    assert bridges.deck(df.where("plane_id = 1")) is None and bridges.substructure(df.where("plane_id = 0"), found, 0.15).count() == 0


def test_types_of_bridges():
    assert bridges.kind(1, 2, [30.0], 3) == "arch" and bridges.kind(0, 2, [40.0, 50.0], 0) == "cable-stayed"
    assert bridges.kind(0, 2, [10.0, 5.0, 40.0], 0) == "suspension" and bridges.kind(0, 0, [], 2) == "girder" and bridges.kind(0, 0, [], 0) == "single span"
