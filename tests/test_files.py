"""Readers and writers of models, poses and records."""

import json
import math
import re
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cloudloom.operators import mesh, records, solids
from cloudloom.plans import reconstruct
from cloudloom.sources import clouds, models, poses


@pytest.fixture(scope="module")
def box(spark):
    """Surfaces of a closed box with a hole in one face."""
    rows = []
    size = np.array([2.0, 3.0, 4.0])
    for k, (axis, side) in enumerate((a, s) for a in range(3) for s in (0, 1)):
        n = np.zeros(3)
        n[axis] = 1.0 if side else -1.0
        u, v = models._frame(n)
        corner = [np.array(c) * size for c in np.ndindex(2, 2, 2) if c[axis] == side]
        flat = [(float(c @ u), float(c @ v)) for c in corner]
        middle = np.mean(flat, axis=0)
        flat.sort(key=lambda p: math.atan2(p[1] - middle[1], p[0] - middle[0]))
        hole = [[(middle[0] + a, middle[1] + b) for a, b in ((-0.2, -0.2), (-0.2, 0.2), (0.2, 0.2), (0.2, -0.2))]] if k == 0 else []
        told = lambda loop: [{"u": float(a), "v": float(b)} for a, b in loop]
        kind = "wall" if axis < 2 else "ceiling" if side else "floor"
        rows.append((k, kind, *map(float, n), -float(n[axis] * side * size[axis]), told(flat), [told(h) for h in hole]))
    return spark.createDataFrame(rows, f"plane_id long, class string, nx double, ny double, nz double, d double, loop {reconstruct.shapes.LOOP}, holes array<{reconstruct.shapes.LOOP}>")


def references(text):
    """Every number an entity refers to is one that is there."""
    made = {int(x) for x in re.findall(r"^#(\d+)=", text, re.M)}
    assert {int(x) for x in re.findall(r"#(\d+)", text)} == made
    return text


def test_step_and_ifc(box):
    closed = references(models.step(box.withColumn("holes", F.slice("holes", 1, 0))))
    assert "MANIFOLD_SOLID_BREP" in closed and closed.count("ADVANCED_FACE(") == 6 and closed.count("EDGE_CURVE(") == 12 and closed.count("VERTEX_POINT(") == 8
    open_ = references(models.step(box))
    assert "SHELL_BASED_SURFACE_MODEL" in open_ and open_.count("FACE_BOUND(") == 1
    text = references(models.ifc(box, [0.0, 3.0]))
    assert text.count("IFCWALL(") == 4 and text.count("IFCSLAB(") == 1 and text.count("IFCCOVERING(") == 1 and text.count("IFCFACEBOUND(") == 1
    ids = re.findall(r"\('([0-9A-Za-z_$]{22})'", text)
    assert len(ids) == len(set(ids)) > 10 and all(i[0] in "0123" for i in ids) and models.ifc(box, [0.0, 3.0]) == text
    references(models.step(box.limit(0)))


def test_surface_mesh_volume(spark, box):
    tri = reconstruct.surface_mesh(box.withColumn("holes", F.slice("holes", 1, 0)))
    assert tri.count() == 12 and mesh.signed_volume(tri).first()["volume"] == pytest.approx(24)
    area = mesh.area(reconstruct.surface_mesh(box)).first()["area"]
    assert area == pytest.approx(2 * (6 + 8 + 12) - 0.16)


def test_glb_png_and_obj_parts(spark, tmp_path):
    items = spark.createDataFrame([(0, 0.0, 0.0, 0.0, 1.0, 2.0, 3.0)], "item long, x0 double, y0 double, z0 double, x1 double, y1 double, z1 double")
    faces, vertices = solids.boxes(items)
    models.write_glb(faces, vertices, str(tmp_path / "b.glb"))
    raw = (tmp_path / "b.glb").read_bytes()
    magic, version, length = struct.unpack_from("<4sII", raw)
    head = struct.unpack_from("<I", raw, 12)[0]
    scene = json.loads(raw[20 : 20 + head])
    assert (magic, version, length) == (b"glTF", 2, len(raw)) and scene["accessors"][0]["max"] == [1, 2, 3] and scene["accessors"][2]["count"] == 36
    image = np.arange(2 * 3 * 3, dtype=np.uint8).reshape(2, 3, 3)
    data = models.png(image)
    assert zlib.decompress(data[41:-16]) == b"".join(b"\0" + r.tobytes() for r in image.reshape(2, -1))
    models.write_obj_parts(faces, vertices, str(tmp_path / "o"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "o").glob("part-*")))
    assert text.count("v ") == 8 and text.count("f ") == 12 and text.index("v ") < text.index("f ") and "f 1 3 4" in text


def test_drawings_and_pages(spark):
    loop = np.array([[0, 0], [0.0, 2], [-1, 2], [-1, 0]])
    text = models.cut_drawing([("Plate 0 t=8mm", [loop], []), ("Part 1", [loop], [(loop[0], loop[2])])])
    assert text.count("POLYLINE") == 2 and text.count("\nVERTEX\n") == 8 and text.count("\nLINE\n") == 1 and "Plate 0 t=8mm" in text
    assert models.aligned(loop).max(axis=0).tolist() == pytest.approx([2, 1])
    df = spark.createDataFrame([("<a>", 3, 1, None)], "name string, h0 int, h1 int, x double")
    page = models.page("A & B", {"t": df}, {"i": np.zeros((1, 1, 3), np.uint8)})
    assert "&lt;a&gt;" in page and "3 (75.0 %)" in page and "A &amp; B" in page and "data:image/png;base64," in page
    assert json.loads(json.dumps(models.plain({"a": np.float64(1.5), 2: [np.int64(3), np.array([1, 2])]}))) == {"a": 1.5, "2": [3, [1, 2]]}


def test_poses(spark, tmp_path):
    def made(name, text):
        (tmp_path / name).write_text(text)
        return str(tmp_path / name)

    plain = poses.read_trajectory(spark, made("a.txt", "# path\n1 2 3\n4,5,6\n\nx y z\n")).orderBy("line").collect()
    assert [tuple(r)[1:] for r in plain] == [(1, 2, 3, None), (4, 5, 6, None)]
    first = poses.read_trajectory(spark, made("b.txt", "10 1 2 3 0 0 0\n11 1 5 3 0 0 0\n12 1 1 3 0 0 0\n")).orderBy("line").collect()
    assert [(r["x"], r["t"]) for r in first] == [(1, 10), (1, 11), (1, 12)]
    last = poses.read_trajectory(spark, made("c.txt", "5 1 2 0 0 7\n4 1 2 0 0 8\n6 1 2 0 0 9\n")).orderBy("line").collect()
    assert [(r["x"], r["t"]) for r in last] == [(5, 7), (4, 8), (6, 9)]
    with pytest.raises(ValueError):
        poses.read_trajectory(spark, made("d.txt", "nothing\n"))
    turned = poses.read_angles(spark, made("e.txt", "Index X Y Z Omega Phi Kappa\nimg1.jpg 1 2 3 0 1.5707963267948966 3\n7 8 9 0.1 0.2 0.3 img2.jpg\n")).orderBy("name").collect()
    assert [r["name"] for r in turned] == ["img1.jpg", "img2.jpg"] and turned[0]["phi"] == pytest.approx(90) and turned[1]["x"] == 7
    kept = poses.read_angles(spark, made("f.txt", "a.jpg 1 2 3 0 90 3\n")).first()
    assert kept["phi"] == 90
    paths = spark.createDataFrame([("/d/left", "A.jpg"), ("/d/right", "a.jpg"), ("/d/left", "sub/B.jpg")], "folder string, path string")
    index = {r["key"]: (r["folder"], r["path"]) for r in poses.image_index(paths).collect()}
    assert index["a.jpg"] == ("/d/left", "A.jpg") and index["right/a.jpg"] == ("/d/right", "a.jpg") and index["b.jpg"] == ("/d/left", "sub/B.jpg")
    assert {r["key"]: len(r["files"]) for r in poses.image_candidates(paths).collect()}["a.jpg"] == 2
    poses.save_state({"paths": paths}, str(tmp_path / "state"))
    assert poses.load_state(spark, str(tmp_path / "state"), ["paths"])["paths"].count() == 3


def test_clouds_with_odd_rows(spark, tmp_path):
    (tmp_path / "n.xyz").write_text("1 2 3 4\n1 2 3 4\n1 2 3\n")
    rows = clouds.read_cloud(spark, str(tmp_path / "n.xyz")).orderBy("pid").collect()
    assert [r["intensity"] for r in rows] == [4, 4, None] and len({r["pid"] for r in rows}) == 3
    body = struct.pack("<B3i", 3, 0, 1, 2) + struct.pack("<B2i", 2, 0, 1) + np.array([1, 2, 3, 4, 5, 6], "<f4").tobytes()
    head = b"ply\nformat binary_little_endian 1.0\nelement face 2\nproperty list uchar int vertex_indices\nelement vertex 2\nproperty float x\nproperty float y\nproperty float z\nend_header\n"
    (tmp_path / "f.ply").write_bytes(head + body)
    assert [tuple(r) for r in clouds.read_cloud(spark, str(tmp_path / "f.ply")).orderBy("pid").collect()] == [(0, 1, 2, 3), (1, 4, 5, 6)]
    assert clouds.header_facts(str(tmp_path / "f.ply")) == (2, False) and clouds.header_facts(str(tmp_path / "n.xyz")) == (None, None)
    pcd = "FIELDS x y z\nSIZE 4 4 4\nTYPE F F F\nPOINTS 2\nDATA binary\n"
    (tmp_path / "p.pcd").write_bytes(pcd.encode() + np.array([1, 2, 3, np.nan, 5, 6], "<f4").tobytes())
    assert [tuple(r) for r in clouds.read_cloud(spark, str(tmp_path / "p.pcd")).collect()] == [(0, 1, 2, 3)]
    grey = spark.createDataFrame([(0, 10.0, 11.0, 10.0), (1, 200.0, 201.0, 200.0)], "pid long, r double, g double, b double")
    assert clouds.grey_probe(grey) and not clouds.grey_probe(grey.withColumn("r", F.lit(90.0)))


def test_records(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0, 3.0, 9, "x"), (1, None, 2.0, 3.0, 9, "y"), (2, float("nan"), 0.0, 0.0, 9, "z")], "pid int, x double, y double, z double, r int, other string")
    assert records.conform(df, "points").dtypes == [("pid", "bigint"), ("x", "double"), ("y", "double"), ("z", "double"), ("r", "int")]
    assert tuple(records.faults(df, "points", ["pid"]).first()) == (3, 2, 1)
    with pytest.raises(ValueError, match="without z"):
        records.conform(df.drop("z"), "points")
    assert all(records._columns(text) for text in records.RECORDS.values())
    assert records.select(df, spark.createDataFrame([(1,), (1,)], "pid int")).count() == 2


def test_settings():
    s = reconstruct.settings("indoor", "slam", seed=3)
    assert (s.outward, s.ghost_offset_tol, s.seed) == (False, 0.03, 3)
    assert reconstruct.signature(s) == reconstruct.signature(reconstruct.settings("building", "slam", max_planes=3)) != reconstruct.signature(reconstruct.settings())
    for bad in (("yard",), ("indoor", "ear")):
        with pytest.raises(ValueError):
            reconstruct.settings(*bad)
    with pytest.raises(ValueError):
        reconstruct.settings(colour=1)


def test_camera_files(spark, tmp_path):
    from cloudloom.sources import cameras

    def made(name, text):
        (tmp_path / name).write_text(text)
        return str(tmp_path / name)

    made("cameras.txt", "# list\n1 PINHOLE 640 480 500 510 320 240\n2 SIMPLE_RADIAL 100 80 90 50 40 -0.1\n")
    made("images.txt", "# list\n7 1 0 0 0 1 2 3 1 a b.jpg\n\n8 0.7071067811865476 0 0 0.7071067811865476 0 0 0 2 c.jpg\n1 2 -1\n")
    rows = {r["cam_id"]: r for r in cameras.read_colmap(spark, str(tmp_path)).collect()}
    assert rows[7]["name"] == "a b.jpg" and rows[7]["r0"] == 1 and rows[7]["t2"] == 3 and rows[7]["fy"] == 510
    assert [round(rows[8][f"r{i}"], 9) for i in range(9)] == [0, -1, 0, 1, 0, 0, 0, 0, 1] and rows[8]["k1"] == -0.1
    named = cameras.read_image_poses(spark, made("p.txt", "index x y z roll pitch yaw qx qy qz qw timestamp\na.jpg 1 2 3 90 10 20 0 0 0 1 1234567\n")).first()
    assert tuple(named) == ("a.jpg", 1, 2, 3, [0, 0, 0, 1], 1234567)
    rows = cameras.read_image_poses(spark, made("q.txt", "a 5 6 7 0 0 1 0 9999\nb 1 0 0 0 8 9 10\nc 1 2 3\n")).collect()
    assert [(r["name"], r["x"], r["t"]) for r in rows] == [("a", 5, 9999), ("b", 8, None)]
    text = "intrinsic:\n   left:\n      model_type: POLYFISHEYE\n      camera_name: left\n      image_width: 3504\n      image_height: 4672\n      A11: 1480.0\n      A12: 1.07\n      k2: -0.016\n      k3: 7.5e-02\n"
    text += "   middle:\n      image_width: 640\n      image_height: 480\n      camera_matrix: !!m\n         data: [ 5.48e+02, 0., 3.27e+02, 0., 5.49e+02, 2.57e+02, 0., 0., 1. ]\n"
    found = cameras.read_calibrations(spark, made("c.yaml", text))
    assert [(c["model"], c["fx"], c["fy"], c["poly"]) for c in found] == [("POLYFISHEYE", 1480, 1480, [-0.016, 0.075]), ("PINHOLE", 548, 549, [])]
    assert cameras.pick(found, 4672, 3504)["name"] == "left" and cameras.pick(found, 640, 482)["fx"] == 548 and cameras.pick(found, 100, 100) is None
    twins = [found[0], found[0] | {"name": "right"}]
    assert cameras.pick(twins, 3504, 4672) is None and cameras.pick(twins, 3504, 4672, "img_RIGHT_1.jpg")["name"] == "right"


def test_gear_profiles():
    from cloudloom.operators import parts

    t = np.arange(1_024) / 1_024
    for z in (17, 24, 48):
        profile = np.where((t * z) % 1 < 0.45, 1.0, 0.8)
        assert parts.teeth(profile)[0] == z
    r = np.random.default_rng(1)
    assert parts.teeth(1 + 0.01 * r.normal(size=1_024)) is None and parts.teeth(np.ones(64)) is None


def test_command_line(spark, tmp_path):
    from cloudloom import cli

    r = np.random.default_rng(2)
    flat = [f"{x:.4f} {y:.4f} {0.02 * math.sin(3 * x):.4f}" for x, y in r.uniform(0, 2, (300, 2))]
    (tmp_path / "a.xyz").write_text("\n".join(flat))
    told = cli.main(["info", str(tmp_path / "a.xyz")])
    assert told["n"] == 300 and 0 <= told["x_min"] < 0.1 and told["header_points"] is None
    assert 0 < cli.main(["thin", str(tmp_path / "a.xyz"), str(tmp_path / "thin"), "--size", "0.5"])["points"] <= 64
    same = cli.main(["compare", str(tmp_path / "a.xyz"), str(tmp_path / "a.xyz"), "--as-is"])
    assert same["points"] == 300 and same["largest"] == 0 and same["within"] == 1
    with pytest.raises(ValueError, match="no writer"):
        models.write_mesh(spark.range(0), spark.range(0), "x.abc")


def test_text_records_of_any_length(spark, tmp_path):
    """Blank lines anywhere, longer and shorter lines, a word that is no number."""
    head = "ply\nformat ascii 1.0\nelement vertex 6\nproperty float x\nproperty float y\nproperty float z\nend_header\n"
    (tmp_path / "a.ply").write_text(head + "\n1 2 3 99 98\n4 5 6\n\n7 8\n9 x 9\n10 11 12 13\n14 15 16\n")
    clouds.register(spark)
    rows = spark.read.format("cloud-ply").option("path", str(tmp_path / "a.ply")).load().collect()
    assert sorted((r["pid"], r["x"], r["y"], r["z"]) for r in rows) == [(0, 1, 2, 3), (1, 4, 5, 6), (4, 10, 11, 12), (5, 14, 15, 16)]
