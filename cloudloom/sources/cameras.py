"""Camera files: COLMAP text models, image poses with quaternions, calibrations. Small files, parsed where they are read."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession

NUMBER = r"[-+]?\d*\.?\d+(?:[eE][-+]?\d+)?"
_SCHEMA = "cam_id long, name string, w int, h int, fx double, fy double, ox double, oy double, k1 double, " + ", ".join(f"r{i} double" for i in range(9)) + ", t0 double, t1 double, t2 double"


def _text(spark: SparkSession, path: str) -> list[str]:
    """Lines of a small text file, through Spark's reader, in order."""
    row = spark.read.text(path, wholetext=True).first()
    return (row["value"] if row else "").splitlines()


def rotation(qw: float, qx: float, qy: float, qz: float) -> np.ndarray:
    """Rotation matrix of a quaternion, made unit."""
    w, x, y, z = np.array([qw, qx, qy, qz]) / np.linalg.norm([qw, qx, qy, qz])
    v = np.array([x, y, z])
    k = np.array([[0, -z, y], [z, 0, -x], [-y, x, 0]])
    return np.eye(3) * (w * w - v @ v) + 2 * np.outer(v, v) + 2 * w * k


def _intrinsics(model: str, p: list[float]) -> tuple[float, float, float, float, float]:
    """fx, fy, ox, oy, k1 of a model's parameters."""
    if model == "PINHOLE":
        return p[0], p[1], p[2], p[3], 0.0
    if model in ("SIMPLE_PINHOLE", "SIMPLE_RADIAL", "RADIAL"):
        return p[0], p[0], p[1], p[2], p[3] if model != "SIMPLE_PINHOLE" else 0.0
    if model in ("OPENCV", "FULL_OPENCV"):
        return p[0], p[1], p[2], p[3], p[4]
    raise ValueError(f"camera model {model} is not supported")


def read_colmap(spark: SparkSession, folder: str) -> DataFrame:
    """Cameras (world to camera: r0 .. r8, t0 .. t2) of a text model's cameras.txt and images.txt.

    Images take two lines, of which the second, the points, may be empty.
    """
    known = {}
    for line in _text(spark, f"{folder}/cameras.txt"):
        word = line.split()
        if word and word[0][0] != "#":
            known[int(word[0])] = (int(word[2]), int(word[3]), *_intrinsics(word[1], [float(x) for x in word[4:]]))
    lines = [x for x in _text(spark, f"{folder}/images.txt") if not x.lstrip().startswith("#")]
    out, i = [], 0
    while i < len(lines):
        word = lines[i].split()
        i += 1
        if len(word) < 10:
            continue
        i += 1
        turn = rotation(*map(float, word[1:5]))
        w, h, fx, fy, ox, oy, k1 = known[int(word[8])]
        out.append((int(word[0]), " ".join(word[9:]), w, h, fx, fy, ox, oy, k1, *map(float, turn.ravel()), *map(float, word[5:8])))
    return spark.createDataFrame(out, _SCHEMA)


def _columns(words: list[str]) -> dict[str, int] | None:
    """Places of the named numbers of a header, names of images aside."""
    numeric = [w.lower() for w in words if w.lower() not in ("index", "name", "image", "file")]
    if not {"x", "y", "z", "qx", "qy", "qz", "qw"} <= set(numeric):
        return None
    at = {k: numeric.index(k) for k in ("x", "y", "z", "qx", "qy", "qz", "qw")}
    return at | {"t": next((numeric.index(k) for k in ("timestamp", "time", "t", "stamp") if k in numeric), -1)}


def _unit(q) -> bool:
    return 0.85 < float(np.linalg.norm(q)) < 1.15


def read_image_poses(spark: SparkSession, path: str) -> DataFrame:
    """name, x, y, z, q (four numbers as they come), t: a line per image.

    A header that names the columns is believed where the named quaternion is unit. Else the
    first four numbers of unit length are it; the position is the first three numbers if six or
    more stand before it, the three before it if there are so many, or the three after it.
    """
    out, header = [], None
    for line in _text(spark, path):
        words = re.split(r"[\s,;]+", line.strip().lstrip("#").strip())
        numbers = [float(w) for w in words if re.fullmatch(NUMBER, w)]
        name = next((w for w in words if w and not re.fullmatch(NUMBER, w)), None)
        if not numbers:
            header = header or _columns([w for w in words if w])
            continue
        if len(numbers) < 7:
            continue
        if header and len(numbers) > max(header.values()):
            q = [numbers[header[k]] for k in ("qx", "qy", "qz", "qw")]
            if _unit(q):
                out.append((name, *[numbers[header[k]] for k in "xyz"], q, numbers[header["t"]] if header["t"] >= 0 else None))
                continue
        at = next((i for i in range(len(numbers) - 3) if _unit(numbers[i : i + 4])), None)
        if at is None or at < 3 and len(numbers) < at + 7:
            continue
        first = 0 if at >= 6 else at - 3 if at >= 3 else at + 4
        used = {*range(at, at + 4), *range(first, first + 3)}
        rest = [x for i, x in enumerate(numbers) if i not in used]
        t = max(rest, key=abs) if rest and max(map(abs, rest)) > 1e3 else None
        out.append((name, *numbers[first : first + 3], numbers[at : at + 4], t))
    return spark.createDataFrame(out, "name string, x double, y double, z double, q array<double>, t double")


#: Names of the numbers in calibration files.
KEYS = {"fx": "fx|A11", "fy": "fy|A22", "ox": "cx|u0", "oy": "cy|v0", "k1": "k1", "a12": "A12", "max_theta": "maxIncidentAngle", "w": "(?:image_)?width", "h": "(?:image_)?height"}


def calibration(text: str) -> dict | None:
    """Numbers of one camera's block of text: a flat list of names, or a 3 x 3 matrix; None without a likely focal length."""
    found: dict = {}
    for what, names in (("camera_matrix", ("fx", None, "ox", None, "fy", "oy")), ("distortion", ("k1",))):
        m = re.search(rf"{what}.{{0,200}}?data\s*:\s*\[([^\]]+)\]", text, re.S | re.I)
        numbers = [float(x) for x in re.findall(NUMBER, m[1])] if m else []
        if len(numbers) >= (9 if what == "camera_matrix" else 1):
            found |= {n: x for n, x in zip(names, numbers, strict=False) if n}
    for key, names in KEYS.items():
        m = re.search(rf"\b(?:{names})\b\s*[:=]\s*({NUMBER})", text, re.I)
        if key not in found and m:
            found[key] = float(m[1])
    m = re.search(r"model(?:_type)?\s*[:=]\s*([A-Za-z_]+)", text, re.I)
    poly = []
    while k := re.search(rf"\bk{len(poly) + 2}\b\s*[:=]\s*({NUMBER})", text, re.I):
        poly.append(float(k[1]))
    if not 50 < found.get("fx", 0) < 50_000:
        return None
    found["model"] = m[1].upper() if m else "POLYFISHEYE" if poly else "PINHOLE"
    name = re.search(r"camera_name\s*[:=]\s*(\S+)", text, re.I)
    return found | {"fy": found.get("fy", found["fx"]), "poly": poly, "name": name[1] if name else None}


def read_calibrations(spark: SparkSession, path: str) -> list[dict]:
    """Cameras of a calibration file: a block begins at each line of a name alone that is indented least but one."""
    lines = _text(spark, path)
    heads = [(len(x) - len(x.lstrip()), i) for i, x in enumerate(lines) if re.fullmatch(r"\s+[\w-]+:\s*", x)]
    least = min((d for d, _ in heads), default=0)
    starts = [i for d, i in heads if d == least] or [0]
    blocks = ["\n".join(lines[a:b]) for a, b in zip(starts, [*starts[1:], len(lines)], strict=True)]
    return [c for c in map(calibration, blocks) if c]


def pick(cameras: list[dict], w: int, h: int, name: str | None = None, share: float = 0.02) -> dict | None:
    """The calibration of an image's size, either way round, within two percent; of several the one whose name the image has.

    Sizes that fit none, or several that the name does not tell apart, give None.
    """
    near = lambda a, b: a and b and abs(a - b) <= share * b
    fit = [c for c in cameras if near(c.get("w"), w) and near(c.get("h"), h) or near(c.get("w"), h) and near(c.get("h"), w)]
    if len(fit) > 1 and name:
        fit = [c for c in fit if c["name"] and c["name"].lower() in name.lower()] or fit
    return fit[0] if len(fit) == 1 else None
