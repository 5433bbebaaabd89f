"""Machine and steel parts: cylinders, shafts, radius clusters, members, plates as pairs of planes.

Cylinders are searched like planes: bounded hypotheses a round, one pass that counts what
each explains and what any two explain together, all that do not overlap refined at once.
Members are measured from aggregates per cluster; only a few numbers a cluster come to the
driver.

Edge cases: rows with a null coordinate or normal take no part; too few points give no
parts; a cluster that is not long gives no member.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloudloom.functions.catalogs import sections, stock
from cloudloom.functions.linalg import moments
from cloudloom.operators.graph import components
from cloudloom.operators.planes import footprint_overlaps, intersection_lines, pairs
from cloudloom.operators.points import XYZ, radius_pairs
from cloudloom.operators.search import _NORMAL, _taken, counted, largest_pieces
from cloudloom.operators.series import match_profiles, nearest_stock
from cloudloom.plans.scratch import saved

_CYLINDER = "plane_id long, px double, py double, pz double, ax double, ay double, az double, radius double"


def frame(axis: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    helper = np.array([1.0, 0, 0]) if abs(axis[0]) < 0.9 else np.array([0, 1.0, 0])
    u = np.cross(axis, helper)
    u /= np.linalg.norm(u)
    return u, np.cross(axis, u)


def from_two(p1: np.ndarray, n1: np.ndarray, p2: np.ndarray, n2: np.ndarray, least_sine: float = 0.15) -> tuple[np.ndarray, np.ndarray, float] | None:
    """Point on the axis, axis and radius of the cylinder through two points with normals; None if the normals are near parallel."""
    axis = np.cross(n1, n2)
    size = np.linalg.norm(axis)
    if size < least_sine:
        return None
    axis /= size
    u, v = frame(axis)
    a, b = np.array([n1 @ u, n1 @ v]), np.array([n2 @ u, n2 @ v])
    gap = np.array([(p2 - p1) @ u, (p2 - p1) @ v])
    det = -a[0] * b[1] + a[1] * b[0]
    if abs(det) < 1e-9:
        return None
    s = (-gap[0] * b[1] + gap[1] * b[0]) / det
    t = (a[0] * gap[1] - a[1] * gap[0]) / det
    r1, r2 = abs(s) * np.linalg.norm(a), abs(t) * np.linalg.norm(b)
    if abs(r1 - r2) > 0.2 * max(r1, r2):
        return None
    centre = p1 + s * (a[0] * u + a[1] * v)
    return centre, axis, float((r1 + r2) / 2)


def _explained(p: np.ndarray, n: np.ndarray, tried: np.ndarray, threshold: float, least: float) -> np.ndarray:
    """Which points (columns) lie on which cylinders (rows of centre, axis, radius), normals about radial."""
    c, a, r = tried[:, :3], tried[:, 3:6], tried[:, 6:]
    along = a @ p - (a * c).sum(axis=1, keepdims=True)
    dx = [p[i] - c[:, i : i + 1] - along * a[:, i : i + 1] for i in range(3)]
    off = np.sqrt(dx[0] ** 2 + dx[1] ** 2 + dx[2] ** 2)
    radial = np.abs(dx[0] * n[0] + dx[1] * n[1] + dx[2] * n[2]) / np.maximum(off, 1e-12)
    return (np.abs(off - r) < threshold) & (radial > least)


def _counts(points: DataFrame, tried: np.ndarray, threshold: float, least: float) -> np.ndarray:
    return counted(points, lambda p, n: _explained(p, n, tried, threshold, least), len(tried))


def on_cylinders(points: DataFrame, cylinders: list[tuple], threshold: float, least: float = 0.85) -> DataFrame:
    """Points with the nearest cylinder (plane_id, centre, axis, radius) they lie on, and t, off: along the axis, from its surface."""
    own = np.array([c[1:] for c in cylinders], dtype=np.float64).reshape(-1, 7)
    ids = np.array([c[0] for c in cylinders], dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows if len(ids) else 0, 16_384):
                part = batch.slice(s, 16_384)
                p, n = (np.stack([part.column(c).to_numpy(zero_copy_only=False) for c in names]) for names in (XYZ, _NORMAL))
                best = np.full((4, part.num_rows), np.inf)
                for k, (px, py, pz, ax, ay, az, r) in enumerate(own):
                    d = p - np.array([[px], [py], [pz]])
                    t = d[0] * ax + d[1] * ay + d[2] * az
                    w = d - t * np.array([[ax], [ay], [az]])
                    far = np.sqrt((w * w).sum(axis=0))
                    off = np.abs(far - r)
                    ok = (off < threshold) & (np.abs((w * n).sum(axis=0)) > far * least) & (off < best[0])
                    best[:, ok] = off[ok], np.full(ok.sum(), k), t[ok], (far - r)[ok]
                on = np.flatnonzero(np.isfinite(best[0]))
                added = [pa.array(ids[best[1, on].astype(np.int64)]), pa.array(best[2, on]), pa.array(best[3, on])]
                yield pa.RecordBatch.from_arrays([*part.take(pa.array(on)).columns, *added], names=[*part.schema.names, "plane_id", "t", "off"])

    kinds = ", ".join(f"{c} {t}" for c, t in points.dtypes)
    return points.mapInArrow(run, f"{kinds}, plane_id long, t double, off double")


def _refined(own: DataFrame, cylinders: list[tuple]) -> list[tuple]:
    """Cylinders fitted to their points: the axis square to the normals, then a circle across it; sums of a fixed number each."""
    pairs = [(i, j) for i in range(3) for j in range(i, 3)]
    turns = own.groupBy("plane_id").agg(*[F.sum(F.col(_NORMAL[i]) * F.col(_NORMAL[j])).alias(f"s{i}{j}") for i, j in pairs]).collect()
    axes, old = {}, {c[0]: c for c in cylinders}
    for r in turns:
        m = np.array([[r[f"s{min(i, j)}{max(i, j)}"] for j in range(3)] for i in range(3)])
        axes[r["plane_id"]] = np.linalg.eigh(m)[1][:, 0]
    if not axes:
        return []
    spark = own.sparkSession
    frames = spark.createDataFrame(
        [(k, *map(float, np.concatenate(frame(a))), *map(float, old[k][1:4])) for k, a in axes.items()],
        "plane_id long, ux double, uy double, uz double, vx double, vy double, vz double, ox double, oy double, oz double",
    )
    local = own.join(F.broadcast(frames), "plane_id")  # a row per hypothesis
    uv = local.select("plane_id", *[sum((F.col(c) - F.col(f"o{c}")) * F.col(f"{f}{c}") for c in XYZ).alias(f) for f in "uv"])
    s = {"n": F.lit(1.0), "u": F.col("u"), "v": F.col("v"), "uu": F.col("u") ** 2, "uv": F.col("u") * F.col("v"), "vv": F.col("v") ** 2}
    q = F.col("u") ** 2 + F.col("v") ** 2
    s |= {"uq": F.col("u") * q, "vq": F.col("v") * q}
    out = []
    for r in uv.groupBy("plane_id").agg(*[F.sum(e).alias(k) for k, e in s.items()]).collect():
        a = np.array([[r["uu"], r["uv"], r["u"]], [r["uv"], r["vv"], r["v"]], [r["u"], r["v"], r["n"]]])
        x = np.linalg.lstsq(a, np.array([r["uq"], r["vq"], r["uu"] + r["vv"]]), rcond=None)[0]
        u, v = frame(axes[r["plane_id"]])
        centre = np.array(old[r["plane_id"]][1:4]) + x[0] / 2 * u + x[1] / 2 * v
        radius = math.sqrt(max(0.0, x[2] + x[0] ** 2 / 4 + x[1] ** 2 / 4))
        out.append((r["plane_id"], *map(float, centre), *map(float, axes[r["plane_id"]]), radius))
    return out


def detect_cylinders(
    points: DataFrame, threshold: float, min_inliers: int = 300, most: int = 32, max_radius: float | None = None, radius: float | None = None,
    hypotheses: int = 256, share: float = 0.3, least_radial: float = 0.85, least_arc: int = 16, seed: int = 7, dry: int = 3,
) -> tuple[DataFrame, DataFrame]:
    """Cylinders (cyl_id, n, centre of their length, axis, radius, length, rms) and the assignment (pid, cyl_id).

    A hypothesis goes through two points with normals. It is kept if enough points in one piece lie
    within ``threshold`` of it, their rms is at most half of that, and they cover ``least_arc`` of 64 sectors.
    """
    spark = points.sparkSession
    piece = 4 * threshold if radius is None else radius
    left = saved(points.select("pid", *XYZ, *_NORMAL).where(" and ".join(f"{c} is not null" for c in (*XYZ, *_NORMAL))), "left")
    found, owners, round_, idle = [], None, 0, 0
    while idle < dry and len(found) < most and left.count() >= min_inliers:
        drawn = left.orderBy(F.xxhash64("pid", F.lit(seed + round_)), "pid").limit(2 * hypotheses).toPandas()
        round_ += 1
        p, n = drawn[list(XYZ)].to_numpy(), drawn[list(_NORMAL)].to_numpy()
        half = len(p) // 2
        made = [from_two(p[i], n[i], p[half + i], n[half + i]) for i in range(half)]
        made = [m for m in made if m and m[2] >= 2 * threshold and (max_radius is None or m[2] <= max_radius)]
        chosen = []
        if made:
            tried = np.array([[*c, *a, r] for c, a, r in made])
            chosen = _taken(_counts(left, tried, threshold, least_radial), max(3, min_inliers // 2), most - len(found), share)
        if not chosen:
            idle += 1
            continue
        fit = [(len(found) + k, *map(float, tried[c])) for k, c in enumerate(chosen)]
        for _ in range(3):
            fit = _refined(saved(on_cylinders(left, fit, threshold, least_radial), "on"), fit) if fit else []
        if not fit:
            idle += 1
            continue
        own = saved(largest_pieces(saved(on_cylinders(left, fit, threshold, least_radial), "on"), piece), "pieces")
        frames = spark.createDataFrame([(f[0], *map(float, np.concatenate(frame(np.array(f[4:7])))), *f[1:4]) for f in fit],
                                       "plane_id long, ux double, uy double, uz double, vx double, vy double, vz double, ox double, oy double, oz double")
        turned = own.join(F.broadcast(frames), "plane_id")
        u, v = (sum((F.col(c) - F.col(f"o{c}")) * F.col(f"{f}{c}") for c in XYZ) for f in "uv")
        sector = F.floor((F.atan2(v, u) + math.pi) / (2 * math.pi) * 64) % 64
        facts = turned.groupBy("plane_id").agg(
            F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(F.col("off") ** 2)).alias("rms"), F.min("t").alias("t0"), F.max("t").alias("t1"), F.countDistinct(sector).alias("arc")
        )
        good = {r["plane_id"]: r for r in facts.collect() if r["n"] >= min_inliers and r["rms"] <= threshold / 2 and r["arc"] >= least_arc}
        if not good:
            idle += 1
            continue
        idle, to = 0, {}
        for f in sorted((f for f in fit if f[0] in good), key=lambda f: (-good[f[0]]["n"], f[0])):
            r, to[f[0]] = good[f[0]], len(found)
            middle = (r["t0"] + r["t1"]) / 2
            found.append((to[f[0]], r["n"], *[c + a * middle for c, a in zip(f[1:4], f[4:7], strict=True)], *f[4:], r["t1"] - r["t0"], r["rms"]))
        number = spark.createDataFrame(list(to.items()), "plane_id long, cyl_id long")
        mine = saved(own.join(F.broadcast(number), "plane_id").select("pid", "cyl_id"), "assigned")
        owners = mine if owners is None else owners.unionByName(mine)
        left = saved(left.join(mine.select("pid").hint("merge"), "pid", "left_anti"), "left")
    if owners is None:
        owners = spark.createDataFrame([], "pid long, cyl_id long")
    schema = "cyl_id long, n long, px double, py double, pz double, ax double, ay double, az double, radius double, length double, rms double"
    return spark.createDataFrame(found, schema), owners


_CONE = "cone_id long, n long, px double, py double, pz double, ax double, ay double, az double, half_deg double, r_min double, r_max double, height double, rms double"


def cone_of(u: np.ndarray) -> tuple[np.ndarray, float] | None:
    """Axis and half angle of directions from an apex: u.w = 1 in least squares, |w| = 1 / cos(half); None if they are none of a cone."""
    w = np.linalg.lstsq(u, np.ones(len(u)), rcond=None)[0]
    return _axis_of(w)


def _axis_of(w: np.ndarray) -> tuple[np.ndarray, float] | None:
    size = float(np.linalg.norm(w))
    if size <= 1 + 1e-9:
        return None
    half = math.acos(1 / size)
    return (w / size, half) if math.radians(1) < half < math.radians(88) else None


def cone_from_three(p: np.ndarray, n: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray, float] | None:
    """Apex (where the tangent planes of three points meet), axis and half angle; None if they meet nowhere near."""
    if abs(np.linalg.det(n)) < 1e-4:
        return None
    apex = np.linalg.solve(n, (n * p).sum(axis=1))
    away = p - apex
    size = np.linalg.norm(away, axis=1)
    if np.linalg.norm(apex - p.mean(axis=0)) > reach or size.min() < 1e-9:
        return None
    found = cone_of(away / size[:, None])
    return (apex, *found) if found else None


def _cone_gaps(p: np.ndarray, n: np.ndarray, tried: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Signed distances of points (columns) to the sides of cones (rows of apex, axis, half angle), and how far normals agree with the side's."""
    d = [p[i] - tried[:, i : i + 1] for i in range(3)]
    axis = [tried[:, 3 + i : 4 + i] for i in range(3)]
    far = np.sqrt(d[0] ** 2 + d[1] ** 2 + d[2] ** 2)
    along = sum(d[i] * axis[i] for i in range(3))
    half = tried[:, 6:7]
    gap = far * np.sin(np.arccos(np.clip(along / np.maximum(far, 1e-12), -1, 1)) - half)
    out = [d[i] - along * axis[i] for i in range(3)]
    wide = np.maximum(np.sqrt(out[0] ** 2 + out[1] ** 2 + out[2] ** 2), 1e-12)
    turn = np.cos(half) * sum(out[i] * n[i] for i in range(3)) / wide - np.sin(half) * sum(axis[i] * n[i] for i in range(3))
    return gap, np.abs(turn)


def on_cones(points: DataFrame, ids: list[int], cones: np.ndarray, threshold: float, least: float = 0.85) -> DataFrame:
    """Points with the nearest cone (plane_id) within ``threshold`` with whose side their normal agrees, and off: signed distance from it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, 16_384):
                part = batch.slice(s, 16_384)
                off, agree = _cone_gaps(*(np.stack([part.column(c).to_numpy(zero_copy_only=False) for c in names]) for names in (XYZ, _NORMAL)), cones)
                off[agree < least] = np.inf
                best = np.abs(off).argmin(axis=0)
                own = off[best, np.arange(part.num_rows)]
                on = np.flatnonzero(np.abs(own) < threshold)
                yield pa.RecordBatch.from_arrays(
                    [*part.take(pa.array(on)).columns, pa.array(np.array(ids, np.int64)[best[on]]), pa.array(own[on])], names=[*part.schema.names, "plane_id", "off"]
                )

    return points.mapInArrow(run, ", ".join(f"{c} {t}" for c, t in points.dtypes) + ", plane_id long, off double")


def _refined_cones(own: DataFrame, ids: list[int], cones: np.ndarray) -> tuple[list[int], np.ndarray]:
    """Cones fitted to their points: the apex nearest to all tangent planes, then the circle of directions; sums of a fixed number each."""
    pairs = [(i, j) for i in range(3) for j in range(i, 3)]
    level = sum(F.col(c) * F.col(n) for c, n in zip(XYZ, _NORMAL, strict=True))
    sums = own.groupBy("plane_id").agg(
        *[F.sum(F.col(_NORMAL[i]) * F.col(_NORMAL[j])).alias(f"m{i}{j}") for i, j in pairs], *[F.sum(F.col(_NORMAL[i]) * level).alias(f"b{i}") for i in range(3)]
    )
    square = lambda r, k: np.array([[r[f"{k}{min(i, j)}{max(i, j)}"] for j in range(3)] for i in range(3)])
    apexes = {r["plane_id"]: np.linalg.lstsq(square(r, "m"), np.array([r[f"b{i}"] for i in range(3)]), rcond=None)[0] for r in sums.collect()}
    if not apexes:
        return [], cones[:0]
    table = own.sparkSession.createDataFrame([(k, *map(float, a)) for k, a in apexes.items()], "plane_id long, ex double, ey double, ez double")
    away = own.join(F.broadcast(table), "plane_id")  # a row per hypothesis
    away = away.withColumn("__s", F.sqrt(sum((F.col(c) - F.col(f"e{c}")) ** 2 for c in XYZ))).where(F.col("__s") > 1e-9)
    u = [(F.col(c) - F.col(f"e{c}")) / F.col("__s") for c in XYZ]
    turns = away.groupBy("plane_id").agg(*[F.sum(u[i] * u[j]).alias(f"m{i}{j}") for i, j in pairs], *[F.sum(u[i]).alias(f"b{i}") for i in range(3)])
    out: dict[int, list[float]] = {}
    for r in turns.collect():
        found = _axis_of(np.linalg.lstsq(square(r, "m"), np.array([r[f"b{i}"] for i in range(3)]), rcond=None)[0])
        if found:
            out[r["plane_id"]] = [*apexes[r["plane_id"]], *found[0], found[1]]
    kept = [k for k in ids if k in out]
    return kept, np.array([out[k] for k in kept]).reshape(-1, 7)


def detect_cones(
    points: DataFrame, threshold: float, min_inliers: int = 400, most: int = 8, radius: float | None = None, hypotheses: int = 256, share: float = 0.3,
    least_side: float = 0.85, least_arc: int = 16, seed: int = 7, dry: int = 3,
) -> tuple[DataFrame, DataFrame]:
    """Truncated cones (cone_id, n, apex, axis, half angle, radii and height between their ends, rms) and the assignment (pid, cone_id).

    A hypothesis goes through three points with normals, whose tangent planes meet in the apex. It is
    kept if enough points in one piece lie within ``threshold`` of its side, their rms is at most
    half of that, its half angle is from 3 to 80 degrees, and they cover ``least_arc`` of 64 sectors.
    """
    spark = points.sparkSession
    piece = 4 * threshold if radius is None else radius
    left = saved(points.select("pid", *XYZ, *_NORMAL).where(" and ".join(f"{c} is not null" for c in (*XYZ, *_NORMAL))), "left")
    box = left.agg(*[(F.max(c) - F.min(c)).alias(c) for c in XYZ]).first()
    reach = 10 * math.sqrt(sum((x or 0.0) ** 2 for x in box))
    found, owners, round_, idle = [], None, 0, 0
    while idle < dry and len(found) < most and left.count() >= min_inliers:
        drawn = left.orderBy(F.xxhash64("pid", F.lit(seed + round_)), "pid").limit(3 * hypotheses).toPandas()
        round_ += 1
        p, n = drawn[list(XYZ)].to_numpy(), drawn[list(_NORMAL)].to_numpy()
        third = len(p) // 3
        made = [cone_from_three(p[i::third][:3], n[i::third][:3], reach) for i in range(third)]
        tried = np.array([[*a, *x, h] for a, x, h in (m for m in made if m)]).reshape(-1, 7)
        def near(x: np.ndarray, own: np.ndarray, tried=tried) -> np.ndarray:
            gap, agree = _cone_gaps(x, own, tried)
            return (np.abs(gap) < threshold) & (agree >= least_side)

        chosen = _taken(counted(left, near, len(tried)), max(3, min_inliers // 2), most - len(found), share) if len(tried) else []
        idle += 1
        if not chosen:
            continue
        ids, cones = [len(found) + k for k in range(len(chosen))], tried[chosen]
        for _ in range(3):
            ids, cones = _refined_cones(saved(on_cones(left, ids, cones, threshold, least_side), "on"), ids, cones) if ids else (ids, cones)
        if not ids:
            continue
        own = saved(largest_pieces(saved(on_cones(left, ids, cones, threshold, least_side), "on"), piece), "pieces")
        frames = [(k, *map(float, np.concatenate(frame(c[3:6]))), *map(float, c[:6])) for k, c in zip(ids, cones, strict=True)]
        table = spark.createDataFrame(frames, "plane_id long, " + ", ".join(f"{f}{c} double" for f in "uvoa" for c in XYZ))
        turned = own.join(F.broadcast(table), "plane_id")  # a row per cone
        u, v, t = (sum((F.col(c) - F.col(f"o{c}")) * F.col(f"{f}{c}") for c in XYZ) for f in "uva")
        sector = F.floor((F.atan2(v, u) + math.pi) / (2 * math.pi) * 64) % 64
        facts = turned.groupBy("plane_id").agg(
            F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(F.col("off") ** 2)).alias("rms"), F.min(t).alias("t0"), F.max(t).alias("t1"), F.countDistinct(sector).alias("arc")
        )
        half = {k: float(c[6]) for k, c in zip(ids, cones, strict=True)}
        good = {
            r["plane_id"]: r for r in facts.collect()
            if r["n"] >= min_inliers and r["rms"] <= threshold / 2 and r["arc"] >= least_arc and 3 < math.degrees(half[r["plane_id"]]) < 80
        }
        if not good:
            continue
        idle, to = 0, {}
        for k, c in sorted(((k, c) for k, c in zip(ids, cones, strict=True) if k in good), key=lambda x: (-good[x[0]]["n"], x[0])):
            r, to[k] = good[k], len(found)
            slope = math.tan(half[k])
            ends = sorted((abs(r["t0"]) * slope, abs(r["t1"]) * slope))
            found.append((to[k], r["n"], *map(float, c[:6]), math.degrees(half[k]), *ends, r["t1"] - r["t0"], r["rms"]))
        number = spark.createDataFrame(list(to.items()), "plane_id long, cone_id long")
        mine = saved(own.join(F.broadcast(number), "plane_id").select("pid", "cone_id"), "assigned")  # a row per cone
        owners = mine if owners is None else owners.unionByName(mine)
        left = saved(left.join(mine.select("pid").hint("merge"), "pid", "left_anti"), "left")
    if owners is None:
        owners = spark.createDataFrame([], "pid long, cone_id long")
    return spark.createDataFrame(found, _CONE), owners


def shafts(cylinders: DataFrame, degrees: float = 3.0, offset: float = 0.25) -> DataFrame:
    """(shaft, step, cyl_id, diameter, start, end): coaxial cylinders of a model, longest first, along the shaft's axis."""
    rows = sorted(cylinders.collect(), key=lambda r: (-r["length"], r["cyl_id"]))
    used, out, shaft = set(), [], 0
    for base in rows:
        if base["cyl_id"] in used:
            continue
        axis, centre = np.array([base[f"a{c}"] for c in XYZ]), np.array([base[f"p{c}"] for c in XYZ])
        steps = []
        for r in rows:
            way = np.array([r[f"p{c}"] for c in XYZ]) - centre
            t = float(way @ axis)
            straight = abs(float(axis @ np.array([r[f"a{c}"] for c in XYZ]))) >= math.cos(math.radians(degrees))
            if r["cyl_id"] not in used and straight and np.linalg.norm(way - t * axis) <= offset * base["radius"]:
                used.add(r["cyl_id"])
                steps.append((t - r["length"] / 2, t + r["length"] / 2, r))
        steps.sort(key=lambda x: (x[0], x[1]))
        out += [(shaft, k, r["cyl_id"], 2 * r["radius"], a - steps[0][0], b - steps[0][0]) for k, (a, b, r) in enumerate(steps)]
        shaft += 1
    return cylinders.sparkSession.createDataFrame(out, "shaft long, step long, cyl_id long, diameter double, start double, end double")


def radius_clusters(points: DataFrame, radius: float) -> DataFrame:
    """pid, cluster: points joined over distances up to ``radius``; a cluster is its smallest pid.

    Points of a cell of radius / sqrt(3) lie within the radius of each other: they are one star, and
    only the nearest pair of two cells is asked for, so a dense cell is not paired with itself.
    """
    size = radius / math.sqrt(3)
    cell = [F.floor(F.col(c) / size).alias(f"g{c}") for c in XYZ]
    keyed = points.select("pid", *XYZ, *cell)
    heads = saved(keyed.groupBy("gx", "gy", "gz").agg(F.min("pid").alias("head")), "heads")
    own = saved(keyed.join(heads, ["gx", "gy", "gz"]).select("pid", *XYZ, "head"), "own")
    near = radius_pairs(own.select("pid", *XYZ), own.select("pid", *XYZ), radius).where("pid > nid").select("pid", "nid")
    a, b = own.select("pid", F.col("head").alias("a")), own.select(F.col("pid").alias("nid"), F.col("head").alias("b"))
    links = near.join(a, "pid").join(b, "nid").where("a <> b").select("a", "b").distinct()
    found = components(heads.select(F.col("head").alias("node")), links)
    return own.join(found, F.col("head") == F.col("node")).select("pid", F.col("root").alias("cluster"))


def members(points: DataFrame, least: int = 400) -> DataFrame:
    """Steel members of clusters (pid, cluster, x, y, z): length, height, width, family, profile and its deviation.

    The section is turned by whole steps of two degrees to where most points lie on its border.
    """
    spark = points.sparkSession
    own = points.select("cluster", *XYZ)
    frames = []
    for r in moments(own, "cluster").where(F.col("n") >= least).collect():
        m = np.array([[r["cxx"], r["cxy"], r["cxz"]], [r["cxy"], r["cyy"], r["cyz"]], [r["cxz"], r["cyz"], r["czz"]]])
        values, vectors = np.linalg.eigh(m)
        if values[2] >= 9 * values[1]:
            frames.append((r["cluster"], r["mx"], r["my"], r["mz"], *map(float, vectors[:, [2, 1, 0]].T.ravel())))
    names = "cluster long, mx double, my double, mz double, " + ", ".join(f"{k}{c} double" for k in "auv" for c in XYZ)
    local = own.join(F.broadcast(spark.createDataFrame(frames, names)), "cluster")  # a row per member
    local = saved(local.select("cluster", *[sum((F.col(c) - F.col(f"m{c}")) * F.col(f"{k}{c}") for c in XYZ).alias(k) for k in "auv"]), "local")

    def ends(x: str, low: float) -> list:
        q = F.percentile_approx(x, [low, 1 - low], 10_000)
        return [q[0].alias(f"{x}0"), q[1].alias(f"{x}1")]

    def at_step(rows: DataFrame, *keep: str) -> DataFrame:
        w = F.radians(F.col("step") * 2)
        return rows.select("cluster", "step", *keep, (F.col("u") * F.cos(w) - F.col("v") * F.sin(w)).alias("p"), (F.col("u") * F.sin(w) + F.col("v") * F.cos(w)).alias("q"))

    # the points are counted in cells of the section once; the cells are turned, at most 256 squared a member
    grain = local.groupBy("cluster").agg((F.greatest(F.max("u") - F.min("u"), F.max("v") - F.min("v"), F.lit(1e-9)) / 256).alias("g"))
    cells = local.join(F.broadcast(grain), "cluster").groupBy("cluster", "g", *[F.floor(F.col(c) / F.col("g")).alias(c) for c in "uv"]).agg(F.count(F.lit(1)).alias("n"))
    cells = saved(cells.select("cluster", "n", *[((F.col(c) + 0.5) * F.col("g")).alias(c) for c in "uv"]), "cells")
    turned = at_step(cells.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(44)))), "n")
    within = [F.percentile(c, [0.01, 0.99], F.col("n")) for c in "pq"]
    limits = turned.groupBy("cluster", "step").agg(*[w.alias(c) for w, c in zip(within, "pq", strict=True)])
    limits = saved(limits.select("cluster", "step", *[F.col(c)[k].alias(f"{c}{k}") for c in "pq" for k in (0, 1)]), "limits")
    banded = turned.join(F.broadcast(limits), ["cluster", "step"])  # 45 rows a member
    border = F.lit(False)
    for c in "pq":
        band = (F.col(f"{c}1") - F.col(f"{c}0")) * 0.08
        border = border | (F.col(c) < F.col(f"{c}0") + band) | (F.col(c) > F.col(f"{c}1") - band)
    score = banded.groupBy("cluster", "step").agg((F.sum(F.when(border, F.col("n")).otherwise(0)) / F.sum("n")).alias("score"))
    best = score.groupBy("cluster").agg(F.max_by("step", F.struct(F.round("score", 9), -F.col("step"))).alias("step"))
    section = saved(at_step(local.join(F.broadcast(best), "cluster"), "a").drop("step"), "section")  # a row per member
    size = section.groupBy("cluster").agg(*[e for c in "apq" for e in ends(c, 0.005)])
    size = saved(size.select("cluster", (F.col("a1") - F.col("a0")).alias("length"), "p0", "p1", "q0", "q1"), "size")
    own = section.join(F.broadcast(size), "cluster")
    tall = (F.col("p1") - F.col("p0")) > (F.col("q1") - F.col("q0"))
    mid = {c: F.col(c) - (F.col(f"{c}0") + F.col(f"{c}1")) / 2 for c in "pq"}
    own = own.select(
        "cluster", "length", F.when(tall, mid["q"]).otherwise(mid["p"]).alias("x"), F.when(tall, mid["p"]).otherwise(mid["q"]).alias("y"),
        F.greatest(F.col("p1") - F.col("p0"), F.col("q1") - F.col("q0")).alias("height"), F.least(F.col("p1") - F.col("p0"), F.col("q1") - F.col("q0")).alias("width"),
    )
    x, y, h, w = (F.col(c) for c in ("x", "y", "height", "width"))
    middle = F.abs(y) < h * 0.25
    facts = own.groupBy("cluster", "length", "height", "width").agg(
        F.avg((y > h * 0.36).cast("double")).alias("top"), F.avg((y < h * -0.36).cast("double")).alias("bottom"),
        F.avg((x < w * -0.36).cast("double")).alias("left"), F.avg((x > w * 0.36).cast("double")).alias("right"),
        F.count_if(middle).alias("mid"), F.avg(F.when(middle, (F.abs(x) < w * 0.15).cast("double"))).alias("web"),
        F.avg((middle & (F.abs(x) < w * 0.36)).cast("double")).alias("core"), F.percentile_approx(F.when(middle, x), 0.5, 10_000).alias("offset"), F.stddev_pop(F.when(middle, x)).alias("spread"),
    )
    flags = [(F.col(c) > 0.08).cast("int") for c in ("top", "bottom", "left", "right")]
    every = flags[0] + flags[1] + flags[2] + flags[3]
    by_web = F.when(F.col("mid") < 20, "unknown").when(F.col("spread") > w * 0.3, "unknown").when(F.abs("offset") < w * 0.15, "I/H").when(F.abs("offset") > w * 0.3, "U").otherwise("unknown")
    family = (
        F.when((every == 4) & (F.col("mid") < 20), "hollow").when((every == 4) & (F.col("web") > 0.5), "I/H").when((every == 4) & (F.col("core") < 0.02), "hollow")
        .when((every == 2) & (flags[0] != flags[1]) & (flags[2] != flags[3]), "L").otherwise(by_web)
    )
    named = facts.select("cluster", "length", "height", "width", family.alias("family"))
    rows = sections()
    rows += [("I/H", *r[1:]) for r in rows if r[0] in "IH"]
    catalog = spark.createDataFrame(rows, "family string, profile string, h double, b double")
    return match_profiles(named, catalog)


def plates(points: DataFrame, planes: DataFrame, threshold: float, max_thickness: float = 0.05) -> DataFrame:
    """(i, j, thickness, stock, area): plates as pairs of parallel faces that overlap, larger faces first, each face once.

    ``points``: pid, plane_id, x, y, z; planes of a model come to the driver as a row per pair.
    """
    spark = points.sparkSession
    facts = planes.select("plane_id", "n", *_NORMAL, "d")
    a = F.broadcast(facts.select(F.col("plane_id").alias("i"), *[F.col(c).alias(f"a{c}") for c in (*_NORMAL, "d")]))
    own = points.select("plane_id", *XYZ).join(F.broadcast(facts.select("plane_id", *_NORMAL)), "plane_id")
    cos = F.abs(sum(F.col(c) * F.col(f"a{c}") for c in _NORMAL))
    facing = own.join(a, (F.col("i") != F.col("plane_id")) & (cos >= math.cos(math.radians(3))))
    off = sum(F.col(c) * F.col(f"an{c}") for c in XYZ) + F.col("ad")
    gaps = facing.groupBy("i", F.col("plane_id").alias("j")).agg(F.abs(F.percentile_approx(off, 0.5, 10_000)).alias("thickness"), F.stddev_pop(off).alias("spread"))
    gaps = gaps.where((F.col("thickness") >= 2.5 * threshold) & (F.col("thickness") <= max_thickness) & (F.col("spread") <= 3 * threshold))
    meet = {(r["i"], r["j"]) for r in footprint_overlaps(points, planes).where("overlaps").collect()}
    found = [r for r in gaps.collect() if (min(r["i"], r["j"]), max(r["i"], r["j"])) in meet]
    weight = {r["plane_id"]: r["n"] for r in facts.select("plane_id", "n").collect()}
    used, out = set(), []
    for i in sorted(weight, key=lambda k: (-weight[k], k)):
        free = [r for r in found if r["i"] == i and i not in used and r["j"] not in used]
        if free:
            r = min(free, key=lambda r: (r["thickness"], r["j"]))
            used |= {i, r["j"]}
            out.append((i, r["j"], r["thickness"]))
    return nearest_stock(spark.createDataFrame(out, "i long, j long, thickness double"), stock(), value="thickness")


# ---------------------------------------------------------------- sheet metal


def seams(points: DataFrame, plates: DataFrame, contact: float, least: float = 0.02, most_cos: float = 0.97) -> DataFrame:
    """(i, j, ax .. bz, length): stretches in which two plates that are not near parallel both lie by their common line.

    ``plates``: (plane_id, nx, ny, nz, d), the middle plane of each; ``points``: (plane_id, x, y, z).
    """
    lines = intersection_lines(plates).where(F.abs("dx").isNotNull())
    cos = pairs(plates).select(F.col("a_plane_id").alias("i"), F.col("b_plane_id").alias("j"), F.abs(sum(F.col(f"a_n{c}") * F.col(f"b_n{c}") for c in XYZ)).alias("cos"))
    lines = saved(lines.join(cos.where(F.col("cos") <= most_cos), ["i", "j"]), "lines")
    both = lines.withColumn("side", F.explode(F.array("i", "j")))
    own = points.select("plane_id", *XYZ).join(F.broadcast(both), F.col("plane_id") == F.col("side"))  # plates of a model
    way = [F.col(c) - F.col(f"p{c}") for c in XYZ]
    t = sum(w * F.col(f"d{c}") for w, c in zip(way, XYZ, strict=True))
    near = own.withColumn("t", t).where(sum(w * w for w in way) - t * t <= contact * contact)
    reach = near.groupBy("i", "j", "side").agg(F.min("t").alias("t0"), F.max("t").alias("t1"))
    met = reach.groupBy("i", "j").agg(F.count(F.lit(1)).alias("sides"), F.max("t0").alias("t0"), F.min("t1").alias("t1")).where(F.col("sides") == 2)
    met = met.withColumn("length", F.col("t1") - F.col("t0")).where(F.col("length") >= least).join(lines, ["i", "j"])
    ends = [(F.col(f"p{c}") + F.col(f"d{c}") * F.col(k)).alias(f"{e}{c}") for e, k in (("a", "t0"), ("b", "t1")) for c in XYZ]
    return met.select("i", "j", *ends, "length")


def _to_outline(p: np.ndarray, outline: np.ndarray) -> float:
    """Distance of a point to the border of a loop in space."""
    a, way = outline, np.roll(outline, -1, axis=0) - outline
    t = np.clip(((p - a) * way).sum(axis=1) / np.maximum((way * way).sum(axis=1), 1e-18), 0, 1)
    return float(np.linalg.norm(a + t[:, None] * way - p, axis=1).min())


def junctions(plates: list[dict], found: list[dict], reach: float = 3.0) -> list[str]:
    """corner where a seam's middle lies by the border of both plates, else tee.

    Plates of a model: id, outline (n x 3), thickness, normal, area; seams: i, j, a, b.
    """
    by_id = {p["id"]: p for p in plates}
    middle = [(s, (s["a"] + s["b"]) / 2) for s in found]
    return ["corner" if all(_to_outline(m, by_id[s[k]]["outline"]) <= reach * by_id[s[k]]["thickness"] for k in ("i", "j")) else "tee" for s, m in middle]


def unfold(plates: list[dict], found: list[dict], k_factor: float = 0.44, inner: float | None = None) -> list[dict]:
    """Flat parts of plates joined at corners: ids, loops in the plane, bend lines and angles, thickness.

    Plates of unlike gauge (25 %) stay apart. A part lies in the plane of its largest plate; the
    others turn about their seams, longest first, each moved out by the bend allowance
    angle * (inner radius + k_factor * thickness).
    """
    by_id = {p["id"]: p for p in plates}
    bends = [
        s for s, kind in zip(found, junctions(plates, found), strict=True)
        if kind == "corner" and abs(by_id[s["i"]]["thickness"] - by_id[s["j"]]["thickness"]) <= 0.25 * max(by_id[s["i"]]["thickness"], by_id[s["j"]]["thickness"])
    ]
    bends.sort(key=lambda s: -float(np.linalg.norm(s["b"] - s["a"])))
    left, parts = set(by_id), []
    while left:
        base = max(sorted(left), key=lambda k: by_id[k]["area"])
        plate = by_id[base]
        u, v = frame(plate["normal"])
        flat = {base: lambda p, o=plate["outline"][0], u=u, v=v: np.c_[(p - o) @ u, (p - o) @ v]}
        part = {"ids": [base], "loops": {base: flat[base](plate["outline"])}, "bends": [], "angles": [], "thickness": plate["thickness"]}
        while True:
            hinge = next((s for s in bends if (s["i"] in flat) != (s["j"] in flat) and {s["i"], s["j"]} <= left), None)
            if hinge is None:
                break
            known, new = (hinge["i"], hinge["j"]) if hinge["i"] in flat else (hinge["j"], hinge["i"])
            a, b = flat[known](np.array([hinge["a"], hinge["b"]]))
            along = (b - a) / np.linalg.norm(b - a)
            out = np.array([-along[1], along[0]])
            if (part["loops"][known].mean(axis=0) - a) @ out > 0:
                out = -out
            # seen along the hinge: how far the new plate turns away from going straight on
            axis = (hinge["b"] - hinge["a"]) / np.linalg.norm(hinge["b"] - hinge["a"])
            arms = []
            for k in (known, new):
                way = by_id[k]["outline"].mean(axis=0) - hinge["a"]
                way = way - (way @ axis) * axis
                arms.append(way / np.linalg.norm(way))
            angle = math.pi - math.acos(max(-1.0, min(1.0, float(arms[0] @ arms[1]))))
            allowance = angle * ((inner if inner is not None else plate["thickness"]) + k_factor * plate["thickness"])

            def placed(p, h=hinge["a"], axis=axis, a=a, along=along, out=out, allowance=allowance):
                t = (p - h) @ axis
                away = np.linalg.norm((p - h) - t[:, None] * axis, axis=1)
                return a + t[:, None] * along + (away + allowance)[:, None] * out

            flat[new] = placed
            part["ids"].append(new)
            part["loops"][new] = placed(by_id[new]["outline"])
            part["bends"].append((a + allowance / 2 * out, b + allowance / 2 * out))
            part["angles"].append(math.degrees(angle))
        left -= set(part["ids"])
        parts.append(part | {"loops": [part["loops"][k] for k in part["ids"]]})
    return parts


# ---------------------------------------------------------------- gears


def teeth(profile: np.ndarray, least: int = 8, most: int = 300) -> tuple[int, float] | None:
    """Teeth of a profile of radii over even angles, and how far the peak stands out; None without a clear one."""
    power = np.abs(np.fft.rfft(profile - profile.mean()))
    most = min(most, len(power) - 1)
    if most < least:
        return None
    z = least + int(power[least : most + 1].argmax())
    # a profile of paired flanks peaks at twice the teeth
    if z % 2 == 0 and z // 2 >= least and power[z // 2] > 0.5 * power[z]:
        z //= 2
    rest = np.ones(len(power), dtype=bool)
    rest[:least] = False
    for k in range(z, len(power), z):
        rest[max(0, k - 1) : k + 2] = False
    noise = float(np.median(power[least:]))
    if power[z] <= 1e-9 * np.abs(profile).sum() or power[z] < 4 * noise or rest.any() and power[z] < 2 * power[rest].max():
        return None
    return z, float(power[z] / max(noise, 1e-12))


def gears(points: DataFrame, by: str = "cluster", least: int = 500, bins: int = 1_024) -> DataFrame:
    """(by, teeth, module, tip, root, width) of clusters that are spur gears: points (by, x, y, z).

    The axis is the cluster's shortest or longest direction, whichever shows teeth more clearly. A
    profile is the largest radius per angle; it and a few sums a cluster come to the driver.
    """
    spark = points.sparkSession
    frames = []
    for r in moments(points.select(by, *XYZ), by).where(F.col("n") >= least).collect():
        m = np.array([[r["cxx"], r["cxy"], r["cxz"]], [r["cxy"], r["cyy"], r["cyz"]], [r["cxz"], r["cyz"], r["czz"]]])
        vectors = np.linalg.eigh(m)[1]
        n = int(max(64, min(bins, 2 ** int(math.log2(r["n"] / 4)))))
        for way in (0, 2):
            u, v = frame(vectors[:, way])
            frames.append((r[by], way, n, r["mx"], r["my"], r["mz"], *map(float, vectors[:, way]), *map(float, u), *map(float, v)))
    names = f"{by} {points.schema[by].dataType.simpleString()}, way int, bins int, mx double, my double, mz double, " + ", ".join(f"{k}{c} double" for k in "auv" for c in XYZ)
    local = points.select(by, *XYZ).join(F.broadcast(spark.createDataFrame(frames, names)), by)  # two rows a cluster
    local = local.select(by, "way", "bins", *[sum((F.col(c) - F.col(f"m{c}")) * F.col(f"{k}{c}") for c in XYZ).alias(k) for k in "auv"])
    angle = (F.atan2("v", "u") + math.pi) / (2 * math.pi)
    rows = local.select(by, "way", F.least(F.floor(angle * F.col("bins")), F.col("bins") - 1).cast("int").alias("bin"), F.sqrt(F.col("u") ** 2 + F.col("v") ** 2).alias("r"))
    profiles = rows.groupBy(by, "way", "bin").agg(F.max("r").alias("r"))
    held: dict = {}
    for r in profiles.groupBy(by, "way").agg(F.collect_list(F.struct("bin", "r")).alias("p")).toLocalIterator():  # `bins` numbers each
        held[r[by], r["way"]] = {x["bin"]: x["r"] for x in r["p"]}
    width = {(r[by], r["way"]): r["w"] for r in local.groupBy(by, "way").agg((F.max("a") - F.min("a")).alias("w")).collect()}
    best: dict = {}
    for f in frames:
        own = held.get((f[0], f[1]), {})
        if len(own) < f[2] // 2:
            continue
        profile = np.interp(np.arange(f[2]), sorted(own), [own[k] for k in sorted(own)], period=f[2])
        found = teeth(profile)
        if found and (f[0] not in best or found[1] > best[f[0]][0]):
            z, clear = found
            tip, low = float(np.quantile(profile, 0.9)), float(np.quantile(profile, 0.08))
            module = 2 * tip / (z + 2)
            if tip - low >= 0.5 * module:
                best[f[0]] = (clear, (f[0], z, module, tip, low, width[f[0], f[1]]))
    return spark.createDataFrame([x for _, x in best.values()], f"{by} {points.schema[by].dataType.simpleString()}, teeth int, module double, tip double, root double, width double")
