"""Planes n.x + d = 0 as a small relation (plane_id, nx, ny, nz, d) with an assignment of points."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloudloom.functions.linalg import cross, dot, minus, moments, norm, vec, with_eigen
from cloudloom.operators.points import XYZ, _offsets, radius_pairs, with_cell
from cloudloom.plans.scratch import saved


def fit_planes(points: DataFrame, by: str = "plane_id") -> DataFrame:
    """Total-least-squares plane of every group: normal, offset, rms, surface variation."""
    fit = with_eigen(moments(points, by))
    total = F.col("l1") + F.col("l2") + F.col("l3")
    # one row per plane: written, so that later filters aren't rewritten in terms of the moments
    return saved(fit.select(
        by, "n", "mx", "my", "mz", "nx", "ny", "nz", (-dot(vec("n"), vec("m"))).alias("d"),
        F.sqrt(F.greatest("l3", F.lit(0.0))).alias("rms"),
        F.when(total > 0, F.greatest("l3", F.lit(0.0)) / total).otherwise(F.lit(0.0)).alias("variation"),
    ), "planes")


def pairs(planes: DataFrame) -> DataFrame:
    """Planes i < j side by side; planes belong to a model, so one side is small enough to send along."""
    a = planes.select(*[F.col(c).alias(f"a_{c}") for c in planes.columns])
    b = planes.select(*[F.col(c).alias(f"b_{c}") for c in planes.columns])
    return a.join(F.broadcast(b), F.col("a_plane_id") < F.col("b_plane_id"))


def angle_report(planes: DataFrame, tol: float = 0.01) -> DataFrame:
    """One row: pairs in all, parallel, orthogonal, other."""
    both = pairs(planes)
    cos = F.least(F.lit(1.0), F.abs(dot(vec("a_n"), vec("b_n"))))
    angle = F.degrees(F.acos(cos))
    both = both.select(F.when(angle < tol, "parallel").when(F.abs(angle - 90) < tol, "orthogonal").otherwise("other").alias("kind"))
    return both.agg(F.count(F.lit(1)).alias("pairs"), *[F.count_if(F.col("kind") == k).alias(k) for k in ("parallel", "orthogonal", "other")])


def intersection_lines(planes: DataFrame, parallel: float = 1e-8) -> DataFrame:
    """Per non-parallel pair: unit direction and the line's point nearest the origin."""
    both = pairs(planes)
    w = cross(vec("a_n"), vec("b_n"))
    both = both.withColumns(dict(zip(("wx", "wy", "wz"), w, strict=True))).withColumn("len", norm(vec("w"))).where(F.col("len") >= parallel)
    # p = (d_b * n_a - d_a * n_b) x w / |w|^2
    u = tuple(F.col("b_d") * F.col(f"a_n{k}") - F.col("a_d") * F.col(f"b_n{k}") for k in "xyz")
    p = cross(u, vec("w"))
    l2 = F.col("len") * F.col("len")
    return both.select(
        F.col("a_plane_id").alias("i"), F.col("b_plane_id").alias("j"),
        *[(F.col(f"w{k}") / F.col("len")).alias(f"d{k}") for k in "xyz"], *[(x / l2).alias(f"p{k}") for k, x in zip("xyz", p, strict=True)],
    )


def supported(corners: DataFrame, points: DataFrame, radius: float) -> DataFrame:
    """Corners (i, j, k, x, y, z) with a point (plane_id, x, y, z) of each of their planes within ``radius``."""
    sides = corners.withColumn("plane_id", F.explode(F.array("i", "j", "k")))
    a = with_cell(sides, radius).withColumn("o", F.explode(_offsets()))
    a = a.select("i", "j", "k", "plane_id", *XYZ, *[(F.col(f"c{c}") + F.col(f"o.{o}")).alias(f"c{c}") for c, o in zip(XYZ, "ijk", strict=True)])
    b = with_cell(points.select("plane_id", *XYZ), radius).select(F.col("plane_id").alias("p"), *[F.col(c).alias(f"n{c}") for c in XYZ], *[F.col(f"c{c}").alias(f"t{c}") for c in XYZ])
    on = [F.col("plane_id") == F.col("p"), *[F.col(f"c{c}") == F.col(f"t{c}") for c in XYZ]]
    d2 = sum((F.col(c) - F.col(f"n{c}")) * (F.col(c) - F.col(f"n{c}")) for c in XYZ)
    near = a.join(b, [*on, d2 <= radius * radius], "left_semi").select("i", "j", "k", "plane_id").distinct()
    whole = near.groupBy("i", "j", "k").agg(F.count(F.lit(1)).alias("n")).where("n = 3")
    return corners.join(whole.select("i", "j", "k"), ["i", "j", "k"], "left_semi")


def corner_points(planes: DataFrame, adjacency: DataFrame, least_det: float = 1e-6) -> DataFrame:
    """Positions in which three mutually adjacent planes meet; ``adjacency``: (i, j), i < j."""
    e = adjacency.select("i", "j")
    tri = e.join(e.select(F.col("i").alias("j"), F.col("j").alias("k")), "j").join(e.select("i", F.col("j").alias("k")), ["i", "k"])
    for p, key in (("a", "i"), ("b", "j"), ("c", "k")):
        tri = tri.join(F.broadcast(planes.select(F.col("plane_id").alias(key), *[F.col(f"n{x}").alias(f"{p}{x}") for x in "xyz"], F.col("d").alias(f"{p}d"))), key)
    bc, ca, ab = cross(vec("b"), vec("c")), cross(vec("c"), vec("a")), cross(vec("a"), vec("b"))
    det = dot(vec("a"), bc)
    tri = tri.withColumn("det", det).where(F.abs("det") >= least_det)
    at = [-(F.col("ad") * x + F.col("bd") * y + F.col("cd") * z) / F.col("det") for x, y, z in zip(bc, ca, ab, strict=True)]
    return tri.select("i", "j", "k", *[v.alias(n) for v, n in zip(at, "xyz", strict=True)])


def adjacency(points: DataFrame, planes: DataFrame, radius: float, least: int = 8, most_cos: float = 0.97) -> DataFrame:
    """(i, j, contacts) of planes that are not near parallel and of which the smaller has enough points near the other.

    ``points``: pid, plane_id, x, y, z.
    """
    cell = ["cx", "cy", "cz"]
    keyed = with_cell(points.select("pid", "plane_id", *XYZ), radius)
    # only points of cells that another plane is near to are looked at, and only until the first hit
    cells = saved(keyed.select("plane_id", *cell).distinct(), "cells")
    step = cells.withColumn("o", F.explode(_offsets()))
    step = step.select("plane_id", *cell, *[(F.col(c) + F.col(f"o.{o}")).alias(f"t{c}") for c, o in zip(cell, "ijk", strict=True)])
    there = cells.select(F.col("plane_id").alias("other"), *[F.col(c).alias(f"t{c}") for c in cell])
    near = step.join(there, [f"t{c}" for c in cell]).where("plane_id <> other")
    a = keyed.join(near, ["plane_id", *cell]).drop(*cell)
    b = keyed.select(F.col("plane_id").alias("other"), *[F.col(c).alias(f"t{c}") for c in cell], *[F.col(c).alias(f"n{c}") for c in XYZ])
    on = [a["other"] == b["other"], *[a[f"t{c}"] == b[f"t{c}"] for c in cell]]
    d2 = sum((a[c] - b[f"n{c}"]) * (a[c] - b[f"n{c}"]) for c in XYZ)
    hit = a.join(b, [*on, d2 <= radius * radius], "left_semi").select("pid", "plane_id", "other").distinct()
    owner = points.select("pid", "plane_id")
    counts = hit.groupBy("plane_id", "other").agg(F.count(F.lit(1)).alias("contacts"))
    sizes = owner.groupBy("plane_id").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.join(F.broadcast(sizes), "plane_id").join(F.broadcast(sizes.select(F.col("plane_id").alias("other"), F.col("n").alias("n_other"))), "other")
    smaller = (F.col("n") < F.col("n_other")) | ((F.col("n") == F.col("n_other")) & (F.col("plane_id") < F.col("other")))
    counts = counts.where(smaller & (F.col("contacts") >= least)).select(F.least("plane_id", "other").alias("i"), F.greatest("plane_id", "other").alias("j"), "contacts")
    skew = pairs(planes).where(F.abs(dot(vec("a_n"), vec("b_n"))) <= most_cos).select(F.col("a_plane_id").alias("i"), F.col("b_plane_id").alias("j"))
    return counts.join(F.broadcast(skew), ["i", "j"])


def basis(planes: DataFrame) -> DataFrame:
    """Adds the in-plane frame u, v: helper axis X, or Y where the normal is within about 26 degrees of X."""
    steep = F.abs("nx") >= 0.9
    h = tuple(F.when(steep, F.lit(float(i == 1))).otherwise(F.lit(float(i == 0))) for i in range(3))
    u = cross(vec("n"), h)
    planes = planes.withColumns(dict(zip(("ux", "uy", "uz"), u, strict=True))).withColumn("__s", norm(vec("u")))
    planes = planes.withColumns({f"u{k}": F.col(f"u{k}") / F.col("__s") for k in "xyz"}).drop("__s")
    return planes.withColumns(dict(zip(("vx", "vy", "vz"), cross(vec("n"), vec("u")), strict=True)))


def footprints(points: DataFrame, planes: DataFrame) -> DataFrame:
    """Bounding box of each plane's points in its own frame: plane_id, u0, u1, v0, v1, area."""
    own = points.select("plane_id", "x", "y", "z").join(F.broadcast(basis(planes).select("plane_id", *[f"{a}{k}" for a in "uv" for k in "xyz"])), "plane_id")
    uv = own.select("plane_id", dot(vec(""), vec("u")).alias("s"), dot(vec(""), vec("v")).alias("t"))
    g = uv.groupBy("plane_id").agg(F.min("s").alias("u0"), F.max("s").alias("u1"), F.min("t").alias("v0"), F.max("t").alias("v1"))
    return g.withColumn("area", (F.col("u1") - F.col("u0")) * (F.col("v1") - F.col("v0")))


def footprint_overlaps(points: DataFrame, planes: DataFrame, least: float = 0.3) -> DataFrame:
    """Planes i < j: share of the smaller bounding box, both in i's frame, that the other covers, and whether it reaches ``least``."""
    frames = [tuple(r) for r in basis(planes).select("plane_id", *[f"{a}{k}" for a in "uv" for k in "xyz"]).dropna().orderBy("plane_id").collect()]  # planes of a model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Boxes of the batch's points in the frame of every plane up to their own: no row per point and plane."""
        for batch in batches:
            own = batch.column("plane_id").to_numpy(zero_copy_only=False)
            at = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in XYZ])
            ids, which = np.unique(own, return_inverse=True)
            rows = []
            for frame, *uv in frames:
                s, t = (sum(at[i] * uv[k + i] for i in range(3)) for k in (0, 3))
                ends = [np.full(len(ids), v) for v in (np.inf, -np.inf, np.inf, -np.inf)]
                for f, out, x in ((np.minimum, ends[0], s), (np.maximum, ends[1], s), (np.minimum, ends[2], t), (np.maximum, ends[3], t)):
                    f.at(out, which, x)
                rows += [(frame, int(k), *(float(e[i]) for e in ends)) for i, k in enumerate(ids.tolist()) if k >= frame]
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            kinds = [pa.int64(), pa.int64(), *[pa.float64()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["frame", "plane_id", "s0", "s1", "t0", "t1"])

    parts = points.select(F.col("plane_id").cast("long").alias("plane_id"), *XYZ).dropna().mapInArrow(run, "frame long, plane_id long, s0 double, s1 double, t0 double, t1 double")
    boxes = parts.groupBy("frame", "plane_id").agg(*[f(f"{c}{k}").alias(f"{c}{k}") for c in "st" for k, f in ((0, F.min), (1, F.max))])
    a = boxes.where("frame = plane_id").select(F.col("frame").alias("i"), *[F.col(f"{c}{k}").alias(f"a_{c}{k}") for c in "st" for k in (0, 1)])
    both = boxes.where("frame <> plane_id").join(F.broadcast(a), F.col("frame") == F.col("i"))
    side = [F.least(f"{c}1", f"a_{c}1") - F.greatest(f"{c}0", f"a_{c}0") for c in "st"]
    areas = [(F.col(f"{p}s1") - F.col(f"{p}s0")) * (F.col(f"{p}t1") - F.col(f"{p}t0")) for p in ("", "a_")]
    shared = F.when((side[0] > 0) & (side[1] > 0), side[0] * side[1])
    share = F.coalesce(shared / F.greatest(F.least(*areas), F.lit(1e-12)), F.lit(0.0))
    return both.select("i", F.col("plane_id").alias("j"), share.alias("share"), (shared.isNotNull() & (share >= least)).alias("overlaps"))


def snap_to_corners(points: DataFrame, corners: DataFrame, most: float) -> DataFrame:
    """pid and the nearest corner (i, j, k, x, y, z) within ``most``; points further away keep their place. Both meet by grid cell."""
    number = F.struct("i", "j", "k", *[F.col(c).alias(f"c{c}") for c in XYZ])
    corners = saved(corners, "corners")  # a model's few, asked for twice
    near = radius_pairs(corners.select(number.alias("pid"), *XYZ), points.select("pid", *XYZ), most)
    best = near.groupBy("nid").agg(F.min_by("pid", F.struct(F.round("d2", 12), "pid.i", "pid.j", "pid.k")).alias("b"))
    both = points.select("pid", *XYZ).join(best.withColumnRenamed("nid", "pid"), "pid", "left")
    close = F.col("b").isNotNull()
    return both.select("pid", *[F.when(close, F.col(f"b.c{k}")).otherwise(F.col(k)).alias(k) for k in "xyz"], close.alias("snapped"))


def snap_to_lines(points: DataFrame, lines: DataFrame, most: float) -> DataFrame:
    """pid and the foot on the nearest line (i, j, direction d, place p) within ``most``, the lower (i, j) on ties; points further away keep their place.

    The lines are a model's; every task compares its points with them, so no row per point and line is made.
    """
    own = [tuple(r) for r in lines.select(*[f"d{k}" for k in "xyz"], *[f"p{k}" for k in "xyz"]).orderBy("i", "j").collect()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.float64) for c in XYZ])
            least, foot = np.full(at.shape[1], np.inf), at.copy()
            for line in own:
                t = sum((at[i] - line[3 + i]) * line[i] for i in range(3))
                on = np.stack([line[3 + i] + line[i] * t for i in range(3)])
                d2 = ((at - on) ** 2).sum(axis=0)
                better = np.round(d2, 12) < least
                least[better], foot[:, better] = np.round(d2, 12)[better], on[:, better]
            close = least <= most * most
            moved = np.where(close, foot, at)
            yield pa.RecordBatch.from_arrays([batch.column("pid"), *map(pa.array, moved), pa.array(close)], names=["pid", *XYZ, "snapped"])

    kind = points.schema["pid"].dataType.simpleString()
    return points.select("pid", *XYZ).mapInArrow(run, f"pid {kind}, x double, y double, z double, snapped boolean")


def classify(surfaces: DataFrame) -> DataFrame:
    """Class of each surface (nz, mean_z) by its slope and its height between the lowest and highest surface."""
    box = surfaces.agg(F.min("mean_z").alias("__lo"), F.max("mean_z").alias("__hi"))
    both = surfaces.crossJoin(F.broadcast(box))  # one row
    rel = (F.col("mean_z") - F.col("__lo")) / F.when(F.col("__hi") > F.col("__lo"), F.col("__hi") - F.col("__lo")).otherwise(F.lit(1.0))
    flat, steep = F.abs("nz") >= math.cos(math.radians(30)), F.abs("nz") <= math.cos(math.radians(60))
    kind = F.when(flat & (rel <= 0.25), "floor").when(flat & (rel >= 0.75), "ceiling").when(flat, "slab").when(steep, "wall").otherwise("sloped")
    return both.withColumn("class", kind).drop("__lo", "__hi")


def refine(surfaces: DataFrame, rms_limit: float = 0.025) -> DataFrame:
    """sloped above the highest wall (or mid height) becomes roof; rough floor or slab becomes terrain."""
    box = surfaces.agg(
        F.coalesce(F.max(F.when(F.col("class") == "wall", F.col("mean_z"))), (F.min("mean_z") + F.max("mean_z")) / 2).alias("__top")
    )
    both = surfaces.crossJoin(F.broadcast(box))  # one row
    kind = (
        F.when((F.col("class") == "sloped") & (F.col("mean_z") > F.col("__top")), "roof")
        .when(F.col("class").isin("floor", "slab") & (F.col("rms") > rms_limit), "terrain")
        .otherwise(F.col("class"))
    )
    return both.withColumn("class", kind).drop("__top")


def takeoff(surfaces: DataFrame) -> DataFrame:
    """Count and area by class, and the total as class null, in one pass."""
    return surfaces.rollup("class").agg(F.count(F.lit(1)).alias("n"), F.sum("area").alias("area"))


def roof_report(surfaces: DataFrame) -> DataFrame:
    """Slope and azimuth in degrees of each surface with an upward normal."""
    up = F.when(F.col("nz") < 0, -1.0).otherwise(1.0)
    azimuth = F.degrees(F.atan2(F.col("nx") * up, F.col("ny") * up))
    slope = F.degrees(F.acos(F.least(F.lit(1.0), F.abs("nz"))))
    return surfaces.select("plane_id", slope.alias("slope"), F.when(azimuth < 0, azimuth + 360).otherwise(azimuth).alias("azimuth"), "area")


def footprint(vertices: DataFrame) -> DataFrame:
    """One row: size_x, size_y and height of a model."""
    ends = [(F.max(c) - F.min(c)).alias(n) for c, n in zip(XYZ, ("size_x", "size_y", "height"), strict=True)]
    return vertices.agg(*ends)


def roof_summary(faces: DataFrame) -> DataFrame:
    """One row: ridge and eaves heights, total area and number of roof surfaces (plane_id, area, outline: array of x, y, z)."""
    tops, lows = (f(F.transform("outline", lambda p: p["z"])) for f in (F.array_max, F.array_min))
    return faces.agg(F.max(tops).alias("ridge"), F.min(lows).alias("eaves"), F.sum("area").alias("area"), F.count(F.lit(1)).alias("n"))
