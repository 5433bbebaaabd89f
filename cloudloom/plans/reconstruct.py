"""Reconstruction end to end: from points to classified surfaces with outlines, and a mesh of them.

Every length that is not given follows from the measured spacing, so one set of settings
serves rooms and small parts. Each stage writes its result once and the next reads it.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, fields, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloudloom.functions.linalg import dot, vec
from cloudloom.operators import mesh, planes, points, search, shapes, watertight
from cloudloom.operators.points import XYZ
from cloudloom.plans.scratch import saved


@dataclass(frozen=True)
class Settings:
    """Knobs of a reconstruction; factors are multiples of the spacing, None is worked out from it."""

    # Defaults of the knobs.
    voxel_size: float | None = None
    sor_neighbors: int = 16
    sor_std_ratio: float = 2.5
    normal_neighbors: int = 16
    edge_artifact_filter: bool = True
    ghost_offset_tol: float = 0.0
    distance_threshold: float | None = None
    distance_factor: float = 3.0
    normal_threshold_deg: float = 30.0
    min_inlier_ratio: float = 0.01
    min_inliers_abs: int = 60
    max_planes: int = 64
    regularize: bool = True
    parallel_tol_deg: float = 8.0
    ortho_tol_deg: float = 8.0
    merge_offset_factor: float = 4.0
    edge_snap_factor: float = 8.0
    corner_snap_factor: float = 12.0
    contact_factor: float = 6.0
    outward: bool = True
    seed: int = 7


# What a scene or a sensor changes.
SCENES = {
    "building": {},
    "indoor": {"outward": False, "normal_threshold_deg": 35.0, "edge_snap_factor": 10.0},
    "object": {"min_inlier_ratio": 0.02, "parallel_tol_deg": 10.0, "ortho_tol_deg": 10.0},
    "fast": {"max_planes": 32, "sor_neighbors": 8},
    "detail": {"min_inlier_ratio": 0.004, "min_inliers_abs": 40, "max_planes": 128},
}
SENSORS = {
    "standard": {},
    "slam": {"distance_factor": 3.5, "ghost_offset_tol": 0.03, "sor_std_ratio": 2.0, "normal_neighbors": 20},
    "tls": {"distance_factor": 2.5},
    "drone": {"distance_factor": 4.0, "sor_std_ratio": 2.0, "min_inlier_ratio": 0.012},
    "phone": {"distance_factor": 5.0, "min_inlier_ratio": 0.015, "normal_neighbors": 24},
}


def settings(scene: str = "building", sensor: str = "standard", **own) -> Settings:
    """Defaults, changed by the scene, then the sensor, then by what is given."""
    if scene not in SCENES or sensor not in SENSORS:
        raise ValueError(f"scene is one of {', '.join(SCENES)}; sensor one of {', '.join(SENSORS)}")
    unknown = set(own) - {f.name for f in fields(Settings)}
    if unknown:
        raise ValueError(f"no such settings: {', '.join(sorted(unknown))}")
    return replace(Settings(), **(SCENES[scene] | SENSORS[sensor] | own))


def signature(s: Settings) -> tuple:
    """What decides the preprocessing: runs that share it share its result."""
    return s.voxel_size, s.sor_neighbors, s.sor_std_ratio, s.edge_artifact_filter, s.normal_neighbors, s.ghost_offset_tol


def _first_cell(cloud: DataFrame) -> float:
    """A cell about one point fills, from the box and the count alone."""
    box = points.extent(cloud).first()
    sides = sorted((box[f"{n}_max"] or 0.0) - (box[f"{n}_min"] or 0.0) for n in XYZ)
    area = 2 * (sides[2] * sides[1] + sides[2] * sides[0] + sides[1] * sides[0])
    return max(1e-9, math.sqrt(area / max(1, box["n"])))


def preprocess(cloud: DataFrame, s: Settings, path: DataFrame | None = None) -> tuple[DataFrame, float]:
    """Thinned, cleaned points with normals (turned towards ``path`` if there is one), and their spacing."""
    cloud = saved(cloud.select("pid", *XYZ).dropna(), "cloud")
    cell = 3 * _first_cell(cloud)
    raw = points.median_spacing(cloud, cell).first()["spacing"]
    voxel = 2 * raw if s.voxel_size is None else s.voxel_size
    work = saved(points.voxel_downsample(cloud, voxel), "thin")
    cell = max(cell, 3 * voxel)
    work = saved(points.remove_statistical_outliers(work, s.sor_neighbors, s.sor_std_ratio, cell), "clean")
    if s.edge_artifact_filter and work.count() > 100:
        gone = points.edge_artifacts(work, sparse_only=False, cell=cell)
        work = saved(work.join(gone.hint("merge"), "pid", "left_anti"), "faces")
    if work.limit(16).count() < 16:
        raise ValueError("fewer than 16 points are left: check the units or the voxel size")
    normals = saved(points.steady_normals(work, s.normal_neighbors, cell), "normals")
    if path is not None:
        normals = points.towards(normals, work, path, 4 * cell)
    work = saved(work.join(normals.hint("merge"), "pid"), "work")
    return work, float(points.median_spacing(work, cell).first()["spacing"])


def snapped(outlines: DataFrame, fit: DataFrame, own: DataFrame, spacing: float, s: Settings) -> DataFrame:
    """Outlines whose corners lie on the corners and lines in which the planes meet, where these are near.

    Planes meet where their points do. A corner of an outline goes to the nearest corner of its
    plane within ``corner_snap_factor`` spacings, else to the nearest line within
    ``edge_snap_factor``; what falls together or in line is one.
    """
    met = planes.adjacency(own.select("pid", "plane_id", *XYZ), fit, s.contact_factor * spacing)
    met = saved(met.select("i", "j"), "met")
    lines = planes.intersection_lines(fit).join(F.broadcast(met), ["i", "j"])
    tops = planes.supported(saved(planes.corner_points(fit, met), "corners"), own, s.corner_snap_factor * spacing)
    lines = saved(lines.withColumn("plane_id", F.explode(F.array("i", "j"))).select("plane_id", *[f"{k}{c}" for k in "dp" for c in XYZ]), "lines")
    tops = saved(tops.withColumn("plane_id", F.explode(F.array("i", "j", "k"))).select("plane_id", *[F.col(c).alias(f"c{c}") for c in XYZ]), "tops")
    frames = planes.basis(fit).select("plane_id", "d", *[f"{a}{c}" for a in "nuv" for c in XYZ])
    rings = outlines.select("plane_id", F.posexplode(F.concat(F.array("loop"), "holes")).alias("ring", "p"))
    ends = rings.select("plane_id", "ring", F.posexplode("p").alias("k", "p")).select("plane_id", "ring", "k", "p.u", "p.v").join(F.broadcast(frames), "plane_id")
    ends = ends.withColumns({c: F.col(f"u{c}") * F.col("u") + F.col(f"v{c}") * F.col("v") - F.col(f"n{c}") * F.col("d") for c in XYZ})
    ends = saved(ends.select("plane_id", "ring", "k", *XYZ, *[f"{a}{c}" for a in "uv" for c in XYZ]), "ends")
    key = ["plane_id", "ring", "k"]
    gap = sum((F.col(c) - F.col(f"c{c}")) * (F.col(c) - F.col(f"c{c}")) for c in XYZ)
    near = ends.join(F.broadcast(tops), "plane_id").withColumn("gap", gap).where(F.col("gap") <= (s.corner_snap_factor * spacing) ** 2)
    at = near.groupBy(*key).agg(F.min_by(F.struct(*[f"c{c}" for c in XYZ]), F.struct(F.round("gap", 12), *[f"c{c}" for c in XYZ])).alias("top"))
    t = sum((F.col(c) - F.col(f"p{c}")) * F.col(f"d{c}") for c in XYZ)
    foot = ends.join(F.broadcast(lines), "plane_id").withColumn("t", t).withColumns({f"f{c}": F.col(f"p{c}") + F.col(f"d{c}") * F.col("t") for c in XYZ})
    foot = foot.withColumn("gap", sum((F.col(c) - F.col(f"f{c}")) * (F.col(c) - F.col(f"f{c}")) for c in XYZ)).where(F.col("gap") <= (s.edge_snap_factor * spacing) ** 2)
    on = foot.groupBy(*key).agg(F.min_by(F.struct(*[f"f{c}" for c in XYZ]), F.struct(F.round("gap", 12), *[f"f{c}" for c in XYZ])).alias("foot"))
    both = ends.join(at, key, "left").join(on, key, "left")
    both = both.withColumns({c: F.coalesce(F.col(f"top.c{c}"), F.col(f"foot.f{c}"), F.col(c)) for c in XYZ})
    flat = both.select(*key, F.struct("k", *[sum(F.col(c) * F.col(f"{a}{c}") for c in XYZ).alias(a) for a in "uv"]).alias("p"))
    again = flat.groupBy("plane_id", "ring").agg(F.transform(F.sort_array(F.collect_list("p")), lambda x: F.struct(x["u"].alias("u"), x["v"].alias("v"))).alias("loop"))
    again = saved(shapes.reshaped(again, 0.0, None), "rings").where(F.size("loop") >= 3)
    ring = F.zip_with("loop", F.concat(F.slice("loop", 2, F.size("loop")), F.slice("loop", 1, 1)), lambda a, b: a["u"] * b["v"] - b["u"] * a["v"])
    again = again.withColumn("area", F.aggregate(ring, F.lit(0.0), lambda a, x: a + x) / 2)
    outer = again.where("ring = 0").select("plane_id", "loop", "area")
    inner = again.where("ring > 0").groupBy("plane_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("ring", "loop"))), lambda x: x["loop"]).alias("holes"))
    return outer.join(inner, "plane_id", "left").select("plane_id", "loop", F.coalesce("holes", F.expr("array()").cast(f"array<{shapes.LOOP}>")).alias("holes"), "area")


def found_planes(cloud: DataFrame, s: Settings, path: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame, float]:
    """Planes (turned outwards), the points on them (pid, plane_id, x, y, z), the points' owners, and the spacing."""
    work, spacing = preprocess(cloud, s, path)
    threshold = s.distance_threshold or s.distance_factor * spacing
    least = max(s.min_inliers_abs, int(s.min_inlier_ratio * work.count()))
    reach = max(4 * threshold, 3 * spacing)
    _, owners = search.detect(work, threshold, s.normal_threshold_deg, least, s.max_planes, reach, seed=s.seed)
    if owners.isEmpty():
        # doubled walls of a bad registration fill the whole slab: once more with wider limits
        _, owners = search.rescue(work, owners, threshold, least, normal_deg=s.normal_threshold_deg, max_planes=s.max_planes, radius=reach)
        threshold *= 1.6
    owners = saved(owners, "owners")
    own = saved(work.join(owners.hint("merge"), "pid"), "own")
    fit = planes.fit_planes(own)
    if s.regularize:
        fit, to = search.regularise(own, fit, s.parallel_tol_deg, s.ortho_tol_deg, s.merge_offset_factor * threshold, s.ghost_offset_tol)
        own = saved(own.join(F.broadcast(to), "plane_id").drop("plane_id").withColumnRenamed("to", "plane_id"), "own")  # a row per plane
    fit = saved(search.oriented(fit, work, s.outward), "planes")
    return fit, own, owners, spacing


def surfaces(cloud: DataFrame, s: Settings | None = None, path: DataFrame | None = None) -> tuple[DataFrame, DataFrame, float]:
    """Surfaces (plane_id, n, normal, d, rms, mean_z, class, outline, holes, area), the points' owners, and the spacing."""
    s = s or Settings()
    fit, own, owners, spacing = found_planes(cloud, s, path)
    frames = planes.basis(fit).select("plane_id", *[f"{a}{k}" for a in "uv" for k in XYZ])
    uv = own.select("pid", "plane_id", *XYZ).join(F.broadcast(frames), "plane_id")
    uv = uv.select("plane_id", *[dot(vec(""), vec(a)).alias(a) for a in "uv"])
    outlines = saved(shapes.surfaces(uv, spacing), "outlines")
    outlines = saved(snapped(outlines, fit, own, spacing, s), "snapped")
    named = planes.refine(planes.classify(fit.withColumn("mean_z", F.col("mz"))))
    return saved(named.join(outlines.select("plane_id", "loop", "holes", F.abs("area").alias("area")), "plane_id"), "surfaces"), owners, spacing


def closed_model(cloud: DataFrame, s: Settings | None = None, path: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The closed model of a cloud instead of single outlines: surfaces (plane_id, class, area, covered), faces, vertices.

    ``covered`` is the area that points measured; the rest of a surface was hidden and follows from
    the planes around it. Planes that bound nothing have no surface. More than 30 planes raise an error.
    """
    s = s or Settings()
    fit, own, _, spacing = found_planes(cloud, s, path)
    facets, _ = watertight.close(own.select("plane_id", *XYZ), fit, 2 * spacing)
    facets = saved(facets, "facets")
    faces, vertices = watertight.as_mesh(facets)
    height = F.aggregate("polygon", F.lit(0.0), lambda total, p: total + p["z"]) / F.size("polygon")
    held = facets.groupBy("plane_id").agg(F.sum("area").alias("area"), F.sum("covered").alias("covered"), (F.sum(height * F.col("area")) / F.sum("area")).alias("mean_z"))
    named = planes.refine(planes.classify(held.join(F.broadcast(fit.select("plane_id", "nz", "rms")), "plane_id")))  # a row per plane
    return named.select("plane_id", "class", "area", "covered"), saved(faces, "faces"), saved(vertices, "vertices")


def surface_mesh(found: DataFrame) -> DataFrame:
    """Triangles (fid, plane_id, ax .. cz) of the surfaces' outlines with their holes, in space."""
    tri = shapes.triangles(found.select(F.col("plane_id").alias("poly"), "loop", "holes"))
    own = planes.basis(found.select("plane_id", "nx", "ny", "nz", "d"))
    both = tri.withColumnRenamed("poly", "plane_id").join(F.broadcast(own), "plane_id")  # a row per plane
    at = [
        (F.col(f"u{c}") * F.col(f"{k}_u") + F.col(f"v{c}") * F.col(f"{k}_v") - F.col(f"n{c}") * F.col("d")).alias(f"{k}{c}")
        for k in "abc" for c in XYZ
    ]
    return both.select(F.monotonically_increasing_id().alias("fid"), "plane_id", *at)


def fit_score(found: DataFrame, work: DataFrame, spacing: float) -> dict[str, float]:
    """How well surfaces explain points: p95 of the distances that are near, the share that is not, and one number, less is better."""
    tri = surface_mesh(found)
    far = saved(mesh.signed_distance(work.select("pid", *XYZ), tri).select(F.abs("d").alias("d")), "far")
    band = 5 * spacing
    facts = far.agg(F.percentile_approx(F.when(F.col("d") <= band, F.col("d")), 0.95, 10_000).alias("p95"), F.avg((F.col("d") <= band).cast("double")).alias("near")).first()
    p95, missing, n = facts["p95"] if facts["p95"] is not None else band, 1 - (facts["near"] or 0.0), found.count()
    return {"p95": p95, "unexplained": missing, "surfaces": float(n), "score": p95 / max(spacing, 1e-9) + 3 * missing + 0.002 * n}


def tune(cloud: DataFrame, candidates: dict[str, Settings]) -> tuple[str, dict[str, dict[str, float]]]:
    """The candidate of the least score, and all scores; a candidate that finds nothing has none."""
    scores: dict[str, dict[str, float]] = {}
    for name, s in candidates.items():
        found, _, spacing = surfaces(cloud, s)
        if not found.isEmpty():
            scores[name] = fit_score(found, cloud.dropna(subset=list(XYZ)), spacing)
    if not scores:
        raise ValueError("no candidate found a surface")
    return min(scores, key=lambda k: (scores[k]["score"], k)), scores


def report(found: DataFrame) -> DataFrame:
    """Count and area by class, and the total as class null."""
    return planes.takeoff(found)
