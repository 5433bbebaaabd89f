"""Registration and epochs: similarity fits, trimmed point-to-plane alignment, signed change.

Pairs are found by the distributed nearest-neighbour search; what comes to the driver are
sums of a fixed number (27 a step, or 16 of a similarity fit) and the matrix they give.

Edge cases: rows with a null coordinate pair with nothing; fewer than ``least`` pairs end the
loop with the matrix so far; singular sums are solved in the least-squares sense.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloudloom.functions.linalg import dot, minus, vec
from cloudloom.functions.quantiles import percentiles
from cloudloom.operators.fitting import icp_sums
from cloudloom.operators.points import XYZ, _cell_size, _in_blocks, estimate_normals, knn, median_spacing, transform
from cloudloom.plans.scratch import saved

#: Limits of the change histogram in metres.
CHANGE_EDGES = (0.0, 0.001, 0.002, 0.005, 0.010, 0.020, 0.050, 0.100, math.inf)


@dataclass(frozen=True)
class Registration:
    """``matrix``: row-major 3 x 4, source to target."""

    matrix: tuple[float, ...]
    rmse: float
    iterations: int
    converged: bool


def rotation(w: np.ndarray) -> np.ndarray:
    """Rotation by the vector ``w``: axis times angle."""
    angle = float(np.linalg.norm(w))
    k = np.array([[0, -w[2], w[1]], [w[2], 0, -w[0]], [-w[1], w[0], 0]])
    if angle < 1e-12:
        return np.eye(3) + k
    return np.eye(3) + math.sin(angle) / angle * k + (1 - math.cos(angle)) / angle**2 * k @ k


def step_of(row) -> tuple[np.ndarray, np.ndarray]:
    """Rotation and shift that solve the normal equations of one step."""
    a = np.zeros((6, 6))
    for i in range(6):
        for j in range(i, 6):
            a[i, j] = a[j, i] = row[f"a{i}{j}"]
    x = np.linalg.lstsq(a, np.array([row[f"b{i}"] for i in range(6)]), rcond=None)[0]
    return rotation(x[:3]), x[3:]


def summed_points(points: DataFrame, size: float) -> DataFrame:
    """A row per cell of that size, of all points in it: pid (of the cell), their mean place and how many (w); with normals also a row per axis these are nearest to, and their mean."""
    normals = [c for c in ("nx", "ny", "nz") if c in points.columns]
    # about multiples of their size, where models have their faces: a face's noise is not cut in two there
    keyed = points.dropna(subset=list(XYZ)).withColumns({f"c{c}": F.floor(F.col(c) / size + 0.5) for c in XYZ})
    key = ["cx", "cy", "cz"]
    if normals:
        steep = F.greatest(*[F.abs(c) for c in normals])
        keyed = keyed.where(steep > 0).withColumn("axis", F.when(F.abs("nx") == steep, 0).when(F.abs("ny") == steep, 1).otherwise(2))
        # one side for all, or opposite normals of a face would cancel
        turn = F.signum(F.element_at(F.array(*normals), F.col("axis") + 1))
        keyed, key = keyed.withColumns({c: F.col(c) * turn for c in normals}), [*key, "axis"]
    cells = keyed.groupBy(*key).agg(F.count(F.lit(1)).alias("w"), *[F.avg(c).alias(c) for c in (*XYZ, *normals)])
    size_n = F.sqrt(sum(F.col(c) * F.col(c) for c in normals)) if normals else None
    return cells.select(F.xxhash64(*key).alias("pid"), "w", *XYZ, *[(F.col(c) / size_n).alias(c) for c in normals])


def register(
    source: DataFrame, target: DataFrame, cell: float, steps: int = 40, trim: float = 0.8, most: float | None = None,
    sample: int | None = None, tolerance: float = 1e-7, least: int = 50, k: int = 16, summed: float | None = None,
) -> Registration:
    """Trimmed point-to-plane alignment of ``source`` (pid, x, y, z) onto ``target``, with normals or without.

    Each step pairs the moved source with its nearest target points closer than ``most`` (20
    spacings of the target if not given), keeps the best share ``trim`` of them, and solves for a
    small motion. ``sample``: so many source points, by hash, take part (all if not given).
    ``summed``: all points of both are first summed in cells of that size; the steps pair means of
    cells up to four cells apart, which count as many as their points and are trimmed by how far
    they lie off the target's plane. Points that lie closer than their noise is thick pair by chance, their means don't; and
    a step's work follows the cells, not the points.
    """
    if "nx" not in target.columns:
        target = target.select("pid", *XYZ).join(estimate_normals(target, k, cell), "pid")
    if summed:
        source, target = summed_points(source.select(*XYZ), summed), summed_points(target, summed)
    target = saved(target.select("pid", *XYZ, "nx", "ny", "nz"), "target")
    if most is None:
        most = 20 * (median_spacing(target, cell).first()["spacing"] or 0.0)
    source = source.select("pid", *XYZ, F.col("w") if summed else F.lit(1).alias("w"))
    if sample:
        source = source.orderBy(F.xxhash64("pid"), "pid").limit(sample)
    source = saved(source, "source")
    facts = target.select(F.col("pid").alias("nid"), *[F.col(c).alias(f"t{c}") for c in XYZ], "nx", "ny", "nz")
    if summed:
        reach = min(most, 4 * summed)
    else:
        # told once: each search would count the target's cells anew, size by size
        cell = _cell_size(target.select(*XYZ).dropna(), cell, 1)[0]
    whole, rmse, done = np.hstack([np.eye(3), np.zeros((3, 1))]), math.inf, 0
    for done in range(1, steps + 1):
        moved = transform(source, [float(v) for v in whole.ravel()])
        if summed:
            # cells lie sparse: one pass finds what lies within reach
            pairs, gap = _in_blocks(moved, target, 1, reach, 8, False).where(F.col("d2") <= reach * reach), F.abs(dot(minus(vec("t"), vec("")), vec("n")))
        else:
            pairs, gap = knn(moved, target, 1, cell).where(F.col("d2") < most * most), F.sqrt("d2")
        # merged: sizes told by compressed files would have these sent whole through the driver
        pairs = saved(pairs.join(facts.hint("merge"), "nid").join(moved.hint("merge"), "pid").withColumn("gap", gap), "pairs")
        if pairs.limit(least).count() < least:
            break
        # cells are few: no task that holds their gaps grows with the points
        limit = pairs.agg(F.percentile("gap", F.lit(trim))).first()[0] if summed else percentiles(pairs, None, {"gap": [trim]})[0]["gap"][0]
        row = icp_sums(pairs.where(F.col("gap") <= limit), "w").first()
        turn, shift = step_of(row)
        whole = np.hstack([turn @ whole[:, :3], (turn @ whole[:, 3] + shift)[:, None]])
        size = math.sqrt(float(np.sum(shift**2)) + float(np.sum((turn - np.eye(3)) ** 2)) / 2)
        settled, rmse = abs(rmse - row["rmse"]) < tolerance and size < 1e-6, row["rmse"]
        if settled:
            return Registration(tuple(map(float, whole.ravel())), rmse, done, True)
    return Registration(tuple(map(float, whole.ravel())), rmse, done, False)


def changes(reference: DataFrame, current: DataFrame, cell: float, k: int = 12) -> DataFrame:
    """pid, nid, change: how far each current point lies along the normal of its nearest reference point."""
    normals = estimate_normals(reference, k, cell)
    facts = reference.select("pid", *XYZ).join(normals, "pid").select(F.col("pid").alias("nid"), *[F.col(c).alias(f"t{c}") for c in XYZ], "nx", "ny", "nz")
    pairs = knn(current.select("pid", *XYZ), reference.select("pid", *XYZ), 1, cell)
    both = pairs.select("pid", "nid").join(facts, "nid").join(current.select("pid", *XYZ), "pid")
    return both.select("pid", "nid", dot(minus(vec(""), vec("t")), vec("n")).alias("change"))


def change_statistics(changed: DataFrame, tolerance: float = 0.005) -> DataFrame:
    """One row: points, share within ``tolerance``, rms, 95 % quantile, largest, and the histogram of the sizes."""
    size = F.abs("change")
    bins = [F.count_if((size >= a) & ((size < b) | F.lit(b == math.inf))).alias(f"h{i}") for i, (a, b) in enumerate(zip(CHANGE_EDGES, CHANGE_EDGES[1:], strict=False))]
    return changed.agg(
        F.count(F.lit(1)).alias("points"), F.avg((size <= tolerance).cast("double")).alias("within"),
        F.sqrt(F.avg(F.col("change") * F.col("change"))).alias("rms"), F.percentile(size, F.lit(0.95)).alias("p95"), F.max(size).alias("largest"), *bins,
    )


def diverging(change: Column, scale: Column) -> Column:
    """Blue (towards) over white to red (away): struct r, g, b of 0..255, full at ``scale``."""
    t = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), change / scale))
    fade = F.round((1 - F.abs(t)) * 255).cast("int")
    return F.struct(
        F.when(t < 0, fade).otherwise(255).cast("int").alias("r"), fade.alias("g"), F.when(t > 0, fade).otherwise(255).cast("int").alias("b")
    )


def similarity(pairs: DataFrame, scaled: bool = True) -> tuple[float, np.ndarray, np.ndarray]:
    """Scale, rotation, shift that carry (sx, sy, sz) to (tx, ty, tz) with least squares, from 16 moments of the pairs."""
    means = {f"{p}{c}": F.avg(f"{p}{c}") for p in "st" for c in XYZ}
    crossed = {f"c{a}{b}": F.covar_pop(f"t{a}", f"s{b}") for a in XYZ for b in XYZ}
    own = sum(F.var_pop(f"s{c}") for c in XYZ)
    row = pairs.agg(*[e.alias(n) for n, e in (means | crossed).items()], own.alias("spread")).first()
    if row["sx"] is None:
        return 1.0, np.eye(3), np.zeros(3)
    u, d, vt = np.linalg.svd(np.array([[row[f"c{a}{b}"] for b in XYZ] for a in XYZ]))
    flip = np.diag([1.0, 1.0, np.sign(np.linalg.det(u) * np.linalg.det(vt)) or 1.0])
    turn = u @ flip @ vt
    scale = float((d * np.diag(flip)).sum() / row["spread"]) if scaled and row["spread"] > 0 else 1.0
    s, t = (np.array([row[f"{p}{c}"] for c in XYZ]) for p in "st")
    return scale, turn, t - scale * turn @ s


def residuals(pairs: DataFrame, fit: tuple[float, np.ndarray, np.ndarray]) -> DataFrame:
    """``pairs`` with the distance left between the carried source and the target."""
    scale, turn, shift = fit
    gap = [F.col(f"t{a}") - (sum(F.col(f"s{b}") * float(scale * turn[i, j]) for j, b in enumerate(XYZ)) + float(shift[i])) for i, a in enumerate(XYZ)]
    return pairs.withColumn("residual", F.sqrt(sum(g * g for g in gap)))


def compare_epochs(reference: DataFrame, current: DataFrame, cell: float, aligned: bool = True, **kw) -> tuple[DataFrame, Registration | None]:
    """Signed changes of ``current`` against ``reference``, after aligning it if ``aligned``."""
    found = register(current, reference, cell, **kw) if aligned else None
    moved = transform(current, list(found.matrix)) if found else current
    return changes(reference, moved, cell), found
