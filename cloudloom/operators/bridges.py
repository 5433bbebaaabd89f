"""Bridges: pylons from columns of occupied cells, cables from lines, stations in the deck's frame, the type.

Pylons are found in a grid seen from above: a cell belongs to one if its points reach high and
fill that height, bin by bin; eight-connected groups of such cells are pylons. Cables are
searched among the other points like planes are: a bounded number of lines through two
points, one job that counts what each and any two explain, all that do not overlap fitted at
once, kept if they are long, thin and stretched.

Edge cases: rows with a null coordinate take no part; equal points count each; too few points
give no pylons and no cables; a level cable has an inclination of 90 degrees.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cloudloom.functions.linalg import moments
from cloudloom.functions.quantiles import percentiles
from cloudloom.operators.graph import components, grid_components
from cloudloom.operators.points import XYZ
from cloudloom.operators.search import _taken, counted
from cloudloom.plans.scratch import saved

_CABLE = "cable_id long, n long, " + ", ".join(f"{p}{c} double" for p in "se" for c in XYZ) + ", length double, diameter double, inclination_deg double"


def column_cells(points: DataFrame, cell: float, least_height: float, filled: float = 0.6) -> DataFrame:
    """(cx, cy, z0, z1): cells seen from above whose points reach at least ``least_height`` and fill more than ``filled`` of its bins."""
    keyed = points.select(*XYZ).dropna().select(F.floor(F.col("x") / cell).alias("cx"), F.floor(F.col("y") / cell).alias("cy"), "z")
    tall = keyed.groupBy("cx", "cy").agg(F.min("z").alias("z0"), F.max("z").alias("z1")).where(F.col("z1") - F.col("z0") > least_height)
    tall = saved(tall.withColumn("bins", F.greatest(F.lit(4), F.floor((F.col("z1") - F.col("z0")) / cell))), "tall")
    own = keyed.join(tall, ["cx", "cy"])
    bin_ = F.least(F.floor((F.col("z") - F.col("z0")) / (F.col("z1") - F.col("z0")) * F.col("bins")), F.col("bins") - 1)
    # a row per cell and bin first, so that a crowded column is no hot key
    held = own.select("cx", "cy", "z0", "z1", "bins", bin_.alias("bin")).distinct().groupBy("cx", "cy", "z0", "z1", "bins").agg(F.count(F.lit(1)).alias("n"))
    return held.where(F.col("n") > filled * F.col("bins")).select("cx", "cy", "z0", "z1")


def pylons(points: DataFrame, cell: float, least_height: float, least_cells: int = 4) -> tuple[DataFrame, DataFrame]:
    """(pylon, x, y, width_x, width_y, z0, z1, cells) and their cells (cx, cy, pylon): groups of ``least_cells`` column cells or more."""
    half = 1 << 30
    cells = saved(column_cells(points, cell, least_height).withColumn("node", F.shiftleft(F.col("cx") + half, 32).bitwiseOR(F.col("cy") + half)), "columns")
    steps = F.array(*[F.lit((i << 32) + j) for i in (-1, 0, 1) for j in (-1, 0, 1) if (i, j) > (0, 0)])
    ahead = cells.select(F.col("node").alias("a"), F.explode(steps).alias("s")).select("a", (F.col("a") + F.col("s")).alias("b"))
    rooted = cells.join(components(cells, ahead.join(cells.select(F.col("node").alias("b")), "b")), "node")
    groups = rooted.groupBy(F.col("root").alias("pylon")).agg(
        F.count(F.lit(1)).alias("cells"), *[f(c).alias(f"{c}{k}") for c in ("cx", "cy") for k, f in (("0", F.min), ("1", F.max))], F.min("z0").alias("z0"), F.max("z1").alias("z1")
    ).where(F.col("cells") >= least_cells)
    middle = [((F.col(f"c{c}0") + F.col(f"c{c}1") + 1) / 2 * cell).alias(c) for c in "xy"]
    width = [F.greatest((F.col(f"c{c}1") - F.col(f"c{c}0") + 1) * cell, F.lit(0.3)).alias(f"width_{c}") for c in "xy"]
    found = saved(groups.select("pylon", *middle, *width, "z0", "z1", "cells"), "pylons")
    return found, rooted.select("cx", "cy", F.col("root").alias("pylon")).join(found.select("pylon"), "pylon", "left_semi")


def beside(points: DataFrame, cells: DataFrame, cell: float) -> DataFrame:
    """Points outside the given cells seen from above."""
    keyed = points.withColumns({"__i": F.floor(F.col("x") / cell), "__j": F.floor(F.col("y") / cell)})
    there = cells.select(F.col("cx").alias("__i"), F.col("cy").alias("__j"))
    return keyed.join(there, ["__i", "__j"], "left_anti").drop("__i", "__j")


def _line_distance(p: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """Distances of points (columns) to lines (rows of a place and a unit direction)."""
    d = [p[i] - lines[:, i : i + 1] for i in range(3)]
    t = sum(d[i] * lines[:, 3 + i : 4 + i] for i in range(3))
    off = [d[i] - t * lines[:, 3 + i : 4 + i] for i in range(3)]
    return np.sqrt(off[0] ** 2 + off[1] ** 2 + off[2] ** 2)


def on_lines(points: DataFrame, lines: np.ndarray, tolerance: float) -> DataFrame:
    """Points (pid, x, y, z) with the nearest line (its row number) within ``tolerance``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, 16_384):
                part = batch.slice(s, 16_384)
                off = _line_distance(np.stack([part.column(c).to_numpy(zero_copy_only=False) for c in XYZ]), lines)
                best = off.argmin(axis=0)
                on = np.flatnonzero(off[best, np.arange(part.num_rows)] < tolerance)
                yield pa.RecordBatch.from_arrays([*part.take(pa.array(on)).columns, pa.array(best[on].astype(np.int64))], names=["pid", *XYZ, "line"])

    return points.select("pid", *XYZ).mapInArrow(run, "pid long, x double, y double, z double, line long")


def _fits(own: DataFrame) -> dict[int, tuple[int, np.ndarray, np.ndarray, float, float]]:
    """Per line: points, the line fitted to them, spreads, how stretched and how thick they are; a row of moments each comes to the driver."""
    sums = own.groupBy("line").agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"m{c}") for c in XYZ], *[F.covar_pop(a, b).alias(f"c{a}{b}") for a in XYZ for b in XYZ if a <= b]
    )
    out = {}
    for r in sums.collect():
        values, vectors = np.linalg.eigh(np.array([[r[f"c{min(a, b)}{max(a, b)}"] for b in XYZ] for a in XYZ]))
        across = max(float(values[1]), 0.0)
        line = np.array([*[r[f"m{c}"] for c in XYZ], *vectors[:, 2]])
        out[r["line"]] = r["n"], line, values, math.sqrt(values[2] / max(across, 1e-12)), 2 * math.sqrt(across)
    return out


#: Parts of a line's length, and the share of them in which a cable must have points.
PARTS, WHOLE = 16, 0.75


def _ends(own: DataFrame, facts: dict[int, tuple]) -> dict[int, tuple]:
    """Per line: its outermost points, the percentiles 1 and 99 along it, and the share of ``PARTS`` between these that hold points; a row each comes to the driver."""
    spark = own.sparkSession
    table = spark.createDataFrame([(k, *map(float, f[1])) for k, f in facts.items()], "line long, " + ", ".join(f"{p}{c} double" for p in "oa" for c in XYZ))
    t = sum((F.col(c) - F.col(f"o{c}")) * F.col(f"a{c}") for c in XYZ)
    along = own.join(F.broadcast(table), "line").withColumn("t", t)  # a row per line
    spot = F.struct(*XYZ)
    ends = along.groupBy("line").agg(
        F.min_by(spot, F.struct("t", "pid")).alias("s"), F.max_by(spot, F.struct("t", "pid")).alias("e")
    ).collect()
    q = {k: x["t"] for k, x in percentiles(along, "line", {"t": [0.01, 0.99]}).items()}
    cut = spark.createDataFrame([(k, *x) for k, x in q.items()], "line long, q0 double, q1 double")
    part = F.floor((F.col("t") - F.col("q0")) / (F.col("q1") - F.col("q0")) * PARTS)
    held = along.join(F.broadcast(cut), "line").withColumn("part", part).where(F.col("part").between(0, PARTS - 1))
    held = {r["line"]: r["n"] for r in held.select("line", "part").distinct().groupBy("line").agg(F.count(F.lit(1)).alias("n")).collect()}
    return {r["line"]: (r["s"], r["e"], q[r["line"]], held.get(r["line"], 0) / PARTS) for r in ends}


def cables(
    points: DataFrame, tolerance: float, least_length: float, most_thick: float, apart: float, least_points: int = 60, most: int = 24, least_stretch: float = 8.0,
    hypotheses: int = 256, share: float = 0.3, seed: int = 7, dry: int = 3,
) -> DataFrame:
    """Cables (cable_id, n, start and end, length, diameter, inclination from the vertical), those of most points first.

    A line's points lie within ``tolerance``; it is a cable if its spread along is ``least_stretch``
    times that across, it is longer than ``least_length`` (between its percentiles 1 and 99) and
    thinner than ``most_thick``, and if its points lie all along it: a line across some cables has
    its points where it meets them, however many these are. A piece of a cable found before (parallel within five degrees, its
    middle within ``apart`` of its line) is not told again.
    """
    spark = points.sparkSession
    left = saved(points.select(F.col("pid").cast("long").alias("pid"), *XYZ).dropna(), "left")
    found: list[tuple] = []
    idle, round_ = 0, 0
    while idle < dry and len(found) < most and left.count() >= least_points:
        drawn = left.orderBy(F.xxhash64("pid", F.lit(seed + round_)), "pid").limit(2 * hypotheses).toPandas()[list(XYZ)].to_numpy()
        round_, idle, half = round_ + 1, idle + 1, len(drawn) // 2
        way = drawn[half : 2 * half] - drawn[:half]
        size = np.linalg.norm(way, axis=1)
        long = size >= least_length
        tried = np.column_stack([drawn[:half][long], way[long] / size[long, None]])
        if not len(tried):
            continue
        flat = left.withColumns({f"n{c}": F.lit(0.0) for c in XYZ})
        chosen = _taken(counted(flat, lambda p, _, t=tried: _line_distance(p, t) < tolerance, len(tried)), least_points, most, share)
        if not chosen:
            continue
        lines, facts = tried[chosen], {}
        for step in range(3):
            own = saved(on_lines(left, lines, tolerance), "on")
            facts = _fits(own)
            # the last time without what is no cable, whose crossings with cables are theirs again
            kept = [k for k, f in sorted(facts.items()) if step != 1 or f[0] >= least_points and f[3] > least_stretch and f[4] < most_thick]
            if step == 1 and kept:
                held = _ends(own, {k: facts[k] for k in kept})
                kept = [k for k in kept if held[k][3] >= WHOLE]
            lines = np.array([facts[k][1] for k in kept]).reshape(-1, 6)
            if not kept:
                break
        if not len(lines):
            continue
        ends = _ends(own, facts)
        for k in sorted(ends, key=lambda k: (-facts[k][0], k)):
            (first, last, q, whole), (n, line, _, stretch, thick) = ends[k], facts[k]
            length = q[1] - q[0]
            if not (n >= least_points and stretch > least_stretch and length > least_length and thick < most_thick and whole >= WHOLE):
                continue
            s, e = (np.array([x[c] for c in XYZ]) for x in (first, last))
            middle = (s + e) / 2
            again = [c for c in found if abs(line[3:] @ c[-1]) >= math.cos(math.radians(5)) and np.linalg.norm((middle - c[0]) - ((middle - c[0]) @ c[-1]) * c[-1]) < apart]
            if not again:
                found.append((s, e, n, length, thick, math.degrees(math.acos(min(1.0, abs(line[5])))), line[3:]))
                idle = 0
        left = saved(left.join(own.select("pid").hint("merge"), "pid", "left_anti"), "left")
    rows = [(k, int(n), *map(float, s), *map(float, e), float(length), thick, tilt) for k, (s, e, n, length, thick, tilt, _) in enumerate(found[:most])]
    return spark.createDataFrame(rows, _CABLE)


@dataclass(frozen=True)
class Deck:
    """``axis``: level and of unit length; stations run along it from the centre."""

    plane_id: int
    centre: tuple[float, float, float]
    axis: tuple[float, float, float]
    length: float
    width: float
    elevation: float


def deck(points: DataFrame, least_points: int = 300, least_level: float = 0.9, least_ratio: float = 2.0) -> Deck | None:
    """The deck among planes (points: plane_id, x, y, z): the highest of the level, long ones whose area is near the largest; None without any."""
    rows = []
    for r in moments(points.dropna(subset=["plane_id", *XYZ]), "plane_id").where(F.col("n") >= least_points).collect():  # a row per plane
        values, vectors = np.linalg.eigh(np.array([[r[f"c{min(a, b)}{max(a, b)}"] for b in XYZ] for a in XYZ]))
        long, wide = (4 * math.sqrt(max(v, 0.0)) for v in (values[2], values[1]))
        along = vectors[:, 2] * np.array([1.0, 1.0, 0.0])
        # an axis points towards +x, or +y
        along = -along if (along[0], along[1]) < (-1e-9, 0.0) or abs(along[0]) <= 1e-9 and along[1] < 0 else along
        if abs(vectors[2, 0]) >= least_level and wide > 0 and long >= least_ratio * wide and np.linalg.norm(along) > 1e-9:
            rows.append((r["plane_id"], *(r[f"m{c}"] for c in XYZ), *map(float, vectors[:, 2]), *map(float, vectors[:, 1]), long * wide, *map(float, along / np.linalg.norm(along))))
    if not rows:
        return None
    names = "plane_id long, " + ", ".join(f"{p}{c} double" for p in "oaw" for c in XYZ)
    frames = points.sparkSession.createDataFrame([r[:10] for r in rows], names)
    own = points.join(F.broadcast(frames), "plane_id")  # a row per plane
    t, w = (sum((F.col(c) - F.col(f"o{c}")) * F.col(f"{p}{c}") for c in XYZ) for p in "aw")
    found = percentiles(own.select("plane_id", t.alias("t"), w.alias("w"), "z"), "plane_id", {"t": [0.005, 0.995], "w": [0.005, 0.995], "z": [0.9]})
    best = max(r[10] for r in rows)
    made = [Deck(r[0], r[1:4], r[11:14], found[r[0]]["t"][1] - found[r[0]]["t"][0], found[r[0]]["w"][1] - found[r[0]]["w"][0], found[r[0]]["z"][0]) for r in rows if r[10] >= 0.7 * best]
    return max(made, key=lambda d: (d.elevation, -d.plane_id))


def substructure(points: DataFrame, found: Deck, spacing: float, least_points: int = 200) -> DataFrame:
    """(support, kind, station, x, y, z, height, footprint, bearing_x, bearing_y, bearing_z): what stands below the deck.

    Points (x, y, z) below the deck and within its reach are joined through cells of six
    spacings. A piece tall enough is an abutment at an end of the deck if it is wide, else a pier
    unless it is wider than the deck; the bearing is the mean of its topmost points.
    """
    at = sum((F.col(c) - found.centre[i]) * found.axis[i] for i, c in enumerate(XYZ))
    # numbered anew, so that repeated pids don't count twice
    own = points.select(*XYZ).dropna().select(F.monotonically_increasing_id().alias("pid"), *XYZ, at.alias("station"))
    own = saved(own.where((F.col("z") < found.elevation - max(0.02 * found.length, 8 * spacing)) & (F.abs("station") < 0.55 * found.length)), "below")
    owned = saved(own.join(grid_components(own.select("pid", *XYZ), 6 * spacing), "pid"), "pieces")
    facts = owned.groupBy(F.col("label").alias("support")).agg(
        F.count(F.lit(1)).alias("n"), (F.max("z") - F.min("z")).alias("height"), F.max("z").alias("top"), F.avg("station").alias("station"), *[F.avg(c).alias(c) for c in XYZ],
        F.sqrt((F.max("x") - F.min("x")) * (F.max("x") - F.min("x")) + (F.max("y") - F.min("y")) * (F.max("y") - F.min("y"))).alias("footprint"),
    )
    facts = facts.where((F.col("n") >= least_points) & ((F.col("height") >= 0.1 * found.length) | (F.col("height") >= 80 * spacing)))
    end = (F.abs("station") > 0.4 * found.length) & (F.col("footprint") > 0.5 * found.width)
    facts = saved(facts.withColumn("kind", F.when(end, "abutment").when(F.col("footprint") <= 1.2 * found.width, "pier")).where("kind is not null"), "supports")
    top = owned.join(F.broadcast(facts.select(F.col("support").alias("label"), "top")), "label").where(F.col("z") > F.col("top") - 4 * spacing)  # a row per support
    bearing = top.groupBy(F.col("label").alias("support")).agg(*[F.avg(c).alias(f"bearing_{c}") for c in XYZ])
    return facts.join(bearing, "support").select("support", "kind", "station", *XYZ, "height", "footprint", *[f"bearing_{c}" for c in XYZ])


def fields(supports: DataFrame, found: Deck) -> DataFrame:
    """(start, end, span): the deck from one end over its piers to the other; supports of one bridge."""
    ends = supports.sparkSession.createDataFrame([(-found.length / 2,), (found.length / 2,)], "station double")
    every = supports.where("kind = 'pier'").select("station").unionByName(ends)
    after = F.lead("station").over(W.orderBy("station"))  # a row per support
    return every.select(F.col("station").alias("start"), after.alias("end")).where("end is not null").withColumn("span", F.col("end") - F.col("start"))


def kind(n_arches: int, n_pylons: int, tilts: list[float], n_piers: int) -> str:
    """Type of a bridge from what was found; ``tilts``: inclinations of its cables from the vertical, in degrees."""
    if n_arches:
        return "arch"
    if tilts and n_pylons:
        return "cable-stayed" if sum(t > 25 for t in tilts) >= max(2, len(tilts) // 2) else "suspension"
    return "girder" if n_piers else "single span"
