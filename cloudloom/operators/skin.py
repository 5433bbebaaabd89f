"""A closed skin around unstructured points: voxels of fitting size, their outer faces, smoothed and drawn to the scan.

The cloud is counted in the finest cells once; cells twice as large are sums of those, so the
size at which most occupied cells hold several points, and the faces fit the budget, is
found without another pass. Cells of one point are noise, and so are pieces (cells joined by
faces) of few points. Where a kept cell has an empty neighbour, their common side becomes two
triangles wound outwards; corners are named by the grid, so they weld by themselves. Two cells
that touch along an edge only would give that edge four faces: with ``joined`` one of the
empty cells beside it is filled, until none is left, and every edge bounds exactly two.

Edge cases: rows with a null coordinate are left out; clouds without a piece of
``least_points`` give no faces; equal points count each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloudloom.operators.graph import components
from cloudloom.operators.points import XYZ, knn
from cloudloom.operators.repair import taubin
from cloudloom.plans.scratch import saved

CELL = ["cx", "cy", "cz"]
#: Corners of a cell's side towards each neighbour, counter-clockwise seen from there.
SIDES = {
    (1, 0, 0): [(1, 0, 0), (1, 1, 0), (1, 1, 1), (1, 0, 1)],
    (-1, 0, 0): [(0, 0, 0), (0, 0, 1), (0, 1, 1), (0, 1, 0)],
    (0, 1, 0): [(0, 1, 0), (0, 1, 1), (1, 1, 1), (1, 1, 0)],
    (0, -1, 0): [(0, 0, 0), (1, 0, 0), (1, 0, 1), (0, 0, 1)],
    (0, 0, 1): [(0, 0, 1), (1, 0, 1), (1, 1, 1), (0, 1, 1)],
    (0, 0, -1): [(0, 0, 0), (0, 1, 0), (1, 1, 0), (1, 0, 0)],
}
#: A cell's number: its place along x, y, z in 21 bits each, from the middle of their range.
HALF = 1 << 20


def _number(cx, cy, cz):
    return F.shiftleft(cx + HALF, 42).bitwiseOR(F.shiftleft(cy + HALF, 21)).bitwiseOR(cz + HALF)


def _moves(steps) -> F.Column:
    return F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in zip("ijk", s, strict=True)]) for s in steps])


def open_sides(cells: DataFrame) -> DataFrame:
    """(cx, cy, cz, o: the step i, j, k) of each side of a cell without a cell beyond."""
    to = cells.select(*CELL, F.explode(_moves(SIDES)).alias("o"))
    beyond = [(F.col(c) + F.col(f"o.{s}")).alias(f"t{c}") for c, s in zip(CELL, "ijk", strict=True)]
    there = cells.select(*[F.col(c).alias(f"t{c}") for c in CELL])
    return to.select("*", *beyond).join(there, [f"t{c}" for c in CELL], "left_anti").select(*CELL, "o")


def pyramid(points: DataFrame, voxel: float, most_faces: int, solid_share: float = 0.6, least: int = 2, steps: int = 12) -> tuple[DataFrame, float]:
    """Cells (cx, cy, cz, n) of ``least`` points or more, and their size: the first of ``voxel``, 2 x, 4 x, ... at which enough cells are solid and the faces fit."""
    places = [F.floor(F.col(c) / voxel).cast("long").alias(k) for c, k in zip(XYZ, CELL, strict=True)]
    cells = saved(points.dropna(subset=list(XYZ)).groupBy(*places).agg(F.count(F.lit(1)).alias("n")), "cells")
    for step in range(steps):
        solid = cells.where(F.col("n") >= least)
        n, full = cells.agg(F.count(F.lit(1)), F.count_if(F.col("n") >= least)).first()
        if step == steps - 1 or full >= solid_share * n and 2 * open_sides(solid).count() <= most_faces:
            return (solid if full else cells), voxel
        voxel *= 2
        halves = [F.shiftright(c, 1).alias(c) for c in CELL]
        cells = saved(cells.groupBy(*halves).agg(F.sum("n").alias("n")), "cells")
    raise AssertionError


def pieces(cells: DataFrame, least_points: int) -> DataFrame:
    """The cells of pieces, joined by sides, that hold enough points, with the piece's number."""
    own = saved(cells.withColumn("node", _number(*[F.col(c) for c in CELL])), "own")
    ahead = own.select(F.col("node").alias("a"), F.explode(F.array(F.lit(1 << 42), F.lit(1 << 21), F.lit(1))).alias("s"))
    edges = ahead.select("a", (F.col("a") + F.col("s")).alias("b")).join(own.select(F.col("node").alias("b")), "b")
    rooted = saved(own.join(components(own, edges), "node"), "rooted")
    good = rooted.groupBy("root").agg(F.sum("n").alias("points")).where(F.col("points") >= least_points)
    return rooted.join(good.select("root"), "root", "left_semi").select(*CELL, "n", F.col("root").alias("piece"))


def joined_edges(cells: DataFrame, most_rounds: int = 64) -> DataFrame:
    """The cells (cx, cy, cz) and those filled where two touch along an edge only."""
    cells = saved(cells.select(*CELL), "solid")
    # the two cells beside an edge, and the two across it, for the three directions of edges and both diagonals
    diagonals = [s for s in [(0, 1, 1), (0, 1, -1), (1, 0, 1), (1, 0, -1), (1, 1, 0), (1, -1, 0)]]
    for _ in range(most_rounds):
        to = cells.select(*CELL, F.explode(_moves(diagonals)).alias("o"))
        far = [(F.col(c) + F.col(f"o.{s}")).alias(f"t{c}") for c, s in zip(CELL, "ijk", strict=True)]
        there = cells.select(*[F.col(c).alias(f"t{c}") for c in CELL])
        both = to.select("*", *far).join(there, [f"t{c}" for c in CELL])
        # beside: one takes the first step that is not zero, the other the second
        first = F.when(F.col("o.i") != 0, F.struct(F.col("tcx").alias("cx"), F.col("cy"), F.col("cz"))).otherwise(F.struct("cx", F.col("tcy").alias("cy"), F.col("cz")))
        second = F.when(F.col("o.k") != 0, F.struct("cx", "cy", F.col("tcz").alias("cz"))).otherwise(F.struct("cx", F.col("tcy").alias("cy"), F.col("cz")))
        beside = both.select(F.monotonically_increasing_id().alias("pair"), first.alias("p"), second.alias("q"))
        beside = saved(beside, "beside")
        each = beside.select("pair", F.explode(F.array("p", "q")).alias("x")).select("pair", "x.*")
        met = each.join(cells, CELL, "left_semi").select("pair").distinct()
        new = beside.join(met, "pair", "left_anti").select(F.least("p", "q").alias("x")).select("x.*").distinct()
        new = saved(new, "filled")
        if new.isEmpty():
            return cells
        cells = saved(cells.unionByName(new), "solid")
    return cells


def shell(cells: DataFrame, voxel: float) -> tuple[DataFrame, DataFrame]:
    """(faces, vertices) of the outer sides of cells, wound outwards; a corner's number is that of the grid."""
    corners = F.create_map(*[x for s, ring in SIDES.items() for x in (F.concat_ws(",", *[F.lit(str(v)) for v in s]), _moves(ring))])
    sides = open_sides(cells)
    ring = F.element_at(corners, F.concat_ws(",", *[F.col(f"o.{s}").cast("string") for s in "ijk"]))
    quads = sides.select(F.transform(ring, lambda p: _number(F.col("cx") + p["i"], F.col("cy") + p["j"], F.col("cz") + p["k"])).alias("q"), *CELL, "o")
    halves = F.array(*[F.struct(F.lit(h).alias("h"), *[F.col("q")[x].alias(c) for c, x in zip("abc", t, strict=True)]) for h, t in ((0, (0, 1, 2)), (1, (0, 2, 3)))])
    faces = quads.select(F.xxhash64(*CELL, "o").alias("side"), F.inline(halves))
    faces = faces.select(F.xxhash64("side", "h").alias("fid"), "a", "b", "c")
    vid = faces.select(F.explode(F.array("a", "b", "c")).alias("vid")).distinct()
    mask = (1 << 21) - 1
    at = {c: (F.shiftright("vid", s).bitwiseAND(F.lit(mask)) - HALF) * voxel for c, s in zip(XYZ, (42, 21, 0), strict=True)}
    return faces, vid.withColumns(at)


def free_form(
    points: DataFrame, spacing: float, voxel: float | None = None, least_points: int = 300, most_faces: int = 800_000, joined: bool = True,
    smooth: int = 3, pull: float = 0.8, reach: float = 0.75,
) -> tuple[DataFrame, DataFrame, dict]:
    """(faces, vertices, facts) of the skin around points (pid, x, y, z and, where there, r, g, b).

    Vertices are smoothed without shrinking, drawn by ``pull`` of the way, at most ``reach``
    voxels, to the nearest measured point, whose colours they take, and smoothed once more.
    """
    solid, size = pyramid(points, voxel or 2.5 * spacing, most_faces)
    kept = saved(pieces(solid, least_points), "kept")
    facts = kept.agg(F.sum("n").alias("points"), F.countDistinct("piece").alias("pieces")).first().asDict()
    faces, vertices = shell(joined_edges(kept) if joined else saved(kept.select(*CELL), "solid"), size)
    faces, vertices = saved(faces, "faces"), saved(vertices, "vertices")
    if smooth:
        vertices = taubin(faces, vertices, smooth)
        near = knn(vertices.withColumnRenamed("vid", "pid"), points.dropna(subset=[*XYZ, "pid"]), 1, size).select(F.col("pid").alias("vid"), "nid")
        colours = [c for c in ("r", "g", "b") if c in points.columns]
        there = points.select(F.col("pid").alias("nid"), *[F.col(c).alias(f"n{c}") for c in XYZ], *colours)
        both = vertices.join(near, "vid", "left").join(there, "nid", "left").drop("nid")
        way = F.sqrt(sum((F.col(f"n{c}") - F.col(c)) * (F.col(f"n{c}") - F.col(c)) for c in XYZ))
        both = both.withColumn("__s", F.least(F.lit(1.0), reach * size / F.greatest(way, F.lit(1e-12))) * pull)
        both = both.withColumns({c: F.coalesce(F.col(c) + (F.col(f"n{c}") - F.col(c)) * F.col("__s"), F.col(c)) for c in XYZ})
        vertices = taubin(faces, saved(both.drop("__s", *[f"n{c}" for c in XYZ]), "drawn"), 1)
    return faces, vertices, facts | {"voxel": size}
