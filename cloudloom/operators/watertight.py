"""A closed surface from planes and the points on them: arrangement of planes, evidence, minimum cut.

The planes and the sides of a box around the scene cut it into convex cells. Any place is
named by its sides: a string with a character for each plane, 0 below it and 1 above. A cell
is the places of one name; a facet is named by its plane and the sides to all others. Corners
(where three planes meet) belong to the cells and facets whose names agree with theirs but
for these planes, so cells, facets and their polygons come from grouping the corners.

Points give evidence by the same names: the texels they cover say how much of a facet is
measured. Lines square to a facet meet other facets, and the chance that they cross a
measured surface an odd number of times says on which side the inside is. A minimum cut of
the cells weighs that evidence against the area that the surface would have to invent. What
the cut separates is closed, however much of a wall or ceiling was hidden.

Edge cases: rows with a null coordinate or plane are left out; fewer than four planes, or
more than ``most``, raise an error; no measured closed room gives no facets. Where four
planes meet in one place, all are shifted by millionths of the scene's size, each its own.
Only the planes, at most ``most`` rows, come to the driver.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloudloom.functions.linalg import dot, vec
from cloudloom.operators.flow import min_cut
from cloudloom.operators.planes import basis, corner_points
from cloudloom.operators.points import XYZ, extent
from cloudloom.plans.scratch import saved

Plane = tuple[int, float, float, float, float]
#: Capacity of what must not be cut, in the cut's unit.
FIXED = 1 << 50
#: Parts of a square unit that the cut counts in.
UNIT = 1_000_000


def _value(plane: Plane, at: tuple[Column, Column, Column]) -> Column:
    return dot(at, tuple(F.lit(x) for x in plane[1:4])) + plane[4]


def _sides(planes: list[Plane], at: tuple[Column, Column, Column], on: Column | None = None) -> Column:
    """The name of a place; planes whose id is in the array ``on`` are left open (*)."""
    each = []
    for p in planes:
        side = F.when(_value(p, at) > 0, "1").otherwise("0")
        each.append(side if on is None else F.when(F.array_contains(on, F.lit(p[0])), "*").otherwise(side))
    return F.concat(*each)


@dataclass(frozen=True)
class Arrangement:
    """``planes`` in the order of the names' characters, the six sides of the box last (ids -1 to -6).

    ``cells``: name, rim (whether it lies at the box). ``facets``: plane_id, name, polygon
    (vid, x, y, z counter-clockwise seen from above the plane), area.
    """

    planes: list[Plane]
    cells: DataFrame
    facets: DataFrame

    def on_plane(self, at: tuple[Column, Column, Column], plane_id: Column) -> Column:
        """Name of the facet of ``plane_id`` at a place on it."""
        return _sides(self.planes, at, F.array(plane_id))


def _table(df: DataFrame, planes: list[Plane]) -> DataFrame:
    return df.sparkSession.createDataFrame([tuple(p) for p in planes], "plane_id long, nx double, ny double, nz double, d double")


def _corners(points: DataFrame, planes: list[Plane], own: int) -> DataFrame:
    """Corners in the box: x, y, z, the three planes as ``on``, a number ``vid``, the name; ``crowd``: whether a fourth plane is there."""
    rows = _table(points, planes)
    two = rows.select(F.col("plane_id").alias("i")).crossJoin(F.broadcast(rows.select(F.col("plane_id").alias("j")))).where("i < j")  # planes of a model
    met = corner_points(rows, two, 1e-9).withColumn("on", F.array("i", "j", "k"))
    at, n = vec(""), len(planes)
    size = max(abs(p[4]) for p in planes[own:])
    inside = F.lit(True)
    for p in planes[own:]:
        inside = inside & (F.array_contains("on", F.lit(p[0])) | (_value(p, at) < 1e-9 * size))
    places = {c: _place(planes, F.col(c)) - 1 for c in "ijk"}
    near = [(~F.array_contains("on", F.lit(p[0])) & (F.abs(_value(p, at)) < 1e-8 * size)).cast("int") for p in planes]
    vid = (places["i"] * n + places["j"]) * n + places["k"]
    return met.where(inside).select(*XYZ, "on", vid.cast("long").alias("vid"), _sides(planes, at, F.col("on")).alias("name"), (sum(near) > 0).alias("crowd"))


def _opened(corners: DataFrame, own: int, keep: Column | None = None) -> DataFrame:
    """A row for each way to close the open places of the names, but for place ``keep``; the box has an inner side only."""
    out = corners if keep is None else corners.withColumn("__k", keep).withColumn("name", F.expr("overlay(name placing '#' from __k for 1)")).drop("__k")
    low, high = (F.expr(f"overlay(name placing '{s}' from instr(name, '*') for 1)") for s in "01")
    for _ in range(3):
        place = F.instr("name", "*")
        out = out.withColumn("name", F.explode(F.when(place == 0, F.array("name")).when(place <= own, F.array(low, high)).otherwise(F.array(low))))
    return out.withColumn("name", F.translate("name", "#", "*"))


def _place(planes: list[Plane], plane_id: Column) -> Column:
    """Where in the names a plane's side stands, from 1."""
    return F.element_at(F.create_map(*[F.lit(x) for k, p in enumerate(planes) for x in (p[0], k + 1)]), plane_id)


def arrange(points: DataFrame, planes: DataFrame, most: int = 30, margin: float = 0.05) -> Arrangement:
    """Cells and facets of the planes (plane_id, nx, ny, nz, d) in the box around ``points``, widened by ``margin`` of its diagonal."""
    rows: list[Plane] = [tuple(r) for r in planes.select("plane_id", "nx", "ny", "nz", "d").dropna().orderBy("plane_id").limit(most + 1).collect()]
    if not 4 <= len(rows) <= most:
        raise ValueError(f"a closed surface needs 4 to {most} planes")
    box = extent(points.select(*XYZ).dropna()).first()
    diagonal = math.sqrt(sum((box[f"{c}_max"] - box[f"{c}_min"]) ** 2 for c in XYZ))
    rim: list[Plane] = []
    for k, c in enumerate(XYZ):
        unit = [float(i == k) for i in range(3)]
        rim.append((-1 - 2 * k, *unit, -box[f"{c}_max"] - margin * diagonal))
        rim.append((-2 - 2 * k, *[-x for x in unit], box[f"{c}_min"] - margin * diagonal))
    own = len(rows)
    corners = saved(_corners(points, rows + rim, own), "corners")
    if corners.where("crowd").count():
        rows = [(*p[:4], p[4] + 1e-6 * diagonal * ((k * 0.6180339887498949) % 1 + 0.1)) for k, p in enumerate(rows)]
        corners = saved(_corners(points, rows + rim, own), "corners")
    every = rows + rim
    at_rim = F.exists("on", lambda x: x < 0)
    cells = _opened(corners, own).groupBy("name").agg(F.max(at_rim).alias("rim"))
    sided = corners.withColumn("plane_id", F.explode("on")).where("plane_id >= 0")
    sided = _opened(sided, own, _place(every, F.col("plane_id")))
    polygons = sided.groupBy("plane_id", "name").agg(F.collect_list(F.struct("vid", *XYZ)).alias("ring"), *[F.avg(c).alias(f"m{c}") for c in XYZ])
    frames = basis(_table(points, rows)).select("plane_id", *[f"{a}{k}" for a in "nuv" for k in "xyz"])
    polygons = polygons.where(F.size("ring") >= 3).join(F.broadcast(frames), "plane_id")  # planes of a model

    def turned(p: Column) -> Column:
        away = tuple(p[c] - F.col(f"m{c}") for c in XYZ)
        return F.struct(F.atan2(dot(away, vec("v")), dot(away, vec("u"))).alias("angle"), p["vid"].alias("vid"), *[p[c].alias(c) for c in XYZ])

    polygons = polygons.withColumn("ring", F.array_sort(F.transform("ring", turned)))
    n = F.size("ring")
    later = F.concat(F.slice("ring", F.lit(2), n - 1), F.slice("ring", 1, 1))

    def twice(a: Column, b: Column) -> Column:
        p, q = (tuple(x[c] - F.col(f"m{c}") for c in XYZ) for x in (a, b))
        return dot(p, vec("u")) * dot(q, vec("v")) - dot(p, vec("v")) * dot(q, vec("u"))

    area = F.aggregate(F.zip_with("ring", later, twice), F.lit(0.0), lambda s, x: s + x) / 2
    polygon = F.transform("ring", lambda p: F.struct(p["vid"].alias("vid"), *[p[c].alias(c) for c in XYZ]))
    facets = polygons.select("plane_id", "name", polygon.alias("polygon"), area.alias("area"))
    return Arrangement(every, saved(cells, "cells"), saved(facets, "facets"))


def evidence(points: DataFrame, room: Arrangement, texel: float) -> DataFrame:
    """(plane_id, name, covered, share, below) of measured facets.

    ``covered``: area of the texels that hold points (plane_id, x, y, z) of their plane;
    ``share``: of the facet's area; ``below``: from -1 to 1, how surely the inside lies below the plane.
    """
    own = [p for p in room.planes if p[0] >= 0]
    frames = basis(_table(points, own)).select("plane_id", "d", *[f"{a}{k}" for a in "nuv" for k in "xyz"])
    placed = points.select("plane_id", *XYZ).dropna().join(F.broadcast(frames), "plane_id")  # planes of a model
    u, v = dot(vec(""), vec("u")), dot(vec(""), vec("v"))
    texels = placed.select("plane_id", F.floor(u / texel).alias("s"), F.floor(v / texel).alias("t")).distinct().join(F.broadcast(frames), "plane_id")
    s, t = (F.col("s") + 0.5) * texel, (F.col("t") + 0.5) * texel
    texels = texels.withColumns({c: F.col(f"u{c}") * s + F.col(f"v{c}") * t - F.col(f"n{c}") * F.col("d") for c in XYZ})
    texels = saved(texels.withColumn("name", room.on_plane(vec(""), F.col("plane_id"))).select("plane_id", "name", "s", "t", *XYZ, "nx", "ny", "nz"), "texels")
    held = texels.groupBy("plane_id", "name").agg((F.count(F.lit(1)) * texel * texel).alias("covered"))
    facets = saved(room.facets.join(held, ["plane_id", "name"]).withColumn("covered", F.least("covered", "area")), "held")
    facets = facets.select("plane_id", "name", "covered", (F.col("covered") / F.col("area")).alias("share"))
    # one texel of each block of eight by eight sends a line both ways
    block = [F.floor(F.col(c) / 8).alias(f"b{c}") for c in "st"]
    rays = texels.groupBy("plane_id", "name", *block).agg(F.min(F.struct("s", "t", *XYZ, "nx", "ny", "nz")).alias("p"))
    rays = saved(rays.select("plane_id", "name", F.monotonically_increasing_id().alias("ray"), "p.*"), "rays")
    met = []
    for q in own:
        slope = dot(vec("n"), tuple(F.lit(x) for x in q[1:4]))
        met.append(F.struct(F.lit(q[0]).cast("long").alias("other"), F.when((F.abs(slope) > 1e-6) & (F.col("plane_id") != q[0]), -_value(q, vec("")) / slope).alias("way")))
    hits = rays.select("ray", "plane_id", "name", *XYZ, "nx", "ny", "nz", F.inline(F.array(*met))).where("way is not null")
    hits = hits.withColumns({c: F.col(c) + F.col("way") * F.col(f"n{c}") for c in XYZ})
    hits = hits.select("ray", (F.col("way") > 0).alias("up"), F.col("other").alias("plane_id"), room.on_plane(vec(""), F.col("other")).alias("name"))
    odds = hits.join(facets, ["plane_id", "name"]).groupBy("ray").agg(
        *[F.coalesce(F.product(F.when(F.col("up") == up, 1 - 2 * F.col("share"))), F.lit(1.0)).alias(c) for up, c in ((True, "over"), (False, "under"))]
    )
    # a chance to be inside of (1 - product) / 2 on either side
    told = rays.join(odds, "ray", "left").groupBy("plane_id", "name").agg(((F.avg(F.coalesce("over", F.lit(1.0))) - F.avg(F.coalesce("under", F.lit(1.0)))) / 2).alias("below"))
    return saved(facets.join(told, ["plane_id", "name"]), "evidence")


def close(points: DataFrame, planes: DataFrame, texel: float, invented: float = 0.27, measured: float = 0.43, plain: float = 0.02, most: int = 30) -> tuple[DataFrame, DataFrame]:
    """Facets (plane_id, name, polygon turned outwards, area, covered) of the closed surface, and the cells (name, inside).

    ``points``: plane_id, x, y, z. The weights are of a unit of area: invented by the surface,
    measured on the wrong side of it or not on it, and of any surface.
    """
    room = arrange(points, planes, most)
    seen = evidence(points, room, texel)
    facets = room.facets.join(seen, ["plane_id", "name"], "left").withColumns({"covered": F.coalesce("covered", F.lit(0.0)), "at": _place(room.planes, F.col("plane_id"))})
    below, above = (F.expr(f"overlay(name placing '{s}' from at for 1)") for s in "01")
    facets = saved(facets.withColumns({"lower": below, "upper": above}), "sided")
    cost = (F.col("area") - F.col("covered")) * invented + F.col("area") * plain
    edges = facets.select(F.col("lower").alias("a"), F.col("upper").alias("b"), F.greatest(F.lit(0.0), F.round(cost * UNIT)).cast("long").alias("capacity"))
    vote = F.round(F.col("below") * F.col("covered") * measured * UNIT).cast("long")
    votes = facets.where("below is not null").select(F.explode(F.array(F.struct(F.col("lower").alias("node"), vote.alias("gain")), F.struct(F.col("upper").alias("node"), (-vote).alias("gain")))).alias("x")).select("x.*")
    rim = room.cells.select(F.col("name").alias("node"), F.when(F.col("rim"), F.lit(-FIXED)).otherwise(F.lit(0)).alias("gain"))
    cells = saved(min_cut(rim.unionByName(votes), edges).select(F.col("node").alias("name"), "inside"), "cut")
    for side in ("lower", "upper"):
        facets = facets.join(cells.select(F.col("name").alias(side), F.col("inside").alias(f"{side}_in")), side)
    outer = facets.where("lower_in <> upper_in")
    turned = F.when(F.col("lower_in"), F.col("polygon")).otherwise(F.reverse("polygon"))
    return outer.select("plane_id", "name", turned.alias("polygon"), "area", "covered"), cells


def as_mesh(facets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(faces, vertices): each facet's polygon as a fan of triangles; corners are shared, so the mesh is closed."""
    rings = facets.select("plane_id", "name", "polygon")
    vertices = rings.select(F.explode("polygon").alias("p")).select("p.*").groupBy("vid").agg(*[F.first(c).alias(c) for c in XYZ])
    each = rings.select("plane_id", "name", "polygon", F.explode(F.sequence(F.lit(2), F.size("polygon") - 1)).alias("k"))
    corner = {c: F.element_at("polygon", at)["vid"] for c, at in (("a", F.lit(1)), ("b", F.col("k")), ("c", F.col("k") + 1))}
    faces = each.select(F.xxhash64("plane_id", "name", "k").alias("fid"), *[v.alias(c) for c, v in corner.items()], F.col("plane_id").alias("group_id"))
    return faces, vertices
