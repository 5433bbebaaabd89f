"""Generated geometry and cameras: frames, tubes, boxes, extrusions, palettes, projections. Rows in, rows out, no pass of its own."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloudloom.functions.linalg import Vec, cross, norm, vec


def frame(axis: Vec) -> tuple[Vec, Vec]:
    """Two unit vectors square to ``axis`` and each other; helper X, or Y where the axis is near X."""
    steep = F.abs(axis[0]) >= 0.9
    helper = (F.when(steep, 0.0).otherwise(1.0), F.when(steep, 1.0).otherwise(0.0), F.lit(0.0))
    u = cross(axis, helper)
    size = norm(u)
    u = tuple(x / size for x in u)
    return u, cross(axis, u)


def tubes(items: DataFrame, segments: int = 48) -> tuple[DataFrame, DataFrame]:
    """Capped tubes of items (item, px, py, pz, ax, ay, az, radius, length): (faces, vertices).

    Vertex ids count 2 * segments + 2 an item: both rings, then both cap centres.
    """
    each = 2 * segments + 2
    u, v = frame(vec("a"))
    own = items.withColumns({f"u{k}": x for k, x in zip("xyz", u, strict=True)} | {f"v{k}": x for k, x in zip("xyz", v, strict=True)})
    ring = own.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(each - 1))))
    end = F.when(F.col("k") < 2 * segments, F.floor(F.col("k") / segments)).otherwise(F.col("k") - 2 * segments)
    turn = (F.col("k") % segments) * (2 * math.pi / segments)
    reach = F.when(F.col("k") < 2 * segments, F.col("radius")).otherwise(F.lit(0.0))
    along = (end - 0.5) * F.col("length")
    place = {c: F.col(f"p{c}") + F.col(f"a{c}") * along + (F.col(f"u{c}") * F.cos(turn) + F.col(f"v{c}") * F.sin(turn)) * reach for c in "xyz"}
    vertices = ring.select((F.col("item") * each + F.col("k")).alias("vid"), *[e.alias(c) for c, e in place.items()])
    side = items.select("item").withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(segments - 1)))).withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(3))))
    s, nxt, base = F.col("s"), (F.col("s") + 1) % segments, F.col("item") * each
    corner = [
        F.when(F.col("t") == 0, s).when(F.col("t") == 1, s).when(F.col("t") == 2, F.lit(2 * segments)).otherwise(F.lit(2 * segments + 1)),
        F.when(F.col("t") == 0, nxt).when(F.col("t") == 1, nxt + segments).when(F.col("t") == 2, nxt).otherwise(s + segments),
        F.when(F.col("t") == 0, nxt + segments).when(F.col("t") == 1, s + segments).when(F.col("t") == 2, s).otherwise(nxt + segments),
    ]
    faces = side.select(((F.col("item") * segments + s) * 4 + F.col("t")).alias("fid"), *[(base + c).alias(n) for n, c in zip("abc", corner, strict=True)], F.col("item").alias("group_id"))
    return faces, vertices


#: Corners of a box as bits x, y, z, and its twelve faces seen from outside.
BOX_FACES = ((0, 2, 3), (0, 3, 1), (4, 5, 7), (4, 7, 6), (0, 1, 5), (0, 5, 4), (2, 6, 7), (2, 7, 3), (0, 4, 6), (0, 6, 2), (1, 3, 7), (1, 7, 5))


def boxes(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Closed boxes of items (item, x0, y0, z0, x1, y1, z1): (faces, vertices)."""
    k = F.col("k")
    corner = items.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(7))))
    place = [F.when(F.floor(k / 2**i) % 2 == 1, F.col(f"{c}1")).otherwise(F.col(f"{c}0")).alias(c) for i, c in enumerate("xyz")]
    vertices = corner.select((F.col("item") * 8 + k).alias("vid"), *place)
    table = F.array(*[F.struct(F.lit(i).alias("f"), *[F.lit(x).alias(n) for n, x in zip("abc", t, strict=True)]) for i, t in enumerate(BOX_FACES)])
    faces = items.select("item", F.explode(table).alias("t"))
    return faces.select((F.col("item") * 12 + F.col("t.f")).alias("fid"), *[(F.col("item") * 8 + F.col(f"t.{n}")).alias(n) for n in "abc"], F.col("item").alias("group_id")), vertices


def extrusions(triangles: DataFrame, loops: DataFrame) -> DataFrame:
    """Triangles (poly, ax .. cz) of prisms of height ``h`` over polygons: caps from their triangles, walls from their sides.

    ``triangles``: (poly, a_u .. c_v, h); ``loops``: (poly, u, v, u1, v1, h), a row per side, inside to the left.
    """
    flat = lambda names, z: [x for p in names for x in (F.col(f"{p}_u"), F.col(f"{p}_v"), z)]
    at = [f"{k}{c}" for k in "abc" for c in "xyz"]
    zero = F.lit(0.0)
    low = triangles.select("poly", *[x.alias(n) for n, x in zip(at, flat(("a", "c", "b"), zero), strict=True)])
    high = triangles.select("poly", *[x.alias(n) for n, x in zip(at, flat("abc", F.col("h")), strict=True)])
    u, v, u1, v1, h = (F.col(c) for c in ("u", "v", "u1", "v1", "h"))
    one = loops.select("poly", *[x.alias(n) for n, x in zip(at, (u, v, zero, u1, v1, zero, u1, v1, h), strict=True)])
    two = loops.select("poly", *[x.alias(n) for n, x in zip(at, (u, v, zero, u1, v1, h, u, v, h), strict=True)])
    return low.unionByName(high).unionByName(one).unionByName(two)


def palette(rows: DataFrame, number: str) -> DataFrame:
    """``rows`` with r, g, b: colours a golden angle of hue apart by ``number`` (not negative), saturation 0.45, value 0.85; null for null."""
    rows = rows.withColumn("__h", F.col(number) * 0.61803398875 % 1.0 * 6)
    low, span = 0.85 * (1 - 0.45), 0.85 * 0.45

    def channel(shift: int) -> Column:
        k = (F.col("__h") + shift) % 6
        return F.round((low + span * F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.abs(k - 3) - 1))) * 255).cast("int")

    return rows.withColumns({"r": channel(0), "g": channel(4), "b": channel(2)}).drop("__h")


def camera_frame(points: DataFrame, cameras: DataFrame) -> DataFrame:
    """Points (pid, x, y, z) in the frame of every camera (cam_id, r0 .. r8 row-major, t0 .. t2): cx, cy, cz.

    Cameras are those of one capture; the points are not multiplied by anything else.
    """
    both = points.select("pid", "x", "y", "z").crossJoin(F.broadcast(cameras))
    at = [sum(F.col(f"r{3 * i + j}") * F.col(c) for j, c in enumerate("xyz")) + F.col(f"t{i}") for i in range(3)]
    return both.withColumns({f"c{c}": x for c, x in zip("xyz", at, strict=True)})


def pinhole(rows: DataFrame) -> DataFrame:
    """px, py of rows (cx, cy, cz, fx, fy, ox, oy, k1) in front of their camera, with one radial term."""
    a, b = F.col("cx") / F.col("cz"), F.col("cy") / F.col("cz")
    warp = (a * a + b * b) * F.col("k1") + 1
    return rows.where("cz > 0").withColumns({"px": F.col("fx") * a * warp + F.col("ox"), "py": F.col("fy") * b * warp + F.col("oy")})


def fisheye(rows: DataFrame, poly: list[float]) -> DataFrame:
    """px, py under the model radius = theta + poly[0] * theta^2 + ..., with skew a12."""
    side = F.sqrt(F.col("cx") * F.col("cx") + F.col("cy") * F.col("cy"))
    theta = F.atan2(side, F.col("cz"))
    r, power = theta, theta
    for k in poly:
        power = power * theta
        r = r + power * k
    scale = F.when(side > 1e-12, r / side).otherwise(F.lit(1.0))
    u, v = F.col("cx") * scale, F.col("cy") * scale
    return rows.withColumns({"px": F.col("fx") * u + F.col("a12") * v + F.col("ox"), "py": F.col("fy") * v + F.col("oy")})


def unprojected(rows: DataFrame, steps: int = 3) -> DataFrame:
    """Unit viewing direction (dx, dy, dz) of pixels (px, py) of a pinhole with one radial term, by fixed-point steps."""
    a0, b0 = (F.col("px") - F.col("ox")) / F.col("fx"), (F.col("py") - F.col("oy")) / F.col("fy")
    rows = rows.withColumns({"__a": a0, "__b": b0, "__a0": a0, "__b0": b0})
    for _ in range(steps):
        warp = (F.col("__a") * F.col("__a") + F.col("__b") * F.col("__b")) * F.col("k1") + 1
        rows = rows.withColumns({"__a": F.col("__a0") / warp, "__b": F.col("__b0") / warp})
    size = F.sqrt(F.col("__a") * F.col("__a") + F.col("__b") * F.col("__b") + 1)
    return rows.withColumns({"dx": F.col("__a") / size, "dy": F.col("__b") / size, "dz": 1 / size}).drop("__a", "__b", "__a0", "__b0")
