"""Triangle meshes as two relations: vertices(vid, x, y, z) and faces(fid, a, b, c, group_id)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cloudloom.functions.linalg import cross, dot, minus, norm, vec
from cloudloom.operators.points import _offsets, with_cell
from cloudloom.plans.scratch import saved

#: So many points at most are compared with every face.
FEW = 16


def corners(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """Faces with the positions of their corners: ax .. cz."""
    out = faces
    for k in "abc":
        v = vertices.select(F.col("vid").alias(k), *[F.col(n).alias(f"{k}{n}") for n in "xyz"])
        # merged: a table of vertices compresses well, and would be sent whole through the driver by its file's size
        out = out.join(v.hint("merge"), k)
    return out


def _normal() -> tuple[Column, Column, Column]:
    return cross(minus(vec("b"), vec("a")), minus(vec("c"), vec("a")))


def with_face_normals(tri: DataFrame) -> DataFrame:
    """Adds the cross product (wx, wy, wz), unit normal (zero if degenerate) and area."""
    tri = tri.withColumns(dict(zip(("wx", "wy", "wz"), _normal(), strict=True)))
    tri = tri.withColumn("area", norm(vec("w")) / 2)
    unit = {f"n{n}": F.when(F.col("area") > 0, F.col(f"w{n}") / (F.col("area") * 2)).otherwise(F.lit(0.0)) for n in "xyz"}
    return tri.withColumns(unit)


def area(tri: DataFrame, *by: str) -> DataFrame:
    return with_face_normals(tri).groupBy(*by).agg(F.count(F.lit(1)).alias("n_faces"), F.sum("area").alias("area"))


def signed_volume(tri: DataFrame) -> DataFrame:
    v = dot(vec("a"), cross(vec("b"), vec("c"))) / 6
    return tri.agg(F.sum(v).alias("volume"))


def vertex_normals(tri: DataFrame) -> DataFrame:
    """vid and the unit sum of the area-weighted normals of its faces."""
    each = with_face_normals(tri).select(F.explode(F.array("a", "b", "c")).alias("vid"), "wx", "wy", "wz")
    sums = each.groupBy("vid").agg(*[F.sum(f"w{n}").alias(f"s{n}") for n in "xyz"])
    size = norm(vec("s"))
    return sums.select("vid", *[F.when(size > 0, F.col(f"s{n}") / size).otherwise(F.lit(0.0)).alias(f"n{n}") for n in "xyz"])


def edges(faces: DataFrame, *keep: str) -> DataFrame:
    """An undirected edge (u < v) for each side of each face, with columns to keep."""
    sides = F.array(*[F.struct(F.least(p, q).alias("u"), F.greatest(p, q).alias("v")) for p, q in (("a", "b"), ("b", "c"), ("c", "a"))])
    return faces.select(F.explode(sides).alias("e"), *keep).select("e.u", "e.v", *keep)


def edge_stats(faces: DataFrame) -> DataFrame:
    """One row: edges in all, on one face, on two, on more."""
    n = edges(faces).groupBy("u", "v").agg(F.count(F.lit(1)).alias("n"))
    return n.agg(
        F.count(F.lit(1)).alias("edges"), F.count_if(F.col("n") == 1).alias("boundary"),
        F.count_if(F.col("n") == 2).alias("manifold"), F.count_if(F.col("n") > 2).alias("non_manifold"),
    )


def crease_edges(tri: DataFrame, degrees: float = 25.0) -> DataFrame:
    """Edges that are not between exactly two faces, separate groups, or bend by more than ``degrees``."""
    sides = edges(with_face_normals(tri), "group_id", "fid", "nx", "ny", "nz")
    # dealt by edge first: few tasks read a mesh, and each would hold a sum for every edge of its part
    g = sides.repartition("u", "v").groupBy("u", "v").agg(
        F.count(F.lit(1)).alias("n"), F.min("group_id").alias("g0"), F.max("group_id").alias("g1"),
        *[F.min_by(f"n{k}", "fid").alias(f"p{k}") for k in "xyz"], *[F.max_by(f"n{k}", "fid").alias(f"q{k}") for k in "xyz"],
    )
    bend = dot(vec("p"), vec("q")) < math.cos(math.radians(degrees))
    return g.where((F.col("n") != 2) | (F.col("g0") != F.col("g1")) | bend).select("u", "v", "n")


def weld(faces: DataFrame, vertices: DataFrame, tolerance: float) -> tuple[DataFrame, DataFrame]:
    """Vertices on one grid key become the first of them; faces that collapse go."""
    key = [F.rint(F.col(n) / tolerance).alias(f"k{n}") for n in "xyz"]
    keyed = vertices.select("*", *key)
    kept = keyed.groupBy("kx", "ky", "kz").agg(F.min("vid").alias("to"))
    to = keyed.join(kept, ["kx", "ky", "kz"]).select("vid", "to")
    out = faces
    for k in "abc":
        out = out.join(to.select(F.col("vid").alias(k), F.col("to").alias(f"__{k}")), k).drop(k).withColumnRenamed(f"__{k}", k)
    out = out.where("a <> b and b <> c and a <> c").select(*faces.columns)
    return out, vertices.join(kept.select(F.col("to").alias("vid")), "vid", "left_semi")


def merge(parts: list[tuple[DataFrame, DataFrame]], shift: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Union of (faces, vertices) parts; ids of each part start behind the largest of those before, or at multiples of ``shift``."""
    faces = vertices = None
    face_at = vertex_at = 0
    for k, (f, v) in enumerate(parts):
        if shift is not None:
            face_at = vertex_at = k * shift
        most = (f.agg(F.max("fid")).first()[0], v.agg(F.max("vid")).first()[0]) if shift is None else (0, 0)
        f = f.withColumns({c: F.col(c) + at for c, at in (("fid", face_at), *((c, vertex_at) for c in "abc"))})
        v = v.withColumn("vid", F.col("vid") + vertex_at)
        faces, vertices = (f, v) if faces is None else (faces.unionByName(f), vertices.unionByName(v))
        face_at, vertex_at = face_at + (most[0] or 0) + 1, vertex_at + (most[1] or 0) + 1
    return faces, vertices


def slice_z(tri: DataFrame, z: float) -> DataFrame:
    """fid and the segment (x0, y0)-(x1, y1) in which each face meets the plane at ``z``."""

    def cut(p: str, q: str) -> Column:
        a, b = F.col(f"{p}z") - z, F.col(f"{q}z") - z
        t = a / (a - b)
        at = F.struct(*[(F.col(f"{p}{n}") + (F.col(f"{q}{n}") - F.col(f"{p}{n}")) * t).alias(n) for n in "xy"])
        return F.when((a * b) < 0, at)

    ends = F.array_compact(F.array(cut("a", "b"), cut("b", "c"), cut("c", "a")))
    met = tri.select("fid", F.array_sort(ends).alias("e")).where(F.size("e") == 2)
    return met.select("fid", F.col("e")[0]["x"].alias("x0"), F.col("e")[0]["y"].alias("y0"), F.col("e")[1]["x"].alias("x1"), F.col("e")[1]["y"].alias("y1"))


def point_triangle_d2(p, a, b, c) -> Column:
    """Squared distance of a point to a triangle: the closest of its seven regions, as one expression."""
    ab, ac, ap = minus(b, a), minus(c, a), minus(p, a)
    d1, d2 = dot(ab, ap), dot(ac, ap)
    bp, cp = minus(p, b), minus(p, c)
    d3, d4, d5, d6 = dot(ab, bp), dot(ac, bp), dot(ab, cp), dot(ac, cp)
    va, vb, vc = d3 * d6 - d5 * d4, d5 * d2 - d1 * d6, d1 * d4 - d3 * d2

    def along(o, d, t) -> Column:
        q = tuple(oi + di * t for oi, di in zip(o, d, strict=True))
        return dot(minus(p, q), minus(p, q))

    bc = minus(c, b)
    n = cross(ab, ac)
    return (
        F.when((d1 <= 0) & (d2 <= 0), dot(ap, ap))
        .when((d3 >= 0) & (d4 <= d3), dot(bp, bp))
        .when((vc <= 0) & (d1 >= 0) & (d3 <= 0), along(a, ab, d1 / (d1 - d3)))
        .when((d6 >= 0) & (d5 <= d6), dot(cp, cp))
        .when((vb <= 0) & (d2 >= 0) & (d6 <= 0), along(a, ac, d2 / (d2 - d6)))
        .when((va <= 0) & (d4 - d3 >= 0) & (d5 - d6 >= 0), along(b, bc, (d4 - d3) / ((d4 - d3) + (d5 - d6))))
        .otherwise(dot(ap, n) * dot(ap, n) / dot(n, n))
    )


def _nearest_face(both: DataFrame) -> DataFrame:
    """pid, d, fid of the nearest of the faces each point is joined with."""
    d2 = point_triangle_d2(vec(""), vec("a"), vec("b"), vec("c"))
    side = dot(minus(vec(""), vec("a")), vec("n"))
    best = both.select("pid", "fid", d2.alias("d2"), side.alias("side")).groupBy("pid").agg(F.min_by(F.struct("d2", "side", "fid"), F.struct(F.round("d2", 12), "fid")).alias("b"))
    return best.select("pid", (F.sqrt("b.d2") * F.when(F.col("b.side") < 0, -1.0).otherwise(1.0)).alias("d"), F.col("b.fid").alias("fid"))


def signed_distance(points: DataFrame, tri: DataFrame, cell: float | None = None) -> DataFrame:
    """pid, distance to the nearest face, positive on the side of its normal.

    Faces lie in the grid cells their boxes touch, points look at their own cell and the 26
    around it: a distance up to the cell size is certain. Points further away try again in
    cells twice as large (``cell``: to begin with the mean size of a face's box, a 16th of the largest at least); the last few
    of a fixed number are sent to the faces. Without faces there are no rows.
    """
    faces = saved(with_face_normals(tri).select("fid", *[f"{k}{n}" for k in "abc" for n in "xyz"], "nx", "ny", "nz"), "faces")
    ends = {n: [f(*[F.col(f"{k}{n}") for k in "abc"]) for f in (F.least, F.greatest)] for n in "xyz"}
    extent = F.greatest(*[high - low for low, high in ends.values()])
    # no face lies in more than a few thousand cells
    size = cell or faces.agg(F.greatest(F.avg(extent), F.max(extent) / 16)).first()[0]
    left, done = points.select("pid", "x", "y", "z").dropna(), None
    while True:
        if size is None or left.limit(FEW + 1).count() <= FEW:
            last = _nearest_face(faces.crossJoin(F.broadcast(left.limit(FEW))))  # so many points at most
            return last if done is None else done.unionByName(last)
        size = max(float(size), 1e-9)
        keyed = faces
        for n, (low, high) in ends.items():
            keyed = keyed.withColumn(f"g{n}", F.explode(F.sequence(F.floor(low / size), F.floor(high / size))))
        asked = with_cell(left, size, prefix="g").withColumn("o", F.explode(_offsets()))
        asked = asked.select("pid", "x", "y", "z", *[(F.col(f"g{n}") + F.col(f"o.{o}")).alias(f"g{n}") for n, o in zip("xyz", "ijk", strict=True)])
        near = _nearest_face(asked.join(keyed, ["gx", "gy", "gz"]))
        sure = saved(near.where(F.abs("d") <= size), "near")
        done = sure if done is None else done.unionByName(sure)
        left = saved(left.join(sure.select("pid"), "pid", "left_anti"), "left")
        size *= 2


def merge_runs(segments: DataFrame, gap: float = 0.08) -> DataFrame:
    """(run, lo, hi) segments of a run joined where the next starts within ``gap`` of the furthest end so far."""
    order = W.partitionBy("run").orderBy("lo", "hi")
    reach = F.max("hi").over(order.rowsBetween(W.unboundedPreceding, -1))
    marked = segments.withColumn("fresh", F.when(reach.isNull() | (F.col("lo") > reach + gap), 1).otherwise(0))
    marked = marked.withColumn("k", F.sum("fresh").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
    return marked.groupBy("run", "k").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.count(F.lit(1)).alias("n"))
