"""Textures: charts of a mesh, their places on pages, texels of faces and of clouds, colour gains of cameras.

Charts start as connected faces of one main direction; small ones are contracted into the
neighbour they share the longest border with, chart by chart, not face by face. Pages are
packed by prefix sums alone: charts of like height stand side by side on shelves, a shelf
taking those whose running width falls into its stretch, which leaves room for the widest;
shelves fill pages the same way. Texels are rows: a face's are exploded and tested, a cloud's
are summed by task before Spark adds them up.

Edge cases: faces without area have the direction of their neighbours, or +x; a face without
neighbours is a chart; charts larger than a page are cut to it; texels that no point met and
cameras with too few samples have no row; rows with nulls take no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cloudloom.operators.graph import components
from cloudloom.operators.mesh import corners, edges, with_face_normals
from cloudloom.operators.points import XYZ, knn
from cloudloom.plans.scratch import saved

_N = ("nx", "ny", "nz")


def neighbours(faces: DataFrame) -> DataFrame:
    """(fid, other): faces that share an edge, both ways, once per edge."""
    side = edges(faces, "fid")
    both = side.select("u", "v", "fid").join(side.select("u", "v", F.col("fid").alias("other")).hint("merge"), ["u", "v"])
    return both.where("fid <> other").select("fid", "other")


def directions(faces: DataFrame, vertices: DataFrame, near: DataFrame, smooth: int = 3) -> DataFrame:
    """(fid, bin): the main axis, 0 to 5 for +x -x +y -y +z -z, of normals summed with their neighbours' ``smooth`` times."""
    now = saved(with_face_normals(corners(faces, vertices)).select("fid", *_N), "normals")
    for _ in range(smooth):
        theirs = now.select(F.col("fid").alias("other"), *[F.col(c).alias(f"o{c}") for c in _N])
        sums = near.join(theirs.hint("merge"), "other").groupBy("fid").agg(*[F.sum(f"o{c}").alias(f"s{c}") for c in _N])
        both = now.join(sums.hint("merge"), "fid", "left").withColumns({f"s{c}": F.col(c) + F.coalesce(f"s{c}", F.lit(0.0)) for c in _N})
        size = F.sqrt(sum(F.col(f"s{c}") * F.col(f"s{c}") for c in _N))
        now = saved(both.select("fid", *[F.when(size > 1e-12, F.col(f"s{c}") / size).otherwise(F.col(c)).alias(c) for c in _N]), "normals")
    x, y, z = (F.round(F.abs(c), 9) for c in _N)
    axis = F.when((x >= y) & (x >= z), 0).when(y >= z, 1).otherwise(2)
    value = F.when(axis == 0, F.col("nx")).when(axis == 1, F.col("ny")).otherwise(F.col("nz"))
    return now.select("fid", (axis * 2 + F.when(F.round(value, 9) < 0, 1).otherwise(0)).alias("bin"))


def charts(faces: DataFrame, vertices: DataFrame, smooth: int = 3, least: int = 24, rounds: int = 4) -> DataFrame:
    """(fid, chart, bin): charts named by their lowest face at first; each round those under ``least`` faces join a larger neighbour."""
    near = saved(neighbours(faces), "near")
    bins = saved(directions(faces, vertices, near, smooth), "bins")
    own = bins.select(F.col("fid").alias("other"), F.col("bin").alias("theirs"))
    alike = near.join(bins.hint("merge"), "fid").join(own.hint("merge"), "other").where("bin = theirs").select(F.col("fid").alias("a"), F.col("other").alias("b"))
    first = components(bins.select(F.col("fid").alias("node")), alike).select(F.col("node").alias("fid"), F.col("root").alias("chart"))
    owner = saved(first.join(bins.hint("merge"), "fid").select("fid", "chart", "bin"), "charts")
    side = near.where("fid < other").join(owner.select("fid", F.col("chart").alias("a")).hint("merge"), "fid")
    side = side.join(owner.select(F.col("fid").alias("other"), F.col("chart").alias("b")).hint("merge"), "other").where("a <> b")
    # from here on charts, not faces: sizes, and borders in edges both ways
    sizes = saved(owner.groupBy("chart", "bin").agg(F.count(F.lit(1)).alias("n")), "sizes")
    one = side.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.count(F.lit(1)).alias("edges"))
    border = saved(one.unionByName(one.select(F.col("b").alias("a"), F.col("a").alias("b"), "edges")), "borders")
    for _ in range(rounds):
        big = sizes.where(F.col("n") >= least).select(F.col("chart").alias("b"), F.col("bin").alias("new_bin"))
        small = sizes.where(F.col("n") < least).select(F.col("chart").alias("a"))
        best = border.join(small.hint("merge"), "a").join(big.hint("merge"), "b").groupBy("a").agg(F.max_by(F.struct("b", "new_bin"), F.struct("edges", -F.col("b"))).alias("to"))
        best = saved(best.select("a", "to.b", "to.new_bin"), "joined")
        if best.isEmpty():
            break
        to = best.select(F.col("a").alias("chart"), F.col("b").alias("to"), "new_bin")
        owner = saved(owner.join(to.hint("merge"), "chart", "left").select("fid", F.coalesce("to", "chart").alias("chart"), F.coalesce("new_bin", "bin").alias("bin")), "charts")
        sizes = saved(owner.groupBy("chart", "bin").agg(F.count(F.lit(1)).alias("n")), "sizes")
        for c in "ab":
            moved = best.select(F.col("a").alias(c), F.col("b").alias("__to"))
            border = border.join(moved.hint("merge"), c, "left").withColumn(c, F.coalesce("__to", c)).drop("__to")
        border = saved(border.where("a <> b").groupBy("a", "b").agg(F.sum("edges").alias("edges")), "borders")
    return owner


def chart_places(owner: DataFrame, faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """(chart, bin, u0, v0, width, height): each chart's box along the two axes across its direction; u runs back in odd bins."""
    at = vertices.select("vid", *XYZ)
    each = faces.select("fid", F.explode(F.array("a", "b", "c")).alias("vid")).join(owner.hint("merge"), "fid").join(at.hint("merge"), "vid")
    axis = F.floor(F.col("bin") / 2)
    u = F.when(axis == 0, F.col("y")).otherwise(F.col("x")) * F.when(F.col("bin") % 2 == 1, -1.0).otherwise(1.0)
    v = F.when(axis == 2, F.col("y")).otherwise(F.col("z"))
    box = each.groupBy("chart", "bin").agg(F.min(u).alias("u0"), F.min(v).alias("v0"), F.max(u).alias("u1"), F.max(v).alias("v1"))
    return box.select("chart", "bin", "u0", "v0", (F.col("u1") - F.col("u0")).alias("width"), (F.col("v1") - F.col("v0")).alias("height"))


def packed(places: DataFrame, texel: float, page: int, gutter: int = 4) -> DataFrame:
    """(chart, page, px, py, w, h): texels of each chart (chart, width, height) and where they stand.

    Charts are of one class if their heights lie between the same powers of two. Within a class they
    stand in order of their numbers; the running sums are those of one row per chart.
    """
    texels = [F.least(F.greatest(F.ceil(F.col(c) / texel) + 1, F.lit(1)), F.lit(page - 2 * gutter)).cast("long").alias(k) for c, k in (("width", "w"), ("height", "h"))]
    rows = places.dropna(subset=["chart", "width", "height"]).select("chart", *texels).withColumns({"cw": F.col("w") + 2 * gutter, "ch": F.col("h") + 2 * gutter})
    rows = rows.withColumn("class", F.length(F.bin(F.col("ch") - 1)))
    over = W.partitionBy("class")
    rows = rows.withColumns({
        "room": F.greatest(F.lit(1), F.lit(page) - F.max("cw").over(over)), "before": F.sum("cw").over(over.orderBy("chart").rowsBetween(W.unboundedPreceding, 0)) - F.col("cw")
    })
    rows = saved(rows.withColumns({"shelf": F.floor(F.col("before") / F.col("room")), "px": F.col("before") % F.col("room")}), "shelved")
    shelves = rows.groupBy("class", "shelf").agg(F.max("ch").alias("sh"))
    room = F.greatest(F.lit(1), F.lit(page) - F.max("sh").over(W.partitionBy()))  # a row per shelf
    upto = F.sum("sh").over(W.orderBy(F.desc("class"), "shelf").rowsBetween(W.unboundedPreceding, 0)) - F.col("sh")
    placed = shelves.withColumns({"room": room, "upto": upto})
    placed = placed.select("class", "shelf", F.floor(F.col("upto") / F.col("room")).alias("page"), (F.col("upto") % F.col("room")).alias("y"))
    both = rows.join(placed.hint("merge"), ["class", "shelf"])
    return both.select("chart", "page", (F.col("px") + gutter).alias("px"), (F.col("y") + gutter).alias("py"), "w", "h")


def target_texel(vertices: DataFrame, centres: DataFrame, focal: float, cell: float, low: float = 0.003, high: float = 0.025) -> float:
    """Texel size from the photos: three quarters of what the nearest camera (pid, x, y, z) resolves, for the nearest quarter of the vertices."""
    near = knn(vertices.select(F.col("vid").alias("pid"), *XYZ), centres, 1, cell)
    far = near.agg(F.percentile(F.sqrt("d2"), 0.25)).first()[0]
    return 0.01 if far is None else min(max(0.75 * far / max(focal, 1.0), low), high)


def face_texels(tri: DataFrame, wide: int, high: int, slack: float = 0.35) -> DataFrame:
    """(fid, ix, iy, b0, b1, b2): texels a face (fid, au, av .. cu, cv in texels) covers, with ``slack`` beyond its sides, and its weights there."""

    def reach(k: str, most: int) -> tuple[Column, Column]:
        clip = lambda x: F.least(F.greatest(x, F.lit(0)), F.lit(most - 1)).cast("int")
        return clip(F.floor(F.least(f"a{k}", f"b{k}", f"c{k}"))), clip(F.ceil(F.greatest(f"a{k}", f"b{k}", f"c{k}")))

    u, v = reach("u", wide), reach("v", high)
    own = tri.dropna(subset=[f"{p}{k}" for p in "abc" for k in "uv"])
    each = own.withColumn("iy", F.explode(F.sequence(*v))).withColumn("ix", F.explode(F.sequence(*u)))
    e1, e2 = ({k: F.col(f"{p}{k}") - F.col(f"a{k}") for k in "uv"} for p in "bc")
    du, dv = F.col("ix") + 0.5 - F.col("au"), F.col("iy") + 0.5 - F.col("av")
    den = e1["u"] * e2["v"] - e1["v"] * e2["u"]
    each = each.withColumns({"__d": den, "__1": du * e2["v"] - dv * e2["u"], "__2": e1["u"] * dv - e1["v"] * du}).where(F.abs("__d") > 1e-12)
    each = each.withColumns({"__1": F.col("__1") / F.col("__d"), "__2": F.col("__2") / F.col("__d")}).withColumn("__0", 1 - F.col("__1") - F.col("__2"))
    inside = each.where(" and ".join(f"__{i} >= {-slack}" for i in range(3)))
    clipped = [F.least(F.greatest(F.col(f"__{i}"), F.lit(0.0)), F.lit(1.0)) for i in range(3)]
    total = F.greatest(clipped[0] + clipped[1] + clipped[2], F.lit(1e-12))
    return inside.select("fid", "ix", "iy", *[(c / total).alias(f"b{i}") for i, c in enumerate(clipped)])


def cloud_texels(points: DataFrame, surfaces: DataFrame, texel: float, near: float) -> DataFrame:
    """(plane_id, ix, iy, n, r, g, b): mean colours of the points (x, y, z, r, g, b) within ``near`` of a surface, by texel of its frame.

    ``surfaces``: plane_id, a place ox, oy, oz, axes ux .. vz and the box u0, v0, u1, v1 in them; a model's
    surfaces. A point may lie on several. Tasks sum their points by texel before Spark does.
    """
    own = surfaces.select("plane_id", *[f"{p}{c}" for p in "ouv" for c in XYZ], "u0", "v0", "u1", "v1").dropna().orderBy("plane_id").collect()
    colours = ("r", "g", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, shade = (np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.float64) for c in names]) for names in (XYZ, colours))
            for s in own:
                o, u, v = (np.array([s[f"{p}{c}"] for c in XYZ]) for p in "ouv")
                d = at - o[:, None]
                pu, pv, off = ((d * axis[:, None]).sum(axis=0) for axis in (u, v, np.cross(u, v)))
                hit = (np.abs(off) < near) & (pu >= s["u0"]) & (pu < s["u1"]) & (pv >= s["v0"]) & (pv < s["v1"])
                if not hit.any():
                    continue
                spot = np.floor(np.stack([(pu[hit] - s["u0"]) / texel, (pv[hit] - s["v0"]) / texel])).astype(np.int64)
                texels, which, n = np.unique(spot, axis=1, return_inverse=True, return_counts=True)
                sums = [np.bincount(which.ravel(), weights=c[hit]) for c in shade]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(n), s["plane_id"], np.int64)), pa.array(texels[0]), pa.array(texels[1]), pa.array(n.astype(np.int64)), *map(pa.array, sums)],
                    names=["plane_id", "ix", "iy", "n", *colours],
                )

    rows = points.select(*XYZ, *colours).dropna().mapInArrow(run, "plane_id long, ix long, iy long, n long, r double, g double, b double")
    sums = rows.groupBy("plane_id", "ix", "iy").agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in colours])
    return sums.select("plane_id", "ix", "iy", "n", *[(F.col(c) / F.col("n")).alias(c) for c in colours])


def gains(samples: DataFrame, least: int = 40, low: float = 0.6, high: float = 1.6) -> DataFrame:
    """(cam_id, r, g, b): what to multiply each camera's colours by, from samples (cam_id, reference r, g, b, photo pr, pg, pb).

    A camera's gain is its median ratio over the median of all cameras' (so the photos keep their own
    level), within ``low`` and ``high``; cameras of under ``least`` samples, or one alone, have none.
    """
    whole = samples.dropna(subset=["cam_id", *[p + c for p in ("", "p") for c in "rgb"]])
    ratio = {c: (F.col(c) + 8) / (F.col(f"p{c}") + 8) for c in "rgb"}
    raw = saved(whole.groupBy("cam_id").agg(F.count(F.lit(1)).alias("n"), *[F.percentile(v, 0.5).alias(c) for c, v in ratio.items()]).where(F.col("n") >= least), "gains")
    middle = raw.agg(F.count(F.lit(1)).alias("cams"), *[F.greatest(F.percentile(c, 0.5), F.lit(1e-6)).alias(f"m{c}") for c in "rgb"])
    both = raw.crossJoin(F.broadcast(middle)).where("cams >= 2")  # one row
    return both.select("cam_id", *[F.least(F.greatest(F.col(c) / F.col(f"m{c}"), F.lit(low)), F.lit(high)).alias(c) for c in "rgb"])
