"""Mesh repair and regions: islands, floaters, box unions, smoothing, consistent sides, hot boxes, cameras.

Meshes are (faces, vertices) as in ``mesh``. Components run over edges, never over pairs of
a group; smoothing is an aggregate over edges per half-step, written every step.

Edge cases: faces with a missing or null corner join nothing and fall away; a vertex without
faces keeps its place; empty meshes give empty results.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloudloom.functions.linalg import cross, dot, minus, vec
from cloudloom.operators.graph import _contracted, components, joined
from cloudloom.operators.mesh import corners, edges
from cloudloom.operators.points import XYZ, radius_pairs
from cloudloom.plans.scratch import saved


def face_components(faces: DataFrame) -> DataFrame:
    """fid, root: faces joined over shared edges; the faces of an edge form a star, not all pairs."""
    sides = edges(faces, "fid")
    head = sides.groupBy("u", "v").agg(F.min("fid").alias("head"))
    links = sides.join(head, ["u", "v"]).where("fid <> head").select(F.col("fid").alias("a"), F.col("head").alias("b"))
    return components(faces.select(F.col("fid").alias("node")), links).select(F.col("node").alias("fid"), "root")


def vertex_components(faces: DataFrame) -> DataFrame:
    """fid, root: faces joined over shared vertices; a root is the smallest vertex."""
    links = edges(faces).select(F.col("u").alias("a"), F.col("v").alias("b")).distinct()
    nodes = faces.select(F.explode(F.array("a", "b", "c")).alias("node")).distinct()
    return faces.select("fid", F.col("a").alias("node")).join(components(nodes, links), "node").select("fid", "root")


def drop_islands(faces: DataFrame, least: int = 40) -> DataFrame:
    """Faces of edge components of ``least`` faces or more."""
    rooted = saved(face_components(faces), "islands")
    large = rooted.groupBy("root").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    return faces.join(rooted.join(large, "root").select("fid"), "fid", "left_semi")


def strip_clutter(faces: DataFrame, vertices: DataFrame, least: int = 1_500, share: float = 0.003, box_least: int = 50) -> tuple[DataFrame, DataFrame]:
    """Faces of components of at least max(``least``, ``share`` of all), and the boxes of dropped ones of ``box_least`` faces."""
    rooted = saved(vertex_components(faces), "clutter")
    sizes = saved(rooted.groupBy("root").agg(F.count(F.lit(1)).alias("n")), "sizes")
    limit = sizes.agg(F.greatest(F.lit(float(least)), F.sum("n") * share).alias("limit"))
    marked = sizes.crossJoin(F.broadcast(limit))  # one row
    kept = faces.join(rooted.join(marked.where("n >= limit").select("root"), "root", "left_semi"), "fid", "left_semi")
    gone = rooted.join(marked.where((F.col("n") < F.col("limit")) & (F.col("n") >= box_least)).select("root", "n"), "root")
    own = gone.join(faces.select("fid", F.explode(F.array("a", "b", "c")).alias("vid")), "fid").join(vertices.select("vid", *XYZ), "vid")
    boxes = own.groupBy("root").agg(F.first("n").alias("weight"), *[f(c).alias(f"{c}{k}") for c in XYZ for k, f in ((0, F.min), (1, F.max))])
    return kept, boxes


def strip_floaters(faces: DataFrame, vertices: DataFrame, most_dist: float = 0.8, small: int = 400) -> DataFrame:
    """Faces without small components that lie further than ``most_dist`` from the largest one."""
    rooted = saved(vertex_components(faces), "floaters")
    sizes = saved(rooted.groupBy("root").agg(F.count(F.lit(1)).alias("n")), "sizes")
    main = sizes.agg(F.max_by("root", F.struct("n", -F.col("root"))).alias("main")).first()["main"]
    own = rooted.join(sizes.where(F.col("n") < small).select("root"), "root", "left_semi").where(F.col("root") != main if main is not None else F.lit(False))
    place = vertices.select(F.col("vid").alias("pid"), *XYZ)
    ends = lambda x: x.join(faces, "fid").select("root", F.explode(F.array("a", "b", "c")).alias("pid")).distinct()
    asked = saved(ends(own), "asked")
    base = ends(rooted.where(F.col("root") == main)) if main is not None else ends(rooted)
    close = radius_pairs(place.join(asked.select("pid").distinct(), "pid"), place.join(base.select("pid"), "pid"), most_dist).select("pid").distinct()
    saved_roots = asked.join(close, "pid").select("root").distinct()
    gone = own.join(saved_roots, "root", "left_anti")
    return faces.join(gone.select("fid"), "fid", "left_anti")


def merge_regions(boxes: DataFrame, dilate: float = 0.25, cap: int = 40) -> DataFrame:
    """Boxes (bid, x0 .. z1, weight) that overlap when grown by ``dilate`` become one; the ``cap`` heaviest are the report.

    Boxes meet over grid cells as large as the largest box, so near ones only are compared.
    """
    grown = boxes.select("bid", *[(F.col(f"{c}0") - dilate).alias(f"{c}0") for c in XYZ], *[(F.col(f"{c}1") + dilate).alias(f"{c}1") for c in XYZ])
    size = grown.agg(F.max(F.greatest(*[F.col(f"{c}1") - F.col(f"{c}0") for c in XYZ]))).first()[0] or 1.0
    cells = grown
    for c in XYZ:
        cells = cells.withColumn(f"g{c}", F.explode(F.sequence(F.floor(F.col(f"{c}0") / size), F.floor(F.col(f"{c}1") / size))))
    other = cells.select(F.col("bid").alias("o"), *[F.col(f"{c}{k}").alias(f"o{c}{k}") for c in XYZ for k in (0, 1)], "gx", "gy", "gz")
    meet = [(F.col(f"{c}0") <= F.col(f"o{c}1")) & (F.col(f"o{c}0") <= F.col(f"{c}1")) for c in XYZ]
    both = cells.repartition("gx", "gy", "gz").join(other.hint("merge"), ["gx", "gy", "gz"]).where("bid > o").where(meet[0] & meet[1] & meet[2])
    # what meets in a task is contracted there: no pair of boxes is written or held, however many lie in a cell
    links = both.select(F.col("bid").cast("long").alias("a"), F.col("o").cast("long").alias("b")).mapInArrow(_contracted, "a long, b long")
    found = components(boxes.select(F.col("bid").alias("node")), links)
    own = boxes.join(found.select(F.col("node").alias("bid"), "root"), "bid")
    ends = [f(f"{c}{k}").alias(f"{c}{k}") for c in XYZ for k, f in ((0, F.min), (1, F.max))]
    out = own.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("weight"), *ends)
    return out.orderBy(F.desc("weight"), "root").limit(cap)


def replace_regions(faces: DataFrame, vertices: DataFrame, boxes: DataFrame) -> DataFrame:
    """Faces whose centre lies in none of the boxes (x0 .. z1) of a report."""
    centre = corners(faces, vertices).select("fid", *[((F.col(f"a{c}") + F.col(f"b{c}") + F.col(f"c{c}")) / 3).alias(f"m{c}") for c in XYZ])
    inside = [F.col(f"m{c}").between(F.col(f"{c}0"), F.col(f"{c}1")) for c in XYZ]
    gone = centre.join(F.broadcast(boxes.select(*[f"{c}{k}" for c in XYZ for k in (0, 1)])), inside[0] & inside[1] & inside[2], "left_semi")
    return faces.join(gone.select("fid"), "fid", "left_anti")


def plain_merge(parts: list[DataFrame], default: int = 180) -> DataFrame:
    """Union of vertex tables on all their columns; missing colours become ``default``."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(default)).cast("int") for c in "rgb" if c in out.columns})


def _smoothed(vertices: DataFrame, sides: DataFrame, factor: float) -> DataFrame:
    """One half-step: each vertex moves by ``factor`` towards the mean of its neighbours, an edge counting once per face."""
    at = vertices.select(F.col("vid").alias("v"), *[F.col(c).alias(f"n{c}") for c in XYZ])
    means = sides.join(at, "v").groupBy("u").agg(*[F.avg(f"n{c}").alias(f"m{c}") for c in XYZ])
    both = vertices.join(means.withColumnRenamed("u", "vid"), "vid", "left")
    moved = {c: F.coalesce(F.col(c) + (F.col(f"m{c}") - F.col(c)) * factor, F.col(c)) for c in XYZ}
    return both.withColumns(moved).drop(*[f"m{c}" for c in XYZ])


def taubin(faces: DataFrame, vertices: DataFrame, steps: int, grow: float = 0.5, shrink: float = -0.53) -> DataFrame:
    """Vertices after ``steps`` pairs of a smoothing and a widening half-step."""
    one = edges(faces)
    sides = saved(one.unionByName(one.select(F.col("v").alias("u"), F.col("u").alias("v"))), "sides")
    for _ in range(steps):
        vertices = saved(_smoothed(_smoothed(vertices, sides, grow), sides, shrink), "smooth")
    return vertices


def hot_boxes(faces: DataFrame, vertices: DataFrame, heat_min: float = 0.45, cell: float = 0.6, least: int = 12) -> DataFrame:
    """Boxes of grid cells with ``least`` faces (with ``heat``) or more of at least ``heat_min``."""
    hot = corners(faces.where(F.col("heat") >= heat_min), vertices)
    hot = hot.withColumns({f"m{c}": (F.col(f"a{c}") + F.col(f"b{c}") + F.col(f"c{c}")) / 3 for c in XYZ})
    ends = [F.min(F.least(*[f"{k}{c}" for k in "abc"])).alias(f"{c}0") for c in XYZ] + [F.max(F.greatest(*[f"{k}{c}" for k in "abc"])).alias(f"{c}1") for c in XYZ]
    keyed = hot.withColumns({f"g{c}": F.floor(F.col(f"m{c}") / cell) for c in XYZ})
    return keyed.groupBy("gx", "gy", "gz").agg(F.count(F.lit(1)).alias("n"), *ends).where(F.col("n") >= least)


def unique_keys(rows: DataFrame, key: str, position: str) -> DataFrame:
    """Distinct keys with their first position and how often they occur."""
    return rows.groupBy(key).agg(F.min(position).alias("first"), F.count(F.lit(1)).alias("n"))


def best_cameras(centres: DataFrame, cameras: DataFrame, least: float = 0.2, signed: bool = False) -> DataFrame:
    """id, cam_id, score: for each centre (id, x, y, z, nx, ny, nz) the camera (cam_id, x, y, z) of most facing over squared distance.

    Cameras are those of one capture, some thousands of small rows; what faces none gets no row.
    """
    cams = cameras.select("cam_id", *[F.col(c).alias(f"k{c}") for c in XYZ])
    both = centres.crossJoin(F.broadcast(cams))
    to = minus(vec("k"), vec(""))
    d2 = dot(to, to)
    facing = dot(to, vec("n")) / F.sqrt(d2)
    facing = facing if signed else F.abs(facing)
    seen = both.where(d2 > 0).withColumn("facing", facing).where(F.col("facing") > least).withColumn("score", F.col("facing") / d2)
    best = seen.groupBy("id").agg(F.max_by(F.struct("cam_id", "score"), F.struct(F.round("score", 12), -F.col("cam_id"))).alias("b"))
    return best.select("id", "b.cam_id", "b.score")


def oriented_faces(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """Faces turned so that shared edges run in opposite directions, and each component has positive volume.

    Sides spread over edges: a face and its mirror image are two nodes, linked to the image of
    each neighbour that agrees with it. A component whose two images meet cannot be oriented and
    stays as it is.
    """
    both = faces.select("fid", "a", "b", "c", F.lit(0).alias("turn")).unionByName(faces.select("fid", "a", F.col("c").alias("b"), F.col("b").alias("c"), F.lit(1).alias("turn")))
    node = F.col("fid") * 2 + F.col("turn")
    sides = F.array(*[F.struct(F.least(p, q).alias("u"), F.greatest(p, q).alias("v"), (F.col(p) < F.col(q)).alias("up")) for p, q in (("a", "b"), ("b", "c"), ("c", "a"))])
    run = faces.select("fid", F.explode(sides).alias("e")).select("fid", "e.u", "e.v", "e.up")
    # the faces of an edge are linked to its first one: image to image if they run against each other, else crosswise
    # dealt by edge first: few tasks read a mesh, and each would hold a sum for every edge of its part
    run = run.repartition("u", "v")
    head = run.groupBy("u", "v").agg(F.min_by(F.struct("fid", "up"), "fid").alias("h"))
    met = run.join(head.hint("merge"), ["u", "v"]).where("fid <> h.fid").withColumn("cross", (F.col("up") == F.col("h.up")).cast("int"))
    links = met.withColumn("t", F.explode(F.array(F.lit(0), F.lit(1)))).select(
        (F.col("fid") * 2 + F.col("t")).alias("a"), (F.col("h.fid") * 2 + F.abs(F.col("t") - F.col("cross"))).alias("b")
    )
    rooted = saved(components(both.select(node.alias("node")), links), "sides")
    own = rooted.select(F.floor(F.col("node") / 2).alias("fid"), (F.col("node") % 2).cast("int").alias("turn"), "root")
    pairs = own.where("turn = 0").select("fid", F.col("root").alias("r0")).join(own.where("turn = 1").select("fid", F.col("root").alias("r1")).hint("merge"), "fid")
    turned = both.join(own.hint("merge"), ["fid", "turn"])
    tri = corners(turned.select("fid", "a", "b", "c", "root"), vertices)
    volume = saved(tri.groupBy("root").agg(F.sum(dot(vec("a"), cross(vec("b"), vec("c")))).alias("volume"), F.count(F.lit(1)).alias("n")), "volumes")
    total, (v0, v1) = rooted.count(), (volume.select(F.col("root").alias(f"r{k}"), F.col("volume").alias(f"v{k}"), "n") for k in (0, 1))
    choice = joined(joined(pairs, v0, "r0", "n", total), v1, "r1", "n", total)
    flip = F.when(F.col("r0") == F.col("r1"), 0).when(F.round("v1", 12) > F.round("v0", 12), 1).when((F.round("v1", 12) == F.round("v0", 12)) & (F.col("r1") < F.col("r0")), 1).otherwise(0)
    chosen = choice.select("fid", flip.alias("turn"))
    rest = [c for c in faces.columns if c not in ("a", "b", "c")]
    out = both.join(chosen.hint("merge"), ["fid", "turn"]).select("fid", "a", "b", "c", F.col("turn").alias("turned"))
    return out.join(faces.select(*rest), "fid") if len(rest) > 1 else out


def snapped_to_planes(vertices: DataFrame, normals: DataFrame, surfaces: DataFrame, voxel: float, degrees: float = 32.0) -> DataFrame:
    """Vertices on a surface moved onto it, those on two that are not near parallel onto their common line.

    ``normals``: (vid, nx, ny, nz); ``surfaces``: (plane_id, nx, ny, nz, d, x0 .. z1), few against
    the vertices. A vertex belongs to a surface within 0.8 ``voxel`` of its plane and two of its
    box; the first two by plane_id count. A single surface must also face as the vertex does.
    """
    own = [tuple(r) for r in surfaces.select(*[f"n{c}" for c in XYZ], "d", *[f"{c}{k}" for c in XYZ for k in (0, 1)]).orderBy("plane_id").collect()]
    held = ["ax", "ay", "az", "ad", "bx", "by", "bz", "bd"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The first two surfaces each vertex is on; no row per vertex and surface."""
        for batch in batches:
            at = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.float64) for c in XYZ])
            two, n = np.full((8, at.shape[1]), np.nan), np.zeros(at.shape[1], np.int64)
            for nx, ny, nz, d, *box in own:
                on = np.abs(at[0] * nx + at[1] * ny + at[2] * nz + d) < 0.8 * voxel
                for i in range(3):
                    on &= (at[i] >= box[2 * i] - 2 * voxel) & (at[i] <= box[2 * i + 1] + 2 * voxel)
                for k in (0, 1):
                    two[4 * k : 4 * k + 4, on & (n == k)] = np.array([[nx], [ny], [nz], [d]])
                n += on
            yield pa.RecordBatch.from_arrays([batch.column("vid"), *[pa.array(x, mask=np.isnan(x)) for x in two]], names=["vid", *held])

    kind = vertices.schema["vid"].dataType.simpleString()
    on = vertices.select("vid", *XYZ).mapInArrow(run, f"vid {kind}, " + ", ".join(f"{c} double" for c in held)).withColumnsRenamed({c: f"__{c}" for c in held})
    both = vertices.join(on, "vid", "left").join(normals.select("vid", *[F.col(f"n{c}").alias(f"w{c}") for c in XYZ]), "vid", "left")
    both = both.withColumnsRenamed({f"__{c}": c for c in held})
    both = both.withColumns({"ea": dot(vec(""), vec("a")) + F.col("ad"), "eb": dot(vec(""), vec("b")) + F.col("bd"), "c": dot(vec("a"), vec("b"))})
    # the nearest point of both planes, or of the first
    det = 1 - F.col("c") * F.col("c")
    cross_ = F.col("eb").isNotNull() & (F.abs("c") < 0.95)
    p, q = (F.col("ea") - F.col("c") * F.col("eb")) / det, (F.col("eb") - F.col("c") * F.col("ea")) / det
    faces_it = F.coalesce(F.abs(dot(vec("w"), vec("a"))) >= math.cos(math.radians(degrees)), F.lit(False))
    moved = {}
    for c in XYZ:
        line = F.col(c) - p * F.col(f"a{c}") - q * F.col(f"b{c}")
        flat = F.col(c) - F.col("ea") * F.col(f"a{c}")
        moved[c] = F.when(cross_, line).when(F.col("ea").isNotNull() & faces_it, flat).otherwise(F.col(c))
    return both.withColumn("snapped", F.coalesce(cross_ | (F.col("ea").isNotNull() & faces_it), F.lit(False))).withColumns(moved).select(*vertices.columns, "snapped")


def snapped_to_cylinders(vertices: DataFrame, cylinders: DataFrame, voxel: float) -> DataFrame:
    """Vertices within 0.8 ``voxel`` of a cylinder (cyl_id, px .. az, radius, length) moved onto it, the first by cyl_id."""
    own = [tuple(r) for r in cylinders.select(*[f"{p}{c}" for p in "pa" for c in XYZ], "radius", "length").orderBy("cyl_id").collect()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.float64) for c in XYZ])
            moved, done = at.copy(), np.zeros(at.shape[1], bool)
            for *line, radius, length in own:
                p, a = np.array(line[:3])[:, None], np.array(line[3:])[:, None]
                t = ((at - p) * a).sum(axis=0)
                across = at - p - t * a
                far = np.sqrt((across * across).sum(axis=0))
                on = ~done & (np.abs(t) <= length / 2) & (np.abs(far - radius) < 0.8 * voxel) & (far > 1e-9)
                moved[:, on] = (p + a * t)[:, on] + across[:, on] * radius / far[on]
                done |= on
            names = batch.schema.names
            yield pa.RecordBatch.from_arrays([pa.array(moved[XYZ.index(c)]) if c in XYZ else batch.column(c) for c in names], names=names)

    return vertices.withColumns({c: F.col(c).cast("double") for c in XYZ}).mapInArrow(run, ", ".join(f"{c} {'double' if c in XYZ else t}" for c, t in vertices.dtypes))


def panes(holes: DataFrame, inward: float = 0.04, least: float = 0.04, most: float = 25.0) -> DataFrame:
    """Triangles (hole, k, ax .. cz) that glaze openings (hole, nx, ny, nz, area, loop of x, y, z): a fan about the centre, set back."""
    fit = holes.where(F.abs("area").between(least, most))
    n = F.size("loop")

    def middle(c: str):
        return F.aggregate("loop", F.lit(0.0), lambda s, x: s + x[c]) / n

    centre = {c: middle(c) for c in XYZ}
    fit = fit.withColumns({f"m{c}": e for c, e in centre.items()}).withColumn("k", F.explode(F.sequence(F.lit(0), n - 1)))
    a, b = F.get("loop", F.col("k")), F.get("loop", (F.col("k") + 1) % n)
    at = [(e - F.col(f"n{c}") * inward).alias(f"{p}{c}") for p, f in (("a", lambda c: F.col(f"m{c}")), ("b", lambda c: a[c]), ("c", lambda c: b[c])) for c in XYZ for e in [f(c)]]
    return fit.select("hole", "k", *at)
