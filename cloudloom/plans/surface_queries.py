"""Registered queries of the plane search, outlines, registration, mesh repair, solids and cameras, each with SQL of the same rows.

Where a search has no SQL of its own, the statement gives the known truth of the scene it must find.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloudloom.functions.linalg import MOMENTS_SQL, cross, dot, eigen_sql, vec
from cloudloom.operators import graph, mesh, parts, planes, points, registration, repair, scene, search, shapes, solids
from cloudloom.operators.points import XYZ
from cloudloom.plans import reconstruct
from cloudloom.plans.queries import E_SQL, FACES, FIT_SQL, TRI, VERTICES, B, O, box, embedded, orders_cloud, part_mesh, query, r6, rounded, view
from cloudloom.plans.scratch import saved
from cloudloom.sources import models

# ---------------------------------------------------------------- planes


def _room(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, float]:
    """The room without labels, with normals, and its mean spacing."""
    room = saved(box(spark, sf_dir).select("pid", *XYZ), "room")
    spacing = math.sqrt(59.0 / max(1, room.count()))
    return saved(room.join(points.steady_normals(room, 12, 3 * spacing), "pid"), "normals"), spacing


@query(f"""
WITH p AS ({B}), m AS (SELECT plane_id, avg(x) ax, avg(y) ay, avg(z) az, stddev_pop(x) sx, stddev_pop(y) sy, stddev_pop(z) sz, min(x) x0, max(x) x1, min(y) y0, max(y) y1, min(z) z0, max(z) z1 FROM p GROUP BY 1)
SELECT CASE WHEN x1 - x0 < 1 THEN 'x' WHEN y1 - y0 < 1 THEN 'y' ELSE 'z' END AS axis,
       round(CASE WHEN x1 - x0 < 1 THEN ax WHEN y1 - y0 < 1 THEN ay ELSE az END, 2) + 0e0 AS at, round(CASE WHEN x1 - x0 < 1 THEN sx WHEN y1 - y0 < 1 THEN sy ELSE sz END, 3) AS rms FROM m""")
def plane_search(spark, sf_dir):
    """The room's faces found from points alone: the axis each is square to, where it crosses it, and the spread of its points."""
    room, spacing = _room(spark, sf_dir)
    found, _ = search.detect(room, 0.02, min_inliers=max(20, room.count() // 40), radius=max(0.08, 3 * spacing))
    axis = F.when(F.abs("nx") > 0.99, "x").when(F.abs("ny") > 0.99, "y").when(F.abs("nz") > 0.99, "z").otherwise("none")
    at = F.when(axis == "x", F.col("mx")).when(axis == "y", F.col("my")).otherwise(F.col("mz"))
    return found.select(axis.alias("axis"), (F.round(at, 2) + F.lit(0.0)).alias("at"), F.round("rms", 3).alias("rms"))


@query("SELECT * FROM (VALUES (0, 'x'), (1, 'y'), (2, 'z')) t(axis_id, axis)")
def regularised_axes(spark, sf_dir):
    """Directions of the room's faces after regularising: exactly three, square to each other."""
    p = box(spark, sf_dir)
    new, _ = search.regularise(p, planes.fit_planes(p))
    a, b = new.select(*[F.col(c).alias(f"a{c}") for c in ("nx", "ny", "nz")]), new.select(*[F.col(c).alias(f"b{c}") for c in ("nx", "ny", "nz")])
    dots = a.crossJoin(F.broadcast(b)).select(F.abs(F.col("anx") * F.col("bnx") + F.col("any") * F.col("bny") + F.col("anz") * F.col("bnz")).alias("c"))  # planes of a model
    exact = dots.agg(F.min((F.col("c") < 1e-9) | (F.col("c") > 1 - 1e-9)).alias("exact"))
    which = F.when(F.abs("nx") > 0.99, 0).when(F.abs("ny") > 0.99, 1).when(F.abs("nz") > 0.99, 2)
    named = new.select(which.alias("axis_id")).distinct().withColumn("axis", F.element_at(F.array(F.lit("x"), F.lit("y"), F.lit("z")), F.col("axis_id") + 1))
    return named.crossJoin(F.broadcast(exact)).where("exact").drop("exact")  # one row


@query(f"""
WITH {FIT_SQL}, c AS (SELECT avg(x) cx, avg(y) cy, avg(z) cz FROM p),
s AS (SELECT plane_id, nx, ny, nz, fit.d AS d, CASE WHEN (mx - cx) * nx + (my - cy) * ny + (mz - cz) * nz < 0 THEN -1e0 ELSE 1e0 END AS s FROM eig JOIN fit USING (plane_id, nx, ny, nz), c)
SELECT plane_id, {r6('nx * s AS nx', 'ny * s AS ny', 'nz * s AS nz', 'd * s AS d')} FROM s""")
def oriented_planes(spark, sf_dir):
    p = box(spark, sf_dir)
    return rounded(search.oriented(planes.fit_planes(p), p).select("plane_id", "nx", "ny", "nz", "d"))


@query(f"""
WITH {FIT_SQL}, e AS (SELECT a.plane_id AS i, b.plane_id AS j FROM fit a JOIN fit b ON a.plane_id < b.plane_id WHERE abs(a.nx*b.nx + a.ny*b.ny + a.nz*b.nz) <= 97e-2),
t AS (SELECT e.i, e.j, g.j AS k, a.nx ax, a.ny ay, a.nz az, a.d ad, b.nx bx, b.ny by_, b.nz bz, b.d bd, c.nx cx, c.ny cy, c.nz cz, c.d cd
      FROM e JOIN e g ON g.i = e.j JOIN e h ON h.i = e.i AND h.j = g.j JOIN fit a ON a.plane_id = e.i JOIN fit b ON b.plane_id = e.j JOIN fit c ON c.plane_id = g.j),
u AS (SELECT *, ax*(by_*cz - bz*cy) + ay*(bz*cx - bx*cz) + az*(bx*cy - by_*cx) AS det FROM t),
v AS (SELECT i, j, k, -(ad*(by_*cz - bz*cy) + bd*(cy*az - cz*ay) + cd*(ay*bz - az*by_)) / det AS x, -(ad*(bz*cx - bx*cz) + bd*(cz*ax - cx*az) + cd*(az*bx - ax*bz)) / det AS y,
             -(ad*(bx*cy - by_*cx) + bd*(cx*ay - cy*ax) + cd*(ax*by_ - ay*bx)) / det AS z FROM u WHERE abs(det) >= 1e-6)
SELECT i, j, k, {r6('x', 'y', 'z')} FROM v WHERE (SELECT count(DISTINCT p.plane_id) FROM p WHERE p.plane_id IN (v.i, v.j, v.k)
  AND (p.x - v.x)*(p.x - v.x) + (p.y - v.y)*(p.y - v.y) + (p.z - v.z)*(p.z - v.z) <= 25e-2 * 25e-2) = 3""")
def supported_corners(spark, sf_dir):
    p = box(spark, sf_dir)
    fit = planes.fit_planes(p)
    skew = planes.pairs(fit).where("abs(a_nx * b_nx + a_ny * b_ny + a_nz * b_nz) <= 0.97")
    corners = planes.corner_points(fit, skew.select(F.col("a_plane_id").alias("i"), F.col("b_plane_id").alias("j")))
    return rounded(planes.supported(saved(corners, "corners"), p, 0.25))


@query(f"""
WITH {FIT_SQL}, h AS (SELECT *, CASE WHEN abs(nx) >= 9e-1 THEN 0e0 ELSE 1e0 END hx, CASE WHEN abs(nx) >= 9e-1 THEN 1e0 ELSE 0e0 END hy FROM fit),
u0 AS (SELECT *, -nz*hy AS ax, nz*hx AS ay, nx*hy - ny*hx AS az FROM h), u1 AS (SELECT *, sqrt(ax*ax + ay*ay + az*az) AS s FROM u0),
u AS (SELECT plane_id, nx, ny, nz, d, ax/s AS ux, ay/s AS uy, az/s AS uz FROM u1),
f AS (SELECT *, ny*uz - nz*uy AS vx, nz*ux - nx*uz AS vy, nx*uy - ny*ux AS vz FROM u)
SELECT plane_id, {r6('2 * ux + 3 * vx - nx * d AS x', '2 * uy + 3 * vy - ny * d AS y', '2 * uz + 3 * vz - nz * d AS z')} FROM f""")
def lifted_points(spark, sf_dir):
    fit = planes.fit_planes(box(spark, sf_dir))
    return rounded(search.lifted(fit, fit.select("plane_id", F.lit(2.0).alias("u"), F.lit(3.0).alias("v"))).select("plane_id", "x", "y", "z"))


@query(f"""
WITH p AS ({E_SQL}), v AS (SELECT * FROM p WHERE pid % 25 = 0), q AS (SELECT p.pid, v.x - p.x AS sx, v.y - p.y AS sy, v.z - p.z AS sz,
  row_number() OVER (PARTITION BY p.pid ORDER BY (p.x-v.x)*(p.x-v.x) + (p.y-v.y)*(p.y-v.y) + (p.z-v.z)*(p.z-v.z), v.pid) AS rk FROM p, v),
n AS (SELECT pid, ((pid % 7) - 3) / 5e0 AS nx, ((pid % 5) - 2) / 5e0 AS ny, 6e-1 AS nz FROM p),
s AS (SELECT n.*, CASE WHEN sx * nx + sy * ny + sz * nz < 0 THEN -1 ELSE 1 END AS s FROM n JOIN q USING (pid) WHERE rk = 1)
SELECT pid, {r6('nx * s AS nx', 'ny * s AS ny', 'nz * s AS nz')} FROM s""")
def normals_towards_path(spark, sf_dir):
    p = embedded(spark, sf_dir).select("pid", *XYZ)
    normals = p.select("pid", ((F.col("pid") % 7 - 3) / 5).alias("nx"), ((F.col("pid") % 5 - 2) / 5).alias("ny"), F.lit(0.6).alias("nz"))
    return rounded(points.towards(normals, p, p.where("pid % 25 = 0"), 0.5))


@query(f"""
WITH RECURSIVE p AS ({O}), k AS (SELECT pid, floor((x - (SELECT min(x) FROM p)) / 15e-1) i, floor((y - (SELECT min(y) FROM p)) / 15e-1) j, floor((z - (SELECT min(z) FROM p)) / 15e-1) l FROM p),
c AS (SELECT DISTINCT i, j, l, (i * 4398046511104 + j * 2097152 + l)::BIGINT AS node FROM k),
e AS (SELECT a.node AS a, b.node AS b FROM c a JOIN c b ON abs(a.i - b.i) <= 1 AND abs(a.j - b.j) <= 1 AND abs(a.l - b.l) <= 1 AND a.node <> b.node),
s(node, root, step) USING KEY (node) AS (SELECT node, node, 0 FROM c UNION
   SELECT e.b, min(s.root), max(s.step) + 1 FROM s JOIN e ON e.a = s.node JOIN recurring.s t ON t.node = e.b WHERE s.root < t.root GROUP BY e.b),
g AS (SELECT s.root AS label, count(*) AS n FROM k JOIN c USING (i, j, l) JOIN s USING (node) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1)
SELECT k.pid FROM k JOIN c USING (i, j, l) JOIN s USING (node) JOIN g ON g.label = s.root""")
def largest_component(spark, sf_dir):
    return graph.largest_component(orders_cloud(spark, sf_dir), 1.5).select("pid")


# ---------------------------------------------------------------- outlines

#: A star-shaped polygon per nation, its corners in order of the angle.
STARS = """
SELECT c_nationkey AS poly, c_custkey AS i, (1 + ((c_custkey * 37) % 101) / 1e2) * cos(6.283185307179586 * rk / n) AS u, (1 + ((c_custkey * 37) % 101) / 1e2) * sin(6.283185307179586 * rk / n) AS v
FROM (SELECT CAST(c_nationkey AS BIGINT) AS c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS rk, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer) q WHERE n >= 3"""


def _stars(spark: SparkSession, sf_dir: str) -> DataFrame:
    corners = view(spark, sf_dir, STARS, "customer")
    ring = F.transform(F.sort_array(F.collect_list(F.struct("i", "u", "v"))), lambda x: F.struct(x["u"].alias("u"), x["v"].alias("v")))
    return corners.groupBy("poly").agg(ring.alias("loop"))


@query(f"""
WITH s AS ({STARS}), t AS (SELECT *, lead(u) OVER w AS u1, lead(v) OVER w AS v1, first(u) OVER w AS u0, first(v) OVER w AS v0 FROM s WINDOW w AS (PARTITION BY poly ORDER BY i))
SELECT poly, (count(*) - 2)::BIGINT AS triangles, {r6('sum(u * coalesce(v1, v0) - coalesce(u1, u0) * v) / 2 AS area')} FROM t GROUP BY 1""")
def polygon_triangles(spark, sf_dir):
    tri = shapes.triangles(_stars(spark, sf_dir).withColumn("holes", F.expr("array()").cast(f"array<{shapes.LOOP}>")))
    area = ((F.col("b_u") - F.col("a_u")) * (F.col("c_v") - F.col("a_v")) - (F.col("b_v") - F.col("a_v")) * (F.col("c_u") - F.col("a_u"))) / 2
    return rounded(tri.groupBy("poly").agg(F.count(F.lit(1)).alias("triangles"), F.sum(area).alias("area")))


@query()
def plane_outlines(spark, sf_dir):
    """Outline and area of each of the room's faces."""
    p = box(spark, sf_dir)
    own = p.join(F.broadcast(planes.basis(planes.fit_planes(p)).select("plane_id", *[f"{a}{k}" for a in "uv" for k in XYZ])), "plane_id")
    uv = own.select("plane_id", *[sum(F.col(k) * F.col(f"{a}{k}") for k in XYZ).alias(a) for a in "uv"])
    spacing = math.sqrt(59.0 / max(1, p.count()))
    found = shapes.surfaces(uv, spacing)
    return rounded(found.select("plane_id", F.size("loop").alias("corners"), F.size("holes").alias("holes"), "area"), 4)


@query()
def simplified_stars(spark, sf_dir):
    """Corners left of each star after simplifying and straightening."""
    return shapes.reshaped(_stars(spark, sf_dir), 0.2, 12.0).select("poly", F.size("loop").alias("corners"))


# ---------------------------------------------------------------- registration and epochs

CHANGES_SQL = f"""p AS ({E_SQL}), a AS (SELECT * FROM p WHERE pid % 2 = 0), b AS (SELECT * FROM p WHERE pid % 2 = 1),
k AS (SELECT s.pid, t.x, t.y, t.z, row_number() OVER (PARTITION BY s.pid ORDER BY (s.x-t.x)*(s.x-t.x) + (s.y-t.y)*(s.y-t.y) + (s.z-t.z)*(s.z-t.z), t.pid) AS rk FROM a s, a t),
m AS (SELECT pid, {MOMENTS_SQL} FROM k WHERE rk <= 13 GROUP BY pid), {eigen_sql('m', 'pid')},
q AS (SELECT b.pid, a.pid AS nid, b.x - a.x AS dx, b.y - a.y AS dy, b.z - a.z AS dz,
      row_number() OVER (PARTITION BY b.pid ORDER BY (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z), a.pid) AS rk FROM b, a),
c AS (SELECT q.pid, q.nid, dx * nx + dy * ny + dz * nz AS change FROM q JOIN eig ON eig.pid = q.nid WHERE rk = 1)"""


def _epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = saved(embedded(spark, sf_dir).select("pid", *XYZ), "epochs")
    return registration.changes(p.where("pid % 2 = 0"), p.where("pid % 2 = 1"), 0.5)


@query(f"WITH {CHANGES_SQL} SELECT pid, nid, {r6('change')} FROM c")
def epoch_changes(spark, sf_dir):
    return rounded(_epochs(spark, sf_dir))


_BINS = ", ".join(
    f"count(*) FILTER (abs(change) >= {a!r} AND {'true' if b == math.inf else f'abs(change) < {b!r}'})::BIGINT AS h{i}"
    for i, (a, b) in enumerate(zip(registration.CHANGE_EDGES, registration.CHANGE_EDGES[1:], strict=False))
)


@query(f"""WITH {CHANGES_SQL} SELECT count(*)::BIGINT AS points, {r6('avg((abs(change) <= 1e-1)::INT) AS within', 'sqrt(avg(change * change)) AS rms', 'quantile_cont(abs(change), 95e-2) AS p95', 'max(abs(change)) AS largest')}, {_BINS} FROM c""")
def epoch_statistics(spark, sf_dir):
    return rounded(registration.change_statistics(_epochs(spark, sf_dir), 0.1))


#: A small known motion: a turn about z, then about x, and a shift.
_TURN = registration.rotation(np.array([0.01, -0.005, 0.02]))
_SHIFT = (0.015, -0.008, 0.004)
_MOTION_SQL = ", ".join(f"({i}, {round(float(v), 3)!r}::DOUBLE)" for i, v in enumerate([x for r, s in zip(_TURN, _SHIFT, strict=True) for x in (*r, s)]))


@query(f"SELECT place, value FROM (VALUES {_MOTION_SQL}) t(place, value)")
def registration_matrix(spark, sf_dir):
    """The motion between two positions of the room, found again from points alone: rows of the matrix, to a millimetre."""
    target = box(spark, sf_dir)
    normal = [F.when(F.col("plane_id").isin(ids), 1.0).otherwise(0.0).alias(n) for n, ids in (("nx", [5, 6]), ("ny", [3, 4]), ("nz", [1, 2]))]
    target = saved(target.select("pid", *XYZ, *normal), "target")
    back = _TURN.T
    gone = [float(v) for r, s in zip(back, -back @ _SHIFT, strict=True) for v in (*r, s)]
    source = points.transform(target.select("pid", *XYZ), gone)
    found = registration.register(source, target, 0.1, steps=20, most=0.5, summed=0.05)
    rows = [(i, round(v, 3) + 0.0) for i, v in enumerate(found.matrix)]
    return spark.createDataFrame(rows, "place int, value double")


@query("SELECT * FROM (VALUES (0, 2.5::DOUBLE), (1, 0.6::DOUBLE), (2, -0.8::DOUBLE), (3, 1.0::DOUBLE), (4, -2.0::DOUBLE), (5, 0.5::DOUBLE)) t(place, value)")
def similarity_fit(spark, sf_dir):
    """Scale, turn and shift between two positions of the customers' points."""
    p = orders_cloud(spark, sf_dir)
    pairs = p.select(
        *[F.col(c).alias(f"s{c}") for c in XYZ], ((F.col("x") * 0.6 - F.col("y") * 0.8) * 2.5 + 1).alias("tx"),
        ((F.col("x") * 0.8 + F.col("y") * 0.6) * 2.5 - 2).alias("ty"), (F.col("z") * 2.5 + 0.5).alias("tz"),
    )
    scale, turn, shift = registration.similarity(pairs)
    values = [scale, turn[0, 0], turn[0, 1], *shift]
    return spark.createDataFrame([(i, round(float(v), 6) + 0.0) for i, v in enumerate(values)], "place int, value double")


# ---------------------------------------------------------------- meshes

#: The grid mesh without every fifth row of faces: strips of four rows of faces.
STRIPS = f"SELECT * FROM ({FACES}) f WHERE c > 40 AND floor((c - 41) / 40) % 5 <> 4"


def _strips(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    _, v = part_mesh(spark, sf_dir)
    return spark.sql(STRIPS), v


@query(f"""
WITH s AS ({STRIPS}), g AS (SELECT *, floor((c - 41) / 200) AS strip FROM s), n AS (SELECT strip FROM g GROUP BY 1 HAVING count(*) >= 200)
SELECT fid FROM g JOIN n USING (strip)""")
def mesh_islands(spark, sf_dir):
    faces, _ = _strips(spark, sf_dir)
    return repair.drop_islands(faces, 200).select("fid")


@query(f"""
WITH v AS (SELECT vid, x * sqrt(2e0) AS x, y * sqrt(2e0) AS y, z * sqrt(2e0) AS z FROM ({VERTICES}) q), f AS ({FACES}), e AS (SELECT a AS u, b AS w FROM f UNION ALL SELECT b, c FROM f UNION ALL SELECT c, a FROM f),
d AS (SELECT u, w FROM e UNION ALL SELECT w, u FROM e),
m AS (SELECT d.u AS vid, avg(x) mx, avg(y) my, avg(z) mz FROM d JOIN v ON v.vid = d.w GROUP BY 1),
a AS (SELECT vid, coalesce(x + 5e-1 * (mx - x), x) x, coalesce(y + 5e-1 * (my - y), y) y, coalesce(z + 5e-1 * (mz - z), z) z FROM v LEFT JOIN m USING (vid)),
n AS (SELECT d.u AS vid, avg(x) mx, avg(y) my, avg(z) mz FROM d JOIN a ON a.vid = d.w GROUP BY 1),
b AS (SELECT vid, coalesce(x - 53e-2 * (mx - x), x) x, coalesce(y - 53e-2 * (my - y), y) y, coalesce(z - 53e-2 * (mz - z), z) z FROM a LEFT JOIN n USING (vid))
SELECT vid, {r6('x', 'y', 'z')} FROM b""")
def smoothed_mesh(spark, sf_dir):
    faces, vertices = part_mesh(spark, sf_dir)
    # scaled by an irrational number, so that no sixth digit lies on the edge of rounding
    scaled = vertices.withColumns({c: F.col(c) * F.sqrt(F.lit(2.0)) for c in XYZ})
    return rounded(repair.taubin(faces, scaled, 1))


@query(f"""
WITH {TRI}, h AS (SELECT *, ((fid * 31) % 100) / 1e2 AS heat, (ax+bx+cx)/3 mx, (ay+by_+cy)/3 my, (az+bz+cz)/3 mz FROM tri)
SELECT floor(mx / 2)::BIGINT AS gx, floor(my / 2)::BIGINT AS gy, floor(mz / 2)::BIGINT AS gz, count(*)::BIGINT AS n,
       {r6('min(least(ax, bx, cx)) AS x0', 'max(greatest(ax, bx, cx)) AS x1', 'min(least(ay, by_, cy)) AS y0', 'max(greatest(ay, by_, cy)) AS y1')}
FROM h WHERE heat >= 45e-2 GROUP BY 1, 2, 3 HAVING count(*) >= 12""")
def mesh_hot_boxes(spark, sf_dir):
    faces, vertices = part_mesh(spark, sf_dir)
    hot = repair.hot_boxes(faces.withColumn("heat", F.col("fid") * 31 % 100 / 100), vertices, cell=2.0)
    return rounded(hot.select("gx", "gy", "gz", "n", "x0", "x1", "y0", "y1"))


BOXES = """
SELECT CAST(s_suppkey AS BIGINT) AS bid, ((s_suppkey * 7919) % 997) / 1e1 AS x0, ((s_suppkey * 104729) % 991) / 1e1 AS y0, 0e0 AS z0,
       ((s_suppkey * 7919) % 997) / 1e1 + 1 + s_suppkey % 5 AS x1, ((s_suppkey * 104729) % 991) / 1e1 + 1 + s_suppkey % 7 AS y1, 1e0 AS z1, CAST(1 + s_suppkey % 11 AS BIGINT) AS weight FROM supplier"""


@query(f"""
WITH RECURSIVE b AS ({BOXES}), e AS (SELECT a.bid AS a, c.bid AS b FROM b a JOIN b c ON a.bid <> c.bid AND a.x0 <= c.x1 + 5e-1 AND c.x0 <= a.x1 + 5e-1 AND a.y0 <= c.y1 + 5e-1 AND c.y0 <= a.y1 + 5e-1),
s(node, root, step) USING KEY (node) AS (SELECT bid, bid, 0 FROM b UNION
   SELECT e.b, min(s.root), max(s.step) + 1 FROM s JOIN e ON e.a = s.node JOIN recurring.s t ON t.node = e.b WHERE s.root < t.root GROUP BY e.b)
SELECT root, count(*)::BIGINT AS n, sum(weight)::BIGINT AS weight, {r6('min(x0) AS x0', 'max(x1) AS x1', 'min(y0) AS y0', 'max(y1) AS y1')}
FROM s JOIN b ON b.bid = s.node GROUP BY 1 ORDER BY weight DESC, root LIMIT 40""")
def merged_regions(spark, sf_dir):
    found = repair.merge_regions(view(spark, sf_dir, BOXES, "supplier"), 0.25, 40)
    return rounded(found.select("root", "n", "weight", "x0", "x1", "y0", "y1"))


@query(f"""
WITH v AS ({VERTICES}), f AS ({FACES}), g AS (SELECT fid, a, CASE WHEN fid % 3 = 0 THEN c ELSE b END AS b, CASE WHEN fid % 3 = 0 THEN b ELSE c END AS c FROM f),
t AS (SELECT f.fid, p.x*(q.y*r.z - q.z*r.y) + p.y*(q.z*r.x - q.x*r.z) + p.z*(q.x*r.y - q.y*r.x) AS w FROM f JOIN v p ON p.vid = f.a JOIN v q ON q.vid = f.b JOIN v r ON r.vid = f.c),
s AS (SELECT sum(w) > 0 AS keep FROM t)
SELECT g.fid, CASE WHEN (fid % 3 = 0) = keep THEN 1 ELSE 0 END AS turned FROM g, s""")
def consistent_faces(spark, sf_dir):
    faces, vertices = part_mesh(spark, sf_dir)
    odd = F.col("fid") % 3 == 0
    mixed = faces.select("fid", "a", F.when(odd, F.col("c")).otherwise(F.col("b")).alias("b"), F.when(odd, F.col("b")).otherwise(F.col("c")).alias("c"))
    return repair.oriented_faces(mixed, vertices).select("fid", "turned")


@query(f"""
WITH v AS ({VERTICES}), f AS ({FACES}), m AS (SELECT s AS part, fid + s * 1099511627776 AS fid, a + s * 1099511627776 AS a FROM f, (SELECT 0::BIGINT AS s UNION ALL SELECT 1) t)
SELECT m.fid, m.a, v.x + 0e0 AS x FROM m JOIN v ON v.vid + m.part * 1099511627776 = m.a""")
def merged_meshes(spark, sf_dir):
    one = part_mesh(spark, sf_dir)
    faces, vertices = mesh.merge([one, one], 1 << 40)
    return faces.join(vertices.select(F.col("vid").alias("a"), "x"), "a").select("fid", "a", "x")


@query(f"""
WITH v AS ({VERTICES}), f AS ({FACES}), n AS (SELECT vid, row_number() OVER (ORDER BY vid) AS i, x, y, z FROM v)
SELECT 0 AS part, vid AS id, printf('v %.6f %.6f %.6f', x, y, z) AS line FROM n
UNION ALL SELECT 1, fid, printf('f %d %d %d', a.i, b.i, c.i) FROM f JOIN n a ON a.vid = f.a JOIN n b ON b.vid = f.b JOIN n c ON c.vid = f.c""")
def obj_text(spark, sf_dir):
    return models.obj_lines(*part_mesh(spark, sf_dir))


@query("SELECT l_suppkey AS key, min(l_orderkey) AS first, count(*)::BIGINT AS n FROM lineitem GROUP BY 1")
def unique_keys(spark, sf_dir):
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_suppkey").alias("key"), "l_orderkey")
    return repair.unique_keys(lines, "key", "l_orderkey")


# ---------------------------------------------------------------- solids and cameras

RODS = "SELECT CAST(n_nationkey AS BIGINT) AS item, n_nationkey * 3e0 AS px, (n_nationkey * 7 % 11) * 1e0 AS py, 1e0 AS pz, 6e-1 AS ax, 0e0 AS ay, 8e-1 AS az, 1e-1 + n_nationkey / 1e2 AS radius, 2e0 AS length FROM nation"


@query(f"""
WITH i AS ({RODS}), u AS (SELECT *, 0e0 AS ux, az AS uy0, -ay AS uz0 FROM i), w AS (SELECT *, sqrt(uy0*uy0 + uz0*uz0) AS s FROM u),
f AS (SELECT *, uy0/s AS uy, uz0/s AS uz, ay*(uz0/s) - az*(uy0/s) AS vx, -ax*(uz0/s) AS vy, ax*(uy0/s) AS vz FROM w),
k AS (SELECT f.*, range AS k FROM f, range(26)),
p AS (SELECT *, CASE WHEN k < 24 THEN floor(k / 12) ELSE k - 24 END - 5e-1 AS e, (k % 12) * 6.283185307179586 / 12 AS t, CASE WHEN k < 24 THEN radius ELSE 0e0 END AS r FROM k)
SELECT (item * 26 + k)::BIGINT AS vid, {r6('px + ax * e * length + (ux * cos(t) + vx * sin(t)) * r AS x', 'py + ay * e * length + (uy * cos(t) + vy * sin(t)) * r AS y', 'pz + az * e * length + (uz * cos(t) + vz * sin(t)) * r AS z')} FROM p""")
def tube_vertices(spark, sf_dir):
    return rounded(solids.tubes(view(spark, sf_dir, RODS, "nation"), 12)[1])


@query(f"""
WITH i AS ({RODS})
SELECT item, {r6('6 * radius * radius * sin(6.283185307179586 / 12) * length AS volume')}, 0::BIGINT AS open FROM i""")
def tube_volumes(spark, sf_dir):
    """Volume of each tube's faces, and its open edges: none."""
    faces, vertices = solids.tubes(view(spark, sf_dir, RODS, "nation"), 12)
    tri = mesh.corners(faces, vertices)
    volume = tri.groupBy(F.col("group_id").alias("item")).agg((F.sum(dot(vec("a"), cross(vec("b"), vec("c")))) / 6).alias("volume"))
    edges = mesh.edges(faces, "group_id").groupBy("u", "v", "group_id").agg(F.count(F.lit(1)).alias("n"))
    return rounded(volume.join(edges.groupBy(F.col("group_id").alias("item")).agg(F.count_if(F.col("n") != 2).alias("open")), "item"))


@query(f"SELECT bid AS item, {r6('(x1 - x0) * (y1 - y0) * (z1 - z0) AS volume')} FROM ({BOXES}) b")
def box_volumes(spark, sf_dir):
    faces, vertices = solids.boxes(view(spark, sf_dir, BOXES, "supplier").withColumnRenamed("bid", "item"))
    tri = mesh.corners(faces, vertices)
    return rounded(tri.groupBy(F.col("group_id").alias("item")).agg((F.sum(dot(vec("a"), cross(vec("b"), vec("c")))) / 6).alias("volume")))


@query("""
WITH h AS (SELECT s_suppkey AS i, (s_suppkey * 0.61803398875::DOUBLE) % 1e0 * 6 AS h FROM supplier),
c AS (SELECT i, h, (h + 4) % 6 AS h4, (h + 2) % 6 AS h2 FROM h)
SELECT i, round((85e-2 * 55e-2 + 85e-2 * 45e-2 * greatest(0e0, least(1e0, abs(h - 3) - 1))) * 255)::INTEGER AS r,
       round((85e-2 * 55e-2 + 85e-2 * 45e-2 * greatest(0e0, least(1e0, abs(h4 - 3) - 1))) * 255)::INTEGER AS g,
       round((85e-2 * 55e-2 + 85e-2 * 45e-2 * greatest(0e0, least(1e0, abs(h2 - 3) - 1))) * 255)::INTEGER AS b FROM c""")
def palette(spark, sf_dir):
    """A colour for every supplier's surface."""
    return solids.palette(spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("i")), "i")


#: Cameras above the cloud, turned about the vertical.
CAMERAS = """
SELECT CAST(n_nationkey AS BIGINT) AS cam_id, cos(n_nationkey * 1e0) AS r0, -sin(n_nationkey * 1e0) AS r1, 0e0 AS r2, sin(n_nationkey * 1e0) AS r3, cos(n_nationkey * 1e0) AS r4, 0e0 AS r5, 0e0 AS r6, 0e0 AS r7, 1e0 AS r8,
       n_nationkey / 1e1 AS t0, 1e-1 AS t1, 4e0 AS t2, 5e2 AS fx, 51e1 AS fy, 32e1 AS ox, 24e1 AS oy, -5e-2 AS k1, 1e-1 AS a12 FROM nation WHERE n_nationkey < 5"""

_FRAME_SQL = f"""c AS ({CAMERAS}), p AS ({E_SQL}),
f AS (SELECT pid, cam_id, r0*x + r1*y + r2*z + t0 AS cx, r3*x + r4*y + r5*z + t1 AS cy, r6*x + r7*y + r8*z + t2 AS cz, fx, fy, ox, oy, k1, a12 FROM p, c)"""


def _seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return solids.camera_frame(embedded(spark, sf_dir), view(spark, sf_dir, CAMERAS, "nation"))


@query(f"""
WITH {_FRAME_SQL}, w AS (SELECT *, cx/cz AS a, cy/cz AS b, 1 + k1 * ((cx/cz)*(cx/cz) + (cy/cz)*(cy/cz)) AS w FROM f WHERE cz > 0)
SELECT pid, cam_id, {r6('fx * a * w + ox AS px', 'fy * b * w + oy AS py')} FROM w""")
def pinhole_pixels(spark, sf_dir):
    return rounded(solids.pinhole(_seen(spark, sf_dir)).select("pid", "cam_id", "px", "py"))


@query(f"""
WITH {_FRAME_SQL}, s AS (SELECT *, sqrt(cx*cx + cy*cy) AS side, atan2(sqrt(cx*cx + cy*cy), cz) AS t FROM f),
r AS (SELECT *, CASE WHEN side > 1e-12 THEN (t + 1e-2*t*t - 2e-2*t*t*t) / side ELSE 1e0 END AS k FROM s)
SELECT pid, cam_id, {r6('fx * cx * k + a12 * cy * k + ox AS px', 'fy * cy * k + oy AS py')} FROM r""")
def fisheye_pixels(spark, sf_dir):
    return rounded(solids.fisheye(_seen(spark, sf_dir), [0.01, -0.02]).select("pid", "cam_id", "px", "py"))


@query(f"""
WITH v AS ({VERTICES}), c AS (SELECT CAST(n_nationkey AS BIGINT) AS cam_id, n_nationkey * 8e-1 AS kx, (n_nationkey * 7 % 25) * 1e0 AS ky, 3e0 + n_nationkey % 3 AS kz FROM nation),
s AS (SELECT vid AS id, cam_id, kx - x AS dx, ky - y AS dy, kz - z AS dz FROM v, c), f AS (SELECT id, cam_id, dx*dx + dy*dy + dz*dz AS d2, dz / sqrt(dx*dx + dy*dy + dz*dz) AS facing FROM s),
r AS (SELECT id, cam_id, facing / d2 AS score, row_number() OVER (PARTITION BY id ORDER BY round(facing / d2, 12) DESC, cam_id) AS rk FROM f WHERE abs(facing) > 2e-1 AND d2 > 0)
SELECT id, cam_id, {r6('score')} FROM r WHERE rk = 1""")
def vertex_cameras(spark, sf_dir):
    cams = view(spark, sf_dir, "SELECT CAST(n_nationkey AS BIGINT) AS cam_id, n_nationkey * 8e-1 AS x, (n_nationkey * 7 % 25) * 1e0 AS y, 3e0 + n_nationkey % 3 AS z FROM nation", "nation")
    _, vertices = part_mesh(spark, sf_dir)
    centres = vertices.select(F.col("vid").alias("id"), "x", "y", "z", F.lit(0.0).alias("nx"), F.lit(0.0).alias("ny"), F.lit(1.0).alias("nz"))
    return rounded(repair.best_cameras(centres, cams))


# ---------------------------------------------------------------- parts

_NOISE = "4e-3 * (((o_orderkey * 1299709 + 3) % 999961) / 999961e0 + ((o_orderkey * 224737 + 5) % 999959) / 999959e0 - 1)"
#: An upright pillar and a level pipe with 2 mm noise, with their normals.
PIPES = f"""
SELECT pid, part, CASE WHEN part = 0 THEN 2 + r * cos(t) ELSE 4 * s END AS x, CASE WHEN part = 0 THEN 2 + r * sin(t) ELSE 5 + r * cos(t) END AS y, CASE WHEN part = 0 THEN 3 * s ELSE 1 + r * sin(t) END AS z,
       CASE WHEN part = 0 THEN cos(t) ELSE 0e0 END AS nx, CASE WHEN part = 0 THEN sin(t) ELSE cos(t) END AS ny, CASE WHEN part = 0 THEN 0e0 ELSE sin(t) END AS nz
FROM (SELECT o_orderkey AS pid, (o_orderkey * 31) % 3 % 2 AS part, CASE WHEN (o_orderkey * 31) % 3 % 2 = 0 THEN 25e-2 ELSE 4e-1 END + {_NOISE} AS r,
             6.283185307179586 * (((o_orderkey * 7919 + 13) % 999983) / 999983e0) AS t, ((o_orderkey * 104729 + 7) % 999979) / 999979e0 AS s FROM orders) q"""


@query(f"""
WITH p AS (SELECT part, CASE WHEN part = 0 THEN sqrt((x - 2)*(x - 2) + (y - 2)*(y - 2)) ELSE sqrt((y - 5)*(y - 5) + (z - 1)*(z - 1)) END AS r, CASE WHEN part = 0 THEN z ELSE x END AS s FROM ({PIPES}) q)
SELECT CASE WHEN part = 0 THEN 'z' ELSE 'x' END AS axis, round(avg(r), 3) AS radius, count(*) AS n, round(stddev_pop(r), 4) AS rms, round(max(s) - min(s), 2) AS length FROM p GROUP BY part""")
def cylinder_search(spark, sf_dir):
    """The pillar and the pipe found from points and normals: axis, radius to a millimetre, how many points, their rms, length."""
    p = saved(view(spark, sf_dir, PIPES, "orders"), "pipes")
    found, _ = parts.detect_cylinders(p, 0.02, min_inliers=p.count() // 5, radius=0.4)
    axis = F.when(F.abs("ax") > 0.99, "x").when(F.abs("ay") > 0.99, "y").when(F.abs("az") > 0.99, "z").otherwise("none")
    return found.select(axis.alias("axis"), F.round("radius", 3).alias("radius"), "n", F.round("rms", 4).alias("rms"), F.round("length", 2).alias("length"))


#: Surface points of an I section 200 x 100 and a hollow section 100 x 100, 3 m long, half a millimetre of noise.
BEAMS = """
SELECT pid, cluster, x + 5 * cluster AS x, CASE WHEN cluster = 0 THEN a ELSE 8e-1 * a - 6e-1 * b END AS y, CASE WHEN cluster = 0 THEN b ELSE 6e-1 * a + 8e-1 * b END AS z
FROM (SELECT pid, cluster, 3 * s AS x,
        CASE WHEN cluster = 0 THEN CASE WHEN w < 50 THEN (t - 5e-1) * 1e-1 ELSE e END ELSE CASE WHEN w < 25 THEN 5e-2 + e WHEN w < 50 THEN -5e-2 + e ELSE (t - 5e-1) * 1e-1 END END AS a,
        CASE WHEN cluster = 0 THEN CASE WHEN w < 25 THEN 1e-1 + e WHEN w < 50 THEN -1e-1 + e ELSE (t - 5e-1) * 2e-1 END ELSE CASE WHEN w < 50 THEN (t - 5e-1) * 1e-1 WHEN w < 75 THEN 5e-2 + e ELSE -5e-2 + e END END AS b
      FROM (SELECT l_orderkey * 8 + l_linenumber AS pid, CAST(l_orderkey % 2 AS BIGINT) AS cluster, (l_partkey * 7919 + l_orderkey * 31 + l_linenumber * 17) % 100 AS w,
                   ((l_orderkey * 104729 + l_linenumber * 1299709 + l_partkey) % 999979) / 999979e0 AS s, ((l_orderkey * 15485863 + l_linenumber * 7919 + l_suppkey) % 999983) / 999983e0 AS t,
                   1e-3 * (((l_orderkey * 224737 + l_partkey * 5) % 999959) / 999959e0 - 5e-1) AS e FROM lineitem) q0) q1"""


@query("SELECT * FROM (VALUES (0::BIGINT, 'I/H', 'IPE 200', 3.0::DOUBLE), (1::BIGINT, 'hollow', 'SHS 100', 3.0::DOUBLE)) t(cluster, family, profile, length)")
def steel_members(spark, sf_dir):
    """Family, section and length of two beams from their surface points."""
    p = saved(view(spark, sf_dir, BEAMS, "lineitem"), "beams")
    return parts.members(p).select("cluster", "family", "profile", F.round("length", 1).alias("length"))


#: Both faces of a plate of 8 mm and of one of 12 mm, square to it.
SHEETS = """
SELECT o_orderkey AS pid, CAST(1 + o_orderkey % 4 AS BIGINT) AS plane_id, CASE WHEN o_orderkey % 4 < 2 THEN 6e-1 * u ELSE 1 + 12e-3 * (o_orderkey % 2) + e END AS x, 4e-1 * v AS y,
       CASE WHEN o_orderkey % 4 < 2 THEN 8e-3 * (o_orderkey % 2) + e ELSE 6e-1 * u END AS z
FROM (SELECT o_orderkey, ((o_orderkey * 7919 + 13) % 999983) / 999983e0 AS u, ((o_orderkey * 104729 + 7) % 999979) / 999979e0 AS v, 5e-4 * (((o_orderkey * 1299709 + 3) % 999961) / 999961e0 - 5e-1) AS e FROM orders) q"""


@query("SELECT * FROM (VALUES (1::BIGINT, 2::BIGINT, 0.008::DOUBLE, 0.008::DOUBLE), (3::BIGINT, 4::BIGINT, 0.012::DOUBLE, 0.012::DOUBLE)) t(i, j, thickness, stock)")
def plate_pairs(spark, sf_dir):
    """Plates found as pairs of faces, with their thickness to a tenth of a millimetre."""
    p = saved(view(spark, sf_dir, SHEETS, "orders"), "sheets")
    found = parts.plates(p, planes.fit_planes(p), 0.002)
    return found.select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), F.round("thickness", 4).alias("thickness"), "stock")


@query(f"""
WITH RECURSIVE p AS ({E_SQL}), e AS (SELECT a.pid AS a, b.pid AS b FROM p a JOIN p b ON a.pid <> b.pid AND (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z) <= 6e-2 * 6e-2),
s(node, root, step) USING KEY (node) AS (SELECT pid, pid, 0 FROM p UNION
   SELECT e.b, min(s.root), max(s.step) + 1 FROM s JOIN e ON e.a = s.node JOIN recurring.s t ON t.node = e.b WHERE s.root < t.root GROUP BY e.b)
SELECT node AS pid, root AS cluster FROM s""")
def radius_clusters(spark, sf_dir):
    return parts.radius_clusters(embedded(spark, sf_dir), 0.06).select("pid", "cluster")


# ---------------------------------------------------------------- end to end


@query("SELECT * FROM (VALUES ('ceiling', 1::BIGINT), ('floor', 1::BIGINT), ('wall', 4::BIGINT)) t(class, n)")
def reconstructed_room(spark, sf_dir):
    """Classes of the surfaces rebuilt from the room's points alone, preprocessing to outlines."""
    found, _, _ = reconstruct.surfaces(box(spark, sf_dir), reconstruct.settings("indoor", voxel_size=0.0, edge_artifact_filter=False, distance_threshold=0.03))
    return found.groupBy("class").agg(F.count(F.lit(1)).alias("n"))


#: Ground, a vehicle, a green tree and a pole, from lines of orders.
SCENE = """
SELECT pid, kind, CASE kind WHEN 'ground' THEN 12 * u WHEN 'vehicle' THEN 4 + 4.2e0 * u WHEN 'vegetation' THEN 10 + 8e-1 * (u - 5e-1) ELSE 2 + 4e-2 * u END AS x,
       CASE kind WHEN 'ground' THEN 8 * v WHEN 'vehicle' THEN 3 + CASE WHEN w < 50 THEN 1.8e0 * v WHEN w < 75 THEN 0e0 ELSE 1.8e0 END WHEN 'vegetation' THEN 6 + 8e-1 * (v - 5e-1) ELSE 6 + 4e-2 * v END AS y,
       CASE kind WHEN 'ground' THEN 2e-2 * s WHEN 'vehicle' THEN CASE WHEN w < 50 THEN 1.6e0 ELSE 4e-1 + 1.2e0 * v END WHEN 'vegetation' THEN 1 + 8e-1 * s ELSE 3 * s END AS z,
       CASE WHEN kind = 'vegetation' THEN 40 ELSE 120 END AS r, CASE WHEN kind = 'vegetation' THEN 160 ELSE 120 END AS g, CASE WHEN kind = 'vegetation' THEN 40 ELSE 120 END AS b
FROM (SELECT l_orderkey * 8 + l_linenumber + 1000000 * (l_partkey % 1000) + 1000000000 * (l_suppkey % 100) AS pid, CASE WHEN k < 50 THEN 'ground' WHEN k < 85 THEN 'vehicle' WHEN k < 92 THEN 'vegetation' ELSE 'bars' END AS kind, (k * 37) % 100 AS w, u, v, s
      FROM (SELECT *, (l_partkey * 7919 + l_orderkey * 31 + l_linenumber * 17) % 100 AS k, ((l_orderkey * 104729 + l_linenumber * 1299709 + l_partkey) % 999979) / 999979e0 AS u,
                   ((l_orderkey * 15485863 + l_linenumber * 7919 + l_suppkey) % 999983) / 999983e0 AS v, ((l_orderkey * 224737 + l_partkey * 5 + l_linenumber * 65537) % 999959) / 999959e0 AS s FROM lineitem) q0) q1"""


@query("SELECT * FROM (VALUES ('bars', true), ('ground', true), ('vegetation', true), ('vehicle', true)) t(kind, found)")
def scene_classes(spark, sf_dir):
    """Whether nine in ten points of each thing in the scene got its class (those less than the band above ground aside)."""
    p = saved(view(spark, sf_dir, SCENE, "lineitem").withColumn("pid", F.monotonically_increasing_id()), "scene")
    found = scene.classify(p)
    both = p.join(found, "pid").where("kind = 'ground' or z >= 0.4")
    return both.groupBy("kind").agg((F.avg((F.col("kind") == F.col("class")).cast("double")) >= 0.9).alias("found"))


#: A disc with 24 teeth of module 4 mm: points of its rim, tip and root circles alternating.
GEAR = """
SELECT o_orderkey AS pid, 1::BIGINT AS cluster, 1 + r * cos(t) AS x, 2 + 3e-2 * s AS y, 3 + r * sin(t) AS z
FROM (SELECT o_orderkey, t, s, CASE WHEN (t * 24 / 6.283185307179586) % 1e0 < 5e-1 THEN 52e-3 ELSE 43e-3 END AS r
      FROM (SELECT o_orderkey, 6.283185307179586 * (((o_orderkey * 7919 + 13) % 999983) / 999983e0) AS t, ((o_orderkey * 104729 + 7) % 999979) / 999979e0 AS s FROM orders) q0) q1"""


@query("SELECT * FROM (VALUES (1::BIGINT, 24, 0.004::DOUBLE, 0.03::DOUBLE)) t(cluster, teeth, module, width)")
def gear_teeth(spark, sf_dir):
    """Teeth, module and width of a gear from its points."""
    p = view(spark, sf_dir, GEAR.replace("1::BIGINT", "CAST(1 AS BIGINT)"), "orders")
    return parts.gears(saved(p, "gear")).select("cluster", "teeth", F.round("module", 4).alias("module"), F.round("width", 3).alias("width"))
