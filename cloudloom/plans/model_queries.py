"""Registered queries of closed models, skins, budget thinning, carving and cameras, each with SQL of the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from cloudloom.functions.linalg import MOMENTS_SQL, eigen_sql
from cloudloom.operators import bridges, holes, mesh, parts, paths, planes, repair, scene, skin, textures, thinning, visibility, watertight
from cloudloom.operators.points import XYZ
from cloudloom.plans import reconstruct
from cloudloom.plans.queries import BOX, FACES, TRACK, TRACK_SQL, VERTICES, O, box, orders_cloud, part_mesh, query, r6, rounded, view
from cloudloom.plans.scratch import saved

# ---------------------------------------------------------------- closed models

#: The room without the half of its ceiling beyond x = 2.
OPEN_BOX = f"SELECT * FROM ({BOX}) b WHERE NOT (plane_id = 2 AND x > 2)"


@query(f"""
WITH p AS ({OPEN_BOX}), m AS (SELECT plane_id, {MOMENTS_SQL} FROM p GROUP BY 1), {eigen_sql('m', 'plane_id, n, mx, my, mz')},
fit AS (SELECT plane_id, nx, ny, nz, -(nx*mx + ny*my + nz*mz) AS d FROM eig),
v AS (SELECT a.plane_id AS i, b.plane_id AS j, c.plane_id AS k,
        -(a.d*(b.ny*c.nz - b.nz*c.ny) + b.d*(c.ny*a.nz - c.nz*a.ny) + c.d*(a.ny*b.nz - a.nz*b.ny)) / (a.nx*(b.ny*c.nz - b.nz*c.ny) + a.ny*(b.nz*c.nx - b.nx*c.nz) + a.nz*(b.nx*c.ny - b.ny*c.nx)) AS x,
        -(a.d*(b.nz*c.nx - b.nx*c.nz) + b.d*(c.nz*a.nx - c.nx*a.nz) + c.d*(a.nz*b.nx - a.nx*b.nz)) / (a.nx*(b.ny*c.nz - b.nz*c.ny) + a.ny*(b.nz*c.nx - b.nx*c.nz) + a.nz*(b.nx*c.ny - b.ny*c.nx)) AS y,
        -(a.d*(b.nx*c.ny - b.ny*c.nx) + b.d*(c.nx*a.ny - c.ny*a.nx) + c.d*(a.nx*b.ny - a.ny*b.nx)) / (a.nx*(b.ny*c.nz - b.nz*c.ny) + a.ny*(b.nz*c.nx - b.nx*c.nz) + a.nz*(b.nx*c.ny - b.ny*c.nx)) AS z
      FROM fit a, fit b, fit c WHERE a.plane_id IN (5, 6) AND b.plane_id IN (3, 4) AND c.plane_id IN (1, 2)),
w AS (SELECT f.plane_id, f.nx, f.ny, f.nz, f.d, v.*, row_number() OVER (PARTITION BY f.plane_id ORDER BY i, j, k) AS r FROM fit f JOIN v ON f.plane_id IN (i, j, k)),
q AS (SELECT s.plane_id, s.nx, s.ny, s.nz, s.d, t.x - s.x ax, t.y - s.y ay, t.z - s.z az, u.x - s.x bx, u.y - s.y by_, u.z - s.z bz
      FROM w s JOIN w t ON t.plane_id = s.plane_id JOIN w u ON u.plane_id = s.plane_id WHERE (s.r, t.r, u.r) IN ((1, 2, 4), (1, 4, 3))),
g AS (SELECT plane_id, nx, ny, nz, d, sum(sqrt((ay*bz - az*by_)*(ay*bz - az*by_) + (az*bx - ax*bz)*(az*bx - ax*bz) + (ax*by_ - ay*bx)*(ax*by_ - ay*bx)) / 2) AS area FROM q GROUP BY ALL)
SELECT plane_id::BIGINT AS plane_id, 4 AS corners, {r6('area')}, round(sum(abs(2 * nx + 15e-1 * ny + 125e-2 * nz + d) * area / 3) OVER (), 6) + 0e0 AS volume, 0::BIGINT AS open_edges FROM g""")
def watertight_room(spark, sf_dir):
    """The room's closed model though half its ceiling was never measured: areas of its sides, volume, open edges."""
    p = saved(view(spark, sf_dir, OPEN_BOX, "orders"), "open")
    facets, _ = watertight.close(p, planes.fit_planes(p), 0.15)
    facets = saved(facets, "closed")
    faces, vertices = watertight.as_mesh(facets)
    whole = mesh.signed_volume(mesh.corners(faces, vertices)).crossJoin(F.broadcast(mesh.edge_stats(faces).select(F.col("boundary").alias("open_edges"))))  # one row each
    return rounded(facets.select("plane_id", F.size("polygon").alias("corners"), "area").crossJoin(F.broadcast(whole)))


@query(f"""
WITH p AS ({OPEN_BOX}), m AS (SELECT plane_id, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM p GROUP BY 1),
e AS (SELECT max(x) FILTER (plane_id = 6) - max(x) FILTER (plane_id = 5) AS a, max(y) FILTER (plane_id = 4) - max(y) FILTER (plane_id = 3) AS b, max(z) FILTER (plane_id = 2) - max(z) FILTER (plane_id = 1) AS c FROM m)
SELECT class, n, round(area, 1) AS area, round(a * b * c, 1) AS volume, 0::BIGINT AS open_edges
FROM e, LATERAL (SELECT unnest(['floor', 'ceiling', 'wall']) AS class, unnest([1, 1, 4])::BIGINT AS n, unnest([a * b, a * b, 2 * (a + b) * c]) AS area) t""")
def closed_room(spark, sf_dir):
    """The same room closed from points alone: surfaces by class, volume, open edges."""
    p = saved(view(spark, sf_dir, OPEN_BOX, "orders").select("pid", *XYZ), "open")
    found, faces, vertices = reconstruct.closed_model(p, reconstruct.settings("indoor", outward=True, voxel_size=0.0, edge_artifact_filter=False))
    whole = mesh.signed_volume(mesh.corners(faces, vertices)).crossJoin(F.broadcast(mesh.edge_stats(faces).select(F.col("boundary").alias("open_edges"))))  # one row each
    sums = found.groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.sum("area").alias("area")).crossJoin(F.broadcast(whole))
    return sums.select("class", "n", F.round("area", 1).alias("area"), F.round("volume", 1).alias("volume"), "open_edges")


# ---------------------------------------------------------------- thinning and skins

#: A cloud over lineitem: a thousand-fold denser middle, and outliers.
LINES = """
SELECT l_orderkey * 8 + l_linenumber AS pid, ((l_orderkey * 7919 + l_linenumber * 31) % 10007) / 1e2 AS x, ((l_partkey * 104729 + l_orderkey * 7) % 10009) / 1e2 AS y,
       ((l_suppkey * 15485863 + l_linenumber * 7) % 3001) / 1e3 AS z FROM lineitem"""
BUDGET = 9_000


@query(f"""
WITH p AS ({LINES}), b AS (SELECT min(x) lx, min(y) ly, min(z) lz, greatest(max(x) - min(x), max(y) - min(y), max(z) - min(z)) s FROM p),
c AS (SELECT p.*, least(floor((x - lx) / s * 2097152), 2097151)::BIGINT i, least(floor((y - ly) / s * 2097152), 2097151)::BIGINT j, least(floor((z - lz) / s * 2097152), 2097151)::BIGINT k FROM p, b),
m AS MATERIALIZED (SELECT pid, x, y, z, list_sum(list_transform(range(21), lambda t: (((i >> t) & 1) << (3 * t + 2)) + (((j >> t) & 1) << (3 * t + 1)) + (((k >> t) & 1) << (3 * t))))::BIGINT AS code FROM c),
n AS MATERIALIZED (SELECT l, count(DISTINCT code >> (63 - l)) AS n FROM m, range(64) t(l) GROUP BY l),
t AS (SELECT l, n FROM n WHERE n <= {BUDGET} ORDER BY l DESC LIMIT 1),
h AS (SELECT m.*, t.l, t.n, code >> (63 - t.l) AS cell, code >> (62 - t.l) AS half FROM m, t),
k AS MATERIALIZED (SELECT *, ((cell % 1000003) * 7919 + ((cell >> 20) % 999983) * 104729 + 13) % 1000000 AS hash FROM h),
x AS (SELECT hash // 1000 AS bucket, any_value(n) AS n, (min(half) <> max(half))::INT AS more FROM k GROUP BY hash, cell),
y AS (SELECT bucket, any_value(n) AS n, sum(more) AS more FROM x GROUP BY bucket),
u AS (SELECT bucket, n, sum(more) OVER (ORDER BY bucket) AS upto FROM y),
d AS (SELECT *, hash < 1000 * (SELECT coalesce(min(bucket), 1000) FROM u WHERE upto > {BUDGET} - n) AS deeper FROM k)
SELECT pid, x, y, z FROM d QUALIFY row_number() OVER (PARTITION BY deeper, CASE WHEN deeper THEN half ELSE cell END ORDER BY pid, x, y, z) = 1""")
def budget_points(spark, sf_dir):
    """The points a budget leaves of the cloud over lineitem."""
    return thinning.budget_points(view(spark, sf_dir, LINES, "lineitem"), BUDGET)


@query(f"""
WITH RECURSIVE p AS ({BOX}), f AS (SELECT floor(x / 4e-2)::BIGINT i, floor(y / 4e-2)::BIGINT j, floor(z / 4e-2)::BIGINT k, count(*) AS n FROM p GROUP BY ALL),
a AS (SELECT l, i >> l AS i, j >> l AS j, k >> l AS k, sum(n) AS n FROM f, range(12) t(l) GROUP BY ALL),
l AS (SELECT min(l) AS l FROM (SELECT l FROM a GROUP BY l HAVING count(*) FILTER (n >= 2) >= 6e-1 * count(*))),
c AS MATERIALIZED (SELECT i, j, k, n, ((i + 1048576) << 42) | ((j + 1048576) << 21) | (k + 1048576) AS node FROM a JOIN l USING (l) WHERE n >= 2),
e AS (SELECT x.node AS a, y.node AS b FROM c x JOIN c y ON abs(x.node - y.node) IN (1, 2097152, 4398046511104)),
s(node, root, step) USING KEY (node) AS (SELECT node, node, 0 FROM c UNION
   SELECT e.b, min(s.root), max(s.step) + 1 FROM s JOIN e ON e.a = s.node JOIN recurring.s t ON t.node = e.b WHERE s.root < t.root GROUP BY e.b),
g AS (SELECT root FROM c JOIN s USING (node) GROUP BY 1 HAVING sum(n) >= 300),
kept AS MATERIALIZED (SELECT c.* FROM c JOIN s USING (node) JOIN g USING (root)),
o AS (SELECT * FROM (VALUES (1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)) o(di, dj, dk)),
q AS MATERIALIZED (SELECT kept.i, kept.j, kept.k, di, dj, dk FROM kept, o WHERE NOT EXISTS (SELECT 1 FROM kept t WHERE t.i = kept.i + di AND t.j = kept.j + dj AND t.k = kept.k + dk)),
r AS (SELECT DISTINCT q.i + (CASE WHEN di <> 0 THEN (di + 1) // 2 ELSE u END) AS i, q.j + (CASE WHEN dj <> 0 THEN (dj + 1) // 2 WHEN di <> 0 THEN u ELSE v END) AS j,
        q.k + (CASE WHEN dk <> 0 THEN (dk + 1) // 2 ELSE v END) AS k FROM q, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) t(u, v))
SELECT 4e-2 * (1 << (SELECT l FROM l)) AS voxel, (SELECT count(*) FROM g) AS pieces, (SELECT sum(n) FROM kept)::BIGINT AS points, (SELECT count(*) FROM kept) AS cells,
       2 * (SELECT count(*) FROM q) AS n_faces, (SELECT count(*) FROM r) AS n_vertices, 0::BIGINT AS boundary,
       round((SELECT count(*) FROM kept) * power(4e-2 * (1 << (SELECT l FROM l)), 3), 6) + 0e0 AS volume""")
def freeform_skin(spark, sf_dir):
    """The unsmoothed skin around the room: size of its voxels, pieces, cells, faces, corners, open edges and the volume it encloses."""
    p = box(spark, sf_dir).select("pid", *XYZ)
    solid, size = skin.pyramid(p, 0.04, 1 << 40)
    kept = saved(skin.pieces(solid, 300), "kept")
    faces, vertices = skin.shell(kept, size)
    faces, vertices = saved(faces, "faces"), saved(vertices, "vertices")
    facts = kept.agg(F.countDistinct("piece").alias("pieces"), F.sum("n").alias("points"), F.count(F.lit(1)).alias("cells"))
    counts = faces.agg(F.count(F.lit(1)).alias("n_faces")).crossJoin(F.broadcast(vertices.agg(F.count(F.lit(1)).alias("n_vertices"))))
    whole = mesh.edge_stats(faces).select("boundary").crossJoin(F.broadcast(mesh.signed_volume(mesh.corners(faces, vertices))))
    one_row = facts.crossJoin(F.broadcast(counts)).crossJoin(F.broadcast(whole))
    return rounded(one_row.select(F.lit(size).alias("voxel"), "*"))


# ---------------------------------------------------------------- carving

#: A track over supplier, through the cloud over orders.
SUPPLY_TRACK = """
SELECT s_suppkey AS pid, ((s_suppkey * 4391) % 1009) / 1e1 AS x, ((s_suppkey * 7001) % 1013) / 1e1 AS y, 15e-1 + ((s_suppkey * 37) % 11) / 1e2 AS z FROM supplier"""


@query(f"""
WITH p AS ({O}), t AS (SELECT *, row_number() OVER (ORDER BY pid) - 1 AS i, count(*) OVER () AS n FROM ({SUPPLY_TRACK}) s),
v AS (SELECT pid AS vid, x AS vx, y AS vy, z AS vz FROM t WHERE n <= 110 OR i IN (SELECT floor(k * (n - 1) / 109e0) FROM range(110) r(k))),
d AS (SELECT p.pid, vid, x - vx AS dx, y - vy AS dy, z - vz AS dz, sqrt((x - vx)*(x - vx) + (y - vy)*(y - vy) + (z - vz)*(z - vz)) AS r FROM p, v),
c AS MATERIALIZED (SELECT pid, vid, r, least(floor((atan2(dy, dx) + pi()) / (2 * pi()) * 512), 511) * 160 + least(floor((asin(greatest(-1, least(1, dz / greatest(r, 1e-6)))) + pi() / 2) / pi() * 160), 159) AS cell,
        least(floor((ln(r) - ln(8e-1)) / (ln(12e1) - ln(8e-1)) * 96), 95) AS bucket FROM d WHERE r > 8e-1 AND r < 12e1),
h AS (SELECT vid, cell, bucket, count(*) AS n FROM c GROUP BY ALL),
u AS (SELECT vid, cell, bucket, sum(n) OVER (PARTITION BY vid, cell ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY vid, cell) AS total FROM h),
s AS (SELECT vid, cell, exp(ln(8e-1) + min(bucket) / 96 * (ln(12e1) - ln(8e-1))) AS far FROM u WHERE total >= 6 AND upto >= floor(total * 6e-1) GROUP BY ALL),
w AS (SELECT pid, count(*) FILTER (r < far - greatest(25e-2, 5e-2 * far)) AS passed, count(*) FILTER (abs(r - far) <= greatest(1e-1 + 2e-2 * far, 12e-2)) AS held FROM c JOIN s USING (vid, cell) GROUP BY 1)
SELECT pid, coalesce(passed, 0)::BIGINT AS passed, coalesce(held, 0)::BIGINT AS held, coalesce(passed >= 3 AND passed > 2 * held, FALSE) AS ghost FROM p LEFT JOIN w USING (pid)""")
def carved_ghosts(spark, sf_dir):
    """Votes of up to 110 views along a track over the cloud of orders."""
    return scene.carve_views(orders_cloud(spark, sf_dir), view(spark, sf_dir, SUPPLY_TRACK, "supplier"))


# ---------------------------------------------------------------- cameras

#: Cameras over nation that look straight down on spikes over part: 200 x 150 pixels, a little barrel distortion.
CAMERAS = """
SELECT CAST(n_nationkey AS BIGINT) AS cam_id, 1e0 AS r0, 0e0 AS r1, 0e0 AS r2, 0e0 AS r3, -1e0 AS r4, 0e0 AS r5, 0e0 AS r6, 0e0 AS r7, -1e0 AS r8,
       -(n_nationkey * 8e-1) AS t0, (n_nationkey * 7 % 25) * 1e0 AS t1, 9e0 + n_nationkey % 3 AS t2, 6e1 AS fx, 6e1 AS fy, 1e2 AS ox, 75e0 AS oy, 1e-2 AS k1, 200 AS width, 150 AS height
FROM nation"""
#: The part mesh with heights twenty times as large.
SPIKES = f"SELECT vid, x, y, z * 20 AS z FROM ({VERTICES}) v"


def _projected(source: str, keep: str) -> str:
    return f"""SELECT {keep}, cam_id, fx * a * w + ox AS px, fy * b * w + oy AS py, cz, -t0 - x AS dx, t1 - y AS dy, t2 - z AS dz
  FROM (SELECT *, 1 + k1 * (a * a + b * b) AS w FROM (SELECT *, (x + t0) / cz AS a, (t1 - y) / cz AS b FROM (SELECT s.*, cams.*, t2 - z AS cz FROM {source} s, cams) q0 WHERE cz > 5e-2) q1) q2"""


SEEN_SQL = f"""cams AS ({CAMERAS}), v AS ({SPIKES}), f AS ({FACES}),
tri AS (SELECT fid, p.x ax, p.y ay, p.z az, q.x bx, q.y by_, q.z bz, r.x cx, r.y cy, r.z cz FROM f JOIN v p ON p.vid = f.a JOIN v q ON q.vid = f.b JOIN v r ON r.vid = f.c),
w AS (SELECT *, (by_-ay)*(cz-az) - (bz-az)*(cy-ay) AS wx, (bz-az)*(cx-ax) - (bx-ax)*(cz-az) AS wy, (bx-ax)*(cy-ay) - (by_-ay)*(cx-ax) AS wz FROM tri),
m AS (SELECT fid AS id, (ax+bx+cx)/3 AS x, (ay+by_+cy)/3 AS y, (az+bz+cz)/3 AS z, wx/sqrt(wx*wx+wy*wy+wz*wz) AS nx, wy/sqrt(wx*wx+wy*wy+wz*wz) AS ny, wz/sqrt(wx*wx+wy*wy+wz*wz) AS nz FROM w),
d AS (SELECT cam_id, floor(py / 150 * 30) * 40 + floor(px / 200 * 40) AS pixel, min(cz) AS depth FROM ({_projected('v', 'vid')}) p WHERE px >= 0 AND px < 200 AND py >= 0 AND py < 150 GROUP BY 1, 2),
c AS (SELECT *, least(greatest(floor(py / 150 * 30), 0), 29) * 40 + least(greatest(floor(px / 200 * 40), 0), 39) AS pixel, dx*dx + dy*dy + dz*dz AS d2 FROM ({_projected('m', 'id, nx, ny, nz')}) p
      WHERE px >= 0 AND px <= 199 AND py >= 0 AND py <= 149),
s AS (SELECT id, cam_id, abs(nx*dx + ny*dy + nz*dz) / sqrt(d2) / d2 AS score FROM c LEFT JOIN d USING (cam_id, pixel)
      WHERE abs(nx*dx + ny*dy + nz*dz) / sqrt(d2) > 2e-1 AND (depth IS NULL OR cz <= depth + greatest(12e-2, 5e-2 * cz))),
b AS MATERIALIZED (SELECT fid AS id, cam_id, score FROM f LEFT JOIN (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, cam_id) = 1) s ON s.id = f.fid)"""


def _spikes(spark, sf_dir):
    faces, _ = part_mesh(spark, sf_dir)
    return faces, view(spark, sf_dir, SPIKES, "part"), view(spark, sf_dir, CAMERAS, "nation")


@query(f"WITH {SEEN_SQL} SELECT id, cam_id, {r6('score')} FROM b")
def seen_faces(spark, sf_dir):
    """The camera that sees each face best, with depth buffers of 40 x 30 pixels."""
    faces, vertices, cameras = _spikes(spark, sf_dir)
    return rounded(visibility.seen_by(visibility.face_centres(faces, vertices), vertices, cameras, wide=40))


def _vote_sql(k: int) -> str:
    return f"""r{k} AS MATERIALIZED (SELECT o.id, CASE WHEN o.cam_id IS NOT NULL THEN coalesce(t.theirs, o.cam_id) END AS cam_id FROM r{k - 1} o
  LEFT JOIN (SELECT nb.id, o.cam_id AS theirs FROM nb JOIN r{k - 1} o ON o.id = nb.other WHERE o.cam_id IS NOT NULL GROUP BY ALL HAVING count(*) >= 2) t ON t.id = o.id)"""


@query(f"""
WITH {SEEN_SQL}, e AS (SELECT fid, least(a, b) AS u, greatest(a, b) AS v FROM f UNION ALL SELECT fid, least(b, c), greatest(b, c) FROM f UNION ALL SELECT fid, least(c, a), greatest(c, a) FROM f),
nb AS (SELECT DISTINCT x.fid AS id, y.fid AS other FROM e x JOIN e y ON x.u = y.u AND x.v = y.v AND x.fid <> y.fid QUALIFY dense_rank() OVER (PARTITION BY x.fid ORDER BY y.fid) <= 3),
r0 AS (SELECT id, cam_id FROM b), {_vote_sql(1)}, {_vote_sql(2)}
SELECT id, cam_id FROM r2""")
def voted_cameras(spark, sf_dir):
    """The same choice after two rounds of neighbours' votes."""
    faces, vertices, cameras = _spikes(spark, sf_dir)
    seen = saved(visibility.seen_by(visibility.face_centres(faces, vertices), vertices, cameras, wide=40), "seen")
    return visibility.voted(faces, seen)


# ---------------------------------------------------------------- holes

#: The part mesh without every eleventh of its squares.
PIERCED = f"SELECT * FROM ({FACES}) f WHERE floor(fid / 2) % 11 <> 0"
LOOPS_SQL = f"""v AS ({VERTICES}), f AS ({PIERCED}),
h AS (SELECT b AS u, a AS v FROM f UNION ALL SELECT c, b FROM f UNION ALL SELECT a, c FROM f),
o AS (SELECT any_value(u) AS u, any_value(v) AS v FROM h GROUP BY least(u, v), greatest(u, v) HAVING count(*) = 1),
k AS (SELECT x FROM (SELECT u AS x FROM o UNION ALL SELECT v FROM o) GROUP BY x HAVING count(*) = 2 INTERSECT SELECT u FROM o GROUP BY u HAVING count(*) = 1),
st AS MATERIALIZED (SELECT u, v FROM o WHERE u IN (SELECT x FROM k) AND v IN (SELECT x FROM k)),
wk AS (SELECT u AS start, v AS pos, 1 AS n, least(u, v) AS low FROM st UNION ALL SELECT start, st.v, n + 1, least(low, st.v) FROM wk JOIN st ON st.u = wk.pos WHERE wk.pos <> wk.start),
lp AS MATERIALIZED (SELECT start AS vid, low AS loop, n FROM wk WHERE pos = start),
rk AS MATERIALIZED (SELECT lp.loop, lp.vid, CASE WHEN lp.vid = lp.loop THEN 0 ELSE wk.n END::BIGINT AS place, lp.n::BIGINT AS n FROM lp JOIN wk ON wk.start = lp.loop AND wk.pos = lp.vid)"""


@query(f"WITH RECURSIVE {LOOPS_SQL} SELECT * FROM rk")
def boundary_loops(spark, sf_dir):
    """Open loops of a pierced mesh, their vertices in order."""
    part_mesh(spark, sf_dir)
    return holes.loops(spark.sql(PIERCED))


@query(f"""
WITH RECURSIVE {LOOPS_SQL}, g AS (SELECT loop, n, avg(x) AS x, avg(y) AS y, sqrt(power(max(x) - min(x), 2) + power(max(y) - min(y), 2) + power(max(z) - min(z), 2)) AS across
  FROM rk JOIN v USING (vid) WHERE n BETWEEN 4 AND 300 GROUP BY loop, n)
SELECT loop, n, {r6('x', 'y')}, 125e-3 AS z, n AS fan FROM g WHERE across <= 1""")
def closed_holes(spark, sf_dir):
    """Holes of one square closed by a fan each on the plane at mid height."""
    _, vertices = part_mesh(spark, sf_dir)
    level = spark.createDataFrame([(0, 0.0, 0.0, 1.0, -0.125, -1e6, 1e6, -1e6, 1e6, -1.0, 1.0)], "plane_id long, nx double, ny double, nz double, d double, x0 double, x1 double, y0 double, y1 double, z0 double, z1 double")
    fans, _, middles = holes.close_planar(spark.sql(PIERCED), vertices, level, off=0.2)
    sizes = fans.groupBy(F.col("a").alias("vid")).agg(F.count(F.lit(1)).alias("fan"))
    return rounded(middles.join(sizes, "vid").select("loop", "n", *XYZ, "fan"))


# ---------------------------------------------------------------- cones

_OFF = "2e-3 * (((o_orderkey * 1299709 + 3) % 999961) / 999961e0 + ((o_orderkey * 224737 + 5) % 999959) / 999959e0 - 1)"
#: A hopper of 20 degrees that hangs from its apex and a level cone of 30 degrees, 2 mm of noise, with their normals.
CONES = f"""
SELECT pid, part, CASE WHEN part = 0 THEN q * cos(t) ELSE 5 + l END AS x, CASE WHEN part = 0 THEN q * sin(t) ELSE 5 + q * cos(t) END AS y, CASE WHEN part = 0 THEN 3 - l ELSE q * sin(t) END AS z,
       CASE WHEN part = 0 THEN cs * cos(t) ELSE -sn END AS nx, CASE WHEN part = 0 THEN cs * sin(t) ELSE cs * cos(t) END AS ny, CASE WHEN part = 0 THEN sn ELSE cs * sin(t) END AS nz, h, e
FROM (SELECT *, h * sn / cs + e * cs AS q, h - e * sn AS l FROM (
  SELECT o_orderkey AS pid, (o_orderkey * 31) % 3 % 2 AS part, sin(radians(CASE WHEN (o_orderkey * 31) % 3 % 2 = 0 THEN 20e0 ELSE 30e0 END)) AS sn, cos(radians(CASE WHEN (o_orderkey * 31) % 3 % 2 = 0 THEN 20e0 ELSE 30e0 END)) AS cs,
         {_OFF} AS e, 6.283185307179586 * (((o_orderkey * 7919 + 13) % 999983) / 999983e0) AS t, 1 + 2 * (((o_orderkey * 104729 + 7) % 999979) / 999979e0) AS h FROM orders) q0) q1"""


@query(f"""
SELECT CASE WHEN part = 0 THEN 'z' ELSE 'x' END AS axis, round(CASE WHEN part = 0 THEN 20e0 ELSE 30e0 END, 1) AS half_deg, count(*) AS n, round(sqrt(avg(e * e)), 4) AS rms,
       round(min(h) * tan(radians(CASE WHEN part = 0 THEN 20e0 ELSE 30e0 END)), 2) AS r_min, round(max(h) * tan(radians(CASE WHEN part = 0 THEN 20e0 ELSE 30e0 END)), 2) AS r_max FROM ({CONES}) c GROUP BY part""")
def cone_search(spark, sf_dir):
    """Two cones found from points and normals: axis, half angle, how many points, their rms, and the radii at the ends."""
    p = saved(view(spark, sf_dir, CONES, "orders"), "cones")
    found, _ = parts.detect_cones(p, 0.02, min_inliers=p.count() // 5, radius=0.5)
    axis = F.when(F.abs("ax") > 0.999, "x").when(F.abs("az") > 0.999, "z").otherwise("none")
    return found.select(axis.alias("axis"), F.round("half_deg", 1).alias("half_deg"), "n", F.round("rms", 4).alias("rms"), F.round("r_min", 2).alias("r_min"), F.round("r_max", 2).alias("r_max"))


# ---------------------------------------------------------------- bridges

_TREMBLE = {k: f"1e-2 * (2 * (((l_orderkey * {a} + l_linenumber * {b} + l_partkey) % 9973) / 9973e0) - 1)" for k, a, b in (("ex", 1299709, 31), ("ey", 224737, 57), ("ez", 350377, 91))}
#: Two square pylons of 1.2 m, 20 m high, and four cables that run down from them; a centimetre of noise.
BRIDGE = f"""
SELECT pid, part, CASE WHEN part < 2 THEN x0 + CASE w WHEN 0 THEN 6e-1 WHEN 1 THEN -6e-1 ELSE 12e-1 * s - 6e-1 END ELSE x0 + way * (2 + 16 * s) END + ex AS x,
       CASE WHEN part < 2 THEN CASE w WHEN 2 THEN 6e-1 WHEN 3 THEN -6e-1 ELSE 12e-1 * s - 6e-1 END ELSE 0e0 END + ey AS y, CASE WHEN part < 2 THEN 20 * t ELSE 18 - 16 * s END + ez AS z, s
FROM (SELECT *, CASE WHEN part % 2 = 0 THEN -20e0 ELSE 20e0 END AS x0, CASE WHEN part < 4 THEN -1 ELSE 1 END AS way FROM (
  SELECT l_orderkey * 8 + l_linenumber AS pid, (l_orderkey * 31 + l_linenumber * 7) % 6 AS part, (l_partkey * 13 + l_orderkey) % 4 AS w,
         ((l_orderkey * 7919 + l_linenumber * 613 + l_suppkey) % 99991) / 99991e0 AS s, ((l_partkey * 104729 + l_orderkey * 17) % 99989) / 99989e0 AS t,
         {', '.join(f'{v} AS {k}' for k, v in _TREMBLE.items())} FROM lineitem) q0) q1"""
CELL = 0.5


@query(f"""
WITH p AS (SELECT *, floor(x / 5e-1) AS i, floor(y / 5e-1) AS j FROM ({BRIDGE}) b WHERE part < 2)
SELECT round((min(i) + max(i) + 1) / 2 * 5e-1, 6) AS x, round((min(j) + max(j) + 1) / 2 * 5e-1, 6) + 0e0 AS y, (max(i) - min(i) + 1) * 5e-1 AS width_x, (max(j) - min(j) + 1) * 5e-1 AS width_y,
       {r6('min(z) AS z0', 'max(z) AS z1')}, count(DISTINCT (i, j)) AS cells FROM p GROUP BY part""")
def bridge_pylons(spark, sf_dir):
    """Pylons of the scene, found without labels among its cables."""
    found, _ = bridges.pylons(view(spark, sf_dir, BRIDGE, "lineitem"), CELL, 15.0)
    return rounded(found.drop("pylon"))


@query(f"""
WITH p AS (SELECT part, sqrt(2) * 16 * s AS t, x, z FROM ({BRIDGE}) b WHERE part >= 2)
SELECT round(quantile_cont(t, 99e-2) - quantile_cont(t, 1e-2), 1) AS length, 45e0 AS inclination_deg, count(*) AS n,
       round(CASE WHEN part % 2 = 0 THEN -20e0 ELSE 20e0 END + CASE WHEN part < 4 THEN -10e0 ELSE 10e0 END, 0) + 0e0 AS middle FROM p GROUP BY part""")
def bridge_cables(spark, sf_dir):
    """Cables of the scene: length, inclination, how many points, and over which place of the deck their middle is."""
    p = saved(view(spark, sf_dir, BRIDGE, "lineitem").select("pid", *XYZ), "bridge")
    _, cells = bridges.pylons(p, CELL, 15.0)
    found = bridges.cables(bridges.beside(p, cells, CELL), 0.3, 5.0, 0.5, 2.0)
    middle = F.round((F.col("sx") + F.col("ex")) / 2, 0) + F.lit(0.0)
    return found.select(F.round("length", 1).alias("length"), F.round("inclination_deg", 0).alias("inclination_deg"), "n", middle.alias("middle"))


# ---------------------------------------------------------------- long tracks

DAY = 86_400_000_000


@query(f"""
WITH e AS ({TRACK_SQL}), k AS (SELECT t, avg(v) AS v FROM e GROUP BY 1), q AS (SELECT DISTINCT t + 3600000000 AS t FROM k),
a AS (SELECT q.t, k.t AS t0, k.v AS v0 FROM q ASOF LEFT JOIN k ON q.t >= k.t), b AS (SELECT a.*, k.t AS t1, k.v AS v1 FROM a ASOF LEFT JOIN k ON a.t <= k.t)
SELECT t, round(CASE WHEN v1 IS NULL THEN v0 WHEN v0 IS NULL THEN v1 WHEN t1 > t0 THEN v0 + (v1 - v0) * ((t - t0)::DOUBLE / (t1 - t0)) ELSE v0 END, 6) AS v FROM b""")
def long_track(spark, sf_dir):
    """All events as one track, asked an hour after each: cut by day."""
    track = view(spark, sf_dir, TRACK, "events").groupBy("t").agg(F.avg("v").alias("v"))
    return rounded(paths.between(track, track.select((F.col("t") + 3_600_000_000).alias("t")).distinct(), ["v"], DAY))


@query(f"""
WITH k AS (SELECT t, v FROM ({TRACK_SQL}) e), s AS (SELECT t, v, coalesce(abs(v - lag(v) OVER (ORDER BY t, v)), 0) AS d FROM k)
SELECT t, round(v, 6) AS v, round(sum(d) OVER (ORDER BY t, v ROWS UNBOUNDED PRECEDING), 4) AS s FROM s""")
def long_track_lengths(spark, sf_dir):
    """Running length along all events as one track."""
    out = paths.lengths(view(spark, sf_dir, TRACK, "events").select("t", "v"), ["v"], DAY)
    return out.select("t", F.round("v", 6).alias("v"), F.round("s", 4).alias("s"))


#: A walk over orders, and photos taken along it in a frame of their own, turned by 90 degrees, half as large and 150 off, their clock 5,000 behind.
WALK = """
SELECT CAST(o_orderkey AS DOUBLE) AS t, 40 * cos(o_orderkey / 9e3) + o_orderkey / 1e3 AS x, 25 * sin(o_orderkey / 7e3) AS y, 2 + sin(o_orderkey / 4e3) AS z FROM orders"""
PHOTOS = f"SELECT t - 5000 AS t, 150 + y / 2 AS x, -x / 2 AS y, z / 2 AS z FROM ({WALK}) w WHERE CAST(t AS BIGINT) % 97 = 0 OR t = (SELECT min(o_orderkey) FROM orders)"


@query(f"SELECT 'time from start, scaled' AS label, TRUE AS applied, count(*)::BIGINT AS photos, 2e0 AS scale, round(max(t) - min(t), 3) AS span FROM ({PHOTOS}) p")
def matched_walk(spark, sf_dir):
    """The pairing of photos and walk that fits, of eight tried, with its scale."""
    walk = saved(view(spark, sf_dir, WALK, "orders"), "walk")
    photos = saved(spark.sql(PHOTOS), "photos")
    found = paths.match(photos, walk, 5_000.0)
    facts = photos.agg(F.count(F.lit(1)).alias("photos"), F.round(F.max("t") - F.min("t"), 3).alias("span"))
    return facts.select(F.lit(found.label).alias("label"), F.lit(bool(found.applied)).alias("applied"), "photos", F.round(F.lit(found.scale), 6).alias("scale"), "span")


# ---------------------------------------------------------------- textures

_NB = "nb AS MATERIALIZED (SELECT x.fid, y.fid AS other FROM e x JOIN e y ON x.u = y.u AND x.v = y.v AND x.fid <> y.fid)"


def _smooth_sql(k: int) -> str:
    return f"""n{k} AS MATERIALIZED (SELECT fid, CASE WHEN s > 1e-12 THEN sx / s ELSE nx END AS nx, CASE WHEN s > 1e-12 THEN sy / s ELSE ny END AS ny, CASE WHEN s > 1e-12 THEN sz / s ELSE nz END AS nz FROM (
  SELECT *, sqrt(sx*sx + sy*sy + sz*sz) AS s FROM (SELECT n.fid, n.nx, n.ny, n.nz, n.nx + coalesce(sum(o.nx), 0) AS sx, n.ny + coalesce(sum(o.ny), 0) AS sy, n.nz + coalesce(sum(o.nz), 0) AS sz
  FROM n{k - 1} n LEFT JOIN nb USING (fid) LEFT JOIN n{k - 1} o ON o.fid = nb.other GROUP BY n.fid, n.nx, n.ny, n.nz) q0) q1)"""


def _join_sql(k: int) -> str:
    """One round: charts, their sizes and borders, and which chart each small one joins."""
    return f"""z{k} AS MATERIALIZED (SELECT chart, bin, count(*) AS n FROM o{k - 1} GROUP BY ALL),
g{k} AS MATERIALIZED (SELECT p.chart AS a, q.chart AS b, count(*) AS edges FROM nb JOIN o{k - 1} p ON p.fid = nb.fid JOIN o{k - 1} q ON q.fid = nb.other WHERE p.chart <> q.chart GROUP BY ALL),
j{k} AS MATERIALIZED (SELECT g.a, g.b, t.bin FROM g{k} g JOIN z{k} s ON s.chart = g.a JOIN z{k} t ON t.chart = g.b WHERE s.n < 24 AND t.n >= 24
  QUALIFY row_number() OVER (PARTITION BY g.a ORDER BY g.edges DESC, g.b) = 1),
o{k} AS MATERIALIZED (SELECT o.fid, coalesce(j.b, o.chart) AS chart, coalesce(j.bin, o.bin) AS bin FROM o{k - 1} o LEFT JOIN j{k} j ON j.a = o.chart)"""


CHARTS_SQL = f"""v AS ({SPIKES}), f AS ({FACES}),
e AS MATERIALIZED (SELECT fid, least(a, b) AS u, greatest(a, b) AS v FROM f UNION ALL SELECT fid, least(b, c), greatest(b, c) FROM f UNION ALL SELECT fid, least(c, a), greatest(c, a) FROM f), {_NB},
tri AS (SELECT fid, p.x ax, p.y ay, p.z az, q.x bx, q.y by_, q.z bz, r.x cx, r.y cy, r.z cz FROM f JOIN v p ON p.vid = f.a JOIN v q ON q.vid = f.b JOIN v r ON r.vid = f.c),
w AS (SELECT *, (by_-ay)*(cz-az) - (bz-az)*(cy-ay) AS wx, (bz-az)*(cx-ax) - (bx-ax)*(cz-az) AS wy, (bx-ax)*(cy-ay) - (by_-ay)*(cx-ax) AS wz FROM tri),
n0 AS MATERIALIZED (SELECT fid, wx/sqrt(wx*wx+wy*wy+wz*wz) AS nx, wy/sqrt(wx*wx+wy*wy+wz*wz) AS ny, wz/sqrt(wx*wx+wy*wy+wz*wz) AS nz FROM w), {', '.join(_smooth_sql(k) for k in (1, 2, 3))},
ab AS (SELECT fid, nx, ny, nz, round(abs(nx), 9) AS x, round(abs(ny), 9) AS y, round(abs(nz), 9) AS z FROM n3),
bn AS MATERIALIZED (SELECT fid, (CASE WHEN x >= y AND x >= z THEN 0 + (round(nx, 9) < 0)::INT WHEN y >= z THEN 2 + (round(ny, 9) < 0)::INT ELSE 4 + (round(nz, 9) < 0)::INT END)::INTEGER AS bin FROM ab),
ed AS MATERIALIZED (SELECT nb.fid AS a, nb.other AS b FROM nb JOIN bn p ON p.fid = nb.fid JOIN bn q ON q.fid = nb.other WHERE p.bin = q.bin),
c(node, root, step) USING KEY (node) AS (SELECT fid, fid, 0 FROM bn UNION
   SELECT ed.b, min(c.root), max(c.step) + 1 FROM c JOIN ed ON ed.a = c.node JOIN recurring.c t ON t.node = ed.b WHERE c.root < t.root GROUP BY ed.b),
o0 AS MATERIALIZED (SELECT fid, root AS chart, bin FROM bn JOIN c ON c.node = bn.fid), {', '.join(_join_sql(k) for k in (1, 2, 3, 4))}"""


def _charts(spark, sf_dir):
    faces, _ = part_mesh(spark, sf_dir)
    vertices = view(spark, sf_dir, SPIKES, "part")
    return faces, vertices, textures.charts(faces, vertices)


@query(f"WITH RECURSIVE {CHARTS_SQL} SELECT fid, chart, bin FROM o4")
def mesh_charts(spark, sf_dir):
    """Charts of the spiky mesh after four rounds of joining small ones."""
    return _charts(spark, sf_dir)[2].select("fid", "chart", "bin")


PAGES_SQL = """
t AS (SELECT o4.chart, o4.bin, p.* FROM o4 JOIN f USING (fid) JOIN v p ON p.vid IN (f.a, f.b, f.c)),
x AS (SELECT chart, max(uu) - min(uu) AS width, max(vv) - min(vv) AS height FROM (SELECT chart, CASE WHEN bin < 2 THEN y ELSE x END AS uu, CASE WHEN bin >= 4 THEN y ELSE z END AS vv FROM t) q GROUP BY chart),
s AS (SELECT chart, least(greatest(ceil(width / 2e-2) + 1, 1), 504)::BIGINT AS w, least(greatest(ceil(height / 2e-2) + 1, 1), 504)::BIGINT AS h FROM x),
k AS (SELECT *, w + 8 AS cw, h + 8 AS ch, len(bin(h + 7)) AS cl FROM s),
m AS (SELECT *, greatest(1, 512 - max(cw) OVER (PARTITION BY cl)) AS room, sum(cw) OVER (PARTITION BY cl ORDER BY chart) - cw AS before FROM k),
l AS MATERIALIZED (SELECT *, before // room AS shelf, before % room AS px FROM m),
h AS (SELECT cl, shelf, max(ch) AS sh FROM l GROUP BY 1, 2),
r AS (SELECT *, greatest(1, 512 - max(sh) OVER ()) AS room, sum(sh) OVER (ORDER BY cl DESC, shelf) - sh AS upto FROM h)"""


@query(f"""
WITH RECURSIVE {CHARTS_SQL}, {PAGES_SQL}
SELECT chart, (upto // r.room)::BIGINT AS page, (px + 4)::BIGINT AS px, (upto % r.room + 4)::BIGINT AS py, w, l.h FROM l JOIN r USING (cl, shelf)""")
def chart_pages(spark, sf_dir):
    """Places of the charts on pages of 512 texels."""
    faces, vertices, owner = _charts(spark, sf_dir)
    placed = textures.packed(textures.chart_places(saved(owner, "owner"), faces, vertices), 0.02, 512)
    return placed.select("chart", F.col("page").cast("long").alias("page"), F.col("px").cast("long").alias("px"), F.col("py").cast("long").alias("py"), "w", "h")


FLAT = f"""SELECT fid, p.x * 10 AS au, p.y * 10 AS av, q.x * 10 AS bu, q.y * 10 AS bv, r.x * 10 AS cu, r.y * 10 AS cv
FROM ({FACES}) f JOIN ({VERTICES}) p ON p.vid = f.a JOIN ({VERTICES}) q ON q.vid = f.b JOIN ({VERTICES}) r ON r.vid = f.c"""


@query(f"""
WITH t AS ({FLAT}), g AS (SELECT t.*, ix, iy FROM t, LATERAL unnest(range(least(greatest(floor(least(au, bu, cu)), 0), 199)::BIGINT, least(greatest(ceil(greatest(au, bu, cu)), 0), 199)::BIGINT + 1)) i(ix),
  LATERAL unnest(range(least(greatest(floor(least(av, bv, cv)), 0), 299)::BIGINT, least(greatest(ceil(greatest(av, bv, cv)), 0), 299)::BIGINT + 1)) j(iy)),
d AS (SELECT *, (bu-au)*(cv-av) - (bv-av)*(cu-au) AS den, (ix + 5e-1 - au) AS du, (iy + 5e-1 - av) AS dv FROM g),
b AS (SELECT fid, ix, iy, (du*(cv-av) - dv*(cu-au)) / den AS b1, ((bu-au)*dv - (bv-av)*du) / den AS b2 FROM d WHERE abs(den) > 1e-12),
c AS (SELECT fid, ix, iy, least(greatest(1 - b1 - b2, 0), 1) AS c0, least(greatest(b1, 0), 1) AS c1, least(greatest(b2, 0), 1) AS c2 FROM b WHERE b1 >= -0.35 AND b2 >= -0.35 AND 1 - b1 - b2 >= -0.35)
SELECT fid, count(*) AS texels, round(sum(c1 / (c0 + c1 + c2)), 6) AS b1, round(sum(c2 / (c0 + c1 + c2)), 6) AS b2 FROM c GROUP BY fid""")
def face_texels(spark, sf_dir):
    """Texels of every face of the part mesh seen from above, ten to a unit, and the sums of their weights."""
    part_mesh(spark, sf_dir)
    rows = textures.face_texels(spark.sql(FLAT), 200, 300)
    return rows.groupBy("fid").agg(F.count(F.lit(1)).alias("texels"), F.round(F.sum("b1"), 6).alias("b1"), F.round(F.sum("b2"), 6).alias("b2"))


@query(f"""
WITH p AS ({O}), s AS (SELECT * FROM (VALUES (0, 1e0), (1, 2e0)) s(plane_id, level)),
h AS (SELECT plane_id::BIGINT AS plane_id, floor((x - 10) / 2)::BIGINT AS ix, floor((y - 20) / 2)::BIGINT AS iy, r, g, b FROM p, s WHERE abs(z - level) < 4e-1 AND x >= 10 AND x < 90 AND y >= 20 AND y < 80)
SELECT plane_id, ix, iy, count(*) AS n, round(avg(r), 6) AS r, round(avg(g), 6) AS g, round(avg(b), 6) AS b FROM h GROUP BY 1, 2, 3""")
def cloud_texels(spark, sf_dir):
    """Mean colours of the cloud over orders on two level surfaces."""
    level = [(k, 0.0, 0.0, float(k + 1), 1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 10.0, 20.0, 90.0, 80.0) for k in range(2)]
    names = "plane_id long, " + ", ".join(f"{p}{c} double" for p in "ouv" for c in XYZ) + ", u0 double, v0 double, u1 double, v1 double"
    return rounded(textures.cloud_texels(orders_cloud(spark, sf_dir), spark.createDataFrame(level, names), 2.0, 0.4))


#: Colours of parts of orders as photos and as a scan saw them, by clerk's customer.
SHADES = """
SELECT o_custkey % 40 AS cam_id, (o_orderkey * 37) % 200 + 20 AS r, (o_orderkey * 91) % 200 + 20 AS g, (o_orderkey * 53) % 200 + 20 AS b,
       ((o_orderkey * 37) % 200 + 20) * (7e-1 + (o_custkey % 40) / 6e1) AS pr, ((o_orderkey * 91) % 200 + 20) * (13e-1 - (o_custkey % 40) / 8e1) AS pg, ((o_orderkey * 53) % 200 + 20) * 11e-1 AS pb FROM orders"""


@query(f"""
WITH s AS ({SHADES}), m AS (SELECT cam_id, median((r + 8) / (pr + 8)) AS r, median((g + 8) / (pg + 8)) AS g, median((b + 8) / (pb + 8)) AS b FROM s GROUP BY 1 HAVING count(*) >= 40)
SELECT cam_id, {', '.join(f"round(least(greatest({c} / (SELECT median({c}) FROM m), 6e-1), 16e-1), 6) AS {c}" for c in 'rgb')} FROM m""")
def camera_gains(spark, sf_dir):
    return rounded(textures.gains(view(spark, sf_dir, SHADES, "orders")))


# ---------------------------------------------------------------- snapping, contours, panes, terrain

_LINES_SQL = f"""m AS (SELECT plane_id, {MOMENTS_SQL} FROM p GROUP BY 1), {eigen_sql('m', 'plane_id, n, mx, my, mz')},
fit AS (SELECT plane_id, nx, ny, nz, -(nx*mx + ny*my + nz*mz) AS d FROM eig),
w AS (SELECT a.plane_id AS i, b.plane_id AS j, a.ny*b.nz - a.nz*b.ny AS wx, a.nz*b.nx - a.nx*b.nz AS wy, a.nx*b.ny - a.ny*b.nx AS wz, b.d*a.nx - a.d*b.nx AS ux, b.d*a.ny - a.d*b.ny AS uy, b.d*a.nz - a.d*b.nz AS uz
      FROM fit a JOIN fit b ON a.plane_id < b.plane_id),
ln AS (SELECT i, j, wx / sqrt(l2) AS dx, wy / sqrt(l2) AS dy, wz / sqrt(l2) AS dz, (uy*wz - uz*wy) / l2 AS px, (uz*wx - ux*wz) / l2 AS py, (ux*wy - uy*wx) / l2 AS pz FROM (SELECT *, wx*wx + wy*wy + wz*wz AS l2 FROM w) q WHERE l2 >= 1e-2)"""


@query(f"""
WITH p AS ({BOX}), {_LINES_SQL},
f AS (SELECT pid, x, y, z, i, j, px + dx * t AS fx, py + dy * t AS fy, pz + dz * t AS fz FROM (SELECT p.pid, p.x, p.y, p.z, ln.*, (p.x - px) * dx + (p.y - py) * dy + (p.z - pz) * dz AS t FROM p, ln) q),
b AS (SELECT *, (x-fx)*(x-fx) + (y-fy)*(y-fy) + (z-fz)*(z-fz) AS d2 FROM f QUALIFY row_number() OVER (PARTITION BY pid ORDER BY round((x-fx)*(x-fx) + (y-fy)*(y-fy) + (z-fz)*(z-fz), 12), i, j) = 1)
SELECT pid, {r6('CASE WHEN d2 <= 1e-2 THEN fx ELSE x END AS x', 'CASE WHEN d2 <= 1e-2 THEN fy ELSE y END AS y', 'CASE WHEN d2 <= 1e-2 THEN fz ELSE z END AS z')}, d2 <= 1e-2 AS snapped FROM b""")
def line_snap(spark, sf_dir):
    """Points of the room within 10 cm of an edge moved onto it."""
    p = box(spark, sf_dir)
    lines = planes.intersection_lines(planes.fit_planes(p), 0.1)
    return rounded(planes.snap_to_lines(p, saved(lines, "lines"), 0.1))


#: Level and steep surfaces over nation, in boxes of their own.
SURFACES = """
SELECT CAST(n_nationkey AS BIGINT) AS plane_id, CASE WHEN n_nationkey % 2 = 0 THEN 0e0 ELSE 6e-1 END AS nx, 0e0 AS ny, CASE WHEN n_nationkey % 2 = 0 THEN 1e0 ELSE 8e-1 END AS nz,
       -(n_nationkey % 7) * 4e-1 AS d, -1e0 AS x0, 21e0 AS x1, CAST(n_nationkey % 5 * 4 AS DOUBLE) AS y0, n_nationkey % 5 * 4 + 6e0 AS y1, -1e0 AS z0, 6e0 AS z1 FROM nation"""


@query(f"""
WITH v AS ({SPIKES}), s AS ({SURFACES}),
o AS (SELECT v.*, s.plane_id, s.nx AS sx, s.ny AS sy, s.nz AS sz, s.d, row_number() OVER (PARTITION BY vid ORDER BY plane_id) AS k FROM v JOIN s ON abs(x * nx + y * ny + z * nz + d) < 168e-3 AND x BETWEEN x0 - 42e-2 AND x1 + 42e-2 AND y BETWEEN y0 - 42e-2 AND y1 + 42e-2 AND z BETWEEN z0 - 42e-2 AND z1 + 42e-2),
t AS (SELECT v.vid, v.x, v.y, v.z, a.sx AS ax, a.sy AS ay, a.sz AS az, v.x*a.sx + v.y*a.sy + v.z*a.sz + a.d AS ea, b.sx AS bx, b.sy AS by_, b.sz AS bz, v.x*b.sx + v.y*b.sy + v.z*b.sz + b.d AS eb
      FROM v LEFT JOIN o a ON a.vid = v.vid AND a.k = 1 LEFT JOIN o b ON b.vid = v.vid AND b.k = 2),
c AS (SELECT *, ax*bx + ay*by_ + az*bz AS c FROM t),
e AS (SELECT *, eb IS NOT NULL AND abs(c) < 95e-2 AS two, coalesce(abs(az) >= cos(radians(32)), FALSE) AS one, (ea - c*eb) / (1 - c*c) AS p, (eb - c*ea) / (1 - c*c) AS q FROM c)
SELECT vid, {r6(*[f'CASE WHEN two THEN {k} - p * a{k} - q * {b} WHEN ea IS NOT NULL AND one THEN {k} - ea * a{k} ELSE {k} END AS {k}' for k, b in zip('xyz', ('bx', 'by_', 'bz'), strict=True)])},
       coalesce(two OR (ea IS NOT NULL AND one), FALSE) AS snapped FROM e""")
def contoured_mesh(spark, sf_dir):
    """Vertices of the spiky mesh, all facing up, drawn onto the surfaces they are near, or onto the line of two."""
    vertices = view(spark, sf_dir, SPIKES, "part")
    up = vertices.select("vid", F.lit(0.0).alias("nx"), F.lit(0.0).alias("ny"), F.lit(1.0).alias("nz"))
    return rounded(repair.snapped_to_planes(vertices, up, view(spark, sf_dir, SURFACES, "nation"), 0.21))


#: Level rods over nation.
RODS = """
SELECT CAST(n_nationkey AS BIGINT) AS cyl_id, 10e0 AS px, n_nationkey * 9e-1 AS py, 2e0 + n_nationkey % 3 AS pz, 1e0 AS ax, 0e0 AS ay, 0e0 AS az, 5e-1 AS radius, 14e0 AS length FROM nation"""


@query(f"""
WITH v AS ({SPIKES}), k AS ({RODS}),
o AS (SELECT v.vid, cyl_id, x AS mx, py + (y - py) * radius / far AS my, pz + (z - pz) * radius / far AS mz, row_number() OVER (PARTITION BY v.vid ORDER BY cyl_id) AS r
      FROM (SELECT v.*, k.*, sqrt((y - py)*(y - py) + (z - pz)*(z - pz)) AS far FROM v, k) v WHERE abs(x - px) <= length / 2 AND abs(far - radius) < 16e-2 AND far > 1e-9)
SELECT vid, {r6('coalesce(mx, x) AS x', 'coalesce(my, y) AS y', 'coalesce(mz, z) AS z')} FROM v LEFT JOIN (SELECT * FROM o WHERE r = 1) o USING (vid)""")
def rounded_mesh(spark, sf_dir):
    """Vertices of the spiky mesh near a rod drawn onto it."""
    return rounded(repair.snapped_to_cylinders(view(spark, sf_dir, SPIKES, "part"), view(spark, sf_dir, RODS, "nation"), 0.2))


#: A deck of 100 by 10 m at height 20, three piers and two abutments below it; a centimetre of noise.
SPANS = f"""
SELECT pid, CASE WHEN part < 4 THEN 0 ELSE part END AS part, CASE WHEN part < 4 THEN 100 * s - 50 WHEN part < 7 THEN (part - 5) * 25 + CASE w WHEN 0 THEN 75e-2 WHEN 1 THEN -75e-2 ELSE 15e-1 * s - 75e-2 END
         ELSE CASE part WHEN 7 THEN -48e0 ELSE 48e0 END + CASE w WHEN 0 THEN 5e-1 WHEN 1 THEN -5e-1 ELSE s - 5e-1 END END + ex AS x,
       CASE WHEN part < 4 THEN 10 * t - 5 WHEN part < 7 THEN CASE w WHEN 2 THEN 2e0 WHEN 3 THEN -2e0 ELSE 4 * s - 2 END ELSE CASE w WHEN 2 THEN 4e0 WHEN 3 THEN -4e0 ELSE 8 * s - 4 END END + ey AS y,
       CASE WHEN part < 4 THEN 20e0 WHEN part < 7 THEN 17 * t ELSE 5 + 12 * t END + ez AS z
FROM (SELECT l_orderkey * 8 + l_linenumber AS pid, (l_orderkey * 31 + l_linenumber * 7) % 9 AS part, (l_partkey * 13 + l_orderkey) % 4 AS w,
         ((l_orderkey * 7919 + l_linenumber * 613 + l_suppkey) % 99991) / 99991e0 AS s, ((l_partkey * 104729 + l_orderkey * 17) % 99989) / 99989e0 AS t,
         {', '.join(f'{v} AS {k}' for k, v in _TREMBLE.items())} FROM lineitem) q"""


@query(f"""
WITH p AS ({SPANS}), d AS (SELECT avg(x) AS cx, quantile_cont(x, 995e-3) - quantile_cont(x, 5e-3) AS length FROM p WHERE part = 0),
f AS (SELECT part, count(*) AS n, avg(x) - cx AS station, max(z) - min(z) AS height, sqrt(power(max(x) - min(x), 2) + power(max(y) - min(y), 2)) AS footprint, max(z) AS top FROM p, d WHERE part > 0 GROUP BY part, cx),
b AS (SELECT part, avg(z) AS bearing FROM p JOIN f USING (part) WHERE z > top - 1 GROUP BY part)
SELECT CASE WHEN part < 7 THEN 'pier' ELSE 'abutment' END AS kind, round(station, 1) + 0e0 AS station, round(height, 3) AS height, round(footprint, 3) AS footprint, round(bearing, 3) AS bearing, round(length, 1) AS deck FROM f JOIN b USING (part), d""")
def bridge_supports(spark, sf_dir):
    """Piers and abutments below the deck that is found among the scene's planes."""
    p = saved(view(spark, sf_dir, SPANS, "lineitem"), "spans")
    found = bridges.deck(p.where("part = 0").withColumn("plane_id", F.lit(0).cast("long")).unionByName(p.where("part > 3").withColumn("plane_id", F.col("part").cast("long"))))
    rows = bridges.substructure(p, found, 0.25)
    return rows.select(
        "kind", (F.round("station", 1) + F.lit(0.0)).alias("station"), F.round("height", 3).alias("height"), F.round("footprint", 3).alias("footprint"),
        F.round("bearing_z", 3).alias("bearing"), F.round(F.lit(float(found.length)), 1).alias("deck"),
    )


#: A gabled roof over each region: two faces with their outlines.
ROOFS = """
SELECT CAST(r_regionkey * 2 + h AS BIGINT) AS plane_id, 10e0 + r_regionkey AS area, array(named_struct('x', 0e0, 'y', 0e0, 'z', 3e0 + r_regionkey / 4e0), named_struct('x', 5e0, 'y', 0e0, 'z', 3e0 + r_regionkey / 4e0),
       named_struct('x', 5e0, 'y', 4e0, 'z', 5e0 + r_regionkey / 3e0), named_struct('x', 0e0, 'y', 4e0, 'z', 5e0 + r_regionkey / 3e0)) AS outline FROM region CROSS JOIN (SELECT 0 AS h UNION ALL SELECT 1) t"""


@query("SELECT round(max(5e0 + r_regionkey / 3e0), 6) AS ridge, round(min(3e0 + r_regionkey / 4e0), 6) AS eaves, sum(2 * (10e0 + r_regionkey)) AS area, 2 * count(*) AS n FROM region")
def roof_totals(spark, sf_dir):
    """Ridge, eaves and area of the roofs of all regions."""
    return rounded(planes.roof_summary(view(spark, sf_dir, ROOFS, "region")))


@query(f"SELECT round(max(x) - min(x), 6) AS size_x, round(max(y) - min(y), 6) AS size_y, round(max(z) - min(z), 6) AS height FROM ({SPIKES}) v")
def model_footprint(spark, sf_dir):
    return rounded(planes.footprint(view(spark, sf_dir, SPIKES, "part")))
