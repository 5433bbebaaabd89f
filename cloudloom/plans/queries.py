"""Registered queries of the scan operators, each with SQL that gives the same rows.

Inputs are clouds, scenes and meshes laid over the star-schema tables by integer
arithmetic that every engine agrees on; the whole table is always used.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloudloom.functions.catalogs import sections, stock
from cloudloom.functions.linalg import MOMENTS_SQL, eigen_sql, moments, with_eigen
from cloudloom.operators import fitting, graph, mesh, planes, points, scene, series
from cloudloom.plans.scratch import saved

# ---------------------------------------------------------------- inputs, in SQL both engines read

#: A volume of points over orders, with colour and intensity.
ORDERS = """
SELECT o_orderkey AS pid, ((o_orderkey * 7919 + 13) % 10007) / 1e2 AS x, ((o_custkey * 104729 + o_orderkey * 31) % 10009) / 1e2 AS y,
       ((o_orderkey * 15485863 + 7) % 3001) / 1e3 AS z, CAST((o_orderkey * 37) % 256 AS INT) AS r, CAST((o_orderkey * 91) % 256 AS INT) AS g,
       CAST((o_custkey * 53) % 256 AS INT) AS b, o_totalprice AS intensity FROM orders"""

#: The first three components of the embeddings.
EMBEDDED = "SELECT vec_id AS pid, CAST(embedding[{0}] AS DOUBLE) AS x, CAST(embedding[{1}] AS DOUBLE) AS y, CAST(embedding[{2}] AS DOUBLE) AS z, label FROM embeddings"

#: The six faces of a 4 x 3 x 2.5 m room with 4 mm noise, points shared out by area.
BOX = """
SELECT k AS pid, CASE WHEN f < 1200 THEN 1 WHEN f < 2400 THEN 2 WHEN f < 3400 THEN 3 WHEN f < 4400 THEN 4 WHEN f < 5150 THEN 5 ELSE 6 END AS plane_id,
       CASE WHEN f < 4400 THEN 4 * u WHEN f < 5150 THEN e ELSE 4 + e END AS x,
       CASE WHEN f < 2400 THEN 3 * v WHEN f < 3400 THEN e WHEN f < 4400 THEN 3 + e ELSE 3 * u END AS y,
       CASE WHEN f < 1200 THEN e WHEN f < 2400 THEN 25e-1 + e ELSE 25e-1 * v END AS z
FROM (SELECT o_orderkey AS k, (o_orderkey * 15485863 + 11) % 5900 AS f, ((o_orderkey * 7919 + 13) % 999983) / 999983e0 AS u,
             ((o_orderkey * 104729 + 7) % 999979) / 999979e0 AS v,
             8e-3 * (((o_orderkey * 1299709 + 3) % 999961) / 999961e0 + ((o_orderkey * 224737 + 5) % 999959) / 999959e0
                     + ((o_orderkey * 350377 + 1) % 999953) / 999953e0 - 15e-1) AS e FROM orders) q"""

#: A terrain-like grid mesh over part, 40 vertices a row.
VERTICES = """
SELECT p_partkey AS vid, ((p_partkey - 1) % 40) * 5e-1 AS x, CAST(floor((p_partkey - 1) / 40) AS DOUBLE) * 5e-1 AS y, ((p_partkey * 7919) % 1000) / 4e3 AS z FROM part"""
FACES = """
SELECT p.k * 2 + h AS fid, CASE WHEN h = 0 THEN k ELSE k + 1 END AS a, CASE WHEN h = 0 THEN k + 1 ELSE k + 41 END AS b, k + 40 AS c, CAST((k * 13) % 3 AS INT) AS group_id
FROM (SELECT p.p_partkey AS k FROM part p JOIN part q ON q.p_partkey = p.p_partkey + 41 WHERE (p.p_partkey - 1) % 40 < 39) p
     CROSS JOIN (SELECT 0 AS h UNION ALL SELECT 1) t"""

#: Small planes of a model over nation: unit-free normals made unit.
PLANES = """
SELECT plane_id, a / s AS nx, b / s AS ny, c / s AS nz, ((plane_id * 37) % 11) / 1e1 - 5e-1 AS d, CAST(((plane_id * 29) % 13) / 4e0 AS DOUBLE) AS mean_z,
       CAST(1 + (plane_id * 17) % 7 AS DOUBLE) AS area, ((plane_id * 41) % 9) / 2e2 AS rms
FROM (SELECT *, sqrt(a * a + b * b + c * c) AS s FROM (
      SELECT CAST(n_nationkey AS BIGINT) AS plane_id, CAST(n_nationkey % 3 - 1 AS DOUBLE) AS a, CAST(floor(n_nationkey / 3) % 3 - 1 AS DOUBLE) AS b,
             CAST(CASE WHEN n_nationkey % 9 = 4 THEN 1 ELSE floor(n_nationkey / 9) % 3 END AS DOUBLE) AS c FROM nation) q0) q1"""


def view(spark: SparkSession, sf_dir: str, sql: str, *names: str) -> DataFrame:
    """The relation an input statement makes of the tables it reads."""
    for n in names:
        spark.read.parquet(f"{sf_dir}/{n}.parquet").createOrReplaceTempView(n)
    return spark.sql(sql)


def orders_cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, ORDERS, "orders")


def embedded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, EMBEDDED.format(0, 1, 2), "embeddings")


def box(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, BOX, "orders")


def part_mesh(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    v = view(spark, sf_dir, VERTICES, "part")
    return spark.sql(FACES), v


def nation_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, PLANES, "nation")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so engines that sum in another order agree; minus zero becomes zero."""
    return df.select(*[(F.round(c, digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


O = ORDERS.strip()  # noqa: E741
E_SQL = EMBEDDED.format(1, 2, 3)
B = BOX.strip()
TRI = f"""v AS ({VERTICES}), f AS ({FACES}),
tri AS (SELECT f.*, p.x ax, p.y ay, p.z az, q.x bx, q.y by_, q.z bz, r.x cx, r.y cy, r.z cz FROM f JOIN v p ON p.vid = f.a JOIN v q ON q.vid = f.b JOIN v r ON r.vid = f.c),
w AS (SELECT *, (by_-ay)*(cz-az) - (bz-az)*(cy-ay) AS wx, (bz-az)*(cx-ax) - (bx-ax)*(cz-az) AS wy, (bx-ax)*(cy-ay) - (by_-ay)*(cx-ax) AS wz FROM tri),
nrm AS (SELECT *, sqrt(wx*wx + wy*wy + wz*wz) AS len FROM w)"""
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def r6(*names: str) -> str:
    """Rounded columns as SQL; adding zero turns minus zero into zero."""
    return ", ".join(f"round({n.split(' AS ')[0]}, 6) + 0e0 AS {n.split(' AS ')[-1]}" for n in names)


# ---------------------------------------------------------------- points


@query(f"SELECT count(*)::BIGINT AS n, {r6('min(x) AS x_min', 'max(x) AS x_max', 'avg(x) AS x_avg', 'min(y) AS y_min', 'max(y) AS y_max', 'avg(y) AS y_avg', 'min(z) AS z_min', 'max(z) AS z_max', 'avg(z) AS z_avg')} FROM ({O}) p")
def cloud_extent(spark, sf_dir):
    return rounded(points.extent(orders_cloud(spark, sf_dir)))


@query(f"""
WITH p AS ({O}), b AS (SELECT min(x) x0, min(y) y0, min(z) z0 FROM p),
k AS (SELECT pid, x, y, z, floor((x - x0) / 5) i, floor((y - y0) / 5) j, floor((z - z0) / 5) l FROM p, b),
m AS (SELECT i, j, l, avg(x) ax, avg(y) ay, avg(z) az FROM k GROUP BY 1, 2, 3),
d AS (SELECT k.*, row_number() OVER (PARTITION BY k.i, k.j, k.l ORDER BY round((x-ax)*(x-ax) + (y-ay)*(y-ay) + (z-az)*(z-az), 12), pid) AS rk
      FROM k JOIN m ON m.i = k.i AND m.j = k.j AND m.l = k.l)
SELECT pid, {r6('x', 'y', 'z')} FROM d WHERE rk = 1""")
def voxel_thin(spark, sf_dir):
    return rounded(points.voxel_downsample(orders_cloud(spark, sf_dir).select("pid", "x", "y", "z"), 5.0))


@query(f"""
WITH p AS ({O}), b AS (SELECT min(x) x0, min(y) y0, min(z) z0, sqrt((max(x)-min(x))*(max(x)-min(x)) + (max(y)-min(y))*(max(y)-min(y)) + (max(z)-min(z))*(max(z)-min(z))) AS diag FROM p),
s AS (SELECT range AS step FROM range(40)),
c AS (SELECT step, diag * 1e-3 * pow(14e-1, step) AS voxel, count(DISTINCT (floor((x - x0) / (diag * 1e-3 * pow(14e-1, step))), floor((y - y0) / (diag * 1e-3 * pow(14e-1, step))),
             floor((z - z0) / (diag * 1e-3 * pow(14e-1, step)))))::BIGINT AS cells FROM p, b, s GROUP BY 1, 2)
SELECT step::INTEGER AS step, {r6('voxel')}, cells FROM c WHERE step <= (SELECT coalesce(min(step), 40) FROM c WHERE cells <= 500)""")
def budget_thin(spark, sf_dir):
    return rounded(points.budget_voxel(orders_cloud(spark, sf_dir), 500))


#: Pairs of points of the cloud over orders up to 8 units apart, among which all nearest ones are: by rank of distance.
NEAR_SQL = f"""p AS ({O}), c AS (SELECT pid, x, y, z, floor(x / 8) AS i, floor(y / 8) AS j FROM p),
near AS MATERIALIZED (SELECT a.pid, b.pid AS nid, b.x, b.y, b.z, (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z) AS d2
  FROM (SELECT c.pid, x, y, z, i + u.di AS i, j + v.dj AS j FROM c, range(-1, 2) u(di), range(-1, 2) v(dj)) a JOIN c b USING (i, j)
  WHERE (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z) <= 64)"""


@query(f"""
WITH {NEAR_SQL}, q AS (SELECT pid, sqrt(d2) AS d FROM near WHERE pid <> nid QUALIFY row_number() OVER (PARTITION BY pid ORDER BY d2, nid) <= 8)
SELECT pid, {r6('avg(d) AS spacing')} FROM q GROUP BY pid""")
def knn_spacing(spark, sf_dir):
    return rounded(points.local_spacing(orders_cloud(spark, sf_dir), 8, 2.0))


@query(f"""
WITH p AS ({E_SQL}), q AS (SELECT a.pid, min(sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z))) AS d FROM p a JOIN p b ON a.pid <> b.pid GROUP BY 1)
SELECT {r6('coalesce(quantile_cont(d, 5e-1), 0e0) AS spacing')} FROM q""")
def point_spacing(spark, sf_dir):
    return rounded(points.median_spacing(embedded(spark, sf_dir), 0.5))


@query(f"""
WITH {NEAR_SQL}, q AS (SELECT pid, sqrt(d2) AS d FROM near WHERE pid <> nid QUALIFY row_number() OVER (PARTITION BY pid ORDER BY d2, nid) <= 16),
m AS (SELECT pid, avg(d) AS s FROM q GROUP BY pid)
SELECT pid FROM m WHERE s <= (SELECT avg(s) + 25e-1 * stddev_pop(s) FROM m)""")
def sor_filter(spark, sf_dir):
    return points.remove_statistical_outliers(orders_cloud(spark, sf_dir), 16, 2.5, 2.0).select("pid")


@query(f"""
WITH {NEAR_SQL}, q AS (SELECT * FROM near QUALIFY row_number() OVER (PARTITION BY pid ORDER BY d2, nid) <= 17),
m AS (SELECT pid, {MOMENTS_SQL} FROM q GROUP BY pid), {eigen_sql('m', 'pid')}
SELECT pid, {r6('nx', 'ny', 'nz', 'l1', 'l2', 'l3')} FROM eig""")
def pca_normals(spark, sf_dir):
    shape = points.neighbourhood_shape(orders_cloud(spark, sf_dir), 16, 2.0)
    return rounded(shape.select("pid", "nx", "ny", "nz", "l1", "l2", "l3"))


@query(f"""
WITH p AS ({E_SQL}), q AS (SELECT a.pid, b.pid AS nid, b.x, b.y, b.z, sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z)) AS d,
  row_number() OVER (PARTITION BY a.pid ORDER BY (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z), b.pid) AS rk FROM p a, p b),
m AS (SELECT pid, {MOMENTS_SQL} FROM q WHERE rk <= 13 GROUP BY pid), {eigen_sql('m', 'pid')}
SELECT pid FROM eig WHERE (l1 - l2) / l1 > 6e-1""")
def edge_artifact_points(spark, sf_dir):
    return points.edge_artifacts(embedded(spark, sf_dir), 12, 0.6, sparse_only=False, cell=0.5)


@query(f"""
WITH p AS ({E_SQL})
SELECT a.pid, b.pid AS nid, {r6('(a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z) AS d2')} FROM p a, p b
WHERE a.pid <> b.pid AND (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z) <= 25e-2 * 25e-2""")
def radius_pairs(spark, sf_dir):
    p = embedded(spark, sf_dir)
    pairs = points.radius_pairs(p, p, 0.25).where("pid <> nid")
    return pairs.select("pid", "nid", (F.floor(F.col("d2") * 1e6 + 0.5) / 1e6).alias("d2"))  # rounded as the SQL does, without a decimal for each pair


@query(f"""
WITH p AS ({O}), s AS (SELECT * FROM p WHERE pid % 4 = 0), t AS (SELECT * FROM p WHERE pid % 4 <> 0),
q AS (SELECT t.pid, s.r, s.g, s.b, row_number() OVER (PARTITION BY t.pid ORDER BY (t.x-s.x)*(t.x-s.x) + (t.y-s.y)*(t.y-s.y) + (t.z-s.z)*(t.z-s.z), s.pid) AS rk
      FROM t JOIN s ON abs(t.x - s.x) <= 1 AND (t.x-s.x)*(t.x-s.x) + (t.y-s.y)*(t.y-s.y) + (t.z-s.z)*(t.z-s.z) <= 1)
SELECT t.pid, coalesce(q.r, 128) AS r, coalesce(q.g, 128) AS g, coalesce(q.b, 128) AS b, q.pid IS NOT NULL AS hit FROM t LEFT JOIN q ON q.pid = t.pid AND q.rk = 1""")
def colour_transfer(spark, sf_dir):
    p = orders_cloud(spark, sf_dir)
    bare = p.where("pid % 4 <> 0").select("pid", "x", "y", "z")
    return points.transfer_colors(bare, p.where("pid % 4 = 0"), 1.0, 1.0).select("pid", "r", "g", "b", "hit")


@query(f"""
WITH p AS (SELECT pid, r * 257e0 AS r, g * 257e0 AS g, b * 257e0 AS b FROM ({O}) q), k AS (SELECT max(greatest(r, g, b)) AS peak FROM p),
s AS (SELECT p.*, CASE WHEN peak > 0 AND peak <= 1 THEN 255e0 WHEN peak > 255 THEN 1e0 / 257 ELSE 1e0 END AS f FROM p, k)
SELECT pid, floor(greatest(0e0, least(255e0, r * f)))::INTEGER AS r, floor(greatest(0e0, least(255e0, g * f)))::INTEGER AS g, floor(greatest(0e0, least(255e0, b * f)))::INTEGER AS b FROM s""")
def rgb_normalise(spark, sf_dir):
    p = orders_cloud(spark, sf_dir).select("pid", *[(F.col(c) * F.lit(257.0)).alias(c) for c in "rgb"])
    return points.normalize_rgb(p)


@query(f"WITH p AS ({O}), k AS (SELECT min(intensity) lo, max(intensity) hi, max(abs(intensity)) top FROM p) SELECT pid, {r6('CASE WHEN lo >= -2048 AND hi <= 0 THEN (intensity + 2048) / 2048 WHEN top > 0 THEN intensity / top ELSE intensity END AS intensity')} FROM p, k")
def intensity_normalise(spark, sf_dir):
    return rounded(points.normalize_intensity(orders_cloud(spark, sf_dir).select("pid", "intensity")))


@query(f"SELECT max(greatest(r, g, b) - least(r, g, b)) AS spread, max(greatest(r, g, b) - least(r, g, b)) <= 3 AS is_grey FROM ({O}) p")
def grey_test(spark, sf_dir):
    return points.grey(orders_cloud(spark, sf_dir))


@query(f"""
WITH p AS ({O}), a AS (SELECT pid, x, y, z FROM p UNION ALL SELECT vec_id, CAST(embedding[1] AS DOUBLE), CAST(embedding[2] AS DOUBLE), CAST(embedding[3] AS DOUBLE) FROM embeddings)
SELECT pid, {r6('6e-1 * x - 8e-1 * y + 1 AS x', '8e-1 * x + 6e-1 * y - 2 AS y', 'z + 3 AS z')} FROM a""")
def merged_and_moved(spark, sf_dir):
    both = points.merge_clouds([orders_cloud(spark, sf_dir), embedded(spark, sf_dir)])
    return rounded(points.transform(both, [0.6, -0.8, 0, 1, 0.8, 0.6, 0, -2, 0, 0, 1, 3]).select("pid", "x", "y", "z"))


@query(f"""
WITH RECURSIVE p AS ({O}), k AS (SELECT pid, floor((x - (SELECT min(x) FROM p)) / 15e-1) i, floor((y - (SELECT min(y) FROM p)) / 15e-1) j, floor((z - (SELECT min(z) FROM p)) / 15e-1) l FROM p),
c AS (SELECT DISTINCT i, j, l, (i * 4398046511104 + j * 2097152 + l)::BIGINT AS node FROM k),
e AS (SELECT a.node AS a, b.node AS b FROM c a JOIN c b ON abs(a.i - b.i) <= 1 AND abs(a.j - b.j) <= 1 AND abs(a.l - b.l) <= 1 AND a.node <> b.node),
s(node, root, step) USING KEY (node) AS (SELECT node, node, 0 FROM c UNION
   SELECT e.b, min(s.root), max(s.step) + 1 FROM s JOIN e ON e.a = s.node JOIN recurring.s t ON t.node = e.b WHERE s.root < t.root GROUP BY e.b)
SELECT s.root AS label, count(*)::BIGINT AS n FROM k JOIN c USING (i, j, l) JOIN s USING (node) GROUP BY 1""")
def grid_components(spark, sf_dir):
    labels = graph.grid_components(orders_cloud(spark, sf_dir), 1.5)
    return labels.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- planes


@query(f"""
WITH p AS ({B}), m AS (SELECT plane_id, {MOMENTS_SQL} FROM p GROUP BY 1), {eigen_sql('m', 'plane_id, n, mx, my, mz')}
SELECT plane_id, n, {r6('mx', 'my', 'mz', 'nx', 'ny', 'nz', '-(nx * mx + ny * my + nz * mz) AS d', 'sqrt(greatest(l3, 0e0)) AS rms', 'greatest(l3, 0e0) / (l1 + l2 + l3) AS variation')} FROM eig""")
def plane_tls(spark, sf_dir):
    return rounded(planes.fit_planes(box(spark, sf_dir)))


@query(f"""
WITH p AS (SELECT pid, x, y, z, CAST(label AS BIGINT) AS label FROM ({E_SQL}) q), m AS (SELECT label, {MOMENTS_SQL} FROM p GROUP BY 1), {eigen_sql('m', 'label, n')}
SELECT label, n, {r6('l1', 'l2', 'l3', 'l3 / (l1 + l2 + l3) AS variation')} FROM eig""")
def eigenvalues(spark, sf_dir):
    p = embedded(spark, sf_dir).withColumn("label", F.col("label").cast("long"))
    e = with_eigen(moments(p, "label"))
    return rounded(e.select("label", "n", "l1", "l2", "l3", (F.col("l3") / (F.col("l1") + F.col("l2") + F.col("l3"))).alias("variation")))


FIT_SQL = f"p AS ({B}), m AS (SELECT plane_id, {MOMENTS_SQL} FROM p GROUP BY 1), {eigen_sql('m', 'plane_id, n, mx, my, mz')}, fit AS (SELECT plane_id, nx, ny, nz, -(nx*mx + ny*my + nz*mz) AS d FROM eig)"


@query(f"""
WITH {FIT_SQL},
k AS (SELECT *, floor(x / 15e-2) i, floor(y / 15e-2) j, floor(z / 15e-2) l FROM p),
o AS (SELECT u.range AS di, v.range AS dj, w.range AS dl FROM range(-1, 2) u, range(-1, 2) v, range(-1, 2) w),
n AS (SELECT k.*, i + di AS ni, j + dj AS nj, l + dl AS nl FROM k, o),
c AS (SELECT a.plane_id, b.plane_id AS other, count(DISTINCT a.pid) AS contacts FROM n a JOIN k b ON b.i = a.ni AND b.j = a.nj AND b.l = a.nl
      WHERE a.plane_id <> b.plane_id AND (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z) <= 15e-2 * 15e-2 GROUP BY 1, 2),
s AS (SELECT plane_id, count(*) AS n FROM p GROUP BY 1)
SELECT least(c.plane_id, c.other) AS i, greatest(c.plane_id, c.other) AS j, c.contacts::BIGINT AS contacts FROM c JOIN s u USING (plane_id) JOIN s v ON v.plane_id = c.other
JOIN fit f ON f.plane_id = c.plane_id JOIN fit g ON g.plane_id = c.other
WHERE (u.n < v.n OR (u.n = v.n AND c.plane_id < c.other)) AND c.contacts >= 8 AND abs(f.nx*g.nx + f.ny*g.ny + f.nz*g.nz) <= 97e-2""")
def plane_adjacency(spark, sf_dir):
    p = box(spark, sf_dir)
    return planes.adjacency(p, planes.fit_planes(p), 0.15)


@query(f"""
WITH {FIT_SQL}, e AS (SELECT a.plane_id AS i, b.plane_id AS j FROM fit a JOIN fit b ON a.plane_id < b.plane_id WHERE abs(a.nx*b.nx + a.ny*b.ny + a.nz*b.nz) <= 97e-2),
t AS (SELECT e.i, e.j, g.j AS k, a.nx ax, a.ny ay, a.nz az, a.d ad, b.nx bx, b.ny by_, b.nz bz, b.d bd, c.nx cx, c.ny cy, c.nz cz, c.d cd
      FROM e JOIN e g ON g.i = e.j JOIN e h ON h.i = e.i AND h.j = g.j JOIN fit a ON a.plane_id = e.i JOIN fit b ON b.plane_id = e.j JOIN fit c ON c.plane_id = g.j),
u AS (SELECT *, ax*(by_*cz - bz*cy) + ay*(bz*cx - bx*cz) + az*(bx*cy - by_*cx) AS det FROM t)
SELECT i, j, k, {r6('-(ad*(by_*cz - bz*cy) + bd*(cy*az - cz*ay) + cd*(ay*bz - az*by_)) / det AS x', '-(ad*(bz*cx - bx*cz) + bd*(cz*ax - cx*az) + cd*(az*bx - ax*bz)) / det AS y', '-(ad*(bx*cy - by_*cx) + bd*(cx*ay - cy*ax) + cd*(ax*by_ - ay*bx)) / det AS z')}
FROM u WHERE abs(det) >= 1e-6""")
def plane_corners(spark, sf_dir):
    fit = planes.fit_planes(box(spark, sf_dir))
    skew = planes.pairs(fit).where("abs(a_nx * b_nx + a_ny * b_ny + a_nz * b_nz) <= 0.97")
    return rounded(planes.corner_points(fit, skew.select(F.col("a_plane_id").alias("i"), F.col("b_plane_id").alias("j"))))


@query(f"""
WITH p AS ({PLANES}), q AS (SELECT degrees(acos(least(1e0, abs(a.nx*b.nx + a.ny*b.ny + a.nz*b.nz)))) AS g FROM p a JOIN p b ON a.plane_id < b.plane_id)
SELECT count(*)::BIGINT AS pairs, count(*) FILTER (g < 1e-2)::BIGINT AS parallel, count(*) FILTER (g >= 1e-2 AND abs(g - 90) < 1e-2)::BIGINT AS orthogonal,
       count(*) FILTER (g >= 1e-2 AND abs(g - 90) >= 1e-2)::BIGINT AS other FROM q""")
def angle_statistics(spark, sf_dir):
    return planes.angle_report(nation_planes(spark, sf_dir))


@query(f"""
WITH p AS ({PLANES}), c AS (SELECT a.plane_id i, b.plane_id j, a.ny*b.nz - a.nz*b.ny wx, a.nz*b.nx - a.nx*b.nz wy, a.nx*b.ny - a.ny*b.nx wz,
  b.d*a.nx - a.d*b.nx ux, b.d*a.ny - a.d*b.ny uy, b.d*a.nz - a.d*b.nz uz FROM p a JOIN p b ON a.plane_id < b.plane_id),
l AS (SELECT *, sqrt(wx*wx + wy*wy + wz*wz) AS s FROM c)
SELECT i, j, {r6('wx / s AS dx', 'wy / s AS dy', 'wz / s AS dz', '(uy*wz - uz*wy) / (s*s) AS px', '(uz*wx - ux*wz) / (s*s) AS py', '(ux*wy - uy*wx) / (s*s) AS pz')} FROM l WHERE s >= 1e-8""")
def plane_lines(spark, sf_dir):
    return rounded(planes.intersection_lines(nation_planes(spark, sf_dir)))


@query(f"""
WITH {FIT_SQL}, h AS (SELECT *, CASE WHEN abs(nx) >= 9e-1 THEN 0e0 ELSE 1e0 END hx, CASE WHEN abs(nx) >= 9e-1 THEN 1e0 ELSE 0e0 END hy FROM fit),
u0 AS (SELECT *, -nz*hy AS ax, nz*hx AS ay, nx*hy - ny*hx AS az FROM h), u1 AS (SELECT *, sqrt(ax*ax + ay*ay + az*az) AS s FROM u0),
u AS (SELECT plane_id, nx, ny, nz, ax/s AS ux, ay/s AS uy, az/s AS uz FROM u1),
f AS (SELECT *, ny*uz - nz*uy AS vx, nz*ux - nx*uz AS vy, nx*uy - ny*ux AS vz FROM u),
q AS (SELECT p.plane_id, p.x*ux + p.y*uy + p.z*uz AS a, p.x*vx + p.y*vy + p.z*vz AS b FROM p JOIN f USING (plane_id))
SELECT plane_id, {r6('min(a) AS u0', 'max(a) AS u1', 'min(b) AS v0', 'max(b) AS v1', '(max(a) - min(a)) * (max(b) - min(b)) AS area')} FROM q GROUP BY 1""")
def plane_footprints(spark, sf_dir):
    p = box(spark, sf_dir)
    return rounded(planes.footprints(p, planes.fit_planes(p)))


@query(f"""
WITH {FIT_SQL}, h AS (SELECT *, CASE WHEN abs(nx) >= 9e-1 THEN 0e0 ELSE 1e0 END hx, CASE WHEN abs(nx) >= 9e-1 THEN 1e0 ELSE 0e0 END hy FROM fit),
u0 AS (SELECT *, -nz*hy AS ax, nz*hx AS ay, nx*hy - ny*hx AS az FROM h), u1 AS (SELECT *, sqrt(ax*ax + ay*ay + az*az) AS s FROM u0),
u AS (SELECT plane_id, nx, ny, nz, ax/s AS ux, ay/s AS uy, az/s AS uz FROM u1),
f AS (SELECT *, ny*uz - nz*uy AS vx, nz*ux - nx*uz AS vy, nx*uy - ny*ux AS vz FROM u),
q AS (SELECT f.plane_id AS i, p.plane_id AS j, min(p.x*ux + p.y*uy + p.z*uz) s0, max(p.x*ux + p.y*uy + p.z*uz) s1, min(p.x*vx + p.y*vy + p.z*vz) t0, max(p.x*vx + p.y*vy + p.z*vz) t1
      FROM p JOIN f ON f.plane_id <= p.plane_id GROUP BY 1, 2),
w AS (SELECT b.i, b.j, least(a.s1, b.s1) - greatest(a.s0, b.s0) AS ds, least(a.t1, b.t1) - greatest(a.t0, b.t0) AS dt,
      greatest(least((a.s1 - a.s0) * (a.t1 - a.t0), (b.s1 - b.s0) * (b.t1 - b.t0)), 1e-12) AS m FROM q a JOIN q b ON a.i = a.j AND b.i = a.i AND b.j <> b.i),
o AS (SELECT i, j, ds > 0 AND dt > 0 AS ok, CASE WHEN ds > 0 AND dt > 0 THEN ds * dt / m ELSE 0e0 END AS share FROM w)
SELECT i, j, {r6('share')}, ok AND share >= 3e-1 AS overlaps FROM o""")
def plane_overlaps(spark, sf_dir):
    p = box(spark, sf_dir)
    return rounded(planes.footprint_overlaps(p, planes.fit_planes(p)))


@query(f"""
WITH {FIT_SQL}, e AS (SELECT a.plane_id AS i, b.plane_id AS j FROM fit a JOIN fit b ON a.plane_id < b.plane_id WHERE abs(a.nx*b.nx + a.ny*b.ny + a.nz*b.nz) <= 97e-2),
t AS (SELECT e.i, e.j, g.j AS k, a.nx ax, a.ny ay, a.nz az, a.d ad, b.nx bx, b.ny by_, b.nz bz, b.d bd, c.nx cx, c.ny cy, c.nz cz, c.d cd
      FROM e JOIN e g ON g.i = e.j JOIN e h ON h.i = e.i AND h.j = g.j JOIN fit a ON a.plane_id = e.i JOIN fit b ON b.plane_id = e.j JOIN fit c ON c.plane_id = g.j),
u AS (SELECT *, ax*(by_*cz - bz*cy) + ay*(bz*cx - bx*cz) + az*(bx*cy - by_*cx) AS det FROM t),
c AS (SELECT i, j, k, -(ad*(by_*cz - bz*cy) + bd*(cy*az - cz*ay) + cd*(ay*bz - az*by_)) / det AS x, -(ad*(bz*cx - bx*cz) + bd*(cz*ax - cx*az) + cd*(az*bx - ax*bz)) / det AS y,
      -(ad*(bx*cy - by_*cx) + bd*(cx*ay - cy*ax) + cd*(ax*by_ - ay*bx)) / det AS z FROM u WHERE abs(det) >= 1e-6),
d AS (SELECT p.pid, p.x, p.y, p.z, c.x AS qx, c.y AS qy, c.z AS qz, i, j, k, (p.x-c.x)*(p.x-c.x) + (p.y-c.y)*(p.y-c.y) + (p.z-c.z)*(p.z-c.z) AS d2 FROM p, c),
r AS (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY round(d2, 12), i, j, k) AS rk, d2 <= 25e-2 AS near FROM d)
SELECT pid, {r6('CASE WHEN near THEN qx ELSE x END AS x', 'CASE WHEN near THEN qy ELSE y END AS y', 'CASE WHEN near THEN qz ELSE z END AS z')}, near AS snapped FROM r WHERE rk = 1""")
def corner_snap(spark, sf_dir):
    p = box(spark, sf_dir)
    fit = planes.fit_planes(p)
    skew = planes.pairs(fit).where("abs(a_nx * b_nx + a_ny * b_ny + a_nz * b_nz) <= 0.97")
    corners = planes.corner_points(fit, skew.select(F.col("a_plane_id").alias("i"), F.col("b_plane_id").alias("j")))
    return rounded(planes.snap_to_corners(p, corners, 0.5))


CLASS_SQL = f"""p AS ({PLANES}), b AS (SELECT min(mean_z) lo, max(mean_z) hi FROM p),
k AS (SELECT p.*, (mean_z - lo) / CASE WHEN hi > lo THEN hi - lo ELSE 1e0 END AS rel FROM p, b),
c AS (SELECT *, CASE WHEN abs(nz) >= cos(radians(30)) AND rel <= 25e-2 THEN 'floor' WHEN abs(nz) >= cos(radians(30)) AND rel >= 75e-2 THEN 'ceiling'
      WHEN abs(nz) >= cos(radians(30)) THEN 'slab' WHEN abs(nz) <= cos(radians(60)) THEN 'wall' ELSE 'sloped' END AS class FROM k)"""


@query(f"""
WITH {CLASS_SQL}, t AS (SELECT coalesce(max(mean_z) FILTER (class = 'wall'), (min(mean_z) + max(mean_z)) / 2) AS top FROM c)
SELECT plane_id, CASE WHEN class = 'sloped' AND mean_z > top THEN 'roof' WHEN class IN ('floor', 'slab') AND rms > 25e-3 THEN 'terrain' ELSE class END AS class FROM c, t""")
def surface_classes(spark, sf_dir):
    return planes.refine(planes.classify(nation_planes(spark, sf_dir))).select("plane_id", "class")


@query(f"WITH {CLASS_SQL} SELECT class, count(*)::BIGINT AS n, {r6('sum(area) AS area')} FROM c GROUP BY ROLLUP (class)")
def quantity_takeoff(spark, sf_dir):
    return rounded(planes.takeoff(planes.classify(nation_planes(spark, sf_dir))))


@query(f"""
WITH p AS ({PLANES}), a AS (SELECT plane_id, area, degrees(acos(least(1e0, abs(nz)))) AS slope, degrees(atan2(nx * CASE WHEN nz < 0 THEN -1 ELSE 1 END, ny * CASE WHEN nz < 0 THEN -1 ELSE 1 END)) AS z FROM p)
SELECT plane_id, {r6('slope', 'CASE WHEN z < 0 THEN z + 360 ELSE z END AS azimuth', 'area')} FROM a""")
def roof_report(spark, sf_dir):
    return rounded(planes.roof_report(nation_planes(spark, sf_dir)))


# ---------------------------------------------------------------- meshes


@query(f"WITH {TRI}, e AS (SELECT least(a, b) u, greatest(a, b) v FROM f UNION ALL SELECT least(b, c), greatest(b, c) FROM f UNION ALL SELECT least(c, a), greatest(c, a) FROM f), g AS (SELECT u, v, count(*) n FROM e GROUP BY 1, 2) SELECT count(*)::BIGINT AS edges, count(*) FILTER (n = 1)::BIGINT AS boundary, count(*) FILTER (n = 2)::BIGINT AS manifold, count(*) FILTER (n > 2)::BIGINT AS non_manifold FROM g")
def mesh_edge_stats(spark, sf_dir):
    return mesh.edge_stats(part_mesh(spark, sf_dir)[0])


@query(f"WITH {TRI} SELECT group_id, count(*)::BIGINT AS n_faces, {r6('sum(len) / 2 AS area')} FROM nrm GROUP BY 1")
def mesh_area(spark, sf_dir):
    return rounded(mesh.area(mesh.corners(*part_mesh(spark, sf_dir)), "group_id"))


@query(f"WITH {TRI} SELECT fid, {r6('CASE WHEN len > 0 THEN wx / len ELSE 0 END AS nx', 'CASE WHEN len > 0 THEN wy / len ELSE 0 END AS ny', 'CASE WHEN len > 0 THEN wz / len ELSE 0 END AS nz')} FROM nrm")
def mesh_face_normals(spark, sf_dir):
    return rounded(mesh.with_face_normals(mesh.corners(*part_mesh(spark, sf_dir))).select("fid", "nx", "ny", "nz"))


@query(f"""
WITH {TRI}, e AS (SELECT a AS vid, wx, wy, wz FROM w UNION ALL SELECT b, wx, wy, wz FROM w UNION ALL SELECT c, wx, wy, wz FROM w),
s AS (SELECT vid, sum(wx) x, sum(wy) y, sum(wz) z FROM e GROUP BY 1), n AS (SELECT *, sqrt(x*x + y*y + z*z) AS l FROM s)
SELECT vid, {r6('CASE WHEN l > 0 THEN x / l ELSE 0 END AS nx', 'CASE WHEN l > 0 THEN y / l ELSE 0 END AS ny', 'CASE WHEN l > 0 THEN z / l ELSE 0 END AS nz')} FROM n""")
def mesh_vertex_normals(spark, sf_dir):
    return rounded(mesh.vertex_normals(mesh.corners(*part_mesh(spark, sf_dir))))


@query(f"WITH {TRI} SELECT {r6('sum(ax*(by_*cz - bz*cy) + ay*(bz*cx - bx*cz) + az*(bx*cy - by_*cx)) / 6 AS volume')} FROM tri")
def mesh_signed_volume(spark, sf_dir):
    return rounded(mesh.signed_volume(mesh.corners(*part_mesh(spark, sf_dir))))


@query(f"""
WITH {TRI}, k AS (SELECT vid, min(vid) OVER (PARTITION BY round_even(x / 7e-1, 0), round_even(y / 7e-1, 0), round_even(z / 7e-1, 0)) AS t FROM v),
g AS (SELECT f.fid, p.t AS a, q.t AS b, r.t AS c, f.group_id FROM f JOIN k p ON p.vid = f.a JOIN k q ON q.vid = f.b JOIN k r ON r.vid = f.c)
SELECT fid, a, b, c, group_id FROM g WHERE a <> b AND b <> c AND a <> c""")
def mesh_weld(spark, sf_dir):
    return mesh.weld(*part_mesh(spark, sf_dir), 0.7)[0].select("fid", "a", "b", "c", "group_id")


@query(f"""
WITH {TRI}, s AS (SELECT least(a, b) u, greatest(a, b) v, * EXCLUDE (a, b, c) FROM (SELECT a, b, c, fid, group_id, wx/len nx, wy/len ny, wz/len nz FROM nrm) q
  UNION ALL SELECT least(b, c), greatest(b, c), * EXCLUDE (a, b, c) FROM (SELECT a, b, c, fid, group_id, wx/len nx, wy/len ny, wz/len nz FROM nrm) q
  UNION ALL SELECT least(c, a), greatest(c, a), * EXCLUDE (a, b, c) FROM (SELECT a, b, c, fid, group_id, wx/len nx, wy/len ny, wz/len nz FROM nrm) q),
g AS (SELECT u, v, count(*) n, min(group_id) g0, max(group_id) g1, arg_min(nx, fid)*arg_max(nx, fid) + arg_min(ny, fid)*arg_max(ny, fid) + arg_min(nz, fid)*arg_max(nz, fid) AS bend FROM s GROUP BY 1, 2)
SELECT u, v, n::BIGINT AS n FROM g WHERE n <> 2 OR g0 <> g1 OR bend < cos(radians(25))""")
def mesh_crease_edges(spark, sf_dir):
    return mesh.crease_edges(mesh.corners(*part_mesh(spark, sf_dir)))


@query(f"""
WITH {TRI}, c AS (SELECT fid, ax x0, ay y0, az - 12e-2 h0, bx x1, by_ y1, bz - 12e-2 h1 FROM tri UNION ALL SELECT fid, bx, by_, bz - 12e-2, cx, cy, cz - 12e-2 FROM tri UNION ALL SELECT fid, cx, cy, cz - 12e-2, ax, ay, az - 12e-2 FROM tri),
h AS (SELECT fid, x0 + (x1 - x0) * (h0 / (h0 - h1)) AS x, y0 + (y1 - y0) * (h0 / (h0 - h1)) AS y FROM c WHERE h0 * h1 < 0),
l AS (SELECT fid, list({{'x': x, 'y': y}} ORDER BY x, y) AS e FROM h GROUP BY 1 HAVING count(*) = 2)
SELECT fid, {r6('e[1].x AS x0', 'e[1].y AS y0', 'e[2].x AS x1', 'e[2].y AS y1')} FROM l""")
def mesh_slice(spark, sf_dir):
    return rounded(mesh.slice_z(mesh.corners(*part_mesh(spark, sf_dir)), 0.12))


@query("""
WITH s AS (SELECT o_custkey % 50 AS run, ((o_orderkey * 7919) % 10007) / 1e1 AS lo, ((o_orderkey * 7919) % 10007) / 1e1 + 1 + (o_orderkey % 5) AS hi FROM orders),
m AS (SELECT *, max(hi) OVER (PARTITION BY run ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s),
k AS (SELECT *, sum(CASE WHEN reach IS NULL OR lo > reach + 8e-2 THEN 1 ELSE 0 END) OVER (PARTITION BY run ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS g FROM m)
SELECT run, round(min(lo), 6) AS lo, round(max(hi), 6) AS hi, count(*)::BIGINT AS n FROM k GROUP BY run, g""")
def wall_runs(spark, sf_dir):
    s = view(spark, sf_dir, "SELECT o_custkey % 50 AS run, ((o_orderkey * 7919) % 10007) / 1e1 AS lo, ((o_orderkey * 7919) % 10007) / 1e1 + 1 + (o_orderkey % 5) AS hi FROM orders", "orders")
    return rounded(mesh.merge_runs(s).drop("k"))


# ---------------------------------------------------------------- levels, time, deviation


@query("""
WITH h AS (SELECT s_nationkey AS building, ((s_suppkey * 7919) % 400) / 2e1 AS z FROM supplier),
l AS (SELECT building, z, sum(CASE WHEN d > 5e-1 THEN 1 ELSE 0 END) OVER (PARTITION BY building ORDER BY z ROWS UNBOUNDED PRECEDING) AS k FROM (SELECT *, z - lag(z) OVER (PARTITION BY building ORDER BY z) AS d FROM h) q),
m AS (SELECT building, k, avg(z) AS lev FROM l GROUP BY 1, 2), u AS (SELECT *, lead(lev) OVER (PARTITION BY building ORDER BY lev) AS up FROM m)
SELECT building, k::BIGINT AS k, round(lev, 4) AS elevation, round(up - lev, 4) AS height FROM u WHERE up - lev >= 18e-1""")
def storeys(spark, sf_dir):
    h = view(spark, sf_dir, "SELECT s_nationkey AS building, ((s_suppkey * 7919) % 400) / 2e1 AS z FROM supplier", "supplier")
    return series.storeys(h, by=["building"])


TRACK = "SELECT user_id, timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts) AS t, value AS v FROM events"
TRACK_SQL = "SELECT user_id, epoch_us(ts)::BIGINT AS t, value AS v FROM events"


@query(f"""
WITH e AS ({TRACK_SQL}), k AS (SELECT user_id, t, avg(v) AS v FROM e GROUP BY 1, 2), q AS (SELECT DISTINCT user_id, t + 3600000000 AS t FROM k),
a AS (SELECT q.user_id, q.t, k.t AS t0, k.v AS v0 FROM q ASOF LEFT JOIN k ON q.user_id = k.user_id AND q.t >= k.t),
b AS (SELECT a.*, k.t AS t1, k.v AS v1 FROM a ASOF LEFT JOIN k ON a.user_id = k.user_id AND a.t <= k.t)
SELECT user_id, t, round(CASE WHEN v1 IS NULL THEN v0 WHEN v0 IS NULL THEN v1 WHEN t1 > t0 THEN v0 + (v1 - v0) * ((t - t0)::DOUBLE / (t1 - t0)) ELSE v0 END, 6) AS v FROM b""")
def interpolated_track(spark, sf_dir):
    track = view(spark, sf_dir, TRACK, "events").groupBy("user_id", "t").agg(F.avg("v").alias("v"))
    at = track.select("user_id", (F.col("t") + 3_600_000_000).alias("t")).distinct()
    return rounded(series.interpolate(track, at, ["user_id"], ["v"]))


@query(f"""
WITH e AS ({TRACK_SQL}), s AS (SELECT *, coalesce(abs(v - lag(v) OVER (PARTITION BY user_id ORDER BY t, v)), 0) AS d FROM e)
SELECT user_id, t, round(v, 6) AS v, round(sum(d) OVER (PARTITION BY user_id ORDER BY t, v ROWS UNBOUNDED PRECEDING), 4) AS s FROM s""")
def arc_length(spark, sf_dir):
    out = series.arc_length(view(spark, sf_dir, TRACK, "events"), ["user_id"], ["v"])
    return out.select("user_id", "t", F.round("v", 6).alias("v"), F.round("s", 4).alias("s"))


@query(f"WITH e AS ({TRACK_SQL}), s AS (SELECT *, v - lag(v) OVER (PARTITION BY user_id ORDER BY t) AS d FROM (SELECT user_id, t, max(v) AS v FROM e GROUP BY 1, 2) q) SELECT user_id, coalesce(min(d) >= 0, true) AS monotone, count(*)::BIGINT AS n FROM s GROUP BY 1")
def monotone_columns(spark, sf_dir):
    e = view(spark, sf_dir, TRACK, "events").groupBy("user_id", "t").agg(F.max("v").alias("v"))
    return series.monotone(e, ["user_id"], "t", "v")


DEVIATION = "SELECT pid, CASE plane_id WHEN 1 THEN z WHEN 2 THEN z - 25e-1 WHEN 3 THEN y WHEN 4 THEN y - 3 WHEN 5 THEN x ELSE x - 4 END AS d FROM ({}) q"


@query(f"WITH d AS ({DEVIATION.format(B)}) SELECT count(*)::BIGINT AS n, {r6('sqrt(avg(d * d)) AS rms', 'avg(d) AS mean', 'quantile_cont(abs(d), 95e-2) AS p95', 'max(abs(d)) AS max', 'avg((abs(d) <= 5e-3)::INT) AS within', 'avg((abs(d) <= 25e-3)::INT) AS covered')} FROM d")
def deviation_statistics(spark, sf_dir):
    return rounded(series.deviation_stats(view(spark, sf_dir, DEVIATION.format(BOX), "orders"), 0.005))


@query(f"WITH d AS ({DEVIATION.format(B)}) SELECT (len(list_filter([0e0, 1e-3, 2e-3, 3e-3, 5e-3, 8e-3, 1e-2, 2e-2], lambda e: e <= abs(d))) - 1)::INTEGER AS bin, count(*)::BIGINT AS n FROM d GROUP BY 1")
def deviation_histogram(spark, sf_dir):
    return series.histogram(view(spark, sf_dir, DEVIATION.format(BOX), "orders"), [0.0, 0.001, 0.002, 0.003, 0.005, 0.008, 0.01, 0.02])


@query(f"""
WITH p AS ({E_SQL}), a AS (SELECT * FROM p WHERE pid % 2 = 0), b AS (SELECT * FROM p WHERE pid % 2 = 1),
q AS (SELECT b.pid, a.pid AS nid, (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z) AS d2 FROM b, a),
r AS (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY d2, nid) AS rk FROM q)
SELECT pid, nid, {r6('sqrt(d2) AS moved')} FROM r WHERE rk = 1""")
def epoch_distance(spark, sf_dir):
    p = embedded(spark, sf_dir)
    near = points.knn(p.where("pid % 2 = 1"), p.where("pid % 2 = 0"), 1, 0.5)
    return rounded(near.select("pid", "nid", F.sqrt("d2").alias("moved")))


# ---------------------------------------------------------------- terrain and views


@query(f"""
WITH p AS ({O}), k AS (SELECT floor(x / 2) cx, floor(y / 2) cy, z FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY cx, cy ORDER BY z) rk, count(*) OVER (PARTITION BY cx, cy) n FROM k),
g0 AS (SELECT cx, cy, z AS g FROM r WHERE rk = least(floor(n * 5e-2), n - 1) + 1),
{', '.join(f"g{i + 1} AS (SELECT a.cx, a.cy, least(a.g, min(b.g) + 2) AS g FROM g{i} a JOIN g{i} b ON abs(a.cx - b.cx) <= 1 AND abs(a.cy - b.cy) <= 1 GROUP BY a.cx, a.cy, a.g)" for i in range(2))},
m AS (SELECT a.cx, a.cy, quantile_cont(b.g, 5e-1) AS g FROM g2 a JOIN g2 b ON abs(a.cx - b.cx) <= 1 AND abs(a.cy - b.cy) <= 1 GROUP BY 1, 2)
SELECT p.pid, {r6('p.z - m.g AS height')} FROM p JOIN m ON m.cx = floor(p.x / 2) AND m.cy = floor(p.y / 2)""")
def height_above_ground(spark, sf_dir):
    p = orders_cloud(spark, sf_dir)
    return rounded(scene.height_above(p, scene.terrain(p, 2.0, passes=2), 2.0))


@query(f"""
WITH p AS ({O}), r AS (SELECT floor(x / 3)::BIGINT AS px, floor(y / 3)::BIGINT AS py, pid, z, row_number() OVER (PARTITION BY floor(x / 3), floor(y / 3) ORDER BY z DESC, pid) AS rk, count(*) OVER (PARTITION BY floor(x / 3), floor(y / 3)) AS hits FROM p)
SELECT px, py, pid, {r6('z AS depth')}, hits::BIGINT AS hits FROM r WHERE rk = 1""")
def depth_buffer(spark, sf_dir):
    return rounded(scene.z_buffer(orders_cloud(spark, sf_dir), 3.0))


@query(f"""
WITH p AS ({O}), d AS (SELECT pid, x - 50 dx, y - 50 dy, z - 15e-1 dz FROM p), q AS (SELECT *, sqrt(dx*dx + dy*dy + dz*dz) r FROM d),
c AS (SELECT pid, r, least(floor((atan2(dy, dx) + pi()) / (2 * pi()) * 64), 63) az, least(floor((asin(dz / r) + pi() / 2) / pi() * 20), 19) el FROM q WHERE r > 0),
w AS (SELECT az, el, quantile_cont(r, 6e-1) c, count(*) n FROM c GROUP BY 1, 2 HAVING count(*) >= 6)
SELECT pid, r < w.c - greatest(25e-2, 5e-2 * w.c) AS passed FROM c JOIN w USING (az, el)""")
def free_space_votes(spark, sf_dir):
    return scene.carve_votes(orders_cloud(spark, sf_dir), (50.0, 50.0, 1.5), 64, 20)


# ---------------------------------------------------------------- parts and members

STOCK = stock()
SECTIONS = [r for r in sections() if r[0] in ("I", "H", "U")]
MEASURED = "SELECT p_partkey AS part, CASE p_partkey % 3 WHEN 0 THEN 'I' WHEN 1 THEN 'H' ELSE 'U' END AS family, 8e-2 + ((p_partkey * 7919) % 250) / 1e3 AS height, 4e-2 + ((p_partkey * 104729) % 180) / 1e3 AS width, ((p_partkey * 31) % 450) / 1e4 + 1e-3 AS t, CAST(p_size AS DOUBLE) AS area FROM part"
SECTION_SQL = "SELECT * FROM (VALUES " + ", ".join(f"('{f}', '{n}', {h!r}::DOUBLE, {b!r}::DOUBLE)" for f, n, h, b in SECTIONS) + ") s(family, profile, h, b)"


@query(f"""
WITH m AS ({MEASURED}), s AS ({SECTION_SQL}), e AS (SELECT m.part, s.profile, greatest(abs(height - h) / h, abs(width - b) / b) AS d FROM m JOIN s USING (family)),
r AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY d, profile) rk FROM e)
SELECT part, CASE WHEN d <= 8e-2 THEN profile END AS profile, {r6('d AS deviation')} FROM r WHERE rk = 1""")
def profile_match(spark, sf_dir):
    m = view(spark, sf_dir, MEASURED, "part").select("part", "family", "height", "width")
    catalog = spark.createDataFrame(SECTIONS, "family string, profile string, h double, b double")
    return rounded(series.match_profiles(m, catalog).select("part", "profile", "deviation"))


@query(f"""
WITH m AS ({MEASURED}), s AS (SELECT unnest({STOCK!r}::DOUBLE[]) AS s), r AS (SELECT part, area, t, s, row_number() OVER (PARTITION BY part ORDER BY abs(t - s), s) rk FROM m, s),
k AS (SELECT part, area, t, CASE WHEN abs(t - s) <= s * 15e-2 THEN s END AS stock FROM r WHERE rk = 1)
SELECT part, {r6('stock', 'coalesce(stock, t) * area * 7850 AS weight')} FROM k""")
def plate_weights(spark, sf_dir):
    m = view(spark, sf_dir, MEASURED, "part").select("part", "t", "area")
    out = series.nearest_stock(m, STOCK)
    return rounded(out.select("part", "stock", (F.coalesce("stock", "t") * F.col("area") * 7850).alias("weight")))


GEARS = "SELECT s_suppkey AS gid, ((s_suppkey * 7919) % 97) / 1e1 AS x, ((s_suppkey * 104729) % 89) / 1e1 AS y, 0e0 AS z, 0e0 AS ax, 0e0 AS ay, 1e0 AS az, CAST(10 + (s_suppkey * 13) % 50 AS DOUBLE) / 1e1 AS diameter, CAST(10 + (s_suppkey * 13) % 50 AS DOUBLE) AS teeth FROM supplier"


@query(f"""
WITH g AS ({GEARS}), p AS (SELECT a.gid a_gid, b.gid b_gid, sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y)) dist, (a.diameter + b.diameter) / 2 want, b.teeth / a.teeth ratio FROM g a JOIN g b ON a.gid < b.gid)
SELECT a_gid, b_gid, {r6('dist', 'ratio')} FROM p WHERE abs(dist - want) <= want * 8e-2""")
def gear_stages(spark, sf_dir):
    return rounded(series.gear_stages(view(spark, sf_dir, GEARS, "supplier")))


@query("""
WITH s AS (SELECT CAST(n_nationkey * 7 % 26 AS DOUBLE) AS station FROM nation UNION ALL SELECT -1e0 UNION ALL SELECT 3e1), o AS (SELECT station AS "from", lead(station) OVER (ORDER BY station) AS "to" FROM s)
SELECT "from", "to", "to" - "from" AS span FROM o WHERE "to" IS NOT NULL""")
def bridge_spans(spark, sf_dir):
    s = view(spark, sf_dir, "SELECT n_nationkey * 7 % 26 AS station FROM nation", "nation")
    return series.spans(s, -1.0, 30.0)


@query(f"""
WITH pts AS ({E_SQL}), {TRI}, t AS (SELECT fid, ax, ay, az, bx-ax ux, by_-ay uy, bz-az uz, cx-ax vx, cy-ay vy, cz-az vz, cx-bx ex, cy-by_ ey, cz-bz ez, bx, by_, bz, cx, cy, cz, wx, wy, wz FROM w),
d AS (SELECT pid, t.*, x-ax px, y-ay py, z-az pz, x-bx qx, y-by_ qy, z-bz qz, x-cx rx, y-cy ry, z-cz rz, x, y, z FROM pts, t),
e AS (SELECT *, ux*px+uy*py+uz*pz d1, vx*px+vy*py+vz*pz d2, ux*qx+uy*qy+uz*qz d3, vx*qx+vy*qy+vz*qz d4, ux*rx+uy*ry+uz*rz d5, vx*rx+vy*ry+vz*rz d6 FROM d),
g AS (SELECT *, d3*d6-d5*d4 va, d5*d2-d1*d6 vb, d1*d4-d3*d2 vc FROM e),
h AS (SELECT pid, fid, px*wx + py*wy + pz*wz AS side, CASE
  WHEN d1 <= 0 AND d2 <= 0 THEN px*px + py*py + pz*pz
  WHEN d3 >= 0 AND d4 <= d3 THEN qx*qx + qy*qy + qz*qz
  WHEN vc <= 0 AND d1 >= 0 AND d3 <= 0 THEN pow(px - ux*d1/(d1-d3), 2) + pow(py - uy*d1/(d1-d3), 2) + pow(pz - uz*d1/(d1-d3), 2)
  WHEN d6 >= 0 AND d5 <= d6 THEN rx*rx + ry*ry + rz*rz
  WHEN vb <= 0 AND d2 >= 0 AND d6 <= 0 THEN pow(px - vx*d2/(d2-d6), 2) + pow(py - vy*d2/(d2-d6), 2) + pow(pz - vz*d2/(d2-d6), 2)
  WHEN va <= 0 AND d4 - d3 >= 0 AND d5 - d6 >= 0 THEN pow(qx - ex*(d4-d3)/((d4-d3)+(d5-d6)), 2) + pow(qy - ey*(d4-d3)/((d4-d3)+(d5-d6)), 2) + pow(qz - ez*(d4-d3)/((d4-d3)+(d5-d6)), 2)
  ELSE pow(px*wx + py*wy + pz*wz, 2) / (wx*wx + wy*wy + wz*wz) END AS d2 FROM g),
r AS (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY round(d2, 12), fid) rk FROM h)
SELECT pid, round(sqrt(d2), 6) + 0e0 AS d FROM r WHERE rk = 1""")
def mesh_distance(spark, sf_dir):
    found = mesh.signed_distance(embedded(spark, sf_dir), mesh.corners(*part_mesh(spark, sf_dir)))
    return rounded(found.select("pid", F.abs("d").alias("d")))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A room end to end: thin, drop noise, fit the faces, classify them, take off areas."""
    room = saved(points.voxel_downsample(box(spark, sf_dir), 0.02), "room")
    clean = points.remove_statistical_outliers(room, 8, 2.5, 0.25)
    fit = planes.fit_planes(clean).withColumn("mean_z", F.col("mz"))
    sized = planes.classify(fit).join(planes.footprints(clean, fit).select("plane_id", "area"), "plane_id")
    return rounded(planes.takeoff(sized), 4)


# ---------------------------------------------------------------- fits, outlines, members

RING = "SELECT p_partkey AS pid, p_partkey % 8 AS ring, 3 + (1 + (p_partkey % 8) / 4e0) * cos(p_partkey * 37e-2) + ((p_partkey * 7919) % 100) / 1e4 AS u, -2 + (1 + (p_partkey % 8) / 4e0) * sin(p_partkey * 37e-2) + ((p_partkey * 104729) % 100) / 1e4 AS v FROM part"


@query(f"""
WITH p AS ({RING}), m AS (SELECT ring, avg(u) mu, avg(v) mv FROM p GROUP BY 1), c AS (SELECT ring, mu, mv, u - mu u, v - mv v FROM p JOIN m USING (ring)),
s AS (SELECT ring, mu, mv, count(*)::BIGINT n, sum(u*u) uu, sum(u*v) uv, sum(v*v) vv, sum(u*(u*u+v*v)) u3, sum(v*(u*u+v*v)) v3 FROM c GROUP BY 1, 2, 3),
f AS (SELECT *, (u3*vv - v3*uv) / (2*(uu*vv - uv*uv)) a, (v3*uu - u3*uv) / (2*(uu*vv - uv*uv)) b FROM s WHERE uu*vv - uv*uv > 0)
SELECT ring, n, {r6('mu + a AS u0', 'mv + b AS v0', 'sqrt(a*a + b*b + (uu + vv) / n) AS radius')} FROM f""")
def circle_fits(spark, sf_dir):
    return rounded(fitting.circle_fit(view(spark, sf_dir, RING, "part"), "ring"))


PAIRS = f"SELECT pid, x, y, z, x + ((pid * 31) % 17) / 1e3 AS tx, y - ((pid * 37) % 13) / 1e3 AS ty, z + 4e-3 AS tz, CASE WHEN plane_id > 4 THEN 1e0 ELSE 0e0 END AS nx, CASE WHEN plane_id IN (3, 4) THEN 1e0 ELSE 0e0 END AS ny, CASE WHEN plane_id < 3 THEN 1e0 ELSE 0e0 END AS nz FROM ({B}) q"
_ROW = ("y*nz - z*ny", "z*nx - x*nz", "x*ny - y*nx", "nx", "ny", "nz")


@query(f"""
WITH p AS (SELECT *, (tx-x)*nx + (ty-y)*ny + (tz-z)*nz AS res FROM ({PAIRS}) q)
SELECT count(*)::BIGINT AS n, {r6('sqrt(avg(res*res)) AS rmse')}, {', '.join(f"round(sum(({_ROW[i]}) * ({_ROW[j]})), 4) + 0e0 AS a{i}{j}" for i in range(6) for j in range(i, 6))},
       {', '.join(f"round(sum(({_ROW[i]}) * res), 4) + 0e0 AS b{i}" for i in range(6))} FROM p""")
def icp_normal_equations(spark, sf_dir):
    s = fitting.icp_sums(view(spark, sf_dir, PAIRS, "orders"))
    return s.select("n", *[(F.round(c, 6 if c == "rmse" else 4) + F.lit(0.0)).alias(c) for c in s.columns if c != "n"])


OUTLINE = "SELECT c_nationkey AS poly, c_custkey AS i, (2 + (c_custkey % 7) / 7e0) * cos(c_custkey * 41e-2) AS u, (2 + (c_custkey % 5) / 5e0) * sin(c_custkey * 41e-2) AS v FROM customer"


@query(f"""
WITH p AS ({OUTLINE}), e AS (SELECT poly, u, v, coalesce(lead(u) OVER w, first_value(u) OVER w) AS u1, coalesce(lead(v) OVER w, first_value(v) OVER w) AS v1 FROM p WINDOW w AS (PARTITION BY poly ORDER BY i))
SELECT poly, {r6('sum(u * v1 - u1 * v) / 2 AS area', 'sum(sqrt((u1-u)*(u1-u) + (v1-v)*(v1-v))) AS perimeter')}, count(*)::BIGINT AS n FROM e GROUP BY 1""")
def polygon_measures(spark, sf_dir):
    return rounded(fitting.polygon_measures(view(spark, sf_dir, OUTLINE, "customer")))


STAR = "SELECT CAST(n_regionkey AS BIGINT) AS poly, n_nationkey AS i, (1 + n_nationkey % 3) * cos(n_nationkey * 125e-2) + n_regionkey AS u, (1 + n_nationkey % 3) * sin(n_nationkey * 125e-2) AS v FROM nation"
STAR_EDGES = f"SELECT poly, u, v, coalesce(lead(u) OVER (PARTITION BY poly ORDER BY i), first_value(u) OVER (PARTITION BY poly ORDER BY i)) AS u1, coalesce(lead(v) OVER (PARTITION BY poly ORDER BY i), first_value(v) OVER (PARTITION BY poly ORDER BY i)) AS v1 FROM ({STAR}) s"
SPOTS = "SELECT o_orderkey AS pid, ((o_orderkey * 7919) % 1009) / 1e2 - 3 AS u, ((o_orderkey * 104729) % 601) / 1e2 - 3 AS v FROM orders"


@query(f"""
WITH e AS ({STAR_EDGES}), p AS ({SPOTS})
SELECT pid, poly FROM p JOIN e ON (e.v > p.v) <> (e.v1 > p.v) AND p.u < (e.u1 - e.u) * (p.v - e.v) / (e.v1 - e.v) + e.u GROUP BY 1, 2 HAVING count(*) % 2 = 1""")
def points_in_polygons(spark, sf_dir):
    edges = view(spark, sf_dir, STAR_EDGES, "nation")
    return fitting.inside(view(spark, sf_dir, SPOTS, "orders"), edges)


HOLES = "SELECT p_partkey AS hole, ((p_partkey * 7919) % 140) / 1e2 AS z0, ((p_partkey * 7919) % 140) / 1e2 + ((p_partkey * 31) % 250) / 1e2 AS z1, ((p_partkey * 37) % 180) / 1e2 AS width FROM part"


@query(f"""
WITH h AS ({HOLES}) SELECT hole, CASE WHEN z0 - 5e-2 < 3e-1 AND z1 - z0 > 16e-1 THEN 'door' ELSE 'window' END AS kind, {r6('z0 - 5e-2 AS sill', 'z1 - z0 AS height', 'width')}
FROM h WHERE z1 - z0 >= 25e-2 AND width >= 25e-2""")
def wall_openings(spark, sf_dir):
    return rounded(fitting.openings(view(spark, sf_dir, HOLES, "part"), 0.05))


MEMBERS = "SELECT s_suppkey AS sid, ((s_suppkey * 7919) % 97) / 1e1 AS px, ((s_suppkey * 104729) % 89) / 1e1 AS py, ((s_suppkey * 31) % 7) / 1e0 AS pz, ((s_suppkey * 37) % 101) / 1e1 AS qx, ((s_suppkey * 41) % 83) / 1e1 + 1e-2 AS qy, ((s_suppkey * 43) % 9) / 1e0 AS qz FROM supplier"


@query(f"""
WITH m AS ({MEMBERS}), p AS (SELECT a.sid i, b.sid j, a.px, a.py, a.pz, a.qx-a.px ux, a.qy-a.py uy, a.qz-a.pz uz, b.px bx, b.py by_, b.pz bz, b.qx-b.px vx, b.qy-b.py vy, b.qz-b.pz vz FROM m a JOIN m b ON a.sid < b.sid),
k AS (SELECT *, ux*ux+uy*uy+uz*uz a, vx*vx+vy*vy+vz*vz e, vx*(px-bx)+vy*(py-by_)+vz*(pz-bz) f, ux*(px-bx)+uy*(py-by_)+uz*(pz-bz) c, ux*vx+uy*vy+uz*vz b FROM p),
s0 AS (SELECT *, CASE WHEN a*e - b*b > 1e-12 THEN greatest(0e0, least(1e0, (b*f - c*e) / (a*e - b*b))) ELSE 0e0 END AS s FROM k),
t0 AS (SELECT *, greatest(0e0, least(1e0, (b*s + f) / e)) AS t FROM s0), s1 AS (SELECT *, greatest(0e0, least(1e0, (b*t - c) / a)) AS r FROM t0)
SELECT i, j, {r6('sqrt(pow(px + ux*r - bx - vx*t, 2) + pow(py + uy*r - by_ - vy*t, 2) + pow(pz + uz*r - bz - vz*t, 2)) AS dist')} FROM s1""")
def member_distances(spark, sf_dir):
    return rounded(fitting.segment_distances(view(spark, sf_dir, MEMBERS, "supplier")))


@query(f"""
WITH c AS (SELECT floor(x / 2)::BIGINT cx, floor(y / 2)::BIGINT cy, floor(z / 2)::BIGINT cz FROM ({O}) p GROUP BY 1, 2, 3 HAVING count(*) >= 2),
o AS (SELECT * FROM (VALUES (1,0,0),(-1,0,0),(0,1,0),(0,-1,0),(0,0,1),(0,0,-1)) v(i, j, k))
SELECT c.cx, c.cy, c.cz, count(*)::BIGINT AS open FROM c, o WHERE NOT EXISTS (SELECT 1 FROM c d WHERE d.cx = c.cx + i AND d.cy = c.cy + j AND d.cz = c.cz + k) GROUP BY 1, 2, 3""")
def skin_cells(spark, sf_dir):
    return fitting.boundary_cells(orders_cloud(spark, sf_dir), 2.0)


SEAMS = "SELECT l_suppkey AS seam, l_extendedprice / 1e3 AS s FROM lineitem"


@query(f"SELECT seam, count(*)::BIGINT AS n, count(DISTINCT floor(s / 25e-2))::BIGINT AS bins, {r6('count(DISTINCT floor(s / 25e-2)) * 25e-2 AS covered')} FROM ({SEAMS}) q GROUP BY 1")
def seam_coverage(spark, sf_dir):
    return rounded(fitting.line_coverage(view(spark, sf_dir, SEAMS, "lineitem"), ["seam"], 0.25))
