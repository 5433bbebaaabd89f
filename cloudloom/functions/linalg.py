"""Three-dimensional algebra as Columns: nothing leaves the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Vec = tuple[Column, Column, Column]


def vec(prefix: str, names: tuple[str, str, str] = ("x", "y", "z")) -> Vec:
    return tuple(F.col(prefix + n) for n in names)  # type: ignore[return-value]


def dot(a: Vec, b: Vec) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Vec, b: Vec) -> Vec:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def minus(a: Vec, b: Vec) -> Vec:
    return a[0] - b[0], a[1] - b[1], a[2] - b[2]


def norm(a: Vec) -> Column:
    return F.sqrt(dot(a, a))


def moments(df: DataFrame, *by: str) -> DataFrame:
    """Count, mean and population covariance of x, y, z per group: one partial and one final aggregate."""
    names = ("x", "y", "z")
    pairs = [("x", "x"), ("x", "y"), ("x", "z"), ("y", "y"), ("y", "z"), ("z", "z")]
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.avg(n).alias(f"m{n}") for n in names],
        *[F.covar_pop(a, b).alias(f"c{a}{b}") for a, b in pairs],
    )


def with_eigen(df: DataFrame) -> DataFrame:
    """Adds l1 >= l2 >= l3 and the unit eigenvector (nx, ny, nz) of l3 of the symmetric matrix cxx .. czz.

    The first component above 1e-9 in size is positive; an isotropic matrix gives +z.
    """
    a, b, c, d, e, f = (F.col(n) for n in ("cxx", "cxy", "cxz", "cyy", "cyz", "czz"))
    df = df.withColumn("__q", (a + d + f) / 3)
    q = F.col("__q")
    df = df.withColumn("__p", F.sqrt(((a - q) * (a - q) + (d - q) * (d - q) + (f - q) * (f - q) + (b * b + c * c + e * e) * 2) / 6))
    det = (a - q) * ((d - q) * (f - q) - e * e) - b * (b * (f - q) - e * c) + c * (b * e - (d - q) * c)
    p = F.col("__p")
    r = F.when(p > 0, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), det / (p * p * p * 2)))).otherwise(F.lit(1.0))
    df = df.withColumn("__phi", F.acos(r) / 3)
    phi = F.col("__phi")
    df = df.withColumns({"l1": q + p * 2 * F.cos(phi), "l3": q + p * 2 * F.cos(phi + 2 * math.pi / 3)})
    df = df.withColumn("l2", q * 3 - F.col("l1") - F.col("l3"))
    low = F.col("l3")
    rows = ((a - low, b, c), (b, d - low, e), (c, e, f - low))
    made = {}
    for i, (u, v) in enumerate(((0, 1), (0, 2), (1, 2))):
        for n, x in zip("xyz", cross(rows[u], rows[v]), strict=True):
            made[f"__{i}{n}"] = x
    df = df.withColumns(made)
    sizes = [dot(vec(f"__{i}"), vec(f"__{i}")) for i in range(3)]
    df = df.withColumns({f"__s{i}": s for i, s in enumerate(sizes)})
    s0, s1, s2 = (F.col(f"__s{i}") for i in range(3))
    best = F.when((s0 >= s1) & (s0 >= s2), 0).when(s1 >= s2, 1).otherwise(2)
    df = df.withColumns({"__best": best, "__len": F.sqrt(F.greatest(s0, s1, s2))})
    pick = {n: F.when(F.col("__best") == 0, F.col(f"__0{n}")).when(F.col("__best") == 1, F.col(f"__1{n}")).otherwise(F.col(f"__2{n}")) for n in "xyz"}
    flat = F.col("__len") > 0
    df = df.withColumns({f"__v{n}": F.when(flat, v / F.col("__len")).otherwise(F.lit(1.0 if n == "z" else 0.0)) for n, v in pick.items()})
    x, y, z = vec("__v")
    sign = F.when(F.abs(x) > 1e-9, F.signum(x)).when(F.abs(y) > 1e-9, F.signum(y)).otherwise(F.signum(z))
    df = df.withColumns({"nx": x * sign, "ny": y * sign, "nz": z * sign})
    return df.drop(*[n for n in df.columns if n.startswith("__")])


def eigen_sql(source: str, keep: str) -> str:
    """The same numbers in SQL, from a relation with cxx .. czz; ``keep``: columns carried on."""
    return f"""
e0 AS (SELECT {keep}, cxx a, cxy b, cxz c, cyy d, cyz e, czz f, (cxx + cyy + czz) / 3 AS q FROM {source}),
e1 AS (SELECT *, sqrt(((a-q)*(a-q) + (d-q)*(d-q) + (f-q)*(f-q) + 2*(b*b + c*c + e*e)) / 6) AS p FROM e0),
e2 AS (SELECT *, acos(CASE WHEN p > 0 THEN greatest(-1e0, least(1e0,
         ((a-q)*((d-q)*(f-q) - e*e) - b*(b*(f-q) - e*c) + c*(b*e - (d-q)*c)) / (2*p*p*p))) ELSE 1e0 END) / 3 AS phi FROM e1),
e3 AS (SELECT *, q + 2*p*cos(phi) AS l1, q + 2*p*cos(phi + 2*pi()/3) AS l3 FROM e2),
e4 AS (SELECT *, 3*q - l1 - l3 AS l2,
         b*e - c*(d-l3) AS x0, c*b - (a-l3)*e AS y0, (a-l3)*(d-l3) - b*b AS z0,
         b*(f-l3) - c*e AS x1, c*c - (a-l3)*(f-l3) AS y1, (a-l3)*e - b*c AS z1,
         (d-l3)*(f-l3) - e*e AS x2, e*c - b*(f-l3) AS y2, b*e - (d-l3)*c AS z2 FROM e3),
e5 AS (SELECT *, x0*x0+y0*y0+z0*z0 AS s0, x1*x1+y1*y1+z1*z1 AS s1, x2*x2+y2*y2+z2*z2 AS s2 FROM e4),
e6 AS (SELECT *, CASE WHEN s0 >= s1 AND s0 >= s2 THEN 0 WHEN s1 >= s2 THEN 1 ELSE 2 END AS k, sqrt(greatest(s0, s1, s2)) AS len_ FROM e5),
e7 AS (SELECT *, CASE WHEN len_ > 0 THEN CASE k WHEN 0 THEN x0 WHEN 1 THEN x1 ELSE x2 END / len_ ELSE 0e0 END AS vx,
         CASE WHEN len_ > 0 THEN CASE k WHEN 0 THEN y0 WHEN 1 THEN y1 ELSE y2 END / len_ ELSE 0e0 END AS vy,
         CASE WHEN len_ > 0 THEN CASE k WHEN 0 THEN z0 WHEN 1 THEN z1 ELSE z2 END / len_ ELSE 1e0 END AS vz FROM e6),
eig AS (SELECT *, vx * sg AS nx, vy * sg AS ny, vz * sg AS nz FROM (
         SELECT *, CASE WHEN abs(vx) > 1e-9 THEN sign(vx) WHEN abs(vy) > 1e-9 THEN sign(vy) ELSE sign(vz) END AS sg FROM e7))"""


MOMENTS_SQL = (
    "count(*)::BIGINT AS n, avg(x) AS mx, avg(y) AS my, avg(z) AS mz, covar_pop(x, x) AS cxx, covar_pop(x, y) AS cxy, "
    "covar_pop(x, z) AS cxz, covar_pop(y, y) AS cyy, covar_pop(y, z) AS cyz, covar_pop(z, z) AS czz"
)
