"""The relations operators exchange, and a check that a table is one of them.

Columns in brackets of ``OPTIONAL`` may be absent; a column that is there is there for every
row. ``conform`` selects a relation's columns, casts them, and fails on what is missing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RECORDS = {
    "points": "pid long, x double, y double, z double",
    "vertices": "vid long, x double, y double, z double",
    "faces": "fid long, a long, b long, c long",
    "planes": "plane_id long, n long, nx double, ny double, nz double, d double, rms double",
    "assignment": "pid long, plane_id long",
    "surfaces": "plane_id long, nx double, ny double, nz double, d double, class string, loop array<struct<u:double,v:double>>, holes array<array<struct<u:double,v:double>>>, area double",
    "cameras": "cam_id long, r0 double, r1 double, r2 double, r3 double, r4 double, r5 double, r6 double, r7 double, r8 double, t0 double, t1 double, t2 double, fx double, fy double, ox double, oy double, k1 double",
    "lines": "i long, j long, dx double, dy double, dz double, px double, py double, pz double",
    "corners": "i long, j long, k long, x double, y double, z double",
    "cylinders": "cyl_id long, n long, px double, py double, pz double, ax double, ay double, az double, radius double, length double, rms double",
    "shafts": "shaft long, step long, cyl_id long, diameter double, start double, end double",
    "members": "cluster long, length double, height double, width double, family string, profile string, deviation double",
    "plates": "i long, j long, thickness double, stock double",
    "seams": "i long, j long, length double",
    "flat_parts": "part long, loop array<struct<u:double,v:double>>, holes array<array<struct<u:double,v:double>>>, bends array<struct<u0:double,v0:double,u1:double,v1:double,angle:double>>",
    "nodes": "node long, x double, y double, z double, members array<long>, angles array<double>, eccentricity double",
    "decks": "x double, y double, z double, ax double, ay double, az double, length double, width double, area double",
    "piers": "station double, height double, length double, width double, bearing boolean",
    "cables": "ax double, ay double, az double, bx double, by double, bz double",
}
OPTIONAL = {
    "points": "r int, g int, b int, nx double, ny double, nz double, intensity double, t double",
    "vertices": "r int, g int, b int, u double, v double",
    "faces": "group_id int, page int",
    "planes": "mx double, my double, mz double, variation double",
    "cameras": "name string, w int, h int, a12 double, poly array<double>, max_theta double",
}


def _columns(text: str) -> list[tuple[str, str]]:
    out, depth, held = [], 0, ""
    for c in text + ",":
        depth += (c in "<(") - (c in ">)")
        if c == "," and not depth:
            if held.strip():
                out.append(tuple(held.split(None, 1)))
            held = ""
        else:
            held += c
    return out


def conform(df: DataFrame, record: str) -> DataFrame:
    """``df`` with the record's columns in order and type, and those optional ones it has; other columns go."""
    needed, may = _columns(RECORDS[record]), _columns(OPTIONAL.get(record, ""))
    missing = [n for n, _ in needed if n not in df.columns]
    if missing:
        raise ValueError(f"{record} without {', '.join(missing)}")
    return df.select(*[F.col(n).cast(t).alias(n) for n, t in needed], *[F.col(n).cast(t).alias(n) for n, t in may if n in df.columns])


def faults(df: DataFrame, record: str, key: list[str]) -> DataFrame:
    """One row: rows in all, rows with a null or not finite number in a needed column, and keys that occur twice or more."""
    needed = _columns(RECORDS[record])
    bad = F.lit(False)
    for n, t in needed:
        bad = bad | F.col(n).isNull() | (F.isnan(n) | (F.abs(n) == float("inf")) if t == "double" else F.lit(False))
    whole = conform(df, record).withColumn("bad", F.coalesce(bad, F.lit(True)))
    twice = whole.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).agg(F.count_if(F.col("n") > 1).alias("repeated_keys"))
    return whole.agg(F.count(F.lit(1)).alias("rows"), F.count_if("bad").alias("bad_rows")).crossJoin(F.broadcast(twice))  # one row each


def select(df: DataFrame, ids: DataFrame, key: str = "pid") -> DataFrame:
    """The rows of ``df`` whose key is in ``ids``, with all their columns, each once."""
    return df.join(ids.select(key), key, "left_semi")
