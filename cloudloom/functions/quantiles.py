"""Exact percentiles of groups of any size: no task holds a group's values.

Spark's own percentile keeps every distinct value of a group in one task. Here the values'
ranks are narrowed down: each pass counts values in bins between two bounds, a row per task,
group and bin, until so few are left between them that these alone are looked at.

Edge cases: nulls count nothing and NaN is largest, as for Spark's; a group without values has null.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bins between two bounds; values between two bounds that are few enough to be looked at.
BINS, FEW = 1_024, 256


def percentiles(rows: DataFrame, by: str | None, asked: dict[str, list[float]]) -> dict:
    """Of each group ``by`` (None: of all) and each column in ``asked``: the percentiles that Spark's percentile gives; a row per group comes to the driver.

    ``rows`` are read once per pass, about three times: they should be written.
    """
    spark = rows.sparkSession
    own = rows.select((F.col(by) if by else F.lit(0)).alias("grp"), F.posexplode(F.array(*[F.col(c).cast("double") for c in asked])).alias("v", "x"))
    own = own.where("grp is not null and x is not null")
    schema = f"span int, grp {dict(own.dtypes)['grp']}, v int, low double, high double, held long"
    # bounds are finite; what is not lies before or behind them
    small, big = F.col("x") == float("-inf"), F.col("x") == float("inf")
    real = F.when(~small & ~big & ~F.isnan("x"), F.col("x"))
    known = own.groupBy("grp", "v").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(small).alias("small"), F.count_if(big).alias("big"), F.count(real).alias("real"), F.min(real).alias("low"), F.max(real).alias("high")
    ).collect()
    shares = list(asked.values())
    # by group, column and rank: values, and bounds (low, high, how many lie under them and between them) of those not known
    found: dict[tuple, float] = {}
    open_: dict[tuple, list] = {}
    for r in known:
        for q in shares[r["v"]]:
            at = q * (r["n"] - 1)
            for rank in {math.floor(at), math.ceil(at)}:
                key = (r["grp"], r["v"], rank)
                if rank < r["small"]:
                    found[key] = -math.inf
                elif rank >= r["small"] + r["real"]:
                    found[key] = math.inf if rank < r["small"] + r["real"] + r["big"] else math.nan
                elif r["low"] == r["high"]:
                    found[key] = r["low"]
                else:
                    open_[key] = [r["low"], r["high"], r["small"], r["real"]]
    while open_:
        spans = sorted({(g, v, b[0], b[1], b[3]) for (g, v, _), b in open_.items()}, key=str)
        table = F.broadcast(spark.createDataFrame([(k, *s) for k, s in enumerate(spans)], schema))  # a few rows per group
        within = own.join(table, ["grp", "v"]).where("x >= low and x <= high")
        few = [k for k, s in enumerate(spans) if s[4] <= FEW]
        many = [k for k, s in enumerate(spans) if s[4] > FEW]
        values: dict[int, list[float]] = {k: [] for k in few}
        if few:
            for r in within.where(F.col("span").isin(few)).select("span", "x").toLocalIterator():
                values[r["span"]].append(r["x"])
        bins: dict[int, list] = {k: [] for k in many}
        if many:
            # halves, which don't overflow
            wide = F.col("high") / 2 - F.col("low") / 2
            share = F.when(wide > 0, (F.col("x") / 2 - F.col("low") / 2) / wide).otherwise((F.col("x") > F.col("low")).cast("double"))
            bin_ = F.least(F.floor(share * BINS), F.lit(BINS - 1))
            counts = within.where(F.col("span").isin(many)).groupBy("span", bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("low"), F.max("x").alias("high"))
            for r in counts.collect():
                bins[r["span"]].append((r["bin"], r["n"], r["low"], r["high"]))
        at = {s: k for k, s in enumerate(spans)}
        for key, (low, high, under, held) in list(open_.items()):
            k = at[key[0], key[1], low, high, held]
            if k in values:
                found[key] = sorted(values[k])[key[2] - under]
                del open_[key]
                continue
            for _, n, lo, hi in sorted(bins[k]):
                if key[2] < under + n:
                    break
                under += n
            if lo == hi:
                found[key] = lo
                del open_[key]
            else:
                open_[key] = [lo, hi, under, n]
    out: dict = {}
    for r in known:
        made = []
        for q in shares[r["v"]]:
            at = q * (r["n"] - 1)
            lo, hi = math.floor(at), math.ceil(at)
            a, b = found[r["grp"], r["v"], lo], found[r["grp"], r["v"], hi]
            made.append(a if lo == hi or a == b else (hi - at) * a + (at - lo) * b)
        out.setdefault(r["grp"], {})[list(asked)[r["v"]]] = made
    return out
