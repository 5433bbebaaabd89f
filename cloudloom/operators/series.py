"""Ordered relations: levels, storeys, interpolation in time, arc length, spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cloudloom.operators.fitting import each_two


def levels(values: DataFrame, value: str, gap: float, by: list[str] | None = None) -> DataFrame:
    """Clusters of sorted values: a new one where the step from the previous exceeds ``gap``. (k, n, level)."""
    by = by or []
    order = W.partitionBy(*by).orderBy(value)
    fresh = F.when(F.col(value) - F.lag(value).over(order) > gap, 1).otherwise(0)
    k = F.sum("__fresh").over(order.rowsBetween(W.unboundedPreceding, W.currentRow))
    marked = values.select(*by, value).withColumn("__fresh", fresh).withColumn("k", k)
    return marked.groupBy(*by, "k").agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("level"))


def storeys(heights: DataFrame, value: str = "z", merge: float = 0.5, least: float = 1.8, by: list[str] | None = None) -> DataFrame:
    """Consecutive levels at least ``least`` apart: (k, elevation, height)."""
    by = by or []
    found = levels(heights, value, merge, by)
    up = F.lead("level").over(W.partitionBy(*by).orderBy("level"))
    return found.withColumn("up", up).where(F.col("up") - F.col("level") >= least).select(
        *by, "k", F.round("level", 4).alias("elevation"), F.round(F.col("up") - F.col("level"), 4).alias("height")
    )


def interpolate(track: DataFrame, at: DataFrame, by: list[str], values: list[str], time: str = "t") -> DataFrame:
    """``at`` with each value interpolated linearly between the nearest track rows before and after.

    Outside the track, and at equal times, the nearest row's value holds. One shuffle by
    ``by``; a single long track should be cut by time first, each cut with its neighbours' ends.
    """
    marked = track.select(*by, time, *values, F.lit(0).alias("__q")).unionByName(at.withColumn("__q", F.lit(1)), allowMissingColumns=True)
    order = W.partitionBy(*by).orderBy(F.col(time), F.col("__q"))
    back = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    ahead = order.rowsBetween(W.currentRow, W.unboundedFollowing)

    def known(c: str) -> Column:
        return F.when(F.col("__q") == 0, F.col(c))

    marked = marked.withColumns(
        {f"__{c}0": F.last(known(c), ignorenulls=True).over(back) for c in [time, *values]}
        | {f"__{c}1": F.first(known(c), ignorenulls=True).over(ahead) for c in [time, *values]}
    )
    t0, t1 = F.col(f"__{time}0"), F.col(f"__{time}1")
    share = F.when(t1 > t0, (F.col(time) - t0) / (t1 - t0)).otherwise(F.lit(0.0))
    out = {}
    for c in values:
        a, b = F.col(f"__{c}0"), F.col(f"__{c}1")
        out[c] = F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + (b - a) * share)
    return marked.where(F.col("__q") == 1).withColumns(out).select(*at.columns, *values)


def arc_length(track: DataFrame, by: list[str], coords: list[str], time: str = "t") -> DataFrame:
    """The track with its running length along ``coords``."""
    order = W.partitionBy(*by).orderBy(time, *coords)
    step = F.sqrt(sum((F.col(c) - F.lag(c).over(order)) * (F.col(c) - F.lag(c).over(order)) for c in coords))
    stepped = track.withColumn("__step", F.coalesce(step, F.lit(0.0)))
    return stepped.withColumn("s", F.sum("__step").over(order.rowsBetween(W.unboundedPreceding, W.currentRow))).drop("__step")


def monotone(rows: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """Per group, whether the value never falls along ``order``: how a time column is told."""
    step = F.col(value) - F.lag(value).over(W.partitionBy(*by).orderBy(order))
    return rows.withColumn("__d", step).groupBy(*by).agg(F.coalesce(F.min("__d") >= 0, F.lit(True)).alias("monotone"), F.count(F.lit(1)).alias("n"))


def spans(stations: DataFrame, start: float, end: float, value: str = "station") -> DataFrame:
    """Clear spans between supports from one end of a deck to the other; supports belong to a model."""
    ends = stations.sparkSession.createDataFrame([(start,), (end,)], f"{value} double")
    every = stations.select(F.col(value).cast("double").alias(value)).unionByName(ends)
    after = F.lead(value).over(W.orderBy(value))
    return every.withColumn("to", after).where("to is not null").select(F.col(value).alias("from"), "to", (F.col("to") - F.col(value)).alias("span"))


def deviation_stats(d: DataFrame, tolerance: float, value: str = "d") -> DataFrame:
    """One row: count, rms, mean, 95th percentile and maximum of |d|, share within tolerance and coverage band."""
    size = F.abs(value)
    band = max(5 * tolerance, 0.02)
    return d.agg(
        F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(F.col(value) * F.col(value))).alias("rms"), F.avg(value).alias("mean"),
        F.percentile(size, F.lit(0.95)).alias("p95"), F.max(size).alias("max"),
        F.avg((size <= tolerance).cast("double")).alias("within"), F.avg((size <= band).cast("double")).alias("covered"),
    )


def histogram(d: DataFrame, edges: list[float], value: str = "d") -> DataFrame:
    """Counts of |d| per bin [edge, next edge); the last bin is open. Empty bins have no row."""
    bin_ = F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e <= F.abs(value))) - 1
    return d.groupBy(bin_.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def nearest_stock(measured: DataFrame, stock: list[float], tolerance: float = 0.15, value: str = "t") -> DataFrame:
    """Adds the nearest stock value, null if it is off by more than ``tolerance`` of itself."""
    best = F.array_min(F.transform(F.array(*map(F.lit, stock)), lambda s: F.struct(F.abs(F.col(value) - s).alias("d"), s.alias("s"))))
    return measured.withColumn("__b", best).withColumn("stock", F.when(F.col("__b.d") <= F.col("__b.s") * tolerance, F.col("__b.s"))).drop("__b")


def match_profiles(measured: DataFrame, catalog: DataFrame, tolerance: float = 0.08) -> DataFrame:
    """Best catalog section of the family by the larger relative error of height and width; null beyond tolerance."""
    own = F.struct("profile", "h", "b")
    c = catalog.where("family is not null").groupBy(F.col("family").alias("c_family")).agg(F.collect_list(own).alias("__sections"))
    both = measured.join(F.broadcast(c), F.col("family") == F.col("c_family"), "left")  # the catalog is a fixed list

    def off(s: Column) -> Column:
        error = F.greatest(F.abs(F.col("height") - s["h"]) / s["h"], F.abs(F.col("width") - s["b"]) / s["b"])
        return F.struct(error.alias("error"), s["profile"].alias("profile"))

    # a row meets its family's sections where it lies: no row for each section
    best = both.withColumn("__m", F.array_min(F.transform("__sections", off)))
    ok = F.col("__m.error") <= tolerance
    return best.select(*measured.columns, F.when(ok, F.col("__m.profile")).alias("profile"), F.col("__m.error").alias("deviation"))


def gear_stages(gears: DataFrame, tolerance: float = 0.08) -> DataFrame:
    """Pairs of parallel gears whose centre distance is half the sum of their pitch diameters, with the ratio."""
    both = each_two(gears, "gid")
    d = [F.col(f"b_{k}") - F.col(f"a_{k}") for k in "xyz"]
    cos = sum(F.col(f"a_a{k}") * F.col(f"b_a{k}") for k in "xyz")
    along = sum(x * F.col(f"a_a{k}") for x, k in zip(d, "xyz", strict=True))
    dist = F.sqrt(F.greatest(F.lit(0.0), sum(x * x for x in d) - along * along))
    want = (F.col("a_diameter") + F.col("b_diameter")) / 2
    both = both.withColumns({"dist": dist, "want": want, "cos": F.abs(cos)})
    ok = (F.col("cos") >= 0.99) & (F.abs(F.col("dist") - F.col("want")) <= F.col("want") * tolerance)
    return both.where(ok).select("a_gid", "b_gid", "dist", (F.col("b_teeth") / F.col("a_teeth")).alias("ratio"))
