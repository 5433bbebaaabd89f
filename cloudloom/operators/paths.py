"""Long tracks: values between their rows, lengths along them, and the match of two paths of one walk.

A track is cut by time. Each cut gets the last row of the cuts before it and the first of those
after it, which are found among one row per cut, so cuts are worked on by themselves and a
single track of any length spreads over all tasks.

Edge cases: rows with a null time or value take no part; asked times outside the track take
the nearest row's values, at a time the track has, that row's; of track rows at one time the
values are taken in order of time, then values. An empty track leaves nulls.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cloudloom.operators.points import XYZ
from cloudloom.plans.scratch import saved


def _neighbours(track: DataFrame, cuts: DataFrame, time: str, values: list[str]) -> DataFrame:
    """(__k, __before, __after): per cut the track rows just outside it as structs; one row per cut is ordered, not the track."""
    row = F.struct(time, *values)
    ends = track.groupBy("__k").agg(F.min_by(row, row).alias("first"), F.max_by(row, row).alias("last"))
    every = cuts.select("__k").unionByName(ends.select("__k")).distinct().join(ends, "__k", "left")
    back = W.orderBy("__k").rowsBetween(W.unboundedPreceding, -1)
    ahead = W.orderBy(F.desc("__k")).rowsBetween(W.unboundedPreceding, -1)
    return every.select("__k", F.last("last", ignorenulls=True).over(back).alias("__before"), F.last("first", ignorenulls=True).over(ahead).alias("__after"))


def between(track: DataFrame, at: DataFrame, values: list[str], cut: float, time: str = "t") -> DataFrame:
    """``at`` (with ``time``) with each value interpolated linearly on one track, in cuts of ``cut`` units of time."""
    key = F.floor(F.col(time) / cut)
    rows = track.select(time, *values).dropna().withColumn("__k", key)
    # the asked row as a whole, so that no column of it can clash
    asked = at.select(F.struct(*at.columns).alias("__id"), F.col(time), key.alias("__k"))
    near = saved(_neighbours(rows, asked, time, values), "cuts")
    carried = near.select("__k", F.explode(F.array_compact(F.array("__before", "__after"))).alias("r")).select("__k", *[F.col(f"r.{c}").alias(c) for c in (time, *values)])
    whole = rows.unionByName(carried).withColumn("__q", F.lit(0)).unionByName(asked.select("__k", time, "__id", F.lit(1).alias("__q")), allowMissingColumns=True)
    known = F.when(F.col("__q") == 0, F.struct(time, *values))
    back = W.partitionBy("__k").orderBy(time, "__q", *values).rowsBetween(W.unboundedPreceding, 0)
    # the same order backwards: a running last, not a frame that is summed anew for every row
    ahead = W.partitionBy("__k").orderBy(F.desc(time), "__q", *[F.desc(v) for v in values]).rowsBetween(W.unboundedPreceding, 0)
    both = whole.withColumns({"__a": F.last(known, ignorenulls=True).over(back), "__b": F.last(known, ignorenulls=True).over(ahead)}).where("__q = 1")
    a, b = (lambda c: F.col(f"__a.{c}")), (lambda c: F.col(f"__b.{c}"))
    share = F.when(b(time) > a(time), (F.col(time) - a(time)) / (b(time) - a(time))).otherwise(F.lit(0.0))
    out = {c: F.when(a(time).isNull(), b(c)).when(b(time).isNull(), a(c)).otherwise(a(c) + (b(c) - a(c)) * share) for c in values}
    return both.select(*[F.col(f"__id.{c}").alias(c) for c in at.columns], *[v.alias(c) for c, v in out.items()])


def lengths(track: DataFrame, coords: list[str], cut: float, time: str = "t") -> DataFrame:
    """The rows of one track with ``s``, the running length along ``coords`` in order of time, then coords."""
    rows = track.withColumn("__id", F.struct(*track.columns)).dropna(subset=[time, *coords]).select("__id", time, *coords).withColumn("__k", F.floor(F.col(time) / cut))
    near = saved(_neighbours(rows, rows, time, coords).select("__k", F.col("__before").alias("b")), "cuts")
    order = W.partitionBy("__k").orderBy(time, *coords)
    joined = rows.join(near, "__k")
    last = {c: F.coalesce(F.lag(c).over(order), F.col(f"b.{c}"), F.col(c)) for c in coords}
    step = F.sqrt(sum((F.col(c) - v) * (F.col(c) - v) for c, v in last.items()))
    stepped = saved(joined.withColumn("__step", step).select("__id", "__k", time, *coords, "__step"), "steps")
    sums = stepped.groupBy("__k").agg(F.sum("__step").alias("n"))
    before = F.coalesce(F.sum("n").over(W.orderBy("__k").rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))  # a row per cut
    both = stepped.join(sums.select("__k", before.alias("__s")), "__k")
    along = F.col("__s") + F.sum("__step").over(order.rowsBetween(W.unboundedPreceding, 0))
    return both.select(*[F.col(f"__id.{c}").alias(c) for c in track.columns], along.alias("s"))


@dataclass(frozen=True)
class Match:
    """``label``: the pairing that fits best; ``applied``: whether its residual passes the gate; ``residuals`` of all pairings."""

    label: str
    applied: bool
    residual: float
    scale: float
    turn: np.ndarray
    shift: np.ndarray
    residuals: dict[str, float] = field(default_factory=dict)


def pairings(photos: DataFrame, track: DataFrame, cut: float, share: float = 0.01) -> DataFrame:
    """(label, sx, sy, sz, tx, ty, tz): photo positions with the track's place by time, by time from a common start, and by share of the way, also backwards.

    ``photos`` and ``track``: x, y, z, t. By time only photos within the track's times are paired.
    ``cut``: units of time, ``share``: of the way, that are worked on together.
    """
    known = photos.select(*XYZ, "t").dropna(subset=list(XYZ))
    timed = track.select(*XYZ, "t").dropna()
    span = timed.agg(F.min("t").alias("t0"), F.max("t").alias("t1")).first()
    if span["t0"] is None:
        return photos.sparkSession.createDataFrame([], "label string, " + ", ".join(f"{p}{c} double" for p in "st" for c in XYZ))
    start = known.agg(F.min("t")).first()[0]
    source = {f"s{c}": F.col(c).cast("double") for c in XYZ}
    # the track's places under other names than the photos'
    places = timed.select("t", *[F.col(c).cast("double").alias(f"t{c}") for c in XYZ])
    out = []
    for label, move in (("time", 0), ("time from start", None if start is None else span["t0"] - start)):
        if move is None:
            continue
        asked = known.dropna().withColumn("t", F.col("t") + move).where(F.col("t").between(span["t0"], span["t1"])).select("t", *[v.alias(c) for c, v in source.items()])
        out.append(between(places, asked, [f"t{c}" for c in XYZ], cut).withColumn("label", F.lit(label)))
    way = saved(lengths(timed, list(XYZ), cut), "way")
    own = saved(lengths(known.dropna(), list(XYZ), cut), "own")
    ends = [df.agg(F.max("s")).first()[0] or 0.0 for df in (way, own)]
    shares = way.select((F.col("s") / max(ends[0], 1e-9)).alias("t"), *[F.col(c).cast("double").alias(f"t{c}") for c in XYZ]).groupBy("t").agg(*[F.first(f"t{c}").alias(f"t{c}") for c in XYZ])
    for label, place in (("way", F.col("s") / max(ends[1], 1e-9)), ("way backwards", 1 - F.col("s") / max(ends[1], 1e-9))):
        asked = own.select(place.alias("t"), *[v.alias(c) for c, v in source.items()])
        out.append(between(shares, asked, [f"t{c}" for c in XYZ], share).withColumn("label", F.lit(label)))
    whole = out[0]
    for x in out[1:]:
        whole = whole.unionByName(x)
    return whole.select("label", *[f"{p}{c}" for p in "st" for c in XYZ])


def match(photos: DataFrame, track: DataFrame, cut: float, least: int = 8, gate: tuple[float, float, float] = (0.15, 0.02, 1.0)) -> Match | None:
    """The similarity that carries photo positions onto the track: all pairings, rigid and scaled, are fitted from one pass of sums.

    A pairing counts with ``least`` photos; the least median residual wins, earlier pairings on ties.
    It is applied if that is at most the track's extent times ``gate[1]``, within gate[0] and gate[2].
    """
    pairs = saved(pairings(photos, track, cut), "pairings")
    means = [F.avg(f"{p}{c}").alias(f"{p}{c}") for p in "st" for c in XYZ]
    crossed = [F.covar_pop(f"t{a}", f"s{b}").alias(f"c{a}{b}") for a in XYZ for b in XYZ]
    spread = sum(F.var_pop(f"s{c}") for c in XYZ).alias("spread")
    fits: dict[str, tuple[float, np.ndarray, np.ndarray]] = {}
    rows = {r["label"]: r for r in pairs.groupBy("label").agg(F.count(F.lit(1)).alias("n"), *means, *crossed, spread).where(F.col("n") >= least).collect()}
    for label in ("time", "time from start", "way", "way backwards"):
        if label not in rows:
            continue
        r = rows[label]
        u, d, vt = np.linalg.svd(np.array([[r[f"c{a}{b}"] for b in XYZ] for a in XYZ]))
        flip = np.array([1.0, 1.0, np.sign(np.linalg.det(u) * np.linalg.det(vt)) or 1.0])
        turn = u @ np.diag(flip) @ vt
        s, t = (np.array([r[f"{p}{c}"] for c in XYZ]) for p in "st")
        scale = float((d * flip).sum() / max(r["spread"], 1e-12))
        fits[label] = (1.0, turn, t - turn @ s)
        if 1e-7 <= scale <= 1e7:
            fits[f"{label}, scaled"] = (scale, turn, t - scale * turn @ s)
    if not fits:
        return None
    gaps = []
    for name, (scale, turn, shift) in fits.items():
        moved = [sum(F.col(f"s{b}") * float(scale * turn[i, j]) for j, b in enumerate(XYZ)) + float(shift[i]) for i in range(3)]
        gap = F.sqrt(sum((m - F.col(f"t{c}")) * (m - F.col(f"t{c}")) for m, c in zip(moved, XYZ, strict=True)))
        gaps.append(F.percentile(F.when(F.col("label") == name.removesuffix(", scaled"), gap), 0.5).alias(name))
    residuals = pairs.agg(*gaps).first().asDict()
    best = None
    for name in fits:
        if best is None or residuals[name] < residuals[best] - 1e-6:
            best = name
    box = track.agg(*[(F.max(c) - F.min(c)).alias(c) for c in XYZ]).first()
    limit = min(gate[2], max(gate[0], gate[1] * math.sqrt(sum((x or 0.0) ** 2 for x in box))))
    return Match(best, residuals[best] <= limit, residuals[best], *fits[best], residuals)
