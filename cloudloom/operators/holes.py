"""Boundary loops of meshes and the closing of small holes on planes.

An edge with one face is a step of a loop, against the face's turn. Loops are traced by
pointer jumping: every vertex doubles its pointer each round and learns the lowest vertex it
has passed, so a loop of any length is known by its lowest vertex, and each vertex by its
steps to it, after rounds that grow with the logarithm of the length. No task holds a loop.

Edge cases: vertices that more than one loop passes break theirs, as do open chains; such
steps are in no loop. Repeated faces bound nothing; a mesh without open edges has no loops.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cloudloom.operators.points import XYZ
from cloudloom.plans.scratch import saved


def steps(faces: DataFrame) -> DataFrame:
    """(u, v): open edges, directed so that a face on the other side would turn as its neighbours do; clean vertices only."""
    sides = F.array(*[F.struct(F.col(p).alias("u"), F.col(q).alias("v")) for p, q in (("b", "a"), ("c", "b"), ("a", "c"))])
    half = faces.select(F.explode(sides).alias("e")).select("e.u", "e.v")
    count = half.groupBy(F.least("u", "v").alias("p"), F.greatest("u", "v").alias("q")).agg(F.count(F.lit(1)).alias("n"), F.first("u").alias("u"), F.first("v").alias("v"))
    single = saved(count.where("n = 1").select("u", "v"), "single")
    ends = single.select(F.explode(F.array("u", "v")).alias("x")).groupBy("x").agg(F.count(F.lit(1)).alias("n")).where("n = 2").select("x")
    leaves = single.groupBy("u").agg(F.count(F.lit(1)).alias("n")).where("n = 1").select(F.col("u").alias("x"))
    clean = saved(ends.join(leaves.hint("merge"), "x", "left_semi"), "clean")
    return single.join(clean.select(F.col("x").alias("u")).hint("merge"), "u", "left_semi").join(clean.select(F.col("x").alias("v")).hint("merge"), "v", "left_semi")


def loops(faces: DataFrame) -> DataFrame:
    """(loop, vid, place, n): closed boundary loops, named by their lowest vertex, their vertices in order from it."""
    step = saved(steps(faces), "steps")
    # to: where 2^k steps lead; low: the lowest vertex on the way; open chains run out of pointers
    now = saved(step.select(F.col("u").alias("vid"), F.col("v").alias("to"), F.least("u", "v").alias("low")), "jump")
    before = None
    while True:
        ahead = now.select(F.col("vid").alias("to"), F.col("to").alias("to2"), F.col("low").alias("low2"))
        now = saved(now.join(ahead.hint("merge"), "to").select("vid", F.col("to2").alias("to"), F.least("low", "low2").alias("low")), "jump")
        after = tuple(now.agg(F.count(F.lit(1)), F.sum(F.col("low").cast("decimal(38,0)"))).first())
        if after == before:
            break
        before = after
    own = now.select("vid", F.col("low").alias("loop"))
    # steps to the loop's lowest vertex, again by doubling; there the way ends
    rank = step.select(F.col("u").alias("vid"), F.col("v").alias("to")).join(own.hint("merge"), "vid")
    rank = saved(rank.select("vid", "loop", F.when(F.col("vid") == F.col("loop"), F.col("vid")).otherwise(F.col("to")).alias("to"), (F.col("vid") != F.col("loop")).cast("long").alias("far")), "rank")
    while not rank.where("to <> loop").isEmpty():
        ahead = rank.select(F.col("vid").alias("to"), F.col("to").alias("to2"), F.col("far").alias("far2"))
        rank = saved(rank.join(ahead.hint("merge"), "to").select("vid", "loop", F.col("to2").alias("to"), (F.col("far") + F.col("far2")).alias("far")), "rank")
    sizes = rank.groupBy("loop").agg(F.count(F.lit(1)).alias("n"))
    return rank.join(sizes.hint("merge"), "loop").select("loop", "vid", F.when(F.col("far") == 0, 0).otherwise(F.col("n") - F.col("far")).cast("long").alias("place"), "n")


def close_planar(
    faces: DataFrame, vertices: DataFrame, planes: DataFrame, most: float = 1.0, off: float = 0.06, margin: float = 0.3, share: float = 0.8, longest: int = 300
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(new faces, new vertices, holes): fans that close the holes of at most ``most`` across that lie on a plane.

    ``planes``: plane_id, nx, ny, nz, d and the box x0 .. z1 of its outline. A hole lies on the first
    plane that ``share`` of its vertices are within ``off`` of and, widened by ``margin``, in the box
    of. The fan's middle is the mean of the hole's vertices, moved onto the plane; it takes its
    number from behind the largest vertex, in order of the holes.
    """
    found = saved(loops(faces), "loops")
    held = found.where((F.col("n") >= 4) & (F.col("n") <= longest)).join(vertices.select("vid", *XYZ).hint("merge"), "vid")
    size = F.sqrt(sum((F.max(c) - F.min(c)) * (F.max(c) - F.min(c)) for c in XYZ))
    holes = saved(held.groupBy("loop", "n").agg(size.alias("across"), *[F.avg(c).alias(c) for c in XYZ]).where(F.col("across") <= most), "holes")
    small = held.join(holes.select("loop").hint("merge"), "loop", "left_semi")
    at = small.join(F.broadcast(planes), F.lit(True))  # planes of a model, corners of small holes only
    gap = F.abs(sum(F.col(f"n{c}") * F.col(c) for c in XYZ) + F.col("d"))
    inside = F.lit(True)
    for c in XYZ:
        inside = inside & (F.col(c) >= F.col(f"{c}0") - margin) & (F.col(c) <= F.col(f"{c}1") + margin)
    fits = at.groupBy("loop", "plane_id").agg(F.avg((gap < off).cast("double")).alias("near"), F.avg(inside.cast("double")).alias("within"))
    fits = fits.where((F.col("near") >= share) & (F.col("within") >= share)).groupBy("loop").agg(F.min("plane_id").alias("plane_id"))
    placed = holes.join(fits.hint("merge"), "loop").join(F.broadcast(planes.select("plane_id", "nx", "ny", "nz", "d")), "plane_id")  # planes of a model
    lift = sum(F.col(f"n{c}") * F.col(c) for c in XYZ) + F.col("d")
    placed = saved(placed.select("loop", "plane_id", "n", "across", *[(F.col(c) - lift * F.col(f"n{c}")).alias(c) for c in XYZ]), "placed")
    top = vertices.agg(F.max("vid")).first()[0] or 0
    ranged = placed.repartitionByRange("loop").sortWithinPartitions("loop").withColumn("__p", F.spark_partition_id())
    ranged = saved(ranged, "ranged")
    sizes = ranged.groupBy("__p").agg(F.count(F.lit(1)).alias("k"))
    before = F.coalesce(F.sum("k").over(W.orderBy("__p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # a row per partition
    numbered = ranged.join(F.broadcast(sizes.select("__p", before.alias("__b"))), "__p")
    numbered = numbered.withColumn("vid", F.lit(top) + F.col("__b") + F.row_number().over(W.partitionBy("__p").orderBy("loop")))
    middles = saved(numbered.select("loop", "vid", "plane_id", "n", "across", *XYZ), "middles")
    ring = found.join(middles.select("loop", F.col("vid").alias("a")).hint("merge"), "loop")
    after = ring.select("loop", ((F.col("place") - 1 + F.col("n")) % F.col("n")).alias("place"), F.col("vid").alias("c"))
    fans = ring.select("loop", "place", "a", F.col("vid").alias("b")).join(after.hint("merge"), ["loop", "place"])
    return fans.select(F.xxhash64("loop", "place").alias("fid"), "a", "b", "c"), middles.select("vid", *XYZ), middles
