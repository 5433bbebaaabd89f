"""Thinning to a budget of points by Morton codes, in three passes over the cloud.

A point's code interleaves the bits of its place in the scene's box, 21 an axis, so a code's
first bits name the cell it lies in at any of 63 levels, each halving the cells of the level
before along one axis. The codes are range-partitioned and sorted once; how many first bits
neighbouring codes share says at which level they part, so one histogram gives the occupied
cells of all levels. The finest level within the budget is taken, and as many of its cells,
in order of a thousand buckets of a hash, go one level deeper as the budget still holds. Every
cell keeps one measured point, that of the lowest pid.

Edge cases: rows with a null coordinate are left out; a null pid comes last in its cell;
equal points share a cell at every level, so one of them stays; a budget of all cells or more
keeps every distinct place of the finest grid; a budget of zero keeps nothing; an empty cloud
gives no rows. Columns of the input stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cloudloom.operators.points import XYZ, extent

#: Bits an axis, and of a code.
AXIS, BITS = 21, 63
#: Shifts and masks that spread 21 bits to every third place (fixed values).
SPREAD = [(32, 0x1F00000000FFFF), (16, 0x1F0000FF0000FF), (8, 0x100F00F00F00F00F), (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249)]


def spread(x: Column) -> Column:
    """The lowest 21 bits of ``x``, two empty places after each."""
    for shift, mask in SPREAD:
        x = x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(F.lit(mask))
    return x


def morton(points: DataFrame, low: tuple[float, float, float], size: float) -> Column:
    """Code of each point in the cube of side ``size`` from ``low``; the cube's far sides belong to the last cells."""
    whole = 1 << AXIS
    cells = [F.least(F.greatest(F.floor((F.col(c) - a) / size * whole), F.lit(0)), F.lit(whole - 1)).cast("long") for c, a in zip(XYZ, low, strict=True)]
    x, y, z = (spread(c) for c in cells)
    return F.shiftleft(x, 2).bitwiseOR(F.shiftleft(y, 1)).bitwiseOR(z)


def cube(points: DataFrame) -> tuple[tuple[float, float, float], float] | None:
    """Lowest corner and side of the cube around a cloud; none without points."""
    box = extent(points.select(*XYZ).dropna()).first()
    if not box["n"]:
        return None
    side = max(box[f"{c}_max"] - box[f"{c}_min"] for c in XYZ)
    return tuple(box[f"{c}_min"] for c in XYZ), side or 1.0


def cells_by_level(codes: DataFrame) -> list[int]:
    """Occupied cells at each level 0 to 63 of a relation of codes (code)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, first, last = np.zeros(BITS + 1, np.int64), None, None
        for batch in batches:
            c = batch.column(0).to_numpy(zero_copy_only=False)
            if not len(c):
                continue
            first = int(c[0]) if first is None else first
            differ = c[1:] ^ c[:-1] if last is None else c ^ np.concatenate(([last], c[:-1]))
            differ = differ[differ != 0]
            # the level at which two codes part: 63 less the place of the highest bit in which they differ
            high = np.frexp((differ >> 32).astype(np.float64))[1] + 32
            low = np.frexp((differ & 0xFFFFFFFF).astype(np.float64))[1]
            place = np.where(differ >> 32 != 0, high, low)
            parts += np.bincount(BITS + 1 - place, minlength=BITS + 1)
            last = int(c[-1])
        if first is not None:
            yield pa.RecordBatch.from_arrays([pa.array([first]), pa.array([last]), pa.array([parts.tolist()], pa.list_(pa.int64()))], names=["first", "last", "parts"])

    each = codes.select("code").repartitionByRange("code").sortWithinPartitions("code")
    told = each.mapInArrow(run, "first long, last long, parts array<bigint>")
    # a row per partition; neighbours part where one ends and the next begins
    seam = told.withColumn("before", F.lag("last").over(W.orderBy("first")))
    seam = seam.withColumn("differ", F.expr("first ^ before"))
    at = F.when(F.coalesce("differ", F.lit(0)) != 0, F.lit(BITS + 1) - F.length(F.bin("differ")))
    rows = seam.select(at.alias("at"), F.posexplode("parts").alias("level", "n"))
    sums = rows.groupBy("level").agg((F.sum("n") + F.count_if(F.col("at") == F.col("level"))).alias("n"))
    found = {r["level"]: r["n"] for r in sums.collect()}
    return [int(x) for x in np.cumsum([bool(found)] + [found.get(k, 0) for k in range(1, BITS + 1)])]


def cell_hash(cell: Column) -> Column:
    """A number from 0 to 999,999 for a cell, the same in every engine."""
    return (F.pmod(cell, F.lit(1_000_003)) * 7919 + F.pmod(F.shiftright(cell, 20), F.lit(999_983)) * 104_729 + 13) % 1_000_000


def budget_points(points: DataFrame, target: int) -> DataFrame:
    """At most ``target`` measured points of a cloud (pid, x, y, z, ...), spread evenly, nearly all of the budget used; all places if there are fewer."""
    whole = points.where(" and ".join(f"{c} is not null" for c in XYZ))
    at = cube(whole)
    if at is None or target < 1:
        return whole.limit(0)
    # the row as a whole, so that no column of it can clash
    first = F.struct(F.col("pid").isNull(), F.col("pid"), *XYZ)
    coded = whole.select(F.struct(*points.columns).alias("p"), first.alias("first"), morton(whole, *at).alias("code"))
    counts = cells_by_level(coded)
    level = max(k for k, n in enumerate(counts) if n <= target)
    cell = F.shiftright("code", BITS - level) if level else F.lit(0).cast("long")
    deeper = F.lit(False)
    if level < BITS:
        # a cell whose points part at the next level takes one more of the budget if it goes deeper
        half = F.shiftright("code", BITS - level - 1)
        more = coded.groupBy(cell.alias("cell")).agg((F.min(half) != F.max(half)).cast("long").alias("more"))
        buckets = more.groupBy(F.floor(cell_hash(F.col("cell")) / 1_000).alias("bucket")).agg(F.sum("more").alias("more")).collect()  # a thousand rows
        room, limit = target - counts[level], 1_000
        for r in sorted(buckets, key=lambda r: r["bucket"]):
            room -= r["more"]
            if room < 0:
                limit = r["bucket"]
                break
        deeper = cell_hash(cell) < 1_000 * limit
        cell = F.when(deeper, half).otherwise(cell)
    best = coded.groupBy(deeper.alias("deeper"), cell.alias("cell")).agg(F.min_by("p", "first").alias("p"))
    return best.select("p.*")
