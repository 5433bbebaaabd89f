"""Outdoor scenes: terrain, height above ground, visibility buffers."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cloudloom.functions.linalg import moments, with_eigen
from cloudloom.operators.graph import grid_components
from cloudloom.operators.points import XYZ
from cloudloom.plans.scratch import saved


def terrain(points: DataFrame, cell: float = 0.5, share: float = 0.05, passes: int = 6) -> DataFrame:
    """(cx, cy, ground): per cell the point at index floor(share * n) of the sorted heights, then slope limits.

    Each pass lowers a cell to the least of its 3 x 3 neighbours plus one cell size; a
    3 x 3 median follows. Cells without points are not in it. A cell's heights are
    ranked in a window, not gathered.
    """
    from pyspark.sql import Window as W

    keyed = points.select(F.floor(F.col("x") / cell).alias("cx"), F.floor(F.col("y") / cell).alias("cy"), "z")
    w = W.partitionBy("cx", "cy")
    ranked = keyed.select("cx", "cy", "z", F.row_number().over(w.orderBy("z")).alias("rk"), F.count(F.lit(1)).over(w).alias("n"))
    at = F.least(F.floor(F.col("n") * share), F.col("n") - 1) + 1
    grid = ranked.where(F.col("rk") == at).select("cx", "cy", F.col("z").alias("ground"))
    for _ in range(passes):
        low = spread(grid).groupBy("cx", "cy").agg(F.min("near").alias("low"))
        grid = grid.join(low, ["cx", "cy"]).select("cx", "cy", F.least("ground", F.col("low") + cell).alias("ground"))
    middle = spread(grid).groupBy("cx", "cy").agg(F.percentile("near", F.lit(0.5)).alias("ground"))
    return grid.select("cx", "cy").join(middle, ["cx", "cy"])


def spread(grid: DataFrame) -> DataFrame:
    """Every cell's value handed to itself and its eight neighbours."""
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    to = grid.withColumn("o", F.explode(steps))
    return to.select((F.col("cx") + F.col("o.i")).alias("cx"), (F.col("cy") + F.col("o.j")).alias("cy"), F.col("ground").alias("near"))


def height_above(points: DataFrame, ground: DataFrame, cell: float = 0.5) -> DataFrame:
    """pid and z minus the ground of its cell."""
    keyed = points.withColumns({"cx": F.floor(F.col("x") / cell), "cy": F.floor(F.col("y") / cell)})
    return keyed.join(ground, ["cx", "cy"]).select("pid", (F.col("z") - F.col("ground")).alias("height"))


def z_buffer(points: DataFrame, pixel: float, depth: str = "z") -> DataFrame:
    """Per pixel of the x-y view the foremost point: a map-side combined minimum, no sort."""
    keyed = points.withColumns({"px": F.floor(F.col("x") / pixel), "py": F.floor(F.col("y") / pixel)})
    best = F.max_by(F.struct("pid", depth), F.struct(F.col(depth), -F.col("pid")))
    return keyed.groupBy("px", "py").agg(best.alias("b"), F.count(F.lit(1)).alias("hits")).select("px", "py", "b.pid", F.col(f"b.{depth}").alias("depth"), "hits")


def _whole(scaled: np.ndarray, again: Callable[[int], float]) -> np.ndarray:
    """Whole parts. What lies next to a whole number is worked out ``again``, one by one in the C library: arrays may differ from it in the last bit."""
    out = np.floor(scaled).astype(np.int64)
    for k in np.flatnonzero(np.abs(scaled - np.rint(scaled)) < 1e-9).tolist():
        out[k] = math.floor(again(k))
    return out


def _rays(at: np.ndarray, view: np.ndarray, az: int, el: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Range, cell of azimuth and of elevation of points (rows) seen from ``view``."""
    d = at - view
    r = np.sqrt(d[:, 0] * d[:, 0] + d[:, 1] * d[:, 1] + d[:, 2] * d[:, 2])
    up = np.clip(d[:, 2] / np.maximum(r, 1e-6), -1, 1)
    turned = lambda t: (t + math.pi) / (2 * math.pi) * az
    lifted = lambda t: (t + math.pi / 2) / math.pi * el
    a = _whole(turned(np.arctan2(d[:, 1], d[:, 0])), lambda k: turned(math.atan2(d[k, 1], d[k, 0])))
    e = _whole(lifted(np.arcsin(up)), lambda k: lifted(math.asin(up[k])))
    return r, np.minimum(a, az - 1), np.minimum(e, el - 1)


def carve_votes(points: DataFrame, view: tuple[float, float, float], az: int = 512, el: int = 160) -> DataFrame:
    """pid and whether the view's ray to it passes on to a surface farther off.

    Rays are cells of azimuth and elevation; the surface is the 60th percentile of the
    cell's ranges, in cells of six points at least; a point nearer than it by more than
    max(0.25, 5 %) was passed through.
    """
    place = np.array(view, dtype=np.float64)

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            r, a, e = _rays(np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in XYZ]), place, az, el)
            there = np.flatnonzero(r > 0)
            yield pa.RecordBatch.from_arrays([batch.column("pid").take(pa.array(there)), *[pa.array(x[there]) for x in (r, a, e)]], names=["pid", "r", "az", "el"])

    kind = points.schema["pid"].dataType.simpleString()
    known = points.select("pid", *[F.col(c).cast("double").alias(c) for c in XYZ]).dropna(subset=list(XYZ))
    at = known.mapInArrow(seen, f"pid {kind}, r double, az long, el long")
    wall = at.groupBy("az", "el").agg(F.percentile("r", F.lit(0.6)).alias("c"), F.count(F.lit(1)).alias("n")).where("n >= 6")
    both = at.join(wall, ["az", "el"])
    return both.select("pid", (F.col("r") < F.col("c") - F.greatest(F.lit(0.25), F.col("c") * 0.05)).alias("passed"))


#: The grid of rays and depths of a view: cells of azimuth and elevation, logarithmic buckets of range between the limits.
RAYS_AZ, RAYS_EL, DEPTHS, NEAREST, FARTHEST = 512, 160, 96, 0.8, 120.0
NOBODY = 255


def _ray_cells(at: np.ndarray, view: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Range, ray cell and depth bucket of points (rows) seen from ``view``, and which are in range."""
    r, az, el = _rays(at, view, RAYS_AZ, RAYS_EL)
    ok = (r > NEAREST) & (r < FARTHEST)
    near = math.log(NEAREST)
    scaled = lambda t: (t - near) / (math.log(FARTHEST) - near) * DEPTHS
    held = np.where(ok, r, NEAREST * 2)
    bucket = _whole(scaled(np.log(held)), lambda k: scaled(math.log(held[k])))
    return r, az * RAYS_EL + el, np.minimum(bucket, DEPTHS - 1), ok


def spread_views(views: DataFrame, most: int = 110) -> list[tuple[float, float, float]]:
    """Positions (pid, x, y, z in order of pid) of a track, at most ``most`` of them, evenly spread by number."""
    known = views.dropna(subset=["pid", *XYZ])
    n = known.count()
    if n > most:
        wanted = [int(k * (n - 1) / (most - 1)) for k in range(most)]
        # numbered by ranges of pid: no task holds the track
        ranged = saved(known.select("pid", *XYZ).repartitionByRange("pid").sortWithinPartitions("pid", *XYZ).withColumn("__p", F.spark_partition_id()), "track")
        sizes = {r["__p"]: r["count"] for r in ranged.groupBy("__p").count().collect()}
        before = dict(zip(sorted(sizes), np.cumsum([0] + [sizes[p] for p in sorted(sizes)]).tolist(), strict=False))
        start = F.element_at(F.create_map(*[F.lit(x) for kv in before.items() for x in kv]), F.col("__p"))
        place = start + F.row_number().over(W.partitionBy("__p").orderBy("pid", *XYZ)) - 1
        known = ranged.withColumn("__at", place).where(F.col("__at").isin(wanted))
    return [tuple(r) for r in known.orderBy("pid").select(*XYZ).collect()]


def carve_views(points: DataFrame, views: DataFrame, most_views: int = 110, least: int = 3, quantile: float = 0.6, slack: float = 0.1) -> DataFrame:
    """(pid, passed, held, ghost) of points (pid, x, y, z): views whose ray passes through the point, views whose surface it lies on.

    Each of up to ``most_views`` views has a histogram of log-depths per ray cell; the bucket that
    reaches ``quantile`` of a cell of six points or more is its surface. A point nearer than that
    by more than max(0.25, 5 %) is passed, one within max(0.12, slack + 2 %) holds; it is a ghost
    if at least ``least`` views pass it and more than twice as many as hold it. The histograms are
    summed by Spark; the surfaces, a byte per view and cell (9 MB at most), go to every task, so
    points never move. Rows with a null coordinate are left out; without views nothing is passed.
    """
    spark = points.sparkSession
    at = np.array(spread_views(views, most_views)).reshape(-1, 3)
    known = points.dropna(subset=list(XYZ)).select("pid", *XYZ)
    cells = RAYS_AZ * RAYS_EL

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in XYZ])
            for k, view in enumerate(at):
                _, cell, bucket, ok = _ray_cells(p, view)
                key, n = np.unique((k * cells + cell[ok]) * DEPTHS + bucket[ok], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n.astype(np.int64))], names=["key", "n"])

    counts = known.select(*XYZ).mapInArrow(seen, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    counts = counts.select(F.expr(f"key div {DEPTHS}").alias("ray"), (F.col("key") % DEPTHS).cast("int").alias("bucket"), "n")
    over = W.partitionBy("ray").orderBy("bucket")
    upto, total = F.sum("n").over(over), F.sum("n").over(W.partitionBy("ray"))  # at most as many rows as buckets
    reached = counts.select("ray", "bucket", upto.alias("upto"), total.alias("total")).where("total >= 6")
    # the first bucket with at least floor(quantile x total) points up to it
    surface = reached.where(F.col("upto") >= F.floor(F.col("total") * quantile)).groupBy("ray").agg(F.min("bucket").alias("bucket"))
    packed = surface.select(F.expr(f"ray div {cells}").alias("view"), (F.col("ray") % cells).cast("int").alias("cell"), "bucket")

    def bytes_of(own: pa.Table) -> pa.Table:
        row = np.full(cells, NOBODY, np.uint8)
        row[own.column("cell").to_numpy()] = own.column("bucket").to_numpy()
        return pa.table({"view": own.column("view").slice(0, 1), "row": [row.tobytes()]})

    table = np.full((max(1, len(at)), cells), NOBODY, np.uint8)
    for r in packed.groupBy("view").applyInArrow(bytes_of, "view long, row binary").collect():
        table[r["view"]] = np.frombuffer(r["row"], np.uint8)
    sent = spark.sparkContext.broadcast(table)

    def voted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = math.log(FARTHEST) - math.log(NEAREST)
        far = np.exp(math.log(NEAREST) + np.arange(NOBODY + 1) / DEPTHS * span)
        for batch in batches:
            p = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in XYZ])
            passed, held = np.zeros(len(p), np.int64), np.zeros(len(p), np.int64)
            for k, view in enumerate(at):
                r, cell, _, ok = _ray_cells(p, view)
                bucket = sent.value[k, cell]
                there, surface = ok & (bucket != NOBODY), far[bucket]
                passed += there & (r < surface - np.maximum(0.25, 0.05 * surface))
                held += there & (np.abs(r - surface) <= np.maximum(slack + 0.02 * surface, 0.12))
            ghost = (passed >= least) & (passed > 2 * held)
            yield pa.RecordBatch.from_arrays([batch.column("pid"), pa.array(passed), pa.array(held), pa.array(ghost)], names=["pid", "passed", "held", "ghost"])

    kind = known.schema["pid"].dataType.simpleString()
    return known.mapInArrow(voted, f"pid {kind}, passed long, held long, ghost boolean")


def classify(points: DataFrame, cell: float = 0.5, band: float = 0.2, voxel: float = 0.3, least: int = 40) -> DataFrame:
    """(pid, class) of points with x, y, z and, where known, r, g, b: ground, vehicle, vegetation, bars or rest.

    Ground lies less than ``band`` above the terrain. What is above falls into connected clusters
    of ``voxel`` cells, judged by their extent, shape and greenness; a point whose cell has no
    terrain is rest, and so are clusters of fewer than ``least`` points. Shapes come from
    aggregates, so a cluster may be as large as it likes.
    """
    ground = saved(terrain(points, cell), "terrain")
    high = saved(points.join(height_above(points, ground, cell), "pid", "left"), "heights")
    above = high.where(F.coalesce(F.col("height") >= band, F.lit(True)))
    labels = saved(grid_components(above.select("pid", "x", "y", "z"), voxel), "clusters")
    own = above.join(labels, "pid")
    green = (F.col("g") * 2 - F.col("r") - F.col("b") > 24).cast("double") if {"r", "g", "b"} <= set(points.columns) else F.lit(0.0)
    shape = with_eigen(moments(own, "label"))
    shape = saved(shape.select("label", "n", *[F.sqrt(F.greatest(F.col(c), F.lit(1e-12))).alias(c) for c in ("l1", "l2", "l3")]), "shapes")
    box = own.groupBy("label").agg(*[(F.max(c) - F.min(c)).alias(f"e{c}") for c in "xyz"], F.min("height").alias("low"), F.avg(green).alias("green"))
    f = shape.join(box, "label")
    foot = F.sqrt(F.col("ex") * F.col("ex") + F.col("ey") * F.col("ey"))
    linear, round_ = (F.col("l1") - F.col("l2")) / F.col("l1"), F.col("l3") / F.col("l1")
    kind = (
        F.when(F.col("n") < least, "rest").when(F.col("green") > 0.3, "vegetation")
        .when((foot > 12) | (F.col("ez") > 6) | (F.col("n") > 600_000), "rest")
        .when((round_ > 0.35) & (F.col("ez") > 0.8) & (F.col("green") > 0.12), "vegetation")
        .when((F.col("low") < 0.6) & F.col("ez").between(1, 3.2) & foot.between(1.4, 8) & (linear < 0.9) & (F.col("n") > 1_500), "vehicle")
        .when((linear > 0.85) | (F.least("ex", "ey") < 0.35), "bars").otherwise("rest")
    )
    named = labels.join(f.select("label", kind.alias("class")), "label").select("pid", "class")
    return high.where(F.col("height") < band).select("pid", F.lit("ground").alias("class")).unionByName(named)


_CROSS = ((0, 0), (1, 0), (-1, 0), (0, 1), (0, -1))


def closed_cells(cells: DataFrame, times: int = 2) -> DataFrame:
    """Cells (cx, cy) grown and shrunk again ``times`` cells through their four neighbours: small gaps are filled."""
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in _CROSS])

    def around(x: DataFrame) -> DataFrame:
        return x.withColumn("o", F.explode(steps)).select((F.col("cx") + F.col("o.i")).alias("cx"), (F.col("cy") + F.col("o.j")).alias("cy"))

    cells = cells.select("cx", "cy").distinct()
    for _ in range(times):
        cells = around(cells).distinct()
    for _ in range(times):
        whole = around(cells).groupBy("cx", "cy").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(_CROSS))
        cells = whole.select("cx", "cy")
    return cells


def terrain_mesh(points: DataFrame, cell: float = 0.25) -> tuple[DataFrame, DataFrame]:
    """(faces, vertices) of a grid over the observed cells of ground points; a vertex has the mean height of the cells around it."""
    ground = saved(terrain(points, cell), "terrain")
    seen = closed_cells(ground)
    filled = spread(ground).groupBy("cx", "cy").agg(F.avg("near").alias("guess"))
    grid = saved(seen.join(ground, ["cx", "cy"], "left").join(filled, ["cx", "cy"], "left").select("cx", "cy", F.coalesce("ground", "guess").alias("ground")).dropna(), "grid")
    vid = lambda i, j: F.shiftleft(F.col("cx") + i + (1 << 30), 31) + F.col("cy") + j + (1 << 30)
    corner = F.array(*[F.struct(vid(i, j).alias("vid"), ((F.col("cx") + i) * cell).alias("x"), ((F.col("cy") + j) * cell).alias("y")) for i in (0, 1) for j in (0, 1)])
    ends = grid.select(F.explode(corner).alias("v"), "ground").select("v.*", "ground")
    vertices = ends.groupBy("vid").agg(F.first("x").alias("x"), F.first("y").alias("y"), F.avg("ground").alias("z"))
    pair = F.array(F.struct(vid(0, 0).alias("a"), vid(1, 0).alias("b"), vid(1, 1).alias("c"), F.lit(0).alias("k")), F.struct(vid(0, 0).alias("a"), vid(1, 1).alias("b"), vid(0, 1).alias("c"), F.lit(1).alias("k")))
    faces = grid.select(F.explode(pair).alias("f")).select((F.col("f.a") * 2 + F.col("f.k")).alias("fid"), "f.a", "f.b", "f.c", F.lit(0).alias("group_id"))
    return faces, vertices
