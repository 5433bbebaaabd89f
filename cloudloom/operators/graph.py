"""Connected components by alternating large and small stars; no graph is collected.

Edges are laid out by ranges of their larger node first, and every task contracts what is
connected within its range, up to ``CHUNK`` edges at a time: where numbers follow places, as
those of grid cells do, only the seams between ranges are left for the rounds.

Edge cases: edges with a null end and loops connect nothing; a node without edges is its own
component; repeated nodes and edges count once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloudloom.plans.scratch import saved


def joined(rows: DataFrame, own: DataFrame, key: str, times: str, total: int, share: int = 256) -> DataFrame:
    """``rows`` with the columns of ``own``, which has a row per ``key`` and in ``times`` how many of ``rows`` have it.

    ``total``: how many rows there are, or more. Keys of more than one in ``share`` of them number
    fewer than ``share``, so they are sent to every task and their rows stay where they lie. Up to a
    million rows one task can hold any key.
    """
    if total <= 1 << 20:
        return rows.join(own.drop(times).hint("merge"), key)
    hot, rest = (own.where(F.col(times) * share > total).drop(times), own.where(F.col(times) * share <= total).drop(times))
    return rows.join(F.broadcast(hot), key).unionByName(rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(rest.hint("merge"), key))


#: Edges contracted at once.
CHUNK = 1 << 20


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node reachable) of the nodes of the edges that reach a smaller one: smallest labels go over the edges, and to the labels' own nodes."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    i, j = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        for to in (i, j, label[i], label[j]):
            np.minimum.at(new, to, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = np.flatnonzero(label < np.arange(len(nodes)))
    return nodes[moved], nodes[label[moved]]


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for batch in batches:
        held.append(tuple(c.to_numpy(zero_copy_only=False) for c in batch.columns))
        if sum(len(x[0]) for x in held) >= CHUNK:
            # what is contracted takes part again, so the task ends with one star per component of its range
            held = [stars(*(np.concatenate(x) for x in zip(*held, strict=True)))]
            if 2 * len(held[0][0]) >= CHUNK:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in held.pop()], names=["a", "b"])
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in stars(*(np.concatenate(x) for x in zip(*held, strict=True)))], names=["a", "b"])


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable from each node by edges (a, b)."""
    down = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    if dict(down.dtypes)["a"] == "bigint":
        down = down.repartitionByRange("a").mapInArrow(_contracted, "a long, b long")
    e = saved(down.distinct(), "edges")
    mark = lambda x: tuple(x.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    before = mark(e)
    while before[0]:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count(F.lit(1)).alias("n"))
        large = saved(joined(both, low, "a", "n", 2 * before[0]).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "large")
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
        small = joined(large, least, "a", "n", 2 * before[0]).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = saved(least.select("a", F.col("m").alias("b")).unionByName(small).distinct(), "small")
        after = mark(e)
        if after == before:
            break
        before = after
    found = e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.select("node").distinct().join(found.hint("merge"), "node", "left").select("node", F.coalesce("root", "node").alias("root"))


def grid_components(points: DataFrame, size: float, faces_only: bool = False) -> DataFrame:
    """pid, label: components of occupied cells under 26 (or 6) neighbours; a label is its smallest cell."""
    from cloudloom.operators.points import XYZ, _offsets, extent, with_cell

    # a cell as one number, 21 bits an axis
    code = F.expr("shiftleft(cx, 42) + shiftleft(cy, 21) + cz")
    keyed = with_cell(points, size, extent(points)).withColumn("node", code)
    cells = keyed.select("node", "cx", "cy", "cz").distinct()
    to = cells.withColumn("o", F.explode(_offsets()))
    if faces_only:
        to = to.where(F.abs("o.i") + F.abs("o.j") + F.abs("o.k") <= 1)
    to = to.select(F.col("node").alias("a"), F.expr("shiftleft(cx + o.i, 42) + shiftleft(cy + o.j, 21) + cz + o.k").alias("b"), *[F.col(f"c{n}") for n in XYZ])
    there = cells.select(F.col("node").alias("b"))
    found = components(cells, to.select("a", "b").where("a > b").join(there.hint("merge"), "b"))
    return keyed.join(found.hint("merge"), "node").select("pid", F.col("root").alias("label"))


def largest_component(points: DataFrame, size: float) -> DataFrame:
    """The points of the component with most points, the lowest label on ties."""
    labels = saved(grid_components(points, size), "labels")
    best = labels.groupBy("label").agg(F.count(F.lit(1)).alias("n")).agg(F.max_by("label", F.struct("n", -F.col("label"))).alias("label"))
    keep = labels.join(F.broadcast(best), "label", "left_semi").select("pid")  # one row
    return points.join(keep.hint("merge"), "pid", "left_semi")
