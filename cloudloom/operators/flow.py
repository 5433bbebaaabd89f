"""Minimum cuts of graphs held as relations, by rounds of pushes along shortest ways.

Nodes carry a surplus (what it costs to cut them off from the inside) or a deficit. Each
round labels nodes with their distance to a deficit over arcs with room left, then pushes
surplus one level down at a time, all nodes of a level at once: a node shares its surplus
out over its arcs by a running sum of their room. When no surplus can reach a deficit, what
the rest of it still reaches is the inside. Nothing of the graph is collected but counts.

Edge cases: nodes without arcs are inside if their gain is positive; arcs that are null,
loops or without room count for nothing; repeated arcs add up; no nodes give no rows. Of
several smallest cuts the one with the fewest nodes inside is given. Capacities and gains are
whole numbers, so the rounds end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cloudloom.plans.scratch import saved


def _reached(nodes: DataFrame, arcs: DataFrame, start: str, backwards: bool) -> DataFrame:
    """(node, far): steps from the nodes that satisfy ``start`` over arcs with room, against their direction if ``backwards``."""
    step = arcs.where("room > 0").select(*([F.col("v").alias("a"), F.col("u").alias("b")] if backwards else [F.col("u").alias("a"), F.col("v").alias("b")]))
    edge = found = nodes.where(start).select("node", F.lit(0).alias("far"))
    far = 0
    while True:
        far += 1
        new = edge.join(step, F.col("node") == F.col("a")).select(F.col("b").alias("node")).distinct()
        edge = saved(new.join(found, "node", "left_anti").withColumn("far", F.lit(far)), "edge")
        if edge.isEmpty():
            return found
        found = found.unionByName(edge)


def _pushed(nodes: DataFrame, arcs: DataFrame, level: int) -> tuple[DataFrame, DataFrame]:
    """Nodes and arcs after all surplus of one level went down as far as the arcs have room."""
    above = nodes.where((F.col("far") == level) & (F.col("gain") > 0)).select(F.col("node").alias("u"), "gain")
    below = nodes.where(F.col("far") == level - 1).select(F.col("node").alias("v"))
    ways = arcs.where("room > 0").join(above, "u").join(below, "v")
    before = F.coalesce(F.sum("room").over(W.partitionBy("u").orderBy("v").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sent = saved(ways.select("u", "v", F.greatest(F.lit(0), F.least(F.col("room"), F.col("gain") - before)).alias("sent")).where("sent > 0"), "sent")
    change = sent.unionByName(sent.select(F.col("v").alias("u"), F.col("u").alias("v"), (-F.col("sent")).alias("sent")))
    arcs = arcs.join(change, ["u", "v"], "left").select("u", "v", (F.col("room") - F.coalesce("sent", F.lit(0))).alias("room"))
    moved = change.groupBy(F.col("u").alias("node")).agg(F.sum("sent").alias("sent"))
    nodes = nodes.join(moved, "node", "left").select("node", (F.col("gain") - F.coalesce("sent", F.lit(0))).alias("gain"), "far")
    return saved(nodes, "nodes"), saved(arcs, "arcs")


def min_cut(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, inside) of least cost: gains (node, gain) lost plus capacities of edges (a, b, capacity) between inside and outside.

    A node outside loses its gain if that is positive, one inside its gain's size if negative.
    """
    both = edges.where("a <> b and capacity > 0").select("a", "b", "capacity")
    both = both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"), "capacity"))
    arcs = saved(both.groupBy(F.col("a").alias("u"), F.col("b").alias("v")).agg(F.sum("capacity").alias("room")), "arcs")
    nodes = saved(nodes.groupBy("node").agg(F.sum("gain").cast("long").alias("gain")), "nodes")
    while True:
        far = _reached(nodes, arcs, "gain < 0", True)
        placed = saved(nodes.select("node", "gain").join(far, "node", "left"), "placed")
        top = placed.where("gain > 0").agg(F.max("far")).first()[0]
        if top is None:
            inside = _reached(nodes, arcs, "gain > 0", False).select("node", F.lit(True).alias("inside"))
            return nodes.select("node").join(inside, "node", "left").select("node", F.coalesce("inside", F.lit(False)).alias("inside"))
        for level in range(top, 0, -1):
            placed, arcs = _pushed(placed, arcs, level)
        nodes = placed
