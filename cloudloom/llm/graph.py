"""Connected components by alternating large and small stars, in DataFrame operations.

Every round replaces edges by stars around smaller nodes and writes them to the
shared scratch; the rounds grow with the logarithm of a component's diameter. A hub's
edges stay where they lie: its minimum is sent to them.
Nothing of the graph is collected but two numbers a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloudloom.llm.common import saved


def joined(rows: DataFrame, own: DataFrame, key: str, times: str, total: int, share: int = 256) -> DataFrame:
    """``rows`` with the columns of ``own``, which has a row per ``key`` and in ``times`` how many of ``rows`` have it.

    A key of more than one in ``share`` of ``total`` rows (how many there are, or more) is joined
    where its rows lie: there are fewer than ``share`` of them, whatever the input, so they can
    be sent to every task.
    """
    hot = own.where(F.col(times) * share > total).drop(times)
    rest = own.where(F.col(times) * share <= total).drop(times)
    cold = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(rest, key)
    return rows.join(F.broadcast(hot), key).unionByName(cold)


def _sum(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return r[0], r[1]


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node reachable) of every node of the edges (a, b)."""
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = saved(e, "edges")
    before = _sum(e)
    while before[0]:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count(F.lit(1)).alias("n"))
        large = joined(both, low, "a", "n", 2 * before[0]).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        large = saved(large, "large")
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
        small = joined(large, least, "a", "n", 2 * before[0]).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = saved(least.select("a", F.col("m").alias("b")).unionByName(small).distinct(), "small")
        after = _sum(e)
        if after == before:
            break
        before = after
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
