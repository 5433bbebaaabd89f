"""Mixing sources to target weights, in DataFrame operations only.

Every row gets a hash-random key (from its id, so reruns agree). Rows are dealt
out by source and the leading bits of the key, sorted by the key, and summed
within each bucket; the buckets' sums give each row its distributed prefix sum
within its source, whatever the source's share of the rows. A source's budget is
cut exactly: whole epochs first, then the rows whose prefix lies below the rest
of the budget, the row at the cut taken in part.

Edge cases: a null text has size 0 and takes nothing; a null source is a source
of its own, after all others; an empty table, or one without words, gives targets
of 0; rows with equal ids are ordered by size (in ``mixed`` also by text and the other
columns). Extra columns are handed on by ``mixed`` and else not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cloudloom.llm.common import saved

WORD = r"[^\\x20\\x09-\\x0D]+"
#: Weights of the sources in order, repeating.
WEIGHTS = (5, 2, 1)


def words(text: str = "text") -> Column:
    """Number of words; a null text has none."""
    return F.coalesce(F.expr(f"regexp_count(`{text}`, '{WORD}')"), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = (3, 2), most: int = 2) -> DataFrame:
    """Budgets of the sources: one row per source in and out.

    All sources share ``share`` of all sizes by weight; none gets above ``most``
    times its own size, and what it can't take is shared anew by weight. With the
    sources sorted by size over weight those at their limit come first, so one pass
    of prefix sums finds the final state. The windows hold one row per source.
    """
    big = "decimal(38,0)"
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    src = sizes.withColumn("w", w.cast("long"))
    order = W.orderBy((F.col("source_size") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    before = order.rowsBetween(W.unboundedPreceding, -1)
    every = W.partitionBy()
    src = src.select(
        "source", "source_size", "w",
        F.coalesce(F.sum("source_size").over(before), F.lit(0)).cast(big).alias("s0"),
        F.coalesce(F.sum("w").over(before), F.lit(0)).cast(big).alias("w0"),
        F.sum("source_size").over(every).cast(big).alias("t"),
        F.sum("w").over(every).cast(big).alias("wt"),
    )
    a, b = share
    left = F.expr(f"{a} * t - {b * most} * s0")
    capped = F.expr(f"{b * most} * cast(source_size as {big}) * (wt - w0)") <= left * F.col("w")
    src = src.withColumn("capped", capped)
    open_ = src.where("not capped").agg(F.min("s0").alias("s1"), F.min("w0").alias("w1"))
    rest = F.expr(f"cast(({a} * t - {b * most} * s1) * w as double) / cast({b} * (wt - w1) as double)")
    return src.crossJoin(open_).select(  # one row on the right
        "source", "source_size", "w",
        F.when(F.col("capped"), (most * F.col("source_size")).cast("double")).otherwise(rest).alias("target"),
    )


def _keyed(docs: DataFrame, seed: str) -> DataFrame:
    """``docs`` with size, the hash-random key, and the key's leading bits."""
    key = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(f":{seed}")))
    rows = docs.withColumn("size", words()).withColumn("key", key)
    return rows.withColumn("lead", F.conv(F.substring("key", 1, 8), 16, 10).cast("long"))


def _planned(rows: DataFrame, rows_each: int, ties: list[str], **kw) -> DataFrame:
    """Keyed ``rows`` with source_size, target and taken; the sums need none of their other columns."""
    buckets = max(16, -(-rows.count() // rows_each))
    rows = rows.withColumn("bucket", F.floor(F.col("lead") * buckets / (1 << 32)).cast("int")).drop("lead")
    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    src = targets(sums.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), **kw)
    over = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.withColumn("offset", F.coalesce(F.sum("bucket_size").over(over), F.lit(0)))
    offsets = offsets.join(src, offsets["source"].eqNullSafe(src["source"])).select(
        offsets["source"].alias("o_source"), F.col("bucket").alias("o_bucket"), "offset", "source_size", "target"
    )
    local = W.partitionBy("source", "bucket").orderBy("key", "doc_id", "size", *ties).rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = rows.withColumn("upto", F.sum("size").over(local))
    both = placed.join(offsets, placed["source"].eqNullSafe(F.col("o_source")) & (F.col("bucket") == F.col("o_bucket")))
    return both.withColumn("taken", taken())


def mix(docs: DataFrame, seed: str = "mix", rows_each: int = 50_000, **kw) -> DataFrame:
    """doc_id, source, size, source_size, target and taken of every row of ``docs``.

    ``taken``: words the mix takes of the row over all epochs. ``rows_each``: rows of
    a bucket at most, about; the buckets' count follows the rows.
    """
    rows = saved(_keyed(docs.select("doc_id", "source", "text"), seed).drop("text"), "mix")
    return _planned(rows, rows_each, [], **kw).select("doc_id", "source", "size", "source_size", "target", "taken")


def taken() -> Column:
    """Words taken of a row from its source's budget: epochs times its size, and its part of the rest."""
    budget = F.floor(F.col("target"))
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    rest = budget - epochs * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - (F.col("offset") + F.col("upto") - F.col("size"))))
    return (epochs * F.col("size") + part).cast("long")


def cut(text: str, n: str) -> Column:
    """The stretch of ``text`` up to the end of its ``n``-th word."""
    return F.expr(f"array_join(slice(regexp_extract_all(`{text}`, '[\\\\x20\\\\x09-\\\\x0D]*{WORD}', 0), 1, cast({n} as int)), '')")


def mixed(docs: DataFrame, seed: str = "mix", rows_each: int = 20_000, **kw) -> DataFrame:
    """The mix itself: a row of ``docs`` for each epoch that takes it whole, and the cut row's first words.

    A row is planned and written out where it lies, so rows that repeat an id, or all of a
    row, are taken each on its own; what the mix takes nothing of is not in it.
    """
    names = docs.columns
    rows = docs.select("doc_id", "source", "text", F.struct(*[docs[n] for n in names if n != "text"]).alias("row"))
    kind = rows.schema["row"].dataType.simpleString()
    ties = ["text"] if "map<" in kind or "variant" in kind else ["text", "row"]
    plan = _planned(_keyed(rows, seed), rows_each, ties, **kw).where("taken > 0").select("text", "row", "size", "taken")
    plan = plan.withColumn("epoch", F.explode(F.expr("sequence(1, cast(ceil(taken / size) as int))")))
    left = F.expr("taken - (epoch - 1) * size")
    text = F.when(left >= F.col("size"), F.col("text")).otherwise(cut("text", "(taken - (epoch - 1) * size)"))
    return plan.select(*[text.alias(n) if n == "text" else F.col("row")[n].alias(n) for n in names])
