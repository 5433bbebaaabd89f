"""Sharding by a hypergeometric communication matrix, in DataFrame operations only.

A uniform shuffle with exact shard sizes: rows lie in partitions (by a hash of the
row); how many rows of each partition go to each shard is drawn exactly as a uniform
permutation would have it, a multivariate hypergeometric draw per partition given
what the shards can still take. Each partition then permutes its rows locally and
hands them out by these counts, the rows are exchanged, and each shard permutes
again: it is laid out in blocks by a second random key, whose counts give every row
a gapless slot without gathering a shard in one task.

The draws are a fold over the partitions' counts, ``width`` of them at a time and level
by level above that, by the ratio-of-uniforms rejection method, with uniforms from
hashes, so reruns agree. A draw has 48 tries of which each is accepted with a chance of
over a half, so the mode, returned if all fail, comes up less than once in 10 ** 14 draws.

Edge cases: a null text has size 1 and checksum 0; fewer rows than shards leaves
shards empty; an empty table gives an empty result; rows with equal ids are told
apart by size and checksum. Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloudloom.llm.common import grouped_rank, saved

_TRIES = 48
#: Constants of the ratio-of-uniforms hat: 2*sqrt(2/e) and 3 - 2*sqrt(3/e).
_HAT, _SHIFT = 1.7155277699214135, 0.8989161620588988


def _let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _log_factorial(x: Column) -> Column:
    small = F.log(F.factorial(F.least(x, F.lit(20)).cast("int")).cast("double"))
    y = F.greatest(x, F.lit(1)).cast("double")
    series = y * F.log(y) - y + F.log(y * 6.283185307179586) / 2 + F.lit(1) / (y * 12) - F.lit(1) / (y * y * y * 360) + F.lit(1) / (y * y * y * y * y * 1260)
    return F.when(x <= 20, small).otherwise(series)


def _uniform(*parts: Column) -> Column:
    """In (0, 1), from a hash."""
    return (F.xxhash64(*parts).bitwiseAND((1 << 52) - 1).cast("double") + 0.5) / float(1 << 52)


def hypergeometric(good: Column, bad: Column, sample: Column, *seed: Column) -> Column:
    """How many of ``good`` are among ``sample`` drawn from ``good + bad``; exact law, long."""
    least, most, all_ = F.least(good, bad), F.greatest(good, bad), good + bad
    m = F.least(sample, all_ - sample)
    share = least / all_
    setup = F.struct(
        least.cast("double").alias("least"), most.cast("double").alias("most"), m.cast("double").alias("m"),
        (m * share + 0.5).alias("centre"),
        F.sqrt((all_ - m).cast("double") * sample * share * (F.lit(1) - share) / F.greatest(all_ - 1, F.lit(1)) + 0.5).alias("sd"),
        F.floor((m + 1).cast("double") * (least + 1) / (all_ + 2)).cast("double").alias("mode"),
    )

    def weight(s: Column, z: Column) -> Column:
        return _log_factorial(z) + _log_factorial(s["least"] - z) + _log_factorial(s["m"] - z) + _log_factorial(s["most"] - s["m"] + z)

    def tried(s: Column, top: Column, end: Column) -> Column:
        def step(got: Column, t: Column) -> Column:
            def judged(w: Column) -> Column:
                z = F.floor(w["w"]).cast("double")
                fits = (w["w"] >= 0) & (w["w"] < end)
                return F.when(fits & (F.log(w["x"]) * 2 <= top - weight(s, z)), z).otherwise(F.lit(-1.0))

            x, y = _uniform(*seed, t, F.lit(1)), _uniform(*seed, t, F.lit(2))
            drawn = _let(x, lambda v: F.struct(v.alias("x"), (s["centre"] + (s["sd"] * _HAT + _SHIFT) * (y - 0.5) / v).alias("w")))
            return F.when(got >= 0, got).otherwise(_let(drawn, judged))

        found = F.aggregate(F.sequence(F.lit(1), F.lit(_TRIES)), F.lit(-1.0), step)
        return _let(found, lambda z: F.when(z >= 0, z).otherwise(s["mode"]))

    def whole(s: Column) -> Column:
        end = F.least(F.least(s["m"], s["least"]) + 1, F.floor(s["centre"] + s["sd"] * 16).cast("double"))
        z = tried(s, weight(s, s["mode"]), end)
        z = F.when(good > bad, s["m"] - z).otherwise(z)
        return F.when(s["m"] < sample, good - z).otherwise(z).cast("long")

    return (
        F.when((good <= 0) | (sample <= 0), F.lit(0).cast("long"))
        .when(bad <= 0, F.least(sample, good).cast("long"))
        .when(sample >= all_, good.cast("long"))
        .otherwise(_let(setup, whole))
    )


def matrix(counts: DataFrame, partitions: int, shards: int, seed: str, width: int = 1_024) -> DataFrame:
    """(partition, ends): per partition the running ends of its rows per shard.

    ``counts``: (partition, n), one row per partition, numbered below ``partitions``.
    Shard sizes differ by one at most. More than ``width`` partitions are drawn for in
    groups of ``width``: what a group gives to each shard is drawn first, in the same way,
    and dealt out among its partitions group by group, in parallel. The law is the same.
    """
    one = F.struct("partition", F.col("n").cast("long").alias("n"))
    if partitions <= width:
        row = counts.groupBy().agg(F.sort_array(F.collect_list(one)).alias("parts"))
        total = F.aggregate("parts", F.lit(0).cast("long"), lambda a, x: a + x["n"])
        room = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda j: (F.floor(total / shards) + F.when(j < total % shards, 1).otherwise(0)).cast("long"))
        return _dealt(row.select("parts", room.alias("room")), shards, seed)
    grouped = counts.withColumn("group", F.floor(F.col("partition") / width).cast("int"))
    groups = grouped.groupBy("group").agg(F.sum("n").alias("n"), F.sort_array(F.collect_list(one)).alias("parts"))
    ends = matrix(groups.select(F.col("group").alias("partition"), "n"), -(-partitions // width), shards, f"{seed}/up", width)
    room = F.transform("ends", lambda e, i: e - F.when(i > 0, F.get("ends", i - 1)).otherwise(F.lit(0).cast("long")))
    rooms = groups.select("group", "parts").join(ends.withColumnRenamed("partition", "group"), "group").select("parts", room.alias("room"))
    return _dealt(rooms, shards, seed)


def _dealt(rows: DataFrame, shards: int, seed: str) -> DataFrame:
    """(partition, ends) of rows of (parts: partitions with counts, room: what each shard takes of them)."""
    empty = F.lit(None).cast("array<struct<partition:int,ends:array<bigint>>>")

    def one(state: Column, part: Column) -> Column:
        """Deal one partition's rows out to the shards that have room."""

        def shard(got: Column, j: Column) -> Column:
            free = F.get(state["room"], j)
            rest = F.aggregate(F.slice(state["room"], j + 2, F.lit(shards)), F.lit(0).cast("long"), lambda a, x: a + x)
            n = hypergeometric(free, rest, got["left"], F.lit(seed), part["partition"], j)
            return _let(n, lambda k: F.struct((got["left"] - k).alias("left"), F.concat(got["row"], F.array(k)).alias("row")))

        start = F.struct(part["n"].alias("left"), F.expr("cast(array() as array<bigint>)").alias("row"))
        dealt = F.aggregate(F.sequence(F.lit(0), F.lit(shards - 1)), start, shard)["row"]

        def done(row: Column) -> Column:
            ends = F.transform(row, lambda _, i: F.aggregate(F.slice(row, F.lit(1), i + 1), F.lit(0).cast("long"), lambda a, x: a + x))
            left = F.zip_with(state["room"], row, lambda a, b: a - b)
            new = F.array(F.struct(part["partition"].alias("partition"), ends.alias("ends")))
            return F.struct(left.alias("room"), F.concat(state["out"], new).alias("out"))

        return _let(dealt, done)

    start = F.struct(F.col("room"), F.coalesce(empty, F.expr("cast(array() as array<struct<partition:int,ends:array<bigint>>>)")).alias("out"))
    return rows.select(F.explode(F.aggregate("parts", start, one)["out"]).alias("x")).select("x.*")


def shard(docs: DataFrame, shards: int = 8, seed: str = "shards", rows_each: int = 50_000, width: int = 1_024) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot of every row of ``docs``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = saved(rows, "shard")
    n = rows.count()
    partitions = max(1, -(-n // rows_each))
    row_key = [F.col("doc_id"), F.col("size"), F.col("text_crc32")]
    rows = rows.withColumn("partition", F.pmod(F.xxhash64(*row_key, F.lit(f"{seed}/home")), F.lit(partitions)).cast("int"))
    ends = matrix(rows.groupBy("partition").agg(F.count(F.lit(1)).alias("n")), partitions, shards, seed, width)
    first = F.xxhash64(*row_key, F.lit(f"{seed}/first"))
    ranked = grouped_rank(rows, ["partition"], F.lit(0), [first, *row_key], "place")
    dealt = ranked.join(ends, "partition").withColumn("shard", F.size(F.filter("ends", lambda e: e <= F.col("place"))).cast("int"))
    dealt = saved(dealt.select("doc_id", "size", "text_crc32", "shard"), "dealt")
    blocks = max(1, -(-n // (shards * rows_each)))
    second = F.xxhash64(*row_key, F.col("shard"), F.lit(f"{seed}/second"))
    # the block is made of other bits of the key than the order in it needs
    block = F.pmod(F.shiftrightunsigned(second, 20), F.lit(blocks)).cast("int")
    return grouped_rank(dealt, ["shard"], block, [second, *row_key], "slot")
