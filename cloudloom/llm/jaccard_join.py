"""N-gram Jaccard join: exact, size-aware, heavy and light.

A document's set is its distinct word shingles. Documents with equal sets are one
class from the start; classes link when their sets' Jaccard similarity reaches the
threshold. The steps:

1. Prefilter. In the order of the shingles' hashes, two linked sets share at least
   ``c`` shingles within their extended prefixes (size - least overlap + c). Only
   these prefixes are exchanged; a class with fewer shared shingles there has no link.
2. Shared shingles. The classes left, in blocks, ask for the frequency of all their
   shingles, each once per block; those found in two classes or more are kept. A link
   lies in them alone.
3. Candidates. Rarest shingle first, a small set enumerates the fixed-size (2-)subsets
   of its extended prefix, a large set scans the inverted lists of its prefix (one
   shingle each); sets near the boundary do both. The boundary is the size with the
   least total cost: subsets enumerated against entries of lists scanned.
4. Sets that meet in a subset or list form candidate components. Each is searched
   with an inverted index: from a set to all unreached sets that truly link to it, and
   on from those, so that a group of near copies costs one look at each, not a pair
   for every two. Large components are cut into blocks by size; each block is searched
   with itself and the next, and what that links is one group. Other pairs of blocks that
   sizes allow are searched only where they are not of one group as a whole. Only tree
   links leave a task.
5. The links' components give every document its class.

Nothing is capped; the steps bound memory by ranges and blocks whose number grows
with the input. Words, shingles and sets are told apart by hashes: 64 bits for a
shingle (48 and the range's in the prefilter), 128 bits for a set.

Edge cases: texts without words (null included) have empty sets and link with
nothing; fewer words than the width are one shingle; repeated rows and copies share a
class; null ids rank first. An empty table gives an empty result. Extra columns are
not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloudloom.llm.common import arrow, encoded, grouped_rank, saved, shuffle_parts, sliced
from cloudloom.llm.graph import components, joined
from cloudloom.llm.hashed import NOBODY, Flush, dealt, laid, merged, mixed, range_of, runs, shingles, word_hashes

_U = np.uint64
#: The threshold as a fraction.
NUM, DEN = 4, 5
#: Sizes up to this one are told apart when the boundary is sought, larger ones in steps of a sixteenth of a doubling.
EACH_SIZE = 128
_NO_ID = -(1 << 63)


def least_overlap(n):
    """Shingles a set of size n shares with any set it links to, at least."""
    return -(-NUM * n // DEN)


def _slack(n):
    """Shared shingles asked for in the prefilter."""
    return max(1, n // 8)


def linked(both: np.ndarray, n: int, m: np.ndarray) -> np.ndarray:
    return (NUM + DEN) * both >= NUM * (n + m)


# ---------------------------------------------------------------- sets


def _digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _mark(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "little", signed=True)


def sets(docs: DataFrame, width: int = 5) -> DataFrame:
    """id, n (set size), digest and mark (its first eight bytes) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            n, digests = [], []
            for raw in encoded(batch.column("text")):
                s = shingles(word_hashes(raw), width)
                n.append(len(s))
                digests.append(_digest(s))
            arrays = [batch.column("id"), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(map(_mark, digests), pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=["id", "n", "digest", "mark"])

    return arrow(docs.select(F.coalesce("doc_id", F.lit(_NO_ID)).alias("id"), "text"), run, "id long, n long, digest binary, mark long")


def maybe_linked(docs: DataFrame, classes: DataFrame, entries: int, width: int, per_range: int) -> DataFrame:
    """Step 1: ids of the classes (with n and digest) that pass the prefilter.

    Shingles that several sets of a flush share are counted there, so a range holds no
    more entries of a very frequent shingle than there are flushes.
    """
    buckets = shuffle_parts(docs.sparkSession)
    ranges = max(buckets, -(-entries // (3 * per_range)))
    names = ["range", "entries", "owners", "counts"]
    kinds = [pa.int64(), *[pa.binary()] * 3]

    def out(flush: Flush) -> pa.RecordBatch:
        rows, credited, times = flush.out(ranges)
        used, (keys, counts) = dealt(credited, [times.astype(np.int64)], buckets)
        columns = [
            [*[r for r, *_ in rows], *[u % ranges for u in used]], [*[e.tobytes() for _, e, _ in rows], *[None] * len(used)],
            [*[o.tobytes() for *_, o in rows], *keys], [*[None] * len(rows), *counts],
        ]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flush = Flush()
        seen: set[int] = set()
        for batch in sliced(batches, "text"):
            for raw in encoded(batch.column("text")):
                s = shingles(word_hashes(raw), width)
                if len(s) < NUM:  # a link would need an equal set
                    continue
                mark = _mark(_digest(s))
                if mark in seen:  # a copy in the same flush
                    continue
                seen.add(mark)
                n = len(s)
                flush.add(mark, s[: n - least_overlap(n) + _slack(n)])
                if flush.full:
                    yield out(flush)
                    seen.clear()
        if flush.owners:
            yield out(flush)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, held in runs(batches):
            ids, n = [np.frombuffer(o, np.int64) for e, o, _ in held if e is None], [np.frombuffer(c, np.int64) for e, _, c in held if e is None]
            if len(ids) < len(held):
                h, who = merged([np.frombuffer(e, _U) for e, _, _ in held if e is not None], [np.frombuffer(o, np.int64) for e, o, _ in held if e is not None])
                order = np.lexsort((who, h))
                h, who = h[order], who[order]
                fresh = np.ones(len(h), dtype=bool)
                fresh[1:] = (h[1:] != h[:-1]) | (who[1:] != who[:-1])
                h, who = h[fresh], who[fresh]
                here = np.unique(who[(_runs(h) > 1) & (who != NOBODY)], return_counts=True)
                ids.append(here[0])
                n.append(here[1])
            used, (keys, counts) = dealt(np.concatenate(ids), [np.concatenate(n)], buckets)
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(keys, pa.binary()), pa.array(counts, pa.binary())], names=["bucket", "marks", "counts"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, held in runs(batches):
            ids, at = np.unique(np.concatenate([np.frombuffer(k, np.int64) for k, _ in held]), return_inverse=True)
            n = np.bincount(at, weights=np.concatenate([np.frombuffer(c, np.int64) for _, c in held]))
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n.astype(np.int64))], names=["mark", "shared"])

    blobs = arrow(docs.select("text"), emit, "range long, entries binary, owners binary, counts binary")
    counts = arrow(laid(blobs, ranges), count, "bucket int, marks binary, counts binary")
    shared = arrow(laid(counts, buckets), total, "mark long, shared long")
    least = F.greatest(F.lit(1), F.floor(F.ceil(F.col("n") * NUM / DEN) / 8))
    return classes.join(shared, "mark").where(F.col("shared") >= least).select("id", "n", "digest")


def _runs(h: np.ndarray) -> np.ndarray:
    """For sorted values, how often each entry's value occurs."""
    starts = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if len(h) else np.zeros(0, np.int64)
    sizes = np.diff(np.concatenate((starts, [len(h)])))
    return np.repeat(sizes, sizes)


def _bloom(ids: DataFrame, n: int):
    """A bit per hashed id: at most 2^27 bits, 16 MB, whatever the input; a filter only, the join decides."""
    bits = 1 << min(27, max(16, (16 * max(1, n)).bit_length()))
    at = F.pmod(F.xxhash64("id"), F.lit(bits))
    word = ids.select(at.alias("at")).select(F.floor(F.col("at") / 64).alias("w"), F.expr("shiftleft(1L, cast(at % 64 as int))").alias("b"))
    table = np.zeros(bits // 64, dtype=np.int64)
    for r in word.groupBy("w").agg(F.bit_or("b").alias("b")).toLocalIterator():
        table[r["w"]] = r["b"]
    return bits, table


def shared_sets(docs: DataFrame, left: DataFrame, width: int, per_range: int) -> DataFrame:
    """Step 2: id, n, tokens and their frequencies (rarest first) of classes that can still link."""
    spark = docs.sparkSession
    size = left.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    buckets = shuffle_parts(spark)
    ranges = max(buckets, -(-size[1] // per_range))
    bits, bloom = _bloom(left, size[0])
    kept = spark.sparkContext.broadcast(bloom)

    def maybe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column("at").to_numpy()
            yield batch.filter(pa.array((kept.value[at >> 6] >> (at & 63) & 1).astype(bool)))

    src = docs.select(F.coalesce("doc_id", F.lit(_NO_ID)).alias("id"), "text")
    src = arrow(src.withColumn("at", F.pmod(F.xxhash64("id"), F.lit(bits)).cast("long")), maybe, "id long, text string, at long")
    own = src.join(left, "id").select("id", "digest", "text")
    fields = ["block", "range", "ids", "sizes", "tokens", "times"]
    kinds = [pa.int64(), pa.int64(), *[pa.binary()] * 4]

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per block of sets a row with the sets (range -1) and a row per range with the shingles in it and their counts."""
        here, number, ids, held, size = TaskContext.get().partitionId() << 32, 0, [], [], 0

        def out() -> pa.RecordBatch:
            flat = np.concatenate(held)
            each, times = np.unique(flat, return_counts=True)
            parts = list(_in_ranges(each, ranges))
            rows = [(here + number, -1, np.array(ids, np.int64), np.array([len(x) for x in held], np.int64), flat, None)]
            rows += [(here + number, r, None, None, each[at], times[at].astype(np.int64)) for r, at in parts]
            columns = [[x.tobytes() if isinstance(x, np.ndarray) else x for x in column] for column in zip(*rows, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=fields)

        for batch in sliced(batches, "text"):
            for i, mark, raw in zip(batch.column("id").to_pylist(), batch.column("digest").to_pylist(), encoded(batch.column("text")), strict=True):
                s = shingles(word_hashes(raw), width)
                if _digest(s) != mark:  # another row of that id
                    continue
                ids.append(i)
                held.append(s)
                size += len(s)
                if size >= 1 << 19:
                    yield out()
                    ids, held, size, number = [], [], 0, number + 1
        if held:
            yield out()

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The frequency of every shingle asked for, in the order asked."""
        for r, rows in runs(batches):
            asked = [np.frombuffer(t, _U) for _, t, _ in rows]
            each, at = np.unique(np.concatenate(asked), return_inverse=True)
            n = np.bincount(at, weights=np.concatenate([np.frombuffer(x, np.int64) for *_, x in rows])).astype(np.int64)
            cuts = np.cumsum([len(x) for x in asked])[:-1]
            for (block, *_), x in zip(rows, np.split(n[at], cuts), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([r]), pa.array([x.tobytes()], pa.binary())], names=["block", "range", "often"])

    def rare_first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in runs(batches):
            own_ids, own_sizes, own_tokens = next(x[2:] for x in rows if x[0] < 0)
            t, n = np.frombuffer(own_tokens, _U), np.frombuffer(own_sizes, np.int64)
            ids = np.repeat(np.frombuffer(own_ids, np.int64), n)
            n = np.repeat(n, n)
            each, at = np.unique(t, return_inverse=True)
            told = {r: np.frombuffer(o, np.int64) for r, o, *_ in rows if r >= 0}
            often = np.zeros(len(each), np.int64)
            for r, places in _in_ranges(each, ranges):
                often[places] = told[r]
            often = often[at]
            many = often > 1
            ids, n, t, often = ids[many], n[many], t[many].view(np.int64), often[many]
            order = np.lexsort((t, often, ids))
            ids, n, t, often = ids[order], n[order], t[order], often[order]
            each, starts, lengths = np.unique(ids, return_index=True, return_counts=True)
            n = n[starts]
            able = lengths >= least_overlap(n)
            keep = np.repeat(able, lengths)
            cuts = pa.array(np.concatenate(([0], np.cumsum(lengths[able]))).astype(np.int32))
            lists = [pa.ListArray.from_arrays(cuts, pa.array(x[keep])) for x in (t, often)]
            yield pa.RecordBatch.from_arrays([pa.array(each[able]), pa.array(n[able]), *lists], names=["id", "n", "tokens", "often"])

    blocks = saved(arrow(own, ask, "block long, range long, ids binary, sizes binary, tokens binary, times binary"), "blocks")
    buckets = max(buckets, -(-size[1] // (1 << 20)))  # two blocks a task, about, however many there are
    answers = arrow(laid(blocks.where("range >= 0").select("range", "block", "tokens", "times"), ranges), answer, "block long, range long, often binary")
    sets_ = blocks.where("range < 0").select("block", "range", "ids", "sizes", "tokens")
    back = answers.unionByName(sets_, allowMissingColumns=True).select("block", "range", "often", "ids", "sizes", "tokens")
    return arrow(laid(back, buckets), rare_first, "id long, n long, tokens array<long>, often array<long>")


def _in_ranges(each: np.ndarray, ranges: int) -> Iterator[tuple[int, np.ndarray]]:
    """(range, places) of the hashes of each range, in their order."""
    where = range_of(each, ranges).astype(np.int64)
    order = np.argsort(where, kind="stable")
    used, starts = np.unique(where[order], return_index=True)
    if len(used):
        yield from zip(used.tolist(), np.split(order, starts[1:]), strict=True)


# ---------------------------------------------------------------- candidates


#: A subset is a row that travels and is stored; an entry of a list is a number scanned in memory.
SUBSET_COST = 8


def boundary(costs: dict[int, tuple[int, int]]) -> int:
    """The largest size of small sets with the least cost; by size: (subsets, list entries)."""
    best, chosen = None, 0
    sizes = sorted(costs)
    for x in [0, *sizes]:
        near = least_overlap(x)
        cost = SUBSET_COST * sum(c[0] for s, c in costs.items() if s <= x) + sum(c[1] for s, c in costs.items() if s > x or s >= near)
        if best is None or cost < best:
            best, chosen = cost, x
    return chosen


def size_costs(shared: DataFrame) -> dict[int, tuple[int, int]]:
    """Subsets to enumerate and list entries to scan, by size (the largest of a step): a few hundred rows."""
    size = F.when(F.col("n") <= EACH_SIZE, F.col("n")).otherwise(F.floor(F.pow(F.lit(2.0), F.ceil(F.log2("n") * 16) / 16))).cast("long")
    prefix = F.size("tokens") - F.ceil(F.col("n") * NUM / DEN) + 1
    lists = F.aggregate(F.slice("often", F.lit(1), prefix.cast("int")), F.lit(0).cast("long"), lambda a, x: a + x)
    rows = shared.groupBy(size.alias("s")).agg(F.sum(prefix * (prefix + 1) / 2).cast("long").alias("subsets"), F.sum(lists).alias("lists")).collect()
    return {r["s"]: (r["subsets"], r["lists"]) for r in rows}


def keys_of(n: int, tokens: np.ndarray, small: int) -> np.ndarray:
    """Keys at which the set meets others: 2-subsets if small, single shingles if large or near the boundary."""
    t = tokens.view(_U)
    spare = len(t) - int(least_overlap(n))
    out = []
    if n <= small:
        a, b = np.triu_indices(spare + 2, 1)
        low, high = np.minimum(t[a], t[b]), np.maximum(t[a], t[b])
        out.append(mixed(low * _U(0x9E3779B97F4A7C15) + high))
    if n > small or n >= least_overlap(small):
        out.append(mixed(t[: spare + 1].copy()))
    return np.concatenate(out)


def candidate_edges(shared: DataFrame, small: int) -> DataFrame:
    """Step 3: a star of ids for every key, distinct."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = [], []
            for i, n, t in zip(batch.column("id").to_pylist(), batch.column("n").to_pylist(), batch.column("tokens"), strict=True):
                k = keys_of(n, t.values.to_numpy(), small)
                ids.append(np.full(len(k), i, dtype=np.int64))
                keys.append(k)
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids)), pa.array(np.concatenate(keys).view(np.int64))], names=["id", "key"])

    met = arrow(shared.select("id", "n", "tokens"), emit, "id long, key long")
    met = saved(met, "keys")
    heads = met.groupBy("key").agg(F.min("id").alias("head"), F.count(F.lit(1)).alias("met")).where("met > 1")
    return joined(met, heads, "key", "met", met.count()).where("id <> head").select(F.col("id").alias("a"), F.col("head").alias("b")).distinct()


# ---------------------------------------------------------------- exact search


def tree_links(ids: list[int], sizes: list[int], tokens: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links that connect exactly the sets connected by links: a search over unreached sets."""
    m = len(ids)
    n = np.array(sizes, dtype=np.int64)
    if m == 2:
        both = len(np.intersect1d(tokens[0], tokens[1], assume_unique=True))
        return [(ids[0], ids[1])] if linked(np.array([both]), int(n[0]), n[1:])[0] else []
    lengths = np.array([len(t) for t in tokens])
    flat = np.unique(np.concatenate(tokens), return_inverse=True)[1]
    cuts = np.concatenate(([0], np.cumsum(lengths)))

    def index(alive: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        who = np.repeat(np.arange(m), lengths)
        keep = alive[who]
        order = np.argsort(flat[keep], kind="stable")
        starts = np.concatenate(([0], np.cumsum(np.bincount(flat[keep], minlength=flat.max() + 1))))
        return who[keep][order], starts

    alive = np.ones(m, dtype=bool)
    lists, starts = index(alive)
    indexed, left = m, m
    out: list[tuple[int, int]] = []
    for root in range(m):
        if not alive[root]:
            continue
        alive[root] = False
        left -= 1
        stack = [root]
        while stack and left:
            u = stack.pop()
            t = flat[cuts[u] : cuts[u + 1]]
            a, k = starts[t], starts[t + 1] - starts[t]
            at = np.repeat(a - np.concatenate(([0], np.cumsum(k)[:-1])), k) + np.arange(k.sum())
            # a cost of what is met, not of all sets
            if len(at) < m // 8:
                near, both = np.unique(lists[at], return_counts=True)
            else:
                both = np.bincount(lists[at], minlength=m)
                near = np.flatnonzero(both)
                both = both[near]
            hit = near[alive[near] & linked(both, int(n[u]), n[near])]
            alive[hit] = False
            left -= len(hit)
            out += [(ids[u], ids[v]) for v in hit]
            stack += hit.tolist()
            if left and left * 2 < indexed:
                lists, starts = index(alive)
                indexed = left
        if not left:
            break
    return out


def exact_links(shared: DataFrame, comps: DataFrame, most_tokens: int) -> DataFrame:
    """Step 4: tree links (a, b) within candidate components."""
    own = shared.select("id", "n", "tokens").join(comps.withColumnsRenamed({"node": "id"}), "id")
    narrow = own.select("id", "n", "root", F.size("tokens").cast("long").alias("k"))
    totals = narrow.groupBy("root").agg(F.sum("k").alias("all"), F.count(F.lit(1)).alias("members")).where("members > 1")
    totals = totals.withColumn("blocks", F.ceil(F.col("all") / most_tokens).cast("int"))
    large = totals.where("blocks > 1")
    # large components: blocks by size, so that block pairs of unlike sizes fall away
    ranks = grouped_rank(narrow.join(large, "root"), ["root"], F.floor(F.log2("n") * 16).cast("int"), [F.col("n"), F.col("id")], "rank")
    block = ranks.select("id", "n", "root", F.floor(F.col("rank") * F.col("blocks") / F.col("members")).cast("int").alias("block"))
    block = saved(block, "blocks")
    edges = block.groupBy("root", "block").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    x = edges.select("root", F.col("block").alias("i"), F.col("high").alias("high_i"))
    y = edges.select(F.col("root").alias("root_y"), F.col("block").alias("j"), F.col("low").alias("low_j"))
    pairs = x.join(y, (F.col("root") == F.col("root_y")) & (F.col("i") <= F.col("j")) & (F.col("high_i") * DEN >= F.col("low_j") * NUM)).select("root", "i", "j")
    # blocks that follow each other first: what they link needs no search between blocks further apart
    close = pairs.where("j <= i + 1")
    single = narrow.join(totals.where("blocks = 1").select("root"), "root").select("id", "root", F.lit(0).alias("i"), F.lit(0).alias("j"))
    found = _searched(_sent(block, close).unionByName(single), own)
    far = pairs.where("j > i + 1")
    if far.isEmpty():
        return found
    found = saved(found, "links")
    group = components(found).withColumnsRenamed({"node": "id", "root": "group"})
    named = block.join(group, "id", "left").select("root", "block", F.coalesce("group", "id").alias("group"))
    ends = saved(named.groupBy("root", "block").agg(F.min("group").alias("g0"), F.max("group").alias("g1")), "ends")
    x, y = (ends.select(F.col("root").alias(f"{k}_root"), F.col("block").alias(f"{k}_block"), F.col("g0").alias(f"{k}0"), F.col("g1").alias(f"{k}1")) for k in "xy")
    both = far.join(x, (F.col("root") == F.col("x_root")) & (F.col("i") == F.col("x_block"))).join(y, (F.col("root") == F.col("y_root")) & (F.col("j") == F.col("y_block")))
    left = both.where("not (x0 = x1 and y0 = y1 and x0 = y0)").select("root", "i", "j")
    return found.unionByName(_searched(_sent(block, left), own))


def _sent(block: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, root, i, j): the sets of the blocks of each pair."""
    wanted = pairs.select("root", F.col("i").alias("block"), "i", "j").unionByName(pairs.where("i < j").select("root", F.col("j").alias("block"), "i", "j"))
    return block.join(wanted, ["root", "block"]).select("id", "root", "i", "j")


def _searched(sent: DataFrame, own: DataFrame) -> DataFrame:
    """Tree links (a, b) among the sets sent to one (root, i, j)."""
    laid = sent.join(own.select("id", "n", "tokens"), "id")
    laid = laid.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j").select("root", "i", "j", "id", "n", "tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, sizes, held = None, [], [], []
        out: list[tuple[int, int]] = []
        for batch in batches:
            roots, i, j, own_ids, n = [batch.column(k).to_pylist() for k in range(5)]
            column = batch.column(5)
            cuts, values = column.offsets.to_numpy(), column.values.to_numpy()
            for k, key in enumerate(zip(roots, i, j, strict=True)):
                if key != now:
                    if len(ids) > 1:
                        out += tree_links(ids, sizes, held)
                    now, ids, sizes, held = key, [], [], []
                ids.append(own_ids[k])
                sizes.append(n[k])
                held.append(values[cuts[k] : cuts[k + 1]])
            held = [x.copy() for x in held]
            if len(out) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*out, strict=True)], names=["a", "b"])
                out = []
        if len(ids) > 1:
            out += tree_links(ids, sizes, held)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*out, strict=True)], names=["a", "b"])

    return arrow(laid, run, "a long, b long")


# ---------------------------------------------------------------- the join


def groups(docs: DataFrame, width: int = 5, per_range: int = 1 << 22, most_tokens: int = 1 << 22) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs``."""
    all_sets = saved(sets(docs, width), "sets")
    classes = all_sets.where("n > 0").groupBy("digest", "n").agg(F.min("id").alias("id"), F.min("mark").alias("mark"))
    classes = saved(classes, "classes")
    entries = classes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    left = saved(maybe_linked(docs, classes, entries, width, per_range), "left")
    shared = saved(shared_sets(docs, left, width, per_range), "shared")
    small = boundary(size_costs(shared))
    comps = components(candidate_edges(shared, small))
    found = components(exact_links(shared, comps, most_tokens))
    # a root is the smallest id of its component, and a class's id the smallest of its rows
    rooted = classes.join(found.withColumnsRenamed({"node": "id"}), "id", "left").select("digest", "n", F.coalesce("root", "id").alias("component"))
    both = all_sets.join(rooted, ["digest", "n"], "left")
    return both.select(
        F.nullif("id", F.lit(_NO_ID)).alias("doc_id"), F.col("n").alias("n_shingles"),
        F.nullif(F.coalesce("component", "id"), F.lit(_NO_ID)).alias("component_id"),
    )


def keep_one(docs: DataFrame, **kw) -> DataFrame:
    """``docs`` with one row of each group of linked ones: that of the smallest id, null first; any one of equal ids."""
    clear = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("doc_id is null or n > 1").isEmpty()
    if not clear:
        # ids that don't name one row: rows are numbered for the join, and written so that the numbers hold
        rows = saved(docs.withColumn("__row", F.monotonically_increasing_id()), "rows")
        found = groups(rows.select(F.col("__row").alias("doc_id"), "text"), **kw).select(F.col("doc_id").alias("__row"), "component_id")
        named = saved(rows.select("__row", "doc_id").join(found, "__row"), "named")
        first = named.groupBy("component_id").agg(F.min(F.struct("doc_id", "__row")).alias("m")).select(F.col("m.__row").alias("__row"))
        return rows.join(first, "__row", "left_semi").select(*docs.columns)
    gone = groups(docs, **kw).where("component_id <> doc_id").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, F.col("doc_id") == F.col("__gone"), "left_anti")
