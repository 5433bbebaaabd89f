"""Best-fit packing of token sequences by exact-complement hashing.

Documents are tokenised and cut into pieces of at most ``capacity`` tokens. Only the
histogram of piece lengths is needed to plan the packing: for the longest length
left, the gap to the capacity is looked up in an index of single, pair and triple
length sums, and the combination is consumed as often as the availability counts
allow. Lengths that nothing completes exactly are packed best-fit, longest first.

The plan is a list of (lengths, how often) patterns. Each planning step uses up a
length or a group of equal gaps, so it has a few steps per possible length whatever
the number of documents, and is small enough to send to every task. Pieces get their
places by their rank among pieces of equal length, counted in hashed buckets.

Edge cases: a null text is an empty one and packs its end token; texts of any length
are tokenised whole; repeated rows are packed each on its own. An empty table gives
an empty result. Extra columns are not read.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloudloom.llm.common import arrow, grouped_rank, saved, sliced

Pattern = tuple[tuple[int, ...], int]


# ---------------------------------------------------------------- tokens


class Coder:
    """Ids of the byte-level tokenizer as little-endian 32-bit bytes.

    The vocabulary is that of ``tokenizer``, run by a faster library; texts with special
    tokens go through the tokenizer itself. A single space between two characters that are
    not white space begins a token and no token reaches across it, so long texts are cut
    there and their ids joined.
    """

    cut = re.compile(r"(?<=\S) (?=\S)")
    #: Characters tokenised at once, about.
    most_chars = 1 << 20

    def __init__(self, tokenizer: str, ranks: str, pattern: str, special: tuple[str, ...] = ("<|endoftext|>",)):
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(ranks, "rb"))}
        self.fast = tiktoken.Encoding("ids", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.tokenizer, self.special, self.whole = tokenizer, special, None

    def _whole(self, text: str) -> bytes:
        if self.whole is None:
            from tokenizers import Tokenizer

            self.whole = Tokenizer.from_file(self.tokenizer)
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _parts(self, text: str) -> Iterator[str]:
        start = 0
        while len(text) - start > self.most_chars and (m := self.cut.search(text, start + self.most_chars)):
            yield text[start : m.start()]
            start = m.start()
        yield text[start:] if start else text

    def ids(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return self._whole(text)
        return b"".join([np.array(self.fast.encode_ordinary(x), "<u4").tobytes() for x in self._parts(text)])

    def encode(self, texts: list[str]) -> list[bytes]:
        return [self.ids(t) for t in texts]


_CODERS: dict[tuple, Coder] = {}


def public_coder() -> tuple[str, str, str]:
    """Places of the public tokenizer's two forms, and its pattern."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def pieces(docs: DataFrame, capacity: int = 2_048, coder: tuple[str, str, str] | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece; ``with_ids``: and its ids."""
    made_with = coder

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where = made_with or public_coder()
        if where not in _CODERS:
            _CODERS[where] = Coder(*where)
        encode = _CODERS[where].encode
        for batch in sliced(batches, "text", 4 << 20):
            out: list[list] = [[] for _ in range(6)]
            all_ids = encode([t or "" for t in batch.column("text").to_pylist()])
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), all_ids, strict=True):
                ids += b"\0\0\0\0"
                n = len(ids) // 4
                first = n % capacity or capacity
                for k, end in enumerate(range(first, n + 1, capacity)):
                    start = 0 if k == 0 else end - capacity
                    part = ids[4 * start : 4 * end]
                    for column, value in zip(out, (doc_id, k, start, end - start, zlib.crc32(part), part), strict=True):
                        column.append(value)
            kinds = [batch.column("doc_id").type, pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            arrays = [pa.array(x, k) for x, k in zip(out, kinds, strict=False)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                arrays.append(pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in out[5]], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    kind = docs.select("doc_id").schema[0].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return arrow(docs.select("doc_id", "text"), run, schema)


# ---------------------------------------------------------------- plan


class Counts:
    """Availability by length, with the index of sums over the lengths that are left."""

    def __init__(self, counts: np.ndarray):
        self.n = counts.copy()
        self.there = np.flatnonzero(counts)
        self.by_sum: dict[int, np.ndarray] = {}

    def enough(self, lengths: tuple[int, ...]) -> int:
        """How often the combination can be taken."""
        return min(int(self.n[x]) // lengths.count(x) for x in lengths)

    def pairs(self, total: int) -> np.ndarray:
        """The index: longer halves of all pairs of this sum, longest first; made when first asked for."""
        if total not in self.by_sum:
            high = self.there[(2 * self.there >= total) & (self.there < total)][::-1]
            self.by_sum[total] = high[self.n[total - high] > 0] if len(high) else high
        return self.by_sum[total]

    def pair(self, total: int, most: int) -> tuple[int, int] | None:
        """Two available lengths of this sum, the longest possible first."""
        a = self.pairs(total)
        # what is used up never comes back
        a = self.by_sum[total] = a[(self.n[a] > 0) & (self.n[total - a] > 0) & ((2 * a != total) | (self.n[a] > 1))]
        hit = np.flatnonzero(a <= most)
        return (int(a[hit[0]]), int(total - a[hit[0]])) if len(hit) else None

    def pair_sums(self, most: int) -> np.ndarray:
        """Which sums two available lengths make (a necessary condition; counts decide)."""
        there = (self.n > 0).astype(np.float64)
        size = 1 << (2 * len(there) - 1).bit_length()
        return np.fft.irfft(np.fft.rfft(there, size) ** 2, size)[: most + 1] > 0.5


def exact_complements(counts: Counts, longest: int, gap: int, sums: np.ndarray | None) -> Iterator[tuple[int, ...]]:
    """Combinations of one, two and three lengths that fill the gap exactly, as counts stand."""
    while gap <= longest and gap > 0 and counts.enough((longest, gap)):
        yield (gap,)
    while (found := counts.pair(gap, longest)) is not None and counts.enough((longest, *found)):
        yield found
    if sums is None:
        return
    for a in np.flatnonzero(counts.n[1 : min(gap - 2, longest) + 1])[::-1] + 1 if gap > 2 else ():
        a = int(a)
        if 3 * a < gap:
            break
        while sums[gap - a] and counts.n[a] and (found := counts.pair(gap - a, a)) is not None and counts.enough((longest, a, *found)):
            yield (a, *found)
        if not counts.n[longest]:
            return


def plan(histogram: dict[int, int], capacity: int = 2_048) -> list[Pattern]:
    """Patterns that use every piece once."""
    n = np.zeros(capacity + 1, dtype=np.int64)
    for length, k in histogram.items():
        n[length] = k
    counts, out = Counts(n), []
    if counts.n[capacity]:
        out.append(((capacity,), int(counts.n[capacity])))
        counts.n[capacity] = 0
    sums = counts.pair_sums(capacity)
    for longest in range(capacity - 1, 0, -1):
        if not counts.n[longest]:
            continue
        for rest in exact_complements(counts, longest, capacity - longest, sums):
            made = (longest, *rest)
            k = counts.enough(made)
            for x in made:
                counts.n[x] -= k
            out.append((made, k))
            if not counts.n[longest]:
                break
    return out + best_fit(counts.n, capacity)


def best_fit(n: np.ndarray, capacity: int) -> list[Pattern]:
    """Best-fit of the lengths left, longest first, many equal ones at a time."""
    bins: dict[int, list[list]] = defaultdict(list)  # by gap: [lengths, how many]
    gaps = np.zeros(capacity + 1, dtype=bool)
    for length in range(capacity, 0, -1):
        left = int(n[length])
        while left:
            fits = np.flatnonzero(gaps[length:])
            if len(fits):
                gap = int(fits[0]) + length
                have = bins[gap][-1]
                k = min(left, have[1])
                # one of the group's bins at a time takes as many as it holds
                fill = min(gap // length, max(1, left // k)) if gap // length > 1 else 1
                have[1] -= k
                made = [(*have[0], *[length] * fill), k]
                if not have[1]:
                    bins[gap].pop()
                    gaps[gap] = bool(bins[gap])
                left -= k * fill
                rest = gap - fill * length
            else:
                fill = min(capacity // length, left)
                k = max(1, left // fill)
                made = [(length,) * fill, k]
                left -= k * fill
                rest = capacity - fill * length
            bins[rest].append(made)
            gaps[rest] = True
    return [(tuple(x), k) for group in bins.values() for x, k in group]


def places(patterns: list[Pattern]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By length: ranks at which a run of places starts, its first sequence, and its offset there."""
    runs: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    given: dict[int, int] = defaultdict(int)
    base = 0
    for lengths, k in patterns:
        at = 0
        for x in lengths:
            runs[x].append((given[x], base, at))
            given[x] += k
            at += x
        base += k
    return {x: tuple(np.array(c, dtype=np.int64) for c in zip(*r, strict=True)) for x, r in runs.items()}


# ---------------------------------------------------------------- packing


def pack(parts: DataFrame, capacity: int = 2_048, rows_each: int = 50_000) -> DataFrame:
    """``parts`` (with doc_id, piece, start, length) with the sequence and offset of every piece."""
    parts = saved(parts, "pieces")
    histogram = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    where = places(plan(histogram, capacity))
    most = max(histogram.values(), default=0)
    buckets = max(1, -(-most // rows_each))
    bucket = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)).cast("int")
    ranked = grouped_rank(parts, ["length"], bucket, [F.col("doc_id"), F.col("piece"), F.col("start"), F.col("ids_crc32")], "place")
    names = parts.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy()
            place = batch.column("place").to_numpy()
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            cuts = np.flatnonzero(np.diff(length[order])) + 1
            for rows in np.split(order, cuts) if len(order) else ():
                starts, first, at = where[int(length[rows[0]])]
                k = np.searchsorted(starts, place[rows], side="right") - 1
                sequence[rows] = first[k] + place[rows] - starts[k]
                offset[rows] = at[k]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema.fields)
    return arrow(ranked, run, f"{schema}, sequence_id long, offset long")
