"""Document fingerprints: a quartile bucket digest.

Six hashed byte triplets are taken from every five-byte window and counted in
128 buckets. The digest holds, in hexadecimal: one checksum byte, one byte for
the length on a logarithmic scale, one byte with the ratios of the quartiles of
the bucket counts, and two bits per bucket naming the quartile its count falls
into. Two digests are compared by a bounded difference score: quartile steps of
the buckets plus circular differences of the header; likeness is one minus the
score over its bound.

Edge cases: null is an empty text; texts under five bytes have empty counts and
differ by their header alone. Equal texts have equal digests. Texts are read
whole whatever their length (counted block by block). Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloudloom.llm.common import arrow, shuffle_parts, sliced

BUCKETS = 128
#: Places of a triplet's bytes in the window of five; each has its own multiplier.
TRIPLETS = ((0, 1, 2), (0, 1, 3), (1, 2, 3), (0, 2, 4), (1, 3, 4), (2, 3, 4))
_ODD = np.array([0x9E3779B1 * (2 * i + 1) % (1 << 32) | 1 for i in range(18)], dtype=np.uint32).reshape(6, 3)
_BLOCK = 1 << 18
#: Steps of a bucket (0 to 3) score 0, 1, 2 or 6: extremes that swap places count more.
_STEP = np.array([0, 1, 2, 6])
#: Header parts: length and ratios, circular; the bound of the whole score.
_LENGTH_STEP, _LENGTH_MOST, _RATIO_MOST = 4, 48, 16
MOST = 1 + _LENGTH_MOST + 2 * _RATIO_MOST + 6 * BUCKETS


def counts(raw: bytes) -> np.ndarray:
    """Counts of hashed triplets per bucket."""
    total = np.zeros(BUCKETS, dtype=np.int64)
    for start in range(0, max(0, len(raw) - 4), _BLOCK):
        part = np.frombuffer(raw, np.uint8, min(_BLOCK + 4, len(raw) - start), start).astype(np.uint32)
        n = len(part) - 4
        for (a, b, c), (x, y, z) in zip(TRIPLETS, _ODD, strict=True):
            h = part[a : a + n] * x
            h ^= h >> 15
            h += part[b : b + n] * y
            h ^= h >> 13
            h += part[c : c + n] * z
            h *= np.uint32(0x85EBCA6B)
            h >>= np.uint32(25)
            total += np.bincount(h.view(np.int32), minlength=BUCKETS)
    return total


def length_code(n: int) -> int:
    """Bytes on a logarithmic scale, eight steps to a doubling."""
    return min(255, round(8 * math.log2(n + 1)))


def digest(raw: bytes) -> str:
    """The fingerprint of a text's UTF-8 bytes: 70 hexadecimal digits."""
    c = counts(raw)
    q1, q2, q3 = np.sort(c)[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    body = (c > q1).astype(np.uint8) + (c > q2) + (c > q3)
    four = body.reshape(-1, 4)
    packed = (four[:, 0] << 6 | four[:, 1] << 4 | four[:, 2] << 2 | four[:, 3]).astype(np.uint8)
    ratio = [int(16 * q // q3) % 16 if q3 else 0 for q in (q1, q2)]
    check = hashlib.blake2b(raw, digest_size=1).digest()[0]
    return bytes([check, length_code(len(raw)), ratio[0] << 4 | ratio[1]]).hex() + packed.tobytes().hex()


def difference(a: str, b: str) -> int:
    """0 (alike) to MOST."""
    x, y = np.frombuffer(bytes.fromhex(a), np.uint8), np.frombuffer(bytes.fromhex(b), np.uint8)
    score = int(x[0] != y[0])
    score += min(_LENGTH_MOST, _LENGTH_STEP * max(0, abs(int(x[1]) - int(y[1])) - 1))
    for shift in (4, 0):
        d = abs((int(x[2]) >> shift & 15) - (int(y[2]) >> shift & 15))
        score += min(d, 16 - d) * _RATIO_MOST // 8
    u, v = x[3:], y[3:]
    for shift in (6, 4, 2, 0):
        score += int(_STEP[np.abs((u >> shift & 3).astype(np.int8) - (v >> shift & 3).astype(np.int8))].sum())
    return score


def likeness(a: str, b: str) -> float:
    return 1.0 - difference(a, b) / MOST


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            marks = [digest((t or "").encode()) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(marks, pa.string())], names=["doc_id", "fingerprint"])

    return arrow(docs.select("doc_id", "text"), run, "doc_id long, fingerprint string")


def _bucket(edges: list[int]) -> F.Column:
    """How many of the sorted edges are below doc_id, by binary search."""
    size = 1
    while size <= len(edges):
        size *= 2
    padded = F.array(*[F.lit(int(e)) for e in edges], *[F.lit((1 << 63) - 1)] * (size - len(edges)))
    steps = []
    while size > 1:
        size //= 2
        steps.append(size)
    if not steps:
        return F.lit(0)
    seek = F.aggregate(
        F.array(*map(F.lit, steps)),
        F.lit(0),
        lambda at, step: F.when(F.get(padded, at + step - 1) < F.col("doc_id"), at + step).otherwise(at),
    )
    return F.coalesce(seek, F.lit(0))


def with_next(docs: DataFrame, work, schema: str) -> DataFrame:
    """Run ``work(rows)`` over (doc_id, text, next text) in descending doc_id (null last).

    ``rows`` is an iterator; the row after the last is the first. Rows are dealt out
    by ranges of doc_id in one shuffle; the head of every range also goes to the
    range before it, so no task needs another's rows. A task gets one range. Ties follow the
    text's hash; all rows of one doc_id (an identity, so few) lie in one range.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text").withColumn("tie", F.xxhash64("text"))
    parts = shuffle_parts(spark)
    cut = [i / parts for i in range(1, parts)]
    edges = sorted(set(docs.select("doc_id").approxQuantile("doc_id", cut, 0.2 / parts))) if cut else []
    dealt = docs.withColumn("bucket", _bucket([int(x) for x in edges]))
    key = F.struct(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("k"), F.col("doc_id").isNotNull().alias("some"), "tie")
    heads = sorted(
        ((r["bucket"], r["head"]) for r in dealt.groupBy("bucket").agg(F.max(key).alias("head")).collect()), reverse=True
    )
    if not heads:
        return spark.createDataFrame([], schema)
    # a head is sent on to the bucket that precedes its own; the first bucket's to the last
    rows = [(b, heads[i - 1][0], *h) for i, (b, h) in enumerate(heads)]
    ends = spark.createDataFrame(rows, "h_bucket int, h_to int, h_k long, h_some boolean, h_tie long")
    # a row per shuffle partition at most
    sent = dealt.join(F.broadcast(ends), F.col("bucket") == F.col("h_bucket"))
    is_head = F.struct(F.col("h_k").alias("k"), F.col("h_some").alias("some"), F.col("h_tie").alias("tie")) == key
    sent = sent.withColumn("copy", F.explode(F.when(is_head, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))))
    sent = sent.withColumn("bucket", F.when(F.col("copy"), F.col("h_to")).otherwise(F.col("bucket")))
    order = [F.col("bucket"), F.col("copy"), F.col("doc_id").desc_nulls_last(), F.col("tie").desc()]
    laid = sent.repartitionById(len(edges) + 1, F.col("bucket")).sortWithinPartitions(*order).select("bucket", "copy", "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            last = None
            for batch in batches:
                for now in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                    if last is not None and now[0] == last[0] and not last[1]:
                        yield last[2], last[3] or "", now[3] or ""
                    last = now

        yield from work(rows())

    return arrow(laid, run, schema)


def edited(text: str, after: str) -> str:
    """The last half of the code points replaced by the first as many of ``after``."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def near_copies(docs: DataFrame, rows_each: int = 2_000) -> DataFrame:
    """Fingerprints of texts and of their edited forms, with likeness to the edited and the next text."""
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    names = [p.split()[0] for p in schema.split(", ")]

    def work(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), *[pa.string()] * 3, pa.float64(), pa.float64()]
        out: list[tuple] = []
        known: tuple[str, str] = ("", digest(b""))
        for doc_id, text, after in rows:
            own = known[1] if known[0] == text else digest(text.encode())
            new = edited(text, after).encode()
            mark = digest(new)
            known = (after, digest(after.encode()))
            out.append((doc_id, len(text), hashlib.sha256(new).hexdigest(), own, mark, likeness(own, mark), likeness(own, known[1])))
            if len(out) == rows_each:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return with_next(docs, work, schema)
