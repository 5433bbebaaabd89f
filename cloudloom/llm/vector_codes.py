"""Vector code compression: product codes by exact Lloyd rounds with heaps of bounds.

Vectors become integers, are cut into equal consecutive parts, and every part position
gets a codebook by Lloyd's rounds. A part need not be compared with its codebook each
round: the distance to its own entry grows at most by that entry's way, the distance to
the second nearest shrinks at most by the longest way of the others. So each entry has, in
every block of vectors, a heap of its parts keyed by lower minus upper bound at the time of
their last scan plus the entry's drift until then. After an update the drift grows, and only
the parts at the top of the heap that it has reached are popped, scanned exactly against the
whole codebook (ties to the lower index) and pushed onto their entry's heap; all others
provably keep their entry. Entry sums follow from the parts that moved.

A block row holds its integers and its heaps; a round reads the blocks, writes them anew to
the shared scratch, and sums the moves of all tasks by (part, entry, place). Nothing is
shuffled but these sums. The driver holds the codebooks, entries x dimension integers,
whatever the number of vectors. Distances and sums are exact integers; the bounds, which are
rounded, are shrunk by more than their rounding, so equal distances are always scanned.

Edge cases: rows whose vector is null or holds null or non-finite components are dropped, and
so are empty vectors and those whose length is not a multiple of ``parts`` or not that of the
smallest kept id. With fewer kept rows than entries, the codebook has as many entries as
rows. Null ids sort last; rows of an equal id are taken in order of their vectors and each
coded by itself. An empty table gives no rows and empty codebooks. Components of 65,536 and
more in magnitude, whose squares could leave 64 bits, raise an error. Other columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from cloudloom.llm.common import arrow, saved
from cloudloom.llm.graph import joined

#: Components are floors of so many times their value.
SCALE = 1024
#: Vectors of a block at most, and integers of it.
BLOCK_ROWS, BLOCK_CELLS = 4_096, 1 << 20
#: Largest magnitude of an integer component.
MOST = 1 << 26


@dataclass(frozen=True)
class Fitted:
    """``books``: per part position the final entries, a row each. ``rows``: id, label, codes, error of every kept vector."""

    books: list[np.ndarray]
    rows: DataFrame

    def text(self) -> str:
        """All final components in decimal, by part, entry and place, comma-joined."""
        return ",".join(str(x) for book in self.books for x in book.ravel().tolist())


# -------------------------------------------------- exact distances


def distances(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distances of every row of ``x`` to every entry: doubles where these are exact, else 64-bit integers."""
    most = int(np.abs(x).max(initial=0)) + int(np.abs(book).max(initial=0))
    kind = np.float64 if x.shape[1] * most * most < 1 << 52 else np.int64
    x, book = x.astype(kind), book.astype(kind)
    return (x * x).sum(1)[:, None] - 2 * (x @ book.T) + (book * book).sum(1)


def scan(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry (ties to the lower index) and slack: a bound below second nearest minus nearest distance."""
    d = distances(x, book)
    at = np.arange(len(x))
    near = d.argmin(1)
    first = np.sqrt(d[at, near].astype(np.float64))
    if len(book) == 1:
        return near, np.full(len(x), np.inf)
    second = np.sqrt(np.partition(d, 1, axis=1)[:, 1].astype(np.float64))
    return near, second - first - 1e-12 * (first + second)


# -------------------------------------------------- heaps


class Heaps:
    """A heap of (key, row in block) per entry, packed as arrays; an entry is unpacked when it is touched."""

    def __init__(self, entries: int, packed: bytes | None = None):
        self.touched: dict[int, list[tuple[float, int]]] = {}
        if packed is None:
            self.ends = np.zeros(entries + 1, np.int32)
            self.rows, self.keys = np.zeros(0, np.int16), np.zeros(0, np.float32)
        else:
            self.ends = np.frombuffer(packed, np.int32, entries + 1)
            n = int(self.ends[-1])
            self.keys = np.frombuffer(packed, np.float32, n, 4 * (entries + 1))
            self.rows = np.frombuffer(packed, np.int16, n, 4 * (entries + 1) + 4 * n)

    def _slice(self, e: int) -> slice:
        return slice(int(self.ends[e]), int(self.ends[e + 1]))

    def heap(self, e: int) -> list[tuple[float, int]]:
        if e not in self.touched:
            s = self._slice(e)
            self.touched[e] = list(zip(self.keys[s].tolist(), self.rows[s].tolist(), strict=True))
        return self.touched[e]

    def popped(self, drift: np.ndarray) -> tuple[list[int], list[int]]:
        """Rows whose key the drift of their entry has reached, and their entries."""
        rows: list[int] = []
        own: list[int] = []
        used = np.flatnonzero(np.diff(self.ends))
        for e in used[self.keys[self.ends[used]] <= drift[used]].tolist():
            heap = self.heap(e)
            while heap and heap[0][0] <= drift[e]:
                rows.append(heapq.heappop(heap)[1])
                own.append(e)
        return rows, own

    def push(self, entries: np.ndarray, keys: np.ndarray, rows: np.ndarray) -> None:
        low = np.nextafter(keys.astype(np.float32), np.float32(-np.inf))  # a key in fewer bits is a lower one
        for e, k, r in zip(entries.tolist(), low.tolist(), rows.tolist(), strict=True):
            heapq.heappush(self.heap(e), (k, r))

    def owners(self) -> np.ndarray:
        """Entry of every row of the block."""
        all_rows, own = [], []
        for e in range(len(self.ends) - 1):
            r = [x[1] for x in self.touched[e]] if e in self.touched else self.rows[self._slice(e)].tolist()
            all_rows += r
            own += [e] * len(r)
        out = np.zeros(len(own), np.int64)
        out[all_rows] = own
        return out

    def packed(self) -> bytes:
        entries = len(self.ends) - 1
        keys, rows, ends = [], [], np.zeros(entries + 1, np.int32)
        for e in range(entries):
            if e in self.touched:
                pairs = self.touched[e]
                keys.append(np.array([k for k, _ in pairs], np.float32))
                rows.append(np.array([r for _, r in pairs], np.int16))
            else:
                keys.append(self.keys[self._slice(e)])
                rows.append(self.rows[self._slice(e)])
            ends[e + 1] = ends[e] + len(rows[-1])
        return ends.tobytes() + np.concatenate(keys).tobytes() + np.concatenate(rows).tobytes()


class Moves:
    """Changes of the entries' counts and sums over the blocks of a task."""

    def __init__(self, books: list[np.ndarray]):
        self.sums = [np.zeros((len(b), b.shape[1] + 1), np.int64) for b in books]

    def add(self, part: int, x: np.ndarray, old: np.ndarray | None, new: np.ndarray) -> None:
        x = np.column_stack((np.ones(len(x), np.int64), x.astype(np.int64)))
        np.add.at(self.sums[part], new, x)
        if old is not None:
            np.subtract.at(self.sums[part], old, x)

    def rows(self) -> list[dict]:
        return [
            {"part": p, "entry": int(e), "sums": s[e].tolist()} for p, s in enumerate(self.sums) for e in np.flatnonzero(s.any(1))
        ]


def settle(part: int, x: np.ndarray, heaps: Heaps, book: np.ndarray, drift: np.ndarray, moves: Moves) -> None:
    """Pop the parts whose bounds the drift has violated, scan them exactly, push them again."""
    rows, own = heaps.popped(drift)
    if not rows:
        return
    at, old = np.array(rows), np.array(own)
    near, slack = scan(x[at], book)
    heaps.push(near, slack + drift[near], at)
    moved = near != old
    moves.add(part, x[at[moved]], old[moved], near[moved])


def drifted(drift: np.ndarray, old: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Cumulative drift after the entries went from ``old`` to ``new``: own way plus the longest way of the others."""
    way = np.sqrt(((new - old).astype(np.float64) ** 2).sum(1))
    order = np.sort(way)
    others = np.where(way == order[-1], order[-2] if len(way) > 1 else 0.0, order[-1]) if len(way) else way
    if len(way) > 1 and order[-1] == order[-2]:
        others = np.full(len(way), order[-1])
    return (drift + way + others) * (1 + 1e-12)


# -------------------------------------------------- blocks


def integers(vectors: pa.Array, length: int) -> np.ndarray:
    flat = np.floor(SCALE * np.asarray(vectors.flatten(), dtype=np.float64)).reshape(-1, length)
    if np.abs(flat).max(initial=0) >= MOST:
        raise ValueError("components of 65,536 and more are out of range")
    return flat.astype(np.int32)


def _packed(data: np.ndarray) -> bytes:
    """Integers in 16 bits each where they fit, the lower bytes apart from the higher ones, which compress well."""
    small = np.abs(data).max(initial=0) < 1 << 15
    raw = data.astype(np.int16 if small else np.int32)
    width = raw.itemsize
    return bytes([width]) + np.ascontiguousarray(raw.view(np.uint8).reshape(-1, width).T).tobytes()


def _data(packed: bytes, length: int) -> np.ndarray:
    width = packed[0]
    raw = np.frombuffer(packed, np.uint8, offset=1).reshape(width, -1)
    return np.ascontiguousarray(raw.T).view(np.int16 if width == 2 else np.int32).reshape(-1, length).astype(np.int32)


def _parts(data: np.ndarray, n: int) -> list[np.ndarray]:
    width = data.shape[1] // n
    return [data[:, p * width : (p + 1) * width] for p in range(n)]


CHANGES = "changes array<struct<part: int, entry: int, sums: array<bigint>>>"


def _schema(ids: T.DataType, labels: T.DataType, parts: int) -> T.StructType:
    heaps = [T.StructField(f"heaps{p}", T.BinaryType()) for p in range(parts)]
    return T.StructType(
        [T.StructField("ids", T.ArrayType(ids)), T.StructField("labels", T.ArrayType(labels)), T.StructField("data", T.BinaryType()), *heaps,
         *T.StructType.fromDDL(CHANGES).fields]
    )


def _first_round(rows: DataFrame, books: list[np.ndarray], schema: T.StructType) -> DataFrame:
    """Blocks of the rows, every part scanned once."""
    length, n = sum(b.shape[1] for b in books), len(books)
    kinds = [to_arrow_type(f.dataType) for f in schema.fields]
    size = max(1, min(BLOCK_ROWS, BLOCK_CELLS // length))
    none = np.zeros(len(books[0]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        moves = Moves(books)
        held: list[pa.RecordBatch] = []

        def block(table: pa.Table) -> pa.RecordBatch:
            table = table.combine_chunks()
            ids, labels, vectors = (c.chunk(0) if c.num_chunks else pa.array([], c.type) for c in table.columns)
            data = integers(vectors, length)
            heaps = []
            for p, x in enumerate(_parts(data, n)):
                near, slack = scan(x, books[p])
                moves.add(p, x, None, near)
                h = Heaps(len(books[p]))
                h.push(near, slack + none[near], np.arange(len(x)))
                heaps.append(h.packed())
            values = [[ids], [labels], [_packed(data)], *[[h] for h in heaps], [None]]
            return _batch(values)

        def _batch(values: list) -> pa.RecordBatch:
            made = [pa.array([v[0].to_pylist() if isinstance(v[0], pa.Array) else v[0]], k) for v, k in zip(values, kinds, strict=True)]
            return pa.RecordBatch.from_arrays(made, names=schema.names)

        count = 0
        for batch in batches:
            held.append(batch)
            count += batch.num_rows
            while count >= size:
                table = pa.Table.from_batches(held)
                yield block(table.slice(0, size))
                held = table.slice(size).to_batches()
                count -= size
        if count:
            yield block(pa.Table.from_batches(held))
        yield _batch([[None]] * (3 + n) + [[moves.rows()]])

    return arrow(rows, run, schema)


def _next_round(blocks: DataFrame, books: list[np.ndarray], drifts: list[np.ndarray], schema: T.StructType) -> DataFrame:
    """The blocks with their heaps after the drift, and what moved."""
    length, n = sum(b.shape[1] for b in books), len(books)
    kinds = [to_arrow_type(f.dataType) for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        moves = Moves(books)
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                data = _data(row.column(2)[0].as_py(), length)
                new = []
                for p, x in enumerate(_parts(data, n)):
                    heaps = Heaps(len(books[p]), row.column(3 + p)[0].as_py())
                    settle(p, x, heaps, books[p], drifts[p], moves)
                    new.append(pa.array([heaps.packed()], kinds[3 + p]))
                columns = [row.column(0), row.column(1), row.column(2), *new, pa.array([None], kinds[-1])]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)
        told = [pa.array([None], k) for k in kinds[:-1]] + [pa.array([moves.rows()], kinds[-1])]
        yield pa.RecordBatch.from_arrays(told, names=schema.names)

    return arrow(blocks.where("data is not null"), run, schema)


def _coded_schema(ids: T.DataType, labels: T.DataType) -> T.StructType:
    return T.StructType([T.StructField("id", ids), T.StructField("label", labels), *T.StructType.fromDDL("codes array<int>, error bigint").fields])


def _coded(blocks: DataFrame, books: list[np.ndarray], drifts: list[np.ndarray], ids: T.DataType, labels: T.DataType) -> DataFrame:
    """Id, label, codes and exact error of every vector, parts settled once more."""
    length, n = sum(b.shape[1] for b in books), len(books)
    schema = _coded_schema(ids, labels)
    kinds = [to_arrow_type(f.dataType) for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                data = _data(batch.column(2)[i].as_py(), length)
                codes, error = [], np.zeros(len(data), np.int64)
                for p, x in enumerate(_parts(data, n)):
                    heaps = Heaps(len(books[p]), batch.column(3 + p)[i].as_py())
                    settle(p, x, heaps, books[p], drifts[p], Moves(books))
                    own = heaps.owners()
                    way = x.astype(np.int64) - books[p][own]
                    error += (way * way).sum(1)
                    codes.append(own)
                listed = pa.array(np.column_stack(codes).tolist(), kinds[2])
                columns = [batch.column(0)[i].values.cast(kinds[0]), batch.column(1)[i].values.cast(kinds[1]), listed, pa.array(error, kinds[3])]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return arrow(blocks.where("data is not null").drop("changes"), run, schema)


def _updated(blocks: DataFrame, sums: list[np.ndarray], books: list[np.ndarray]) -> list[np.ndarray]:
    """Entries as floors of their parts' means; ``sums`` (counts first) take in the moves. Unused entries stay."""
    each = blocks.where("changes is not null").select(F.explode("changes").alias("c"))
    each = each.select("c.part", "c.entry", F.posexplode("c.sums").alias("place", "value"))
    for r in each.groupBy("part", "entry", "place").agg(F.sum("value").alias("value")).collect():
        sums[r["part"]][r["entry"], r["place"]] += r["value"]
    new = []
    for s, book in zip(sums, books, strict=True):
        used = s[:, 0] > 0
        fresh = book.copy()
        fresh[used] = s[used, 1:] // s[used, :1]
        new.append(fresh)
    return new


# -------------------------------------------------- the operator


def kept(vectors: DataFrame, vector: str, parts: int) -> DataFrame:
    """Rows whose vector has finite components only and can be cut into equal parts."""
    good = F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vectors.where(F.coalesce(good, F.lit(False)) & (F.size(vector) > 0) & (F.size(vector) % parts == 0))


def compress(
    vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label"
) -> Fitted:
    """Codebooks by ``rounds`` Lloyd rounds from the ``entries`` smallest ids, and every kept vector's codes."""
    ids, labels = vectors.schema[id_col].dataType, vectors.schema[label_col].dataType
    rows = kept(vectors, vector_col, parts).select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    by_id = [F.col("id").asc_nulls_last(), F.col("v")]
    smallest = rows.orderBy(*by_id).select("v").first()
    if smallest is None:
        return Fitted([], vectors.sparkSession.createDataFrame([], _coded_schema(ids, labels)))
    length = len(smallest["v"])
    rows = rows.where(F.size("v") == length)
    first = integers(pa.array([r["v"] for r in rows.orderBy(*by_id).select("v").limit(entries).collect()]), length)
    books = [x.astype(np.int64) for x in _parts(first, parts)]
    sums = [np.zeros((len(b), b.shape[1] + 1), np.int64) for b in books]
    drifts = [np.zeros(len(b)) for b in books]
    schema = _schema(ids, labels, parts)
    blocks = saved(_first_round(rows, books, schema), "codes0")
    for k in range(rounds):
        if k:
            blocks = saved(_next_round(blocks, books, drifts, schema), f"codes{k}")
        new = _updated(blocks, sums, books)
        drifts = [drifted(d, o, c) for d, o, c in zip(drifts, books, new, strict=True)]
        books = new
    return Fitted(books, saved(_coded(blocks, books, drifts, ids, labels), "codes"))


def label_errors(rows: DataFrame) -> DataFrame:
    """``rows`` with label_error: the error summed over rows of an equal label, nulls together. A label many rows have is joined where they lie."""
    keyed = rows.withColumn("__k", F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit("")))
    sums = keyed.groupBy("__k").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("__n"))
    return joined(keyed, sums, "__k", "__n", rows.count()).drop("__k")
