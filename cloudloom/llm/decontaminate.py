"""Benchmark decontamination: one Aho-Corasick automaton over normalised benchmark windows.

Benchmark items and documents are normalised alike: A-Z lower-cased, words are maximal runs
of ASCII letters, digits and characters beyond ASCII. Every ``size`` consecutive words of an
item are a window (a shorter item is one window). The distinct windows, found by Spark, make
one automaton over word numbers; each document's words pass through it once, and what lies
in an occurrence of any window is hit. Hits are mapped back to places in the original text.

The automaton goes to every task as a broadcast of at most ``most_windows`` (window, item)
pairs. A larger benchmark is cut by a hash of the window into several automata, which scan
the texts one after the other, the hits so far written in between: nothing is capped.
A text is scanned in stretches, each beginning with the last words of the one before. Rows
of documents never move between tasks, so hot texts and repeated rows cost nothing more.

Edge cases: a null text, of a document or an item, has no words and no windows. Items of an
equal id are one item; a null id is told as an empty string. Rows of documents are scanned
each by itself, also where ids repeat or are null. Without windows nothing is hit. Other
columns are not read.
"""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cloudloom.llm.common import arrow, encoded, saved, sliced

#: Normalisation byte by byte: what is no word byte becomes a space.
NORMAL = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
#: Bytes of a text scanned at once.
STRETCH = 1 << 20
FOUND = "words array<struct<first: bigint, last: bigint>>, items array<string>"


def normal_words(raw: bytes) -> list[bytes]:
    return raw.translate(NORMAL).split()


def windows(benchmark: DataFrame, size: int, item_col: str, text_col: str) -> DataFrame:
    """Distinct (window, item): the window's words joined by one space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            told: list[str] = []
            items: list[str] = []
            for item, raw in zip(batch.column(0).to_pylist(), encoded(batch.column(1)), strict=True):
                words = normal_words(raw)
                n = min(size, len(words))
                found = {b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)} if n else ()
                told += [x.decode("utf-8", "replace") for x in found]
                items += [item] * len(found)
            yield pa.RecordBatch.from_pydict({"window": pa.array(told, pa.string()), "item": pa.array(items, pa.string())})

    rows = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.col(text_col).alias("text"))
    return arrow(rows, run, "window string, item string").distinct()


class Automaton:
    """The automaton over numbered words, and the items of each window."""

    def __init__(self, pairs: list[tuple[str, str]]):
        self.numbers: dict[bytes, int] = {}
        self.items: list[list[str]] = []
        self.lengths: list[int] = []
        self.longest = 0
        self.machine = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        for k, (window, group) in enumerate(itertools.groupby(sorted(pairs), key=lambda x: x[0])):
            key = tuple(self.numbers.setdefault(w, len(self.numbers) + 1) for w in window.encode().split(b" "))
            self.machine.add_word(key, k)
            self.items.append([x for _, x in group])
            self.lengths.append(len(key))
            self.longest = max(self.longest, len(key))
        if self.items:
            self.machine.make_automaton()

    def scan(self, raw: bytes, stretch: int = STRETCH) -> tuple[int, list[tuple[int, int]], set[int]]:
        """Number of words, occurrences as (first, last) word, windows found."""
        clean = raw.translate(NORMAL)
        start, words, tail = 0, 0, ()
        hits: list[tuple[int, int]] = []
        found: set[int] = set()
        number, lengths = self.numbers.get, self.lengths
        while start < len(clean):
            end = clean.find(b" ", start + stretch)
            end = len(clean) if end < 0 else end
            own = clean[start:end].split()
            if self.items:
                ids = tail + tuple([number(w, 0) for w in own])
                before = words - len(tail)
                for last, k in self.machine.iter(ids):
                    hits.append((before + last + 1 - lengths[k], before + last))
                    found.add(k)
                tail = ids[len(ids) - min(len(ids), self.longest - 1) :]
            words += len(own)
            start = end
        return words, hits, found


def joined_up(hits: list[tuple[int, int]], words: int) -> list[tuple[int, int]]:
    """Stretches of words that lie in any hit."""
    if not hits:
        return []
    first, last = np.array(hits).T
    edge = np.zeros(words + 1, np.int64)
    np.add.at(edge, first, 1)
    np.add.at(edge, last + 1, -1)
    inside = np.concatenate(([False], np.cumsum(edge[:-1]) > 0, [False]))
    flips = np.flatnonzero(inside[1:] != inside[:-1])
    return list(zip(flips[::2].tolist(), (flips[1::2] - 1).tolist(), strict=True))


def places(raw: bytes, stretches: list[tuple[int, int]], step: int = STRETCH) -> list[tuple[int, int]]:
    """(start, end) in code points of the original text of stretches of words, ascending; the end is exclusive."""
    wanted = np.array(stretches, dtype=np.int64).reshape(-1, 2)
    starts, ends = np.zeros(len(wanted), np.int64), np.zeros(len(wanted), np.int64)
    begin = words = points = 0
    clean = raw.translate(NORMAL)
    while begin < len(raw) and len(wanted):
        stop = clean.find(b" ", begin + step)
        stop = len(raw) if stop < 0 else stop
        b = np.frombuffer(raw, np.uint8, stop - begin, begin)
        edge = np.diff(np.concatenate(([0], np.frombuffer(clean, np.uint8, stop - begin, begin) != 32, [0])).astype(np.int8))
        first, last = np.flatnonzero(edge > 0), np.flatnonzero(edge < 0)
        point = points + np.concatenate(([0], np.cumsum((b & 0xC0) != 0x80)))
        for column, at, out in ((0, first, starts), (1, last, ends)):
            here = (wanted[:, column] >= words) & (wanted[:, column] < words + len(first))
            out[here] = point[at[wanted[here, column] - words]]
        words += len(first)
        points = int(point[-1])
        begin = stop
    return list(zip(starts.tolist(), ends.tolist(), strict=True))


_AUTOMATA: dict[str, Automaton] = {}


def _automaton(shared: tuple[str, Broadcast]) -> Automaton:
    """The automaton of the broadcast pairs of that name, made once in a Python worker."""
    name, pairs = shared
    if name not in _AUTOMATA:
        _AUTOMATA.clear()
        _AUTOMATA[name] = Automaton(pairs.value)
    return _AUTOMATA[name]


def _marked(rows: DataFrame, shared: tuple[str, Broadcast]) -> DataFrame:
    """(id, text, words, items) with what this automaton finds added."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _automaton(shared)
        for batch in sliced(batches, "text"):
            words, items = [], []
            for raw, w, it in zip(encoded(batch.column(1)), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                n, hits, found = own.scan(raw)
                if hits:
                    w = joined_up(hits + [(x["first"], x["last"]) for x in w], n)
                    w = [{"first": a, "last": b} for a, b in w]
                    it = sorted({*it, *(x for k in found for x in own.items[k])})
                words.append(w)
                items.append(it)
            columns = [batch.column(0), batch.column(1), pa.array(words, batch.schema.field(2).type), pa.array(items, batch.schema.field(3).type)]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return arrow(rows, run, rows.schema)


def scan(
    docs: DataFrame, benchmark: DataFrame, size: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", most_windows: int = 200_000,
) -> DataFrame:
    """Per document: its id, n_words, n_hit, items (ids as strings, sorted), spans (start, end in code points of the text)."""
    spark = docs.sparkSession
    found = saved(windows(benchmark, size, item_col, item_text_col), "windows")
    parts = max(1, -(-found.count() // most_windows))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    for field in T.StructType.fromDDL(FOUND).fields:
        rows = rows.withColumn(field.name, F.array().cast(field.dataType))
    shared: tuple[str, Broadcast] | None = None
    for p in range(parts):
        if p:
            rows = saved(_marked(rows, shared), f"marked{p}")
        own = found.where(F.pmod(F.xxhash64("window"), F.lit(parts)) == p).toArrow().to_pydict()
        shared = uuid.uuid4().hex, spark.sparkContext.broadcast(list(zip(own["window"], own["item"], strict=True)))
    kind = rows.schema["id"].dataType
    schema = T.StructType([T.StructField(id_col, kind)]).add("n_words", "long").add("n_hit", "long").add("items", T.ArrayType(T.StringType()))
    schema = schema.add("spans", T.StructType.fromDDL("spans array<struct<start: bigint, end: bigint>>")[0].dataType)

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _automaton(shared)
        for batch in sliced(batches, "text"):
            told = []
            for raw, w, it in zip(encoded(batch.column(1)), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                n, hits, found = own.scan(raw)
                spans = joined_up(hits + [(x["first"], x["last"]) for x in w], n)
                it = sorted({*it, *(x for k in found for x in own.items[k])}) if found else it
                told.append((n, sum(b + 1 - a for a, b in spans), it, [{"start": a, "end": b} for a, b in places(raw, spans)] if spans else []))
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.struct({"start": pa.int64(), "end": pa.int64()})))
            columns = [pa.array([x[i] for x in told], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=schema.names)

    return arrow(rows, last, schema)
