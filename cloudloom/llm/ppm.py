"""Language-model scoring by prediction by partial matching over bytes.

The model is a trie of byte contexts up to ``order`` bytes with the counts of the
symbols that followed them in the training texts (A-Z lower-cased, an end symbol after
each text). A symbol a context has not seen is coded by an escape (estimate: distinct
symbols over total plus distinct) and looked up one byte shorter, where the symbols
already refused are excluded; below the empty context all bytes are alike. Because
the model is pretrained, the probability of a symbol depends on the ``order`` bytes
before it and on nothing else: it is worked out once per gram (context and symbol)
and range of contexts, and a text's score is the sum over its grams.

Every counted context is kept. Grams are dealt out by the hash of their three newest
context bytes, so a range holds whole branches of the trie; texts ask for the distinct
grams of a block of texts, and the answers are joined back to the block. Only the
counts of contexts of up to two bytes are sent to all tasks: at most 256 ** 3 cells,
whatever the corpus, and far fewer in text.

The base score is a word unigram model with add-one smoothing: a block asks for the
counts of its distinct words in the same exchange, by ranges of the words' hashes, so a
word of all texts costs its range one entry per block. Words are told apart by 64 bits.

Edge cases: a null text is an empty one, its score that of the end symbol; texts of
any length are scored whole; repeated rows count as often as they occur and are scored
each; without training rows every symbol has probability 1/256. An empty table gives
an empty result. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from cloudloom.llm.common import arrow, encoded, saved, shuffle_parts, sliced
from cloudloom.llm.hashed import _LOWER, laid, mixed, range_of, runs, word_hashes

_U = np.uint64
#: The end symbol: a byte that UTF-8 never uses.
END = 0xFF


def symbols(raw: bytes, order: int) -> np.ndarray:
    """The text's symbols behind ``order`` end symbols, with the end symbol after it."""
    out = np.full(order + len(raw) + 1, END, dtype=np.uint8)
    out[order : order + len(raw)] = _LOWER[np.frombuffer(raw, np.uint8)]
    return out


# ---------------------------------------------------------------- training


def grams(texts: DataFrame, order: int, block: int = 1 << 20) -> DataFrame:
    """gram (context bytes, then the symbol in the lowest byte), n: counts over all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        total = 0

        def merge() -> tuple[np.ndarray, np.ndarray]:
            code, at = np.unique(np.concatenate([c for c, _ in held]), return_inverse=True)
            return code, np.bincount(at, weights=np.concatenate([n for _, n in held]).astype(float)).astype(np.int64)

        for batch in sliced(batches, "text", block):
            parts = [symbols(raw, order) for raw in encoded(batch.column("text"))]
            if not parts:
                continue
            for start, s in _blocks(parts, order, block):
                held.append(np.unique(codes(s, order)[start], return_counts=True))
                total += len(held[-1][0])
                if total > 1_500_000:
                    held = [merge()]
                    if len(held[0][0]) > 1_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(held[0][0].view(np.int64)), pa.array(held[0][1])], names=["gram", "n"])
                        held = []
                    total = sum(len(c) for c, _ in held)
        if held:
            code, n = merge()
            yield pa.RecordBatch.from_arrays([pa.array(code.view(np.int64)), pa.array(n)], names=["gram", "n"])

    return arrow(texts.select("text"), run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def _blocks(parts: list[np.ndarray], order: int, block: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Joined symbol sequences of about ``block``, with the mask of places that are symbols of a text."""
    held, size = [], 0
    for s in parts:
        for a in range(0, len(s) - order, block):
            piece = s[a : min(len(s), a + block + order)]
            held.append(piece)
            size += len(piece)
            if size >= block:
                yield _joined(held, order)
                held, size = [], 0
    if held:
        yield _joined(held, order)


def _joined(held: list[np.ndarray], order: int) -> tuple[np.ndarray, np.ndarray]:
    s = np.concatenate(held)
    real = np.ones(len(s) - order, dtype=bool)
    at = np.cumsum([len(x) for x in held])[:-1]
    for d in range(order):
        real[at - order + d] = False
    return real, s


def codes(s: np.ndarray, order: int) -> np.ndarray:
    """The gram that ends at each symbol behind the first ``order``."""
    code = np.zeros(len(s) - order, dtype=_U)
    for d in range(order + 1):
        code = code << _U(8) | s[d : len(s) - order + d].astype(_U)
    return code


# ---------------------------------------------------------------- probabilities

#: Contexts of so many bytes at most are known to every task.
NEAR = 2


def _summed(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sum of each."""
    each, at = np.unique(key, return_inverse=True)
    return each, np.bincount(at, weights=n, minlength=len(each))


def _at(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each wanted key among sorted keys, and whether it is there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), dtype=bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


class Branches:
    """Contexts with the counts of their symbols, complete for all suffixes of the grams asked for."""

    def __init__(self, order: int, gram: np.ndarray, n: np.ndarray, near: tuple[np.ndarray, np.ndarray]):
        """``gram``, ``n``: training counts; ``near``: counts of all grams with ``NEAR`` context bytes."""
        self.order = order
        self.cells: list[tuple[np.ndarray, np.ndarray]] = []
        self.nodes: list[tuple[np.ndarray, ...]] = []
        low = min(NEAR, order)
        for d in range(order + 1):
            key, times = near if d <= low else (gram, n)
            cell, count = _summed(key & _U((1 << 8 * (d + 1)) - 1), times)
            node, at = np.unique(cell >> _U(8), return_inverse=True)
            total = np.bincount(at, weights=count, minlength=len(node))
            kinds = np.bincount(at, minlength=len(node)).astype(float)
            rest = rest_kinds = np.zeros(len(node))
            if d:
                # what the context one byte shorter holds besides the symbols seen here
                up, _ = _at(self.cells[-1][0], cell & _U((1 << 8 * d) - 1))
                refused = np.bincount(at, weights=self.cells[-1][1][up], minlength=len(node)) if len(cell) else total
                parent, _ = _at(self.nodes[-1][0], node & _U((1 << 8 * (d - 1)) - 1))
                if len(node):
                    rest = self.nodes[-1][1][parent] - refused
                    rest_kinds = self.nodes[-1][2][parent] - kinds
            self.cells.append((cell, count))
            self.nodes.append((node, total, kinds, rest, rest_kinds))

    def log10(self, gram: np.ndarray) -> np.ndarray:
        """log10 probability of the symbol of each gram after its context."""
        out = np.zeros(len(gram))
        open_ = np.ones(len(gram), dtype=bool)
        # of the escape from the context one byte longer; none yet where no longer context is known
        total, kinds = np.zeros(len(gram)), np.zeros(len(gram))
        begun = np.zeros(len(gram), dtype=bool)
        for d in range(self.order, -1, -1):
            cell, count = self.cells[d]
            node, all_, each, rest, rest_kinds = self.nodes[d]
            asked = gram & _U((1 << 8 * (d + 1)) - 1)
            x, there = _at(node, asked >> _U(8))
            if not there.any():
                continue
            c, seen = _at(cell, asked)
            total = np.where(begun, total, all_[x])
            kinds = np.where(begun, kinds, each[x])
            base = np.maximum(total + kinds, 1)
            hit, miss = open_ & there & seen, open_ & there & ~seen
            out[hit] += np.log10(count[c[hit]] / base[hit])
            miss &= kinds > 0
            out[miss] += np.log10(kinds[miss] / base[miss])
            open_ &= ~hit
            begun |= there
            total, kinds = np.where(there, rest[x], total), np.where(there, rest_kinds[x], kinds)
        known = self.nodes[0][2][0] if len(self.nodes[0][0]) else 0
        out[open_] -= np.log10(max(1, 256 - known))
        return out


def _dealt_grams(gram: np.ndarray, ranges: int, order: int) -> Iterator[tuple[int, np.ndarray]]:
    """(range, places in ``gram``) of the grams of each range."""
    branch = gram >> _U(8) & _U((1 << 8 * min(NEAR + 1, order)) - 1)
    where = range_of(mixed(branch), ranges).astype(np.int64)
    by = np.argsort(where, kind="stable")
    used, starts = np.unique(where[by], return_index=True)
    if len(used):
        yield from zip(used.tolist(), np.split(by, starts[1:]), strict=True)


def _dealt_words(words: np.ndarray, ranges: int) -> Iterator[tuple[int, np.ndarray]]:
    """(range, places in ``words``) of the word hashes of each range; they follow the grams' ranges."""
    where = range_of(words, ranges).astype(np.int64) + ranges
    by = np.argsort(where, kind="stable")
    used, starts = np.unique(where[by], return_index=True)
    if len(used):
        yield from zip(used.tolist(), np.split(by, starts[1:]), strict=True)


def scored(docs: DataFrame, order: int, per_range: int, block: int = 16 << 20) -> DataFrame:
    """doc_id, held_out, n_words, part (sum of log10(c + 1) over its words), n_known, score (log10 probability) of every row.

    One more row has ``fact`` set and in n_words the number of kinds of training words.
    """
    spark = docs.sparkSession
    counted = saved(grams(docs.where("not held_out"), order), "grams")
    low = min(NEAR, order)
    cells = counted.groupBy(F.expr(f"gram & {(1 << 8 * (low + 1)) - 1}L").alias("gram")).agg(F.sum("n").alias("n")).toArrow()
    near = spark.sparkContext.broadcast((cells.column("gram").to_numpy().astype(_U), cells.column("n").to_numpy().astype(float)))
    buckets = shuffle_parts(spark)
    ranges = max(buckets, -(-counted.count() // per_range))
    kind = docs.schema["doc_id"].dataType.simpleString()
    fields = ["block", "range", "asked", "times", "ids", "held", "lengths", "texts"]

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per block of texts a row with the texts (range -1) and a row per range with the grams, or words and their training counts."""
        packer, held, size, number = zstandard.ZstdCompressor(level=1), [], 0, 0
        here = TaskContext.get().partitionId() << 32

        def out() -> pa.RecordBatch:
            all_ = pa.Table.from_batches(held).combine_chunks()
            raws = encoded(all_.column("text").combine_chunks())
            parts = [np.unique(codes(s, order)[real]) for real, s in _blocks([symbols(r, order) for r in raws], order, 1 << 20)]
            asked = np.unique(np.concatenate(parts))
            trains = np.logical_not(all_.column("held_out").to_numpy())
            own = [word_hashes(r) for r in raws]
            words, at = np.unique(np.concatenate(own), return_inverse=True)
            times = np.bincount(at, weights=np.repeat(trains, [len(w) for w in own]), minlength=len(words)).astype(np.int64)
            rows = [(r, asked[p].tobytes(), None) for r, p in _dealt_grams(asked, ranges, order)]
            rows += [(r, words[p].tobytes(), times[p].tobytes()) for r, p in _dealt_words(words, ranges)]
            one = lambda x: pa.concat_arrays([pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x), pa.nulls(len(rows), pa.list_(x.type))])
            columns = [
                pa.array([here + number] * (1 + len(rows)), pa.int64()), pa.array([-1, *[r for r, *_ in rows]], pa.int64()),
                pa.array([None, *[x for _, x, _ in rows]], pa.binary()), pa.array([None, *[t for *_, t in rows]], pa.binary()),
                one(all_.column("doc_id").combine_chunks()), one(all_.column("held_out").combine_chunks()), one(pa.array([len(r) for r in raws], pa.int64())),
                pa.array([packer.compress(b"".join(raws)), *[None] * len(rows)], pa.binary()),
            ]
            return pa.RecordBatch.from_arrays(columns, names=fields)

        for batch in sliced(batches, "text", 1 << 20):
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.column("text").nbytes
            if size >= block:
                yield out()
                held, size, number = [], 0, number + 1
        if held:
            yield out()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gram = batch.column("gram").to_numpy().view(_U)
            n = batch.column("n").to_numpy()
            rows = [(-1, r, gram[at].tobytes(), n[at].tobytes()) for r, at in _dealt_grams(gram, ranges, order)]
            arrays = [pa.array([x[i] for x in rows], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.binary(), pa.binary()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["block", "range", "asked", "times"])

    def of_grams(rows: list) -> Iterator[tuple]:
        trained = [(np.frombuffer(g, _U), np.frombuffer(t, np.int64)) for b, g, t in rows if b < 0]
        gram = np.concatenate([np.zeros(0, _U), *[g for g, _ in trained]])
        n = np.concatenate([np.zeros(0), *[t.astype(float) for _, t in trained]])
        asked = [(b, np.frombuffer(g, _U)) for b, g, _ in rows if b >= 0]
        if asked:
            each = np.unique(np.concatenate([g for _, g in asked]))
            logs = Branches(order, gram, n, near.value).log10(each)
            for b, g in asked:
                yield b, g.tobytes(), logs[np.searchsorted(each, g)].tobytes()

    def of_words(rows: list) -> Iterator[tuple]:
        """The training counts of the words each block asks for, in the order asked, and the number of kinds for block -1."""
        asked = [np.frombuffer(w, _U) for _, w, _ in rows]
        each, at = np.unique(np.concatenate(asked), return_inverse=True)
        c = np.bincount(at, weights=np.concatenate([np.frombuffer(t, np.int64) for *_, t in rows])).astype(np.int64)
        for (b, *_), x in zip(rows, np.split(c[at], np.cumsum([len(x) for x in asked])[:-1]), strict=True):
            yield b, None, x.tobytes()
        yield -1, None, np.array([(c > 0).sum()], np.int64).tobytes()

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r, rows in runs(batches):
            for b, asked, told in (of_grams if r < ranges else of_words)(rows):
                cols = [pa.array([b], pa.int64()), pa.array([r], pa.int64()), pa.array([asked], pa.binary()), pa.array([told], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["block", "range", "asked", "told"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "held_out", "n_words", "part", "n_known", "score", "fact"]
        types = [id_type, pa.bool_(), pa.int64(), pa.float64(), pa.int64(), pa.float64(), pa.bool_()]
        for b, rows in runs(batches):
            if b < 0:
                kinds = sum(int(np.frombuffer(t, np.int64)[0]) for _, _, t, *_ in rows)
                yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip((None, None, kinds, None, None, None, True), types, strict=True)], names=names)
                continue
            gram = np.concatenate([np.frombuffer(g, _U) for r, g, *_ in rows if 0 <= r < ranges])
            by = np.argsort(gram)
            gram, log = gram[by], np.concatenate([np.frombuffer(t) for r, _, t, *_ in rows if 0 <= r < ranges])[by]
            ids, held, lengths, packed = next(x[3:] for x in rows if x[0] < 0)
            joined, start, raws = memoryview(zstandard.ZstdDecompressor().decompress(packed)), 0, []
            for length in lengths:
                raws.append(joined[start : start + length])
                start += length
            own = [word_hashes(bytes(r)) for r in raws]
            words = np.unique(np.concatenate(own))
            c, told = np.zeros(len(words), np.int64), {r: np.frombuffer(t, np.int64) for r, _, t, *_ in rows if r >= ranges}
            for r, places in _dealt_words(words, ranges):
                c[places] = told[r]
            part, known, scores = [], [], []
            for raw, w in zip(raws, own, strict=True):
                s, sum_ = symbols(bytes(raw), order), 0.0
                for a in range(0, len(s) - order, 1 << 20):
                    sum_ += log[np.searchsorted(gram, codes(s[a : a + order + (1 << 20)], order))].sum()
                scores.append(float(sum_))
                found = c[np.searchsorted(words, w)]
                part.append(float(np.log10(found + 1.0).sum()))
                known.append(int((found > 0).sum()))
            columns = (ids, held, [len(w) for w in own], part, known, scores, [False] * len(ids))
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, types, strict=True)], names=names)

    id_type = to_arrow_type(docs.schema["doc_id"].dataType)
    schema = f"block long, range long, asked binary, times binary, ids array<{kind}>, held array<boolean>, lengths array<long>, texts binary"
    blocks = saved(arrow(docs.select("doc_id", "held_out", "text"), ask, schema), "blocks")
    trained = arrow(counted, count, "block long, range long, asked binary, times binary")
    both = blocks.where("range >= 0").select("range", "block", "asked", "times").unionByName(trained)
    # two blocks a task, about, however many there are
    buckets = max(buckets, -(-blocks.where("range = -1").count() // 2))
    answers = arrow(laid(both, 2 * ranges), answer, "block long, range long, asked binary, told binary")
    texts = blocks.where("range = -1").select("block", "range", *fields[4:])
    back = answers.unionByName(texts, allowMissingColumns=True).select("block", "range", "asked", "told", *fields[4:])
    return arrow(laid(back, buckets), total, f"doc_id {kind}, held_out boolean, n_words long, part double, n_known long, score double, fact boolean")


def held_out(doc_id: str = "doc_id", parts: int = 7, left: int = 2) -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % parts == left


def score(docs: DataFrame, order: int = 4, per_range: int = 1 << 22) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    rows = saved(scored(docs.select("doc_id", "text", held_out().alias("held_out")), order, per_range), "scores")
    facts = rows.agg(
        F.coalesce(F.sum(F.when(F.col("fact"), F.col("n_words"))), F.lit(0)).alias("kinds"),
        F.coalesce(F.sum(F.when(~F.col("fact") & ~F.col("held_out"), F.col("n_words") + 1)), F.lit(0)).alias("tokens"),
        F.count_if(~F.col("fact") & ~F.col("held_out")).alias("texts"),
    ).first()
    kinds = facts["kinds"] + (facts["texts"] > 0)
    per_token = F.log10(F.lit(float(facts["tokens"] + kinds + 1)))
    end = F.log10(F.lit(float(facts["texts"] + 1)))
    n_tokens = F.col("n_words") + 1
    return rows.where("not fact").select(
        "doc_id", "held_out", n_tokens.alias("n_tokens"),
        (F.col("n_known") + (1 if facts["texts"] else 0)).alias("n_known"),
        F.lit(facts["tokens"]).cast("long").alias("train_tokens"),
        (F.col("part") + end - per_token * n_tokens).alias("base_score"),
        "score",
    )
