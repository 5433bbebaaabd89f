"""Periodic runs of words: the linear method of Gusfield and Stoye for tandem repeats.

A run is a maximal stretch of words with smallest period q that is long enough: at least
``least`` words and ``times`` periods. They are found in three steps over a text of word numbers:

1. Lempel-Ziv blocks. Where a block ends, the text is compared with itself ``k`` words
   apart, ahead and back, for every ``k`` up to the sizes of the blocks there. That gives
   the leftmost stretch of every kind of repeat, a covering set of its squares.
2. Each stretch's first square is located in the suffix tree, and walks along suffix
   links, each square dropping its first word and taking it up again at its end, mark the
   places of all its rotations: the complete vocabulary, wherever the squares occur.
3. The leaves below the marked places are the squares' occurrences; neighbouring
   occurrences of one period merge into runs, and the short ones go.

Suffixes are sorted by doubling: the names of all stretches of 2^j words also answer how far
two places agree, for whole arrays of places at once. Words that can lie in no run are left
out first: a run of four periods has every three of its words three times or more in its
text, so the words of rarer triples cut a text into stretches, each with its runs whole. The
stretches of several texts share one tree, apart by separators that occur once.

A text is worked on whole, in one task: memory is about 60 bytes a word of it, and about 500
bytes a word of its stretches; texts are gathered up to ``GATHER`` bytes. Rows never move.

Edge cases: a null text, like an empty one, has no words: no runs and an empty collapsed
text. Each row is worked on by itself, also where ids repeat or are null (a null id is
decimally an empty string). Words are compared byte by byte. Other columns are not read.
"""

from __future__ import annotations

import bisect
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cloudloom.llm.common import arrow, encoded, sliced
from cloudloom.llm.hashed import mixed

#: Bytes of text worked on together.
GATHER = 2 << 20
RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


class Names:
    """Numbers (ranks) of all stretches of 1, 2, 4, ... elements; the text ends with an element that occurs once."""

    def __init__(self, text: np.ndarray):
        n = len(text)
        rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
        self.levels = [rank]
        while rank.max() + 1 < n:
            width = 1 << (len(self.levels) - 1)
            second = np.zeros(n, np.int64)
            second[: n - width] = rank[width:] + 1
            rank = np.unique(rank * (n + 1) + second, return_inverse=True)[1]
            self.levels.append(rank)
        self.order = np.argsort(rank)  # the suffix array
        self.rank = rank

    def ahead(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many elements from ``i`` and from ``j`` (other places) on agree."""
        far = np.zeros(len(i), np.int64)
        for p in range(len(self.levels) - 1, -1, -1):
            level = self.levels[p]
            far += (level[i + far] == level[j + far]).astype(np.int64) << p
        return far

    def back(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many elements before ``i`` and before ``j`` agree."""
        far = np.zeros(len(i), np.int64)
        low = np.minimum(i, j)
        for p in range(len(self.levels) - 1, -1, -1):
            level, step = self.levels[p], far + (1 << p)
            fits = step <= low
            far += (fits & (level[np.where(fits, i - step, i)] == level[np.where(fits, j - step, j)])).astype(np.int64) << p
        return far

    def named(self, place: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two numbers that tell a stretch from all others of its size (>= 1)."""
        p = np.frexp(size)[1] - 1
        first, second = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
        for k in np.unique(p).tolist():
            at = p == k
            first[at] = self.levels[k][place[at]]
            second[at] = self.levels[k][place[at] + size[at] - (1 << k)]
        return first, second


def blocks(names: Names) -> np.ndarray:
    """Starts of the Lempel-Ziv blocks: each the longest stretch that also begins earlier, or a single new element."""
    order = names.order.tolist()
    n = len(order)
    earlier_up, earlier_down = [-1] * n, [-1] * n
    stack: list[int] = []
    for x in order:
        while stack and stack[-1] > x:
            earlier_down[stack.pop()] = x
        if stack:
            earlier_up[x] = stack[-1]
        stack.append(x)
    place, longest = np.arange(n), np.zeros(n, np.int64)
    for earlier in (np.array(earlier_up), np.array(earlier_down)):
        has = earlier >= 0
        longest[has] = np.maximum(longest[has], names.ahead(place[has], earlier[has]))
    sizes, starts, i = longest.tolist(), [], 0
    while i < n:
        starts.append(i)
        i += max(1, sizes[i])
    return np.array(starts)


def leftmost(text: np.ndarray, names: Names, room: np.ndarray, least: int, times: int) -> np.ndarray:
    """(start, end, period) of the stretches found at block borders, the smallest period of each. ``room``: longest period at a place."""
    starts = blocks(names)
    ends = np.append(starts[1:], len(text))
    size = ends - starts
    after = np.append(size[1:], 0)
    pairs = []
    for base, most, sign in ((ends[:-1], size[:-1], -1), (starts, size + after, 1)):
        most = np.minimum(most, np.maximum(room[base], room[np.maximum(base - 1, 0)]))
        at = np.repeat(base, most)
        k = np.arange(len(at)) - np.repeat(np.cumsum(most) - most, most) + 1
        i, j = (at - k, at) if sign < 0 else (at, at + k)
        fits = (i >= 0) & (j < len(text))
        i, j = i[fits], j[fits]
        touch = (text[i] == text[j]) | (text[np.maximum(i - 1, 0)] == text[j - 1])
        pairs.append((i[touch], j[touch]))
    i, j = (np.concatenate(x) for x in zip(*pairs, strict=True))
    k = j - i
    start, end = i - names.back(i, j), j + names.ahead(i, j)
    long = end - start >= np.maximum(least, times * k)
    found = np.unique(np.column_stack((start[long], end[long], k[long])), axis=0)
    return found[np.concatenate(([True], (found[1:, :2] != found[:-1, :2]).any(1)))] if len(found) else found


class Tree:
    """The suffix tree's inner nodes: depth, first and last leaf (in suffix order), parent, children in order, suffix links."""

    def __init__(self, names: Names):
        order = names.order
        n = len(order)
        shared = [0, *names.ahead(order[:-1], order[1:]).tolist(), 0]
        depth, left, right, up, above, path = [0], [0], [n - 1], [0], [0] * n, [0]
        for r in range(1, n + 1):
            d, first, last = shared[r], r - 1, -1
            if d <= depth[path[-1]]:
                above[r - 1] = path[-1]
            while depth[path[-1]] > d:
                last = path.pop()
                right[last], first = r - 1, left[last]
                up[last] = path[-1]
            if depth[path[-1]] < d:
                own = len(depth)
                if last >= 0:
                    up[last] = own
                else:
                    above[r - 1] = own
                depth.append(d)
                left.append(first)
                right.append(n - 1)
                up.append(path[-1])
                path.append(own)
        self.depth, self.left, self.right, self.up, self.above = (np.array(x, dtype=np.int64) for x in (depth, left, right, up, above))
        self._link(names)
        nodes = np.lexsort((self.left, self.up))
        nodes = nodes[nodes > 0]  # the root is nobody's child
        self.children = nodes.tolist()
        self.lefts = self.left[nodes].tolist()
        self.ranges = np.searchsorted(self.up[nodes], np.arange(len(depth) + 1)).tolist()

    def _link(self, names: Names) -> None:
        """Suffix links: the node of what follows a node's first element, by the names of both."""
        n = len(names.order)
        inner = np.flatnonzero(self.depth > 0)
        place, size = names.order[self.left[inner]], self.depth[inner]
        deep = size > 1
        sizes = np.concatenate((size, size[deep] - 1))
        first, second = names.named(np.concatenate((place, place[deep] + 1)), sizes)
        named = np.unique(sizes * (n + 1) + first, return_inverse=True)[1]
        named = np.unique(named * (n + 1) + second, return_inverse=True)[1]
        node = np.zeros(int(named.max(initial=0)) + 1, np.int64)
        node[named[: len(inner)]] = inner
        self.link = np.zeros(len(self.depth), np.int64)
        self.link[inner[deep]] = node[named[len(inner) :]]

    def located(self, leaf: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The highest node above each leaf that is at least so deep, jumping up by powers of two."""
        jumps = [self.up]
        while jumps[-1].any():
            jumps.append(jumps[-1][jumps[-1]])
        node = self.above[leaf]
        for jump in reversed(jumps):
            node = np.where(self.depth[jump[node]] >= size, jump[node], node)
        return node

    def vocabulary(self, names: Names, found: np.ndarray) -> np.ndarray:
        """(first leaf, last leaf, period) of every rotation of the squares that begin the stretches ``found``."""
        depth, up, link, rank = self.depth.tolist(), self.up.tolist(), self.link.tolist(), names.rank
        heads = self.located(rank[found[:, 0]], 2 * found[:, 2]).tolist()
        marked: set[tuple[int, int]] = set()
        for (start, _, period), node in zip(found.tolist(), heads, strict=True):
            size = 2 * period
            leaves = rank[start : start + period + 1].tolist()
            for step in range(1, period + 1):
                if (node, period) in marked:
                    break  # the walk has come round, or another has been here
                marked.add((node, period))
                node = link[up[node]]
                while depth[node] < size:  # down towards the square that begins one word later
                    at = bisect.bisect_right(self.lefts, leaves[step], self.ranges[node], self.ranges[node + 1]) - 1
                    node = self.children[at]
        told = np.array(sorted(marked), dtype=np.int64).reshape(-1, 2)
        return np.column_stack((self.left[told[:, 0]], self.right[told[:, 0]], told[:, 1]))


def merged(names: Names, vocabulary: np.ndarray, least: int, times: int) -> np.ndarray:
    """Runs (start, length, period), by start and period, from all occurrences of the vocabulary."""
    n = len(names.order)
    count = vocabulary[:, 1] - vocabulary[:, 0] + 1
    leaf = np.arange(count.sum()) + np.repeat(vocabulary[:, 0] - (np.cumsum(count) - count), count)
    key = np.sort(np.repeat(vocabulary[:, 2], count) * (n + 1) + names.order[leaf])
    fresh = np.flatnonzero(np.concatenate(([True], np.diff(key) != 1)))
    period, start = key[fresh] // (n + 1), key[fresh] % (n + 1)
    length = np.diff(np.append(fresh, len(key))) - 1 + 2 * period
    runs = np.column_stack((start, length, period))[length >= np.maximum(least, times * period)]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def runs_of(text: np.ndarray, least: int = 6, times: int = 4) -> np.ndarray:
    """Runs (start, length, period) of a text of numbers in which stretches are set apart, and the end, by numbers that occur once (negative)."""
    if len(text) <= least:
        return np.zeros((0, 3), np.int64)
    names = Names(text)
    border = np.flatnonzero(text < 0)
    size = np.diff(np.concatenate(([-1], border))) - 1
    room = np.append(np.repeat(size // times, size + 1), 0)[: len(text)]
    found = leftmost(text, names, room, least, times)
    if not len(found):
        return np.zeros((0, 3), np.int64)
    return merged(names, Tree(names).vocabulary(names, found), least, times)


# -------------------------------------------------- texts


def stretches(ids: np.ndarray, text: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, end) of the stretches of words that may lie in runs: words of triples met three times in their text."""
    none = np.zeros(0, np.int64)
    if len(ids) < least:
        return none, none
    u = ids.astype(np.uint64)
    key = mixed(u[:-2] * np.uint64(0x9E3779B97F4A7C15) ^ mixed(u[1:-1] + (text[2:].astype(np.uint64) << np.uint64(40))) * np.uint64(0xA0761D6478BD642F) ^ u[2:])
    within = text[2:] == text[:-2]
    order = np.argsort(key)
    key = key[order]
    often = key[2:] == key[:-2]  # three alike in a row
    at = np.unique(np.concatenate((order[2:][often], order[1:-1][often], order[:-2][often])))
    at = at[within[at]]
    inside = np.zeros(len(ids), bool)
    for d in range(3):
        inside[at + d] = True
    cut = np.concatenate(([True], (inside[1:] != inside[:-1]) | (text[1:] != text[:-1]), [True]))
    edges = np.flatnonzero(cut)
    starts, ends = edges[:-1], edges[1:]
    starts, ends = starts[inside[starts]], ends[inside[starts]]
    long = ends - starts >= least
    return starts[long], ends[long]


def text_runs(texts: list[list[bytes]], least: int = 6, times: int = 4) -> list[list[tuple[int, int, int]]]:
    """Runs (start, length, period) of each text's words."""
    names: dict[bytes, int] = {}
    ids = np.array([names.setdefault(w, len(names)) for words in texts for w in words], dtype=np.int64)
    sizes = [len(words) for words in texts]
    which = np.repeat(np.arange(len(texts)), sizes)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    first, end = stretches(ids, which, least)
    if not len(first):
        return out
    size = end - first + 1  # a separator ends each
    begin = np.cumsum(size) - size
    joint = np.arange(size.sum()) + np.repeat(first - begin, size)
    last = begin + size - 1
    joint[last] = 0
    line = ids[joint]
    line[last] = -1 - np.arange(len(last))
    found = runs_of(line, least, times)
    home = np.searchsorted(begin, found[:, 0], side="right") - 1
    place = found[:, 0] - begin[home] + first[home]
    owner = which[place]
    place -= (np.cumsum(sizes) - sizes)[owner]
    for t, s, n, q in zip(owner.tolist(), place.tolist(), found[:, 1].tolist(), found[:, 2].tolist(), strict=True):
        out[t].append((s, n, q))
    return out


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words but for those of any run after its first period, joined by one space."""
    if not runs:
        return b" ".join(words)
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return b" ".join([words[i] for i in np.flatnonzero(keep).tolist()])


def find_runs(
    docs: DataFrame, least: int = 6, times: int = 4, id_col: str = "doc_id", text_col: str = "text", edit: Callable[[object, list[bytes]], list[bytes]] | None = None
) -> DataFrame:
    """Per document: its id, runs (start, length, period; by start, then period), collapsed text.

    ``edit(id, words)`` may change a document's words first. ``times`` must be at least 4:
    the stretches that are left out rest on it.
    """
    if times < 4 or least < 6:
        raise ValueError("runs of at least six words and four periods are found")
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType)]).add("runs", T.StructType.fromDDL(f"runs {RUNS}")[0].dataType).add("collapsed", "string")
    kind = pa.list_(pa.struct({"start": pa.int64(), "length": pa.int64(), "period": pa.int64()}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", GATHER):
            ids = batch.column(0).to_pylist()
            texts = [raw.split() for raw in encoded(batch.column(1))]
            if edit is not None:
                texts = [edit(i, words) for i, words in zip(ids, texts, strict=True)]
            found = text_runs(texts, least, times)
            told = [[{"start": s, "length": n, "period": q} for s, n, q in runs] for runs in found]
            left = pa.array([collapsed(w, r) for w, r in zip(texts, found, strict=True)], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(told, kind), left], names=schema.names)

    return arrow(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), run, schema)
