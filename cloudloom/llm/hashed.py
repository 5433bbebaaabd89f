"""Vectorised 64-bit hashes of words and word shingles of whole texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_POWERS: list[np.ndarray] = []
#: Bytes hashed at once; texts are cut at white space.
_BLOCK = 1 << 18


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread every bit over the word (in place)."""
    h ^= h >> _U(32)
    h *= _U(0xD6E8FEB86659FD93)
    h ^= h >> _U(32)
    h *= _U(0xD6E8FEB86659FD93)
    h ^= h >> _U(32)
    return h


def _powers(n: int) -> list[np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, _BLOCK + (_BLOCK >> 2))
        _POWERS[:] = []
        for base in (_BASE, _INVERSE):
            p = np.full(size, base, dtype=_U)
            p[0] = 1
            _POWERS.append(np.cumprod(p, dtype=_U))
    return _POWERS


def _block(raw: bytes) -> np.ndarray:
    """Hashes of the words of a stretch that starts and ends at word borders."""
    b = _LOWER[np.frombuffer(raw, np.uint8)]
    edge = np.diff(np.concatenate(([1], _SPACE[b], [1])).astype(np.int8))
    starts, ends = np.flatnonzero(edge < 0), np.flatnonzero(edge > 0)
    if not len(starts):
        return np.zeros(0, _U)
    power, inverse = _powers(len(b) + 1)
    total = np.zeros(len(b) + 1, _U)
    np.cumsum((b.astype(_U) + _U(1)) * power[: len(b)], out=total[1:])
    h = (total[ends] - total[starts]) * inverse[starts]
    return mixed(h + (ends - starts).astype(_U) * _U(0xA0761D6478BD642F))


def word_hashes(raw: bytes) -> np.ndarray:
    """One hash per word (A-Z lower-cased), in order, of a text of any length."""
    if len(raw) <= _BLOCK:
        return _block(raw)
    parts, start = [], 0
    while start < len(raw):
        end = min(len(raw), start + _BLOCK)
        while end < len(raw) and not _SPACE[raw[end]]:
            end += 1
        parts.append(_block(raw[start:end]))
        start = end
    return np.concatenate(parts)


def shingles(words: np.ndarray, width: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; fewer words than ``width`` are one shingle."""
    n = len(words)
    if not n:
        return words
    use = min(width, n)
    h = np.full(n - use + 1, use * 0x8EBC6AF09C88C6E3 % (1 << 64), dtype=_U)
    factor = 1
    for k in range(use):
        factor = factor * 0xE7037ED1A0B428DB % (1 << 64)
        h += words[k : n - use + 1 + k] * _U(factor)
    return np.unique(mixed(h))


# -------------------------------------------------- entries dealt out by range of the hash


def range_of(h: np.ndarray, ranges: int) -> np.ndarray:
    """Range of a hash, from its low 16 bits and then its top 16: up to 2 ** 32 ranges."""
    return ((h & _U(0xFFFF)) << _U(16) | h >> _U(48)) * _U(ranges) >> _U(32)


#: An owner that stands for those already credited.
NOBODY = 0


class Flush:
    """Collects (hash, owner) entries and gives them out as one blob per range.

    An entry is 48 bits of the hash and 16 of the owner's number in the flush; with
    the range, 48 + log2(ranges) bits tell hashes apart, and the ranges grow with the
    input. Hashes that several owners of the flush have go out once, owned by NOBODY,
    and these owners are credited here: a hash that very many owners have costs its
    range one entry per flush.
    """

    def __init__(self, most_entries: int = 1 << 19):
        self.most = most_entries
        self.clear()

    def clear(self) -> None:
        self.hashes: list[np.ndarray] = []
        self.owners: list[int] = []
        self.held = 0

    def add(self, owner: int, hashes: np.ndarray) -> None:
        """``hashes``: distinct."""
        self.owners.append(owner)
        self.hashes.append(hashes)
        self.held += len(hashes)

    @property
    def full(self) -> bool:
        return self.held >= self.most or len(self.owners) >= 65_534

    def out(self, ranges: int) -> tuple[list[tuple[int, np.ndarray, np.ndarray]], np.ndarray, np.ndarray]:
        """(range, entries, owners) of each range, then the owners credited and how often."""
        h = np.concatenate(self.hashes)
        owners = np.append(np.array(self.owners, dtype=np.int64), NOBODY)
        number = np.repeat(np.arange(len(self.owners), dtype=_U), [len(x) for x in self.hashes])
        order = np.argsort(h, kind="stable")
        h, number = h[order], number[order]
        fresh = np.concatenate(([True], h[1:] != h[:-1]))
        several = np.diff(np.append(np.flatnonzero(fresh), len(h))) > 1
        credited = np.bincount(number[np.repeat(several, np.diff(np.append(np.flatnonzero(fresh), len(h))))].astype(np.int64), minlength=len(self.owners))
        h, number = h[fresh], np.where(several, _U(len(self.owners)), number[fresh])
        where = range_of(h, ranges).astype(np.int64)
        order = np.argsort(where, kind="stable")
        used, starts = np.unique(where[order], return_index=True)
        rows = []
        for r, at in zip(used.tolist(), np.split(order, starts[1:]), strict=True):
            there, local = np.unique(number[at].astype(np.int64), return_inverse=True)
            rows.append((r, (h[at] & ~_U(0xFFFF)) | local.astype(_U), owners[there]))
        some = np.flatnonzero(credited)
        self.clear()
        return rows, owners[some], credited[some]


def merged(entries: list[np.ndarray], owners: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Blobs of one range as arrays of the hash part and the owner of every entry."""
    h = np.concatenate(entries)
    who = np.concatenate([o[(e & _U(0xFFFF)).astype(np.int64)] for e, o in zip(entries, owners, strict=True)])
    return h & ~_U(0xFFFF), who


# -------------------------------------------------- blobs through Spark


def runs(batches: Iterator) -> Iterator[tuple[int, list[tuple]]]:
    """(first column, the other columns' rows) of each run of an equal first column."""
    now, held = None, []
    for batch in batches:
        for first, *rest in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if first != now and held:
                yield now, held
                held = []
            now = first
            held.append(rest)
    if held:
        yield now, held


def laid(blobs, parts: int):
    """Blob rows by their first column, each value's rows together."""
    first = blobs.columns[0]
    return blobs.repartition(parts, first).sortWithinPartitions(first)


def dealt(keys: np.ndarray, columns: list[np.ndarray], buckets: int) -> tuple[list[int], list[list[bytes]]]:
    """Rows of equal-length columns dealt out by key: the buckets, and per column (keys first) a blob for each."""
    where = (mixed(keys.astype(np.int64).view(_U).copy()) % _U(buckets)).astype(np.int64)
    order = np.argsort(where, kind="stable")
    used, starts = np.unique(where[order], return_index=True)
    parts = np.split(order, starts[1:]) if len(used) else []
    return used.tolist(), [[c[p].tobytes() for p in parts] for c in (keys, *columns)]
