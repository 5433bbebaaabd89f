"""Secret scans with a recursive decoding worklist.

Layer 0 is the text itself. Each layer is scanned for the secret kinds, then
unwrapped: URL escapes and ``\\u`` / ``\\x`` escapes rewrite the whole layer
character by character, base64 runs yield a layer each, and gzip, zlib, bzip2,
xz or bare deflate bytes found under base64 or URL escapes are decompressed. Decoded bytes
are read as UTF-8 or, where every other byte says so, UTF-16. Lines of wrapped base64, of
any width, are joined; a run that does not decode as it stands (text is glued to it, or a line
too many is joined) is decoded at all four alignments, of which the readable
stretches and the compressed parts are layers. Runs of under 16 characters, lines joined, are no
layers: they hold at most 11 bytes, and no kind of secret is that short. URL escapes
that are not UTF-8 stay as they are, those beside them are decoded. New layers join
the worklist until none is left; a layer whose content was seen before is dropped,
which ends cycles. Every layer knows which span of the original text a character
came from (kept as runs of equal steps, not per character), so a finding in any
layer is reported as a span of the original text.

Edge cases: null is an empty text without spans; texts of any length are scanned
whole; equal spans of a kind found in several layers are one span; undecodable
runs are left alone. Bytes that decompress to more than ``most_bytes`` are opened
as a stream, a layer per ``most_bytes``, each with the last ``OVERLAP`` bytes of the
one before: nothing is skipped, memory stays bounded, and a finding has one span
wherever it lies in the stream. Rows are independent; extra columns are never read.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import hashlib
import io
import lzma
import re
import urllib.parse
import zlib
from array import array
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from cloudloom.llm.common import arrow, sliced

KINDS = ("assign", "access", "hex")
# letters of the key words in either case, ASCII only
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KEY_WORDS = (b"passw", b"secret", b"token", b"apikey", b"api_key")

URL = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
ESCAPE = re.compile(r"\\u\{([0-9A-Fa-f]{1,6})\}|\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})")
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
#: Between two lines of wrapped base64: a line end, also an escaped one, and indentation.
LINE_END = re.compile(r"[ \t]*(?:\r\n|\n|\r|\\r\\n|\\n)[ \t]*")
WRAPPED = re.compile(rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]++(?:{LINE_END.pattern}[A-Za-z0-9+/_-]+)+")
URL_BYTES = re.compile(r"(?<![A-Za-z0-9_.~/+-])[A-Za-z0-9_.~/+-]*+%[0-9A-Fa-f]{2}(?:%[0-9A-Fa-f]{2}|[A-Za-z0-9_.~/+-])*+")
#: How gzip, bzip2, xz and zlib begin.
PACKED = re.compile(rb"\x1f\x8b\x08|BZh[1-9]|\xfd7zXZ\x00|\x78[\x01\x5e\x9c\xda]")
#: A readable stretch among other bytes.
STRETCH = re.compile(rb"(?:[\t\n\r\x20-\x7e]|[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}){8,}")

#: Characters that take equally many bytes.
EQUAL = re.compile(r"[\0-\x7f]+|[\x80-\u07ff]+|[\u0800-\uffff]+|[\U00010000-\U0010ffff]+")
#: Bytes that a part of a long stream repeats from the part before it.
OVERLAP = 1 << 16

Span = tuple[int, int, int]


def base_spans(text: str, raw: bytes | None = None) -> list[Span]:
    """(start, end, kind) of the three kinds, leftmost and non-overlapping in each kind."""
    found: list[Span] = []
    raw = text.encode("utf-8", "surrogatepass") if raw is None else raw
    low = raw.lower()
    if any(k in low for k in KEY_WORDS):
        found += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if b"AKIA" in raw:
        found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    found.sort(key=lambda x: (x[0], x[2], x[1]))
    return found


class Places:
    """Where characters came from: runs of characters whose spans have one width and lie one step apart."""

    __slots__ = ("first", "n", "start", "step", "width")

    def __init__(self):
        # by run: its first character, the start of its span, the step to the next one's, the width
        self.first, self.start, self.step, self.width = (array("q") for _ in range(4))
        self.n = 0

    def add(self, start: int, step: int, width: int, times: int = 1) -> None:
        if self.first:
            held, k = self.n - self.first[-1], start - self.start[-1]
            if width == self.width[-1]:
                if held == 1 and k > 0 and (times == 1 or step == k):
                    self.step[-1] = k
                    self.n += times
                    return
                if held > 1 and k == held * self.step[-1] and (times == 1 or step == self.step[-1]):
                    self.n += times
                    return
        for column, x in zip((self.first, self.start, self.step, self.width), (self.n, start, step, width), strict=True):
            column.append(x)
        self.n += times

    def span(self, a: int, b: int) -> tuple[int, int]:
        """The span of characters a to b; spans never go back, so the first and the last tell it."""
        i, j = bisect_right(self.first, a) - 1, bisect_right(self.first, b - 1) - 1
        return self.start[i] + self.step[i] * (a - self.first[i]), self.start[j] + self.step[j] * (b - 1 - self.first[j]) + self.width[j]

    def copy(self, other: Places, a: int, b: int) -> None:
        """Add the places of characters a to b of ``other``."""
        i = bisect_right(other.first, a) - 1
        while a < b:
            end = min(b, other.first[i + 1] if i + 1 < len(other.first) else other.n)
            self.add(other.start[i] + other.step[i] * (a - other.first[i]), other.step[i], other.width[i], end - a)
            a, i = end, i + 1


class Layer:
    """A decoded text; ``at``: where its characters came from, None for layer 0, or one span for all."""

    __slots__ = ("at", "text")

    def __init__(self, text: str, at: Places | tuple[int, int] | None):
        self.text, self.at = text, at

    def origin(self, start: int, end: int) -> tuple[int, int]:
        if self.at is None:
            return start, end
        return self.at if isinstance(self.at, tuple) else self.at.span(start, end)


def _rewritten(layer: Layer, found: Iterator[tuple[int, str, int]]) -> Layer | None:
    """The layer with stretches replaced: (start, characters, width of each one's stretch), in order."""
    out, at, last, whole = io.StringIO(), Places(), 0, isinstance(layer.at, tuple)
    for start, new, width in found:
        out.write(layer.text[last:start])
        out.write(new)
        if not whole:
            _kept(layer, at, last, start)
            if layer.at is None:
                at.add(start, width, width, len(new))
            else:
                for k in range(len(new)):
                    a, b = layer.origin(start + k * width, start + (k + 1) * width)
                    at.add(a, b - a, b - a)
        last = start + len(new) * width
    if not last:
        return None
    out.write(layer.text[last:])
    if not whole:
        _kept(layer, at, last, len(layer.text))
    return Layer(out.getvalue(), layer.at if whole else at)


def _kept(layer: Layer, at: Places, a: int, b: int) -> None:
    if a < b and layer.at is None:
        at.add(a, 1, 1, b - a)
    elif a < b:
        at.copy(layer.at, a, b)


def _url(layer: Layer) -> Layer | None:
    def found() -> Iterator[tuple[int, str, int]]:
        for m in URL.finditer(layer.text):
            raw = binascii.unhexlify(m[0].replace("%", ""))
            first = 0
            while first < len(raw):
                try:
                    new, skip = raw[first:].decode(), 0
                except UnicodeDecodeError as e:
                    new, skip = raw[first : first + e.start].decode(), e.end - e.start
                # characters of one width at a time
                for part in EQUAL.finditer(new):
                    n = len(part[0][0].encode())
                    yield m.start() + 3 * first, part[0], 3 * n
                    first += n * len(part[0])
                first += skip

    return _rewritten(layer, found())


def _escapes(layer: Layer) -> Layer | None:
    def units() -> Iterator[tuple[int, int, int]]:
        held = None
        for m in ESCAPE.finditer(layer.text):
            code = int(m[m.lastindex], 16)
            if held and 0xDC00 <= code < 0xE000 and 0xD800 <= held[2] < 0xDC00 and held[1] == m.start():
                yield held[0], m.end(), 0x10000 + ((held[2] - 0xD800) << 10) + code - 0xDC00
                held = None
                continue
            if held:
                yield held
            held = m.start(), m.end(), code
        if held:
            yield held

    return _rewritten(layer, ((a, chr(c), b - a) for a, b, c in units() if c < 0x110000 and not 0xD800 <= c < 0xE000))


def _inflated(d, raw: bytes | memoryview, most: int) -> Iterator[bytes]:
    while True:
        part = d.decompress(raw, most)
        raw = d.unconsumed_tail
        if part:
            yield part
        if d.eof or not (part or raw):
            return


def _stream(raw: bytes | memoryview, most: int) -> Iterator[bytes]:
    """What compressed bytes hold, ``most`` bytes at a time; bytes behind the end are ignored, a cut end is no error."""
    head = bytes(raw[:6])
    if head[:2] == b"\x1f\x8b":
        rest = raw
        while bytes(rest[:2]) == b"\x1f\x8b":
            d = zlib.decompressobj(31)
            yield from _inflated(d, rest, most)
            rest = d.unused_data
    elif head[:1] == b"\x78" and len(head) > 1 and int.from_bytes(head[:2], "big") % 31 == 0:
        yield from _inflated(zlib.decompressobj(), raw, most)
    elif head[:3] == b"BZh" or head == b"\xfd7zXZ\x00":
        d = bz2.BZ2Decompressor() if head[:3] == b"BZh" else lzma.LZMADecompressor()
        part = d.decompress(raw, most)
        while part or not (d.eof or d.needs_input):
            yield part
            part = d.decompress(b"", most) if not d.eof and not d.needs_input else b""


def _deflated(raw: bytes) -> bool:
    """Whether the bytes are one whole deflate stream without a header; bytes of another kind end early or in an error."""
    if not raw or raw[0] >> 1 & 3 == 3:
        return False
    d, size, rest = zlib.decompressobj(-15), 0, raw
    try:
        while not d.eof:
            part = d.decompress(rest, 1 << 20)
            rest = d.unconsumed_tail
            size += len(part)
            if not (part or rest or d.eof):
                return False
    except zlib.error:
        return False
    return size >= 8 and len(d.unused_data) < 3


def _unpacked(raw: bytes | memoryview, most: int, bare: bool = False) -> Iterator[bytes]:
    """The stream in parts of ``most`` bytes (the last shorter), each behind the last OVERLAP bytes of the one before."""
    held, behind = bytearray(), 0
    try:
        for part in _inflated(zlib.decompressobj(-15), raw, most) if bare else _stream(raw, most):
            held += part
            while len(held) >= most + behind:
                yield bytes(held[: most + behind])
                del held[: most + behind - OVERLAP]
                behind = OVERLAP
    except (OSError, EOFError, zlib.error, lzma.LZMAError, ValueError):
        pass
    if len(held) > behind:
        yield bytes(held)


def _opened(raw: bytes | memoryview, most: int, seen: frozenset[bytes] = frozenset(), bare: bool = False) -> Iterator[bytes]:
    """What compressed bytes hold, once or several times packed; nothing if they are not compressed."""
    for part in _unpacked(raw, most, bare):
        mark = hashlib.sha256(part).digest()
        if mark in seen:
            continue
        inner = False
        for x in _opened(part, most, seen | {mark}):
            inner = True
            yield x
        if not inner:
            yield part


def _wide(raw: bytes) -> str | None:
    """The byte order of UTF-16: by its mark, or where a tenth of every other byte is zero and the rest is not."""
    if raw[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return "utf-16"
    first, second = raw[::2].count(0), raw[1::2].count(0)
    if 10 * max(first, second) < len(raw) // 2 or 4 * min(first, second) > max(first, second):
        return None
    return "utf-16-be" if first > second else "utf-16-le"


def _readable(raw: bytes) -> str | None:
    kinds = ["utf-8"]
    if len(raw) > 1 and (wide := _wide(raw)):
        kinds.append(wide)
    for kind in kinds:
        try:
            text = raw[: len(raw) // 2 * 2].decode(kind) if kind != "utf-8" else raw.decode()
        except UnicodeDecodeError:
            continue
        odd = sum(not (c.isprintable() or c in "\t\n\r") for c in text)
        if text and odd * 20 <= len(text):
            return text
    return None


def _runs(text: str) -> Iterator[tuple[str, list[int] | range]]:
    """Base64 runs and joined lines of wrapped ones, with the place of every character."""
    for m in WRAPPED.finditer(text):
        ends = [(x.start(), x.end()) for x in LINE_END.finditer(text, m.start(), m.end())]
        lines = list(zip([m.start(), *[b for _, b in ends]], [*[a for a, _ in ends], m.end()], strict=True))
        i = 0
        while i < len(lines):
            # lines of one width, the first and the last may be shorter
            j, width = i + 1, max(b - a for a, b in lines[i : i + 2])
            while j < len(lines) and lines[j][1] - lines[j][0] == width:
                j += 1
            if j < len(lines) and lines[j][1] - lines[j][0] < width:
                j += 1
            if j - i > 1 and sum(b - a for a, b in lines[i:j]) >= 16:
                yield "".join(text[a:b] for a, b in lines[i:j]), [k for a, b in lines[i:j] for k in range(a, b)]
            i = j
    for m in BASE64.finditer(text):
        yield m[0].rstrip("="), range(m.start(), m.end())


def _bytes(run: str) -> bytes:
    """A run's bytes; a last character that holds no whole byte is dropped."""
    run = run[: len(run) - (len(run) % 4 == 1)].replace("-", "+").replace("_", "/")
    return base64.b64decode(run + "=" * (-len(run) % 4))


def _texts(parts: Iterator[bytes]) -> Iterator[str]:
    for part in parts:
        # a part may begin or end inside a character
        text = _readable(part) or _readable(part.decode("utf-8", "ignore").encode()) if len(part) > OVERLAP else _readable(part)
        if text is not None:
            yield text


def _base64(layer: Layer, most_bytes: int) -> Iterator[Layer]:
    done: list[tuple[int, int]] = []
    for run, at in _runs(layer.text):
        # a line of a wrapped run that decoded as a whole
        if any(a <= at[0] and at[-1] < b for a, b in done):
            continue
        if len(run) % 4 != 1:
            raw, whole, origin = _bytes(run), False, layer.origin(at[0], at[-1] + 1)
            packed = False
            for part in _opened(raw, most_bytes):
                packed = True
                for text in _texts(iter((part,))):
                    whole = True
                    yield Layer(text, origin)
            if not packed and (text := _readable(raw)) is not None:
                whole = True
                yield Layer(text, origin)
            elif not packed and _deflated(raw):
                for text in _texts(_opened(raw, most_bytes, bare=True)):
                    whole = True
                    yield Layer(text, origin)
            if whole:
                if not isinstance(at, range):
                    done.append((at[0], at[-1] + 1))
                continue
        for phase in range(4):
            raw = _bytes(run[phase:])
            for m in PACKED.finditer(raw):
                for text in _texts(_opened(memoryview(raw)[m.start() :], most_bytes)):
                    yield Layer(text, layer.origin(at[phase + m.start() * 4 // 3], at[-1] + 1))
            for m in STRETCH.finditer(raw):
                last = min(len(run), phase - (-m.end() * 4 // 3)) - 1
                yield Layer(m[0].decode("utf-8", "replace"), layer.origin(at[phase + m.start() * 4 // 3], at[last] + 1))


def _url_packed(layer: Layer, most_bytes: int) -> Iterator[Layer]:
    """Compressed bytes under URL escapes (what needs no escape stands among them)."""
    for m in URL_BYTES.finditer(layer.text) if "%" in layer.text else ():
        for token in {m[0], m[0].replace("+", " ")}:
            raw = urllib.parse.unquote_to_bytes(token)
            if _readable(raw) is None and _deflated(raw):
                for text in _texts(_opened(raw, most_bytes, bare=True)):
                    yield Layer(text, layer.origin(m.start(), m.end()))
            for p in PACKED.finditer(raw):
                for text in _texts(_opened(memoryview(raw)[p.start() :], most_bytes)):
                    yield Layer(text, layer.origin(m.start(), m.end()))


def _unwrapped(layer: Layer, most_bytes: int) -> Iterator[Layer]:
    """The layers under one, made as they are asked for."""
    for way in (_url, _escapes):
        if (x := way(layer)) is not None:
            yield x
    yield from _base64(layer, most_bytes)
    yield from _url_packed(layer, most_bytes)


def all_spans(text: str, base: list[Span], most_bytes: int = 16 << 20) -> list[Span]:
    """Base spans and those of every decoded layer, as spans of ``text``."""
    found = set(base)
    seen = {hashlib.sha256(text.encode("utf-8", "surrogatepass")).digest()}
    # depth first, so that only the layers above one are held
    work = [_unwrapped(Layer(text, None), most_bytes)]
    while work:
        x = next(work[-1], None)
        if x is None:
            work.pop()
            continue
        # one content decoded from two places is two layers; from one place, one
        where = x.at if isinstance(x.at, tuple) else None
        key = hashlib.sha256(repr(where).encode() + x.text.encode("utf-8", "surrogatepass")).digest()
        if key in seen:
            continue
        seen.add(key)
        found.update((*x.origin(a, b), k) for a, b, k in base_spans(x.text))
        work.append(_unwrapped(x, most_bytes))
    return sorted(found, key=lambda x: (x[0], x[2], x[1]))


def told(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


def find(text: str | None) -> tuple[list[Span], list[Span]]:
    """Base spans and all spans of one text."""
    text = text or ""
    base = base_spans(text)
    coded = "%" in text and URL.search(text) or "\\" in text and ESCAPE.search(text) or BASE64.search(text) or WRAPPED.search(text)
    return base, all_spans(text, base) if coded else base


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, base and all spans as arrays of struct(start, end, kind)."""
    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            both = [find(t) for t in batch.column("text").to_pylist()]
            lists = [[[{"start": a, "end": b, "kind": KINDS[k]} for a, b, k in x[i]] for x in both] for i in (0, 1)]
            arrays = [batch.column("doc_id"), *[pa.array(x, pa.list_(span)) for x in lists]]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "base", "spans"])

    kind = "array<struct<start:bigint,end:bigint,kind:string>>"
    return arrow(docs.select("doc_id", "text"), run, f"doc_id long, base {kind}, spans {kind}")


def masked(text: str, spans: list[Span], mark: str = "[SECRET]") -> str:
    """``text`` with each stretch covered by spans replaced by ``mark``."""
    out, last = [], 0
    for a, b, _ in sorted(spans):
        if b <= last:
            continue
        if a >= last:
            out += [text[last:a], mark]
        last = b
    return "".join([*out, text[last:]])


def mask(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with secrets of any layer masked in ``text`` (null stays null), all columns kept."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            texts = batch.column("text").to_pylist()
            clean = [t if t is None else masked(t, find(t)[1], mark) for t in texts]
            arrays = [pa.array(clean, pa.string()) if n == "text" else batch.column(n) for n in names]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return arrow(docs, run, docs.schema)
