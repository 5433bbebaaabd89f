"""HTML extraction by tag-path ratios.

A page is cut into blocks of text; every block has a root-to-leaf tag path (tag
names, with the first class). Text outside links and punctuation are aggregated per
path; each block takes its path's ratios, the two sequences are smoothed along
the page, fused, and thresholded, which selects content paths. The blocks of these
paths are the result in page order, each with the headings right before it; what lies
on no selected path goes, whatever its tag. Items and cells, which are short by nature, have
their paths' scores multiplied by ``SHORT``. Scripts, navigation, footers, hidden elements and
the like are left out before any ratio is taken. A form, or an element whose class,
id or role names an advert, a notice, reader comments and so on, only lowers the
score of the paths below it, and not where it holds most of the page's text.

Edge cases: null or empty html gives an empty text; unclosed tags, stray ends
and unterminated comments or quotes are read as browsers do (an open ``p`` or
``li`` ends at the next one). Pages of any size are read whole. Rows are
independent; repeated rows and extra columns change nothing.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from cloudloom.llm.common import arrow, sliced

TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)([^>]*+)>""",
    re.S,
)
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
RAW = {"script", "style", "textarea", "title", "xmp", "noframes", "iframe", "noembed"}
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary "
    "table tbody td tfoot th thead title tr ul".split()
)
#: Elements left out with all they hold.
LEFT_OUT = set(
    "head script style title noscript nav footer aside button select option textarea input label legend menu dialog "
    "iframe object embed svg canvas audio video template noframes noembed xmp".split()
)
#: Elements, and words of class, id or role, that lower the score of what they hold.
DOUBTED = {"form", "fieldset"}
NAMED_OUT = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisements?|advertising|sponsor(?:ed|s)?|promo(?:tion|s)?|banner|cookies?|consent|gdpr|notices?|alert|"
    r"popup|modal|overlay|newsletter|subscribe|subscription|signup|login|nav|navbar|navigation|menus?|breadcrumbs?|"
    r"sidebar|side|widgets?|related|recommend(?:ed|ations)?|share|sharing|social|footer|header|masthead|copyright|comments?|commentlist|"
    r"disqus|respond|replies|reply|reviews?|toolbar|pagination|pager|search|contentinfo|complementary|form)(?=$|[\s_-]|\d)",
    re.I,
)
CLOSES = {"p": BLOCK - {"body", "html"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
SCOPE = {"ul", "ol", "dl", "table", "article", "section", "div", "body", "main", "td", "blockquote"}
HEADING = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Weights of the paths of elements that hold little text each.
SHORT = dict.fromkeys(("li", "td", "th", "dd", "dt"), 10.0) | dict.fromkeys(("blockquote", "pre", "caption", "figcaption"), 4.0)
PUNCTUATION = re.compile(r"[.,;:!?…、。，！？]")
SPACE = re.compile(r"\s+")


class Block:
    """A text block: its element, path, innermost doubted element (0: none), text, and characters inside links."""

    __slots__ = ("doubt", "links", "node", "path", "text")

    def __init__(self, node: int, path: int, doubt: int, text: str, links: int):
        self.node, self.path, self.doubt, self.text, self.links = node, path, doubt, text, links


class Page:
    """The elements of a page in order, as arrays by number (0: the page itself), and its text blocks.

    ``last``: the largest number inside an element; ``article``: the nearest article or main
    element around it, itself included (0: none); ``paths``: numbers of (path above, name).
    """

    def __init__(self):
        self.parent, self.last, self.tag, self.path, self.depth, self.article = [0], [0], [""], [0], [0], [0]
        self.paths: dict[tuple[int, str], int] = {}
        self.tag_of_path = [""]
        self.doubt_above: dict[int, int] = {}
        self.blocks: list[Block] = []

    def element(self, tag: str, name: str, above: int) -> int:
        path = self.paths.setdefault((self.path[above], name), len(self.paths) + 1)
        if path == len(self.tag_of_path):
            self.tag_of_path.append(tag)
        k = len(self.parent)
        self.parent.append(above)
        self.last.append(k)
        self.tag.append(tag)
        self.path.append(path)
        self.depth.append(self.depth[above] + 1)
        self.article.append(k if tag in ("article", "main") else self.article[above])
        return k

    def holds(self, node: int, other: int) -> bool:
        return node <= other <= self.last[node] if node else True


def _out(tag: str, attributes: str) -> tuple[bool, bool, str]:
    """Whether an element is left out, whether it is doubted, and its name in paths."""
    if tag in LEFT_OUT:
        return True, False, tag
    first, gone, doubted = "", False, tag in DOUBTED
    if not attributes or attributes.isspace():
        return gone, doubted, tag
    for m in ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none", value):
            gone = True
        elif key in ("class", "id", "role") and tag not in ("html", "body", "article", "main", *HEADING):
            doubted = doubted or bool(NAMED_OUT.search(value))
        if key == "class" and not first:
            first = value.split()[0] if value.split() else ""
    # doubted elements have paths of their own
    return gone, doubted, f"{tag}.{first}!" if doubted else f"{tag}.{first}" if first else tag


def read(page: str) -> Page:
    """Elements and text blocks in page order, blocks of left-out elements excepted; linear in the page and its depth."""
    made = Page()
    # open elements: tags, numbers, whether left out, doubted ones; places in the stack by tag, of blocks, of scopes
    tags: list[str] = []
    nodes: list[int] = []
    outs: list[bool] = []
    doubts: list[int] = []
    places: dict[str, list[int]] = defaultdict(list)
    block_at: list[int] = []
    scope_at: list[int] = []
    held: list[str] = []
    place: tuple[int, int] | None = None
    at, links = 0, 0

    def flush() -> None:
        nonlocal held, place, links
        if held:
            text = SPACE.sub(" ", entities.unescape("".join(held))).strip()
            if text and place is not None:
                made.blocks.append(Block(place[0], made.path[place[0]], place[1], text, links))
        held, place, links = [], None, 0

    def add(piece: str) -> None:
        nonlocal place, links
        if piece and not (outs and outs[-1]):
            if place is None:
                if not piece.strip():
                    return
                # a block's path ends at its block element; inline tags inside don't count
                place = nodes[block_at[-1]] if block_at else 0, doubts[-1] if doubts else 0
            held.append(piece)
            if places["a"]:
                links += len(piece.strip())

    def close_to(i: int) -> None:
        if block_at and block_at[-1] >= i:
            flush()
        while len(tags) > i:
            tag, node = tags.pop(), nodes.pop()
            outs.pop()
            places[tag].pop()
            made.last[node] = len(made.parent) - 1
            for stack in (block_at, scope_at):
                if stack and stack[-1] == len(tags):
                    stack.pop()
            if doubts and doubts[-1] == node:
                doubts.pop()

    # nothing behind the last ">" is a tag; an open comment there ends the page
    end = page.rfind(">") + 1
    tail = page[end:].partition("<!--")[0]
    for m in TOKEN.finditer(page[:end] if tail or end < len(page) else page):
        if m.start() < at:
            continue
        add(page[at : m.start()])
        at = m.end()
        if m[0].startswith("<![CDATA["):
            continue
        tag = m[2] or m[5]
        if not tag:
            continue
        tag, ends = tag.lower(), bool(m[1] or m[4])
        if ends:
            if places[tag]:
                i = places[tag][-1]
                # an inline end never closes a block
                if tag in BLOCK or not (block_at and block_at[-1] >= i):
                    close_to(i)
            elif tag == "p":
                flush()
            continue
        attributes = m[3] or m[6] or ""
        if tag in VOID:
            if tag == "br":
                add(" ") if held else None
            elif tag == "hr":
                flush()
            continue
        for open_tag, by in CLOSES.items():
            if tag in by and places[open_tag]:
                i = places[open_tag][-1]
                if not (scope_at and scope_at[-1] > i):
                    close_to(i)
        if tag in RAW:
            done = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = done.end() if done else len(page)
            continue
        if tag in BLOCK:
            flush()
        if attributes.rstrip().endswith("/") and tag not in BLOCK:
            continue
        gone, doubted, name = _out(tag, attributes)
        if tag == "header" and not places["article"] and not places["main"]:
            gone = True
        if gone and not (outs and outs[-1]):
            flush()
        node = made.element(tag, name, nodes[-1] if nodes else 0)
        if doubted:
            made.doubt_above[node] = doubts[-1] if doubts else 0
            doubts.append(node)
        places[tag].append(len(tags))
        if tag in BLOCK:
            block_at.append(len(tags))
        if tag in SCOPE:
            scope_at.append(len(tags))
        tags.append(tag)
        nodes.append(node)
        outs.append(gone or bool(outs and outs[-1]))
    if at < end:
        add(page[at:end])
    if at <= end:
        add(tail)
    close_to(0)
    flush()
    made.last[0] = len(made.parent) - 1
    return made


def smoothed(values: list[float], sigma: float = 1.0) -> list[float]:
    """Gaussian smoothing along the page."""
    reach = math.ceil(2 * sigma)
    kernel = [math.exp(-d * d / (2 * sigma * sigma)) for d in range(-reach, reach + 1)]
    out = []
    for i in range(len(values)):
        near = [(values[i + d], kernel[d + reach]) for d in range(-reach, reach + 1) if 0 <= i + d < len(values)]
        out.append(sum(v * k for v, k in near) / sum(k for _, k in near))
    return out


def doubted_nodes(page: Page) -> set[int]:
    """Elements named as something else, without those that hold most of the page's text.

    Such an element stays doubted where an article or main element lies beside it, or where
    text at least half as long lies outside all of them (reader comments longer than the article).
    """
    above, left = page.doubt_above, set(page.doubt_above)
    held: dict[int, int] = dict.fromkeys(above, 0)
    total = 0
    for b in page.blocks:
        total += len(b.text)
        if b.doubt:
            held[b.doubt] += len(b.text)
    for node in sorted(above, reverse=True):
        if above[node]:
            held[above[node]] += held[node]
    # those that hold most of the text lie in one another; from the outermost inwards
    heavy = [node for node in sorted(above) if 2 * held[node] > total]
    level = {node: k + 1 for k, node in enumerate(heavy)}
    # how deep a doubted element lies among them; -1 if a lighter one lies around it or is it
    depth = {0: 0}
    for node in sorted(above):
        up = depth[above[node]]
        depth[node] = level.get(node, -1) if up >= 0 else -1
    free: dict[int, list[Block]] = defaultdict(list)
    for b in page.blocks:
        if depth[b.doubt] >= 0:
            free[depth[b.doubt]].append(b)
    outside, beside = 0, False
    for k, node in enumerate(heavy):
        # text outside the element, as far as no element that stays doubted holds it
        outside += sum(len(b.text) for b in free[k])
        beside = beside or any(page.article[b.node] and not page.holds(page.article[b.node], node) for b in free[k])
        if beside or 2 * outside >= held[node]:
            # it stays, and the text in it is no text outside for those further in
            free = defaultdict(list)
        else:
            left.discard(node)
    return left


def fused_ratios(page: Page, doubted: set[int] = frozenset(), sigma: float = 1.0, prior: float = 0.05) -> tuple[list[float], list[float]]:
    """Per block the fused ratio of its path, and the same from the ratios smoothed along the page.

    The text ratio is a path's characters outside links per block, the punctuation ratio its marks
    and one per block; ``prior`` is the weight of blocks in ``doubted`` elements.
    """
    found = page.blocks
    n, chars, marks = defaultdict(int), defaultdict(int), defaultdict(int)
    for b in found:
        n[b.path] += 1
        chars[b.path] += max(0, len(b.text) - b.links)
        marks[b.path] += len(PUNCTUATION.findall(b.text))
    inside = _inside(page, doubted)
    weight = [SHORT.get(page.tag_of_path[b.path], 1.0) * (prior if inside[b.doubt] else 1.0) for b in found]
    text_ratio = [chars[b.path] / n[b.path] for b in found]
    mark_ratio = [(1 + marks[b.path]) / n[b.path] for b in found]
    own, along = (
        [w * math.sqrt(t * p) for w, t, p in zip(weight, texts, points, strict=True)]
        for texts, points in ((text_ratio, mark_ratio), (smoothed(text_ratio, sigma), smoothed(mark_ratio, sigma)))
    )
    return own, along


def content_paths(page: Page, doubted: set[int] = frozenset(), sigma: float = 1.0, share: float = 0.25, prior: float = 0.05) -> set[int]:
    """Paths whose fused ratios, their own and smoothed, reach ``share`` of the text-weighted mean."""
    inside = _inside(page, doubted)
    length = [(prior if inside[b.doubt] else 1.0) * len(b.text) for b in page.blocks]
    chosen: set[int] | None = None
    for fused in fused_ratios(page, doubted, sigma, prior):
        level = share * sum(f * x for f, x in zip(fused, length, strict=True)) / max(1e-9, sum(length))
        best: dict[int, float] = defaultdict(float)
        for f, b in zip(fused, page.blocks, strict=True):
            best[b.path] = max(best[b.path], f)
        reached = {p for p, f in best.items() if f and f >= level}
        chosen = reached if chosen is None else chosen & reached
    return chosen or set()


def _inside(page: Page, doubted: set[int]) -> dict[int, bool]:
    """By doubted element (0: none): whether it or one around it is among ``doubted``."""
    inside = {0: False}
    for node in sorted(page.doubt_above):
        inside[node] = node in doubted or inside[page.doubt_above[node]]
    return inside


def extract(html: str | None) -> str:
    """The page's main text: blocks of content paths, and headings that stand before one."""
    page = read(html or "")
    if not page.blocks:
        return ""
    doubted = doubted_nodes(page)
    chosen = content_paths(page, doubted)
    out = _inside(page, doubted)
    kept: list[str] = []
    led = False  # whether the next block that is no heading is kept
    for b in reversed(page.blocks):
        heading = page.tag_of_path[b.path] in HEADING
        if not heading:
            led = b.path in chosen
        if led and not (heading and out[b.doubt]):
            kept.append(b.text)
    return " ".join(reversed(kept))


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text (empty if none) and n_chars of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "html"):
            texts = [extract(x) for x in batch.column("html").to_pylist()]
            arrays = [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=["page_id", "url", "text", "n_chars"])

    return arrow(pages.select("page_id", "url", "html"), run, "page_id long, url string, text string, n_chars long")
