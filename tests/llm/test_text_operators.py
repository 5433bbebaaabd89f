"""The text operators against brute force on small fixtures, edge cases included."""

import base64
import bz2
import gzip
import hashlib
import lzma
import math
import random
import re
import urllib.parse
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cloudloom.llm import (
    chat,
    fingerprints,
    hashed,
    html_extract,
    jaccard_join,
    mixing,
    packing,
    ppm,
    quality,
    queries,
    secrets,
    sharding,
)
from cloudloom.llm.graph import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, bucket int, n double"
WORDS = "the of stone river amber quick lantern meadow Über fjord naïve copper signal vector drift".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return "".join(r.choice(WORDS) + r.choice([" ", " ", " ", "\n", ", "]) for _ in range(n))


def texts() -> list[str | None]:
    base = [prose(i, 40 + 13 * i) for i in range(24)]
    near = [re.sub(r"\bstone\b", "pebble", t, count=1) for t in base[:8]]
    return [*base, *near, base[3], base[3], base[3].upper(), None, "", " \n ", "one", "two words", "a b c d", "a b c d", "x" * 5000, "lone\x1cword", prose(99, 4000), "  double  spaces \xa0 odd　"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i * 3, t, "en", [None, "b", "a", "b", "é"][i % 5], len(t or ""), i, 0.5) for i, t in enumerate(texts())]
    rows.append(rows[5])  # a repeated row
    return spark.createDataFrame(rows, SCHEMA).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t):
    return (t or "").encode().split()


# ------------------------------------------------------------ 1 mixing


def test_mixing_meets_budgets(docs, none):
    rows = mixing.mix(docs).collect()
    assert len(rows) == docs.count()
    size = defaultdict(int)
    for r in docs.collect():
        size[r["source"]] += len(words(r["text"]))
    # water filling by rounds
    order = [*sorted((s for s in size if s is not None), key=lambda s: s.encode()), *([None] if None in size else [])]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, left, open_ = {}, 1.5 * sum(size.values()), set(order)
    while True:
        unit = left / sum(weight[s] for s in open_)
        above = {s for s in open_ if unit * weight[s] > 2 * size[s]}
        if not above:
            target |= {s: unit * weight[s] for s in open_}
            break
        for s in above:
            target[s] = 2.0 * size[s]
            left -= target[s]
        open_ -= above
    got = defaultdict(int)
    for r in rows:
        assert r["source_size"] == size[r["source"]] and r["target"] == pytest.approx(target[r["source"]])
        assert 0 <= r["taken"] <= 2 * r["size"]
        got[r["source"]] += r["taken"]
    assert all(got[s] == math.floor(target[s] + 1e-9) for s in order)
    assert sorted(map(tuple, mixing.mix(docs, rows_each=3).collect()), key=str) == sorted(map(tuple, rows), key=str)
    assert mixing.mix(none).count() == 0


def test_mixed_texts_hold_the_words_taken(docs):
    want = defaultdict(int)
    for r in mixing.mix(docs).collect():
        want[r["doc_id"]] += r["taken"]
    got = defaultdict(int)
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    for r in out.collect():
        got[r["doc_id"]] += len(words(r["text"]))
    assert {k: v for k, v in want.items() if v} == dict(got)


# ------------------------------------------------------------ 2 fingerprints


def test_next_documents_and_digests(docs, none):
    unique = docs.dropDuplicates(["doc_id"])
    by_id = {r["doc_id"]: r["text"] or "" for r in unique.collect()}
    ids = sorted(by_id, reverse=True)
    got = {r["doc_id"]: r for r in fingerprints.near_copies(unique).collect()}
    assert set(got) == set(ids)
    for a, b in zip(ids, [*ids[1:], ids[0]], strict=True):
        t, after = by_id[a], by_id[b]
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        r = got[a]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["fingerprint"] == fingerprints.digest(t.encode()) and r["edited_fingerprint"] == fingerprints.digest(edited.encode())
        assert r["near_edited"] == fingerprints.likeness(r["fingerprint"], r["edited_fingerprint"])
        assert r["near_next"] == fingerprints.likeness(r["fingerprint"], fingerprints.digest(after.encode()))
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    assert fingerprints.near_copies(docs).count() == docs.count()
    assert fingerprints.near_copies(none).count() == 0


def test_one_document_follows_itself(spark):
    one = spark.createDataFrame([(7, "abcdef", "", "", 6, 0, 0.0)], SCHEMA)
    r = fingerprints.near_copies(one).first()
    assert r["edited_sha256"] == hashlib.sha256(b"abcabc").hexdigest() and r["near_next"] == 1.0


def test_digest_counts_do_not_depend_on_blocks(monkeypatch):
    raw = prose(1, 3000).encode()
    whole = fingerprints.counts(raw)
    monkeypatch.setattr(fingerprints, "_BLOCK", 1000)
    assert (fingerprints.counts(raw) == whole).all() and whole.sum() == 6 * (len(raw) - 4)
    assert fingerprints.difference(fingerprints.digest(b""), fingerprints.digest(raw)) <= fingerprints.MOST


# ------------------------------------------------------------ 3 quality


def slow_counts(t):
    t = t or ""
    ws = re.findall(r"[^\x20\x09-\x0D]+", t)
    three = Counter(zip(ws, ws[1:], ws[2:]))
    inside = {i + d for i in range(len(ws) - 2) if three[tuple(ws[i : i + 3])] > 1 for d in range(3)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    failed = len(ws) < 50 or 100 * len(inside) > 50 * len(ws)
    return len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(inside), failed


def test_quality_counts_and_verdicts(docs, none):
    rows = quality.score(docs).collect()
    want = sorted((r["doc_id"], *slow_counts(r["text"])) for r in docs.collect())
    assert sorted((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in rows) == want
    assert not any(r["kept"] and r["base_failed"] for r in rows)
    assert quality.score(none).count() == 0
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r["kept"] for r in rows)


def test_compression_bands():
    packer, bands = quality.zstandard.ZstdCompressor(level=3), quality.Bands()
    r = random.Random(5)
    varied = [f"w{r.randrange(10**9)}" for _ in range(70)]
    noise = " ".join(base64.b85encode(r.randbytes(40)).decode() for _ in range(120))
    assert quality.measure(noise, packer, bands)[-1].startswith("incompressible")
    # words between which spaces and case vary escape the repeated-window rule but not the compressor
    again = "\n".join(" ".join(varied) + f" {i}" for i in range(1))
    assert quality.measure(again, packer, bands)[6]
    repetitive = " ".join(f"{'la' * 40}{i}" for i in range(200))
    assert quality.measure(repetitive, packer, bands)[-1] == "repetitive"
    assert quality.measure(prose(3, 300), packer, bands)[5:7] == (False, False)


def test_bands_reject_beyond_the_base_rules():
    packer, bands = quality.zstandard.ZstdCompressor(level=3), quality.Bands()
    r = random.Random(7)
    vocabulary = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(300)]
    # no window of three words makes up half of it, yet it is far more repetitive than good prose
    text = " ".join(r.choice(vocabulary) for _ in range(700))
    got = quality.measure(text, packer, bands)
    assert not got[5] and not got[6] and got[-1] == "repetitive"


# ------------------------------------------------------------ 4 Jaccard


def slow_groups(rows):
    sets = {}
    for r in rows:
        ws = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), r["text"] or ""))
        sets[r["doc_id"]] = {tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))} if ws else set()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in sets}


@pytest.fixture(scope="module")
def chains(spark):
    """Near copies at all sizes and distances about the threshold, chains of them, and shared passages."""
    r = random.Random(11)
    out = []
    passage = [f"p{i}" for i in range(60)]
    for n in [5, 6, 7, 9, 12, 20, 33, 64, 120, 300]:
        ws = [f"v{n}x{r.randrange(10**6)}" for _ in range(n)]
        out.append(ws)
        for edits in (1, 2, 3, 5, 8, 13):
            if edits * 3 < n:
                ws = list(ws)
                for _ in range(edits):
                    ws[r.randrange(len(ws))] = f"e{r.randrange(10**6)}"
                out.append(ws)
        out.append(ws[: max(1, n * 9 // 10)])
        out.append([*ws[: n // 2], *passage, *ws[n // 2 :]])
    out += [[*passage, f"tail{i}"] for i in range(12)]
    rows = [(i, " ".join(w), "", "", 0, 0, 0.0) for i, w in enumerate(out)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("small", [None, 0, 40])
def test_groups_equal_brute_force(chains, monkeypatch, small):
    if small is not None:
        monkeypatch.setattr(jaccard_join, "boundary", lambda _: small)
    want = slow_groups(chains.collect())
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.groups(chains, most_tokens=200 if small == 0 else 1 << 22).collect()}
    assert got == want


def test_groups_of_odd_texts(docs, none):
    got = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.groups(docs).collect()}
    assert got == {(d, *v) for d, v in slow_groups(docs.collect()).items()}
    assert jaccard_join.groups(docs).count() == docs.count()
    assert jaccard_join.groups(none).count() == 0
    kept = {r["doc_id"] for r in jaccard_join.keep_one(docs).collect()}
    assert kept == {d for d, (_, c) in slow_groups(docs.collect()).items() if c == d}


def test_keep_one_of_null_and_repeated_ids(spark):
    a, b, c = prose(1, 60), prose(2, 60), prose(3, 60)
    rows = [(None, a), (5, a), (6, a), (7, b), (7, b), (7, c), (8, b), (None, c), (9, prose(4, 60)), (9, prose(5, 60)), (None, None), (10, "")]
    kept = jaccard_join.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert kept.columns == ["doc_id", "text"]
    want = [(None, a), (7, b), (None, c), (9, prose(4, 60)), (9, prose(5, 60)), (None, None), (10, "")]
    assert Counter(tuple(r) for r in kept.collect()) == Counter(want)


def test_word_hashes_of_long_texts(monkeypatch):
    raw = prose(4, 3000).encode()
    whole = hashed.word_hashes(raw)
    monkeypatch.setattr(hashed, "_BLOCK", 100)
    assert (hashed.word_hashes(raw) == whole).all() and len(whole) == len(raw.split())
    assert len(set(whole.tolist())) == len({w.lower() if w.isascii() else w.decode().translate({i: i + 32 for i in range(65, 91)}) for w in raw.split()})


def test_components(spark):
    r = random.Random(2)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 460)]
    got = {x["node"]: x["root"] for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    near = defaultdict(set)
    for a, b in edges:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    for x in near:
        seen, work = {x}, [x]
        while work:
            fresh = near[work.pop()] - seen
            seen |= fresh
            work += fresh
        assert got[x] == min(seen)
    assert set(got) == set(near)


def test_boundary_takes_the_cheaper_side():
    # 20 pays for both, being near the boundary; 5 and 6 for subsets alone
    assert jaccard_join.boundary({5: (1, 100), 6: (1, 100), 20: (1, 100), 100: (10**6, 10)}) == 20
    assert jaccard_join.boundary({5: (100, 1), 129: (5, 5)}) == 0


# ------------------------------------------------------------ 5 packing


def test_tokens_equal_the_tokenizer():
    from tokenizers import Tokenizer

    where = packing.public_coder()
    plain, coder = Tokenizer.from_file(where[0]), packing.Coder(*where)
    odd = ["a  b", "a \n b", " \n\n  x", "a   b ", "x\xa0 y　z", "don't  I'll", "<|endoftext|> hi", "", "  ", "tab\t x \t y", " lead", "trail ", "y" * 300 + " z"]
    for _ in range(2):
        for t, raw in zip([*odd, *map(lambda x: x or "", texts())], coder.encode([*odd, *map(lambda x: x or "", texts())]), strict=True):
            assert np.frombuffer(raw, "<u4").tolist() == plain.encode(t, add_special_tokens=False).ids


def test_packing_is_exact_and_tight(docs, none):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(packing.public_coder()[0])
    cap = 256
    rows = packing.pack(packing.pieces(docs, cap), cap, rows_each=4).collect()
    by_doc = defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
    for r in docs.dropDuplicates(["doc_id"]).collect():
        ids = [*plain.encode(r["text"] or "", add_special_tokens=False).ids, 0]
        mine = sorted({(p["piece"], p["start"], p["length"], p["ids_crc32"]) for p in by_doc[r["doc_id"]]})
        assert [p[0] for p in mine] == list(range(len(mine)))
        assert all(p[2] == cap for p in mine[1:]) and sum(p[2] for p in mine) == len(ids)
        for _, start, length, crc in mine:
            assert crc == zlib.crc32(np.array(ids[start : start + length], "<u4").tobytes())
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= cap
    assert len(bins) <= 1.05 * math.ceil(sum(r["length"] for r in rows) / cap) + 1
    assert packing.pack(packing.pieces(none)).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_plans_use_every_piece_once(seed):
    r = random.Random(seed)
    cap = r.choice([7, 64, 2048])
    counts = Counter(r.randint(1, cap) for _ in range(r.choice([0, 1, 50, 5000])))
    used = Counter()
    patterns = packing.plan(dict(counts), cap)
    for lengths, k in patterns:
        assert k > 0 and sum(lengths) <= cap
        for x in lengths:
            used[x] += k
    assert used == counts
    assert packing.plan({3: 10, 4: 10}, 7) == [((4, 3), 10)]
    # triples: 10 + 20 + 70 fill the rest of 100 left by nothing else
    assert sum(k for _, k in packing.plan({45: 4, 30: 4, 15: 4, 10: 4}, 100)) == 4


# ------------------------------------------------------------ 6 pages

ARTICLE = "First line, of prose. " * 8


@pytest.mark.parametrize(
    "page, want",
    [
        (None, ""),
        ("", ""),
        ("<html><head><title>x</title></head><body></body></html>", ""),
        (
            f"<body><nav><a href=/>Home</a></nav><div class='cookie-notice'>We use cookies.</div><article><h1>Ti&amp;tle</h1><p>{ARTICLE}<p>Short&nbsp;one<br>two <b>bo<i>ld</i></b>er</article>"
            "<aside>More, more, more.</aside><div id=comments><p>I, for one, disagree. Very much so.</div><footer>(c)</footer>",
            f"Ti&tle {ARTICLE.strip()} Short one two bolder",
        ),
        (
            f"<div class=wrap><div class=menu><ul><li>a<li>b</ul></div><div class=post><h2>Head</h2><p>{ARTICLE}</p><p>{ARTICLE}</p><form><label>Mail</label><input></form></div>"
            "<div class='sidebar'><p>Side, text.</p></div></div><script>var t='<p>no, no, no.</p>'</script>",
            f"Head {ARTICLE.strip()} {ARTICLE.strip()}",
        ),
        (f"<p>{ARTICLE}<!-- hidden <p>not this --><p>{ARTICLE}<script>open", f"{ARTICLE.strip()} {ARTICLE.strip()}"),
        ("<article>a < b and \"c\" > d</article>", 'a < b and "c" > d'),
        ("<article><p>x<p hidden>gone<p>y</article>", "x y"),
    ],
)
def test_pages(page, want):
    assert html_extract.extract(page) == want


LINKS = "<ul><li><a href=/1>One link</a><li><a href=/2>Two link</a><li><a href=/3>Three</a></ul>"


@pytest.mark.parametrize(
    "page, want",
    [
        *[(f"<body>{w}<article><p>{ARTICLE}</p></article></body>", ARTICLE.strip()) for w in ("<div id=page class='no-sidebar'>", "<div class='has-comments'>", "<form action=/x>", "<section class=search>")],
        # without an article element
        (f"<div class='no-sidebar'><div class=sidebar><p>Side, text.</div><p>{ARTICLE}<p>{ARTICLE}</div>", f"{ARTICLE.strip()} {ARTICLE.strip()}"),
        (f"<article><p>{ARTICLE}</p><div>Buy now</div><p>{ARTICLE}</p>{LINKS}</article>", f"{ARTICLE.strip()} {ARTICLE.strip()}"),
        (f"<div class=post><p>{ARTICLE}</p></div><div id=comments><p>{ARTICLE}</p></div>", ARTICLE.strip()),
        (f"<main><h2><a href=/x>Head</a></h2><p>{ARTICLE}</p><ul><li>An item<li>Next item</ul></main>", f"Head {ARTICLE.strip()} An item Next item"),
    ],
)
def test_names_are_a_prior_and_paths_decide_inside_articles(page, want):
    assert html_extract.extract(page) == want


@pytest.mark.parametrize(
    "page, want",
    [
        # an advert in a paragraph of its own path, an unnamed box, a table of short cells, links in a list
        (f"<article><p>{ARTICLE}</p><p class=cta>Subscribe now!</p><p>{ARTICLE}</p></article>", f"{ARTICLE.strip()} {ARTICLE.strip()}"),
        (f"<div><div><h2>Head</h2><div>{ARTICLE}</div><div class=x>Buy now</div><div>{ARTICLE}</div></div><p>Short teaser</p></div>", f"Head {ARTICLE.strip()} {ARTICLE.strip()}"),
        (f"<main><p>{ARTICLE}</p><table><tr><th>Year<th>Sum, net<tr><td>1999<td>12.5</table><h3>More</h3><p><a href=/x>Read on here</a></p></main>", f"{ARTICLE.strip()} Year Sum, net 1999 12.5 More Read on here"),
        (f"<div id=a><span>{ARTICLE}</span></div><div id=b class=teasers>{LINKS}<h3>Also read</h3>{LINKS}</div>", ARTICLE.strip()),
        # short paragraphs share their path with long ones; a heading before what goes, goes
        (f"<article><h1>T</h1><p>{ARTICLE}</p><p>Yes.</p><h2>Ads</h2><div class=box>Buy</div></article>", f"T {ARTICLE.strip()} Yes."),
    ],
)
def test_ratios_of_paths_decide_whatever_the_tag(page, want):
    assert html_extract.extract(page) == want


def slow_fused(page, doubted, sigma=1.0, prior=0.05):
    """Both fused ratios of every block from their definition, block by block."""
    bs = page.blocks
    heavy = lambda b: html_extract.SHORT.get(page.tag_of_path[b.path], 1.0) * (prior if any(page.holds(k, b.node) for k in doubted) else 1.0)
    same = [[x for x in bs if x.path == b.path] for b in bs]
    text = [sum(max(0, len(x.text) - x.links) for x in s) / len(s) for s in same]
    mark = [(1 + sum(len(re.findall("[.,;:!?…、。，！？]", x.text)) for x in s)) / len(s) for s in same]

    def blurred(v):
        near = lambda i: [(v[j], math.exp(-((i - j) ** 2) / (2 * sigma * sigma))) for j in range(len(v)) if abs(i - j) <= math.ceil(2 * sigma)]
        return [sum(x * k for x, k in near(i)) / sum(k for _, k in near(i)) for i in range(len(v))]

    return [[heavy(b) * math.sqrt(t * m) for b, t, m in zip(bs, ts, ms, strict=True)] for ts, ms in ((text, mark), (blurred(text), blurred(mark)))]


def test_fused_ratios_of_the_table_and_what_they_change(spark, data, monkeypatch):
    """Ratios equal the slow ones on every page, and with no path or every path selected no page keeps its text."""
    pages = [r["html"] for r in spark.read.parquet(f"{data}/pages.parquet").collect()]
    told = [html_extract.extract(x) for x in pages]
    for x in pages:
        page = html_extract.read(x)
        doubted = html_extract.doubted_nodes(page)
        for got, want in zip(html_extract.fused_ratios(page, doubted), slow_fused(page, doubted), strict=True):
            assert got == pytest.approx(want)
    for chosen in (lambda page, *_: set(), lambda page, *_: {b.path for b in page.blocks}):
        monkeypatch.setattr(html_extract, "content_paths", chosen)
        assert all(html_extract.extract(x) != t for x, t in zip(pages, told, strict=True))


def test_pages_of_the_table(spark, data):
    rows = queries.op6_html_extraction(spark, data).collect()
    src = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{data}/pages.parquet").collect()}
    import html

    for r in rows:
        a = re.sub(r"</?b>", "", re.search(r"<article>(.*?)</article>", src[r["page_id"]], re.S)[1])
        assert r["text"] == re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", " ", a))).strip() and r["n_chars"] == len(r["text"])


# ------------------------------------------------------------ 7 chat


def test_preferences(spark):
    u, a = "user", "assistant"
    turns = [
        (1, 0, u, "hi"), (1, 1, a, "hello"), (1, 2, u, "more"), (1, 3, a, "yes"),
        (2, 0, u, "hi"), (2, 1, a, "hello"), (2, 2, u, "less"), (2, 3, a, "no"),
        (3, 0, u, "hi"), (3, 1, a, "alone"), (4, 0, u, None), (5, 0, u, None), (6, 0, "system", "s"), (6, 1, u, "q"),
    ]
    rows = {r["chosen_id"]: r for r in chat.preferences(spark.createDataFrame(turns, "conv_id long, turn int, role string, text string")).collect()}
    assert set(rows) == {1, 3, 4, 6}
    r = rows[1]
    assert r["rejected_id"] == 2 and r["prompt_turns"] == 2
    assert r["prompt"] == "<|user|>\nhi<|end|>\n<|assistant|>\nhello<|end|>\n"
    assert [r["chosen"][int(x) : int(y)] for x, y in (s.split(":") for s in r["chosen_mask"].split(","))] == ["yes"]
    assert [r["rejected"][int(x) : int(y)] for x, y in (s.split(":") for s in r["rejected_mask"].split(","))] == ["no"]
    assert rows[3]["rejected_id"] is None and rows[3]["rejected"] is None and rows[3]["prompt_turns"] == 1 and "alone" in rows[3]["chosen"]
    assert (rows[4]["rejected_id"], rows[4]["prompt_turns"], rows[4]["chosen"], rows[4]["rejected"]) == (5, 1, "", "")
    assert rows[6]["prompt_turns"] == 2 and rows[6]["chosen_mask"] == ""
    assert chat.preferences(spark.createDataFrame([], "conv_id long, turn int, role string, text string")).count() == 0


# ------------------------------------------------------------ 8 secrets


def slow_base(t):
    t = t or ""
    key = "(" + "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key")) + ")"
    out = [(m.start(), m.end(), 0) for m in re.finditer(key + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m[2]) >= 6]
    out += [(m.start(), m.end(), 1) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [(m.start(), m.end(), 2) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 24]
    return sorted(out, key=lambda x: (x[0], x[2]))


PLAIN = 'x password = "hunter2hunter" y'


@pytest.mark.parametrize(
    "code",
    [
        urllib.parse.quote,
        lambda s: urllib.parse.quote(urllib.parse.quote(s)),
        lambda s: "".join(f"\\u{ord(c):04x}" for c in s),
        lambda s: "".join(f"\\x{ord(c):02X}" for c in s),
        lambda s: base64.b64encode(s.encode()).decode(),
        lambda s: base64.b64encode(base64.b64encode(s.encode())).decode(),
        lambda s: base64.urlsafe_b64encode(gzip.compress(s.encode(), mtime=0)).decode(),
        lambda s: base64.b64encode(zlib.compress(zlib.compress(s.encode()))).decode(),
        lambda s: urllib.parse.quote(base64.b64encode(s.encode()).decode()),
    ],
)
def test_nested_layers(code):
    coded = code(PLAIN)
    text = f"é text {coded} end"
    base, spans = secrets.find(text)
    assert set(base) <= set(spans) and spans
    at = text.index(coded)
    assert all(at <= a < b <= at + len(coded) for a, b, _ in spans)
    assert "hunter2" not in secrets.masked(text, spans) and secrets.masked(text, spans).startswith("é text ")


def lines(s, width, end="\n"):
    return end.join(s[i : i + width] for i in range(0, len(s), width))


LONG = "".join(f"line {i * 7919 % 1000} of prose, " for i in range(12)) + PLAIN + "".join(f" more {i * 31}" for i in range(20))


@pytest.mark.parametrize("pad", range(12))
@pytest.mark.parametrize(
    "code",
    [
        lambda s: base64.encodebytes(s.encode()).decode(),
        lambda s: lines(base64.b64encode(s.encode()).decode(), 64, "\r\n    "),
        lambda s: lines(base64.b64encode(s.encode()).decode(), 61, "\\n"),
        *[lambda s, f=f: lines(base64.b64encode(f(s.encode())).decode(), 64) for f in (gzip.compress, zlib.compress, bz2.compress, lzma.compress)],
        lambda s: "-----BEGIN CERTIFICATE-----\n" + lines(base64.b64encode(s.encode()).decode(), 64) + "\n-----END CERTIFICATE-----",
        *[lambda s, glue=glue: glue + base64.b64encode(s.encode()).decode() for glue in ("data/", "key_", "a-", "x", "xy", "abcde", "/")],
        *[lambda s, glue=glue: glue + base64.urlsafe_b64encode(gzip.compress(s.encode(), mtime=0)).decode() for glue in ("v1/", "a-", "x")],
        lambda s: "%FF" + "".join(f"%{b:02X}" for b in s.encode()) + "%FE",
        *[lambda s, q=q: q(gzip.compress(s.encode(), mtime=0)) for q in (urllib.parse.quote, urllib.parse.quote_plus)],
        lambda s: "".join(f"%{b:02x}" for b in lzma.compress(s.encode())),
    ],
)
def test_wrapped_glued_and_byte_encodings(code, pad):
    coded = code("z" * pad + " " + LONG)
    text = f"é text {coded} end"
    spans = secrets.find(text)[1]
    at = text.index(coded)
    # the plain text's spans are there, inside the code
    assert {k for *_, k in spans} >= {0} and all(at <= a < b <= at + len(coded) for a, b, _ in spans)


def test_base_spans_and_digests(spark, docs, none):
    odd = ["PASSWORD:'abcdef'", "ſecret = abcdefgh toKen=abcdef", "api_key : short api-key=abcdef apikey==abcdefg", "AKIA" + "A" * 15 + " AKIA" + "B" * 16, "0123456789abcdef" * 2 + "G", None, "token = token = abcdefg"]
    for t in odd:
        assert secrets.base_spans(t or "") == slow_base(t)
        assert set(slow_base(t)) <= set(secrets.find(t)[1])
    assert secrets.scan(none).count() == 0 and secrets.scan(docs).count() == docs.count()
    masked = secrets.mask(docs)
    assert masked.columns == docs.columns and masked.where("text is null").count() == docs.where("text is null").count()


def test_secret_query(spark, data):
    src = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    for r in queries.op8_secret_scan(spark, data).collect():
        base = slow_base(src[r["doc_id"]])
        told = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, b, k in base)
        assert r["base_sha256"] == hashlib.sha256(told.encode()).hexdigest()
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(x[2] == k for x in base) for k in range(3))
        assert set(filter(None, told.split(","))) <= set(r["spans"].split(","))


# ------------------------------------------------------------ 9 shards


def test_shards(docs, none):
    rows = sharding.shard(docs, rows_each=7).collect()
    assert len(rows) == docs.count()
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r["slot"])
    assert set(by) <= set(range(8)) and max(map(len, by.values())) - min(len(by[s]) for s in range(8)) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    text = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    assert all(r["size"] == len(text[r["doc_id"]].encode()) + 1 and r["text_crc32"] == zlib.crc32(text[r["doc_id"]].encode()) for r in rows)
    assert sorted(rows) == sorted(sharding.shard(docs, rows_each=7).collect())
    assert sharding.shard(none).count() == 0 and sharding.shard(docs.limit(3)).count() == 3


def test_shards_are_uniform(spark):
    ids = spark.range(12).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    seen = Counter()
    for k in range(40):
        for r in sharding.shard(ids, 3, seed=f"s{k}", rows_each=4).collect():
            seen[r["shard"], r["slot"]] += r["doc_id"]
    assert len(seen) == 12 and all(abs(v / 40 - 5.5) < 2.6 for v in seen.values())


@pytest.mark.parametrize("good, bad, sample", [(5, 7, 4), (40, 100, 30), (1000, 7000, 1000), (3, 1, 2), (2000, 500, 1200), (30000, 170000, 25000)])
def test_law_of_draws(spark, good, bad, sample):
    n = 4000
    got = np.array([r[0] for r in spark.range(n).select(sharding.hypergeometric(F.lit(good), F.lit(bad), F.lit(sample), F.lit(f"{good}"), F.col("id"))).collect()])
    all_ = good + bad
    mean = sample * good / all_
    var = mean * bad / all_ * (all_ - sample) / (all_ - 1)
    assert abs(got.mean() - mean) < 5 * math.sqrt(var / n) and abs(got.var() / var - 1) < 0.12


# ------------------------------------------------------------ 10 scores


def slow_ppm(train: list[bytes], order: int):
    """Counts per context, and the log10 probability of a text by escapes with exclusion."""
    seen = defaultdict(Counter)
    for t in train:
        s = bytes([255] * order) + t + b"\xff"
        for i in range(order, len(s)):
            for d in range(order + 1):
                seen[s[i - d : i]][s[i]] += 1

    def log10(t: bytes) -> float:
        s, total = bytes([255] * order) + t + b"\xff", 0.0
        for i in range(order, len(s)):
            out: set[int] = set()
            p = 1.0
            for d in range(order, -2, -1):
                if d < 0:
                    p /= 256 - len(out)
                    break
                c = {k: v for k, v in seen[s[i - d : i]].items() if k not in out} if s[i - d : i] in seen else {}
                if not c:
                    continue
                base = sum(c.values()) + len(c)
                if s[i] in c:
                    p *= c[s[i]] / base
                    break
                p *= len(c) / base
                out |= set(c)
            total += math.log10(p)
        return total

    return log10


def test_scores(docs, none):
    rows = ppm.score(docs, order=3, per_range=200).collect()
    src = docs.collect()
    low = lambda t: re.sub(b"[A-Z]", lambda m: m[0].lower(), (t or "").encode())
    train = [r for r in src if zlib.crc32(str(r["doc_id"]).encode()) % 7 != 2]
    c = Counter(w for r in train for w in [*low(r["text"]).split(), None])
    n, v = sum(c.values()), len(c)
    model = slow_ppm([low(r["text"]) for r in train], 3)
    text = {r["doc_id"]: r["text"] for r in src}
    assert len(rows) == len(src)
    for r in rows:
        ws = [*low(text[r["doc_id"]]).split(), None]
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(ws), sum(c[w] > 0 for w in ws), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), rel=1e-9)
        assert r["score"] == pytest.approx(model(low(text[r["doc_id"]])), rel=1e-4, abs=1e-3)
    assert ppm.score(none).count() == 0


def test_scores_use_every_counted_context(spark):
    r = random.Random(11)
    src = {i: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(1_500)) for i in range(50)}
    train = [t.encode() for i, t in src.items() if zlib.crc32(str(i).encode()) % 7 != 2]
    assert sum(len({t[i : i + d] for t in train for i in range(len(t))}) for d in range(1, 5)) > 40_000
    model = slow_ppm(train, 4)
    for row in ppm.score(spark.createDataFrame(list(src.items()), "doc_id long, text string"), per_range=500).collect():
        assert row["score"] == pytest.approx(model(src[row["doc_id"]].encode()), rel=1e-6)


def test_model_without_training(spark):
    one = spark.createDataFrame([(i, "abc") for i in range(50) if zlib.crc32(str(i).encode()) % 7 == 2], "doc_id long, text string")
    r = ppm.score(one).first()
    assert r["n_known"] == 0 and r["train_tokens"] == 0 and r["score"] == pytest.approx(-4 * math.log10(256), rel=1e-5)


def test_gram_blocks_agree(spark):
    rows = spark.createDataFrame([(t or "",) for t in texts()], "text string")
    whole = {(r["gram"], r["n"]) for r in ppm.grams(rows, 2).collect()}
    assert whole == {(r["gram"], r["n"]) for r in ppm.grams(rows, 2, block=97).collect()}


# ------------------------------------------------------------ pipeline


def test_pipeline_against_brute_force(spark, docs, monkeypatch):
    import corpus_pipeline as p

    hidden = prose(5, 120) + " password=hunter22x " + base64.b64encode(b"token: abcdefgh1").decode() + " " + prose(6, 60)
    more = spark.createDataFrame([(1_001, hidden, "en", "a", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    small = docs.select("doc_id", "text", "lang", "source", "n_chars").unionByName(more)
    # bands wide enough for the fixture's few words, so that later stages have something to do
    monkeypatch.setattr(quality.keep_good, "__defaults__", (quality.Bands(whole=((1 << 62, 1.0, 4.0),), chunk_band=(1.0, 9.0)),))
    bands = quality.keep_good.__defaults__[0]
    packer = quality.zstandard.ZstdCompressor(level=3)
    got = small
    for k, (_, stage) in enumerate(p.STAGES):
        before = got.collect()
        got = stage(spark, got, "").cache()
        if k < 4:
            assert got.columns == small.columns
        rows = got.collect()
        if k == 0:
            assert sorted(r["doc_id"] for r in rows) == sorted(r["doc_id"] for r in before if quality.measure(r["text"], packer, bands)[6])
            assert len(rows) > 5
        elif k == 1:
            assert sorted(r["doc_id"] for r in rows) == sorted(d for d, (_, c) in slow_groups(before).items() if d == c)
        elif k == 2:
            want = {r["doc_id"]: r["text"] for r in before}
            for r in rows:
                spans = secrets.find(want[r["doc_id"]])[1]
                outside = want[r["doc_id"]]
                for a, b, _ in reversed(spans):
                    outside = outside[:a] + outside[b:]
                assert r["text"].replace("[SECRET]", "") == outside and not secrets.find(r["text"])[1]
            assert len(rows) == len(before) and sum("[SECRET]" in r["text"] for r in rows) >= 1
        elif k == 3:
            plan = mixing.mix(spark.createDataFrame(before, small.schema)).collect()
            taken = defaultdict(int)
            for r in rows:
                taken[r["doc_id"]] += len(words(r["text"]))
            assert dict(taken) == {r["doc_id"]: r["taken"] for r in plan if r["taken"]}
        else:
            sequences = defaultdict(list)
            for r in rows:
                sequences[r["sequence_id"]].append((r["offset"], r["length"]))
            for held in sequences.values():
                held.sort()
                assert [a for a, _ in held] == [0, *np.cumsum([n for _, n in held])[:-1].tolist()] and sum(n for _, n in held) <= 2_048
            coder = packing.Coder(*packing.public_coder())
            assert sum(r["length"] for r in rows) == sum(len(coder.ids(r["text"] or "")) // 4 + 1 for r in before)
    assert [n for n, _ in p.STAGES] and p.ORACLE_SQL is None
