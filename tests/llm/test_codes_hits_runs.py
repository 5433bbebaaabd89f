"""Vector codes, benchmark hits and periodic runs against slow re-implementations, and their edge cases."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cloudloom.llm import decontaminate, periodic_runs, queries, vector_codes
from cloudloom.llm.common import table

VECTORS = "vec_id long, embedding array<float>, label int"
DOCS = "doc_id long, text string"


# ------------------------------------------------------------ vector codes


def slow_codes(rows, parts=4, entries=256, rounds=4):
    """Lloyd's rounds by comparing every part with every entry, in Python integers."""
    good = [(i, np.floor(1024 * np.array(v, np.float64)).astype(int)) for i, v, _ in rows]
    width = len(good[0][1]) // parts
    cut = [[v[p * width : (p + 1) * width].tolist() for _, v in good] for p in range(parts)]
    books = [c[:entries] for c in cut]
    nearest = lambda x, book: min(range(len(book)), key=lambda e: (sum((a - b) ** 2 for a, b in zip(x, book[e], strict=True)), e))
    for _ in range(rounds):
        for p in range(parts):
            held = defaultdict(list)
            for x in cut[p]:
                held[nearest(x, books[p])].append(x)
            books[p] = [[sum(c) // len(held[e]) for c in zip(*held[e], strict=True)] if e in held else b for e, b in enumerate(books[p])]
    codes = [[nearest(cut[p][i], books[p]) for p in range(parts)] for i in range(len(good))]
    error = [sum(sum((a - b) ** 2 for a, b in zip(cut[p][i], books[p][codes[i][p]], strict=True)) for p in range(parts)) for i in range(len(good))]
    return codes, error, books


@pytest.mark.parametrize(("entries", "rounds", "spread"), [(6, 4, 0.004), (3, 1, 1.0), (12, 7, 0.02), (1, 2, 0.5)])
def test_codes_are_those_of_full_comparison(spark, entries, rounds, spread):
    """Small spreads give many equal distances, repeated vectors and entries that go unused."""
    rng = random.Random(entries)
    rows = [(i, [rng.choice((-1, 1)) * rng.random() * spread for _ in range(8)], i % 3) for i in range(90)]
    rows += [(100 + i, rows[5][1], None) for i in range(40)]
    df = spark.createDataFrame(rows, VECTORS).repartition(5)
    # what Spark holds are floats
    rows = sorted((r["vec_id"], r["embedding"], r["label"]) for r in df.where("label is not null").collect())
    rows += [(r["vec_id"], r["embedding"], None) for r in df.where("label is null").orderBy("vec_id").collect()]
    got = vector_codes.compress(df, entries=entries, rounds=rounds)
    codes, error, books = slow_codes(rows, entries=entries, rounds=rounds)
    assert [b.tolist() for b in got.books] == books
    want = {r[0]: (c, e) for r, c, e in zip(rows, codes, error, strict=True)}
    assert {r["id"]: (r["codes"], r["error"]) for r in got.rows.collect()} == want
    sums = defaultdict(int)
    for r in rows:
        sums[r[2]] += want[r[0]][1]
    assert all(r["label_error"] == sums[r["label"]] for r in vector_codes.label_errors(got.rows).collect())


def test_rounds_scan_only_what_drift_reaches():
    """Parts far from any border keep their entry without a scan; the heaps survive packing."""
    rng = np.random.default_rng(3)
    book = np.array([[0, 0], [5000, 0], [0, 5000]])
    x = book[rng.integers(0, 3, 400)] + rng.integers(-300, 300, (400, 2))
    x[:4] = [[2500, 0], [2499, 1], [2, 2501], [2501, 2500]]
    near, slack = vector_codes.scan(x, book)
    heaps = vector_codes.Heaps(3)
    heaps.push(near, slack, np.arange(400))
    heaps = vector_codes.Heaps(3, heaps.packed())
    assert heaps.owners().tolist() == near.tolist()
    moved = book + [[40, 10], [-30, 0], [5, 5]]
    drift = vector_codes.drifted(np.zeros(3), book, moved)
    rows, _ = vector_codes.Heaps(3, heaps.packed()).popped(drift)
    assert 4 <= len(rows) < 40
    vector_codes.settle(0, x, heaps, moved, drift, vector_codes.Moves([moved]))
    assert heaps.owners().tolist() == vector_codes.scan(x, moved)[0].tolist()


def test_vectors_that_cannot_be_coded_are_dropped(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (7, None, 1), (1, [], 1), (2, [0.5] * 8, 1), (3, [0.5] * 7 + [nan], 1), (4, [inf] * 8, 1), (5, [None] * 8, 1), (6, [0.1] * 7, 1),
        (8, [0.2] * 12, 1), (None, [0.25] * 8, None), (2, [0.75] * 8, 1),
    ]
    df = spark.createDataFrame(rows, VECTORS).withColumn("id", F.lit("x")).withColumn("codes", F.lit(1))
    got = vector_codes.compress(df)
    assert [b.shape for b in got.books] == [(3, 2)] * 4
    assert sorted((r["id"] is None, r["id"] or 0, r["codes"], r["error"]) for r in got.rows.collect()) == [
        (False, 2, [0] * 4, 0), (False, 2, [1] * 4, 0), (True, 0, [2] * 4, 0),
    ]
    empty = vector_codes.compress(df.where("false"))
    assert empty.rows.collect() == [] and empty.text() == ""
    assert vector_codes.label_errors(empty.rows).collect() == []
    with pytest.raises(Exception, match="out of range"):
        vector_codes.compress(spark.createDataFrame([(1, [1e9] * 4, 1)], VECTORS))


def test_large_components_stay_exact():
    x, book = np.array([[1 << 25, -(1 << 25)]]), np.array([[1 << 25, (1 << 25) - 1], [-(1 << 25), -(1 << 25)]])
    assert vector_codes.distances(x, book).tolist() == [[((1 << 26) - 1) ** 2, (1 << 26) ** 2]]


# ------------------------------------------------------------ decontamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def slow_hits(docs, items, size=10):
    """All windows of all items looked up at every word of every document."""
    windows = defaultdict(set)
    for item, text in items:
        ws = WORD.findall(lowered(text))
        n = min(size, len(ws))
        for i in range(len(ws) - n + 1 if n else 0):
            windows[tuple(ws[i : i + n])].add("" if item is None else str(item))
    out = []
    for doc, text in docs:
        at = list(WORD.finditer(lowered(text)))
        ws, hit, found = [m[0] for m in at], set(), set()
        for n in {len(w) for w in windows}:
            for i in range(len(ws) - n + 1):
                if tuple(ws[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[tuple(ws[i : i + n])]
        spans = [(at[i].start(), at[next(j for j in range(i, len(at) + 1) if j not in hit) - 1].end()) for i in sorted(hit) if i - 1 not in hit]
        out.append((doc, len(ws), len(hit), sorted(found), spans))
    return out


def told(rows):
    return [(r["doc_id"], r["n_words"], r["n_hit"], list(r["items"]), [(s["start"], s["end"]) for s in r["spans"]]) for r in rows]


def hit_fixture():
    rng = random.Random(4)
    word = lambda: rng.choice(["Alpha", "beta", "Größe", "x9", "the", "语言", "don't", " nb", "E"])
    text = lambda n: rng.choice([" ", ", ", "\n", " - "]).join(word() for _ in range(n))
    items = [(i, text(rng.randint(1, 25))) for i in range(12)] + [(3, "the the"), (None, "solo\x00only"), (20, None), (21, ""), (22, "!?")]
    docs = [(i, text(rng.randint(0, 60))) for i in range(60)]
    docs += [(100 + i, f"{text(7)}; {t.upper()} ... {text(5)}") for i, (_, t) in enumerate(items) if t]
    docs += [(200, None), (201, ""), (None, "Solo, ONLY"), (201, "solo only"), (202, "x " * 9)]
    return docs, items


@pytest.mark.parametrize(("most", "size"), [(200_000, 10), (7, 4), (7, 10)])
def test_hits_are_those_of_looking_up_every_window(spark, most, size):
    docs, items = hit_fixture()
    df = spark.createDataFrame([(*d, "w", 1) for d in docs], DOCS + ", words string, id int").repartition(4)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = told(decontaminate.scan(df, bench, size=size, most_windows=most).collect())
    key = lambda x: (x[0] is None, x[0] or 0, x[1], x[2])
    assert sorted(got, key=key) == sorted(slow_hits(docs, items, size), key=key)


def test_hits_across_stretches_of_a_text():
    docs, items = hit_fixture()
    pairs = {(" ".join(ws[i : i + min(4, len(ws))]), str(k)) for k, t in items for ws in [WORD.findall(lowered(t))] if ws for i in range(max(1, len(ws) - 3))}
    machine = decontaminate.Automaton(list(pairs))
    for _, text in docs:
        raw = (text or "").encode()
        n, hits, found = machine.scan(raw)
        for step in (1, 5, 30):
            again = machine.scan(raw, step)
            assert (again[0], set(again[1]), again[2]) == (n, set(hits), found)
            spans = decontaminate.joined_up(hits, n)
            assert decontaminate.places(raw, spans, step) == decontaminate.places(raw, spans)


def test_no_benchmark_and_no_documents(spark):
    docs = spark.createDataFrame([(1, "a b c")], DOCS)
    bench = spark.createDataFrame([], "item_id long, text string")
    assert told(decontaminate.scan(docs, bench).collect()) == [(1, 3, 0, [], [])]
    assert decontaminate.scan(docs.where("false"), spark.createDataFrame([(1, "a")], "item_id long, text string")).collect() == []


# ------------------------------------------------------------ periodic runs


def slow_runs(w, least=6, times=4):
    """Every period at every place."""
    out = {}
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i > s and i + q - s >= max(least, times * q):
                out.setdefault((s, i + q - s), q)
            i = max(i, s + 1)
    return sorted((s, n, q) for (s, n), q in out.items())


def random_words(rng):
    """Short alphabets, repeated pieces, and copies of what came before."""
    if rng.random() < 0.3:
        return [rng.choice("abc"[: rng.randint(1, 3)]) for _ in range(rng.randint(0, 80))]
    w = []
    for _ in range(rng.randint(0, 6)):
        piece = [rng.choice("abcde") for _ in range(rng.randint(1, 9))]
        kind = rng.random()
        if kind < 0.6:
            w += (piece * rng.randint(1, 9))[: -rng.randint(1, 3)]
        elif kind < 0.8 and w:
            at = rng.randrange(len(w))
            w += w[at : at + rng.randint(1, 40)]
        else:
            w += [rng.choice("abcdefghij") for _ in range(rng.randint(1, 30))]
    return w


def test_runs_are_those_of_every_period_at_every_place():
    rng = random.Random(9)
    seen = 0
    for _ in range(400):
        texts = [random_words(rng) for _ in range(rng.randint(1, 6))]
        want = [slow_runs(w) for w in texts]
        assert periodic_runs.text_runs([[x.encode() for x in w] for w in texts]) == want
        seen += sum(map(len, want))
    assert seen > 500


def test_vocabulary_has_every_rotation_and_links_drop_the_first_word():
    """Each marked place is a square of its period; a run's rotations are all there; links lead to the rest of a node."""
    text = np.array([5, 1, 2, 3, 1, 2, 3, 1, 2, 3, 1, 2, 3, 9, 2, 3, 1, 2, 3, 1, -1])
    names = periodic_runs.Names(text)
    tree = periodic_runs.Tree(names)
    found = periodic_runs.leftmost(text, names, np.full(len(text), 5), 6, 4)
    assert found.tolist() == [[1, 13, 3]]
    places = tree.vocabulary(names, found)
    squares = {tuple(text[names.order[a] : names.order[a] + 2 * q].tolist()) for a, _, q in places.tolist()}
    assert squares == {(1, 2, 3) * 2, (2, 3, 1) * 2, (3, 1, 2) * 2}
    assert sum(b - a + 1 for a, b, _ in places.tolist()) == 7 + 1
    for v in range(1, len(tree.depth)):
        at, d = names.order[tree.left[v]], tree.depth[v]
        u = tree.link[v]
        assert tree.depth[u] == d - 1
        rest = names.order[tree.left[u]]
        assert text[at + 1 : at + d].tolist() == text[rest : rest + d - 1].tolist()


def test_long_runs_take_near_linear_time():
    n = 60_000
    for q in (1, 7, 1_000, n // 4):
        w = [b"%d" % (i % q) for i in range(n)]
        assert periodic_runs.text_runs([w]) == [[(0, n, q)]]


def test_runs_query_on_hard_rows(spark, tmp_path):
    texts = [None, "", "   ", "a", "a a a a a", "a a a a a a", "x " + "a b " * 9 + "c " + "b a " * 4, "é é " * 8, "p q r " * 400 + "s"]
    rows = [(i, t, "s") for i, t in enumerate(texts)] + [(None, "z " * 30, "s"), (5, "a a a a a a", "s"), (32, " ".join(str(i % 50) for i in range(777)), "s")]
    spark.createDataFrame(rows, DOCS + ", runs string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in queries.op13_periodic_runs(spark, str(tmp_path)).na.fill(-1).collect())
    want = []
    for doc, text, _ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        h = zlib.crc32(str(doc).encode() if doc is not None else b"")
        if h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs = slow_runs(w)
        best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2])) if runs else (-1, -1, -1)
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        want.append((
            -1 if doc is None else doc, len(runs), *best, 1000 * best[1] // best[2] if runs else -1,
            sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)),
        ))
    assert got == sorted(want)
    with pytest.raises(ValueError):
        periodic_runs.find_runs(table(spark, str(tmp_path), "documents"), times=3)
