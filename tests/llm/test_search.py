"""Operators 5, 6, 7 and 9 against brute force."""

import hashlib
import math
import random
import re
import time
from collections import defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import additive, components, minhash, queries, suffixes, tagpaths
from palimpsest.llm.common import same_bytes

from .test_basic import EDGE, frame

SF = "/root/testdata/sf0.001"


# ---- components


@pytest.mark.parametrize("seed", [0, 1])
def test_components(spark, seed):
    rng = np.random.default_rng(seed)
    edges = rng.integers(0, 300, (220, 2)).tolist() + [[1000 + i, 1001 + i] for i in range(40)] + [[5000, 2000 + i] for i in range(50)] + [[7, 7], [None, 3]]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in edges:
        if a is not None and a != b:
            p, q = find(a), find(b)
            parent[max(p, q)] = min(p, q)
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {x: find(x) for x in list(parent)}
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# ---- near-duplicates


def brute_near(rows, percent):
    word = re.compile(r"[^\x20\x09-\x0D]+")
    low = {c: c + 32 for c in range(65, 91)}
    sets = []
    for i, t in rows:
        w = word.findall((t or "").translate(low))
        sets.append((i, {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()))
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = find(sets[a][0]), find(sets[b][0])
                parent[max(p, q)] = min(p, q)
    return sorted((i, len(s), find(i), find(i) == i) for i, s in sets)


def near_rows(seed, n=60, copies=45):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    base = [r.choice(vocab) for _ in range(120)]
    common = [r.choice(vocab) for _ in range(60)]
    rows = []
    for i in range(n):
        rows.append((i * 3, " ".join(r.choice(vocab) for _ in range(r.randint(0, 90)))))
    for i in range(copies):
        w = list(base)
        for _ in range(r.randint(0, 3)):
            w[r.randrange(len(w))] = r.choice(vocab)
        rows.append((1000 + i, " ".join(w).upper() if i % 2 else "\n".join(w)))
    for i in range(30):
        rows.append((2000 + i, " ".join(common + [r.choice(vocab) for _ in range(r.randint(1, 40))])))
    return rows + rows[5:9] + [(5000, None), (5001, ""), (5002, "  \n"), (5003, "a b"), (5004, "A  b"), (5005, "a b c")]


@pytest.mark.parametrize("seed,longest,block", [(0, 24, 256), (1, 3, 8), (2, 2, 5)])
def test_near_duplicates_brute_force(spark, monkeypatch, seed, longest, block):
    monkeypatch.setattr(minhash.links, "__defaults__", (longest, block))
    rows = near_rows(seed)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs, 85).collect())
    want = brute_near(list(dict.fromkeys(rows)), 85)
    twice = [w for w in want for _ in range(rows.count(next(x for x in rows if x[0] == w[0])))]
    assert got == twice


@pytest.mark.parametrize("bits", [1, 6])
def test_near_duplicates_names_of_sets(spark, bits):
    """Names of 1 or 6 bits stand for many sets: second ones replace them, and strangers stay strangers."""
    rows = list(dict.fromkeys(near_rows(5)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs, 85, bits=bits).collect())
    assert got == brute_near(rows, 85)


def test_tied_lists():
    """Long lists of a task become ties and a few entries: the same components, and short lists stay as they are."""
    r = np.random.default_rng(4)
    values, classes = r.integers(0, 40, 900) ** 2 // 40, r.integers(0, 500, 900)
    both = np.unique(np.stack([values, classes], 1), axis=0)
    v, c, t = minhash.tied(both[:, 0], both[:, 1], 6)
    entries, lists = defaultdict(set), defaultdict(set)
    for x, y in both.tolist():
        lists[x].add(y)
    for x, y, z in zip(v.tolist(), c.tolist(), t.tolist()):
        if z < 0:
            entries[x].add(y)
    assert all(entries[x] == m if len(m) <= 6 else entries[x] == set(sorted(m)[:7]) for x, m in lists.items())
    ties = {(y, z) for x, y, z in zip(v.tolist(), c.tolist(), t.tolist()) if z >= 0}
    assert ties == {(y, min(m)) for m in lists.values() if len(m) > 6 for y in m if y != min(m)} and all(x == y for x, y, z in zip(v, c, t) if z >= 0)


def test_near_duplicates_clashing_names(spark):
    long = " ".join(f"w{i}" for i in range(30_000))
    docs = spark.createDataFrame([(1, long, 5, 6), (2, long + " more", 7, 8), (None, long, 9, 9), (3, None, 1, 1), (3, "b", 1, 1), (3, "a", 1, 1)], "doc_id bigint, text string, nth int, kept_id int").withColumn("node", F.lit(1)).withColumn("cls", F.lit("x"))
    out = minhash.deduplicated(docs)
    assert out.columns == docs.columns and sorted((str(r.doc_id), r.nth, r.kept_id) for r in out.collect()) == [("1", 5, 6), ("3", 1, 1), ("None", 9, 9)]
    assert minhash.deduplicated(docs.limit(0)).collect() == []


def test_near_duplicates_real_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in queries.op9_bottom_k_near_dedup(spark, SF).collect())
    assert got == brute_near(rows, 85)
    kept = {g[0] for g in brute_near(rows, 80) if g[3]}
    assert {r.doc_id for r in minhash.deduplicated(docs, 80).collect()} == kept


def test_near_duplicates_edges(spark):
    got = minhash.near_duplicates(frame(spark)).collect()
    assert len(got) == len(EDGE) and sum(r.doc_id is None and r.kept for r in got) == 1
    assert minhash.near_duplicates(frame(spark).limit(0)).count() == 0
    assert sorted(str(r.doc_id) for r in minhash.deduplicated(frame(spark)).collect()) == ["1", "2", "3", "4", "5", "6", "None"]
    odd = spark.createDataFrame([(1, "a b c d e"), (1, "x y z v w"), (2, "x y z v w"), (0, "a b c d e")], "doc_id bigint, text string")
    assert {r.component_id for r in minhash.near_duplicates(odd).collect()} == {0}


def shuffles(spark):
    dirs = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {f.name.split("_")[1] for d in dirs for f in Path(str(d)).glob("*/shuffle_*.data")}


@pytest.mark.parametrize("query", [minhash.near_duplicates, minhash.deduplicated])
def test_near_duplicates_leave_no_shuffle_files(spark, query):
    """Of some hundred shuffles; one that a query begins and turns out not to need may end after it."""
    before = shuffles(spark)
    out = query(frame(spark))
    assert out.count()
    until = time.time() + 10
    while len(left := shuffles(spark) - before) and time.time() < until:
        time.sleep(0.2)
    assert len(left) <= 3


def test_pairs_of_unlike_sizes_take_no_values_along(spark, monkeypatch):
    met, cut = [], minhash.cut
    monkeypatch.setattr(minhash, "cut", lambda df: met.append(out := cut(df)) or out)
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(words[:n]) for n in (12, 13, 14, 40, 42, 60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs, 85).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 5}
    pairs = [r for df in met if df.columns == ["a", "b", "na", "nb"] for r in df.collect()]
    assert pairs and all(100 * min(r.na, r.nb) >= 85 * max(r.na, r.nb) for r in pairs)


def test_sketch_keeps_a_common_value():
    r = np.random.default_rng(2)
    for _ in range(300):
        n = int(r.integers(1, 200))
        a = np.unique(r.integers(0, 2**63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[r.random(len(a)) > 0.06], r.integers(0, 2**63, int(r.integers(0, 8))).astype(np.uint64)]))
        if 100 * len(np.intersect1d(a, b)) >= 85 * len(np.union1d(a, b)):
            bitmap = r.integers(0, 256, 1 << 19).astype(np.uint8)
            assert len(np.intersect1d(minhash.sketch(a, 85), minhash.sketch(b, 85)))
            assert len(np.intersect1d(minhash.sketch(a, 85, bitmap), minhash.sketch(b, 85, bitmap)))


# ---- suffixes


def brute_repeats(rows, width=50):
    raw = [(i, (t or "").encode()) for i, t in rows]
    least = {}
    for i, b in raw:
        for p in range(len(b) - width + 1):
            w = b[p : p + width]
            least[w] = min(i, least.get(w, i))
    out = []
    for i, b in raw:
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - width + 1):
            if least[b[p : p + width]] < i:
                gone[p : p + width] = True
        n = int(gone.sum())
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((i, len(b), n, spans, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()))
    return sorted(out)


def test_difference_cover():
    d = suffixes.difference_cover(31)
    assert len(d) == 6 and {(a - b) % 31 for a in d for b in d} == set(range(31))
    assert len(suffixes.difference_cover(7)) == 3


@pytest.mark.parametrize("letters,n", [("ab", 3000), ("a", 400), ("abcdefgh", 2000), ("abc\0", 1500)])
def test_sort_suffixes(letters, n):
    r = random.Random(n)
    text = "".join(r.choice(letters) for _ in range(n))
    text = text[: n // 2] + text[: n // 2] + text[100:400]
    raw = np.frombuffer(text.encode() + bytes(suffixes.PAD), np.uint8)
    at = np.array(sorted(r.sample(range(len(text)), len(text) // 2)))
    got = at[suffixes.sort_suffixes(raw, at)]
    heads = [bytes(raw[p : p + 150]) for p in got]
    assert heads == sorted(heads) and sorted(got) == at.tolist()


def repeat_rows(seed):
    r = random.Random(seed)
    words = ["the", "Über", "naïve", "x", "and", "lorem", "ipsum", "€", "zz9", "plural"]
    text = lambda n: " ".join(r.choice(words) + str(r.randint(0, 30)) for _ in range(n))
    passage, line = text(25), text(9)
    rows = [(i, text(r.randint(0, 80))) for i in range(40)]
    rows += [(100 + i, text(10) + passage[r.randint(0, 20) :] + text(7)) for i in range(25)]
    rows += [(200 + i, line + "\n" + text(5) + "\n" + line + "\n" + line) for i in range(10)]
    rows += [(300 + i, "And " * (20 + i)) for i in range(5)] + [(400, passage), (401, passage), (50, passage), (402, None), (403, ""), (404, "short")]
    long = text(300)
    return rows + [(500, long), (499, long[:900] + "!" + long[900:]), (501, long[40:])]


@pytest.mark.parametrize("seed,bits", [(0, None), (1, None), (2, None)])
def test_repeats_brute_force(spark, seed, bits):
    rows = repeat_rows(seed)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    got = sorted(tuple(r) for r in suffixes.remove_repeats(docs, keep=False).collect())
    assert got == brute_repeats(rows)


def test_repeats_real_rows(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(tuple(r) for r in queries.op5_suffix_dedup(spark, SF).collect())
    assert got == brute_repeats(rows)


def repeats_without_spark(rows, blocks=3, bits=2):
    """The worker functions one after another, so that a test can change their parameters."""
    def dealt(batches, column):
        out = defaultdict(list)
        for b in batches:
            for r in b.to_pylist():
                out[r[column]].append(r)
        return {k: pa.Table.from_pylist(v, mail) for k, v in sorted(out.items())}

    mail = pa.schema(list(zip(suffixes._NAMES, suffixes._TYPES)))
    docs = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("block", pa.int32())])
    table = pa.Table.from_pylist([{"doc_id": i, "text": t, "block": i % blocks} for i, t in rows], docs)
    sent = [b for part in (table[:20], table[20:]) for b in suffixes._scan(blocks, bits)(iter(part.combine_chunks().to_batches()))]
    told = [b for p, t in dealt(sent, "place").items() for b in suffixes._share(blocks, bits)((pa.scalar(p),), iter(t.to_batches()))]
    told, found = dealt(told, "block"), []
    parts = {b: table.filter(pa.compute.equal(table.column("block"), b)) for b in range(blocks)}
    for b in range(blocks):
        found += suffixes._emit(bits, "block")(parts[b], told.get(b, mail.empty_table())).to_batches()
    texts = []
    for level in range(len(suffixes.GRAMS)):
        texts.append(sum(r["kind"] == suffixes.TEXT for b in found for r in b.to_pylist()))
        found = [b for p, t in dealt(found, "place").items() for b in suffixes._sort_bucket(level, bits)((pa.scalar(p),), iter(t.to_batches(max_chunksize=1)))]
    spans = dealt(found, "block")
    done = [suffixes._digests(False)(parts[b], spans.get(b, mail.empty_table())) for b in range(blocks)]
    return sorted(tuple(r.values())[:5] for t in done for r in t.to_pylist()), texts


@pytest.mark.parametrize("seed", [0, 1])
def test_repeats_compare_bytes(monkeypatch, seed):
    """Digests of 8 bits (nearly all strings agree) change nothing."""
    rows = repeat_rows(seed)
    plain = suffixes._digest
    monkeypatch.setattr(suffixes, "_digest", lambda *a: plain(*a) & np.uint64(0xFF))
    assert repeats_without_spark(rows)[0] == brute_repeats(rows)
    monkeypatch.setattr(suffixes, "_digest", lambda *a: plain(*a) * np.uint64(0))
    assert repeats_without_spark(rows)[0] == brute_repeats(rows)


@pytest.mark.parametrize("bucket,key,part,some", [(20_000, 400, 1 << 20, 1 << 16), (1500, 200, 500, 64), (60, 50, 100, 16)])
def test_repeats_hot_keys_are_dealt_anew(monkeypatch, bucket, key, part, some):
    """One phrase of 46 bytes with very many surroundings, and buckets, keys, parts and ranges that hold next to nothing."""
    for name, value in (("BUCKET_BYTES", bucket), ("KEY_BYTES", key), ("PART", part), ("RANGE", some)):
        monkeypatch.setattr(suffixes, name, value)
    r = random.Random(bucket)
    phrase = "Licensed under the Apache License, Version 2.0"
    rows = repeat_rows(3) + [(1000 + i, f"{r.random()} {phrase} {r.choice('abc')} {r.random()}") for i in range(60)]
    got, texts = repeats_without_spark(rows)
    assert got == brute_repeats(rows) and texts[1] > 0 and (key > 200 or texts[2] > 0)


def test_same_bytes():
    r = np.random.default_rng(1)
    a, b = (np.concatenate([r.integers(0, 2, 4000).astype(np.uint8), np.zeros(8, np.uint8)]) for _ in range(2))
    x, y, n = r.integers(0, 3900, 3000), r.integers(0, 3900, 3000), r.integers(1, 30, 3000)
    assert same_bytes(a, x, b, y, n).tolist() == [bytes(a[i : i + m]) == bytes(b[j : j + m]) for i, j, m in zip(x, y, n)]
    assert same_bytes(a, x, a, x, n).all()


def test_repeats_clashing_names_and_long_texts(spark):
    text = "And so on, line by line. " * 8000
    rows = [(1, text, 7), (2, "x" + text + "y", 8), (3, None, 9), (3, None, 9), (None, text, 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, block int").withColumn("BLOCK_", F.lit("mine")).withColumn("place", F.lit(3))
    got = {r.doc_id: r for r in suffixes.removed_documents(docs).collect() if r.doc_id != 3}
    assert got[2].text == "xy" and got[1].text == got[None].text == text and got[2].block == 8 and got[2]["BLOCK_"] == "mine" and got[1].place == 3
    assert sorted(tuple(r) for r in suffixes.remove_repeats(docs.where("doc_id < 3"), keep=False).collect()) == brute_repeats([r[:2] for r in rows[:2]])
    assert suffixes.removed_documents(docs.limit(0)).collect() == []


def test_repeats_edges(spark):
    got = suffixes.remove_repeats(frame(spark)).collect()
    assert len(got) == len(EDGE) and all(r.n_removed == 0 for r in got)  # equal ids are one document
    assert suffixes.remove_repeats(frame(spark).limit(0)).count() == 0
    rows = [(2, "é" * 60 + "A" * 60), (1, "é" * 60 + "B" * 10)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r.doc_id: r.text for r in suffixes.removed_documents(docs).collect()} == {1: rows[1][1], 2: "A" * 60}
    assert suffixes.removed_documents(frame(spark)).columns == frame(spark).columns


# ---- pages


def test_pages():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
    <nav><ul><li><a href="/a">A menu, here.</a></li></ul></nav><!-- x --><div class="ad">Buy this, now.</div>
    <article><h1>Head &amp; line</h1><p><b>One&nbsp;two<br>three.</b><p>Short.<ul><li>i<li>ii</ul><p>Last</article>
    <section id="comments"><p>A long comment, with marks, and more of them, and more.</p></section><footer>&copy; x, y, z.</footer></body></html>"""
    assert tagpaths.main_text(page) == "Head & line\n\nOne two three.\n\nShort.\n\ni\n\nii\n\nLast"
    assert tagpaths.main_text(None) == tagpaths.main_text("") == tagpaths.main_text("<nav>x</nav>") == ""
    plain = '<body><div class="top"><a href="x">home</a> <a>news</a></div><div id="story">' + "<p>Some running text, with marks, that goes on. And on it goes.</p>" * 6 + "<p>End</p></div><div><a>one</a><a>two</a></div></body>"
    assert tagpaths.main_text(plain) == "\n\n".join(["Some running text, with marks, that goes on. And on it goes."] * 6 + ["End"])
    assert tagpaths.main_text("<p>a<p>b") == "a\n\nb" and tagpaths.main_text("bare text &lt;") == "bare text <"


def test_pages_ratios_decide_in_a_marked_part():
    """Low paths inside <article> that no list of signs knows: links, a share box, a notice."""
    prose = "Some running text, with marks, that goes on. And on it goes, for a while."
    page = "<body><article><h1>Head</h1><div class='tools'><a href='t'>Tweet</a> <a href='m'>Mail</a></div>" + f"<p>{prose}</p>" * 5 + "<div class='hint'>Closing soon</div><p>See <a href='x'>this</a></p><ul><li>one item</li></ul>"
    page += "<ul><li><a href='1'>More</a></li><li><a href='2'>And more</a></li></ul></article></body>"
    assert tagpaths.main_text(page) == "\n\n".join(["Head", *[prose] * 5, "See this", "one item"])
    assert tagpaths.main_text(page.replace("article", "main")) == tagpaths.main_text(page)


def test_pages_keep_what_the_ratios_select():
    """An article spread over sibling containers, its heading beside them, and wrappers whose names only contain a sign."""
    prose = [f"Some running text, number {k}, with marks, that goes on. And on it goes, for a while." for k in range(11)]
    story, more = ("".join(f"<p>{p}</p>" for p in part) for part in (prose[:10], prose[10:]))
    menu = "<div class='top'><a href='x'>home</a> <a href='y'>news</a></div>"
    whole = "\n\n".join(prose)
    assert tagpaths.main_text(f"<body>{menu}<div id=a>{story}</div><div id=b>{more}</div></body>") == whole
    assert tagpaths.main_text(f"<body>{menu}<h1>Head</h1><div id=a>{story}{more}</div></body>") == "Head\n\n" + whole
    for wrapper in ("class='content no-sidebar'", "id='social-history'", "class='widget'"):
        assert tagpaths.main_text(f"<body>{menu}<div {wrapper}>{story}{more}</div></body>") == whole
        assert tagpaths.main_text(f"<body><article><div {wrapper}>{story}{more}</div></article></body>") == whole
    assert tagpaths.main_text(f"<body><article>{story}<div class='share'><p>Tell others</p></div>{more}</article></body>") == whole


def rated(nodes):
    """The ratings by definition, path by path."""
    own, smooth, real = {}, {}, [n for n in nodes if n.text != " "]
    for p in {n.path for n in real}:
        mine = [n for n in real if n.path is p]
        own[p] = math.log1p(sum(len(n.text) for n in mine) / len(mine) * (1 + sum(len(re.findall("[.,;:!?。、，]", n.text)) for n in mine) / len(mine)))
    for k, n in enumerate(real):
        near = [(w, own[real[k + d].path]) for d, w in zip(range(-2, 3), (1, 4, 6, 4, 1)) if 0 <= k + d < len(real)] if len(real) >= 5 else [(1, own[n.path])]
        smooth.setdefault(n.path, []).append(sum(w * v for w, v in near) / sum(w for w, _ in near))
    return {p: math.sqrt(own[p] * sum(v) / len(v)) for p, v in smooth.items()}


def test_pages_ratios_by_brute_force(spark):
    for r in spark.read.parquet(f"{SF}/pages.parquet").select("html").collect():
        nodes = [n for n in tagpaths.text_nodes(r.html)[0] if not n.left_out]
        want, got = rated(nodes), tagpaths.path_ratios(nodes)
        assert want.keys() == got.keys() and all(abs(want[p] - got[p]) < 1e-9 for p in want)


def test_pages_ratios_decide_without_marks(spark, monkeypatch):
    """Pages without <article>, and with navigation that only its ratios tell from the story: nearly all keep their text, and none does with one ratio
    for all paths."""
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect()]
    texts = [tagpaths.main_text(p) for p in pages]
    bare = [re.sub(r"<nav\b(.*?)</nav>", r"<div class='top'\1</div>", re.sub(r"(</?)(article|main)\b", r"\1div", p), flags=re.S) for p in pages]
    assert sum(a == tagpaths.main_text(b) for a, b in zip(texts, bare)) >= 0.88 * len(pages)
    monkeypatch.setattr(tagpaths, "path_ratios", lambda nodes: {n.path: 1.0 for n in nodes if n.text != " "})
    assert sum(tagpaths.main_text(b) != t for b, t in zip(bare, texts)) > 0.9 * len(pages)


def test_pages_marks_only_settle_what_the_ratios_leave():
    prose = [f"Some running text, number {k}, with marks, that goes on. And on it goes, for a while." for k in range(8)]
    story = "".join(f"<p>{p}</p>" for p in prose)
    cards = "".join(f"<article><h3>Card {k}</h3><span>5 min</span></article>" for k in range(4))
    assert tagpaths.main_text(f"<body>{cards}<div id='story'>{story}</div></body>") == "\n\n".join(prose)  # marks on what is no article
    assert tagpaths.main_text(f"<body><article>{story}</article><div><p>{prose[0]}</p></div></body>") == "\n\n".join(prose)


def test_pages_comments_adverts_and_loose_text():
    prose = [f"Some running text, number {k}, with marks, that goes on. And on it goes, for a while." for k in range(6)]
    story, whole = "".join(f"<p>{p}</p>" for p in prose), "\n\n".join(prose)
    said = "".join(f"<p>I say, at length, that {p}</p>" for p in prose * 3)
    for tag in ("<section class='comments'>", "<div id='comments'>", "<div class='post-footer comment'>"):
        close = "</section>" if "section" in tag else "</div>"
        assert tagpaths.main_text(f"<body><main>{story}{tag}{said}{close}</main></body>") == whole
        assert tagpaths.main_text(f"<body><div id='story'>{story}</div>{tag}{said}{close}</body>") == whole
    assert tagpaths.main_text(f"<body><article>{story}<div class='sponsored'><p>Buy this thing, the best of all, now. {prose[0]}</p></div></article></body>") == whole
    loose = f"<body><article><p>{prose[0]}</p>Loose text without a paragraph<p>{prose[1]}</p><div>Short text.</div><div>{prose[2]}</div></article></body>"
    assert tagpaths.main_text(loose) == "\n\n".join([prose[0], "Loose text without a paragraph", prose[1], "Short text.", prose[2]])
    assert tagpaths.main_text(f"<body><article>{story}<div class='related'><p>{prose[0]}</p></div></article></body>") == whole


@pytest.mark.parametrize("unit", ["<a ", "<a '", '<a ">" ', "<b>x", "<div>x ", "</x>", "<div></p>", "<!--", "<p", "<ul><li>", '<i class="ad">', "<!x ", "<td>1<tr>", "&lt;", "<script>"])
def test_pages_broken_markup_takes_linear_time(unit):
    page = f"<body><article><p>Some text, with marks.</p>{unit * 2000}"
    start = time.perf_counter()
    assert tagpaths.main_text(page).startswith("Some text, with marks.")
    small = time.perf_counter() - start
    start = time.perf_counter()
    tagpaths.main_text(page + unit * 38_000)
    assert time.perf_counter() - start < 60 * small + 1  # 20 times the length


def test_pages_odd_tags():
    """A `>` in quotes, a quote that is never closed, an end that is never opened, nesting without end."""
    prose = "Some running text, with marks, that goes on. And on it goes, for a while."
    assert tagpaths.main_text(f"<article><p title='a > b'>{prose}</p></i></article>") == prose
    assert tagpaths.main_text(f'<article><p title="x>{prose}</p><p>Next, and more of it, here.</p></article>') == prose + "\n\nNext, and more of it, here."
    deep = "<div>" * 3000 + f"<p>{prose}</p>" + "</div>" * 3000
    assert tagpaths.main_text(f"<body><article>{deep}<p>After, and more of it, here.</p></article></body>") == prose + "\n\nAfter, and more of it, here."
    assert tagpaths.main_text("<body><article></article><div><p>Not the article, but prose, with marks.</p></div></body>") == ""


def test_pages_edges(spark):
    rows = [(1, "u", "<p>One, two.</p>"), (1, "u", "<p>One, two.</p>"), (None, None, None), (2, "v", "<p>" + "word, " * 100_000)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("text", F.lit("clash")).withColumn("n_chars", F.lit("clash"))
    got = sorted((str(r.page_id), r.text, r.n_chars) for r in tagpaths.extract(df).collect())
    assert [g[2] for g in got] == [9, 9, 599_999, 0] and got[0] == got[1] and tagpaths.extract(df).columns == ["page_id", "url", "text", "n_chars"]
    assert tagpaths.extract(df.limit(0)).collect() == []


def test_pages_query(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = queries.op6_tag_path_text(spark, SF).collect()
    assert len(rows) == len(pages)
    import html

    for r in rows:
        inner = re.search(r"<article>(.*?)(</article>|<footer|\Z)", pages[r.page_id], re.S)[1]
        want = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", " " if "<br" in b else "", b))).strip() for b in re.split(r"<p>|</p>|</?h1>", inner)]
        assert r.text == "\n\n".join(w for w in want if w) and r.n_chars == len(r.text)
    odd = spark.createDataFrame([(1, "u", None), (None, None, "<p>x</p>"), (2, "u", "")], "page_id bigint, url string, html string")
    assert sorted(r.text for r in tagpaths.extract(odd).collect()) == ["", "", "x"]


# ---- nearest neighbours


def brute_nearest(rows, every=100, k=10):
    out = {}
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], dtype=float)
    for i, v in rows:
        if i % every == 0:
            d = np.sqrt(((x - np.array(v)) ** 2).sum(1))
            order = [j for j in np.lexsort((ids, d)) if ids[j] != i][:k]
            out[i] = [(int(ids[j]), float(d[j])) for j in order]
    return out


def test_nearest_recall(spark):
    d = "/root/testdata/sf0.1"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{d}/embeddings.parquet").collect()]
    want, got = brute_nearest(rows), defaultdict(list)
    for r in queries.op7_additive_nearest(spark, d).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    hits = 0
    for q, best in want.items():
        g = sorted(got[q])
        assert [x[0] for x in g] == list(range(1, len(best) + 1)) and [x[2] for x in g] == sorted(x[2] for x in g)
        hits += len({x[1] for x in g} & {b[0] for b in best})
        near = dict(best)
        assert all(abs(near[x[1]] - x[2]) < 1e-12 for x in g if x[1] in near)
    assert hits / sum(map(len, want.values())) >= 0.97


def test_nearest_recall_at_each_size():
    """Lists, codes and estimates alone, without Spark: the quantiser decides at 500 rows as it does at 50,000, all queries counted. A part of the
    vectors stands about centres, the others all over the sphere."""
    rng = np.random.default_rng(4)
    for n, rerank, least in ((500, 40, 0.9), (50_000, additive.RERANK, 0.9)):
        x = rng.normal(size=(n, 64))
        centres = rng.normal(size=(max(5, n // 150), 64))
        x[: n // 3] = centres[rng.integers(len(centres), size=n // 3)] + 0.15 * x[: n // 3]
        x, ids = (x / np.linalg.norm(x, axis=1, keepdims=True))[rng.permutation(n)], np.arange(n)
        index = additive.build(x[:: max(1, len(x) // additive.SAMPLE)])
        lists, codes, norms = (np.concatenate(p) for p in zip(*(index.encode(x[i : i + 1000]) for i in range(0, len(x), 1000))))
        sums = index.centroids[lists] + sum(b[codes[:, k]] for k, b in enumerate(index.books))
        asked = np.flatnonzero(ids % 100 == 0)
        read = index.lists(x[asked], max(2, index.probes))[:, : index.probes]
        hits = 0
        for q, few in zip(asked, read):
            exact = ((x - x[q]) ** 2).sum(1)
            exact[q] = np.inf
            estimate = np.where(np.isin(lists, few) & (ids != ids[q]), norms - 2 * sums @ x[q], np.inf)
            hits += len(set(np.argsort(exact)[:10]) & set(additive.best_of(np.arange(len(x)), estimate, rerank)))
        assert hits / (10 * len(asked)) >= least and rerank < len(x) / 10


def test_nearest_copies_and_hot_ids(spark):
    """Many copies of one vector just beyond the true neighbours, and one vec_id with very many vectors, take no place from them."""
    r = np.random.default_rng(3)
    rows = [(i, (r.normal(size=8) * 3).tolist()) for i in range(1, 400)]
    hub = [5.0] * 8
    rows += [(1000, hub)] + [(2000 + i, (np.array(hub) + r.normal(size=8) * 0.3).tolist()) for i in range(12)]
    rows += [(5000 + i, [5.9] * 8) for i in range(1500)] + [(7001, (np.array(hub) + 1.1 + r.normal(size=8) * 0.01).tolist()) for _ in range(500)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumn("list", F.lit("clash")).withColumn("code", F.lit("clash")).withColumn("query_id", F.lit("clash"))
    got, want = defaultdict(list), brute_nearest([(i, np.float32(v).tolist()) for i, v in rows])
    for x in additive.nearest(df, rerank=40).collect():
        got[x.query_id].append((x.rank, x.vec_id))
    assert [v for _, v in sorted(got[1000])] == [v for v, _ in want[1000]]
    assert [v for _, v in sorted(got[5000])] == list(range(5001, 5011))
    assert {q: len(set(v)) for q, v in got.items()} == {q: 10 for q in want}


def test_nearest_edges(spark, monkeypatch):
    monkeypatch.setattr(additive, "CODE_BLOCK", 7)
    monkeypatch.setattr(additive, "QUERY_BLOCK", 2)
    r = np.random.default_rng(0)
    rows = [(i, r.normal(size=4).tolist()) for i in range(30)] + [(100, [1.0] * 4), (200, [1.0] * 4), (101, [1.0] * 4), (102, [1.0] * 4), (101, [1.0] * 4)]
    bad = [(103, None), (104, [0.0] * 4), (105, [1.0, None, 1.0, 1.0]), (106, [float("nan")] * 4), (107, [float("inf"), 1.0, 1.0, 1.0]), (300, []), (None, [1.0] * 4), (108, [1.0] * 3)]
    df = spark.createDataFrame(rows + bad, "vec_id bigint, embedding array<float>")
    want = brute_nearest([(i, np.float32(v).tolist()) for i, v in dict(rows).items()])
    got = defaultdict(list)
    for x in additive.nearest(df).collect():
        got[x.query_id].append((x.rank, x.vec_id, x.score))
    assert {q: [v for _, v, _ in sorted(g)] for q, g in got.items()} == {q: [v for v, _ in b] for q, b in want.items()}
    assert additive.nearest(df.limit(0)).count() == 0


@pytest.mark.parametrize("rows", ["tight", "offset", "scales", "corner"])
def test_nearest_of_other_rows(spark, rows):
    """Clusters tighter than any code, far from the origin, norms of many scales, queries where no other rows are: all ten are found."""
    r, n = np.random.default_rng(6), 6000
    x = r.normal(size=(n, 16))
    if rows in ("tight", "offset"):
        x = r.normal(size=(6, 16))[r.integers(6, size=n)] + 1e-4 * x + (1000 if rows == "offset" else 0)
    if rows == "scales":
        x *= np.exp(6 * r.normal(size=(n, 1)))
    if rows == "corner":
        x[::100] = 9 + 1e-3 * x[::100]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    got = defaultdict(list)
    for row in additive.nearest(df).orderBy("query_id", "rank").collect():
        got[row.query_id].append(row.vec_id)
    for q in range(0, n, 100):
        d = ((x - x[q]) ** 2).sum(1)
        d[q] = np.inf
        assert got[q] == np.argsort(d, kind="stable")[:10].tolist()
