"""Operators 1, 2, 3, 4, 8 and 10 against brute force, round trips, libraries and held-out accuracy."""

import hashlib
import math
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import gam, mixing, ogg, packing, perplexity, queries, viterbi

SF = "/root/testdata/sf0.001"
EDGE = [(1, "a b c d e f", "s1"), (2, None, "s1"), (3, "", None), (4, "x " * 5000, "s2"), (4, "x " * 5000, "s2"), (5, "héllo wörld\nzwei", "s2"), (6, "   ", "s3"), (None, "no id", "s1")]
DOCS = "doc_id bigint, text string, source string"


def frame(spark, rows=EDGE, schema=DOCS):
    return spark.createDataFrame(rows, schema).withColumn("score", F.lit("clash")).withColumn("size", F.lit(7)).withColumn("label", F.lit(1))


def plain_crc(data):
    crc = 0
    for b in data:
        crc ^= b << 24
        for _ in range(8):
            crc = ((crc << 1) ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
    return crc


def test_ogg_round_trip_and_damage():
    assert ogg.page_crc(b"OggS some page") == plain_crc(b"OggS some page")
    for n in (64, 640, 5000 * 2, 64 * 3000, 255 * 255 * 4):
        data = bytes(np.random.default_rng(n).integers(0, 256, n, dtype=np.uint8))
        media = ogg.write_ogg(data)
        back, info = ogg.read_samples(media)
        assert back == data and not info["faults"] and info["streams"] == 2
    hurt = bytearray(media)
    hurt[len(media) // 2] ^= 1
    assert any("bad page" in f for f in ogg.read_ogg(bytes(hurt))[1])
    assert ogg.read_ogg(b"") == ({}, []) and ogg.read_ogg(b"junk")[1]


def test_ogg_timestamps_span_pages():
    streams, _ = ogg.read_ogg(ogg.write_ogg(bytes(200_000), rate=1000))
    s = streams[1]
    body = ogg.Stream(1, s.packets[1:], s.granules[1:])
    assert ogg.packet_times(body, 1000) == [i * 5.0 for i in range(20)] and s.ended and s.pages > 2


def test_ogg_query_edges(spark):
    rows = ogg.store_texts(frame(spark)).collect()
    assert len(rows) == len(EDGE)
    for r, (i, t, _) in zip(rows, EDGE):
        raw = (t or "").encode()
        pay = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert (r.doc_id, r.n_bytes, r.payload_bytes) == (i, len(raw), len(pay))
        assert r.payload_sha256 == hashlib.sha256(pay).hexdigest() and r.tail_crc32 == zlib.crc32(pay[-64:])
        assert r.media_sha256 == hashlib.sha256(bytes(r.media)).hexdigest() and r.media_bytes == len(r.media)
    got = ogg.probe(spark.createDataFrame([(1, bytes(rows[0].media)), (2, None), (3, b""), (4, b"x")], "id bigint, media binary")).groupBy("id").agg(F.first("status").alias("s")).collect()
    assert {r.id: r.s for r in got} == {1: "ok", 2: "null", 3: "empty", 4: "damaged"}
    assert ogg.store_texts(frame(spark).limit(0)).count() == 0


def test_nnls_solves():
    rng = np.random.default_rng(0)
    a = rng.random((12, 30))
    x0 = np.maximum(rng.normal(size=30), 0)
    x = packing.nnls(a, a @ x0)
    assert (x >= 0).all() and np.abs(a @ x - a @ x0).max() < 1e-6
    b = rng.normal(size=12)
    g = a.T @ (b - a @ packing.nnls(a, b))
    assert g.max() < 1e-6


@pytest.mark.parametrize("n", [0, 1, 7, 400])
def test_pack_keeps_each_token_once(n):
    lengths = np.random.default_rng(n).integers(1, 9000, n)
    seen = defaultdict(list)
    for seq in packing.pack(lengths):
        total = sum(p[2] for p in seq)
        assert total == 4096 or (total < 4096 and total & (total - 1) == 0)
        for i, s, m in seq:
            seen[i].append((s, m))
    for i, size in enumerate(lengths):
        at = 0
        for s, m in sorted(seen[i]):
            assert s == at and m > 0
            at += m
        assert at == size


def test_packing_query_matches_tokenizer(spark):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()] + ["İstanbul  ΣΑΣ x\x85y\x1cz", "é ́a", "don't I'LL 'S ''s", "a\tb\r\nc  d"]
    got = packing.Ids(path)(texts)
    for t, g in zip(texts, got):
        assert np.frombuffer(g, "<u4").tolist() == [*tok.encode(t, add_special_tokens=False).ids, 2]
    rows = packing.pack_documents(frame(spark), path).collect()
    by_seq = defaultdict(list)
    for r in rows:
        by_seq[r.sequence_id].append(r)
        assert r.ids_crc32 == zlib.crc32(bytes(r.ids)) and len(r.ids) == 4 * r.length
    for v in by_seq.values():
        v.sort(key=lambda r: r.offset)
        assert [r.offset for r in v] == np.cumsum([0] + [r.length for r in v])[:-1].tolist()
    tokens = Counter()
    for r in rows:
        tokens[r.doc_id] += r.length
    assert tokens[2] == tokens[3] == 1 and tokens[4] == 2 * 5001


def test_packing_compares_chunks(spark, monkeypatch):
    """Hashes of 6 bits, which nearly all chunks share, change no id; nor does a table that holds next to nothing."""
    path = queries.tokenizer_path("word_bpe_49k.json")
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want, plain = packing.Ids(path)(texts), packing._chunk_hash
    monkeypatch.setattr(packing, "CACHE", 50)
    ids = packing.Ids(path)
    assert [i for at in range(0, len(texts), 20) for i in ids(texts[at : at + 20])] == want
    monkeypatch.setattr(packing, "_chunk_hash", lambda *a: plain(*a) & np.uint64(63))
    ids = packing.Ids(path)
    assert [i for at in range(0, len(texts), 20) for i in ids(texts[at : at + 20])] == want
    one = packing.Ids(path)
    assert [one([w])[0] for w in ("alpha", "beta", "gamma", "alpha", "delta" * 9, "beta")] == [packing.Ids(path)([w])[0] for w in ("alpha", "beta", "gamma", "alpha", "delta" * 9, "beta")]


def test_packing_edges(spark):
    path = queries.tokenizer_path("word_bpe_49k.json")
    long = "some words, again and again " * 40_000
    docs = spark.createDataFrame([(1, long), (1, long), (None, "x"), (2, None)], "doc_id bigint, text string").withColumn("ids", F.lit("clash")).withColumn("length", F.lit("clash"))
    rows = packing.pack_documents(docs, path).collect()
    n = {r.doc_id: r.doc_tokens for r in rows}
    assert sum(r.length for r in rows if r.doc_id == 1) == 2 * n[1] and n[2] == 1 and n[None] == 2
    assert packing.pack_documents(docs.limit(0), path).collect() == []


def test_gam_learns_an_interaction():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(4000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    m = gam.fit(x[:3000], y[:3000], n_pairs=2)
    assert (0, 1) in m.pairs and ((m.score(x[3000:]) > 0.5) == (y[3000:] > 0.5)).mean() > 0.9
    assert gam.fit(x[:0], y[:0]).score(x[:2]).tolist() == [0.5, 0.5] and gam.fit(x[:9], np.ones(9)).score(x[:1])[0] > 0.99


def test_gam_query_held_out(spark):
    got = queries.op3_gam_quality(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").toPandas()
    held = got[got.held_out]
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got.doc_id]).all()
    assert (held.predicted == held.quality).mean() > 0.93 and got.score.between(0, 1).all()


def test_gam_edges(spark):
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    odd = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (9, None), (None, 1)], "doc_id bigint, quality int")
    for labels in (none, odd):
        rows = gam.quality(frame(spark), labels).collect()
        assert len(rows) == len(EDGE) and all(0 <= r.score <= 1 for r in rows)
    assert gam.quality(frame(spark).limit(0), odd).count() == 0
    scored = gam.score_documents(frame(spark), gam.train(frame(spark), odd))
    assert scored.columns.count("score") == 1


def unigram_proto(path, vocab):
    """The tokenizer's file as a unigram model with our scores (test only)."""
    def num(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    def msg(f, body):
        return num(f << 3 | 2) + num(len(body)) + body

    out = b""
    for f, v in viterbi._fields(open(path, "rb").read()):
        if f == 1:
            got = dict(viterbi._fields(v))
            piece, kind = got.get(1, b""), got.get(3, 1)
            s = vocab[piece.decode()] / viterbi.UNIT if kind == 1 else 0.0
            out += msg(1, msg(1, piece) + num(2 << 3 | 5) + struct.pack("<f", s) + num(3 << 3) + num(kind))
        elif f == 2:
            body = b""
            for g, w in viterbi._fields(v):
                if g == 3:
                    w = 1
                body += num(g << 3) + num(w) if isinstance(w, int) else (num(g << 3 | 5) + w if len(w) == 4 and g in (10, 11, 15) else msg(g, w))
            out += msg(2, body)
        else:
            out += msg(f, v)
    return out


def test_viterbi_brute_force():
    vocab = {"▁": -3, "a": -2, "b": -2, "ab": -4, "▁a": -5, "ba": -3, "bab": -6}
    c = viterbi.Counter(vocab, penalty=10)

    def paths(s):
        if not s:
            yield 0, 0
        for k in range(1, len(s) + 1):
            if s[:k] in vocab:
                for v, n in paths(s[k:]):
                    yield v + vocab[s[:k]], n + 1
    for s in ("▁abab", "▁bbaab", "▁a", "▁"):
        assert c.best(s)[1] == max(v for v, _ in paths(s))
    assert c("") == (0, 0) and c(None) == (0, 0) and c.best("▁€")[0] == 4


def test_viterbi_equals_the_library(spark):
    import sentencepiece

    path = queries.tokenizer_path("piece_bpe_32k.model")
    vocab = viterbi.unigram_vocabulary(path)
    sp = sentencepiece.SentencePieceProcessor(model_proto=unigram_proto(path, vocab))
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()] + ["", "a  b   c ", " lead", "tab\there", "日本語 € \U0001f600x", "a" * 300]
    c = viterbi.Counter(vocab)
    bad = [t[:40] for t in texts if len(sp.encode(t)) != c(t)[0]]
    assert not bad, bad[:3]
    assert [r.n_tokens for r in viterbi.count_tokens(frame(spark), path).where("doc_id in (2, 3)").collect()] == [0, 0]


def test_edges_of_narrow_operators(spark):
    """Nulls, repeated rows, long texts without a space, empty tables and names that clash for operators 1, 3 and 4."""
    path = queries.tokenizer_path("piece_bpe_32k.model")
    long = "y" * 400_000
    docs = spark.createDataFrame([(1, long), (1, long), (None, "x"), (2, None)], "doc_id bigint, text string")
    for name in ("n_bytes", "score", "media", "predicted", "label_id", "x", "n_tokens"):
        docs = docs.withColumn(name, F.lit("clash"))
    stored = ogg.store_texts(docs).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.payload_bytes) for r in stored) == [("1", 400_000, 400_000), ("1", 400_000, 400_000), ("2", 0, 64), ("None", 1, 64)]
    counted = viterbi.count_tokens(docs, path).collect()
    assert sorted((str(r.doc_id), r.n_chars) for r in counted) == [("1", 400_000), ("1", 400_000), ("2", 0), ("None", 1)]
    assert len({r.n_tokens for r in counted if r.doc_id == 1}) == 1
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1)], "doc_id bigint, quality int").withColumn("text", F.lit("clash"))
    scored = gam.quality(docs, labels).collect()
    assert len(scored) == 4 and all(0 <= r.score <= 1 for r in scored) and not any(r.held_out for r in scored if r.doc_id is None)
    model = gam.train(docs, labels)
    kept = gam.score_documents(docs, model, "score_")
    assert kept.columns == [*docs.columns, "score_"] and {r.score for r in kept.collect()} == {"clash"}
    for out in (ogg.store_texts(docs.limit(0)), viterbi.count_tokens(docs.limit(0), path), gam.quality(docs.limit(0), labels), gam.quality(docs.limit(0), labels.limit(0))):
        assert out.collect() == []


def test_viterbi_long_words():
    """Words longer than any piece, at every length: the window of scores changes nothing."""
    counter = viterbi.Counter({"a": -3, "ab": -4, "bab": -9, "b": -5, "abba": -6})
    rng = np.random.default_rng(0)
    for n in range(1, 60):
        word = "".join(rng.choice(list("abc"), n))
        score, count = [0] + [None] * n, [0] * (n + 1)
        for end in range(1, n + 1):
            options = [(score[end - len(p)] + s, count[end - len(p)] + 1, end - len(p)) for p, s in (("a", -3), ("ab", -4), ("bab", -9), ("b", -5), ("abba", -6)) if word[:end].endswith(p)]
            options += [(score[end - 1] + counter.unknown, count[end - 1] + 1, end - 1)] if word[end - 1] == "c" else []
            score[end], count[end], _ = max(options, key=lambda o: (o[0], -o[2]))
        assert counter.best(word) == (count[n], score[n])


def test_mix_targets_brute_force(spark):
    rng = np.random.default_rng(3)
    sizes = {f"s{i}": int(v) for i, v in enumerate(rng.integers(0, 400, 11))} | {None: 50, "": 3000}
    rows = spark.createDataFrame([(i, s, n) for i, (s, n) in enumerate(sizes.items())], "doc_id bigint, source string, size bigint")
    names = sorted((s for s in sizes if s is not None)) + [None]
    w = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, capped, goal = sum(sizes.values()), set(), {}
    while True:
        free = [s for s in names if s not in capped]
        rest = total - sum(3 * sizes[s] for s in capped)
        goal = {s: 3 * sizes[s] if s in capped else rest * w[s] / sum(w[f] for f in free) for s in names}
        over = {s for s in free if goal[s] > 3 * sizes[s]}
        if not over:
            break
        capped |= over
    got = {r.source: r.target for r in mixing.targets(rows).collect()}
    assert all(math.isclose(got[s], goal[s], rel_tol=1e-9, abs_tol=1e-9) for s in names)


def test_pivot_keeps_words_and_expectation():
    rng, mean = np.random.default_rng(5), np.zeros(6)
    p, size = [0.3, 0.8, 0.5, 0.1, 0.9, 0.4], [10, 3, 7, 30, 5, 12]
    for _ in range(4000):
        out, left, f = mixing.pivot(p, size, rng.random(6).tolist())
        words = sum(o * s for k, (o, s) in enumerate(zip(out, size)) if k != left) + (f * size[left] if left is not None else 0)
        assert math.isclose(words, sum(a * b for a, b in zip(p, size)), rel_tol=1e-9)
        mean += [f if k == left else o for k, o in enumerate(out)]
    assert np.abs(mean / 4000 - p).max() < 0.04


def test_mix_query(spark, monkeypatch):
    monkeypatch.setattr(mixing, "GROUP", 5)
    monkeypatch.setattr(mixing, "FAN_IN", 3)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    a, b = mixing.mix(docs).toPandas(), mixing.mix(docs.repartition(5)).toPandas()
    key = lambda d: d.sort_values(list(d.columns)).reset_index(drop=True)
    assert key(a).equals(key(b)) and (a.taken <= 3 * a["size"]).all() and len(a) == docs.count()
    a["source"] = a.doc_id.map(dict(docs.select("doc_id", "source").collect()))
    for _, g in a.groupby("source"):
        assert abs(g.taken.sum() - g.target.iloc[0]) <= g["size"].max()
    assert mixing.mixed_documents(docs).count() == int((a.taken[a["size"] > 0] / a["size"][a["size"] > 0]).sum())
    edge = mixing.mix(frame(spark)).collect()
    assert len(edge) == len(EDGE) and mixing.mix(frame(spark).limit(0)).count() == 0
    assert set(mixing.mixed_documents(frame(spark)).columns) == set(frame(spark).columns)


def test_mix_keeps_large_ids_beside_nulls(spark):
    rows = [(2**53 + k, "one two three " * (k % 4), "a") for k in range(1, 40)] + [(None, "four five", "a"), (-(2**62) - 1, "six", "b"), (None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = mixing.mix(docs).collect()
    assert sorted((r.doc_id for r in got if r.doc_id is not None)) == sorted(r[0] for r in rows if r[0] is not None) and len(got) == len(rows)
    assert {r.doc_id for r in mixing.mixed_documents(docs).collect()} <= {r[0] for r in rows}


def test_mix_repeated_rows_and_rows_without_an_id(spark, monkeypatch):
    """Two thirds of the rows are one row or have no id: no group of the first level holds more than a few times GROUP."""
    monkeypatch.setattr(mixing, "GROUP", 10)
    rows = [(7, "a b c", "s")] * 400 + [(None, f"w {i} " * (i % 7 + 1), "s") for i in range(400)] + [(100 + i, "x y " * (i % 5 + 1), "t" if i % 3 else None) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumn("mark", F.lit("clash")).withColumn("n", F.lit(5)).withColumn("total", F.lit(1)).withColumn("row", F.lit(2))
    plain = mixing._round

    def counted(seed, last):
        run = plain(seed, last)

        def group(g):
            assert int(g["n"].to_numpy().sum()) <= 80, "a hot group"
            return run(g)

        return group

    monkeypatch.setattr(mixing, "_round", counted)
    key = lambda d: d.toPandas().sort_values(["doc_id", "size", "taken"]).reset_index(drop=True)
    one, two = key(mixing.mix(docs)), key(mixing.mix(docs.repartition(7)))
    assert one.equals(two) and len(one) == len(rows)
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns and out.count() == int((one.taken / one["size"]).sum())
    sizes = {s: sum(len(t.split()) for _, t, x in rows if x == s) for s in ("s", "t", None)}
    goal = {r.source_size: r.target for r in mixing.mix(docs).select("source_size", "target").distinct().collect()}
    for r in out.groupBy("source").agg(F.collect_list("text").alias("texts")).collect():
        assert abs(sum(len(t.split()) for t in r.texts) - goal[sizes[r.source]]) <= 14
    assert mixing.mixed_documents(docs.limit(0)).collect() == []


def test_cross_entropy_brute_force(spark):
    docs = spark.createDataFrame([(1, "a b a b"), (2, "c d c d"), (3, None), (4, "a b zz"), (4, "a b zz"), (None, "q")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1)], "doc_id bigint, quality int")
    rows = perplexity.cross_entropy_difference(docs, labels).collect()
    assert [r.n_tokens for r in rows] == [5, 5, 1, 4, 4, 2]
    vocab = {w for r in docs.collect() for w in (r.text or "").lower().split()}
    V = len(vocab) + 2

    def losses(t, texts, others):
        """Mean losses of t by the model of `texts` and by that of `others` scaled to the size of the first one."""
        out, n = [], sum(len(x.split()) + 1 for x in texts)
        m = sum(len(x.split()) + 1 for x in others)
        for part, scale in ((texts, 1), (others, n / max(m, 1))):
            uni, bi = Counter(), Counter()
            for x in part:
                ids = ["$", *x.split(), "$"]
                uni.update(ids[1:])
                bi.update(zip(ids, ids[1:]))
            ids, loss = ["$", *t.split(), "$"], 0
            for a, b in zip(ids, ids[1:]):
                floor = (uni[b] * scale + 1) / (sum(uni.values()) * scale + V)
                loss -= math.log(0.7 * (bi[a, b] / uni[a] if uni[a] else floor) + 0.3 * floor)
            out.append(loss / (len(ids) - 1))
        return out
    texts = [r.text or "" for r in docs.collect()]
    for k, (r, t) in enumerate(zip(rows, texts)):  # each row is held out
        target, background = losses(t, [x for i, x in enumerate(texts) if i == 0 and i != k], [x for i, x in enumerate(texts) if i != k])
        assert math.isclose(r.target_loss, target, rel_tol=1e-9) and math.isclose(r.background_loss, background, rel_tol=1e-9)
    assert perplexity.cross_entropy_difference(docs.limit(0), labels).count() == 0
    assert perplexity.cross_entropy_difference(docs, labels.limit(0)).count() == 6


def test_cross_entropy_ranks_what_is_near_the_target(spark):
    """Documents of the target's kind score lower than others, whether they are marked (and held out) or not."""
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(f"{'ab'[i % 2]}{k}" for k in rng.zipf(1.6, 60) % 50)) for i in range(120)]
    docs, labels = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame([(i, 1) for i in range(0, 60, 2)], "doc_id bigint, quality int")
    score = {r.doc_id: r.score for r in perplexity.cross_entropy_difference(docs, labels).collect()}
    assert max(score[i] for i in range(0, 120, 2)) < min(score[i] for i in range(1, 120, 2))


def test_cross_entropy_edges(spark):
    """Names that clash, a text without a space, repeated rows, and a document that occurs twice: its repetition is not held out."""
    docs = spark.createDataFrame([(1, "a b c"), (2, "a b c"), (3, "d e f"), (3, "d e f"), (4, "q" * 300_000), (5, "x y z"), (6, None)], "doc_id bigint, text string")
    docs = docs.withColumn("block", F.lit("clash")).withColumn("pos", F.lit("clash")).withColumn("kind", F.lit(2)).withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([(5, 1, "x")], "doc_id bigint, quality int, block string")
    rows = {r.doc_id: r for r in perplexity.cross_entropy_difference(docs, labels).collect()}
    assert len(rows) == 6 and rows[4].n_tokens == 2 and rows[6].n_tokens == 1
    assert rows[1].background_loss == rows[2].background_loss < rows[5].background_loss and rows[3].background_loss < rows[5].background_loss


def test_cross_entropy_counts_every_word_and_bigram(spark):
    """More distinct words than the former vocabulary of 50,000 held and as many bigrams as 2^20 slots can't part: each loss is exact."""
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{k}" for k in rng.integers(0, 90_000, 3000)) for _ in range(120)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(5)
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(120)], "doc_id bigint, quality int")
    size = len({w for t in texts for w in t.split()}) + 2
    assert size > 60_000

    def counts(chosen):
        uni, bi = Counter(), Counter()
        for t in chosen:
            ids = ["$", *t.split(), "$"]
            uni.update(ids[1:])
            bi.update(zip(ids, ids[1:]))
        return uni, bi, sum(uni.values())

    (ut, bt, n), (ub, bb, m) = counts(texts[::3]), counts(texts)
    block, perplexity.BLOCK = perplexity.BLOCK, 200_000  # several blocks and buckets
    try:
        rows = perplexity.cross_entropy_difference(docs, labels).collect()
    finally:
        perplexity.BLOCK = block
    assert sorted(r.doc_id for r in rows) == list(range(120))
    for r in rows:
        ids, sums, mine = ["$", *texts[r.doc_id].split(), "$"], [0, 0], r.doc_id % 3 == 0
        own, pairs, rest = Counter(ids[1:]), Counter(zip(ids, ids[1:])), n - 3001 * mine
        for a, b in zip(ids, ids[1:]):
            for k, (uni, bi, total, scale, off) in enumerate(((ut, bt, rest, 1, mine), (ub, bb, m - 3001, rest / (m - 3001), 1))):
                floor = ((uni[b] - off * own[b]) * scale + 1) / (total * scale + size)
                before = uni[a] - off * own[a]
                sums[k] -= math.log(0.7 * ((bi[a, b] - off * pairs[a, b]) / before if before else floor) + 0.3 * floor)
        assert math.isclose(r.target_loss, sums[0] / 3001, rel_tol=1e-9) and math.isclose(r.background_loss, sums[1] / 3001, rel_tol=1e-9)
