"""Operators 11 to 13 against brute force."""

import hashlib
import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest

from palimpsest.llm import alignment, candidates, interactions
from palimpsest.llm.queries import tokenizer_path

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, Mask int, digest string, kept int, added int, pair int, row int"


def docs_of(spark, rows, parts=3):
    """rows: (doc_id, text) or (doc_id, text, source); columns with clashing names beside."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", 0, 1, "x", 2, 3, 4, 5) for r in rows]
    return spark.createDataFrame(full, DOCS).repartition(parts)


# ---- 12


def brute_audit(rows, labels):
    """rows: (doc_id, text, source); labels: (doc_id, quality, toxic)."""
    blank = re.compile(r"[^\x20\x09-\x0D]+")
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    marks = []
    for d, text, source in rows:
        t = text or ""
        w = blank.findall(t)
        f = {k for k, bad in zip("ABCD", (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), bool(re.search(r"[#$%&*|]", t)))) if bad}
        if d is not None and any(x is not None and x < d and (y or "") == t for x, y, _ in rows):
            f.add("E")
        marks.append((source or "", f, d in good, d in toxic))
    out = []
    for part in {m[0] for m in marks}:
        mine, removed_by = [m for m in marks if m[0] == part], Counter()
        steps = []
        for order in itertools.permutations("ABCDE"):
            left = mine
            for k, f in enumerate(order):
                gone = [m for m in left if f in m[1]]
                left = [m for m in left if f not in m[1]]
                removed_by[f] += len(gone)
                failing = sum(f in m[1] for m in mine)
                steps.append((part, "".join(order), k + 1, len(left), len(gone), failing - len(gone), sum(m[1] == {f} for m in mine), sum(m[2] for m in gone), sum(m[3] for m in gone)))
        out += [(*s, removed_by[s[1][s[2] - 1]]) for s in steps]
    return sorted(out)


def test_interactions_by_brute_force(spark):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(400)] + ["BIG", "Ab", "x#y", "10%"]
    texts = [" ".join(rng.choices(words[: rng.choice([3, 60, 404])], k=rng.choice([0, 1, 50, 199, 200, 260]))) for _ in range(60)]
    texts += [None, "", " \t\n", "a\x0bb\x1cc", "A" * 3, "ü" * 500, "word " * 30_000, "Ä B"]
    rows = [(rng.choice([*range(70), 2**53 + 1, None]), rng.choice(texts), rng.choice(["a", "b", None, ""])) for _ in range(240)]
    rows += [(900 + k % 3, "the same text", "hot") for k in range(200)] + [(7, "twice", "a")] * 2
    labels = [(rng.choice([*range(70), None]), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(60)]
    marked = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    got = sorted(tuple(r) for r in interactions.filter_interactions(docs_of(spark, rows), marked).collect())
    assert got == brute_audit(rows, labels)


def test_interactions_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert interactions.filter_interactions(docs_of(spark, []), none).collect() == []
    got = interactions.filter_interactions(docs_of(spark, [(1, None, None)]), none).collect()
    assert len(got) == 600 and {r["part"] for r in got} == {""} and sum(r["removed"] for r in got) == 120


# ---- 13


def whole(path_a, path_b, text):
    """A's and B's ids with the end of each in bytes, by the libraries on the whole text; None where bytes change."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer, decoders

    a = Tokenizer.from_file(path_a)
    a.encode_special_tokens = True
    b = SentencePieceProcessor(model_file=path_b)
    if not text:
        return None
    raw, signs = (" " + text).encode(), alignment._byte_alphabet()
    ends, joined = [], []
    for ids, of in ((a.encode(" " + text, add_special_tokens=False).ids, lambda k: bytes(signs[c] for c in a.id_to_token(k))), (b.encode(text), lambda k: bytes([int(b.id_to_piece(k)[3:5], 16)]) if b.is_byte(k) else b.id_to_piece(k).replace("▁", " ").encode())):
        at, mine = 0, []
        for k in ids:
            at += len(of(k))
            mine.append((k, at))
        ends.append(mine)
        joined.append(b"".join(map(of, ids)))
    return ends if joined == [raw, raw] else None


ODD = [None, "", " ", "  ", "a", " a", "a ", "a  b", "a \n b\tc", "tab\tand\r\nlines \x0b x", "▁x y ▁", "x▁ y", "a ▁b", "日本語 テキスト です", "näive café ﬁ", "<|endoftext|> <s> </s> <unk>", "it's they'll  I'm", "12 345 6789 $ % ^", "\x00 nul", "🙂 🙂🙂 x", " nbsp  em", "'s 's", "word" * 50 + " " + "x" * 300]


@pytest.mark.parametrize("pairs, entries", [(2_000_000, 4_000_000), (7, 40)])
def test_alignment_by_brute_force(spark, monkeypatch, pairs, entries):
    monkeypatch.setattr(alignment, "PAIRS", pairs)
    monkeypatch.setattr(alignment, "ENTRIES", entries)
    paths = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")
    rng = random.Random(3)
    texts = ODD + ["".join(rng.choices("ab  \n\t.,'▁é1", k=rng.randrange(40))) for _ in range(60)] + ["the cat sat on the mat. " * 200]
    rows = [(k, t) for k, t in enumerate(texts)] + [(3, "a  b"), (3, "a  b"), (None, "the cat"), (2**53 + 1, "the cat")]
    found = {t: whole(*paths, t) for t in {t for _, t in rows}}
    counts, links = Counter(), {}
    for t, got in found.items():
        if got:
            by_end = {e: k for k, e in got[1]}
            links[t] = [(k, by_end[e]) for k, e in got[0] if e in by_end]
    for _, t in rows:
        counts.update(links.get(t, []))
    top = Counter()
    for (_, b), n in counts.items():
        top[b] = max(top[b], n)
    want = []
    for d, t in rows:
        if not found[t]:
            want.append((d, 0, 0, 0, 0, 0, 0, ""))
            continue
        cuts = sorted({e for _, e in found[t][0]} & {e for _, e in found[t][1]})
        groups = []
        for lo, hi in zip([0, *cuts], cuts):
            groups.append("|".join(",".join(str(k) for k, e in side if lo < e <= hi) for side in found[t]))
        mine = links[t]
        want.append((d, len(found[t][0]), len(found[t][1]), len(cuts), len(mine), sum(counts[x] == top[x[1]] for x in mine), sum(counts[x] for x in mine), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    got = alignment.cross_tokenizer(docs_of(spark, rows), *paths)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_alignment_keeps_groups_and_forgets_parts(spark, monkeypatch):
    paths = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")
    monkeypatch.setattr(alignment, "CACHE", 3)
    aligner = alignment.Aligner(*paths)
    first = aligner.align(["one two three four five six"])
    for k in range(5):
        aligner.align([f"other{k} words{k} here{k} again{k}"])
    assert aligner.align(["one two three four five six"]) == first
    got = alignment.align_documents(docs_of(spark, [(1, "The cat"), (2, None)]), *paths).orderBy("doc_id").collect()
    assert hashlib.sha256(got[0]["groups"].encode()).hexdigest() == got[0]["groups_sha256"] and got[1]["groups"] == ""
    assert alignment.cross_tokenizer(docs_of(spark, []), *paths).collect() == []


def test_bits():
    rng = np.random.default_rng(1)
    flags = rng.random(1000) < 0.3
    bits = alignment.Bits.of(np.flatnonzero(flags), 1000)
    at = np.arange(1000)
    assert bits.select().tolist() == np.flatnonzero(flags).tolist() and bits.rank(at).tolist() == np.cumsum(flags).tolist()


# ---- 11


def plain_base(text):
    """The contract's patterns as they stand."""
    out = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub(r"\D", "", m.group())
        total = sum(int(c) if k % 2 == 0 else (2 * int(c) - 9 if int(c) > 4 else 2 * int(c)) for k, c in enumerate(reversed(d)))
        if 12 <= len(d) <= 19 and total % 10 == 0:
            out.append((2, *m.span()))
    out += [(3, *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub(r"\D", "", m.group())) <= 15]
    return sorted(out, key=lambda x: (x[1], x[0]))


def test_base_spans_are_the_patterns():
    rng = random.Random(11)
    for _ in range(6000):
        t = "".join(rng.choices("ab.@-+ 0123456789()é", k=rng.randrange(60)))
        assert candidates.base_spans(t) == plain_base(t), t
    for t in ("a@b@c.d", "x@y.z@w.v", "1.2.3.4.5.6.7.8", "0001.1.1.1", "1.2.3.256", "4111 1111 1111 1111", "4111-1111--1111-1111", "+1 (377) 555-0271.", "++12 345 678 901", "٣.1.2.3.4"):
        assert candidates.base_spans(t) == plain_base(t), t


def test_scans_are_linear():
    for t in ("a" * 400_000, "1" * 400_000, "1." * 200_000, "a@" * 200_000, "+1 " * 130_000, "1 " * 200_000, "(" * 400_000, "ab:" * 130_000, "x at y dot " * 30_000):
        candidates.base_spans(t), candidates.candidates(t)


def corpus(n):
    """Documents that hold personal data in plain formats, and others without."""
    rng = random.Random(2)
    prose = "the report says that many people came to the town and nobody left before the evening".split()

    def card():
        d = "4" + "".join(rng.choices("0123456789", k=14))
        return next(d + c for c in "0123456789" if candidates.luhn(d + c))

    out = []
    for k in range(n):
        w = rng.choices(prose, k=60)
        if k % 3 == 0:
            w[20] = f"{rng.choice(prose)}.{rng.randrange(99)}@mail{k % 7}.example.org"
            w[30] = ".".join(str(rng.randrange(256)) for _ in range(4))
            w[40] = card()
            w[50] = f"+1 ({rng.randrange(100, 999)}) 555-{rng.randrange(1000, 9999)}"
        elif k % 3 == 1:
            w[10], w[25], w[35] = str(rng.randrange(10**6)), f"{rng.randrange(1990, 2030)}-0{rng.randrange(1, 9)}-1{rng.randrange(9)}", f"{rng.randrange(24):02}:{rng.randrange(60)}"
        out.append((k, " ".join(w)))
    return out


def test_candidates_found_and_clean_text_left_alone(spark):
    rows = corpus(600)
    model = candidates.train(docs_of(spark, rows))
    assert all(t <= 1 for t in model.thresholds)
    prose = "nobody left before the evening and "
    hidden = ["jane.doe [at] mail3.example [dot] org", "10[.]20[.]30[.]40", "4111.1111.1111.1111", "(377) 555-0271"]
    found = 0
    for kind, h in enumerate(hidden):
        base, added = candidates.select(prose + h + " the report says", model)
        assert base == []
        found += added == [(kind, len(prose), len(prose) + len(h))]
    assert found >= 3
    clean = [t for k, t in corpus(600) if k % 3] + [prose + x + " many people" for x in ("4111.1111.1111.1112", "12:30", "300[.]20[.]30[.]999", "meet at noon", "3.14159", "chapter 12 page 144")]
    assert sum(bool(candidates.select(t, model)[1]) for t in clean) <= len(clean) // 200
    got = {r["doc_id"]: r for r in candidates.digest(candidates.find(docs_of(spark, [*rows, (None, None), (7, ""), (7, "")]), model)).collect() if r["doc_id"] is not None}
    for d, t in rows:
        if d != 7:
            base = plain_base(t)
            text = ",".join(f"{candidates.KINDS[k]}:{s}:{e}" for k, s, e in base)
            assert got[d]["base_sha256"] == hashlib.sha256(text.encode()).hexdigest() and set(text.split(",")) <= set(got[d]["spans"].split(","))
            assert [got[d][f"n_{k}"] for k in candidates.KINDS] == [sum(b[0] == i for b in base) for i in range(4)]
    redacted = {r["doc_id"]: r["text"] for r in candidates.redact(docs_of(spark, rows), model).collect()}
    assert "[email]" in redacted[0] and not any(plain_base(t) for t in redacted.values()) and redacted[1] == rows[1][1]


def test_candidates_of_nothing(spark):
    assert candidates.digest(candidates.find(docs_of(spark, []))).collect() == []
    got = candidates.digest(candidates.find(docs_of(spark, [(1, None), (None, "call 555 1234")]))).collect()
    assert len(got) == 2 and all(r["spans"] == "" and r["base_sha256"] == hashlib.sha256(b"").hexdigest() for r in got)
