"""Operator 11: personal data by boosted trees over candidate spans.

High-recall generators propose spans of four kinds (email, ip, card, phone), which may overlap: everything of the plain
formats and looser forms (`name [at] host dot org`, `1[.]2[.]3[.]4`, IPv6, cards in odd groups, numbers without a country
code). Format and context of a candidate become numbers (`FEATURES`), gradient-boosted trees score them, isotonic regression on
documents kept from learning calibrates the scores, and for each kind the least score whose calibrated precision is `precision` at
least selects redactions: best first, none over another one. Spans of the plain formats (`base_spans`) always stay.

Nobody labels the corpus. It labels itself: base spans are positive; candidates that meet no base span are negative. So that the
trees judge more than the plain formats, each positive is also rewritten in place, in its own context, to the looser
forms, and broken (a check digit, an octet, a part missing) as a negative. A kind without positives gets no further spans.

The trees are fitted on at most `max_docs` documents by hash of id (about; a table of more rows is thinned to it) and at
most `max_rows` candidates of them, a documented bound; finding reads every whole text in one narrow stage. All scans are linear in
the text: plain formats are matched from their rarest sign or from the beginning of a run.

Odd cases. A null or empty text has no spans. Offsets are code points, ends exclusive. Repeated rows give equal rows; a
null doc_id stays null. Without any base span in the sample nothing is added. An empty table gives an empty table. Other columns, whatever
their names, are left out.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, map_columns, releasing

KINDS = ("email", "ip", "card", "phone")
MAX_DOCS = 20_000
MAX_ROWS = 40_000
AROUND = 48
Span = tuple[int, int, int]  # kind, start, end

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_HOST = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")  # a match begins at the beginning of a run of digits
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")


def luhn(digits: str) -> bool:
    return sum(int(d) if k % 2 == 0 else sum(divmod(2 * int(d), 10)) for k, d in enumerate(reversed(digits))) % 10 == 0


def _emails(text: str):
    done, at = 0, text.find("@")
    while at >= 0:
        host = _HOST.match(text, at)
        if host:
            start = at
            while start > done and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                yield start, host.end()
                done = host.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[Span]:
    """Spans of the plain formats, by start and kind."""
    found = [(0, s, e) for s, e in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            found.append((1, *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() <= 37:  # 19 digits and 18 signs between them
            digits = "".join(_DIGIT.findall(m.group()))
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((2, *m.span()))
    for m in _PHONE.finditer(text):
        if 9 <= len(_DIGIT.findall(m.group())) <= 15:
            found.append((3, *m.span()))
    return sorted(found, key=lambda x: (x[1], x[0]))


_AT = re.compile(r"\s?(?:@|[\[({]\s?at\s?[\])}])\s?|\sat\s(?=[\w.-]{1,64}\s?(?:\sdot\s|[\[({]))", re.I)
_NAME = re.compile(r"[^\s@<>()\[\]{}\"',;:|/]{1,64}\Z")
_REST = re.compile(r"[\w-]{1,64}(?:(?:\.|\s?[\[({]\s?dot\s?[\])}]\s?|\sdot\s)[\w-]{1,24}){0,5}", re.I)
_LOOSE = (
    (1, re.compile(r"(?<![0-9A-Za-z.])[0-9]{1,4}(?:\s?[\[({]?\.[\])}]?\s?[0-9]{1,4}){3}(?![0-9A-Za-z])")),
    (1, re.compile(r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){2,7}(?:[0-9A-Fa-f]{1,4}|:(?:[0-9A-Fa-f]{1,4}:){0,5}[0-9A-Fa-f]{1,4})(?![0-9A-Za-z:])")),
    (2, re.compile(r"(?<![0-9A-Za-z])[0-9](?:[\x20.\-_/]{0,2}[0-9]){11,18}(?![0-9A-Za-z])")),
    (3, re.compile(r"(?<![0-9A-Za-z])(?:\+|00)?[0-9]{0,3}[\x20.-]?\(?[0-9]{2,4}\)?(?:[\x20./-]{1,2}[0-9]{2,4}){1,4}(?![0-9A-Za-z])")),
    (3, re.compile(r"(?<![0-9A-Za-z])\([0-9]{2,4}\)[\x20.-]?[0-9]{3,4}[\x20.-]?[0-9]{3,5}(?![0-9A-Za-z])")),
)


def candidates(text: str) -> list[Span]:
    """Proposed spans: base spans and looser ones; they overlap."""
    found = set(base_spans(text))
    for m in _AT.finditer(text):
        name = _NAME.search(text[max(0, m.start() - 64) : m.start()])
        rest = _REST.match(text, m.end())
        if name and rest:
            found.add((0, m.start() - len(name.group()), rest.end()))
    for kind, pattern in _LOOSE:
        for m in pattern.finditer(text):
            start = m.start() + len(m.group()) - len(m.group().lstrip())
            found.add((kind, start, m.end()))
    return sorted(found, key=lambda x: (x[1], x[0], x[2]))


# Words before a span that speak for a kind, in the order of KINDS, and for none.
CUES = (
    ("mail", "email", "e-mail", "contact", "write"),
    ("ip", "host", "server", "address", "addr", "ping"),
    ("card", "visa", "mastercard", "credit", "debit", "payment", "pan"),
    ("phone", "tel", "telephone", "call", "mobile", "fax", "cell"),
    ("order", "invoice", "version", "id", "no", "isbn", "date", "ref", "page", "section"),
)
FEATURES = ["email", "ip", "card", "phone", "length", "digits", "letters", "digit_share", "groups", "least_group", "largest_group", "first_group", "separators", "brackets", "plus", "luhn", "octets", "dots", "colons", "hex_letters", "at_sign", "at_word", "labels", "last_label", "left", "right", "cue_email", "cue_ip", "cue_card", "cue_phone", "cue_none", "digits_around"]
_WORD = re.compile(r"[A-Za-z-]+")


def _side(c: str) -> int:
    return 0 if not c or c.isspace() else 1 if c.isalpha() else 2 if c.isdigit() else 3


def describe(kind: int, before: str, span: str, after: str) -> list[float]:
    """The numbers of one candidate; before and after are up to AROUND code points of its surroundings."""
    groups = re.findall("[0-9]+", span)
    digits, letters = sum(map(len, groups)), sum(c.isalpha() for c in span)
    sizes = [len(g) for g in groups] or [0]
    labels = re.findall(r"[\w-]+", re.split(r"@|\bat\b", span, maxsplit=1, flags=re.I)[-1])
    words = [w.lower() for w in _WORD.findall(before)[-4:]]
    near = before[-24:] + after[:24]
    return [
        *(float(kind == k) for k in range(4)), len(span), digits, letters, digits / max(len(span), 1), len(groups), min(sizes), max(sizes), sizes[0],
        len({c for c in span if not c.isalnum()}), sum(c in "()[]{}" for c in span), span.count("+"), float(12 <= digits <= 19 and luhn("".join(groups))),
        sum(len(g) <= 3 and int(g) <= 255 for g in groups) - 10 * (len(groups) != 4), span.count("."), span.count(":"), sum(c in "abcdefABCDEF" for c in span),
        span.count("@"), float(bool(re.search(r"\bat\b", span, re.I))), len(labels), len(labels[-1]) if labels else 0, _side(before[-1:]), _side(after[:1]),
        *(float(any(w in cue for w in words)) for cue in CUES), sum(c.isdigit() for c in near) / max(len(near), 1),
    ]


def _rewritten(kind: int, span: str, salt: int) -> tuple[list[str], list[str]]:
    """Looser forms of a positive span, and broken ones."""
    d = "".join(_DIGIT.findall(span))
    if kind == 0:
        name, host = span.rsplit("@", 1)
        words = host.split(".")
        good = [f"{name} [at] {' [dot] '.join(words)}", f"{name}(at){'(dot)'.join(words)}", f"{name} at {' dot '.join(words)}", f"{name} @ {host}", f"{name} [at] {host}"]
        return good, [f"{name}@{words[0]}", f"{name} @ {words[0]}", f"{name} at {words[0]} dot"]
    if kind == 1:
        parts = span.split(".")
        v6 = hashlib.sha256(f"{span}{salt}".encode()).hexdigest()
        good = ["[.]".join(parts), "(.)".join(parts), " . ".join(parts), ":".join(v6[k : k + 4] for k in range(0, 32, 4)), f"2001:db8::{v6[:4]}:{v6[4:8]}"]
        wrong = ".".join([str(256 + int(v6[:3], 16) % 700), *parts[1:]])
        return good, [wrong, wrong.replace(".", "[.]"), ".".join(str(1000 + int(v6[k : k + 3], 16)) for k in range(0, 12, 3)), f"{salt % 24:02}:{salt % 60:02}:{salt % 59:02}", ":".join(v6[k : k + 2] for k in range(0, 12, 2))]
    if kind == 2:
        four = [d[k : k + 4] for k in range(0, len(d), 4)]
        at = salt % len(d)
        bad = d[:at] + str((int(d[at]) + 1 + salt % 8) % 10) + d[at + 1 :]
        bad_four = [bad[k : k + 4] for k in range(0, len(bad), 4)]
        good = [".".join(four), "_".join(four), "/".join(four), "  ".join(four), " - ".join(four)[: len(d) + 6 * len(four)].replace(" - ", "- ")]
        return good, [] if luhn(bad) else [bad, ".".join(bad_four), "_".join(bad_four), " ".join(bad_four), "  ".join(bad_four)]
    local = d[-10:]
    good = [f"({local[:3]}) {local[3:6]}-{local[6:]}", f"{local[:3]}-{local[3:6]}-{local[6:]}", f"{local[:3]}.{local[3:6]}.{local[6:]}", f"00{d[:-10]} {local[:3]} {local[3:6]} {local[6:]}"]
    return good, [f"{1900 + salt % 130}-{salt % 12 + 1:02}-{salt % 28 + 1:02}", f"{salt % 28 + 1:02}.{salt % 12 + 1:02}.{1900 + salt % 130}", f"{local[:3]} {local[3:6]}", f"{local[:2]}-{local[2:4]}"]


def examples(text: str) -> list[tuple[int, list[float]]]:
    """(label, numbers) of a text's candidates, rewritten and broken forms included."""
    base = base_spans(text)
    if not base and not any(c in text for c in "0123456789@"):
        return []
    out, plain = [], set(base)
    for c in candidates(text):
        kind, s, e = c
        before, after = text[max(0, s - AROUND) : s], text[e : e + AROUND]
        if c in plain:
            salt = int.from_bytes(hashlib.sha256(text[s:e].encode("utf-8", "surrogatepass")).digest()[:4], "big")
            good, bad = _rewritten(kind, text[s:e], salt)
            out += [(1, describe(kind, before, x, after)) for x in (text[s:e], *good)] + [(0, describe(kind, before, x, after)) for x in bad]
        elif not any(s < y and x < e for _, x, y in base):
            out.append((0, describe(kind, before, text[s:e], after)))
    return out


@dataclass
class Trees:
    """Gradient-boosted trees of fixed depth over binned features; calibration by isotonic steps; a threshold a kind."""

    edges: list[np.ndarray]
    splits: np.ndarray  # (trees, inner nodes, 2): feature, bin
    leaves: np.ndarray  # (trees, leaves)
    base: float
    steps: tuple[np.ndarray, np.ndarray]
    thresholds: np.ndarray

    def raw(self, x: np.ndarray) -> np.ndarray:
        b = binned(x, self.edges)
        z, rows, inner = np.full(len(x), self.base), np.arange(len(x)), self.splits.shape[1]
        for split, leaf in zip(self.splits, self.leaves):
            node = np.zeros(len(x), np.int64)
            while len(node) and node[0] < inner:
                node = 2 * node + 1 + (b[rows, split[node, 0]] > split[node, 1])
            z += leaf[node - inner]
        return z

    def probability(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(x), *self.steps) if len(self.steps[0]) else np.zeros(len(x))


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1)


def _isotonic(score: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: (score, share of positives), both rising; each block counts one negative and one positive more."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []
    for s, y in zip(score[order], label[order]):
        blocks.append([y, 1.0, s, s])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            y2, n2, _, hi = blocks.pop()
            blocks[-1] = [blocks[-1][0] + y2, blocks[-1][1] + n2, blocks[-1][2], hi]
    at, share = [], []
    for y, n, lo, hi in blocks:
        at += [lo, hi]
        share += [y / n] * 2
    return np.array(at), np.array(share)


def fit(x: np.ndarray, y: np.ndarray, held: np.ndarray, precision: float = 0.97, trees: int = 60, depth: int = 3, rate: float = 0.25) -> Trees:
    """held: rows that calibrate and set thresholds instead of being learnt from."""
    d, inner = len(FEATURES), 2**depth - 1
    nothing = Trees([np.zeros(0)] * d, np.zeros((0, inner, 2), np.int64), np.zeros((0, 2**depth)), 0.0, (np.zeros(0), np.zeros(0)), np.full(len(KINDS), 2.0))
    learn = ~held
    if y[learn].sum() in (0, learn.sum()):
        return nothing
    edges = [np.unique(np.quantile(x[learn, j], np.arange(1, 32) / 32, method="lower")) for j in range(d)]
    b, t, bins = binned(x[learn], edges), y[learn], 33
    base = float(np.log(t.mean() / (1 - t.mean())))
    z = np.full(len(t), base)
    splits, leaves = np.zeros((trees, inner, 2), np.int64), np.zeros((trees, inner + 1))
    for k in range(trees):
        p = 1 / (1 + np.exp(-z))
        g, h = t - p, p * (1 - p)
        node = np.zeros(len(t), np.int64)
        for level in range(depth):
            first, n = 2**level - 1, 2**level
            best = np.full(n, 1e-9)
            splits[k, first : first + n, 1] = bins  # everything to the left
            for j in range(d):
                cell = (node - first) * bins + b[:, j]
                sg, sh = (np.bincount(cell, w, n * bins).reshape(n, bins) for w in (g, h))
                cg, ch = sg.cumsum(1), sh.cumsum(1)
                tg, th = cg[:, -1:], ch[:, -1:]
                gain = np.where((ch > 0.5) & (th - ch > 0.5), cg**2 / (ch + 1) + (tg - cg) ** 2 / (th - ch + 1) - tg**2 / (th + 1), 0)
                top = gain.argmax(1)
                better = gain[np.arange(n), top] > best
                best[better] = gain[np.arange(n), top][better]
                splits[k, first + np.flatnonzero(better)] = np.stack([np.full(better.sum(), j), top[better]], 1)
            node = 2 * node + 1 + (b[np.arange(len(t)), splits[k, node, 0]] > splits[k, node, 1])
        leaf = node - inner
        leaves[k] = rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + 1)
        z += leaves[k][leaf]
    model = Trees(edges, splits, leaves, base, (np.zeros(0), np.zeros(0)), np.full(len(KINDS), 2.0))
    judge = held if y[held].sum() > 0 else learn  # a handful of documents: no positive was kept from learning
    model.steps = _isotonic(model.raw(x[judge]), y[judge])
    p = model.probability(x[judge])
    for kind in range(len(KINDS)):
        mine = x[judge][:, kind] == 1
        pk, yk = p[mine], y[judge][mine]
        for cut in np.unique(pk)[::-1]:
            got = yk[pk >= cut]
            if len(got) >= 5 and got.mean() >= precision:
                model.thresholds[kind] = max(cut, 0.8)
    return model


_EXAMPLE = pa.schema([("text_key", pa.int64()), ("label", pa.int32()), ("x", pa.binary())])


def train(docs: DataFrame, max_docs: int = MAX_DOCS, max_rows: int = MAX_ROWS) -> Trees:
    """Documents are taken by hash of id where the table has more than max_docs rows, so a sample is the same in every run; texts stay in their tasks and
    only the numbers of max_rows candidates at most, those with the smallest hash, reach the driver."""
    n = docs.count()
    share = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1_000_000)) < int(1_000_000 * max_docs / max(n, 1)) if n > max_docs else F.lit(True)

    def run(cols: dict) -> dict:
        out: dict[str, list] = {"text_key": [], "label": [], "x": []}
        for t in cols["text"]:
            key = int.from_bytes(hashlib.sha256((t or "").encode("utf-8", "surrogatepass")).digest()[:7], "big")
            for label, x in examples(t or ""):
                for name, v in zip(out, (key, label, np.array(x).tobytes())):
                    out[name].append(v)
        return out

    rows = map_columns(docs.where(share).select("text"), run, _EXAMPLE).distinct()
    got = rows.orderBy(F.xxhash64("text_key", "x", "label"), "text_key", "x", "label").limit(max_rows).toPandas()
    x = np.array([np.frombuffer(v) for v in got["x"]]).reshape(-1, len(FEATURES))
    return fit(x, got["label"].to_numpy(dtype=float), got["text_key"].to_numpy(dtype=np.int64) % 4 == 0)


def select(text: str, model: Trees) -> tuple[list[Span], list[Span]]:
    """(base spans, added spans); no added span meets another span."""
    base = base_spans(text)
    loose = [c for c in candidates(text) if not any(c[1] < e and s < c[2] for _, s, e in base)] if any(t <= 1 for t in model.thresholds) else []
    if not loose:
        return base, []
    p = model.probability(np.array([describe(k, text[max(0, s - AROUND) : s], text[s:e], text[e : e + AROUND]) for k, s, e in loose]))
    taken: list[Span] = []
    for i in sorted(range(len(loose)), key=lambda i: (-p[i], loose[i][1], -loose[i][2], loose[i][0])):
        k, s, e = loose[i]
        if p[i] >= model.thresholds[k] and not any(s < y and x < e for _, x, y in taken):
            taken.append(loose[i])
    return base, sorted(taken, key=lambda c: (c[1], c[0]))


def find(docs: DataFrame, model: Trees | None = None) -> DataFrame:
    """doc_id, base and added: arrays of (kind, start, end)."""
    model = model or train(docs)
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
    schema = pa.schema([("doc_id", pa.int64()), ("base", pa.list_(span)), ("added", pa.list_(span))])

    def run(batches):
        for b in batches:
            got = [select(t or "", model) for t in b.column(1).to_pylist()]
            cols = [[[{"kind": KINDS[k], "start": s, "end": e} for k, s, e in g[side]] for g in got] for side in (0, 1)]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, f.type) for c, f in zip(cols, list(schema)[1:]))], schema=schema)

    kind = "array<struct<kind:string,start:bigint,end:bigint>>"
    return bounded(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")).mapInArrow(releasing(run), f"doc_id bigint, base {kind}, added {kind}")


def redact(docs: DataFrame, model: Trees | None = None, sign: str = "[{}]") -> DataFrame:
    """doc_id, text: whole texts with `[kind]` in place of every span; of spans that overlap, the later ones go with the first."""
    model = model or train(docs)

    def run(cols: dict) -> dict:
        out = []
        for t in cols["text"]:
            parts, done = [], 0
            for k, s, e in sorted(sum(select(t or "", model), []), key=lambda c: (c[1], c[0])):
                if s >= done:
                    parts += [t[done:s], sign.format(KINDS[k])]
                done = max(done, e)
            out.append(None if t is None else "".join(parts) + t[done:])
        return {"doc_id": cols["doc_id"], "text": out}

    return map_columns(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), run, pa.schema([("doc_id", pa.int64()), ("text", pa.string())]))


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (all) from found spans."""
    order = F.array(*(F.lit(k) for k in KINDS))
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.transform(c, lambda s: F.struct(s["start"], F.array_position(order, s["kind"]).alias("k"), s["end"]))), lambda s: F.concat_ws(":", F.element_at(order, s["k"].cast("int")), s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return found.select("doc_id", *(count(k) for k in KINDS), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.concat("base", "added")).alias("spans"))
