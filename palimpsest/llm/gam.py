"""Operator 3: a generalised additive model with pairwise interactions as quality classifier.

Texts become a few numbers (`features`); each number is binned at quantiles.
Training goes round the features again and again: each step grows a shallow
tree on one feature's bins against the current residual and adds a small part
of it to that feature's lookup table. Then the pairs of features with the largest
residual gain get two-dimensional tables in the same way. A score is the
logistic of a sum of table entries, computed with array look-ups.

The model is fitted on at most `max_rows` labelled rows, those with the smallest hash
of doc_id (a documented bound: a classifier of a few thousand parameters gains
nothing from more); scoring covers all rows in one narrow stage.

A null text is an empty text and gets a score. Labels that are null are not learnt
from. Without any label of both kinds the score is the constant share of label 1
(0.5 without labels). Repeated rows get equal scores (and count as often as they are labelled); a document that is labelled twice is learnt
twice; a null id is no label's and is not held out. Long texts are read whole. An empty table gives an empty table. Other columns,
whatever their names, are left out by quality and stay as they are in score_documents, but for one named as the score.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded, map_columns, releasing, text_bytes

MAX_ROWS = 20_000
BINS = 32
PAIR_BINS = 8
FEATURES = ["log_bytes", "log_words", "word_length", "upper", "digit", "space", "marks", "symbols", "bars", "non_ascii", "distinct_words", "top_word", "distinct_lines", "line_words", "sentence_ends", "long_words", "capital_words", "url_marks"]

_CLASS = np.zeros((9, 256))
for _k, _set in enumerate(("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\n\r\v\f", "!?", "*#$%&~^=+_<>@\\{}[]", "|", None, ".", "/:")):
    if _set is None:
        _CLASS[_k, 128:] = 1
    else:
        _CLASS[_k, [ord(c) for c in _set]] = 1


def features(texts: list[str | None]) -> np.ndarray:
    """One row of len(FEATURES) finite numbers for each text, from the whole text."""
    out = np.zeros((len(texts), len(FEATURES)))
    hist = np.zeros((len(texts), 256))
    for i, t in enumerate(texts):
        raw = text_bytes(t)
        hist[i] = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
        words, lines = raw.split(), raw.split(b"\n")
        n = len(words)
        if n:
            seen: dict[bytes, int] = {}
            for w in words:
                seen[w] = seen.get(w, 0) + 1
            starts = sum(1 for w in words if 65 <= w[0] <= 90)
            out[i, [1, 2, 10, 11, 15, 16]] = np.log1p(n), (len(raw) - raw.count(b" ")) / n, len(seen) / n, max(seen.values()) / n, sum(1 for w in words if len(w) > 24) / n, starts / n
        out[i, 12] = len(set(lines)) / len(lines)
        out[i, 13] = np.log1p(n / len(lines))
    total = hist.sum(1)
    share = (hist @ _CLASS.T) / np.maximum(total, 1)[:, None]
    out[:, 0] = np.log1p(total)
    out[:, [3, 4, 5, 6, 7, 8, 9, 14, 17]] = share
    return out


@dataclass
class Gam:
    base: float
    edges: list[np.ndarray]
    tables: np.ndarray  # (features, BINS)
    pairs: list[tuple[int, int]]
    pair_edges: list[np.ndarray]
    pair_tables: np.ndarray  # (pairs, PAIR_BINS, PAIR_BINS)

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.base)
        for j, e in enumerate(self.edges):
            z += self.tables[j][np.searchsorted(e, x[:, j], side="right")]
        if self.pairs:
            coarse = np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.pair_edges)], 1)
            for k, (a, b) in enumerate(self.pairs):
                z += self.pair_tables[k][coarse[:, a], coarse[:, b]]
        return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def _edges(column: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(column, np.arange(1, bins) / bins)) if len(column) else np.zeros(0)


def _shallow(g: np.ndarray, h: np.ndarray, leaves: int, least: float) -> np.ndarray:
    """Values by bin of a regression tree with up to `leaves` leaves over ordered bins (sums of gradient g and weight h)."""
    cg, ch = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    spans = [(0, len(g))]
    while len(spans) < leaves:
        best = (1e-12, None, None)
        for k, (a, b) in enumerate(spans):
            c = np.arange(a + 1, b)
            lg, lh = cg[c] - cg[a], ch[c] - ch[a]
            rg, rh = cg[b] - cg[c], ch[b] - ch[c]
            gain = np.where((lh >= least) & (rh >= least), lg**2 / (lh + 1) + rg**2 / (rh + 1) - (cg[b] - cg[a]) ** 2 / (ch[b] - ch[a] + 1), 0)
            if len(gain) and gain.max() > best[0]:
                best = (gain.max(), k, int(c[gain.argmax()]))
        if best[1] is None:
            break
        a, b = spans.pop(best[1])
        spans += [(a, best[2]), (best[2], b)]
    out = np.zeros(len(g))
    for a, b in spans:
        out[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + 1)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Values by cell of the tree with one cut on either axis, the same on both sides, that has the largest gain."""
    cg, ch = np.zeros((len(g) + 1, len(g) + 1)), np.zeros((len(g) + 1, len(g) + 1))
    cg[1:, 1:], ch[1:, 1:] = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    parts = [(c[:-1, :-1], c[:-1, -1:] - c[:-1, :-1], c[-1:, :-1] - c[:-1, :-1], c[-1, -1] - c[:-1, -1:] - c[-1:, :-1] + c[:-1, :-1]) for c in (cg, ch)]
    gain = sum(a * a / (b + 1) for a, b in zip(*parts))
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    out = np.zeros_like(g)
    for (rows, cols), a, b in zip(((slice(0, i), slice(0, j)), (slice(0, i), slice(j, None)), (slice(i, None), slice(0, j)), (slice(i, None), slice(j, None))), *parts):
        out[rows, cols] = a[i, j] / (b[i, j] + 1)
    return out


def fit(x: np.ndarray, y: np.ndarray, cycles: int = 150, pair_cycles: int = 60, n_pairs: int = 8, rate: float = 0.1) -> Gam:
    n, d = x.shape
    edges = [_edges(x[:, j], BINS) for j in range(d)]
    pair_edges = [_edges(x[:, j], PAIR_BINS) for j in range(d)]
    tables, share = np.zeros((d, BINS)), (y.mean() if n else 0.5)
    base = float(np.log(np.clip(share, 1e-4, 1 - 1e-4) / np.clip(1 - share, 1e-4, 1)))
    if n == 0 or share in (0, 1):
        return Gam(base, edges, tables, [], pair_edges, np.zeros((0, PAIR_BINS, PAIR_BINS)))
    bins = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(edges)]
    coarse = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(pair_edges)]
    z, least = np.full(n, base), max(1.0, 0.0005 * n)
    p = lambda: 1 / (1 + np.exp(-z))
    for _ in range(cycles):
        for j in range(d):
            q = p()
            step = rate * _shallow(np.bincount(bins[j], y - q, BINS), np.bincount(bins[j], q * (1 - q), BINS), 4, least * 0.05)
            tables[j] += step
            z += step[bins[j]]
    q = p()
    gain = {}
    for a in range(d):
        for b in range(a + 1, d):
            cell = coarse[a] * PAIR_BINS + coarse[b]
            g, h = np.bincount(cell, y - q, PAIR_BINS**2), np.bincount(cell, q * (1 - q), PAIR_BINS**2)
            gain[a, b] = float((g**2 / (h + 1)).sum())
    pairs = sorted(gain, key=lambda k: (-gain[k], k))[:n_pairs]
    pair_tables = np.zeros((len(pairs), PAIR_BINS, PAIR_BINS))
    for _ in range(pair_cycles):
        for k, (a, b) in enumerate(pairs):
            q = p()
            cell = coarse[a] * PAIR_BINS + coarse[b]
            g = np.bincount(cell, y - q, PAIR_BINS**2).reshape(PAIR_BINS, PAIR_BINS)
            h = np.bincount(cell, q * (1 - q), PAIR_BINS**2).reshape(PAIR_BINS, PAIR_BINS)
            step = _quadrants(g, h)
            pair_tables[k] += rate * step
            z += rate * step[coarse[a], coarse[b]]
    return Gam(base, edges, tables, pairs, pair_edges, pair_tables)


def held_out(doc_id):
    """Column: the row is kept from learning."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = MAX_ROWS) -> Gam:
    """The labelled sample is chosen by id first, so that only its texts are read into features. Its ids (max_rows at
    most) are the only rows that are broadcast; only its features reach the driver."""
    rows = (
        labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .select(F.col("doc_id").cast("bigint").alias("label_id"), F.col(label).cast("int").alias("label"))
        .orderBy(F.xxhash64("label_id"), "label_id").limit(max_rows)
    )
    schema = pa.schema([("label", pa.int32()), ("x", pa.binary())])
    chosen = docs.select("doc_id", "text").join(F.broadcast(rows), F.col("doc_id") == F.col("label_id")).select("label", "text")
    got = map_columns(chosen, lambda c: {"label": c["label"], "x": [v.tobytes() for v in features(c["text"])]}, schema).toPandas()
    order = np.lexsort((got["x"].to_numpy(), got["label"].to_numpy())) if len(got) else []
    x = np.array([np.frombuffer(got["x"].iloc[i]) for i in order]).reshape(-1, len(FEATURES))
    return fit(x, np.array([got["label"].iloc[i] for i in order], dtype=float))


def score_documents(docs: DataFrame, model: Gam, name: str = "score") -> DataFrame:
    """Adds a column of scores in 0 .. 1 to all columns of docs; a column that has its name already is replaced."""
    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                part = b.slice(at, 2000)
                s = model.score(features(part.column(part.schema.get_field_index("text")).to_pylist()))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(s, pa.float64())], names=[*part.schema.names, name])

    kept = docs.drop(name)
    kind = T.StructType([*kept.schema.fields, T.StructField(name, T.DoubleType())])
    return bounded(kept).mapInArrow(releasing(run), kind)


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    scored = score_documents(docs.select("doc_id", "text"), train(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
