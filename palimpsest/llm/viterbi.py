"""Operator 4: token counts of a unigram tokenizer by count-only Viterbi.

An Aho-Corasick automaton over the vocabulary enumerates all pieces that end at each
character; dynamic programming keeps, for each position, the best score and the number
of pieces on the best path, never the path. Ties follow the tokenizer: a path replaces
another only if its score is strictly higher, and starts are tried from left to right,
so of equal paths the one whose last piece starts first stays. A character that no
one-character piece covers can be an unknown piece (lowest score - 10) and then
counts as its UTF-8 bytes.

The vocabulary comes from a SentencePiece file. Files of the BPE kind hold ranks instead of
log probabilities; `unigram_vocabulary` turns the rank r of a piece into -ln(r + 2) by Zipf's law,
rounded to 1/64 so that sums are exact in any order (and in 32-bit floats up to a
score of 262,144). Nothing is trained.

White space becomes U+2581 and no piece of the vocabulary holds that sign behind another
character (checked when it is loaded), so best paths part at words, and a word's count and score
come from a worker's table after the first time.

A null or empty text has no tokens; a null id stays null; repeated rows are counted as they come. A long text costs time in proportion and a
long word no memory beside it (scores are kept for as many characters as the longest piece has). An empty table gives an
empty table; other columns, whatever their names, are left out. One narrow stage without a shuffle.
"""

from __future__ import annotations

import math
import re
import struct

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_columns, text_bytes

SPACE = "▁"
UNIT = 64  # scores are whole multiples of 1 / UNIT
CACHE = 1_000_000


def _fields(data: bytes):
    """(field number, value) of a protocol-buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        key = number()
        kind = key & 7
        if kind == 0:
            yield key >> 3, number()
        elif kind in (1, 5):
            n = 8 if kind == 1 else 4
            yield key >> 3, data[at : at + n]
            at += n
        else:
            n = number()
            yield key >> 3, data[at : at + n]
            at += n


def model_pieces(path: str) -> list[tuple[str, float, int]]:
    """(piece, score, type) in the order of ids; type 1 is an ordinary piece."""
    out = []
    with open(path, "rb") as f:
        data = f.read()
    for number, value in _fields(data):
        if number == 1:
            got = dict(_fields(value))
            out.append((got.get(1, b"").decode(), struct.unpack("<f", got[2])[0] if 2 in got else 0.0, got.get(3, 1)))
    return out


def unigram_vocabulary(path: str) -> dict[str, int]:
    """Ordinary pieces with their score in units of 1/UNIT."""
    plain = [p for p, _, kind in model_pieces(path) if kind == 1]
    return {p: -round(UNIT * math.log(r + 2)) for r, p in enumerate(plain)}


class Counter:
    """count(text) -> (pieces, score in units). normalise: dummy prefix and spaces as in the tokenizer's file."""

    def __init__(self, vocabulary: dict[str, int], penalty: int = 10 * UNIT):
        import ahocorasick

        if any(SPACE in p.lstrip(SPACE) for p in vocabulary):
            raise ValueError("a piece holds white space behind another character; texts can't be parted at words")
        self.automaton = ahocorasick.Automaton()
        for p, s in vocabulary.items():
            self.automaton.add_word(p, (len(p), s))
        self.automaton.make_automaton()
        self.single = {p for p in vocabulary if len(p) == 1}
        self.reach = max(map(len, vocabulary), default=1) + 1
        self.unknown = min(vocabulary.values(), default=0) - penalty
        self.table: dict[str, tuple[int, int]] = {}

    def best(self, chunk: str) -> tuple[int, int]:
        """Viterbi over a chunk: pieces of the best path and its score."""
        reach = self.reach  # position p has its score at p % reach
        score, count = [0] * reach, [0] * reach
        found = self.automaton.iter(chunk)
        coming = next(found, None)
        for end, sign in enumerate(chunk):
            best, pieces, here = None, 0, []
            while coming and coming[0] == end:
                here.append(coming[1])
                coming = next(found, None)
            for size, s in sorted(here, reverse=True):  # longest first: the leftmost start first
                v = score[(end + 1 - size) % reach] + s
                if best is None or v > best:
                    best, pieces = v, count[(end + 1 - size) % reach] + 1
            if sign not in self.single:
                v = score[end % reach] + self.unknown
                if best is None or v > best:
                    best, pieces = v, count[end % reach] + len(sign.encode("utf-8", "surrogatepass"))
            score[(end + 1) % reach], count[(end + 1) % reach] = best, pieces
        return count[len(chunk) % reach], score[len(chunk) % reach]

    def __call__(self, text: str) -> tuple[int, int]:
        if not text:
            return 0, 0
        table, pieces, score = self.table, 0, 0
        words = text.split(" ")
        if "" in words or SPACE in text:
            chunks = re.findall(f"{SPACE}*[^{SPACE}]+|{SPACE}+$", SPACE + text.replace(" ", SPACE))
        else:
            chunks = [SPACE + w for w in words]
        for c in chunks:
            got = table.get(c)
            if got is None:
                if len(table) >= CACHE:
                    table.clear()
                got = self.best(c)
                if len(c) <= 64:
                    table[c] = got
            pieces += got[0]
            score += got[1]
        return pieces, score


_COUNTERS: dict[str, Counter] = {}
_COUNTED = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_chars", pa.int64()), ("n_tokens", pa.int64()), ("score", pa.float64())])


def count_tokens(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_bytes, n_chars, n_tokens, score of each whole text."""

    def run(cols: dict) -> dict:
        counter = _COUNTERS.get(model_path) or _COUNTERS.setdefault(model_path, Counter(unigram_vocabulary(model_path)))
        got = [counter(t or "") for t in cols["text"]]
        return {"doc_id": cols["doc_id"], "n_bytes": [len(text_bytes(t)) for t in cols["text"]], "n_chars": [len(t or "") for t in cols["text"]], "n_tokens": [g[0] for g in got], "score": [g[1] / UNIT for g in got]}

    return map_columns(docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), docs["text"]), run, _COUNTED)
