"""Operator 2: packing token sequences by non-negative least squares.

Documents are tokenised and cut: full windows leave at once, the tails (shorter
than a window) are packed. A block of tails gives a histogram over length
classes; the shallow combinations of classes that fill a window form the
columns of a matrix; NNLS gives repeat counts for them against the histogram;
the counts are rounded down and filled with tails. A combination counts lengths
rounded down, so its tails overrun the window by less than `depth` classes: the
last one is cut at the window's end. Tails that are left, and what was cut off,
are packed greedily; the end of a block is cut at powers of two. So no
sequence is padded at all.

One narrow stage without a shuffle: a block lies inside one task and holds at
most BLOCK tokens besides its last document. A null text is empty (it still has
its end token); repeated rows and rows with an equal id are packed as often as they occur; a document
without an id keeps null; a long text is cut at the windows' ends as often as needed, and held whole while it is
tokenised. An empty table gives no pieces. Other columns, whatever their names, are left out.
"""

from __future__ import annotations

import itertools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import bounded, ddl, releasing, same_bytes
from .minhash import _BYTE, _powers, mix

WINDOW = 4096
CLASS = 64
DEPTH = 3
BLOCK = 4_000_000
END = 2
CACHE = 500_000  # chunks in a worker's table
WORDS = 250_000  # and words


def combinations(classes: int, depth: int) -> np.ndarray:
    """Rows: how many tails of each class (1 .. classes-1, in units of CLASS) fill a window of `classes` units."""
    found = []
    for d in range(2, depth + 1):
        for head in itertools.combinations_with_replacement(range(1, classes), d - 1):
            rest = classes - sum(head)
            if rest >= head[-1]:
                found.append(np.bincount([*head, rest], minlength=classes + 1)[:classes])
    return np.array(found, dtype=np.float64)


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Active-set solution of min |a x - b| with x >= 0."""
    x, active = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    tol = 1e-9 * max(1.0, float(np.abs(b).max(initial=0)))
    for _ in range(rounds):
        grad = a.T @ (b - a @ x)
        grad[active] = -np.inf
        j = int(np.argmax(grad))
        if grad[j] <= tol:
            break
        active[j] = True
        while True:
            s = np.zeros_like(x)
            s[active] = np.linalg.lstsq(a[:, active], b, rcond=None)[0]
            bad = active & (s <= tol)
            if not bad.any():
                x = s
                break
            step = np.min(x[bad] / np.maximum(x[bad] - s[bad], 1e-300))
            x = x + step * (s - x)
            gone = active & (x <= tol)
            if not gone.any():
                gone = bad
            active &= ~gone
            x[~active] = 0
            if not active.any():
                break
    return x


_TABLE: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}


def plan(histogram: np.ndarray, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """Combinations and whole repeat counts that the histogram (by class) can supply."""
    key = (len(histogram), depth)
    if key not in _TABLE:
        _TABLE[key] = combinations(*key)
    combos = _TABLE[key]
    counts = np.floor(nnls(combos.T, histogram.astype(np.float64)) + 1e-6).astype(np.int64)
    order, left = np.argsort(-counts, kind="stable"), histogram.astype(np.int64).copy()
    for j in order:
        if counts[j]:
            need = combos[j].astype(np.int64)
            counts[j] = min(counts[j], int(np.min(left[need > 0] // need[need > 0])))
            left -= counts[j] * need
    return combos.astype(np.int64), counts


def pack(lengths: np.ndarray, window: int = WINDOW, unit: int = CLASS, depth: int = DEPTH) -> list[list[tuple[int, int, int]]]:
    """Sequences of (item, start, length); every token of every item is in exactly one piece."""
    out: list[list[tuple[int, int, int]]] = []
    tails: list[tuple[int, int, int]] = []
    for i, n in enumerate(lengths):
        full = int(n) // window
        out += [[(i, k * window, window)] for k in range(full)]
        if n % window:
            tails.append((i, full * window, int(n) % window))
    by_class: list[list[tuple[int, int, int]]] = [[] for _ in range(window // unit)]
    for t in tails:
        by_class[t[2] // unit].append(t)
    combos, counts = plan(np.array([0] + [len(c) for c in by_class[1:]]), depth)
    rest: list[tuple[int, int, int]] = []
    for j in np.flatnonzero(counts):
        kinds = np.repeat(np.arange(len(by_class)), combos[j])
        for _ in range(counts[j]):
            seq, room = [], window
            for c in kinds[::-1]:
                i, s, n = by_class[c].pop()
                take = min(n, room)
                seq.append((i, s, take))
                room -= take
                if n > take:
                    rest.append((i, s + take, n - take))
            out.append(seq)
    rest += [t for c in by_class for t in c]
    rest.sort(key=lambda t: (-t[2], t[0], t[1]))
    seq, room, left = [], window, sum(t[2] for t in rest)
    goal = window if left >= window else 1 << max(left.bit_length() - 1, 0)
    room = goal
    for i, s, n in rest:
        while n:
            take = min(n, room)
            seq.append((i, s, take))
            s, n, room, left = s + take, n - take, room - take, left - take
            if not room:
                out.append(seq)
                seq, room = [], window if left >= window else 1 << max(left.bit_length() - 1, 0)
    return out


class Ids:
    """Token ids of whole texts, as the tokenizer file gives them. White space that every file of this kind drops
    (space, new line) bounds chunks; chunks are looked up by a 64-bit hash in sorted arrays, all of a batch at once, and their bytes are
    compared with those that the entry was made of (a batch in which a hash says too much is looked up by its strings). New ones
    part into words, which have a table; new words are encoded many at once. What can't be parted here is encoded by the
    tokenizer with a parting word that is one token (a chunk that holds this word is encoded by itself)."""

    def __init__(self, path: str, end: int = END):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.words, self.end = Tokenizer.from_file(path), {}, np.array([end], "<u4").tobytes()
        self.hashes, self.at, self.sizes, self.pool = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, "<u4")
        self.text_at, self.text_sizes, self.text = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(8, np.uint8)  # the chunks themselves, and 8 bytes more
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)  # tokens that end a word
        self.ends[[i for w, i in vocab.items() if w.endswith("</w>")]] = True
        self.bare = Tokenizer(self.tokenizer.model)  # the same model for words that are parted and lower-cased already
        self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        single = (w for w, i in sorted(vocab.items(), key=lambda x: -x[1]) if w.isascii() and w.endswith("</w>") and len(w) == 7 and w[:-4].isalpha())
        self.mark, self.mark_id = next((w[:-4], self.tokenizer.token_to_id(w)) for w in single if self.tokenizer.encode(w[:-4], add_special_tokens=False).ids == [self.tokenizer.token_to_id(w)])

    def _encode(self, part: list[str]) -> list[bytes]:
        ids = np.array(self.tokenizer.encode(f" {self.mark} ".join(part), add_special_tokens=False).ids, "<u4")
        cuts = np.flatnonzero(ids == self.mark_id)
        if len(cuts) != len(part) - 1:
            raise ValueError("a chunk made the parting token")
        raw = ids.tobytes()
        return [raw[a:b] for a, b in zip([0, *(4 * cuts + 4).tolist()], [*(4 * cuts).tolist(), len(raw)])]

    def _learn_words(self, new: list[str]) -> None:
        for at in range(0, len(new), 1000):
            part = new[at : at + 1000]
            ids = np.array(self.bare.encode(" ".join(part), add_special_tokens=False).ids, "<u4")
            cuts = 4 * (np.flatnonzero(self.ends[ids]) + 1)
            if len(cuts) != len(part):
                self._learn(self.words, part)
                continue
            raw, at_ = ids.tobytes(), cuts.tolist()
            self.words.update((w, raw[a:b]) for w, a, b in zip(part, [0, *at_[:-1]], at_))

    def _learn(self, table: dict[str, bytes], new: list[str]) -> None:
        odd = {c for c in new if self.mark in c.lower() or "<|" in c}
        for c in odd:
            table[c] = np.array(self.tokenizer.encode(c, add_special_tokens=False).ids, "<u4").tobytes()
        todo = [c for c in new if c not in odd] if odd else new
        for at in range(0, len(todo), 200):
            table.update(zip(todo[at : at + 200], self._encode(todo[at : at + 200])))

    def _new_chunks(self, chunks: list[str]) -> list[bytes]:
        """Ids of chunks that the table does not have."""
        find, words, lists, rest = _WORD.findall, set(), [], []
        for c in chunks:
            low = c.lower()
            w = find(low)
            if (len(w) == 1 and len(w[0]) == len(low)) or (sum(map(len, w)) == len(low) and "<|" not in c):
                words.update(w)
            else:
                rest.append(c)
                w = None
            lists.append(w)
        unknown = words.difference(self.words)
        if len(self.words) + len(unknown) > WORDS:
            self.words = {w: self.words[w] for w in words.difference(unknown)}
        self._learn_words(list(unknown))
        others: dict[str, bytes] = {}
        self._learn(others, rest)
        word = self.words.__getitem__
        return [others[c] if w is None else word(w[0]) if len(w) == 1 else b"".join(map(word, w)) for c, w in zip(chunks, lists)]

    def _insert(self, slots: np.ndarray, hashes: np.ndarray, ids: list[bytes], chunks: list[bytes]) -> None:
        """New entries at their places among the sorted hashes."""
        sizes, text_sizes = np.array([len(i) // 4 for i in ids], np.int64), np.array([len(c) for c in chunks], np.int64)
        at, text_at = len(self.pool) + np.cumsum(sizes) - sizes, len(self.text) - 8 + np.cumsum(text_sizes) - text_sizes
        self.pool = np.concatenate([self.pool, np.frombuffer(b"".join(ids), "<u4")])
        self.text = np.concatenate([self.text[:-8], np.frombuffer(b"".join(chunks) + bytes(8), np.uint8)])
        place = slots + np.arange(len(slots))
        old = np.ones(len(self.hashes) + len(slots), bool)
        old[place] = False
        for name, new in (("hashes", hashes), ("at", at), ("sizes", sizes), ("text_at", text_at), ("text_sizes", text_sizes)):
            both = np.empty(len(old), new.dtype)
            both[place], both[old] = new, getattr(self, name)
            setattr(self, name, both)

    def _keep(self, entry: np.ndarray) -> None:
        """Only these entries stay."""
        pool, n = self._gather(entry)
        m = self.text_sizes[entry]
        self.text = np.concatenate([self.text[np.repeat(self.text_at[entry] - (np.cumsum(m) - m), m) + np.arange(int(m.sum()))], np.zeros(8, np.uint8)])
        self.hashes, self.pool, self.sizes, self.at, self.text_sizes, self.text_at = self.hashes[entry], pool, n, np.cumsum(n) - n, m, np.cumsum(m) - m

    def _gather(self, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a row of entries, end to end, and how many each has."""
        n = self.sizes[entry]
        return self.pool[np.repeat(self.at[entry] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))], n

    def _ids_of(self, joined: bytes, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the chunks, end to end, and how many each has."""
        size = end - start
        hashes, first, back = np.unique(_chunk_hash(buf, start, end), return_index=True, return_inverse=True)
        lead = first[back]
        exact = bool((size == size[lead]).all()) and bool(same_bytes(buf, start, buf, start[lead], size).all())
        slot = np.searchsorted(self.hashes, hashes)
        known = np.zeros(len(hashes), bool)
        inside = slot < len(self.hashes)
        known[inside] = self.hashes[slot[inside]] == hashes[inside]
        old, of = slot[known], first[known]
        exact = exact and bool((self.text_sizes[old] == size[of]).all()) and bool(same_bytes(self.text, self.text_at[old], buf, start[of], size[of]).all())
        if not exact:
            every = [joined[a:b] for a, b in zip(start.tolist(), end.tolist())]
            few = list(dict.fromkeys(every))
            ids = dict(zip(few, self._new_chunks([c.decode() for c in few])))
            return np.frombuffer(b"".join(ids[c] for c in every), "<u4"), np.array([len(ids[c]) // 4 for c in every], np.int64)
        new = np.flatnonzero(~known)
        if len(new):
            if len(self.hashes) + len(new) > CACHE:  # what this batch uses stays
                self._keep(old)
                slot = np.searchsorted(self.hashes, hashes)
            chunks = [joined[a:b] for a, b in zip(start[first[new]].tolist(), end[first[new]].tolist())]
            self._insert(slot[new], hashes[new], self._new_chunks([c.decode() for c in chunks]), chunks)
            slot = np.searchsorted(self.hashes, hashes)
        return self._gather(slot[back])

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        raw = [(t or "").encode() for t in texts]
        joined = b"\n".join(raw) + b"\n" + bytes(8)
        buf = np.frombuffer(joined, np.uint8)
        end = np.flatnonzero((buf == 32) | (buf == 10))
        start = np.concatenate([[0], end[:-1] + 1])
        start, end = start[end > start], end[end > start]
        ids, n = self._ids_of(joined, buf, start, end)
        begin = np.cumsum([0] + [len(r) + 1 for r in raw])
        per_doc = np.bincount(np.searchsorted(begin, start, side="right") - 1, weights=n, minlength=len(raw)).astype(np.int64)
        cuts = np.concatenate([[0], np.cumsum(per_doc)]).tolist()
        return [ids[a:b].tobytes() + self.end for a, b in zip(cuts[:-1], cuts[1:])]


def _chunk_hash(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    up, down = _powers(len(buf) + 1)
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_BYTE[buf] * up[: len(buf)], out=sums[1:])
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


# Chunks of printable ASCII and Latin letters part into words here, as the tokenizer's own rule parts them: a contraction,
# letters, one digit, or other signs. What this pattern does not cover whole is left to the tokenizer.
_WORD = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-\u024f\u2c65\u2c66]+|[0-9]|[!-&(-/:-`{-~']+")

_IDS: dict[str, Ids] = {}
_PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


def _pieces(path: str, keep_ids: bool):
    schema = _PIECES.append(pa.field("ids", pa.binary())) if keep_ids else _PIECES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import gc
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        ids_of = _IDS.get(path) or _IDS.setdefault(path, Ids(path))
        context = TaskContext.get()
        base = (context.partitionId() if context else 0) << 36
        block, size, used = [], 0, 0

        def flush():
            nonlocal block, size, used
            cols: dict[str, list] = {n: [] for n in schema.names}
            for seq in pack(np.array([len(b) // 4 for _, b in block])):
                offset = 0
                for i, start, n in seq:
                    doc_id, raw = block[i]
                    part = raw[4 * start : 4 * (start + n)]
                    for name, v in zip(schema.names, (doc_id, start, n, zlib.crc32(part), len(raw) // 4, base + used, offset, part)):
                        cols[name].append(v)
                    offset += n
                used += 1
            block, size = [], 0
            return pa.RecordBatch.from_arrays([pa.array(cols[f.name], type=f.type) for f in schema], schema=schema)

        gc.disable()  # millions of short strings, no cycles
        try:
            for b in batches:
                docs, texts = b.column(0).to_pylist(), b.column(1)
                for at in range(0, len(docs), 1000):
                    for doc_id, raw in zip(docs[at : at + 1000], ids_of(texts[at : at + 1000].to_pylist())):
                        block.append((doc_id, raw))
                        size += len(raw) // 4
                        if size >= BLOCK:
                            yield flush()
            if block:
                yield flush()
        finally:
            gc.enable()

    return run, schema


def pack_documents(docs: DataFrame, tokenizer_path: str, keep_ids: bool = True) -> DataFrame:
    """doc_id, text -> pieces. `ids` holds a piece's ids as little-endian unsigned 32-bit numbers."""
    run, schema = _pieces(tokenizer_path, keep_ids)
    return bounded(docs).select(docs["doc_id"].cast("bigint").alias("doc_id"), docs["text"]).mapInArrow(releasing(run), ddl(schema))
