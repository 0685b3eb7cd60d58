"""Operator 5: exact substring deduplication by blockwise suffix sorting with a difference cover.

A byte goes when it lies in a string of WIDTH bytes that also starts in a document with a smaller doc_id; strings are
judged on the input. The suffixes to be compared are dealt into buckets by content, so that no
task needs more than a bounded part of them:

1. Runs. All GRAM-byte strings are hashed; the smallest hash among those inside a WIDTH-byte window is the window's
   key. Windows with equal bytes have equal keys, and neighbouring windows mostly share theirs: a text is
   cut into runs of windows with one key (about one for 18 bytes).
2. Shared keys. Keys (with the smallest doc_id of a task that has them) are dealt by key; a key that two documents
   have is told to the documents (in blocks by doc_id modulo a prime). Where one task already sees two documents with
   a key, it tells them at once and passes on one of them only: a frequent key costs a task one entry.
3. Suffix buckets. Documents emit the text of the runs whose keys are shared. Runs with equal text (equal digests say which to
   compare, their bytes decide) take one place in a bucket: that of the smallest doc_id; the others go as a whole, in a
   block of documents already. A bucket sorts its suffixes, PART bytes of text after another: the ranks of the sample
   suffixes at the positions of a difference cover modulo 31 are computed first; then one alphabetical range of suffixes
   at a time is sorted by 31 bytes, and where these tie, by the ranks: for any two positions there is a shift under 31 that takes
   both to sample positions. Suffixes with WIDTH equal bytes are neighbours in this order; each group keeps its
   smallest doc_id, and the windows of the others are spans to be removed.
4. Hot keys. A bucket holds BUCKET_BYTES of text at most, a key KEY_BYTES: runs of keys beyond that (one phrase with very many
   surroundings) are dealt anew, cut by the hashes of longer strings (GRAMS), at last each window by all its bytes, where
   a key has one text only. So no task holds a group without a bound; spans found so far travel along.
5. The spans meet the texts again in their blocks.

The exchanges carry 8 bytes for each key of a task, the texts by block (used twice), and the text of shared runs
(compressed). Null texts are empty; rows without a doc_id are kept as they are and remove nothing; rows with an
equal doc_id are one document for the comparison, but each has its own spans; documents under WIDTH bytes lose nothing; an
empty table gives an empty table. Long texts are cut into runs as others; a block holds its documents whole. Other columns, whatever
their names, are left out by remove_repeats and come back unchanged from removed_documents.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, fresh, releasing, same_bytes, text_bytes
from .minhash import _BYTE, _powers, mix

WIDTH = 50
GRAM = 16
GRAMS = (GRAM, 32, WIDTH)  # of the rounds of buckets
SCAN = 1 << 19  # bytes of text that are hashed at once
FLUSH = 500_000  # keys of a task that are sorted at once
PER_BUCKET = 250_000  # keys of a bucket
BLOCK_BYTES = 6 << 20  # text of a block of documents
CHUNK = 1 << 19  # bytes of text that are digested or cut at once
BUCKET_BYTES = 48 << 20  # text that a bucket holds at once
KEY_BYTES = 4 << 20  # text of a key
PART = 1 << 20  # bytes of text with cover ranks of their own (whole keys)
RANGE = 1 << 16  # suffixes of an alphabetical range
PERIOD = 31
PAD = 64


def difference_cover(period: int) -> list[int]:
    """The smallest set (first in order) of which every number modulo period is a difference, by depth-first search."""
    def grow(chosen: list[int], size: int) -> list[int] | None:
        gaps = {(a - b) % period for a in chosen for b in chosen}
        if len(gaps) == period:
            return chosen
        left = size - len(chosen)
        if len(gaps) + sum(2 * (len(chosen) + i) for i in range(left)) < period:
            return None
        for x in range(chosen[-1] + 1, period):
            if left and (got := grow([*chosen, x], size)):
                return got
        return None

    return next(got for size in range(1, period + 1) if (got := grow([0], size)))


COVER = difference_cover(PERIOD)
_IN_COVER = np.isin(np.arange(PERIOD), COVER)
_SHIFT = np.array([[next(k for k in range(PERIOD) if _IN_COVER[(a + k) % PERIOD] and _IN_COVER[(b + k) % PERIOD]) for b in range(PERIOD)] for a in range(PERIOD)])

_FIRST = np.array([next(k for k in range(PERIOD) if _IN_COVER[(a + k) % PERIOD]) for a in range(PERIOD)])


def _load(raw: np.ndarray, big: bool = False) -> np.ndarray:
    """The 8 bytes at each position as a number."""
    return np.ndarray((max(len(raw) - 7, 0),), ">u8" if big else "<u8", raw, strides=(1,)).astype(np.uint64)


def runs(raw: np.ndarray, ends: np.ndarray, width: int = WIDTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of documents laid end to end (ends: where each ends): start, number of windows and key of each run."""
    n = len(raw) - width + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),)
    eight = _load(raw)
    h = eight[: len(raw) - gram + 1].copy()
    for at in dict.fromkeys([*range(8, gram - 8, 8), gram - 8]):
        h *= np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
        h += eight[at : at + len(h)]
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(32)
    span, want = 1, width - gram + 1
    while 2 * span <= want:
        h = np.minimum(h[:-span], h[span:])
        span *= 2
    if span < want:
        h = np.minimum(h[: len(h) - (want - span)], h[want - span :])
    valid = np.ones(n + 1, bool)
    valid[n] = False
    for e in ends.tolist():
        valid[max(e - width + 1, 0) : e] = False
    new = np.ones(n, bool)
    new[1:] = (h[1:n] != h[: n - 1]) | ~valid[: n - 1]
    new &= valid[:n]
    start = np.flatnonzero(new)
    stop = np.flatnonzero(new | ~valid[:n])
    stop = np.append(stop, n)
    length = stop[np.searchsorted(stop, start, side="right")] - start
    return start, length, mix(h[start])


def _pieces(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about SCAN bytes."""
    at = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= SCAN:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def runs_of(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For pieces of a list of texts: index of the text, start in it, windows, key; and start in the piece's bytes, which come last."""
    for a, b in _pieces(texts):
        ends = np.cumsum([len(t) for t in texts[a:b]])
        raw = np.frombuffer(b"".join(texts[a:b]), np.uint8)
        start, length, key = runs(raw, ends)
        doc = np.searchsorted(ends, start, side="right")
        begin = np.concatenate([[0], ends])[doc]
        yield doc + a, start - begin, length, key, (raw, start)


def _short(key: np.ndarray, bits: int) -> np.ndarray:
    """The leading bits of a key that the exchanges carry: bucket and 32 more."""
    return key >> np.uint64(32 - bits)


def _block_of(doc: np.ndarray, blocks: int) -> np.ndarray:
    """As pmod(doc_id, blocks) in SQL; blocks is a prime, so that ids with a pattern spread too."""
    return np.mod(doc.astype(np.int64), blocks)


def _prime(n: int) -> int:
    while any(n % k == 0 for k in range(2, int(n**0.5) + 1)):
        n += 1
    return n


_MAIL = "place int, kind int, block int, body binary"
_NAMES = ["place", "kind", "block", "body"]
_TYPES = [pa.int32(), pa.int32(), pa.int32(), pa.binary()]
KEYS, TOLD, TEXT, SPANS = range(4)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(_TYPES)], names=_NAMES)


def _squeeze(*arrays: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(b"".join(np.array([len(a.tobytes())], "<u8").tobytes() + a.tobytes() for a in arrays))


def _unsqueeze(body: bytes) -> list[bytes]:
    import zstandard

    raw, at, out = zstandard.ZstdDecompressor().decompress(body), 0, []
    while at < len(raw):
        n = int.from_bytes(raw[at : at + 8], "little")
        out.append(raw[at + 8 : at + 8 + n])
        at += 8 + n
    return out


def _split(place: np.ndarray, *arrays: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
    order = np.argsort(place, kind="stable")
    found, first = np.unique(place[order], return_index=True)
    for p, a, b in zip(found.tolist(), first, [*first[1:], len(order)]):
        yield p, [x[order[a:b]] for x in arrays]


def _tell(doc: np.ndarray, short: np.ndarray, blocks: int, buckets: int) -> list[tuple]:
    return [(b % buckets, TOLD, b, _squeeze(d, s)) for b, (d, s) in _split(_block_of(doc, blocks), doc.astype(np.int64), short.astype(np.uint64))]


def _scan(blocks: int, bits: int):
    buckets = 1 << bits

    def flush(keys: list[np.ndarray], docs: list[np.ndarray]) -> pa.RecordBatch:
        key, doc = _short(np.concatenate(keys), bits), np.concatenate(docs)
        order = np.lexsort((doc, key))
        key, doc = key[order], doc[order]
        once = np.ones(len(key), bool)
        once[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
        key, doc = key[once], doc[once]
        first = np.ones(len(key), bool)
        first[1:] = key[1:] != key[:-1]
        many = ~first
        many[:-1] |= ~first[1:]
        rows = _tell(doc[many], key[many], blocks, buckets)
        key, doc = key[first], doc[first]
        for p, (k, d) in _split((key >> np.uint64(32)).astype(np.int64), key, doc):
            base = int(d.min())
            off = d - base
            rows.append((p, KEYS, 0, _squeeze(k.astype(np.uint32), np.array([base]), off.astype(np.uint32 if off.max() < 2**32 else np.uint64))))
        return _batch(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, docs, n = [], [], 0
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for at in range(0, b.num_rows, 1000):
                texts = [text_bytes(t.as_py()) for t in b.column(1).slice(at, 1000)]
                for doc, _start, _length, key, _raw in runs_of(texts):
                    keys.append(key)
                    docs.append(ids[at + doc])
                    n += len(key)
                if n > FLUSH:
                    yield flush(keys, docs)
                    keys, docs, n = [], [], 0
        if n:
            yield flush(keys, docs)

    return run


def _share(blocks: int, bits: int):
    """A bucket of keys: tells the documents of those that come from two documents; passes on what is told already."""
    buckets = 1 << bits

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, keys, docs, told = key[0].as_py(), [], [], []
        for b in batches:
            for kind, block, body in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3)):
                if kind == TOLD:
                    told.append((block, TOLD, block, body.as_py()))
                else:
                    k, base, off = _unsqueeze(body.as_py())
                    k = np.frombuffer(k, np.uint32)
                    keys.append(k)
                    docs.append(np.frombuffer(off, np.uint32 if len(off) == 4 * len(k) else np.uint64).astype(np.int64) + np.frombuffer(base, np.int64)[0])
        if keys:
            k, d = np.concatenate(keys), np.concatenate(docs)
            order = np.argsort(k, kind="stable")
            k, d = k[order], d[order]
            first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
            size = np.diff(np.append(first, len(k)))
            shared = np.repeat((np.minimum.reduceat(d, first) != np.maximum.reduceat(d, first)), size)
            if shared.any():
                told += [(b, kind, b, body) for _, kind, b, body in _tell(d[shared], k[shared].astype(np.uint64) | np.uint64(place << 32), blocks, 1)]
        yield _batch(told)

    return run


def _copied(raw: np.ndarray, place: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The strings at place, laid end to end, and where each begins."""
    lead = np.cumsum(size) - size
    return raw[np.repeat(place - lead, size) + np.arange(int(size.sum()))], lead


def _texts(level: int, buckets: int, key: np.ndarray, doc: np.ndarray, block: np.ndarray, row: np.ndarray, start: np.ndarray, length: np.ndarray, place: np.ndarray, text: np.ndarray) -> list[tuple]:
    """Mail with the text of runs, by the bucket of their key."""
    to = (key >> np.uint64(32)).astype(np.int64) if not level else (mix(key + np.uint64(level)) % np.uint64(buckets)).astype(np.int64)
    rows = []
    for p, (k, d, bl, r, st, n, pl) in _split(to, key, doc, block, row, start, length, place):
        body = _copied(text, pl, n + WIDTH - 1)[0]
        rows.append((p, TEXT, int(bl[0]), _squeeze(k, d, *(x.astype(np.uint32) for x in (bl, r, st, n)), body)))
    return rows


def _emit(bits: int, block_name: str):
    """A block of documents and the keys that are shared: text of the runs, by bucket, and spans that are settled here."""
    buckets = 1 << bits

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        if left.num_rows and right.num_rows:
            block = left.column(block_name)[0].as_py()
            ids, texts, _places = _ordered(left)
            pairs = [_unsqueeze(b.as_py()) for b in right.column("body")]
            doc = np.concatenate([np.frombuffer(p[0], np.int64) for p in pairs])
            short = np.concatenate([np.frombuffer(p[1], np.uint64) for p in pairs])
            told = np.unique(mix(short) ^ mix(doc.view(np.uint64) + np.uint64(1)))  # pairs by one hash: a false one costs work only
            found: list[list[np.ndarray]] = []
            parts, base = [], 0
            for at, start, length, key, (raw, place) in runs_of(texts):
                s = _short(key, bits)
                want = mix(s) ^ mix(ids[at].view(np.uint64) + np.uint64(1))
                hit = told[np.minimum(np.searchsorted(told, want), len(told) - 1)] == want
                if hit.any():
                    at, start, length, s, place = (x[hit] for x in (at, start, length, s, place))
                    text, lead = _copied(raw, place, length + WIDTH - 1)
                    found.append([at, start, length, s, base + lead])
                    parts.append(text)
                    base += len(text)
            if found:
                at, start, length, s, place = (np.concatenate(x) for x in zip(*found))
                text, doc = np.concatenate(parts), ids[at]
                parts.clear()
                kept, spans = _settle(s, length, doc, place, text)
                rows += [(block % buckets, SPANS, block, _squeeze(at[spans].astype(np.uint32), start[spans].astype(np.uint32), (start + length + WIDTH - 1)[spans].astype(np.uint32)))] if spans.any() else []
                rows += _texts(0, buckets, *(x[kept] for x in (s, doc, np.full(len(s), block), at, start, length, place)), text)
        return pa.Table.from_batches([_batch(rows)])

    return run


def _digest(text: np.ndarray, place: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A number for each string of text; place ascends. Equal strings have equal numbers."""
    out = np.zeros(len(place), np.uint64)
    if not len(place):
        return out
    up, down = _powers(CHUNK + int(size.max()) + 1)
    cuts = [0, *(np.flatnonzero(np.diff(place // CHUNK)) + 1).tolist(), len(place)]
    for a, b in zip(cuts[:-1], cuts[1:]):
        lo, p = int(place[a]), place[a:b] - int(place[a])
        part = text[lo : lo + int((p + size[a:b]).max())]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_BYTE[part] * up[: len(part)], out=sums[1:])
        out[a:b] = mix((sums[p + size[a:b]] - sums[p]) * down[p])
    return out


def equal_strings(key: np.ndarray, length: np.ndarray, doc: np.ndarray, place: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of the runs in which those with equal key and text are neighbours, by doc; and where each group of them begins. Digests
    only propose: the bytes are compared."""
    size = length + WIDTH - 1
    digest = _digest(text, place, size)
    order = np.lexsort((doc, length, digest, key))
    new = np.ones(len(order), bool)
    new[1:] = False
    for x in (key, digest, length):
        v = x[order]
        new[1:] |= v[1:] != v[:-1]
    first = np.flatnonzero(new)
    head = order[np.repeat(first, np.diff(np.append(first, len(order))))]
    unlike = ~same_bytes(text, place[order], text, place[head], size[order])
    if unlike.any():  # digests that say too much
        which = np.searchsorted(first, np.flatnonzero(unlike), side="right") - 1
        for f, n in zip(first[np.unique(which)].tolist(), np.diff(np.append(first, len(order)))[np.unique(which)].tolist()):
            groups: dict[bytes, list[int]] = {}
            for i in order[f : f + n].tolist():
                groups.setdefault(text[place[i] : place[i] + size[i]].tobytes(), []).append(i)
            order[f : f + n] = [i for g in groups.values() for i in g]
            new[f + np.cumsum([0, *map(len, groups.values())])[:-1]] = True
        first = np.flatnonzero(new)
    return order, first


def _settle(key: np.ndarray, length: np.ndarray, doc: np.ndarray, place: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs with equal text: those of the smallest doc_id stay open, the others are spans as a whole."""
    spans = np.zeros(len(key), bool)
    if len(key):
        order, first = equal_strings(key, length, doc, place, text)
        d = doc[order]
        spans[order] = d > np.repeat(d[first], np.diff(np.append(first, len(d))))
    return ~spans, spans


def _ordered(left: pa.Table) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """Ids, texts and places of a block's rows in an order that every pass finds again: by doc_id, then text (rows equal in
    both have equal spans)."""
    rows = sorted(zip(left.column("doc_id").to_pylist(), (text_bytes(t) for t in left.column("text").to_pylist()), range(left.num_rows)))
    return np.array([r[0] for r in rows], np.int64), [r[1] for r in rows], np.array([r[2] for r in rows], np.int64)


class Cover:
    """Ranks of the sample suffixes of a text that ends with PAD bytes 0: those at the positions of the difference cover, told apart
    over PERIOD bytes, and twice as many with each doubling."""

    def __init__(self, text: np.ndarray, doublings: int = 3):
        self.eight = _load(text, big=True)
        sample = np.flatnonzero(_IN_COVER[np.arange(len(text) - PAD + 1) % PERIOD])
        self.rank = np.full(len(text) + 5 * PERIOD, -1, np.int32)
        self._name(sample, [self.eight[sample + p] for p in (0, 8, 16, 23)])
        for k in range(doublings):  # along the same residue
            self._name(sample, [self.rank[sample], self.rank[sample + (PERIOD << k)]])

    def _name(self, sample: np.ndarray, keys: list[np.ndarray]) -> None:
        o = np.lexsort(keys[::-1])
        new = np.zeros(len(o), bool)
        for k in keys:
            s = k[o]
            new[1:] |= s[1:] != s[:-1]
        self.rank[sample[o]] = np.cumsum(new)

    def after(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        k = _SHIFT[a % PERIOD, b % PERIOD]
        return self.rank[a + k] > self.rank[b + k]


def sort_suffixes(text: np.ndarray, at: np.ndarray, cover: Cover | None = None) -> np.ndarray:
    """Order of the suffixes of text that start at `at`. text must end with PAD bytes 0 behind all suffixes.

    Suffixes are told apart over as many bytes as the ranks of the cover are, 8 * PERIOD at least where none is given; the order of equal
    ones is any."""
    cover = cover or Cover(text)
    eight, rank = cover.eight, cover.rank
    heads = [eight[at + p] for p in (0, 8, 16, 23)]  # 31 bytes
    order = np.lexsort(heads[::-1])
    tie = np.ones(len(at), bool)
    tie[:1] = False
    for h in heads:
        v = h[order]
        tie[1:] &= v[1:] == v[:-1]
    if not tie.any():
        return order
    # suffixes of one residue and one rank are equal: of those that tie, one of each is compared
    first = np.flatnonzero(~tie)
    size = np.diff(np.append(first, len(order)))
    where = np.flatnonzero(np.repeat(size > 1, size))
    tied, group = order[where], np.repeat(np.arange(len(first)), size)[where]
    residue = at[tied] % PERIOD
    number = rank[at[tied] + _FIRST[residue]]
    o = np.lexsort((number, residue, group))
    new = np.ones(len(o), bool)
    new[1:] = False
    for v in (group[o], residue[o], number[o]):
        new[1:] |= v[1:] != v[:-1]
    begin = np.flatnonzero(new)
    count = np.diff(np.append(begin, len(o)))
    some = _by_ranks(at[tied[o[begin]]], group[o[begin]], cover)
    times = count[some]
    order[where] = tied[o[np.repeat(begin[some] - (np.cumsum(times) - times), times) + np.arange(len(o))]]
    return order


def _by_ranks(at: np.ndarray, group: np.ndarray, cover: Cover) -> np.ndarray:
    """Order of suffixes inside their groups (which lie together), by the ranks of the cover."""
    order, rank, shifts = np.arange(len(at)), cover.rank, _SHIFT.tolist()
    first = np.flatnonzero(np.diff(group, prepend=-1))
    size = np.diff(np.append(first, len(order)))
    for f, n in zip(first[size > 32].tolist(), size[size > 32].tolist()):
        where = at[f : f + n].tolist()

        def compare(i: int, j: int) -> int:
            a, b = where[i], where[j]
            k = shifts[a % PERIOD][b % PERIOD]
            return int(rank[a + k]) - int(rank[b + k])

        order[f : f + n] = f + np.array(sorted(range(n), key=functools.cmp_to_key(compare)))
    small = (size > 1) & (size <= 32)
    inside = np.repeat(small, size)
    offset = np.arange(len(order)) - np.repeat(first, size)
    left = np.repeat(size, size) - offset
    for turn in range(int(size[small].max(initial=1))):  # odd-even transposition, all groups at once
        i = np.flatnonzero(inside & (left > 1) & (offset % 2 == turn % 2) & (np.repeat(size, size) > turn))
        swap = i[cover.after(at[order[i]], at[order[i + 1]])] if len(i) else i
        order[swap], order[swap + 1] = order[swap + 1], order[swap].copy()
    return order


def _ranges(heads: np.ndarray) -> Iterator[np.ndarray]:
    """The suffixes in alphabetical ranges of about RANGE, by their first 8 bytes: which belong to each."""
    if len(heads) <= RANGE:
        yield np.arange(len(heads))
        return
    some = np.sort(heads[:: len(heads) // 4096 + 1])
    count = -(-len(heads) // RANGE)
    cuts = np.unique(some[np.arange(1, count) * len(some) // count])
    for _, (part,) in _split(np.searchsorted(cuts, heads, side="right"), np.arange(len(heads))):
        yield part


def bucket_spans(key: np.ndarray, doc: np.ndarray, length: np.ndarray, place: np.ndarray, text: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of a bucket (place: where its text begins in text): (run, first window, windows) of spans to be removed."""
    order = np.lexsort((doc, key))
    key, doc, length, place = key[order], doc[order], length[order], place[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, int)
    group = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(key))))
    several = (np.minimum.reduceat(doc, first) != np.maximum.reduceat(doc, first))[group] if len(key) else np.zeros(0, bool)
    at = np.flatnonzero(several)
    weight = np.cumsum(length[at] + WIDTH + PAD)
    edge = np.append(np.flatnonzero(np.diff(group[at], prepend=-1)), len(at)) if len(at) else np.zeros(1, int)  # where keys begin
    begin = 0
    while begin < len(at):
        stop = int(np.searchsorted(weight, (weight[begin - 1] if begin else 0) + PART))
        stop = int(edge[np.searchsorted(edge, max(stop, begin + 1))])
        part = at[begin:stop]
        begin = stop
        n, size = length[part], length[part] + WIDTH - 1
        lead = np.concatenate([[0], np.cumsum(-(-(size + PAD) // PERIOD) * PERIOD)])  # runs that begin alike have equal residues
        t = np.zeros(int(lead[-1]) + PAD, np.uint8)
        flat, inner = _copied(text, place[part], size)
        t[np.repeat(lead[:-1] - inner, size) + np.arange(len(flat))] = flat
        step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        windows = np.repeat(lead[:-1], n) + step
        owner = np.repeat(np.arange(len(part)), n)
        cover = Cover(t, 1)  # 62 bytes, of which a result needs 50
        gone = np.zeros(len(windows), bool)
        for some in _ranges(cover.eight[windows]):
            o = some[sort_suffixes(t, windows[some], cover)]
            w = windows[o]
            same = np.ones(len(o), bool)
            same[:1] = False
            for p in (*range(0, WIDTH - 8, 8), WIDTH - 8):
                v = cover.eight[w + p]
                same[1:] &= v[1:] == v[:-1]
            head = np.flatnonzero(~same)
            who = doc[part][owner[o]]
            gone[o] = who > np.repeat(np.minimum.reduceat(who, head), np.diff(np.append(head, len(o))))
        turn = np.ones(len(gone), bool)
        turn[1:] = (gone[1:] != gone[:-1]) | (owner[1:] != owner[:-1])
        f = np.flatnonzero(turn)
        m = np.diff(np.append(f, len(gone)))
        f, m = f[gone[f]], m[gone[f]]
        yield order[part[owner[f]]], step[f], m


class _Bucket:
    """The runs of a bucket while they come in: columns, and their text."""

    def __init__(self, level: int, buckets: int):
        self.level, self.buckets = level, buckets
        self.cols: list[list[np.ndarray]] = []
        self.texts: list[np.ndarray] = []
        self.size = 0
        self.limit = BUCKET_BYTES
        self.hot = np.zeros(0, np.uint64)
        self.spans: list[tuple[np.ndarray, ...]] = []

    def add(self, body: bytes) -> None:
        k, d, bl, r, s, n, t = _unsqueeze(body)
        n = np.frombuffer(n, np.uint32).astype(np.int64)
        size = n + WIDTH - 1
        self.cols.append([np.frombuffer(k, np.uint64), np.frombuffer(d, np.int64), *(np.frombuffer(x, np.uint32).astype(np.int64) for x in (bl, r, s)), n, self.size + np.cumsum(size) - size])
        self.texts.append(np.frombuffer(t, np.uint8))
        self.size += len(t)

    def settle(self) -> tuple[list[np.ndarray], np.ndarray]:
        """Columns (key, doc, block, row, start, windows, place) and text of the open runs; the other ones are spans from here on."""
        cols, text = [np.concatenate(x) for x in zip(*self.cols)], np.concatenate(self.texts)
        k, d, bl, r, s, n, place = cols
        kept, spans = _settle(k, n, d, place, text)
        self.spans.append((bl[spans], r[spans], s[spans], (s + n + WIDTH - 1)[spans]))
        cols = [x[kept] for x in cols]
        if spans.any():
            text, cols[6] = _copied(text, cols[6], cols[5] + WIDTH - 1)
        self.cols, self.texts, self.size = [cols], [text], len(text)
        return cols, text

    def shed(self, last: bool) -> Iterator[tuple]:
        """Mail for the next round: the runs of keys that are too large, the largest ones first, until the others fit."""
        cols, text = self.settle()
        if self.level + 1 == len(GRAMS):
            self.limit = max(BUCKET_BYTES, 2 * self.size)
            return
        keys, of = np.unique(cols[0], return_inverse=True)
        size = np.bincount(of, cols[5] + WIDTH - 1, len(keys))
        largest = np.argsort(size, kind="stable")
        fits = np.zeros(len(keys), bool)
        fits[largest] = (np.cumsum(size[largest]) <= (BUCKET_BYTES if last else BUCKET_BYTES // 2)) & (size[largest] <= KEY_BYTES)
        out = (~fits | np.isin(keys, self.hot))[of]
        if not out.any():
            return
        self.hot = np.union1d(self.hot, keys[~fits])
        yield from self._again(*(x[out] for x in cols), text)
        cols = [x[~out] for x in cols]
        text, cols[6] = _copied(text, cols[6], cols[5] + WIDTH - 1)
        self.cols, self.texts, self.size = [cols], [text], len(text)

    def _again(self, _key: np.ndarray, doc: np.ndarray, block: np.ndarray, row: np.ndarray, start: np.ndarray, length: np.ndarray, place: np.ndarray, text: np.ndarray) -> Iterator[tuple]:
        gram = GRAMS[self.level + 1]
        for i in (np.arange(len(doc))[a:b] for a, b in _pieces_of(length + WIDTH - 1)):
            raw, lead = _copied(text, place[i], length[i] + WIDTH - 1)
            at, n, key = runs(raw, lead + length[i] + WIDTH - 1, WIDTH, gram)
            if gram == WIDTH:  # a window each
                at, key, n = np.repeat(at, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n), np.repeat(key, n), np.ones(int(n.sum()), np.int64)
            for a in range(0, len(at), CHUNK // WIDTH):
                some = slice(a, a + CHUNK // WIDTH)
                of = np.searchsorted(lead, at[some], side="right") - 1
                yield from _texts(self.level + 1, self.buckets, key[some], doc[i][of], block[i][of], row[i][of], start[i][of] + at[some] - lead[of], n[some], at[some], raw)

    def close(self) -> Iterator[tuple]:
        """Spans of all that is left, by block."""
        if self.cols:
            yield from self.shed(last=True)
            k, d, block, row, start, n, place = self.cols[0]
            text = self.texts[0]
            # equal texts of one document (at several places) are sorted once
            o, first = equal_strings(k, n, d, place, text) if len(k) else (np.zeros(0, int), np.zeros(0, int))
            reps, ends = o[first], np.append(first, len(o))
            for which, at, m in bucket_spans(k[reps], d[reps], n[reps], place[reps], text):
                times = ends[which + 1] - ends[which]
                one = o[np.repeat(ends[which], times) + np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)]
                at, m = np.repeat(at, times), np.repeat(m, times)
                self.spans.append((block[one], row[one], start[one] + at, start[one] + at + m + WIDTH - 1))
        if self.spans:
            bl, r, s, e = (np.concatenate(x) for x in zip(*self.spans))
            for b, (r1, s1, e1) in _split(bl, r, s, e):
                yield b % self.buckets, SPANS, b, _squeeze(*(x.astype(np.uint32) for x in (r1, s1, e1)))


def _pieces_of(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of strings of about CHUNK bytes."""
    cuts = [0, *(np.flatnonzero(np.diff(np.cumsum(sizes) // CHUNK)) + 1).tolist(), len(sizes)]
    yield from zip(cuts[:-1], cuts[1:])


def _sort_bucket(level: int, bits: int):
    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, rows = _Bucket(level, 1 << bits), []
        for b in batches:
            for kind, block, body in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3)):
                if kind == SPANS:
                    rows.append((block % bucket.buckets, SPANS, block, body.as_py()))
                    continue
                bucket.add(body.as_py())
                if bucket.size > bucket.limit:
                    for mail in bucket.shed(last=False):
                        rows.append(mail)
                        if len(rows) > 1000:
                            yield _batch(rows)
                            rows = []
            if rows:
                yield _batch(rows)
                rows = []
        yield _batch(list(bucket.close()))

    return run


def merge_spans(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of covered bytes."""
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.ones(len(start), bool)
    new[1:] = start[1:] > end[:-1]
    first = np.flatnonzero(new)
    return start[first], end[np.append(first[1:], len(start)) - 1]


_RESULT = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())]


def _result(rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(_RESULT)], names=[n for n, _ in _RESULT])


def _cut_texts(left: pa.Table, right: pa.Table) -> Iterator[tuple[int, int, bytes, bytes, int, int]]:
    """Place, doc_id, text, what is left of it, removed bytes and spans of each row of a block."""
    ids, texts, places = _ordered(left) if left.num_rows else (np.zeros(0, np.int64), [], np.zeros(0, np.int64))
    by_row: dict[int, list[np.ndarray]] = {}
    if right.num_rows:
        got = [[np.frombuffer(x, np.uint32) for x in _unsqueeze(b.as_py())] for b in right.column("body")]
        row, start, end = (np.concatenate(x).astype(np.int64) for x in zip(*got))
        by_row = dict(_split(row, start, end))
    for i, (place, doc_id, raw) in enumerate(zip(places.tolist(), ids.tolist(), texts)):
        if i not in by_row:
            yield place, doc_id, raw, raw, 0, 0
            continue
        s, e = merge_spans(*by_row[i])
        kept, at, removed = [], 0, 0
        for a, b in zip(s.tolist(), e.tolist()):
            kept.append(raw[at:a])
            at, removed = b, removed + b - a
        yield place, doc_id, raw, b"".join([*kept, raw[at:]]), removed, len(s)


def _digests(keep: bool):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        return _result([(i, len(raw), removed, spans, hashlib.sha256(rest).hexdigest(), rest if keep else None) for _, i, raw, rest, removed, spans in _cut_texts(left, right)])

    return run


def _rows(names: list[str]):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        place, text, n_chars = [], [], []
        for at, _, raw, rest, removed, _ in _cut_texts(left, right):
            t = left.column("text")[at].as_py() if not removed else rest.decode("utf-8", "ignore")
            if not removed or t.strip():
                place.append(at)
                text.append(t)
                n_chars.append(len(t or ""))
        out = left.select(names).take(pa.array(place, pa.int64()))
        for name, values in (("text", text), ("n_chars", n_chars)):
            if name in names:
                k = names.index(name)
                out = out.set_column(k, out.schema.field(k), pa.array(values, out.schema.field(k).type))
        return out

    return run


def _in_blocks(known: DataFrame):
    """Texts grouped by block, and the spans that go from them by block. known: rows with an id."""
    plain = bounded(known).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    total = plain.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = _prime(max(7, -(-total // BLOCK_BYTES)))
    bits = max(5, (int(total * 2 / (WIDTH - GRAM + 2)) // PER_BUCKET).bit_length())
    shared = plain.mapInArrow(releasing(_scan(blocks, bits)), _MAIL).groupBy("place").applyInArrow(releasing(_share(blocks, bits)), _MAIL)
    name = fresh(known, "block")
    texts = known.withColumn(name, F.pmod(F.col("doc_id").cast("bigint"), F.lit(blocks)).cast("int")).groupBy(name)
    mail = texts.cogroup(shared.groupBy("block")).applyInArrow(releasing(_emit(bits, name)), _MAIL)
    for level in range(len(GRAMS)):
        mail = mail.groupBy("place").applyInArrow(releasing(_sort_bucket(level, bits)), _MAIL)
    return texts, mail.groupBy("block")


def remove_repeats(docs: DataFrame, keep: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and (keep) kept, the remaining bytes."""
    plain = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    schema = ", ".join(f"{n} {k}" for n, k in (("doc_id", "bigint"), ("n_bytes", "bigint"), ("n_removed", "bigint"), ("n_spans", "bigint"), ("kept_sha256", "string"), ("kept", "binary")))
    texts, spans = _in_blocks(plain.where(F.col("doc_id").isNotNull()))
    done = texts.cogroup(spans).applyInArrow(releasing(_digests(keep)), schema)
    lost = plain.where(F.col("doc_id").isNull()).select("doc_id", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("kept"))
    lost = lost.select("doc_id", F.length("kept").cast("bigint").alias("n_bytes"), F.lit(0).cast("bigint").alias("n_removed"), F.lit(0).cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), (F.col("kept") if keep else F.lit(None).cast("binary")).alias("kept"))
    out = done.unionByName(lost)
    return out if keep else out.drop("kept")


def removed_documents(docs: DataFrame) -> DataFrame:
    """docs with texts without their repeats (n_chars follows). Bytes of a character that was cut in two go too; documents of which
    nothing but white space is left go. Rows without an id stay as they are."""
    texts, spans = _in_blocks(docs.where(F.col("doc_id").isNotNull()))
    return texts.cogroup(spans).applyInArrow(releasing(_rows(docs.columns)), docs.schema).unionByName(docs.where(F.col("doc_id").isNull()))
