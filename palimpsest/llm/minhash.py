"""Operator 9: near-duplicate documents by bottom-k sketches of one hash function.

A document's set holds the 64-bit hashes of its distinct word shingles. Documents with equal sets are one class, named by
64 bits of the set's digest; 64 more bits tell whether one name stands for two sets, and such names (NAMES at most, of n sets
n^2 / 2^65 by expectation) are replaced by second ones before anything is linked. From there on classes count, not documents. Texts
are read three times; sets travel only for members of clusters. The steps:

1. Sketch: the k smallest values of a set, k = n - ceil(t n) + 1 for the set size n and threshold t. Two sets with a
   similarity of t share one of these values at least (whatever fixed order the values have), so the inverted
   lists of retained values lose no pair.
2. Frequent values: those retained by more than LIST classes, found by counting, go to the end of the order
   (a bounded bitmap of them is broadcast; a false positive only moves a value). So a passage that
   many documents share retains nothing, unless it is nearly all of a document.
3. Inverted lists. A list with up to LIST members gives its pairs; equal member lists count once; pairs are filtered by
   size (before anything else travels with them) and by the union-sketch estimate of similarity, which leaves out what is more than SIGMAS standard
   deviations below t. A longer list only ties its members together (links to its smallest member): near-copies of one
   text by the thousand. A task that sees more than LIST members of a list ties them itself and passes on LIST + 1 of
   them, so no list lands in one task as a whole. The components of both kinds of links are clusters.
4. Verification: a cluster's whole sets meet in blocks of up to BLOCK members; a task compares two blocks by
   matrix products and returns a spanning forest of the exact links, never the pairs. No link between
   different sets inside a cluster is left out, and its work is bounded by the block.
5. The components of the links are the result, named by their smallest doc_id.

Links between documents: t_percent * union <= 100 * intersection, on whole sets. A document with fewer words than the
shingle has its whole sequence as one shingle; one without words (null, empty, white space) has an empty set and is
linked with nothing. Rows with an equal doc_id are one node; a null doc_id gets no component (null, kept true). An empty table gives
an empty table; long texts count whole. Other columns, whatever their names, are left out by near_duplicates and come back unchanged
from deduplicated, which shuffles the texts once, to the ids that stay.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, cut, fresh, releasing, text_bytes, tidied
from .components import components

SHINGLE = 5
LIST = 24
BLOCK = 1536  # members of a cluster in a block
BLOCK_BYTES = 8 << 20  # and bytes of their sets
FEW = 8
SKETCH = 64  # values kept for the union-sketch estimate
SIGMAS = 6.0
BITMAP_BITS = 22  # of frequent values
MEMBER_BITS = (20, 28)  # of classes in clusters: at least and at most, eight a class between
NAMES = 100_000  # names that stand for two sets
ENTRIES = 1_000_000  # entries of inverted lists that a task sorts at once
CHUNK = 1 << 20

_RNG = np.random.default_rng(20240607)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    if not _POWERS or len(_POWERS[0]) < n:
        size, inverse = 1 << max(16, (n - 1).bit_length()), np.uint64(pow(int(_BASE), -1, 2**64))
        with np.errstate(over="ignore"):
            _POWERS[:] = [np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size - 1, b))]) for b in (_BASE, inverse)]
    return _POWERS[0], _POWERS[1]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[str | None], width: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's shingles. A shingle is hashed as its words joined by one space."""
    out: list[np.ndarray] = []
    for t in texts:
        words = text_bytes(t).lower().split()
        if not words:
            out.append(np.zeros(0, np.uint64))
            continue
        raw = np.frombuffer(b" ".join(words), np.uint8)
        up, down = _powers(len(raw) + 1)
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_BYTE[raw] * up[: len(raw)], out=sums[1:])
        gaps = np.flatnonzero(raw == 32)
        starts, ends = np.concatenate([[0], gaps + 1]), np.concatenate([gaps, [len(raw)]])
        w = min(width, len(words))
        s, e = starts[: len(words) - w + 1], ends[w - 1 :]
        h = np.sort(mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64)))
        first = np.ones(len(h), bool)
        np.not_equal(h[1:], h[:-1], out=first[1:])
        out.append(h[first])
    return out


def kept_size(n: int, percent: int) -> int:
    """How many values of a set of size n a sketch must retain."""
    return n - -(-percent * n // 100) + 1 if n else 0


def _slot(values: np.ndarray, bits: int) -> np.ndarray:
    return ((values >> np.uint64(7)) & np.uint64((1 << bits) - 1)).astype(np.int64)


def _marked(values: np.ndarray, bitmap: np.ndarray, bits: int) -> np.ndarray:
    slot = _slot(values, bits)
    return (bitmap[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 > 0


def sketch(values: np.ndarray, percent: int, bitmap: np.ndarray | None = None) -> np.ndarray:
    """The retained values: the first of the order (frequent last, then by hash)."""
    k = kept_size(len(values), percent)
    if bitmap is None:
        return values[:k]
    often = _marked(values, bitmap, BITMAP_BITS)
    return np.concatenate([values[~often], values[often]])[:k]


def class_of(values: np.ndarray, again: frozenset[int] = frozenset(), bits: int = 64) -> tuple[int, int]:
    """Name of a set (bits of its digest; a second one where the first is in `again`) and 64 other bits of the digest."""
    digest = hashlib.blake2b(values.tobytes(), digest_size=24).digest()
    name, check, second = (int.from_bytes(digest[k : k + 8], "little", signed=True) for k in (0, 8, 16))
    name >>= 64 - bits
    return (second if name in again else name), check


def _sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Slices of batches whose last column is the text, with the sets of the texts."""
    for b in batches:
        for at in range(0, b.num_rows, 1000):
            part = b.slice(at, 1000)
            yield part, shingle_sets(part.column(part.num_columns - 1).to_pylist())


def _slim(percent: int, names):
    """node, cls, check, n, keep (retained values), low (smallest values)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        again, bits = names.value
        for part, sets in _sets_of(batches):
            cls, check = zip(*(class_of(s, again, bits) for s in sets)) if sets else ((), ())
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(cls, pa.int64()), pa.array(check, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([sketch(s, percent).tobytes() for s in sets], pa.binary()), pa.array([s[:SKETCH].tobytes() for s in sets], pa.binary())],
                names=["node", "cls", "check", "n", "keep", "low"],
            )

    return run


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(value, cls) from (cls, keep)."""
    for b in batches:
        sizes = np.array([len(k.as_py()) // 8 for k in b.column(1)], np.int64)
        values = np.frombuffer(b"".join(k.as_py() for k in b.column(1)), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(np.repeat(b.column(0).to_numpy(), sizes))], names=["value", "cls"])


def tied(values: np.ndarray, classes: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries of inverted lists as value, class and class that it is tied to (-1: it's an entry). A list of more than `longest`
    members becomes ties to its smallest member (under the member's own name as value) and longest + 1 entries."""
    order = np.lexsort((classes, values))
    v, c = values[order], classes[order]
    first = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]])) if len(v) else np.zeros(0, int)
    size = np.diff(np.append(first, len(v)))
    nth, long = np.arange(len(v)) - np.repeat(first, size), np.repeat(size > longest, size)
    stay = ~long | (nth <= longest)
    ties = np.unique(np.stack([c, c[np.repeat(first, size)]], 1)[long & (nth > 0)], axis=0)
    return np.concatenate([v[stay], ties[:, 0]]), np.concatenate([c[stay], ties[:, 0]]), np.concatenate([np.full(int(stay.sum()), -1), ties[:, 1]])


def _retained(percent: int, bitmap, names, longest: int):
    """(value, cls, tie) of the texts' sets in the order with frequent values last; a class comes once from a task. tie: null, or the class
    that cls is tied to."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks, seen, (again, bits) = np.frombuffer(bitmap.value, np.uint8), set(), names.value
        classes, values, held = [], [], 0

        def flush() -> pa.RecordBatch:
            v, c, t = tied(np.concatenate(values), np.concatenate(classes), longest)
            n = int((t == -1).sum())  # ties come last
            return pa.RecordBatch.from_arrays([pa.array(v), pa.array(c), pa.array(t, mask=np.arange(len(t)) < n)], names=["value", "cls", "tie"])

        for _, sets in _sets_of(batches):
            for s in sets:
                c = class_of(s, again, bits)[0]
                if len(s) and c not in seen:
                    seen.add(c)
                    v = sketch(s, percent, marks)
                    classes.append(np.full(len(v), c, np.int64))
                    values.append(v.view(np.int64))
                    held += len(v)
            if held > ENTRIES:
                yield flush()
                classes, values, held = [], [], 0
        if held:
            yield flush()

    return run


def _whole(members, member_bits: int, names):
    """(cls, values) of the texts' sets whose class may be a member; a class comes once from a task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks, seen, (again, bits) = np.frombuffer(members.value, np.uint8), set(), names.value
        for _, sets in _sets_of(batches):
            classes, values = [], []
            for s in sets:
                c = class_of(s, again, bits)[0]
                if len(s) and c not in seen and _marked(np.array([c], np.int64).view(np.uint64), marks, member_bits)[0]:
                    seen.add(c)
                    classes.append(c)
                    values.append(s.tobytes())
            if values:
                yield pa.RecordBatch.from_arrays([pa.array(classes, pa.int64()), pa.array(values, pa.binary())], names=["cls", "values"])

    return run


def _member_bitmap(spark, members: DataFrame):
    """Bitmap of the classes in clusters and the logarithm of its size, put together from parts of 4096 bytes. A false positive only
    sends a set in vain."""
    least, most = MEMBER_BITS
    member_bits = min(max((8 * members.count()).bit_length(), least), most)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << (member_bits - 3), np.uint8)
        for b in batches:
            slot = _slot(b.column(0).to_numpy().view(np.uint64), member_bits)
            np.bitwise_or.at(bits, slot >> 3, (1 << (slot & 7)).astype(np.uint8))
        parts = bits.reshape(-1, 4096)
        used = np.flatnonzero(parts.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array([parts[i].tobytes() for i in used], pa.binary())], names=["part", "bits"])

    def join(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(4096, np.uint8)
        for b in batches:
            for raw in b.column(1):
                total |= np.frombuffer(raw.as_py(), np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["part", "bits"])

    bits = np.zeros(1 << (member_bits - 3), np.uint8)
    for r in members.select("node").mapInArrow(mark, "part int, bits binary").groupBy("part").applyInArrow(join, "part int, bits binary").collect():
        bits[r["part"] * 4096 : (r["part"] + 1) * 4096] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return spark.sparkContext.broadcast(bits.tobytes()), member_bits


def _frequent_bitmap(spark, entries: DataFrame, longest: int):
    """Bitmap of the values in more than `longest` lists; with more of them than it can tell apart, the most frequent ones."""
    counts = entries.groupBy("value").count()
    most = 1 << (BITMAP_BITS - 3)
    often = counts.where(F.col("count") > longest)
    values = np.array([r["value"] for r in often.orderBy(F.desc("count"), "value").limit(most).collect()], dtype=np.int64).view(np.uint64)
    if not len(values):
        return None
    bitmap = np.zeros(1 << (BITMAP_BITS - 3), np.uint8)
    slot = _slot(values, BITMAP_BITS)
    np.bitwise_or.at(bitmap, slot >> 3, (1 << (slot & 7)).astype(np.uint8))
    return spark.sparkContext.broadcast(bitmap.tobytes())


def _list_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of the members of each list (one row a list, members sorted)."""
    for b in batches:
        left, right = [], []
        for members in b.column(0):
            m = np.array(members.as_py(), np.int64)
            i, j = np.triu_indices(len(m), 1)
            left.append(m[i])
            right.append(m[j])
        if left:
            both = np.unique(np.stack([np.concatenate(left), np.concatenate(right)], 1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])


def estimate(a: np.ndarray, b: np.ndarray, na: int, nb: int, size: int = SKETCH) -> tuple[float, int]:
    """Union-sketch estimate of similarity and the number of union values that it rests on. a, b: the smallest values."""
    union = np.union1d(a, b)
    # below the smaller of the two last values both sketches are whole
    limit = min(a[-1] if len(a) < na else np.uint64(2**64 - 1), b[-1] if len(b) < nb else np.uint64(2**64 - 1))
    union = union[union <= limit]
    return (float(np.isin(union, np.intersect1d(a, b, assume_unique=True)).mean()), len(union)) if len(union) else (1.0, 0)


def _filter_pairs(percent: int):
    t = percent / 100

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for na, nb, x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4), b.column(5)):
                j, m = estimate(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64), na, nb)
                whole = na <= SKETCH and nb <= SKETCH
                keep.append(m == 0 or j >= t - (1e-9 if whole else SIGMAS * math.sqrt(t * (1 - t) / m)))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    parent = list(range(n))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for x, y in zip(a.tolist(), b.tolist()):
        p, q = find(x), find(y)
        if p != q:
            parent[max(p, q)] = min(p, q)
            out.append((x, y))
    return out


def exact_links(nodes: np.ndarray, sets: list[np.ndarray], percent: int, split: int = 0) -> list[tuple[int, int]]:
    """Spanning forest of the links between the sets (with split: only between the first `split` and the others). Elements that
    many of the sets share are counted by matrix products, chunk by chunk; the others by adding up their few pairs."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1].astype(np.int32)
    owner = np.repeat(np.arange(n, dtype=np.int32), sizes)
    counts = np.bincount(ids)
    common = np.zeros((n, n), np.float32)
    for few in (True, False):
        use = (counts > 1) & ((counts <= FEW) if few else (counts > FEW))
        mine = np.flatnonzero(use[ids])
        mine = mine[np.argsort(ids[mine], kind="stable")]
        e, o = ids[mine], owner[mine]
        del mine
        e = np.cumsum(np.concatenate([[False], e[1:] != e[:-1]]), dtype=np.int32) if len(e) else e  # numbers without gaps
        if few:  # equal elements lie together: meet each with the next, the one after it, ...
            for gap in range(1, FEW):
                pair = np.flatnonzero(e[gap:] == e[:-gap])
                if not len(pair):
                    break
                x, y = o[pair], o[pair + gap]
                np.add.at(common, (np.minimum(x, y), np.maximum(x, y)), 1)
            common += common.T
            continue
        top, step = (int(e[-1]) + 1 if len(e) else 0), max(256, CHUNK * 4 // n)
        for at in range(0, top, step):
            lo, hi = np.searchsorted(e, [at, at + step])
            m = np.zeros((n, min(step, top - at)), np.float32)
            m[o[lo:hi], e[lo:hi] - at] = 1
            common += m @ m.T
    out: list[np.ndarray] = []
    for at in range(0, split or n, 256):  # a stripe of rows at a time
        rows = np.arange(at, min(at + 256, split or n))
        c = common[rows].astype(np.int64)
        linked = 100 * c >= percent * (sizes[rows][:, None] + sizes[None, :] - c)
        linked &= np.arange(n)[None, :] >= (split or 0)
        linked &= np.arange(n)[None, :] > rows[:, None]
        i, j = np.nonzero(linked)
        out.append(np.stack([i + at, j]))
    i, j = np.concatenate(out, axis=1)
    return [(int(nodes[x]), int(nodes[y])) for x, y in _forest(n, i, j)]


def _verify(percent: int):
    """Rows arrive sorted by (cluster, i, j, side, node); each run of equal (cluster, i, j) is compared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group, links = None, [], []

        def close():
            if len(group) > 1:
                split = sum(1 for g in group if g[0] == 0) if key[1] != key[2] else 0
                if key[1] == key[2] or 0 < split < len(group):
                    links.extend(exact_links(np.array([g[1] for g in group]), [np.frombuffer(g[2], np.uint64) for g in group], percent, split))

        def out():
            got = pa.RecordBatch.from_arrays([pa.array([x[0] for x in links], pa.int64()), pa.array([x[1] for x in links], pa.int64())], names=["a", "b"])
            links.clear()
            return got

        for b in batches:
            cols = [b.column(i).to_pylist() for i in range(6)]
            for c, i, j, side, node, raw in zip(*cols):
                if (c, i, j) != key:
                    close()
                    key, group = (c, i, j), []
                if not group or group[-1][1] != node:  # a class may come from several tasks
                    group.append((side, node, raw))
            if len(links) > 10_000:
                yield out()
        close()
        if links:
            yield out()

    return run


def links(texts: DataFrame, slim: DataFrame, percent: int, names, longest: int = LIST, block: int = BLOCK) -> DataFrame:
    """(a, b): links between classes whose components are those of all exact links. texts: one column; slim: as _slim gives it; names: how sets are named, as _named gives it."""
    spark = texts.sparkSession
    classes = slim.where("n > 0").dropDuplicates(["cls"])
    entries = classes.select("cls", "keep").mapInArrow(_entries, "value bigint, cls bigint")
    bitmap = _frequent_bitmap(spark, entries, longest)
    if bitmap is not None:
        entries = texts.mapInArrow(releasing(_retained(percent, bitmap, names, longest)), "value bigint, cls bigint, tie bigint").repartition("value").distinct()
    else:
        entries = entries.withColumn("tie", F.lit(None).cast("bigint"))
    alike = Window.partitionBy("value", "tie")
    listed = cut(entries.select("value", "cls", "tie", F.count("*").over(alike).alias("m"), F.min("cls").over(alike).alias("least")).where("m > 1 OR tie IS NOT NULL"))
    lists, ties = listed.where("tie IS NULL"), listed.where("tie IS NOT NULL").select(F.col("cls").alias("a"), F.col("tie").alias("b"))
    short = lists.where(F.col("m") <= longest).groupBy("value").agg(F.array_sort(F.collect_list("cls")).alias("members")).select("members").distinct()
    pairs = short.mapInArrow(_list_pairs, "a bigint, b bigint").distinct()
    # sizes first: pairs whose sizes say no take no smallest values along
    size = slim.where("n > 0").groupBy("cls").agg(F.min("n").alias("n"))
    pairs = pairs.join(size.toDF("a", "na"), "a").join(size.toDF("b", "nb"), "b").select("a", "b", "na", "nb")
    pairs = cut(pairs.where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")))
    asked = pairs.select(F.explode(F.array("a", "b")).alias("k")).distinct()
    low = slim.where("n > 0").select("cls", "low").join(asked, F.col("cls") == F.col("k"), "left_semi").groupBy("cls").agg(F.first("low").alias("low"))
    paired = pairs.join(low.toDF("a", "la"), "a").join(low.toDF("b", "lb"), "b").select("a", "b", "na", "nb", "la", "lb")
    near = paired.mapInArrow(_filter_pairs(percent), "a bigint, b bigint")
    stars = lists.where((F.col("m") > longest) & (F.col("cls") != F.col("least"))).select(F.col("cls").alias("a"), F.col("least").alias("b")).unionAll(ties).distinct()
    clusters = cut(components(near.unionAll(stars)))
    sized = cut(clusters.join(classes.select("cls", "n"), F.col("node") == F.col("cls")).select("node", "root", "n"))
    blocks = F.greatest(F.count("*") / block, F.sum("n") * 8 / BLOCK_BYTES)
    # a cluster of several blocks (two blocks meet in a task anyway); its members may be many, so its size comes by a join that can be split
    large = cut(sized.groupBy("root").agg(F.ceil(blocks).cast("int").alias("parts")).where("parts > 2"))
    member = sized.join(large, "root", "left").select("node", "root", F.coalesce("parts", F.lit(1)).alias("parts")).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    # block p meets every block q: as (p, q) for q >= p and as (q, p) for q < p
    met = member.withColumn("q", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("node", "root", F.least("part", "q").alias("i"), F.greatest("part", "q").alias("j"), (F.col("part") > F.col("q")).cast("int").alias("side"))
    whole = texts.mapInArrow(releasing(_whole(*_member_bitmap(spark, clusters), names)), "cls bigint, values binary")
    # neither side has a bound: the plan is the same at every size
    rows = met.join(whole.hint("merge"), F.col("node") == F.col("cls")).select("root", "i", "j", "side", "node", "values").repartition("root", "i", "j")
    placed = rows.sortWithinPartitions("root", "i", "j", "side", "node")
    return placed.mapInArrow(releasing(_verify(percent)), "a bigint, b bigint")


def _named(docs: DataFrame, percent: int, bits: int):
    """The documents as _slim gives them, written, and the broadcast rule of names by which no name stands for two sets."""
    sc, again = docs.sparkSession.sparkContext, frozenset()
    while True:
        names = sc.broadcast((again, bits))
        slim = cut(docs.mapInArrow(releasing(_slim(percent, names)), "node bigint, cls bigint, check bigint, n bigint, keep binary, low binary"))
        twice = slim.groupBy("cls").agg(F.min("check").alias("a"), F.max("check").alias("b")).where("a != b").select("cls").limit(NAMES + 1).collect()
        if not twice:
            return slim, names
        again = again | {r["cls"] for r in twice}
        if len(again) > NAMES:
            raise RuntimeError(f"more than {NAMES} names stand for two sets")


def near_duplicates(docs: DataFrame, percent: int = 85, bits: int = 64) -> DataFrame:
    """doc_id, n_shingles, component_id, kept. One row for each row of docs. bits: of the names of sets."""
    named = bounded(tidied(docs)).where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("bigint").alias("node"), "text")
    slim, names = _named(named, percent, bits)
    known = slim.select("node", "cls", "n")
    full = known.where("n > 0").select("node", "cls").distinct()
    several = full.groupBy("node").agg(F.min("cls").alias("a"), F.max("cls").alias("b")).where("a != b")
    same = full.join(several.select(F.col("node").alias("k"), "a"), F.col("node") == F.col("k")).select("a", F.col("cls").alias("b"))
    roots = components(cut(links(named.select("text"), slim, percent, names).unionAll(same)))
    # the smallest document of a class, then of a component; written tables, so that the joins on large groups can be split
    first = cut(full.groupBy("cls").agg(F.min("node").alias("first")))
    linked = cut(first.join(roots.toDF("k", "root"), F.col("cls") == F.col("k")).select("cls", "root", "first"))
    least = cut(linked.groupBy("root").agg(F.min("first").alias("component_id")))
    of_class = linked.join(least, "root").select("cls", "component_id").unionAll(first.join(linked.select("cls"), "cls", "left_anti").select("cls", "first"))
    of_node = full.join(of_class.toDF("c", "component_id"), F.col("cls") == F.col("c")).groupBy("node").agg(F.min("component_id").alias("component_id")).withColumnRenamed("node", "k")
    out = known.join(of_node, F.col("node") == F.col("k"), "left").select(F.col("node").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component_id", "node").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id") == F.col("component_id")).unionByName(_null_ids(docs))


def _null_ids(docs: DataFrame) -> DataFrame:
    """Rows without an id: their set size, no component, kept."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(s) for s in shingle_sets(b.column(0).to_pylist())], pa.int64())], names=["n_shingles"])

    lost = docs.where(F.col("doc_id").isNull()).select("text").mapInArrow(run, "n_shingles bigint")
    return lost.select(F.lit(None).cast("bigint").alias("doc_id"), "n_shingles", F.lit(None).cast("bigint").alias("component_id"), F.lit(True).alias("kept"))


def deduplicated(docs: DataFrame, percent: int = 80) -> DataFrame:
    """The rows of docs, one document of each component (of rows with its id, that with the first text)."""
    keep = near_duplicates(docs, percent).where("kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias("kept_id")).distinct()
    kept = docs.join(keep, docs["doc_id"].cast("bigint") == keep["kept_id"], "left_semi")
    nth = fresh(docs, "nth")
    one = kept.withColumn(nth, F.row_number().over(Window.partitionBy("doc_id").orderBy("text"))).where(F.col(nth) == 1).drop(nth)
    return one.unionByName(docs.where(F.col("doc_id").isNull()))
