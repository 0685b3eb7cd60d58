"""Operator 7: nearest neighbours by additive quantisation.

A vector belongs to the nearest of LISTS coarse centroids and is approximated by that centroid and the sum of one codeword
from each of BOOKS full-dimensional codebooks. Codebooks start as residual k-means and are refined in turn by least squares.
Encoding is a beam search: each step extends the BEAM best partial sums by every codeword of
the next book. With a code the squared norm of the sum is stored, so a squared distance is
norm - 2 * (the query's product with the centroid + BOOKS look-ups in its table), and the distance between the vector and its sum: an estimate is wrong
by that much at most, whatever the data look like.

Centroids and codebooks are fitted on about SAMPLE rows (those whose hash of vec_id falls into that share, twice as many at
most: a documented bound); every row is encoded. Vectors are taken from the sample's mean. What the sample does not resemble is coded badly, and so
has a wide bound: it costs time, not neighbours.

The result is exact. A query's k-th distance among the sample bounds what it looks for; lists whose centroid is further than that bound and the list's radius are
not read. In a block, the `rerank` best by the estimate are measured on the original vectors in double precision, first those of the query's nearest lists (as many as
hold PROBED of the true neighbours of sample rows among the sample); then all whose estimate less their own error reaches the k-th distance found.

Search is a join in blocks. Neighbouring lists fill a block of about CODE_BLOCK codes (a longer list is several blocks, by hash; fewer, if vectors are long);
queries with neighbouring nearest lists fill a block of about QUERY_BLOCK; a block of codes travels with its vectors to the blocks of queries that read a list
in it, and returns k rows a query. Copies of one vector (equal codes and hashes of the whole vector) tie, so the
k + 1 smallest vec_ids of them are all that a result can hold; the others are left out of the lists before anything is copied.

Vectors that are null, zero, or hold null or non-finite components, and those of another length than most,
take no part. Rows with an equal vec_id count once, with the smaller distance; a
query's own vec_id is no candidate. Ties go to the smaller vec_id throughout. An empty table gives an empty table. Other columns,
whatever their names, are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, cut, releasing
from .minhash import mix

LISTS = 512
PROBED = 0.99
BOOKS = 32
WORDS = 256
BEAM = 4
SAMPLE = 16_384
RERANK = 100
QUERY_BLOCK = 16_384
CODE_BLOCK = 16_384
BLOCK_VALUES = 1 << 23  # components of the vectors of a block
SCORES = 4_000_000  # estimates in memory at once


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    c = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        a = np.argmin((c * c).sum(1) - 2 * x @ c.T, 1)
        n = np.bincount(a, minlength=k)
        s = np.zeros_like(c)
        np.add.at(s, a, x)
        c[n > 0] = s[n > 0] / n[n > 0, None]
        if (n == 0).any():
            c[n == 0] = x[rng.choice(len(x), int((n == 0).sum()))]
    return c


def encode(x: np.ndarray, books: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """Codes (n, books) and squared norms of the sums."""
    n, (m, k, d) = len(x), books.shape
    codes, rest = np.zeros((n, 1, 0), np.uint8), x[:, None, :].astype(np.float32)
    for b in range(m):
        width = rest.shape[1]
        cost = (books[b] ** 2).sum(1) - 2 * rest.reshape(-1, d) @ books[b].T + (rest.reshape(-1, d) ** 2).sum(1)[:, None]
        cost = cost.reshape(n, width * k)
        keep = min(beam, width * k)
        best = np.argpartition(cost, keep - 1, axis=1)[:, :keep] if keep < width * k else np.tile(np.arange(width * k), (n, 1))
        src, word = best // k, best % k
        rows = np.arange(n)[:, None]
        codes = np.concatenate([codes[rows, src], word[..., None].astype(np.uint8)], axis=2)
        rest = rest[rows, src] - books[b][word]
    win = np.argmin((rest**2).sum(2), 1)
    codes = codes[np.arange(n), win]
    sums = sum(books[b][codes[:, b]] for b in range(m))
    return codes, (sums.astype(np.float64) ** 2).sum(1)


def fit(x: np.ndarray, books: int = BOOKS, words: int = WORDS, refine: int = 3, seed: int = 7) -> np.ndarray:
    """Codebooks (books, words, dimension)."""
    rng, x = np.random.default_rng(seed), x.astype(np.float32)
    k, rest, found = max(1, min(words, len(x))), x.copy(), []
    for _ in range(books):
        c = _kmeans(rest, k, rng).astype(np.float32)
        a = np.argmin((c * c).sum(1) - 2 * rest @ c.T, 1)
        found.append(c)
        rest = rest - c[a]
    out = np.stack(found)
    codes = np.concatenate([encode(x[i : i + 1000], out)[0] for i in range(0, len(x), 1000)])
    rest = x - sum(out[b][codes[:, b]] for b in range(books))
    for _ in range(refine):  # least squares for the codes that the beam finds, one book after another
        for b in range(books):
            n = np.bincount(codes[:, b], minlength=k)
            step = np.zeros_like(out[b])
            np.add.at(step, codes[:, b], rest)
            step /= (n + 0.05)[:, None]
            out[b] += step
            rest -= step[codes[:, b]]
    return out


@dataclass
class Index:
    """Centroids (neighbours in order), codebooks of what they leave, how many lists a query reads first; what is taken from vectors before."""

    centroids: np.ndarray
    books: np.ndarray
    probes: int
    mean: np.ndarray | float = 0.0

    def lists(self, x: np.ndarray, n: int) -> np.ndarray:
        """The n nearest lists of each vector."""
        cost = (self.centroids**2).sum(1) - 2 * x.astype(np.float32) @ self.centroids.T
        return np.argsort(cost, axis=1, kind="stable")[:, :n] if n > 1 else np.argmin(cost, 1)[:, None]

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """List, code and squared norm of the approximation."""
        at = self.lists(x, 1)[:, 0]
        base = self.centroids[at]
        codes, _ = encode(x.astype(np.float32) - base, self.books)
        sums = base + sum(b[codes[:, k]] for k, b in enumerate(self.books))
        return at, codes, (sums.astype(np.float64) ** 2).sum(1)

    def measure(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """List, code, squared norm of the approximation; distances of the vector from the approximation and from its centroid, rounded up."""
        x = x - self.mean
        at, codes, _ = self.encode(x)
        base = self.centroids[at].astype(np.float64)
        sums = base + sum(b[codes[:, k]].astype(np.float64) for k, b in enumerate(self.books))
        out = [(sums**2).sum(1), *(np.sqrt(((x - y) ** 2).sum(1)) * (1 + 1e-9) + 1e-13 * np.sqrt((x**2).sum(1)) for y in (sums, base))]
        lost = ~np.isfinite(out).all(0)  # beyond what codes can say: always measured
        out[0][lost], out[1][lost], out[2][lost] = 0.0, np.inf, np.inf
        return at, codes, *out


def gaps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of all pairs, rounded down."""
    aa, bb = (a**2).sum(1)[:, None], (b**2).sum(1)[None, :]
    return np.sqrt(np.maximum(aa + bb - 2 * a @ b.T - 1e-11 * (aa + bb), 0))


def distances(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Exactly, component after component as Spark's aggregate adds them."""
    return np.sqrt(np.cumsum((vectors - query) ** 2, axis=1)[:, -1])


def build(x: np.ndarray, seed: int = 7) -> Index:
    """An index fitted on sample vectors."""
    rng, x = np.random.default_rng(seed), x.astype(np.float32)
    centroids = _kmeans(x, max(1, min(LISTS, len(x) // 32)), rng).astype(np.float32)
    above = _kmeans(centroids, max(1, int(len(centroids) ** 0.5)), rng)
    centroids = centroids[np.lexsort((centroids @ centroids[0], np.argmin((above * above).sum(1) - 2 * centroids @ above.T, 1)))]
    index = Index(centroids, np.zeros((0, 1, x.shape[1]), np.float32), len(centroids))
    index.books = fit(x - centroids[index.lists(x, 1)[:, 0]])
    asked, own = x[:: max(1, len(x) // 256)], index.lists(x, 1)[:, 0]
    order = index.lists(asked, len(centroids)) if len(centroids) > 1 else np.zeros((len(asked), 1), int)
    place = np.empty_like(order)
    place[np.arange(len(order))[:, None], order] = np.arange(order.shape[1])
    near = np.argsort((x * x).sum(1) - 2 * asked @ x.T, axis=1, kind="stable")[:, 1:11]  # the first one is the vector itself
    if near.size:
        index.probes = int(np.quantile(np.take_along_axis(place, own[near], 1), PROBED, method="higher")) + 1
    return index


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, vector (doubles) of the rows that take part."""
    v = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector")).where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull())
    fine = F.forall("vector", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))) & F.exists("vector", lambda c: c != 0)
    v = v.where(fine)
    size = v.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return v.where(F.size("vector") == (size["n"] if size else 0))


def _encoder(index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                flat = part.column(2).flatten().to_numpy(zero_copy_only=False)
                with np.errstate(all="ignore"):
                    lists, codes, norms, errors, radii = index.value.measure(flat.reshape(part.num_rows, -1).astype(np.float64))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array(lists.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(norms), pa.array(errors), pa.array(radii)], names=["vec_id", "mark", "vector", "list", "code", "norm", "error", "radius"])

    return run


def _blocks(counts: dict[int, int], lists: int, size: int) -> tuple[list[int], list[int]]:
    """First block of each list and how many it has: neighbouring lists share a block of about `size`."""
    first, many, block, filled = [], [], 0, 0
    for k in range(lists):
        n = counts.get(k, 0)
        if filled and filled + n > size:
            block, filled = block + 1, 0
        need = max(1, -(-n // size))
        first.append(block)
        many.append(need)
        block, filled = (block + need, 0) if need > 1 else (block, filled + n)
    return first, many


def _prober(index, sample, radii: list[float], k: int, code_first: list[int], code_many: list[int], query_first: list[int], query_many: list[int]):
    """A query for each block of codes that may hold one of its k nearest, with an upper bound of the k-th distance."""
    far = np.array(radii)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, points = sample.value
        points = points.astype(np.float64)
        sizes = np.sqrt((points**2).sum(1))
        for b in batches:
            rows: list[tuple] = []
            for qid, vector in zip(b.column(0).to_pylist(), b.column(1)):
                with np.errstate(all="ignore"):
                    own = vector.values.to_numpy(zero_copy_only=False).astype(np.float64) - index.value.mean
                    size = np.sqrt((own**2).sum())
                    upper = np.sqrt(((points - own) ** 2).sum(1)) + 1e-6 * (sizes + size)  # the sample holds singles
                    upper = np.sort(np.where((ids == qid) | ~np.isfinite(upper), np.inf, upper))
                    bound = float(upper[k - 1]) if len(upper) >= k else float("inf")
                    apart = gaps(own[None, :], index.value.centroids.astype(np.float64))[0] - far
                    near = int(index.value.lists(own[None, :], 1)[0, 0])
                block = query_first[near] + int(mix(np.array([qid], np.int64).view(np.uint64))[0]) % query_many[near]
                wanted = {c for at in np.flatnonzero(~(apart > bound)).tolist() for c in range(code_first[at], code_first[at] + code_many[at])}
                rows += [(block, c, qid, vector.as_py(), bound) for c in wanted]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], b.column(1).type), pa.array([r[4] for r in rows], pa.float64())], names=["qb", "cb", "query_id", "vector", "bound"])

    return run


_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def best_of(ids: np.ndarray, scores: np.ndarray, most: int) -> np.ndarray:
    """Places of the `most` best finite scores, one for each id; ties go to the smaller id. ids ascend."""
    n = len(scores)
    k = min(n, 2 * most)
    while True:
        edge = np.partition(scores, k - 1)[k - 1] if k < n else np.inf
        pick = np.flatnonzero((scores <= edge) & np.isfinite(scores))
        pick = pick[np.argsort(scores[pick], kind="stable")]
        _, first = np.unique(ids[pick], return_index=True)
        if len(first) >= most or k >= n:
            return pick[np.sort(first)][:most]
        k = min(n, 4 * k)


def _searcher(index, radii: list[float], k: int, rerank: int):
    far = np.array(radii)

    def matrix(column: pa.ChunkedArray, n: int) -> np.ndarray:
        return np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in column.chunks]).reshape(n, -1)

    def best(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """The k nearest of what was measured, an id once; ties go to the smaller id."""
        ids, d = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((ids, d))
        _, first = np.unique(ids[order], return_index=True)
        order = order[np.sort(first)][:k]
        return ids[order], d[order]

    def search(q: pa.Table, c: pa.Table) -> pa.Table:
        if not q.num_rows or not c.num_rows:
            return _FOUND.empty_table()
        ids, lists = c.column("vec_id").to_numpy(), c.column("list").to_numpy()
        order = np.argsort(ids, kind="stable")
        ids, lists, norms, errors = ids[order], lists[order], c.column("norm").to_numpy()[order], c.column("error").to_numpy()[order]
        codes = np.frombuffer(b"".join(x.as_py() for x in c.column("code")), np.uint8).reshape(len(ids), -1)[order]
        stored = matrix(c.column("vector"), len(ids))[order]
        members = {int(at): np.flatnonzero(lists == at) for at in np.unique(lists)}
        books, centroids = index.value.books.astype(np.float64), index.value.centroids.astype(np.float64)
        asked, qids, bounds = matrix(q.column("vector"), q.num_rows), q.column("query_id").to_numpy(), q.column("bound").to_numpy()
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        step = max(1, min(64, SCORES // len(ids)))
        for start in range(0, len(qids), step):
            originals = asked[start : start + step].astype(np.float64)
            some = originals - index.value.mean
            squares = (some**2).sum(1)
            tables = (some @ books.reshape(-1, books.shape[2]).T).reshape(len(some), *books.shape[:2])
            apart = gaps(some, centroids) - far
            soon = np.zeros(apart.shape, bool)
            np.put_along_axis(soon, index.value.lists(some, max(2, index.value.probes))[:, : index.value.probes], True, 1)
            bound = bounds[start : start + step].copy()
            found: list[list[tuple[np.ndarray, np.ndarray]]] = [[(ids[:0], norms[:0])] for _ in qids[start : start + step]]
            for first in (True, False):
                scores = np.full((len(some), len(ids)), np.inf)
                for at, here in members.items():
                    who = np.flatnonzero((soon[:, at] == first) & ~(apart[:, at] > bound))
                    if len(who):
                        s = squares[who, None] + norms[here] - 2 * (some[who] @ centroids[at])[:, None]
                        for b in range(len(books)):
                            s -= 2 * tables[who, b][:, codes[here, b]]
                        scores[who[:, None], here[None, :]] = np.where(np.isnan(s), 0, s)
                for i, qid in enumerate(qids[start : start + step].tolist()):
                    row = scores[i]
                    row[ids == qid] = np.inf
                    pick = best_of(ids, row, rerank)
                    if len(pick):
                        found[i] = [best([*found[i], (ids[pick], distances(stored[pick].astype(np.float64), originals[i]))])]
                        if len(found[i][0][1]) == k:
                            bound[i] = min(bound[i], found[i][0][1][-1])
                        row[pick] = np.inf
                    least = np.sqrt(np.maximum(row - 1e-11 * (squares[i] + norms), 0)) - errors
                    rest = np.flatnonzero(np.isfinite(row) & ~(least > bound[i] * (1 + 1e-9)))
                    for part in np.array_split(rest, -(-len(rest) // 4096)) if len(rest) else []:
                        found[i] = [best([*found[i], (ids[part], distances(stored[part].astype(np.float64), originals[i]))])]
                    if len(found[i][0][1]) == k:
                        bound[i] = min(bound[i], found[i][0][1][-1])
            out += [(np.full(len(f[0][0]), qid), *f[0]) for qid, f in zip(qids[start : start + step].tolist(), found)]
        return pa.Table.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], schema=_FOUND)

    return search


def nearest(vectors: DataFrame, query_every: int = 100, k: int = 10, rerank: int = RERANK) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of each row whose vec_id is divisible by query_every."""
    rows = usable(bounded(vectors))
    spark = vectors.sparkSession
    narrow = "array<float>" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "array<double>"
    rows = rows.withColumn("vector", F.col("vector").cast(narrow))  # floats travel as floats
    share = min(1.0, SAMPLE / max(rows.count(), 1))  # by hash, so that no task sends more than its share to the driver
    sample = rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < int(share * (1 << 30))).limit(2 * SAMPLE).select("vec_id", "vector").toPandas()
    if not len(sample):
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    sample = sample.sort_values("vec_id", kind="stable")
    x, ids = np.stack(sample["vector"].to_numpy()).astype(np.float64), sample["vec_id"].to_numpy()
    del sample
    with np.errstate(all="ignore"):
        mean = x.mean(0)
        mean = np.where(np.isfinite(mean), mean, 0.0)
        x = (x - mean).astype(np.float32)
        fits = np.isfinite((x * x).sum(1))
        built = build(x[fits] if fits.any() else np.zeros((1, x.shape[1]), np.float32))
    built.mean = mean
    lists, index = len(built.centroids), spark.sparkContext.broadcast(built)
    single = np.unique(ids, return_index=True)[1][: SAMPLE // 4]
    points = spark.sparkContext.broadcast((ids[single], x[single]))
    size = x.shape[1]
    del x
    queries = rows.where(F.col("vec_id") % query_every == 0).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    copies = Window.partitionBy("list", "code", "mark").orderBy("vec_id")
    encoded = rows.select("vec_id", F.xxhash64("vector").alias("mark"), "vector").mapInArrow(_encoder(index), f"vec_id bigint, mark bigint, vector {narrow}, list int, code binary, norm double, error double, radius double").dropDuplicates(["list", "code", "mark", "vec_id"])
    kept = cut(encoded.withColumn("nth", F.row_number().over(copies)).where(F.col("nth") <= k + 1).drop("nth", "mark"))
    counts = kept.groupBy("list").agg(F.count("*").alias("n"), F.sum((F.col("vec_id") % query_every == 0).cast("int")).alias("q"), F.max("radius").alias("radius")).collect()
    code_first, code_many = _blocks({r["list"]: r["n"] for r in counts}, lists, min(CODE_BLOCK, max(1, BLOCK_VALUES // size)))
    query_first, query_many = _blocks({r["list"]: r["q"] for r in counts}, lists, min(QUERY_BLOCK, max(1, BLOCK_VALUES // size)))
    known = {r["list"]: r["radius"] for r in counts}
    radii = [known.get(at, float("-inf")) for at in range(lists)]  # lists without rows are further than any bound
    of = lambda values: F.get(F.array(*[F.lit(v) for v in values]), F.col("list"))
    codes = kept.drop("radius").withColumn("cb", (of(code_first) + F.pmod(F.xxhash64("vec_id"), of(code_many))).cast("int"))
    left = queries.mapInArrow(_prober(index, points, radii, k, code_first, code_many, query_first, query_many), f"qb int, cb int, query_id bigint, vector {narrow}, bound double")
    right = codes.join(left.select(F.col("qb").alias("block"), "cb").distinct(), "cb")
    found = left.groupBy("qb", "cb").cogroup(right.groupBy("block", "cb")).applyInArrow(releasing(_searcher(index, radii, k, rerank)), "query_id bigint, vec_id bigint, score double")
    exact = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return exact.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
