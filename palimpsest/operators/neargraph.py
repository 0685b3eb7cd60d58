"""A kept index of vectors: shards about pivots, and in each a graph of near neighbours that a beam walks.

Pivots are means of a bounded sample; a vector belongs to the shard of its best pivot, and a shard that holds more than SHARD is parted by hash. In a
shard each vector is linked to near ones of different directions (a neighbour is left out if it is nearer to one that is linked already, so
copies of one vector don't use up the links), to those that are linked to it, and to a few anywhere. Some vectors are entries, and each vector is near one
of them. A search starts at the vectors that are near its best entries, so that groups without a link to others are found too, and
follows the links of the best vectors that it has not left yet, until its beam holds none; the vectors of the beam are
scored exactly, by inner product in double precision.

A query visits the shards of its `probe` best pivots (all, where none is given), and the best of each are merged. With vectors of one length
the inner product orders as the cosine does. Vectors about centres, as texts make them, are found with a few per cent of the products; vectors
spread evenly over the sphere have no near neighbours to walk along, and `vector.nearest` is the exact form for those.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fusion import DEPTH, topk
from .lineage import cut

SHARD = 20_000
SAMPLE = 8_192
MAX_PIVOTS = 1_024
LINKS = 16
BEAM = 64
ENTRIES = 64  # at least; three times the root of a shard's size
STARTS = 5
MEMBERS = 96  # of an entry, the nearest; others have links
QUERIES = 1_000
CELLS = 2**20  # products that a worker holds at once
WALKS = 50  # queries that walk together


@dataclass
class Index:
    """shards: pivot, sub, n, ids, vectors, links, members (arrays as bytes), a row a shard, in the shared folder; pivots: (number, dimension), MAX_PIVOTS
    at most."""

    shards: DataFrame
    pivots: np.ndarray


def _centres(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Means of k groups about rows far from each other, by direction."""
    centres = x[np.linspace(0, len(x) - 1, k).astype(int)].copy() if len(x) else np.zeros((0, 0))
    for _ in range(rounds if len(x) else 0):
        of = (x @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, of, x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norm > 0, sums / np.maximum(norm, 1e-12), centres)
    return centres


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _entries(n: int) -> np.ndarray:
    return np.unique(np.linspace(0, n - 1, min(max(ENTRIES, int(3 * n**0.5)), n)).astype(int)) if n else np.zeros(0, int)


def members(x: np.ndarray) -> np.ndarray:
    """A row for each entry: the vectors that it is the best entry of, nearest first; -1 where there are fewer."""
    entries = _entries(len(x))
    best, score = np.zeros(len(x), np.int64), np.zeros(len(x))
    for at in range(0, len(x), 2048):
        s = x[at : at + 2048] @ x[entries].T
        best[at : at + len(s)], score[at : at + len(s)] = s.argmax(1), s.max(1)
    order = np.lexsort((-score, best))
    nth = np.arange(len(x)) - np.searchsorted(best[order], best[order])
    out = np.full((len(entries), min(MEMBERS, int(nth.max(initial=0)) + 1)), -1, np.int32)
    few = nth < out.shape[1]
    out[best[order][few], nth[few]] = order[few]
    return out


def graph(x: np.ndarray, links: int = LINKS, seed: int = 1) -> np.ndarray:
    """(n, 2 * links + 4): the links of each vector; itself where there are fewer."""
    n = len(x)
    near = np.tile(np.arange(n)[:, None], (1, min(3 * links, max(n - 1, 1))))
    block = max(1, min(1024, CELLS // max(n, 1)))
    for at in range(0, n, block):
        s = x[at : at + block] @ x.T
        np.negative(s, out=s)
        s[np.arange(len(s)), np.arange(at, at + len(s))] = np.inf
        if n > 1:
            best = np.argpartition(s, near.shape[1] - 1, axis=1)[:, : near.shape[1]]
            near[at : at + len(s)] = np.take_along_axis(best, np.argsort(np.take_along_axis(s, best, 1), axis=1, kind="stable"), 1)
    out = np.tile(np.arange(n)[:, None], (1, 2 * links + 4))
    filled = np.zeros(n, np.int64)
    for at in range(0, n, 1024):  # nearest first; one that is nearer to a linked one than to the vector itself is left out
        rows = np.arange(at, min(at + 1024, n))
        for c in range(near.shape[1]):
            j = near[rows, c]
            own = np.einsum("id,id->i", x[rows], x[j])
            linked = out[rows, :links]
            rival = np.einsum("ikd,id->ik", x[linked], x[j])
            rival[np.arange(links)[None, :] >= filled[rows, None]] = -np.inf
            good = (rival.max(1) < own) & (filled[rows] < links) & (j != rows)
            out[rows[good], filled[rows[good]]] = j[good]
            filled[rows[good]] += 1
    source, target = np.repeat(np.arange(n), links), out[:, :links].ravel()
    keep = source != target
    source, target = source[keep], target[keep]
    order = np.argsort(target, kind="stable")
    source, target = source[order], target[order]
    nth = np.arange(len(target)) - np.searchsorted(target, target)
    few = nth < links
    out[target[few], links + nth[few]] = source[few]
    out[:, 2 * links :] = np.random.default_rng(seed).integers(max(n, 1), size=(n, 4))
    return out.astype(np.int32)


def walk(q: np.ndarray, x: np.ndarray, links: np.ndarray, near: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray, int]:
    """(places, scores, products): the beam of each query, best first."""
    n, rows = len(x), np.arange(len(q))[:, None]
    beam = min(beam, n)
    entries = _entries(n)
    at_entries = q @ x[entries].T
    starts = np.argsort(-at_entries, axis=1, kind="stable")[:, :STARTS]
    places = near[starts].reshape(len(q), -1)  # each vector has one entry, so none is there twice
    there = places >= 0
    scores, at = np.full(places.shape, -np.inf), np.nonzero(there)
    scores[at] = np.einsum("id,id->i", q[at[0]], x[places[at]])
    products = at_entries.size + len(at[0])
    seen = np.zeros((len(q), n), bool)
    seen[at[0], places[at]] = True
    places = np.maximum(places, 0)
    if scores.shape[1] < beam:
        pad = beam - scores.shape[1]
        scores, places = np.pad(scores, ((0, 0), (0, pad)), constant_values=-np.inf), np.pad(places, ((0, 0), (0, pad)))
    top = np.argsort(-scores, axis=1, kind="stable")[:, :beam]
    scores, places = np.take_along_axis(scores, top, 1), np.take_along_axis(places, top, 1)
    left = ~np.isfinite(scores)  # places that the walk has left already
    while not left.all():
        go = np.argsort(left, axis=1, kind="stable")[:, :4]  # the best four that it has not left
        fresh = ~np.take_along_axis(left, go, 1)
        np.put_along_axis(left, go, True, 1)
        ahead = links[np.take_along_axis(places, go, 1)].reshape(len(q), -1)
        new = np.repeat(fresh, links.shape[1], axis=1) & ~seen[rows, ahead]
        order = np.argsort(ahead, axis=1, kind="stable")
        again = np.zeros_like(new)
        sorted_ahead = np.take_along_axis(ahead, order, 1)
        np.put_along_axis(again, order[:, 1:], sorted_ahead[:, 1:] == sorted_ahead[:, :-1], 1)
        new &= ~again
        seen[rows, ahead] |= np.repeat(fresh, links.shape[1], axis=1)
        s = np.full(ahead.shape, -np.inf)
        at = np.nonzero(new)
        s[at] = np.einsum("id,id->i", q[at[0]], x[ahead[at]])
        products += len(at[0])
        scores, places, left = np.concatenate([scores, s], 1), np.concatenate([places, ahead], 1), np.concatenate([left, ~np.isfinite(s)], 1)
        top = np.argsort(-scores, axis=1, kind="stable")[:, :beam]
        scores, places, left = (np.take_along_axis(v, top, 1) for v in (scores, places, left))
    return places, scores, products


def _shard(table: pa.Table) -> pa.Table:
    table = table.sort_by("edge_id")
    x = _matrix(table["vector"])
    ids = table["edge_id"].to_numpy().astype("<i8")
    return pa.table({"pivot": table["pivot"][:1], "sub": table["sub"][:1], "n": pa.array([len(ids)], pa.int64()), "ids": [ids.tobytes()], "vectors": [x.astype("<f8").tobytes()], "links": [graph(x).astype("<i4").tobytes()], "members": [members(x).astype("<i4").tobytes()]})


def _best_pivots(pivots: np.ndarray, probe: int):
    block = max(1, CELLS // max(len(pivots), 1))

    def run(batches):
        for b in batches:
            x = _matrix(b.column(b.schema.get_field_index("vector")))
            order = np.zeros((len(x), min(probe, len(pivots))), np.int32)
            for at in range(0, len(x) if len(pivots) else 0, block):
                order[at : at + block] = np.argsort(-(x[at : at + block] @ pivots.T), axis=1, kind="stable")[:, :probe]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(list(order), pa.list_(pa.int32()))], names=[*b.schema.names, "pivots"])

    return run


def build(vectors: DataFrame, shard: int = SHARD, sample: int = SAMPLE) -> Index:
    """vectors: edge_id, vector (arrays of one length, not null). Reaches the driver: the sample that makes pivots, and a number a pivot."""
    rows = vectors.select("edge_id", "vector").where("vector IS NOT NULL")
    n = rows.count()
    few = rows.orderBy(F.xxhash64("edge_id")).limit(sample).toPandas()
    x = np.array(few["vector"].tolist(), dtype=np.float64) if len(few) else np.zeros((0, 1))
    pivots = _centres(x, max(1, min(MAX_PIVOTS, len(x), -(-n // shard))))
    placed = rows.mapInArrow(_best_pivots(pivots, 1), "edge_id long, vector array<double>, pivots array<int>").select("edge_id", "vector", F.col("pivots")[0].alias("pivot"))
    sizes = {r.pivot: -(-r.n // shard) for r in placed.groupBy("pivot").agg(F.count("*").alias("n")).collect()}  # MAX_PIVOTS rows
    parts = F.create_map(*(F.lit(v) for kv in sizes.items() for v in kv)) if sizes else F.create_map(F.lit(0), F.lit(1))
    dealt = placed.withColumn("sub", F.pmod(F.xxhash64("edge_id"), parts[F.col("pivot")]).cast("int"))
    return Index(cut(dealt.groupBy("pivot", "sub").applyInArrow(_shard, "pivot int, sub int, n long, ids binary, vectors binary, links binary, members binary")), pivots)


def _search(k: int, beam: int, other_only: bool):
    def run(queries: pa.Table, shard: pa.Table) -> pa.Table:
        out = {"query_id": [], "edge_id": [], "score": [], "products": []}
        if len(queries) and len(shard):
            ids = np.frombuffer(shard["ids"][0].as_py(), "<i8")
            x = np.frombuffer(shard["vectors"][0].as_py(), "<f8").reshape(len(ids), -1)
            links = np.frombuffer(shard["links"][0].as_py(), "<i4").reshape(len(ids), -1)
            near = np.frombuffer(shard["members"][0].as_py(), "<i4").reshape(len(_entries(len(ids))), -1)
            names = queries["query_id"].to_numpy()
            q = _matrix(queries["vector"])
            for at in range(0, len(q), WALKS):
                places, scores, products = walk(q[at : at + WALKS], x, links, near, max(beam, k + 1))
                for i, (p, s) in enumerate(zip(places, np.round(scores, 9))):
                    good = np.isfinite(s) & ((ids[p] != names[at + i]) | (not other_only))
                    best = np.flatnonzero(good)
                    best = best[np.lexsort((ids[p][best], -s[best]))[:k]]
                    out["query_id"] += [names[at + i]] * len(best)
                    out["edge_id"] += ids[p][best].tolist()
                    out["score"] += s[best].tolist()
                    out["products"] += [products // len(places)] * len(best)
        return pa.table(out, schema=pa.schema([("query_id", pa.int64()), ("edge_id", pa.int64()), ("score", pa.float64()), ("products", pa.int64())]))

    return run


def search(index: Index, queries: DataFrame, k: int = DEPTH, probe: int | None = None, beam: int = BEAM, other_only: bool = False) -> DataFrame:
    """query_id, edge_id, score, products (a query's inner products in the shard where the fact was found), rank: the k largest inner products found. queries:
    query_id, vector. Queries go to their shards in blocks of QUERIES by hash."""
    n = max(1, -(-queries.count() // QUERIES))
    asked = queries.select("query_id", F.col("vector").cast("array<double>").alias("vector"))
    routed = asked.mapInArrow(_best_pivots(index.pivots, probe or len(index.pivots)), "query_id long, vector array<double>, pivots array<int>")
    parts = index.shards.select(F.col("pivot").alias("of"), F.col("sub").alias("part"))
    each = routed.select("query_id", "vector", F.explode("pivots").alias("pivot")).join(parts, F.col("pivot") == F.col("of")).select("query_id", "vector", "pivot", "part", F.pmod(F.xxhash64("query_id"), F.lit(n)).cast("int").alias("block"))
    copies = index.shards.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    found = each.groupBy("pivot", "part", "block").cogroup(copies.groupBy("pivot", "sub", "copy")).applyInArrow(_search(k, beam, other_only), "query_id long, edge_id long, score double, products long")
    return topk(found, ["query_id"], [F.desc("score"), F.col("edge_id")], k)
