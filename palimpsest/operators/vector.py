"""Vector channel. Nearest facts are found in blocks: both sides are dealt into blocks by hash, each pair of blocks is one
matrix product in a Python worker that returns the best k of each query only. No pair is a row, no side is broadcast."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import dot
from .fusion import DEPTH, topk
from .lineage import written

FLOOR = 0.15
SAMPLE = 200
MIN_FACTS = 30
BLOCK = 32_768
PIECE = 20_000  # queries of one vector that are answered together
EDGE = 2e-9  # scores are rounded to nine digits


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _product(k: int, least: float | None, as_text: bool):
    """The k best of each query in one block. Only entries that reach the k-th score (or `least`) are rounded and sorted."""

    def run(q: pa.Table, v: pa.Table) -> pa.Table:
        schema = pa.schema([("query_id", pa.int64()), ("edge_id", pa.int64()), ("score", pa.float64())])
        if not len(q) or not len(v):
            return schema.empty_table()
        ids = v["edge_id"].to_numpy()
        order = np.argsort(ids.astype(str) if as_text else ids, kind="stable")  # a place is an id's turn among ties
        ids, m, qids, x = ids[order], _matrix(v["vector"])[order].T.copy(), q["query_id"].to_numpy(), _matrix(q["vector"])
        out = []
        for at in range(0, len(x), 256):
            s = x[at : at + 256] @ m
            good = s >= least - EDGE if least is not None else None
            if good is None or good.sum() > 8 * k * len(s):
                kth = np.partition(s, len(ids) - k, axis=1)[:, len(ids) - k, None] if len(ids) > k else s.min(axis=1, keepdims=True)
                near = s >= kth - EDGE
                good = near if good is None else near & good
            row, place = np.nonzero(good)
            score = np.round(s[row, place], 9)
            turn = np.lexsort((place, -score, row))
            row, place, score = row[turn], place[turn], score[turn]
            nth = np.arange(len(row)) - np.searchsorted(row, row)
            keep = nth < k if least is None else (nth < k) & (score >= least)
            out.append(pa.table([pa.array(qids[at + row[keep]]), pa.array(ids[place[keep]]), pa.array(score[keep])], schema=schema))
        return pa.concat_tables(out)

    return run


def _blocks(queries: DataFrame, vectors: DataFrame, k: int, scope: list[str], ties: Column | None, n_queries: int, n_vectors: int, least: float | None) -> DataFrame:
    qb, vb = max(1, -(-n_queries // BLOCK)), max(1, -(-n_vectors // BLOCK))
    part = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    copies = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    key = ["qb", "vb", *scope]
    left = queries.select("query_id", "vector", *scope, part("query_id", qb).alias("qb"), copies(vb).alias("vb"))
    right = vectors.select("edge_id", "vector", *scope, copies(qb).alias("qb"), part("edge_id", vb).alias("vb"))
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(_product(k, least, ties is not None), "query_id long, edge_id long, score double")
    return topk(found, ["query_id"], [F.desc("score"), ties if ties is not None else F.col("edge_id")], k)


def _rows(df: DataFrame, key: str, scope: bool) -> DataFrame:
    return df.where("vector IS NOT NULL").select(key, F.col("vector").cast("array<double>").alias("vector"), *(["group_id"] if scope else []))


def representatives(queries: DataFrame, scope: bool, n_queries: int) -> DataFrame:
    """queries with `rep`: the smallest id among those of one vector (and scope) in a piece, so that no rep has many more than PIECE."""
    piece = F.pmod(F.xxhash64("query_id"), F.lit(max(1, -(-n_queries // PIECE)))).cast("int")
    same = Window.partitionBy(*(["group_id"] if scope else []), "vector", "piece")
    return queries.withColumn("piece", piece).withColumn("rep", F.min("query_id").over(same)).drop("piece")


def nearest_shared(queries: DataFrame, vectors: DataFrame, k: int = DEPTH, scope: bool = False, ties: Column | None = None, n_queries: int | None = None, least: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(rep, edge_id, score, rank; query_id, rep): equal vectors are asked once, and of facts with one vector only the first k by id are ranked,
    as no other can be among the k best. Work grows with the pairs of distinct vectors."""
    by = ["group_id"] if scope else []
    q, v = _rows(queries, "query_id", scope), _rows(vectors, "edge_id", scope)
    asked = representatives(q, scope, n_queries if n_queries is not None else q.count())
    ask = written(asked.where("query_id = rep").select("query_id", "vector", *by), "asked")
    few = written(topk(v, [*by, "vector"], [ties if ties is not None else F.col("edge_id")], k).drop("rank"), "distinct")
    near = _blocks(ask, few, k, by, ties, ask.count(), few.count(), least)
    return near.withColumnRenamed("query_id", "rep"), asked.select("query_id", "rep")


def nearest(queries: DataFrame, vectors: DataFrame, k: int = DEPTH, other_only: bool = False, scope: bool = False, ties: Column | None = None, n_queries: int | None = None, n_vectors: int | None = None, least: float | None = None) -> DataFrame:
    """query_id, edge_id, score, rank: the k facts with the largest inner product. queries: query_id, vector; vectors: edge_id,
    vector (both with group_id if scope: only facts of the query's scope are ranked). other_only: not the fact with the query's id; ties: by id, or by id as
    text if given; least: no score under it. Rows without a vector take no part. Where more than a block meets a block, equal vectors are put together first."""
    n_queries = n_queries if n_queries is not None else queries.count()
    n_vectors = n_vectors if n_vectors is not None else vectors.count()
    most = k + other_only  # the query's own fact is one of them at most
    if n_queries * n_vectors > BLOCK**2:
        shared, of = nearest_shared(queries, vectors, most, scope, ties, n_queries, least)
        found = of.join(shared, "rep").select("query_id", "edge_id", "score", "rank")
    else:
        found = _blocks(_rows(queries, "query_id", scope), _rows(vectors, "edge_id", scope), most, ["group_id"] if scope else [], ties, n_queries, n_vectors, least)
    if not other_only:
        return found
    return topk(found.where("query_id != edge_id").drop("rank"), ["query_id"], [F.desc("score"), ties if ties is not None else F.col("edge_id")], k)


def vector_channel(queries: DataFrame, vectors: DataFrame, floor: float | None = FLOOR, k: int = DEPTH, scope: bool = False) -> DataFrame:
    """The 50 nearest first, the floor after: the order matters. Ties by the id as text. scope: as in nearest."""
    best = nearest(queries, vectors, k, scope=scope, ties=F.col("edge_id").cast("string"))
    return best if floor is None else best.where(F.col("score") >= floor)


def adaptive_floor(vectors: DataFrame, floor: float = FLOOR, sample: int = SAMPLE) -> DataFrame:
    """One row: the 95th percentile of similarity between sampled facts, at least `floor`; `floor` itself when there are fewer than
    30 facts. The sample is at most `sample` rows (a feature of the measure), so its pairs are bounded."""
    few = vectors.select("edge_id", "vector").orderBy(F.md5(F.col("edge_id").cast("string").cast("binary"))).limit(sample)
    a, b = few.select(F.col("edge_id").alias("a"), F.col("vector").alias("va")), few.select(F.col("edge_id").alias("b"), F.col("vector").alias("vb"))
    pairs = a.join(F.broadcast(b), F.col("a") < F.col("b")).select(dot(F.col("va"), F.col("vb")).alias("sim"))
    got = pairs.agg(F.count("*").alias("n_pairs"), F.expr("percentile_cont(0.95) WITHIN GROUP (ORDER BY sim)").alias("p95"))
    return got.select("n_pairs", F.round(F.when(F.col("n_pairs") < MIN_FACTS * (MIN_FACTS - 1) // 2, floor).otherwise(F.greatest(F.col("p95"), F.lit(floor))), 6).alias("floor"))


def duplicate_candidates(nodes: DataFrame, k: int = 5, least: float = 0.45) -> DataFrame:
    """a, b, similarity: unordered pairs of which one is among the other's k nearest, at `least` similarity."""
    near = nearest(nodes.select(F.col("edge_id").alias("query_id"), "vector"), nodes, k, other_only=True, least=least)
    return near.groupBy(F.least("query_id", "edge_id").alias("a"), F.greatest("query_id", "edge_id").alias("b")).agg(F.round(F.max("score"), 6).alias("similarity"))
