"""A kept inverted index: postings in blocks with the best a block can do, and statistics as of their last refresh.

A block holds the postings of one token in one slot, a range of WIDTH edge ids of a scope, so the blocks of all tokens of a
query line up. Beside the lists of a block stand its largest term frequency and its shortest fact. BM25 grows with the first and falls with the
second whatever the statistics, so they bound the score of every fact in the block, and the bounds of a query's tokens add up to
a bound of a slot. A search scores the PROBE most promising slots of each query exactly, takes the k-th score there, and then
reads the lists of those slots only whose bound reaches it: what is left out cannot be among the k best, so the result is that of scoring
everything.

Writing appends blocks (a later write in a slot is one more block of it) and counts writes; statistics stay as they were
until refresh makes them anew from the lengths of the lists, without a text. `usable` says whether a scope's statistics still describe it;
where they don't, facts are ranked by matched terms, from the same postings.

An edge id is written once (a changed fact is a new edge). Facts without a token have a row in docs and no posting. Everything of an index is a table:
`save` puts the lists under the bucket of their token, and a search reads the buckets it asks for.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from .fusion import DEPTH, topk
from .lexical import K1, B, idf, query_terms, small, usable
from .lineage import shared_folder, written

WIDTH = 64
BUCKETS = 32
PROBE = 4
TABLES = ("postings", "docs", "terms", "scopes")


@dataclass
class Index:
    """postings: group_id, bucket, token, slot, edges, tfs, dls (lists in step), n, max_tf, min_dl; docs: group_id, edge_id, dl; terms: group_id,
    token, df; scopes: group_id, n_docs, avg_len, refreshed_docs. docs are as of now, terms and scopes as of the last refresh."""

    postings: DataFrame
    docs: DataFrame
    terms: DataFrame
    scopes: DataFrame


def blocks(facts: DataFrame, width: int = WIDTH, buckets: int = BUCKETS) -> tuple[DataFrame, DataFrame]:
    """postings and docs of facts (group_id, edge_id, fact). One shuffle, of facts by slot; a slot has width facts at most."""
    slot = F.floor(F.col("edge_id") / width).cast("bigint")
    rows = facts.select("group_id", "edge_id", slot.alias("slot"), tokens(F.coalesce(F.col("fact"), F.lit(""))).alias("words"))
    docs = rows.select("group_id", "edge_id", F.size("words").alias("dl"))
    dealt = rows.repartition("group_id", "slot")
    each = dealt.select("group_id", "slot", "edge_id", F.size("words").alias("dl"), F.explode("words").alias("token"))
    counted = each.groupBy("group_id", "slot", "edge_id", "token").agg(F.count("*").cast("int").alias("tf"), F.first("dl").alias("dl"))
    grouped = counted.groupBy("group_id", "slot", "token").agg(F.sort_array(F.collect_list(F.struct("edge_id", "tf", "dl"))).alias("p"), F.max("tf").alias("max_tf"), F.min("dl").alias("min_dl"))
    bucket = F.pmod(F.xxhash64("token"), F.lit(buckets)).cast("int")
    lists = [F.col("p.edge_id").alias("edges"), F.col("p.tf").alias("tfs"), F.col("p.dl").alias("dls")]
    return grouped.select("group_id", bucket.alias("bucket"), "token", "slot", *lists, F.size("p").alias("n"), "max_tf", "min_dl"), docs


def statistics(postings: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """terms and scopes as of now. Only the lengths of the lists are read."""
    terms = postings.groupBy("group_id", "token").agg(F.sum("n").alias("df"))
    scopes = docs.groupBy("group_id").agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avg_len")).withColumn("refreshed_docs", F.col("n_docs"))
    return terms, scopes


def build(facts: DataFrame, width: int = WIDTH, buckets: int = BUCKETS) -> Index:
    postings, docs = blocks(facts, width, buckets)
    return Index(postings, docs, *statistics(postings, docs))


def append(index: Index, facts: DataFrame, width: int = WIDTH, buckets: int = BUCKETS) -> Index:
    """The index with more facts; statistics stay."""
    more = keep(facts, width, buckets)
    return Index(index.postings.unionByName(more.postings), index.docs.unionByName(more.docs), index.terms, index.scopes)


def refresh(index: Index, only: DataFrame | None = None) -> Index:
    """Statistics anew, of all scopes or of those in only (group_id)."""
    postings, docs = index.postings, index.docs
    if only is None:
        return Index(postings, docs, *_told(*statistics(postings, docs)))
    only = written(only, "due")
    terms, scopes = statistics(*(t.join(only, "group_id", "left_semi") for t in (postings, docs)))
    return Index(postings, docs, *_told(index.terms.join(only, "group_id", "left_anti").unionByName(terms), index.scopes.join(only, "group_id", "left_anti").unionByName(scopes)))


def staleness(index: Index) -> DataFrame:
    """group_id, refreshed_docs, writes_since, usable: a scope that was never refreshed has 0 and is not usable."""
    now = index.docs.groupBy("group_id").agg(F.count("*").alias("now"))
    known = now.join(index.scopes.select("group_id", "refreshed_docs"), "group_id", "left").na.fill(0, ["refreshed_docs"])
    return usable(known.select("group_id", "refreshed_docs", F.greatest(F.col("now") - F.col("refreshed_docs"), F.lit(0)).alias("writes_since")))


def refresh_if_due(index: Index) -> Index:
    """Statistics anew for the scopes that have outgrown theirs (a scope that is too small stays as it is: nothing in it is rare)."""
    due = staleness(index).where(F.col("writes_since") > F.greatest(0.2 * F.col("refreshed_docs"), F.lit(10.0))).select("group_id")
    return refresh(index, due)


def save(index: Index, path: str, mode: str = "errorifexists") -> None:
    save_lists(index.postings, f"{path}/postings", mode)
    for name in TABLES[1:]:
        getattr(index, name).write.mode(mode).parquet(f"{path}/{name}")


def save_lists(postings: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Within a bucket lists are dealt by slot too, so that a bucket may be larger than a task's share."""
    postings.repartition("bucket", "slot").sortWithinPartitions("bucket", "token", "group_id", "slot").write.mode(mode).partitionBy("bucket").parquet(path)


def keep(facts: DataFrame, width: int = WIDTH, buckets: int = BUCKETS) -> Index:
    """build, written to the shared folder: texts are read for the lists once and for the lengths once, statistics are read off these."""
    spark, path = facts.sparkSession, f"{shared_folder(facts.sparkSession)}/index-{uuid.uuid4().hex}"
    postings, docs = blocks(facts, width, buckets)
    save_lists(postings, f"{path}/postings")
    docs.write.parquet(f"{path}/docs")
    postings, docs = (spark.read.schema(t.schema).parquet(f"{path}/{name}") for name, t in (("postings", postings), ("docs", docs)))
    return Index(postings, docs, *_told(*statistics(postings, docs)))


def _told(terms: DataFrame, scopes: DataFrame) -> tuple[DataFrame, DataFrame]:
    return written(terms, "terms"), written(scopes, "scopes")


def load(spark: SparkSession, path: str) -> Index:
    return Index(*(spark.read.parquet(f"{path}/{name}") for name in TABLES))


def _part(tf: Column, dl: Column) -> Column:
    avg = F.greatest(F.col("avg_len"), F.lit(1.0))
    return F.col("idf") * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avg))


def heads(index: Index, queries: DataFrame, by_scope: bool = False) -> DataFrame:
    """query_id, group_id, token, slot, idf, avg_len, bound: the blocks that queries ask for, by their heads; lists are not read."""
    terms = query_terms(queries).select("query_id", "token", *(["group_id"] if by_scope else []))
    hint = small(terms, index.scopes, by_scope)
    asked = hint(terms.select("token").distinct())
    blocks_of = index.postings.select("group_id", "token", "slot", "max_tf", "min_dl").join(asked, "token", "left_semi").repartition("group_id", "slot")
    tops = blocks_of.groupBy("group_id", "token", "slot").agg(F.max("max_tf").alias("max_tf"), F.min("min_dl").alias("min_dl"))
    known = tops.join(hint(index.scopes.select("group_id", "n_docs", "avg_len")), "group_id").join(hint(index.terms.join(asked, "token", "left_semi")), ["group_id", "token"], "left").withColumn("idf", idf(F.col("n_docs"), F.coalesce("df", F.lit(0))))
    weighed = known.select("group_id", "token", "slot", "idf", "avg_len", _part(F.col("max_tf"), F.col("min_dl")).alias("bound"))
    return weighed.join(hint(terms), ["token", "group_id"] if by_scope else ["token"])


def _scored(index: Index, wanted: DataFrame, only: DataFrame | None, hint: Callable[[DataFrame], DataFrame] = lambda df: df, asked: DataFrame | None = None) -> DataFrame:
    """query_id, group_id, edge_id, score of the facts in the wanted blocks (rows of heads)."""
    lists = index.postings.select("group_id", "token", "slot", F.arrays_zip("edges", "tfs", "dls").alias("p"))
    lists = lists if asked is None else lists.join(asked, "token", "left_semi")
    each = lists.join(hint(wanted), ["group_id", "token", "slot"]).select("query_id", "group_id", "idf", "avg_len", F.explode("p").alias("p"))
    parts = each.select("query_id", "group_id", F.col("p.edges").alias("edge_id"), _part(F.col("p.tfs"), F.col("p.dls")).alias("part"))
    found = parts.groupBy("query_id", "group_id", "edge_id").agg(F.round(F.sum("part"), 6).alias("score"))
    return found if only is None else found.join(only, "edge_id", "left_semi")


def prune(index: Index, queries: DataFrame, k: int = DEPTH, by_scope: bool = False, only: DataFrame | None = None, probe: int = PROBE) -> tuple[DataFrame, DataFrame]:
    """(heads with their slot's bound, the heads whose slot can hold one of the k best facts). Heads are dealt by slot, where they stay; the slots of the first
    look and the k-th scores go to them."""
    by = ["query_id", "group_id"] if by_scope else ["query_id"]
    slot = ["query_id", "group_id", "slot"]
    terms = query_terms(queries)
    hint = small(terms, index.scopes, by_scope)
    asked = hint(terms.select("token").distinct())
    top = heads(index, queries, by_scope).withColumn("most", F.sum("bound").over(Window.partitionBy(*slot)))
    first = topk(top.select(*slot, "most").distinct(), by, [F.desc("most"), F.col("group_id"), F.col("slot")], probe).select(*slot)
    looked = _scored(index, top.join(hint(first), slot, "left_semi"), only, hint, asked)
    kth = topk(looked, by, [F.desc("score"), F.col("edge_id")], k).where(F.col("rank") == k).select(*by, F.col("score").alias("kth"))
    alive = top.join(hint(kth), by, "left").where(F.col("kth").isNull() | (F.col("most") >= F.col("kth") - 2e-6))  # scores are rounded to six digits
    return top, alive.drop("kth")


def search(index: Index, queries: DataFrame, k: int = DEPTH, by_scope: bool = False, only: DataFrame | None = None, probe: int = PROBE) -> DataFrame:
    """The k best facts of each query by BM25 (of each query and scope, if by_scope): query_id, group_id, edge_id, score, rank. queries:
    query_id, text (group_id if by_scope); only: edge_id of the facts that may be ranked."""
    by = ["query_id", "group_id"] if by_scope else ["query_id"]
    _, alive = prune(index, queries, k, by_scope, only, probe)
    terms = query_terms(queries)
    asked = small(terms, index.scopes, by_scope)(terms.select("token").distinct())
    return topk(_scored(index, alive, only, asked=asked), by, [F.desc("score"), F.col("edge_id")], k)


def matches(index: Index, queries: DataFrame, k: int = DEPTH, by_scope: bool = False, only: DataFrame | None = None) -> DataFrame:
    """The ranking without statistics, from the postings: matched terms, their frequency, id."""
    terms = query_terms(queries).select("query_id", "token", *(["group_id"] if by_scope else []))
    lists = index.postings.select("group_id", "token", F.arrays_zip("edges", "tfs").alias("p"))
    each = lists.join(small(terms, index.scopes, by_scope)(terms), ["token", "group_id"] if by_scope else ["token"]).select("query_id", "group_id", F.explode("p").alias("p"))
    hits = each.groupBy("query_id", "group_id", F.col("p.edges").alias("edge_id")).agg(F.count("*").alias("matched_terms"), F.sum("p.tfs").alias("tf"))
    hits = hits if only is None else hits.join(only, "edge_id", "left_semi")
    return topk(hits, ["query_id", "group_id"] if by_scope else ["query_id"], [F.desc("matched_terms"), F.desc("tf"), F.col("edge_id")], k)


def lexical_channel(index: Index, queries: DataFrame, k: int = DEPTH, by_scope: bool = False, only: DataFrame | None = None) -> DataFrame:
    """query_id, group_id, edge_id, rank, ranker: BM25 where the statistics are usable, matched terms elsewhere. A query of one scope asks that
    scope's; a query of all scopes needs all of them (one stale scope among others would be ranked against the wrong corpus)."""
    state = staleness(index).select("group_id", "usable")
    if by_scope:
        fresh = queries.join(state, "group_id", "left").withColumn("usable", F.coalesce("usable", F.lit(False)))
    else:
        fresh = queries.join(F.broadcast(state.agg(F.coalesce(F.min("usable"), F.lit(False)).alias("usable"))))  # one row
    columns = ["query_id", "group_id", "edge_id", "rank"]
    best = search(index, fresh.where("usable").drop("usable"), k, by_scope, only).select(*columns, F.lit("bm25").alias("ranker"))
    return best.unionByName(matches(index, fresh.where("NOT usable").drop("usable"), k, by_scope, only).select(*columns, F.lit("matches").alias("ranker")))
