"""Many scopes at once: which to read, how to weigh them, and one fused answer within a token budget."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .expand import names_holding
from .fusion import RRF_K, fit_to_budget
from .lineage import written
from .retrieve import Options, query_memory

MATCHED_NODES = 32
HALF = 10
MAX_SCOPES = 8


def score_scopes(terms: DataFrame, nodes: DataFrame, edges: DataFrame, cap: int = MATCHED_NODES) -> DataFrame:
    """query_id, group_id, matched_terms, candidate_facts, score = coverage * (0.75 + 0.25 * facts / (facts + 10)).

    terms: query_id, token; nodes: group_id, node, name; edges: group_id, edge_id, start_id, end_id (live). A term names a node when
    the node's name holds it; the few distinct terms meet the distinct names first, so no name is compared twice."""
    known = nodes.select("group_id", "node", F.lower("name").alias("name"))
    named = known.join(written(names_holding(known, terms), "held"), "name").select("group_id", "node", "token").distinct()
    hits = named.join(terms, "token")
    covered = hits.groupBy("query_id", "group_id").agg(F.countDistinct("token").alias("matched_terms"))
    first = Window.partitionBy("query_id", "group_id").orderBy("node")
    few = hits.select("query_id", "group_id", "node").distinct().withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= cap)
    ends = edges.select("group_id", "edge_id", F.explode(F.array_distinct(F.array("start_id", "end_id"))).alias("node"))
    facts = few.join(ends, ["group_id", "node"]).groupBy("query_id", "group_id").agg(F.countDistinct("edge_id").alias("candidate_facts"))
    asked = terms.groupBy("query_id").agg(F.countDistinct("token").alias("n_terms"))
    out = covered.join(facts, ["query_id", "group_id"], "left").na.fill(0, ["candidate_facts"]).join(asked, "query_id")
    score = F.col("matched_terms") / F.col("n_terms") * (0.75 + 0.25 * F.col("candidate_facts") / (F.col("candidate_facts") + HALF))
    return out.select("query_id", "group_id", "matched_terms", "candidate_facts", F.round(score, 6).alias("score"))


def choose(scores: DataFrame, default: str, most: int = 3, least: float = 0.0) -> DataFrame:
    """The default scope always; others over the least score, best first, up to `most` in all; with the reason for each."""
    mine = F.col("group_id") == default
    order = Window.partitionBy("query_id").orderBy(mine.desc(), (F.col("score") > least).desc(), F.desc("score"), "group_id")
    nth = scores.withColumn("nth", F.row_number().over(order))
    reason = F.when(mine, "default").when(F.col("score") <= least, "below_threshold").when(F.col("nth") > most, "over_limit").otherwise("chosen")
    return nth.select("query_id", "group_id", "score", reason.alias("reason"), reason.isin("default", "chosen").alias("read"))


def weights(scores: DataFrame) -> DataFrame:
    """Each scope against the best: max(0.1, score / best); all alike when nothing scores."""
    best = F.max("score").over(Window.partitionBy("query_id"))
    w = F.when(best > 0, F.greatest(F.lit(0.1), F.col("score") / best)).otherwise(1.0)
    return scores.withColumn("weight", F.round(w, 6))


def fuse_scopes(per_scope: DataFrame, weight: DataFrame, k: int = RRF_K) -> DataFrame:
    """One list of many: per_scope (query_id, group_id, edge_id, rank), weight (query_id, group_id, weight). Ties by id as text."""
    parts = per_scope.join(weight.select("query_id", "group_id", "weight"), ["query_id", "group_id"])
    fused = parts.groupBy("query_id", "edge_id").agg(F.round(F.sum(F.col("weight") / (k + F.col("rank"))), 9).alias("fused"), F.min("group_id").alias("group_id"))
    order = Window.partitionBy("query_id").orderBy(F.desc("fused"), F.col("edge_id").cast("string"))
    return fused.withColumn("rank", F.row_number().over(order))


def over_fetch(top_k: int) -> int:
    """How deep each scope is read before lists are fused."""
    return min(100, max(3 * top_k, 30))


def route(queries: DataFrame, scopes: DataFrame, scores: DataFrame, default: str | None = None, most: int = 3, least: float = 0.0) -> DataFrame:
    """query_id, group_id, position, score, reason, read, weight: each query against each scope it may read. scopes: group_id,
    position (MAX_SCOPES at most). Where no scope scores above `least` (and there is no default), the first `most` scopes are read as
    a fallback: the vector channel may answer what names no entity."""
    few = scopes.select("group_id", "position").limit(MAX_SCOPES + 1).collect()
    if len(few) > MAX_SCOPES:
        raise ValueError(f"at most {MAX_SCOPES} scopes")
    named = F.array(*(F.struct(F.lit(r.group_id).alias("group_id"), F.lit(r.position).alias("position")) for r in sorted(few, key=lambda r: r.position)))
    every = queries.select("query_id", F.explode(named).alias("s")).select("query_id", "s.group_id", "s.position") if few else queries.select("query_id").join(scopes.select("group_id", "position"), F.lit(False))
    scored = every.join(scores.select("query_id", "group_id", "score"), ["query_id", "group_id"], "left").na.fill(0.0, ["score"])
    mine = F.col("group_id").eqNullSafe(F.lit(default))
    each = Window.partitionBy("query_id")
    nth = F.row_number().over(each.orderBy(mine.desc(), (F.col("score") > least).desc(), F.desc("score"), "group_id"))
    reason = F.when(mine, "default").when(F.col("score") <= least, "below_threshold").when(nth > most, "over_limit").otherwise("chosen")
    ranked = scored.withColumn("reason", reason)
    lost = F.max(F.col("reason").isin("default", "chosen").cast("int")).over(each) == 0
    ranked = ranked.withColumn("reason", F.when(lost & (F.col("position") <= most), "fallback").otherwise(F.col("reason"))).withColumn("read", F.col("reason").isin("default", "chosen", "fallback"))
    best = F.max(F.when(F.col("read"), F.col("score"))).over(each)
    return ranked.withColumn("weight", F.when(F.col("read"), F.when(best > 0, F.round(F.greatest(F.lit(0.1), F.col("score") / best), 6)).otherwise(1.0)))


def query_across(queries: DataFrame, facts: DataFrame, read: DataFrame, options: Options | None = None, **tables: DataFrame) -> DataFrame:
    """query_id, rank, edge_id, group_id, fused: one list out of one retrieval for each query and scope. read: query_id, group_id,
    position, weight (as route gives them, read ones only); options and tables as in query_memory. A scope is read over_fetch deep; every
    fact is of a scope that its query reads, since each retrieval ranks facts of its own scope only."""
    o = options or Options()
    each = queries.drop("group_id").join(read.select("query_id", "group_id", "position", "weight"), "query_id").withColumn("sub", F.col("query_id") * MAX_SCOPES + F.col("position") - 1)
    per = query_memory(each.select(F.col("sub").alias("query_id"), "text", "vector", "group_id"), facts, replace(o, top_k=over_fetch(o.top_k)), **tables)
    lists = per.select(F.col("query_id").alias("sub"), "edge_id", "rank").join(each.select("sub", "query_id", "group_id", "weight"), "sub").drop("sub")
    fused = fuse_scopes(lists.drop("weight"), each.select("query_id", "group_id", "weight"), o.rrf_k)
    return fused.where(F.col("rank") <= o.top_k).select("query_id", "rank", "edge_id", "group_id", "fused")


def assemble(queries: DataFrame, facts: DataFrame, scopes: DataFrame, scores: DataFrame, default: str | None = None, budget: int = 0, most: int = 3, least: float = 0.0, options: Options | None = None, **tables: DataFrame) -> dict[str, DataFrame]:
    """Route, ask each scope, fuse, cut, fit: 'facts' is the answer within the token budget, 'routing' says for each query and scope why
    it was read or not."""
    routing = route(queries, scopes, scores, default, most, least)
    fused = query_across(queries, facts, routing.where("read"), options, **tables)
    return {"facts": fit_to_budget(fused.join(facts.select("edge_id", "fact"), "edge_id"), budget), "routing": routing}
