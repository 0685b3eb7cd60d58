"""Causal chains: a bounded walk along edges with a hint, each edge used once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import cut

# Which end of an edge with this hint is the cause.
CAUSE_IS_SOURCE = ["led_to"]
CAUSE_IS_TARGET = ["caused_by", "enabled_by", "blocked_by"]
MAX_HOPS = 6


def oriented(edges: DataFrame) -> DataFrame:
    """edge_id, cause, effect, hint of live edges with a direction."""
    source = F.col("causal_hint").isin(CAUSE_IS_SOURCE)
    return edges.where(F.col("causal_hint").isin(CAUSE_IS_SOURCE + CAUSE_IS_TARGET)).select(
        "edge_id", F.when(source, F.col("start_id")).otherwise(F.col("end_id")).alias("cause"), F.when(source, F.col("end_id")).otherwise(F.col("start_id")).alias("effect"), F.col("causal_hint").alias("hint")
    )


def anchors(ranked_nodes: DataFrame, most: int = 3, margin: float = 0.15) -> DataFrame:
    """query_id, node: the nearest nodes (query_id, node, score, rank) within the margin of the best."""
    best = ranked_nodes.groupBy("query_id").agg(F.max("score").alias("best"))
    return ranked_nodes.where(F.col("rank") <= most).join(best, "query_id").where(F.col("score") >= F.col("best") - margin).select("query_id", "node")


def trace(seeds: DataFrame, edges: DataFrame, upstream: bool = True, max_hops: int = 3) -> DataFrame:
    """query_id, edge_id, hop, hint, path (edges from the anchor). seeds: query_id, node. One join a hop over the whole edge
    table; nodes that were expanded and edges that were used do not come again. The loop is bounded by max_hops, and each hop's
    rows (those it reached) are cut from their lineage."""
    known, wanted = ("effect", "cause") if upstream else ("cause", "effect")
    step = oriented(edges).select("edge_id", F.col(known).alias("node"), F.col(wanted).alias("next"), "hint")
    frontier = seeds.select("query_id", "node", F.array().cast("array<long>").alias("path"))
    expanded, found = seeds.select("query_id", "node").distinct(), None
    for hop in range(1, min(max_hops, MAX_HOPS) + 1):
        hit = frontier.join(step, "node")
        if found is not None:
            hit = hit.join(found.select("query_id", "edge_id"), ["query_id", "edge_id"], "left_anti")
        new = cut(hit.select("query_id", "edge_id", F.lit(hop).alias("hop"), "hint", "next", F.concat("path", F.array("edge_id")).alias("path")))
        found = new if found is None else found.unionByName(new)
        # a node is entered by the first edge that reaches it
        reached = new.groupBy("query_id", F.col("next").alias("node")).agg(F.min_by("path", "edge_id").alias("path"))
        frontier = reached.join(expanded, ["query_id", "node"], "left_anti")
        expanded = expanded.unionByName(frontier.select("query_id", "node"))
    return found.drop("next")


def maximal(chains: DataFrame) -> DataFrame:
    """Chains that do not begin a longer one: those whose last edge leads on to none."""
    onward = chains.where(F.size("path") > 1).select("query_id", F.slice("path", 1, F.size("path") - 1).alias("path")).distinct()
    return chains.join(onward, ["query_id", "path"], "left_anti")


def contradictions(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """query_id, edge_id: edges that contradict at a node (query_id, node)."""
    c = edges.where("causal_hint = 'contradicts'").select("edge_id", F.explode(F.array_distinct(F.array("start_id", "end_id"))).alias("node"))
    return nodes.join(c, "node").select("query_id", "edge_id").distinct()
