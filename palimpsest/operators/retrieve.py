"""query_memory as one plan over a batch of queries."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import prompt_terms
from ..functions.validity import as_of as valid_at
from ..functions.validity import live
from ..functions.vectors import dot
from . import advisory, expand, fusion, lexical, postings, rerank, vector


@dataclass
class Options:
    """What a caller may set. Defaults are the shipping configuration.

    Which facts: group_id (one scope; a column group_id of the queries asks a scope for each), about (one or two entities), as_of.
    What is returned: top_k; digest (the newest facts instead of ranked ones), lexical_only (no vector is used, so there are no
    scores), vector_only. Channels: floor, or adaptive (floor from the facts' own similarities); lexical_bm25, rrf_k. Expansion:
    graph_hops (1 or 0; None asks the router if route_expansion, and walks if an expansion is named), expansion ('structural' or
    'authored'), expansion_weight. Order: salience_at, trust, rerank, use_mmr; weights of lists by name."""

    top_k: int = 10
    group_id: str | None = None
    about: list[str] | None = None
    digest: bool = False
    lexical_only: bool = False
    floor: float | None = vector.FLOOR
    adaptive: bool = False
    vector_only: bool = False
    lexical_bm25: bool = True
    as_of: int | None = None
    rrf_k: int = fusion.RRF_K
    graph_hops: int | None = None
    route_expansion: bool = False
    expansion: str | None = None
    expansion_weight: float | None = None
    rerank: bool = False
    use_mmr: bool = False
    salience_at: int | None = None
    trust: bool = False
    weights: dict[str, float] = field(default_factory=dict)


EXPANSIONS = {"structural": expand.structural_hop, "authored": expand.authored_hop}


def about(facts: DataFrame, nodes: DataFrame, names: list[str]) -> DataFrame:
    """Facts at an entity (one name) or between two, either way round. Names match whole, case aside; an unknown one gives nothing."""
    if not 1 <= len(names) <= 2:
        raise ValueError("one or two names")
    ids = [nodes.where(F.lower("name") == n.lower()).select(F.col("node").alias("n")).distinct() for n in names]
    if len(ids) == 1:
        hit = facts.join(ids[0], F.col("start_id") == F.col("n"), "left_semi").select("edge_id").unionAll(facts.join(ids[0], F.col("end_id") == F.col("n"), "left_semi").select("edge_id"))
    else:
        a, b = ids
        way = lambda x, y: facts.join(x, F.col("start_id") == F.col("n"), "left_semi").join(y, F.col("end_id") == F.col("n"), "left_semi").select("edge_id")
        hit = way(a, b).unionAll(way(b, a))
    return facts.join(hit.distinct(), "edge_id", "left_semi")


def newest(queries: DataFrame, facts: DataFrame, k: int) -> DataFrame:
    """The k newest facts for each query (of its scope, where it asks one): t_valid, then id, descending."""
    order = [F.desc("t_valid"), F.desc("edge_id")]
    if "group_id" in queries.columns:
        found = queries.select("query_id", "group_id").join(fusion.topk(facts, ["group_id"], order, k).select("group_id", "rank", "edge_id"), "group_id")
    else:
        few = facts.orderBy(*order).limit(k).withColumn("rank", F.row_number().over(Window.orderBy(*order)))
        found = queries.select("query_id").join(F.broadcast(few.select("rank", "edge_id")))  # k rows
    return found.select("query_id", "rank", "edge_id", F.lit(None).cast("double").alias("score"), F.array().cast("array<string>").alias("matched"))


def query_memory(queries: DataFrame, facts: DataFrame, options: Options | None = None, edges: DataFrame | None = None, reads: DataFrame | None = None, verifications: DataFrame | None = None, lessons: DataFrame | None = None, nodes: DataFrame | None = None, index: postings.Index | None = None) -> DataFrame:
    """query_id, rank, edge_id, score, matched. queries: query_id, text, vector (group_id: each asks its own scope); facts: edge_id,
    group_id, fact, vector (t_valid, t_invalid where validity matters); edges: edge_id, start_id, end_id, causal_hint for expansion
    and `about`; nodes: node, name (group_id) for `about` and the router; index: kept postings of the facts, which are then ranked from it, by BM25
    where its statistics are usable and by matched terms elsewhere, without a look at their text. Filters come before ranking, suppression before the cut."""
    o = options or Options()
    if o.expansion is not None and o.expansion not in EXPANSIONS:
        raise ValueError(f"expansion must be one of {sorted(EXPANSIONS)}")
    if o.group_id is not None:
        facts = facts.where(F.col("group_id") == o.group_id)
    if "t_valid" in facts.columns:
        facts = facts.where(valid_at(o.as_of) if o.as_of is not None else live())
    if o.digest:
        return newest(queries, facts, o.top_k)
    scoped = "group_id" in queries.columns
    scope = ["group_id"] if scoped else []
    only = None
    if o.about is not None:
        only = about(edges, nodes, o.about).select("edge_id").distinct()
    lists = []
    if not o.lexical_only:
        candidates = (facts if only is None else facts.join(only, "edge_id", "left_semi")).select("edge_id", "vector", *scope)
        near = vector.vector_channel(queries.select("query_id", "vector", *scope), candidates, None if o.adaptive else o.floor, scope=scoped)
        if o.adaptive:
            near = near.join(F.broadcast(vector.adaptive_floor(facts).select("floor"))).where(F.col("score") >= F.col("floor")).drop("floor")  # one row
        lists.append(fusion.as_list(near, "vector", 0))
    if not o.vector_only:
        words = queries.select("query_id", "text", *scope)
        if index is not None and o.lexical_bm25 and o.as_of is None:
            filtered = o.group_id is not None or "t_valid" in facts.columns
            allowed = facts.select("edge_id") if filtered else only
            allowed = allowed.join(only, "edge_id", "left_semi") if filtered and only is not None else allowed
            ranked = postings.lexical_channel(index, words, by_scope=scoped, only=allowed)
        elif o.lexical_bm25 and o.as_of is None:
            ranked = lexical.bm25(words, facts, by_scope=scoped, only=only)
        else:
            ranked = lexical.match_count(words, facts, by_scope=scoped, only=only)
        lists.append(fusion.as_list(ranked, "lexical", 1))
    if o.lexical_only:
        cut = ranked.where(F.col("rank") <= o.top_k)
        return cut.select("query_id", "rank", "edge_id", F.lit(None).cast("double").alias("score"), F.array(F.lit("lexical")).alias("matched"))

    def fuse(weights=None):
        both = lists[0]
        for more in lists[1:]:
            both = both.unionByName(more)
        return fusion.rrf(both, o.rrf_k, weights)

    fused, weights = fuse(o.weights or None), dict(o.weights)
    routed = o.graph_hops is None and o.route_expansion
    walks = edges is not None and (bool(o.graph_hops) if o.graph_hops is not None else routed or o.expansion is not None)
    if walks:
        seeds = fused.where(F.col("rank") <= expand.SEEDS).select("query_id", "edge_id", "rank")
        if routed:
            asks = queries.select("query_id", *scope, F.explode(prompt_terms(F.col("text"))).alias("token"))
            seeds = seeds.join(expand.needs_expansion(asks, nodes, edges).where("expand").select("query_id"), "query_id", "left_semi")
        more = EXPANSIONS[o.expansion or "structural"](seeds, edges)
        if scoped:  # the walk does not leave the scope
            more = more.join(queries.select("query_id", "group_id"), "query_id").join(facts.select("edge_id", "group_id"), ["edge_id", "group_id"], "left_semi")
        elif o.group_id is not None or "t_valid" in facts.columns:
            more = more.join(facts.select("edge_id"), "edge_id", "left_semi")
        more = more if only is None else more.join(only, "edge_id", "left_semi")
        if scoped or only is not None or o.group_id is not None or "t_valid" in facts.columns:
            more = more.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))
        lists.append(fusion.as_list(more, "graph", 2))
        if o.expansion_weight is not None:
            weights["graph"] = o.expansion_weight
        fused = fuse(weights or None)
    extra = (o.expansion_weight if o.expansion_weight is not None else 1.0) if weights else 1.0
    content = fused
    if o.salience_at is not None and reads is not None:
        s = advisory.by_salience(content, reads, o.salience_at).select("query_id", "edge_id", F.col("salience_rank").alias("rank"))
        lists.append(fusion.as_list(s, "salience", 3))
        weights["salience"] = extra
    if o.trust and verifications is not None:
        t = advisory.by_trust(content, advisory.trust_states(verifications)).select("query_id", "edge_id", F.col("trust_rank").alias("rank"))
        lists.append(fusion.as_list(t, "trust", 4))
        weights["trust"] = extra
    if lessons is not None:
        le = advisory.by_lesson(content, lessons).select("query_id", "edge_id", F.col("lesson_rank").alias("rank"))
        lists.append(fusion.as_list(le, "lessons", 5))
        weights["lessons"] = extra
    if len(lists) > 2 + walks - o.vector_only:
        fused = fuse(weights)
    if verifications is not None:
        rejected = advisory.trust_states(verifications).where("state = 'rejected'").select("edge_id")
        fused = fused.join(rejected, "edge_id", "left_anti").withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))
    if o.rerank:
        every = similarity(fused, queries, facts)
        fused = rerank.by_cosine(fused, every)
    if o.use_mmr:
        picked = rerank.mmr(fused.where(F.col("rank") <= 50), facts, o.top_k)
        fused = picked.join(fused.select("query_id", "edge_id", "matched"), ["query_id", "edge_id"])
    cut = fused.where(F.col("rank") <= o.top_k).select("query_id", "rank", "edge_id", "matched")
    scored = similarity(cut, queries, facts)
    content_lists = F.filter("matched", lambda m: m.isin("vector", "lexical", "graph"))
    return cut.join(scored, ["query_id", "edge_id"]).select("query_id", "rank", "edge_id", F.round("score", 4).alias("score"), content_lists.alias("matched"))


def similarity(ranked: DataFrame, queries: DataFrame, facts: DataFrame) -> DataFrame:
    """Cosine of every listed fact, whichever channel found it."""
    q = queries.select("query_id", F.col("vector").alias("qv"))
    v = facts.select("edge_id", F.col("vector").alias("fv"))
    return ranked.select("query_id", "edge_id").join(q, "query_id").join(v, "edge_id").select("query_id", "edge_id", dot(F.col("qv"), F.col("fv")).alias("score"))
