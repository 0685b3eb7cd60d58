"""Batch ingest: validation, entity resolution, versions, audit and outcome of each fact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import temporal, vector
from .lineage import cut, written

MAX_STRING = 4000
CONFIDENCE = ["extracted", "inferred", "ambiguous"]
HINTS = ["caused_by", "led_to", "enabled_by", "blocked_by", "contradicts"]
SAME = 0.45
NEGATIONS = ["in", "un", "non", "not"]


def refusal(facts: DataFrame) -> DataFrame:
    """Adds `reason`: the first rule that a fact breaks, or null. Absent columns are not checked."""
    def rule(name: str, broken: Column):
        return F.when(broken, name)

    has = lambda c: c in facts.columns
    rules = [rule("empty_fact", F.coalesce(F.trim("fact"), F.lit("")) == ""), rule("too_long", F.length("fact") > MAX_STRING)]
    rules += [rule("no_endpoint", F.col("source").isNull() | F.col("target").isNull())] if has("source") else []
    rules += [rule("no_relation", F.coalesce("relation_type", F.lit("")) == "")] if has("relation_type") else []
    rules += [rule("bad_confidence", ~F.col("confidence").isin(CONFIDENCE))] if has("confidence") else []
    rules += [rule("bad_hint", F.col("causal_hint").isNotNull() & ~F.col("causal_hint").isin(HINTS))] if has("causal_hint") else []
    return facts.withColumn("reason", F.coalesce(*rules))


def _bare(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), r"[\s_-]+", "")


def blocked(a: Column, b: Column) -> Column:
    """Names that differ by a negation or a trailing version only are never one entity without a question."""
    x, y = _bare(a), _bare(b)
    first = lambda s, n: F.regexp_replace(s, f"^(.*?){n}", "$1")  # noqa: E731  without its first occurrence
    neg = F.lit(False)
    for n in NEGATIONS:
        neg = neg | (x == first(y, n)) | (y == first(x, n))
    cut = lambda s: F.regexp_replace(s, r"\d+[a-z]?$", "")
    return (x != y) & (neg | ((cut(x) == cut(y)) & (cut(x) != "")))


def numbers_differ(a: Column, b: Column) -> Column:
    found = lambda s: F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(s), F.lit(r"([a-z]*\d+[a-z0-9]*)"), 1)))
    return found(a) != found(b)


def resolve(mentions: DataFrame, nodes: DataFrame) -> DataFrame:
    """mention_id, decision (exact, alias, ambiguous, new), node. mentions: mention_id, group_id, name, vector; nodes: node,
    group_id, name, aliases, vector. Exact names first, then aliases, then the five nearest: one at SAME or more (or a blocked
    name) makes the mention ambiguous. Nothing is merged silently."""
    key = mentions.withColumn("key", F.lower("name"))
    least_node = lambda known: known.groupBy("group_id", "key").agg(F.min("node").alias("node"))  # noqa: E731  a name has one answer however many nodes share it
    exact = key.join(least_node(nodes.select("group_id", F.lower("name").alias("key"), "node")), ["group_id", "key"]).groupBy("mention_id").agg(F.min("node").alias("node")).withColumn("decision", F.lit("exact"))
    rest = key.join(exact.select("mention_id"), "mention_id", "left_anti")
    alias = least_node(nodes.select("group_id", F.explode("aliases").alias("alias"), "node").select("group_id", F.lower("alias").alias("key"), "node"))
    by_alias = rest.join(alias, ["group_id", "key"]).groupBy("mention_id").agg(F.min("node").alias("node")).withColumn("decision", F.lit("alias"))
    rest = written(rest.join(by_alias.select("mention_id"), "mention_id", "left_anti").select("mention_id", "group_id", "name", "vector"), "unknown")
    shared, of = vector.nearest_shared(rest.select(F.col("mention_id").alias("query_id"), "vector", "group_id"), nodes.select(F.col("node").alias("edge_id"), "vector", "group_id"), 5, scope=True)
    # the names of the nearest travel with the vector that they are near to, once however many mentions have it
    near = shared.join(nodes.select(F.col("node").alias("edge_id"), F.col("name").alias("known")), "edge_id").groupBy("rep").agg(F.collect_list(F.struct("rank", "edge_id", "score", "known")).alias("near"))
    near = rest.select(F.col("mention_id").alias("query_id"), F.col("name").alias("mention")).join(of, "query_id").join(near, "rep").repartition("query_id").select("query_id", "mention", F.explode("near").alias("n")).select("query_id", "mention", "n.*")
    like = near.where((F.col("score") >= SAME) | blocked(F.col("mention"), F.col("known"))).groupBy(F.col("query_id").alias("mention_id")).agg(F.min_by("edge_id", "rank").alias("node"))
    fuzzy = rest.select("mention_id").join(like, "mention_id", "left").withColumn("decision", F.when(F.col("node").isNull(), "new").otherwise("ambiguous"))
    cols = ["mention_id", "decision", "node"]
    return exact.select(cols).unionByName(by_alias.select(cols)).unionByName(fuzzy.select(cols))


MAX_ENTITIES = 50
MAX_FACTS = 200


def episode_refusal(entities: DataFrame, facts: DataFrame) -> DataFrame:
    """episode_id, reason of episodes that are refused as a whole: too many entities or facts, a name that is too long or empty, a fact whose
    ends are not listed. entities: episode_id, name; facts: episode_id, source, target."""
    e = entities.groupBy("episode_id").agg(F.count("*").alias("n_entities"), F.max(F.length("name")).alias("longest"), F.max((F.trim("name") == "").cast("int")).alias("blank"))
    f = facts.groupBy("episode_id").agg(F.count("*").alias("n_facts"))
    listed = entities.select("episode_id", F.col("name").alias("end")).distinct()
    ends = facts.select("episode_id", F.explode(F.array("source", "target")).alias("end"))
    loose = ends.join(listed, ["episode_id", "end"], "left_anti").select("episode_id").distinct().withColumn("loose", F.lit(True))
    row = e.join(f, "episode_id", "full").join(loose, "episode_id", "left")
    rules = [("too_many_entities", F.col("n_entities") > MAX_ENTITIES), ("too_many_facts", F.col("n_facts") > MAX_FACTS), ("too_long", F.col("longest") > MAX_STRING), ("empty_name", F.col("blank") == 1), ("unlisted_endpoint", F.col("loose"))]
    return row.select("episode_id", F.coalesce(*[F.when(broken, name) for name, broken in rules]).alias("reason")).where("reason IS NOT NULL")


def resolve_explicit(mentions: DataFrame, claims: DataFrame, nodes: DataFrame) -> DataFrame:
    """resolve, with claims (mention_id, node) that a caller makes: a claim holds if the node is of the mention's scope and its name or an
    alias, or near enough (SAME); else the mention is 'refused'. Mentions without a claim are resolved as usual."""
    claimed = mentions.join(claims, "mention_id").join(nodes.select("node", "group_id", F.col("name").alias("known"), "aliases", F.col("vector").alias("v")), ["node", "group_id"], "left")
    key = F.lower("name")
    named = (F.lower("known") == key) | F.array_contains(F.transform("aliases", lambda x: F.lower(x)), key)
    near = F.aggregate(F.zip_with("vector", "v", lambda x, y: x * y), F.lit(0.0), lambda a, b: a + b) >= SAME
    holds = F.coalesce(named, F.lit(False)) | F.coalesce(near, F.lit(False))
    said = claimed.select("mention_id", F.when(holds, "explicit").otherwise("refused").alias("decision"), F.when(holds, F.col("node")).alias("node"))
    return said.unionByName(resolve(mentions.join(claims.select("mention_id"), "mention_id", "left_anti"), nodes))


def write_episodes(current: DataFrame, entities: DataFrame, facts: DataFrame, nodes: DataFrame, claims: DataFrame | None = None) -> dict[str, DataFrame]:
    """One write of whole episodes: refusal, resolution (claims first), deferral, versions, audit. entities: episode_id, mention_id, group_id,
    name, vector; facts: episode_id, edge_id, group_id, source, target (names), relation_type, fact, confidence, t_valid. A fact with an end that
    is ambiguous (or whose claim is refused) is deferred. 'outcomes' has stored, unchanged, deferred or refused for each fact;
    'episodes' what became of each episode: refused, no_facts, retryable (all deferred), partial, stored or unchanged. New names get
    ids by hash, so that a rerun writes the same rows. Refusals, resolutions, the facts with their ends and the outcomes are each read several
    times and are written once to the checkpoint folder."""
    bad = cut(episode_refusal(entities, facts))
    good = entities.join(bad.select("episode_id"), "episode_id", "left_anti")
    mentions = good.select("mention_id", "group_id", "name", "vector").dropDuplicates(["mention_id"])
    found = cut(resolve(mentions, nodes) if claims is None else resolve_explicit(mentions, claims, nodes))
    fresh = F.when(F.col("decision") == "new", F.xxhash64("group_id", F.lower("name"))).otherwise(F.col("node"))
    named = good.select("episode_id", "mention_id", "group_id", "name").join(found, "mention_id").select("episode_id", "name", F.struct("mention_id", "decision", fresh.alias("node")).alias("m"))
    known = named.groupBy("episode_id", "name").agg(F.min("m").alias("m")).select("episode_id", "name", "m.decision", "m.node")  # a name listed twice is the first mention's
    end = lambda side, node: known.select("episode_id", F.col("name").alias(side), F.col("node").alias(node), F.col("decision").isin("ambiguous", "refused").alias(f"{node}_open"))
    todo = cut(facts.join(bad.select("episode_id"), "episode_id", "left_anti").join(end("source", "start_id"), ["episode_id", "source"]).join(end("target", "end_id"), ["episode_id", "target"]))
    waits = todo.where("start_id_open OR end_id_open")
    batch = todo.where("NOT (start_id_open OR end_id_open)")
    wrote = write_batch(current, batch)
    parts = [wrote["outcomes"], waits.select("edge_id", F.lit("deferred").alias("outcome")), facts.join(bad.select("episode_id"), "episode_id", "left_semi").select("edge_id", F.lit("refused").alias("outcome"))]
    outcomes = cut(parts[0].unionByName(parts[1]).unionByName(parts[2]))
    each = entities.select("episode_id").distinct().join(facts.select("episode_id", "edge_id").join(outcomes, "edge_id"), "episode_id", "left")
    n = lambda name: F.count_if(F.col("outcome") == name)
    counts = each.join(bad, "episode_id", "left").groupBy("episode_id").agg(F.count("edge_id").alias("n"), n("stored").alias("stored"), n("deferred").alias("deferred"), n("refused").alias("refused"), F.max("reason").alias("reason"))
    state = F.when(F.col("reason").isNotNull(), "refused").when(F.col("n") == 0, "no_facts").when(F.col("deferred") == F.col("n"), "retryable").when(F.col("deferred") + F.col("refused") > 0, "partial").when(F.col("stored") > 0, "stored").otherwise("unchanged")
    return wrote | {"outcomes": outcomes, "episodes": counts.select("episode_id", state.alias("state"), "reason"), "resolutions": found}


def write_batch(current: DataFrame, batch: DataFrame) -> dict[str, DataFrame]:
    """Facts after a batch, and what became of each statement. Both have edge_id, group_id, start_id, end_id, relation_type, fact,
    confidence, t_valid (current: live ones). In a scope the statements of one (start, end, relation) follow each other by time and id;
    a restatement is not written; a new version ends the one before."""
    key, value = ["group_id", "start_id", "end_id", "relation_type"], ["fact", "confidence"]
    cols = ["edge_id", *key, *value, "t_valid"]
    good = refusal(batch)
    both = current.select(*cols, F.lit(False).alias("is_new")).unionByName(good.where("reason IS NULL").select(*cols, F.lit(True).alias("is_new")))
    facts = temporal.versions(both, key, value, ["t_valid", "is_new", "edge_id"])
    written = facts.where("is_new").select("edge_id", F.lit("stored").alias("outcome"))
    refused = good.where("reason IS NOT NULL").select("edge_id", F.lit("refused").alias("outcome"))
    unchanged = batch.select("edge_id").join(written.unionByName(refused).select("edge_id"), "edge_id", "left_anti").withColumn("outcome", F.lit("unchanged"))
    return {"facts": facts.drop("is_new"), "outcomes": written.unionByName(refused).unionByName(unchanged), "audit": temporal.audit_trail(facts, key)}
