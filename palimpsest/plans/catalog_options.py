"""One query for each option of retrieval, and the queries of the write path, the queue, the event drain and the external scorer."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import advisory, evalkit, events, fusion, govern, graph, ingest, ops, retrieve
from . import fixtures as fx
from .catalog import _DOC_EDGES, _FLOOR, _SEED, _WEIGHTS, BASE, HYBRID, LISTS, TEXT_BASE, _doc_edges, _lists, _observations, query, sql_rrf, with_

_SCORED = "SELECT query_id, rank, edge_id, round(list_inner_product(q.vector, f.vector), 4) AS score, array_to_string(matched, ',') AS matched FROM {} JOIN questions q USING (query_id) JOIN facts_doc f USING (edge_id) WHERE rank <= 10"
_PLAIN = "SELECT query_id, rank, edge_id, NULL::DOUBLE AS score, 'lexical' AS matched FROM {} WHERE rank <= 10"


def _ask(s, d, options, queries=None, facts=None, **tables):
    found = retrieve.query_memory(queries if queries is not None else fx.questions(s, d), facts if facts is not None else fx.facts_doc(s, d), options, **tables)
    return found.withColumn("matched", F.array_join("matched", ",")).select("query_id", "rank", "edge_id", "score", "matched")


@query(with_(*TEXT_BASE) + _PLAIN.format("bm25"))
def query_lexical_only(s, d):
    return _ask(s, d, retrieve.Options(lexical_only=True), facts=fx.facts_text(s, d))


@query(with_(*BASE, "only_near AS (SELECT query_id, edge_id, rank, ['vector'] AS matched FROM near)") + _SCORED.format("only_near"))
def query_vector_only(s, d):
    return _ask(s, d, retrieve.Options(vector_only=True))


@query(with_(*BASE, "m AS (SELECT query_id, edge_id, count(*) AS matched_terms, sum(tf)::BIGINT AS tf FROM postings JOIN query_tokens USING (token) GROUP BY query_id, edge_id), words_near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY matched_terms DESC, tf DESC, edge_id) AS rank FROM m) WHERE rank <= 50)", LISTS.replace("FROM bm25", "FROM words_near"), sql_rrf("fused", "lists")) + _SCORED.format("fused"))
def query_match_count(s, d):
    return _ask(s, d, retrieve.Options(lexical_bm25=False))


@query(with_(*BASE, LISTS, sql_rrf("fused", "lists").replace("60 + rank", "10 + rank")) + _SCORED.format("fused"))
def query_rrf_k(s, d):
    return _ask(s, d, retrieve.Options(rrf_k=10))


_ADAPTIVE = _FLOOR.replace("FROM embeddings", "FROM embeddings JOIN documents ON doc_id = vec_id") + ", least AS (SELECT CASE WHEN count(*) < 435 THEN 0.15 ELSE greatest(quantile_cont(sim, 0.95), 0.15) END AS floor FROM pairs)"


@query(with_(*BASE, _ADAPTIVE, LISTS.replace("FROM near", "FROM near, least WHERE score >= round(floor, 6)"), sql_rrf("fused", "lists")) + _SCORED.format("fused"))
def query_adaptive_floor(s, d):
    return _ask(s, d, retrieve.Options(adaptive=True))


def _scoped_questions(s, d):
    langs = F.element_at(F.array(F.lit("de"), F.lit("en"), F.lit("es"), F.lit("fr")), (F.col("query_id") % 4 + 1).cast("int"))
    return fx.questions(s, d).withColumn("group_id", langs)


_OWN = "own AS (SELECT query_id, ['de', 'en', 'es', 'fr'][query_id % 4 + 1] AS group_id FROM questions), near_own AS (SELECT * FROM (SELECT query_id, edge_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, CAST(edge_id AS VARCHAR)) AS rank FROM sims JOIN own USING (query_id, group_id)) WHERE rank <= 50 AND score >= 0.15), bm25_own AS (SELECT * FROM (SELECT query_id, edge_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, edge_id) AS rank FROM bm25_all JOIN own USING (query_id, group_id)) WHERE rank <= 50)"
_OWN_LISTS = LISTS.replace("FROM near", "FROM near_own").replace("FROM bm25", "FROM bm25_own")


@query(with_(*BASE, _OWN, _OWN_LISTS, sql_rrf("fused", "lists")) + _SCORED.format("fused"))
def query_scoped(s, d):
    return _ask(s, d, retrieve.Options(), _scoped_questions(s, d))


@query(with_(*BASE, _OWN.replace("['de', 'en', 'es', 'fr'][query_id % 4 + 1]", "'en'"), _OWN_LISTS, sql_rrf("fused", "lists")) + _SCORED.format("fused"))
def query_group_id(s, d):
    return _ask(s, d, retrieve.Options(group_id="en"))


_TIMED = f"(SELECT edge_id, group_id, fact, vector, {fx.START} + edge_id * 3600 AS t_valid, CASE WHEN edge_id % 3 = 0 THEN {fx.START} + edge_id * 3600 + 864000 END AS t_invalid FROM facts_doc)"


def _timed(s, d):
    at = (F.lit(fx.START) + F.col("edge_id") * 3600).cast("bigint")
    return fx.facts_doc(s, d).withColumn("t_valid", at).withColumn("t_invalid", F.when(F.col("edge_id") % 3 == 0, at + 864000))


@query(with_(fx.FACTS_DOC, fx.QUESTIONS, f"newest AS (SELECT edge_id, row_number() OVER (ORDER BY t_valid DESC, edge_id DESC) AS rank FROM {_TIMED} WHERE t_invalid IS NULL)") + "SELECT query_id, rank, edge_id, NULL::DOUBLE AS score, '' AS matched FROM questions CROSS JOIN newest WHERE rank <= 10")
def query_digest(s, d):
    return _ask(s, d, retrieve.Options(digest=True), facts=_timed(s, d))


_PAST = f"past AS (SELECT edge_id FROM {_TIMED} WHERE t_valid <= {fx.START + 1728000} AND (t_invalid IS NULL OR t_invalid > {fx.START + 1728000})), near_past AS (SELECT * FROM (SELECT query_id, edge_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, CAST(edge_id AS VARCHAR)) AS rank FROM sims WHERE edge_id IN (FROM past)) WHERE rank <= 50 AND score >= 0.15), m AS (SELECT query_id, edge_id, count(*) AS matched_terms, sum(tf)::BIGINT AS tf FROM postings JOIN query_tokens USING (token) WHERE edge_id IN (FROM past) GROUP BY query_id, edge_id), words_past AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY matched_terms DESC, tf DESC, edge_id) AS rank FROM m) WHERE rank <= 50)"


@query(with_(*BASE, _PAST, LISTS.replace("FROM near", "FROM near_past").replace("FROM bm25", "FROM words_past"), sql_rrf("fused", "lists")) + _SCORED.format("fused"))
def query_as_of(s, d):
    return _ask(s, d, retrieve.Options(as_of=fx.START + 1728000), facts=_timed(s, d))


_ABOUT = "only_ids AS (SELECT edge_id FROM doc_edges WHERE start_id = 3 OR end_id = 3), near_about AS (SELECT * FROM (SELECT query_id, edge_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, CAST(edge_id AS VARCHAR)) AS rank FROM sims WHERE edge_id IN (FROM only_ids)) WHERE rank <= 50 AND score >= 0.15), bm25_about AS (SELECT * FROM (SELECT query_id, edge_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, edge_id) AS rank FROM bm25_all WHERE edge_id IN (FROM only_ids)) WHERE rank <= 50)"


@query(with_(*BASE, _DOC_EDGES, _ABOUT, LISTS.replace("FROM near", "FROM near_about").replace("FROM bm25", "FROM bm25_about"), sql_rrf("fused", "lists")) + _SCORED.format("fused"))
def query_about(s, d):
    nodes = s.range(10).select(F.col("id").alias("node"), F.concat(F.lit("Label "), F.col("id")).alias("name"))
    return _ask(s, d, retrieve.Options(about=["label 3"]), edges=_doc_edges(s, d), nodes=nodes)


_HOP = (_DOC_EDGES, _SEED, "hop_all AS (SELECT query_id, e.edge_id, min(seed_rank) AS seed_rank FROM touched JOIN ends e USING (node) WHERE NOT EXISTS (SELECT 1 FROM seeds s WHERE s.query_id = touched.query_id AND s.edge_id = e.edge_id) GROUP BY query_id, e.edge_id), hop AS (SELECT * FROM (SELECT query_id, edge_id, row_number() OVER (PARTITION BY query_id ORDER BY seed_rank, edge_id) AS rank FROM hop_all) WHERE rank <= 50)")
_WALKED = "walked AS (SELECT * FROM lists UNION ALL SELECT query_id, 'graph', 2, edge_id, rank FROM hop)"


@query(with_(*HYBRID, *_HOP, _WALKED, sql_rrf("fused2", "walked")) + _SCORED.format("fused2"))
def query_graph_hops(s, d):
    return _ask(s, d, retrieve.Options(graph_hops=1), edges=_doc_edges(s, d))


@query(with_(*HYBRID, *_HOP, _WALKED, sql_rrf("fused2", "walked", "CASE list_id WHEN 'graph' THEN 0.2 ELSE 1.0 END")) + _SCORED.format("fused2"))
def query_expansion_weight(s, d):
    return _ask(s, d, retrieve.Options(graph_hops=1, expansion_weight=0.2), edges=_doc_edges(s, d))


_ROUTER = "asked AS (SELECT query_id, unnest(terms) AS token FROM term_lists), enough AS (SELECT query_id FROM asked GROUP BY query_id HAVING count(DISTINCT token) >= 2), named AS (SELECT query_id, node FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY node) AS nth FROM (SELECT DISTINCT query_id, node FROM asked JOIN benchmark_nodes ON contains(lower(name), token) WHERE query_id IN (FROM enough))) WHERE nth <= 8), linked AS (SELECT DISTINCT a.query_id FROM doc_edges JOIN named a ON a.node = start_id JOIN named b ON b.node = end_id AND b.query_id = a.query_id), routed AS (SELECT query_id FROM named GROUP BY query_id HAVING count(*) >= 2 AND query_id NOT IN (FROM linked))"


@query(with_(*HYBRID, *_HOP, "benchmark_nodes AS (SELECT item_id AS node, text AS name FROM benchmark)", _ROUTER, _WALKED.replace("FROM hop", "FROM hop WHERE query_id IN (FROM routed)"), sql_rrf("fused2", "walked")) + _SCORED.format("fused2"))
def query_route_expansion(s, d):
    nodes = fx.table(s, d, "benchmark").select(F.col("item_id").alias("node"), F.col("text").alias("name"))
    return _ask(s, d, retrieve.Options(route_expansion=True), edges=_doc_edges(s, d), nodes=nodes)


_TRUSTED = f"by_trust AS (SELECT query_id, edge_id, row_number() OVER (PARTITION BY query_id ORDER BY {_WEIGHTS} DESC, rank) AS rank FROM fused LEFT JOIN states USING (edge_id)), more AS (SELECT * FROM lists UNION ALL SELECT query_id, 'trust', 4, edge_id, rank FROM by_trust)"
_KEPT = "kept AS (SELECT query_id, edge_id, list_filter(matched, lambda m: m <> 'trust') AS matched, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM fused2 f WHERE NOT EXISTS (SELECT 1 FROM states s WHERE s.edge_id = f.edge_id AND s.state = 'rejected'))"


@query(with_(*HYBRID, fx.VERIFICATIONS, _TRUSTED, sql_rrf("fused2", "more"), _KEPT) + _SCORED.format("kept"))
def query_trust(s, d):
    return _ask(s, d, retrieve.Options(trust=True), verifications=fx.verifications(s, d))


_BEHIND = "behind AS (SELECT doc_id AS edge_id, 1 + doc_id % 5 AS support, CASE WHEN quality = 1 THEN 'verified_causal' ELSE 'correlational' END AS basis FROM labels), by_lesson AS (SELECT query_id, edge_id, row_number() OVER (PARTITION BY query_id ORDER BY coalesce(support + CASE WHEN basis = 'verified_causal' THEN 0.5 ELSE 0 END, 0) DESC, rank) AS rank FROM fused LEFT JOIN behind USING (edge_id))"


def _behind(s, d):
    k = F.col("doc_id")
    return fx.table(s, d, "labels").select(k.alias("edge_id"), (1 + k % 5).alias("support"), F.when(F.col("quality") == 1, "verified_causal").otherwise("correlational").alias("basis"))


@query(with_(*HYBRID, _BEHIND, "more AS (SELECT * FROM lists UNION ALL SELECT query_id, 'lessons', 5, edge_id, rank FROM by_lesson)", sql_rrf("fused2", "more")) + _SCORED.format("fused2").replace("array_to_string(matched, ',')", "array_to_string(list_filter(matched, lambda m: m <> 'lessons'), ',')"))
def query_lessons(s, d):
    return _ask(s, d, retrieve.Options(), lessons=_behind(s, d))


@query(with_(*HYBRID, _BEHIND) + "SELECT query_id, edge_id, rank AS lesson_rank FROM by_lesson")
def lesson_rank(s, d):
    return advisory.by_lesson(fusion.rrf(_lists(s, d)), _behind(s, d)).select("query_id", "edge_id", "lesson_rank")


@query(with_(*HYBRID, "scored AS (SELECT query_id, edge_id, rank, matched, round(list_inner_product(q.vector, f.vector), 9) AS sim FROM fused JOIN questions q USING (query_id) JOIN facts_doc f USING (edge_id)), again AS (SELECT query_id, edge_id, matched, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN rank <= 50 THEN 0 ELSE 1 END, CASE WHEN rank <= 50 THEN sim END DESC, rank) AS rank FROM scored)") + _SCORED.format("again"))
def query_rerank(s, d):
    return _ask(s, d, retrieve.Options(rerank=True))


# ---- queue, sessions, reads


_QUEUE = f"queue AS (SELECT 'p' || c_custkey AS path, 'n' || c_nationkey AS project, md5(c_name) AS digest, {fx.START} + c_custkey * 60 AS noticed_at, CASE c_custkey % 5 WHEN 0 THEN 'claude-memory' WHEN 1 THEN 'project-instructions' WHEN 2 THEN 'gstack-learnings' ELSE 'other' END AS source, CASE WHEN c_custkey % 3 = 0 THEN {fx.NOW} END AS ingested_at FROM customer)"


def _queue(s, d):
    k = F.col("c_custkey")
    source = F.when(k % 5 == 0, "claude-memory").when(k % 5 == 1, "project-instructions").when(k % 5 == 2, "gstack-learnings").otherwise("other")
    return fx.table(s, d, "customer").select(F.concat(F.lit("p"), k).alias("path"), F.concat(F.lit("n"), F.col("c_nationkey")).alias("project"), F.md5(F.col("c_name").cast("binary")).alias("digest"), (fx.START + k * 60).alias("noticed_at"), source.alias("source"), F.when(k % 3 == 0, fx.NOW).alias("ingested_at"))


@query(with_(_QUEUE) + "SELECT path, project, digest, noticed_at, source, row_number() OVER (ORDER BY CASE source WHEN 'claude-memory' THEN 0 WHEN 'project-instructions' THEN 1 WHEN 'gstack-learnings' THEN 2 ELSE 3 END, project, noticed_at, path) AS position FROM queue WHERE ingested_at IS NULL")
def queue_pending(s, d):
    return ops.pending_documents(_queue(s, d))


@query(with_(_QUEUE) + f"SELECT path, coalesce(ingested_at, CASE WHEN noticed_at % 7 = 0 THEN {fx.NOW + 5} END) AS ingested_at, CASE WHEN ingested_at IS NULL AND noticed_at % 7 = 0 THEN 's1' END AS ingested_by_session, ingested_at IS NULL AND noticed_at % 7 = 0 AS closed FROM queue")
def queue_close(s, d):
    q = _queue(s, d)
    return ops.mark_ingested(q, q.where("noticed_at % 7 = 0").select("path"), fx.NOW + 5, "s1").select("path", "ingested_at", "ingested_by_session", "closed")


@query("WITH e AS (SELECT 's' || (user_id % 200) AS session_id, count(*) FILTER (WHERE event_type <> 'signup')::BIGINT AS n_edits, count(*) FILTER (WHERE event_type = 'signup') AS n_written FROM events GROUP BY 1) SELECT * FROM e")
def session_activity(s, d):
    e = fx.table(s, d, "events").withColumn("session_id", F.concat(F.lit("s"), F.col("user_id") % 200))
    return ops.session_activity(e.where("event_type != 'signup'").select("session_id", F.lit(1).alias("n_edits")), e.where("event_type = 'signup'").select("session_id", F.lit("created").alias("mutation_type")))


@query("SELECT c_custkey AS edge_id, CASE WHEN o.k IS NULL THEN 'unknown' WHEN o.who = 'O' THEN 'unattributed' ELSE o.who END AS author FROM customer LEFT JOIN (SELECT o_custkey AS k, min(o_orderstatus) AS who FROM orders GROUP BY o_custkey) o ON o.k = c_custkey")
def author_of(s, d):
    facts = fx.table(s, d, "orders").groupBy(F.col("o_custkey").alias("edge_id")).agg(F.min("o_orderstatus").alias("who")).select("edge_id", F.when(F.col("who") != "O", F.col("who")).alias("agent_id"))
    return ops.author_of(facts, fx.table(s, d, "customer").select(F.col("c_custkey").alias("edge_id")))


@query(with_(_QUEUE) + f"SELECT count(*) AS pending, count(DISTINCT project) AS projects, (SELECT CAST(floor(({fx.NOW} - max(CAST(floor(epoch(ts)) AS BIGINT))) / 86400) AS BIGINT) FROM events) AS days_since_write FROM queue WHERE ingested_at IS NULL")
def unwritten_work(s, d):
    audit = fx.table(s, d, "events").select(F.lit("created").alias("mutation_type"), fx.seconds("ts").alias("at"))
    return ops.unwritten_work(_queue(s, d), audit, fx.NOW)


@query(with_(fx.READS, "saves AS (SELECT DISTINCT edge_id, 'a' || (id % 3) AS written_by, CASE WHEN id % 11 = 0 THEN ' ' ELSE agent_id END AS recalled_by FROM reads)", "given AS (SELECT DISTINCT edge_id, agent_id FROM reads WHERE id % 2 = 0)") + "SELECT s.edge_id, written_by, recalled_by, g.edge_id IS NOT NULL AS delivered FROM saves s LEFT JOIN given g ON g.edge_id = s.edge_id AND g.agent_id = s.recalled_by WHERE trim(recalled_by) <> '' AND written_by <> recalled_by AND s.edge_id IS NOT NULL")
def recall_saves(s, d):
    r = fx.reads(s, d).where("edge_id IS NOT NULL")
    saves = r.select("edge_id", F.concat(F.lit("a"), F.col("id") % 3).alias("written_by"), F.when(F.col("id") % 11 == 0, " ").otherwise(F.col("agent_id")).alias("recalled_by"))
    return ops.recall_saves(saves, r.where("id % 2 = 0")).select("edge_id", "written_by", "recalled_by", "delivered")


@query("WITH e AS (SELECT event_type AS name, 'u' || (user_id % 40) AS label, value, ts FROM events), f AS (SELECT name, label, min(ts) AS t FROM e GROUP BY ALL), r AS (SELECT name, label, CASE WHEN row_number() OVER (PARTITION BY name ORDER BY t, label) <= 10 THEN label ELSE 'overflow' END AS series FROM f) SELECT name, series AS label, count(*) AS n, round(sum(value), 6) AS total FROM e JOIN r USING (name, label) GROUP BY name, series")
def metric_series(s, d):
    e = fx.table(s, d, "events").select(F.col("event_type").alias("name"), F.concat(F.lit("u"), F.col("user_id") % 40).alias("label"), "value", F.col("ts").alias("at"))
    more = e.limit(5).withColumn("name", F.lit("query.text"))  # refused: its key carries content
    return ops.metrics(e.unionByName(more), 10)


# ---- event drain


_WRONG = "CASE WHEN schema_version <> 1 THEN 'schema_version' WHEN NOT regexp_matches(event_id, '^[A-Za-z0-9][A-Za-z0-9._:-]{7,127}$') THEN 'event_id' WHEN event_type = 'other' THEN 'event_type' WHEN trim(agent) = '' THEN 'actor' WHEN strlen(payload) > 65536 THEN 'payload' END"


def _inbox(s, d):
    e = events.first_arrivals(fx.envelopes(s, d))
    return e.withColumn("state", F.when(F.col("arrival") % 4 == 0, "applied").otherwise("pending")).withColumn("attempts", F.lit(0))


_ONCE = "inbox AS (SELECT * EXCLUDE (reason), CASE WHEN arrival % 4 = 0 THEN 'applied' ELSE 'pending' END AS state FROM (SELECT *, row_number() OVER (PARTITION BY group_id, event_id ORDER BY received_at, arrival) AS nth FROM judged) WHERE nth = 1), turn AS (SELECT event_id AS turn_event, group_id AS turn_group FROM (SELECT * FROM inbox WHERE state = 'pending' ORDER BY received_at, event_id, group_id LIMIT 400)), after AS (SELECT i.*, turn_event IS NOT NULL AS was, CASE WHEN turn_event IS NOT NULL THEN " + _WRONG + " END AS error FROM inbox i LEFT JOIN turn ON turn_event = i.event_id AND turn_group = i.group_id AND i.state = 'pending')"


@query(with_(fx.ENVELOPES, _ONCE) + "SELECT CASE WHEN NOT was THEN state WHEN error IS NULL THEN 'applied' ELSE 'rejected' END AS state, error, CAST(was AS INTEGER) AS attempts, count(*) AS n FROM after GROUP BY ALL")
def drain_states(s, d):
    return events.drain(_inbox(s, d), 400)["inbox"].groupBy("state", "error", "attempts").agg(F.count("*").alias("n"))


@query(with_(fx.ENVELOPES, _ONCE) + "SELECT group_id, event_id, occurred_at AS t_valid, agent AS source FROM after WHERE was AND error IS NULL")
def drain_facts(s, d):
    return events.drain(_inbox(s, d), 400)["facts"].select("group_id", "event_id", "t_valid", "source")


@query(with_(fx.ENVELOPES) + "SELECT DISTINCT group_id, CASE WHEN event_type IN ('decision.recorded', 'action.executed') THEN subject ELSE subject || ' :: ' || sign END AS name, CASE event_type WHEN 'decision.recorded' THEN 'decision' WHEN 'action.executed' THEN 'action' ELSE 'outcome' END AS type FROM accepted WHERE event_type NOT IN ('evidence.attached', 'claim.verified')")
def event_nodes(s, d):
    good = events.first_arrivals(events.validate(fx.envelopes(s, d)).where("reason IS NULL"))
    return events.graph_rows(good)["nodes"]


# ---- write path


_EPISODES = "facts_in AS (SELECT o_custkey AS episode_id, o_orderkey * 1000 AS edge_id, 'c' || o_custkey AS source, CASE WHEN o_orderkey % 50 = 0 THEN 'nobody' ELSE 'p' || (o_orderkey % 7) END AS target FROM orders), names_in AS (SELECT DISTINCT episode_id, source AS name FROM facts_in UNION SELECT DISTINCT episode_id, target FROM facts_in WHERE target <> 'nobody' UNION SELECT c_custkey, 'c' || c_custkey FROM customer)"


def _episodes(s, d):
    k = F.col("o_orderkey")
    facts = fx.table(s, d, "orders").select(F.col("o_custkey").alias("episode_id"), (k * 1000).alias("edge_id"), F.concat(F.lit("c"), F.col("o_custkey")).alias("source"), F.when(k % 50 == 0, "nobody").otherwise(F.concat(F.lit("p"), k % 7)).alias("target"))
    named = facts.select("episode_id", F.col("source").alias("name")).unionByName(facts.where("target != 'nobody'").select("episode_id", F.col("target").alias("name")))
    every = named.unionByName(fx.table(s, d, "customer").select(F.col("c_custkey").alias("episode_id"), F.concat(F.lit("c"), F.col("c_custkey")).alias("name"))).distinct()
    return every, facts


@query(with_(_EPISODES) + "SELECT DISTINCT episode_id, 'unlisted_endpoint' AS reason FROM facts_in WHERE target = 'nobody'")
def episode_refusals(s, d):
    return ingest.episode_refusal(*_episodes(s, d))


# an alias of p6 and a name near p5 make those two ambiguous or known; the other names are new
@query(with_(_EPISODES, "bad AS (SELECT DISTINCT episode_id FROM facts_in WHERE target = 'nobody')", "st AS (SELECT episode_id, CASE WHEN episode_id IN (FROM bad) THEN 'refused' WHEN target = 'p5' THEN 'deferred' ELSE 'stored' END AS outcome FROM facts_in)", "c AS (SELECT episode_id, count(outcome) AS n, count(*) FILTER (WHERE outcome = 'deferred') AS d, count(*) FILTER (WHERE outcome = 'refused') AS r FROM (SELECT DISTINCT episode_id FROM names_in) LEFT JOIN st USING (episode_id) GROUP BY episode_id)") + "SELECT state, count(*) AS n FROM (SELECT CASE WHEN r > 0 THEN 'refused' WHEN n = 0 THEN 'no_facts' WHEN d = n THEN 'retryable' WHEN d > 0 THEN 'partial' ELSE 'stored' END AS state FROM c) GROUP BY state")
def episode_states(s, d):
    return _written(s, d)["episodes"].groupBy("state").agg(F.count("*").alias("n"))


def _written(s, d):
    names, facts = _episodes(s, d)
    near = F.when(F.col("name") == "p5", F.array(F.lit(1.0), F.lit(0.0))).otherwise(F.array(F.lit(0.0), F.lit(1.0)))
    entities = names.select("episode_id", F.xxhash64("name").alias("mention_id"), F.lit("g").alias("group_id"), "name", near.alias("vector"))
    nodes = s.range(1).select(F.lit(1).cast("bigint").alias("node"), F.lit("g").alias("group_id"), F.lit("fifth product").alias("name"), F.array(F.lit("p6")).alias("aliases"), F.array(F.lit(1.0), F.lit(0.0)).alias("vector"))
    said = facts.select("episode_id", "edge_id", F.lit("g").alias("group_id"), "source", "target", F.lit("ordered").alias("relation_type"), F.concat(F.lit("order "), F.col("edge_id")).alias("fact"), F.lit("extracted").alias("confidence"), F.col("edge_id").alias("t_valid"))
    none = said.select("edge_id", "group_id", F.lit(0).cast("bigint").alias("start_id"), F.lit(0).cast("bigint").alias("end_id"), "relation_type", "fact", "confidence", "t_valid").limit(0)
    return ingest.write_episodes(none, entities, said, nodes)


@query(with_(_EPISODES, "bad AS (SELECT DISTINCT episode_id FROM facts_in WHERE target = 'nobody')") + "SELECT CASE WHEN episode_id IN (FROM bad) THEN 'refused' WHEN target = 'p5' THEN 'deferred' ELSE 'stored' END AS outcome, count(*) AS n FROM facts_in GROUP BY 1")
def episode_outcomes(s, d):
    return _written(s, d)["outcomes"].groupBy("outcome").agg(F.count("*").alias("n"))


@query("SELECT c_custkey AS mention_id, CASE c_custkey % 4 WHEN 0 THEN 'explicit' WHEN 1 THEN 'explicit' WHEN 2 THEN 'refused' ELSE 'new' END AS decision, CASE c_custkey % 4 WHEN 0 THEN c_custkey WHEN 1 THEN c_custkey END AS node FROM customer")
def referent_check(s, d):
    k, c = F.col("c_custkey"), fx.table(s, d, "customer")
    nodes = c.select(k.alias("node"), F.lit("g").alias("group_id"), F.col("c_name").alias("name"), F.array(F.concat(F.lit("alias "), k)).alias("aliases"), F.array(F.lit(1.0), F.lit(0.0)).alias("vector"))
    name = F.when(k % 4 == 0, F.upper("c_name")).when(k % 4 == 1, F.concat(F.lit("ALIAS "), k)).otherwise(F.concat(F.lit("someone "), k))
    mentions = c.select(k.alias("mention_id"), F.lit("g").alias("group_id"), name.alias("name"), F.array(F.lit(0.0), F.lit(1.0)).alias("vector"))
    return ingest.resolve_explicit(mentions, c.where("c_custkey % 4 != 3").select(k.alias("mention_id"), k.alias("node")), nodes).select("mention_id", "decision", "node")


# ---- governance, trust, graph


@query(with_(fx.FACTS_TEXT) + "SELECT edge_id, fact FROM facts_text WHERE group_id = 'en' AND contains(lower(fact), 'the ')")
def substring_candidates(s, d):
    return govern.substring_candidates(fx.facts_text(s, d), "en", "The ")


@query("SELECT p_partkey AS node, CASE WHEN contains(CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN 'a:' || p_name ELSE '  ' END, ':') THEN 'separator' WHEN p_partkey % 3 = 2 THEN 'empty' END AS fault FROM part")
def scope_segments(s, d):
    k = F.col("p_partkey")
    name = F.when(k % 3 == 0, F.col("p_name")).when(k % 3 == 1, F.concat(F.lit("a:"), "p_name")).otherwise("  ")
    return fx.table(s, d, "part").select(k.alias("node"), govern.segment_fault(name).alias("fault"))


@query(with_(fx.VERIFICATIONS) + "SELECT edge_id, row_number() OVER (PARTITION BY edge_id ORDER BY id) AS nth, id, state FROM verifications")
def verification_history(s, d):
    return advisory.history(fx.verifications(s, d))


@query(with_(fx.VERIFICATIONS, "observations AS (SELECT 'd' || (user_id % 400) AS decision, CASE event_type WHEN 'purchase' THEN 'success' WHEN 'error' THEN 'failure' WHEN 'click' THEN 'mixed' ELSE 'unknown' END AS sign, state FROM events LEFT JOIN states ON edge_id = event_id % 1000), c AS (SELECT decision, sign, count(*) FILTER (WHERE state IN ('verified', 'evidence_backed')) AS support FROM observations WHERE sign IN ('success', 'failure') GROUP BY decision, sign), b AS (SELECT decision, max(support) AS best, sum(support) AS total FROM c GROUP BY decision)") + "SELECT decision, CASE WHEN total = 0 THEN 'trust' WHEN best < 2 THEN 'support' WHEN round(best / greatest(total, 1), 4) < 0.6 THEN 'agreement' ELSE 'met' END AS bar FROM b")
def lesson_bars(s, d):
    return advisory.lesson_bars(_observations(s, d), 2, 0.6)


@query(with_(fx.KG_EDGES) + "SELECT edge_id, start_id, end_id, relation_type FROM kg_edges")
def unmerge_restores(s, d):
    nodes, edges = fx.nodes(s, d).withColumn("aliases", F.array().cast("array<string>")), fx.kg_edges(s, d)
    merged = graph.merge(nodes, edges, 12, 22)
    return graph.unmerge(*merged, nodes, edges, 12, 22)[1].select("edge_id", "start_id", "end_id", "relation_type")


# ---- evaluation


_ASKED = "asked AS (SELECT item_id AS query_id, CASE WHEN item_id % 5 <> 0 THEN text END AS answer, CASE WHEN item_id % 4 <> 0 THEN ['t' || (item_id % 50), 't' || (item_id % 50 + 1)] ELSE [] END AS gold FROM benchmark)"
_RETURNED = "returned AS (SELECT query_id, rank, fact, CASE WHEN edge_id % 6 = 0 THEN [] ELSE ['t' || (edge_id % 50)] END AS turns FROM fused JOIN facts_doc USING (edge_id) WHERE rank <= 30)"
_CONTENT = "list_filter(list_distinct(regexp_extract_all(lower({}), '[a-z0-9]+')), lambda w: NOT list_contains([" + ", ".join(f"'{w}'" for w in evalkit.ANSWER_STOPWORDS) + "], w))"
_EXTERNAL = with_(*HYBRID, _ASKED, _RETURNED, f"gold AS (SELECT DISTINCT query_id, unnest(gold) AS turn FROM asked), gs AS (SELECT DISTINCT query_id, 's' || (CAST(substr(turn, 2) AS BIGINT) % 10) AS session FROM gold), need AS (SELECT query_id, count(*) AS n_gold FROM gold GROUP BY query_id), need_s AS (SELECT query_id, count(*) AS n_s FROM gs GROUP BY query_id), tr AS (SELECT query_id, rank, unnest(turns) AS turn FROM returned), met AS (SELECT query_id, turn, min(rank) AS f FROM tr JOIN gold USING (query_id, turn) GROUP BY ALL), seen AS (SELECT query_id, session, min(rank) AS f FROM (SELECT query_id, rank, 's' || (CAST(substr(turn, 2) AS BIGINT) % 10) AS session FROM tr) JOIN gs USING (query_id, session) GROUP BY ALL), wanted AS (SELECT query_id, {_CONTENT.format('answer')} AS w FROM asked WHERE answer IS NOT NULL), words_of AS (SELECT query_id, word, min(rank) AS f FROM (SELECT query_id, rank, unnest({_CONTENT.format('fact')}) AS word FROM returned) GROUP BY ALL), told AS (SELECT query_id, word, f FROM (SELECT query_id, unnest(w) AS word FROM wanted) JOIN words_of USING (query_id, word)), rate AS (SELECT query_id, count(*) AS returned, avg(CAST(len(turns) > 0 AS INTEGER)) AS rate FROM returned GROUP BY query_id)")
_AT = ", ".join(f"CASE WHEN n_gold IS NOT NULL THEN round((SELECT count(*) FROM met m WHERE m.query_id = a.query_id AND f <= {k}) / n_gold, 6) END AS recall_{k}, CASE WHEN n_gold IS NOT NULL THEN CAST(EXISTS (SELECT 1 FROM met m WHERE m.query_id = a.query_id AND f <= {k}) AS INTEGER)::DOUBLE END AS hit_{k}, CASE WHEN n_gold IS NOT NULL THEN round((SELECT count(*) FROM seen m WHERE m.query_id = a.query_id AND f <= {k}) / n_s, 6) END AS session_{k}, CASE WHEN len(w) >= 2 THEN round((SELECT count(*) FROM told m WHERE m.query_id = a.query_id AND f <= {k}) / len(w), 6) END AS answer_words_{k}" for k in evalkit.DEPTHS)


@query(_EXTERNAL + f"SELECT a.query_id, CASE WHEN n_gold IS NOT NULL THEN coalesce(round(1 / (SELECT min(f) FROM met m WHERE m.query_id = a.query_id), 6), 0) END AS rr, {_AT}, coalesce(returned, 0) AS returned, round(rate, 6) AS attribution_rate FROM asked a LEFT JOIN need USING (query_id) LEFT JOIN need_s USING (query_id) LEFT JOIN wanted USING (query_id) LEFT JOIN rate USING (query_id)")
def external_scores(s, d):
    k = F.col("item_id")
    turns = F.array(F.concat(F.lit("t"), k % 50), F.concat(F.lit("t"), k % 50 + 1))
    asked = fx.table(s, d, "benchmark").select(k.alias("query_id"), F.when(k % 5 != 0, F.col("text")).alias("answer"), F.when(k % 4 != 0, turns).otherwise(F.array().cast("array<string>")).alias("gold"))
    facts = fx.facts_doc(s, d).select("edge_id", "fact", F.when(F.col("edge_id") % 6 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("t"), F.col("edge_id") % 50))).alias("turns"))
    returned = fusion.rrf(_lists(s, d)).where("rank <= 30").join(facts, "edge_id").select("query_id", "rank", "fact", "turns")
    sessions = s.range(60).select(F.concat(F.lit("t"), F.col("id")).alias("turn"), F.concat(F.lit("s"), F.col("id") % 10).alias("session"))
    return evalkit.external_scores(asked, returned, sessions)


@query(with_("f AS (SELECT lang AS group_id, count(*) FILTER (WHERE doc_id % 3 <> 0) AS active_facts FROM documents GROUP BY lang)", "q AS (SELECT doc_id AS query_id, lang AS group_id FROM documents WHERE doc_id % 10 = 0)", "qn AS (SELECT group_id, count(*) AS questions FROM q WHERE query_id % 20 = 0 GROUP BY group_id)", "j AS (SELECT group_id, count(*) AS judged FROM (SELECT DISTINCT doc_id - doc_id % 10 AS query_id, doc_id AS edge_id FROM labels WHERE doc_id % 2 = 0) JOIN q USING (query_id) GROUP BY group_id)") + "SELECT group_id, active_facts, coalesce(questions, 0) AS questions, coalesce(judged, 0) AS judged, active_facts * coalesce(questions, 0) AS possible, active_facts * coalesce(questions, 0) > 0 AND coalesce(judged, 0) >= active_facts * coalesce(questions, 0) AS complete FROM f LEFT JOIN qn USING (group_id) LEFT JOIN j USING (group_id) WHERE active_facts > 0 OR questions > 0 OR judged > 0")
def judging_coverage(s, d):
    docs, k = fx.table(s, d, "documents"), F.col("doc_id")
    facts = docs.select(F.col("lang").alias("group_id"), F.when(k % 3 == 0, 1).alias("t_invalid"))
    asked = docs.where("doc_id % 10 = 0").select(k.alias("query_id"), F.col("lang").alias("group_id"), F.when(k % 20 == 0, 1).alias("opened_at"))
    judged = fx.table(s, d, "labels").select((k - k % 10).alias("query_id"), k.alias("edge_id"), F.when(k % 2 == 0, "a").otherwise("b").alias("judged_by"))
    return evalkit.coverage(facts, asked, judged, "a")


@query("SELECT 'g' || o_custkey AS group_id, CASE WHEN n = have THEN 'skip' WHEN have = 0 THEN 'ingest' ELSE 'clear' END AS action FROM (SELECT o_custkey, count(*) AS n, count(*) FILTER (WHERE o_orderstatus <> 'F' AND o_custkey % 3 > 0 OR o_custkey % 3 = 2) AS have FROM orders GROUP BY o_custkey)")
def resume_actions(s, d):
    o = fx.table(s, d, "orders").withColumn("group_id", F.concat(F.lit("g"), F.col("o_custkey")))
    stored = o.where("o_orderstatus != 'F' AND o_custkey % 3 > 0 OR o_custkey % 3 = 2").groupBy("group_id").agg(F.count("*").alias("n"))
    return evalkit.todo_scopes(o.groupBy("group_id").agg(F.count("*").alias("n")), stored)
