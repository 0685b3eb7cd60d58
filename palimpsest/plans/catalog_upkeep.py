"""Queries for upkeep."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph, ops, temporal, upkeep, vector
from . import fixtures as fx
from .catalog import BASE, SQL, VECTOR, _vectors, query, with_
from .catalog_more import _BODY, _OWNED, _SESSIONS, _chain, _owned


@query("SELECT doc_id AS edge_id, count(DISTINCT event_id) AS n_evidence FROM documents LEFT JOIN events ON user_id = doc_id GROUP BY doc_id")
def evidence_counts(s, d):
    links = fx.table(s, d, "events").select(F.col("user_id").alias("edge_id"), F.col("event_id").alias("evidence_id"))
    return upkeep.evidence_counts(fx.table(s, d, "documents").select(F.col("doc_id").alias("edge_id")), links)


@query("SELECT user_id AS edge_id, event_id AS evidence_id, false AS flagged, row_number() OVER (PARTITION BY user_id ORDER BY CAST(floor(epoch(ts)) AS BIGINT) DESC, event_id) AS position FROM events")
def evidence_listing(s, d):
    e = fx.table(s, d, "events")
    return upkeep.evidence_of(e.select(F.col("user_id").alias("edge_id"), F.col("event_id").alias("evidence_id")), e.select(F.col("event_id").alias("evidence_id"), fx.seconds("ts").alias("received_at"), F.col("props").alias("detail")))


@query("SELECT max(CAST(floor(epoch(ts)) AS BIGINT)) FILTER (WHERE user_id % 4 <> 0) AS organic_at, max(CAST(floor(epoch(ts)) AS BIGINT)) FILTER (WHERE user_id % 4 = 0) AS imported_at FROM events")
def last_writes(s, d):
    return upkeep.last_writes(fx.table(s, d, "events").select(F.when(F.col("user_id") % 4 == 0, "import:x").otherwise("s").alias("session_id"), fx.seconds("ts").alias("at")))


@query("WITH a AS (SELECT 'g' || (user_id % 8) AS group_id, 'v' || (event_id % 3) AS version, CAST(floor(epoch(ts)) AS BIGINT) * 1000000 + event_id AS o FROM events) SELECT group_id, arg_max(version, o) AS version, arg_max(version, o) <> 'v1' AS stale FROM a GROUP BY group_id")
def stale_writer(s, d):
    e = fx.table(s, d, "events")
    return upkeep.stale_writer(e.select(F.concat(F.lit("g"), F.col("user_id") % 8).alias("group_id"), F.concat(F.lit("v"), F.col("event_id") % 3).alias("writer_version"), fx.seconds("ts").alias("at"), F.col("event_id").alias("id")), "v1")


@query("SELECT * FROM (SELECT doc_id AS edge_id, source AS project, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id DESC) AS position FROM documents) WHERE position <= 4")
def project_brief(s, d):
    f = fx.table(s, d, "documents").select(F.col("doc_id").alias("edge_id"), F.col("source").alias("project"), F.col("n_chars").alias("t_valid"))
    return upkeep.brief(f).select("edge_id", "project", "position")


@query("SELECT CAST(floor(sum(length(text)) / 4) AS BIGINT) AS tokens FROM documents")
def corpus_tokens(s, d):
    return upkeep.corpus_tokens(fx.table(s, d, "documents").withColumnRenamed("text", "fact"))


@query(with_(_OWNED, "owned2 AS (SELECT * REPLACE ('t' || (edge_id % 60) AS session_id) FROM owned)", _SESSIONS) + "SELECT edge_id, coalesce(agent_id, author) AS agent_id FROM owned2 LEFT JOIN known USING (session_id)")
def reattribute(s, d):
    f = _owned(s, d).withColumn("session_id", F.concat(F.lit("t"), F.col("edge_id") % 60))
    return upkeep.reattribute(f, ops.attribution(f)).select("edge_id", "agent_id")


@query(with_(fx.FACTS_EVT, _BODY, "chain(group_id, seq, digest) AS (SELECT group_id, seq, 'sha256:' || sha256('genesis' || chr(10) || body) FROM link WHERE seq = 1 UNION ALL SELECT l.group_id, l.seq, 'sha256:' || sha256(c.digest || chr(10) || l.body) FROM chain c JOIN link l ON l.group_id = c.group_id AND l.seq = c.seq + 1)", recursive=True) + "SELECT group_id, max(seq) AS seq, arg_max(digest, seq) AS digest FROM chain GROUP BY group_id")
def chain_heads(s, d):
    return upkeep.chain_heads(_chain(s, d))


@query(with_(fx.FACTS_EVT) + "SELECT edge_id FROM facts_evt WHERE group_id IN ('g1', 'g2')")
def unattested(s, d):
    return upkeep.unattested(fx.facts_evt(s, d), _chain(s, d).where("group_id NOT IN ('g1', 'g2')"))


@query(with_(fx.FACTS_EVT) + "SELECT group_id, count(*) AS gone, CASE WHEN group_id = 'g1' THEN 1000000 ELSE 1 END AS erased, CASE WHEN group_id = 'g1' OR count(*) <= 1 THEN 0 ELSE count(*) END AS open FROM facts_evt WHERE edge_id % 3 = 0 GROUP BY group_id")
def chain_vanished(s, d):
    told = s.createDataFrame([(f"g{i}", 1_000_000 if i == 1 else 1) for i in range(8)], "group_id string, n_edges bigint")
    return upkeep.vanished(_chain(s, d), fx.facts_evt(s, d).where("edge_id % 3 != 0"), told)


@query("SELECT count(*) FILTER (WHERE event_type = 'purchase') AS saves, count(*) FILTER (WHERE event_type = 'signup') AS duplicates, count(*) FILTER (WHERE event_type = 'error') AS bad_merges, count(*) FILTER (WHERE event_type = 'purchase') >= 3 AND count(*) FILTER (WHERE event_type = 'signup') <= 1 AND count(*) FILTER (WHERE event_type = 'error') = 0 AS passed FROM events WHERE event_id % 5 <> 0")
def trial_report(s, d):
    kind = F.when(F.col("event_type") == "purchase", "recall_save").when(F.col("event_type") == "signup", "duplicate").when(F.col("event_type") == "error", "bad_merge").otherwise("other")
    return upkeep.trial_report(fx.table(s, d, "events").select(kind.alias("kind"), (F.col("event_id") % 5 == 0).alias("retracted")))


@query(with_(fx.FACTS_EVT) + "SELECT count(*) FILTER (WHERE group_id NOT LIKE 'g1%') AS foreign_facts FROM facts_evt")
def foreign_facts(s, d):
    return upkeep.foreign_facts(fx.facts_evt(s, d), "g1")


@query("SELECT count(*) FILTER (WHERE doc_id % 7 <> 0 AND doc_id % 11 <> 0) AS graded, count(*) FILTER (WHERE doc_id % 7 = 0 AND doc_id % 11 <> 0) AS ungraded, count(*) FILTER (WHERE doc_id % 11 = 0) AS cannot, round(avg(quality) FILTER (WHERE doc_id % 7 <> 0 AND doc_id % 11 <> 0), 6) AS accuracy FROM labels")
def qa_accuracy(s, d):
    k = F.col("doc_id")
    return upkeep.accuracy(fx.table(s, d, "labels").select(F.when(k % 7 != 0, F.col("quality")).alias("correct"), (k % 11 == 0).alias("cannot")))


@query("WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings) SELECT a.vec_id AS a, b.vec_id AS b, CAST(a.label = b.label AS INTEGER) AS label, round(list_inner_product(a.v, b.v), 6) AS score FROM v a JOIN v b ON b.vec_id = a.vec_id + 1")
def calibration_pairs(s, d):
    v = _vectors(s, d)
    a = v.select(F.col("edge_id").alias("a"), (F.col("edge_id") + 1).alias("b"), F.col("label").alias("la"))
    pairs = a.join(v.select(F.col("edge_id").alias("b"), F.col("label").alias("lb")), "b").select("a", "b", (F.col("la") == F.col("lb")).cast("int").alias("label"))
    return upkeep.label_similarity(pairs, v)


_RULES = (("silent", "attention", "quiet_days > 7"), ("one_writer", "attention", "writers < 2"), ("unattributed", "recommendation", "unattributed > 0"), ("orphans", "recommendation", "orphans > 0"), ("healthy", "strong", "score >= 80"))


@query(f"WITH h AS ({SQL['health']}) " + " UNION ALL ".join(f"SELECT '{n}' AS finding, '{k}' AS kind FROM h WHERE {c}" for n, k, c in _RULES))
def health_findings(s, d):
    return upkeep.findings(ops.health(_owned(s, d), fx.nodes(s, d), fx.kg_edges(s, d), fx.NOW))


@query()
def reindex(s, d):
    return upkeep.reindex(fx.facts_doc(s, d)).select("edge_id", F.round(F.element_at("vector", 1), 6).alias("first"), F.size("vector").alias("dimension"))


@query(with_(fx.FACTS_EVT, "n AS (SELECT DISTINCT user_id AS node, 'user ' || user_id AS name FROM events)") + "SELECT edge_id, name AS source, t_valid FROM facts_evt JOIN n ON node = start_id WHERE t_invalid IS NULL")
def graph_export(s, d):
    n = fx.table(s, d, "events").select(F.col("user_id").alias("node"), F.concat(F.lit("user "), F.col("user_id")).alias("name")).distinct()
    return upkeep.export(n, fx.facts_evt(s, d))[1].select("edge_id", "source", "t_valid")


@query(with_(*BASE[:2], VECTOR, "top AS (SELECT query_id, edge_id, rank FROM near WHERE rank <= 20)", "facts AS (SELECT edge_id, label::BIGINT AS a, 100 + CAST(substr(project, 4) AS BIGINT) AS b FROM facts_doc)", "cand AS (SELECT query_id, node, min(rank) AS best FROM (SELECT query_id, unnest([a, b]) AS node, rank FROM top JOIN facts USING (edge_id)) GROUP BY query_id, node)", "written AS (SELECT query_id, query_id % 10 AS node FROM questions)", "known AS (SELECT * FROM written UNION SELECT query_id, b FROM written JOIN facts ON a = node)", "r AS (SELECT c.*, row_number() OVER (PARTITION BY query_id ORDER BY best, node) AS rank FROM cand c ANTI JOIN known k ON k.query_id = c.query_id AND k.node = c.node)") + "SELECT query_id, node, best, rank FROM r WHERE rank <= 5")
def related_entities(s, d):
    f = fx.facts_doc(s, d)
    edges = f.select("edge_id", F.col("label").cast("bigint").alias("start_id"), (F.substring("project", 4, 9).cast("bigint") + 100).alias("end_id"))
    near = vector.vector_channel(fx.questions(s, d), f).where("rank <= 20").select("query_id", "edge_id", "rank")
    written = fx.questions(s, d).select("query_id", (F.col("query_id") % 10).alias("node"))
    return graph.related(written, near, edges)
