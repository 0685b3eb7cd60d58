"""Queries for record keeping, judging, recall and import."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import events, govern, ops, records
from . import fixtures as fx
from .catalog import BASE, HYBRID, _lists, _vectors, query, with_
from .catalog_more import _DOCS_AND_SAMPLES, _texts

_JUDGED = "judgements AS (SELECT doc_id % 50 AS query_id, doc_id % 97 AS edge_id, 'j' || (doc_id % 3) AS judged_by, quality AS relevant, doc_id % 7 AS at, doc_id AS id FROM labels)"


def _judgements(s, d):
    k = F.col("doc_id")
    return fx.table(s, d, "labels").select((k % 50).alias("query_id"), (k % 97).alias("edge_id"), F.concat(F.lit("j"), k % 3).alias("judged_by"), F.col("quality").alias("relevant"), (k % 7).alias("at"), k.alias("id"))


@query(with_(_JUDGED) + "SELECT query_id, edge_id, judged_by, arg_max(relevant, at * 100000000 + id) AS relevant FROM judgements GROUP BY ALL")
def judgement_upsert(s, d):
    return records.last_judgements(_judgements(s, d))


@query(with_(_JUDGED) + "SELECT judged_by, count(*) AS labels, count(*) FILTER (WHERE relevant = 1) AS yes FROM judgements GROUP BY judged_by")
def judge_listing(s, d):
    return records.judges(_judgements(s, d))


@query("WITH k AS (SELECT lang AS group_id, trim(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) AS text, false AS created FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT lang, trim(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')), true FROM documents WHERE doc_id % 2 = 1) SELECT group_id, text, bool_and(created) AS created FROM k GROUP BY group_id, text")
def question_upsert(s, d):
    t = fx.table(s, d, "documents").select("doc_id", F.col("lang").alias("group_id"), "text")
    return records.upsert_questions(t.where("doc_id % 2 = 0"), t.where("doc_id % 2 = 1"))


@query("WITH r AS (SELECT user_id % 60 AS query_id, event_type AS configuration, value AS returned, CAST(floor(epoch(ts)) AS BIGINT) AS ran_at, event_id AS id FROM events) SELECT query_id, configuration, arg_max(returned, ran_at * 1000000000 + id) AS returned FROM r GROUP BY query_id, configuration")
def latest_runs(s, d):
    e = fx.table(s, d, "events").select((F.col("user_id") % 60).alias("query_id"), F.col("event_type").alias("configuration"), F.col("value").alias("returned"), fx.seconds("ts").alias("ran_at"), F.col("event_id").alias("id"))
    return records.latest_runs(e)


@query(with_("p AS (SELECT o_custkey AS prompt_id, o_orderstatus AS group_id, count(*) AS n_facts, 1000 + o_custkey AS chars FROM orders GROUP BY o_custkey, o_orderstatus)", "b AS (SELECT *, CAST(floor(chars * n_facts / greatest(sum(n_facts) OVER (PARTITION BY prompt_id), 1)) AS BIGINT) AS base FROM p)", "c AS (SELECT *, chars - sum(base) OVER (PARTITION BY prompt_id) AS rest, row_number() OVER (PARTITION BY prompt_id ORDER BY n_facts DESC, group_id) AS nth FROM b)") + "SELECT prompt_id, group_id, base + CAST(nth <= rest AS BIGINT) AS injected_chars FROM c")
def apportion_chars(s, d):
    p = fx.table(s, d, "orders").groupBy(F.col("o_custkey").alias("prompt_id"), F.col("o_orderstatus").alias("group_id")).agg(F.count("*").alias("n_facts")).withColumn("chars", F.col("prompt_id") + 1000)
    return records.apportion(p)


_BAND = "CASE WHEN similarity >= 0.45 THEN 0.45 WHEN similarity >= 0.3 THEN 0.3 WHEN similarity >= 0.15 THEN 0.15 ELSE 0.0 END::DOUBLE"


@query(with_("pairs AS (SELECT doc_id AS a, doc_id + 1 AS b, ((doc_id * 53) % 100)::DOUBLE / 100.0 AS similarity FROM labels)", f"l AS (SELECT *, {_BAND} AS band FROM pairs WHERE similarity < 0.6)", "n AS (SELECT *, count(*) OVER (PARTITION BY band) AS population, row_number() OVER (PARTITION BY band ORDER BY md5(a || ':' || b), a, b) AS nth FROM l)") + "SELECT a, b, similarity, band, population FROM n WHERE nth <= 5")
def sample_below(s, d):
    k = F.col("doc_id")
    return records.sample_below(fx.table(s, d, "labels").select(k.alias("a"), (k + 1).alias("b"), ((k * 53 % 100).cast("double") / 100.0).alias("similarity")), 0.6, 5)


@query("WITH p AS (SELECT l_partkey AS node, 'q' || (l_suppkey % 4) AS project FROM lineitem GROUP BY ALL), s AS (SELECT node, list(project) AS p FROM p GROUP BY node), pairs AS (SELECT p_partkey AS a, p_partkey + 1 AS b FROM part) SELECT count(*) AS pairs, count(*) FILTER (WHERE x.p IS NOT NULL AND y.p IS NOT NULL AND NOT list_has_any(x.p, y.p)) AS suppressed FROM pairs LEFT JOIN s x ON x.node = a LEFT JOIN s y ON y.node = b")
def suppressed_pairs(s, d):
    p = fx.table(s, d, "lineitem").select(F.col("l_partkey").alias("node"), F.concat(F.lit("q"), F.col("l_suppkey") % 4).alias("project")).distinct()
    return records.suppressed_pairs(fx.table(s, d, "part").select(F.col("p_partkey").alias("a"), (F.col("p_partkey") + 1).alias("b")), p)


@query(with_(_DOCS_AND_SAMPLES) + "SELECT content_class, count(*) AS n FROM (SELECT CASE WHEN " + " OR ".join(f"regexp_matches(fact, '(?i){p}')" for p in tx.INSTRUCTION_SHAPES) + " THEN 'instruction_like' ELSE 'memory' END AS content_class FROM texts) GROUP BY content_class")
def content_classes(s, d):
    return records.describe(_texts(s, d)).groupBy("content_class").agg(F.count("*").alias("n"))


@query(f"SELECT coalesce(sum(user_id % 5), 0)::BIGINT AS erased FROM events WHERE event_type <> 'error' AND CAST(floor(epoch(ts)) AS BIGINT) > {fx.START + 864000}")
def erased_after(s, d):
    e = fx.table(s, d, "events").select(F.when(F.col("event_type") == "error", "planned").otherwise("completed").alias("status"), fx.seconds("ts").alias("completed_at"), (F.col("user_id") % 5).alias("n_edges"))
    return records.erased_after(e, fx.START + 864000)


_RECALL = ("each AS (SELECT query_id, group_id, edge_id, score, row_number() OVER (PARTITION BY query_id, group_id ORDER BY score DESC, edge_id) AS rank FROM bm25_all WHERE group_id IN ('en', 'fr'))", "best AS (SELECT e.*, fact, CAST(e.group_id <> 'en' AS INTEGER) AS scope_no FROM each e JOIN facts_doc USING (edge_id) WHERE rank <= 3)", "once AS (SELECT *, row_number() OVER (PARTITION BY query_id, fact ORDER BY scope_no, rank) AS nth FROM best)", "top AS (SELECT query_id, edge_id, group_id, row_number() OVER (PARTITION BY query_id ORDER BY scope_no, score DESC, edge_id) AS rank FROM once WHERE nth = 1)")


@query(with_(*BASE, *_RECALL) + "SELECT query_id, rank, edge_id, group_id FROM top WHERE rank <= 3")
def recall_for_prompt(s, d):
    return records.recall_for_prompt(fx.questions(s, d).select("query_id", "text"), fx.facts_doc(s, d), "en", "fr")


@query(with_(*HYBRID, "pooled AS (SELECT query_id, edge_id, row_number() OVER (PARTITION BY query_id ORDER BY md5(query_id || ':' || edge_id)) AS position FROM (SELECT DISTINCT query_id, edge_id FROM lists))") + "SELECT query_id, edge_id, CAST((edge_id % 2 = 0) AS INTEGER) AS relevant FROM pooled")
def judging_sheet_round_trip(s, d):
    from ..operators import evalkit

    pooled = evalkit.pool(_lists(s, d), fx.questions(s, d).select("query_id", F.lit(-1).cast("bigint").alias("edge_id")))
    sheet = records.judging_sheet(pooled, fx.facts_doc(s, d))
    even = F.regexp_extract("line", r"/(\d+)", 1).cast("bigint") % 2 == 0
    marked = sheet.withColumn("line", F.regexp_replace("line", r"^\[ \]", F.when(even, F.lit("[y]")).otherwise(F.lit("[n]"))))
    return records.read_sheet(marked)


@query(with_(fx.TURN_FACTS) + "SELECT edge_id, CASE WHEN length(fact) > 4000 THEN 'refused' WHEN source = 'assistant' THEN 'deferred' ELSE 'ready' END AS outcome FROM turn_facts")
def fact_outcomes(s, d):
    t = fx.turn_facts(s, d)
    return records.fact_outcomes(t, t.select(F.col("source").alias("name"), F.when(F.col("source") == "assistant", "ambiguous").otherwise("exact").alias("decision")))


@query(with_(_DOCS_AND_SAMPLES, "todo AS (SELECT * FROM texts WHERE edge_id % 3 <> 0 ORDER BY edge_id LIMIT 500)") + f"SELECT edge_id, CASE WHEN regexp_matches(fact, '{tx.cue_pattern()}') THEN 'ask' ELSE 'no_cue' END AS verdict FROM todo")
def causal_scan_window(s, d):
    t = _texts(s, d)
    return records.causal_verdicts(t, t.where("edge_id % 3 = 0"), tx.states_a_cue(F.col("fact")), 500)


@query("SELECT 'o:import:b' || (doc_id % 9) AS group_id, count(*) AS n FROM documents WHERE doc_id % 9 IN (0, 3, 6) GROUP BY 1 UNION ALL SELECT 'o:own', count(*) FROM labels")
def readable_scopes(s, d):
    docs = fx.table(s, d, "documents").select(F.concat(F.lit("o:import:b"), F.col("doc_id") % 9).alias("group_id"))
    every = docs.unionAll(fx.table(s, d, "labels").select(F.lit("o:own").alias("group_id")))
    reg = docs.distinct().withColumn("state", F.when(F.regexp_extract("group_id", r"b(\d+)$", 1).cast("int") % 3 == 0, "promoted").otherwise("quarantined"))
    return govern.readable_scopes(every, reg, "o:").groupBy("group_id").agg(F.count("*").alias("n"))
