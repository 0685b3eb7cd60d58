"""The catalogue: each query of the engine over its whole tables, with the same result in SQL where SQL can say it."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.vectors import dot
from ..operators import advisory, causal, evalkit, events, expand, fusion, govern, graph, ingest, lexical, ops, rerank, retrieve, scopes, temporal, vector
from ..sources import bundles
from . import fixtures as fx

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = re.sub(r"'(?:[^']|'')*'|\bat\b", lambda m: '"at"' if m.group() == "at" else m.group(), sql)  # a reserved word there; literals stay
        return f

    return keep


def with_(*parts: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(parts) + "\n"


STOP = "[" + ", ".join(f"'{w}'" for w in tx.STOPWORDS) + "]"
SPLIT = r"[^\p{L}\p{N}]+"


def sql_tokens(column: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({column}), '{SPLIT}'), lambda w: w <> '' AND NOT list_contains({STOP}, w))"


TERM_LISTS = rf"""term_lists AS (SELECT query_id, list_slice(list_filter(l, lambda w, i: list_position(l, w) = i), 1, 12) AS terms FROM
(SELECT query_id, list_filter(list_transform(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}_.\-/]+'), lambda w: regexp_replace(w, '^[\-./]+|[\-./]+$', '', 'g')), lambda w: length(w) >= 3 AND NOT list_contains({STOP}, w)) AS l FROM questions))"""
QUERY_TOKENS = f"query_tokens AS (SELECT DISTINCT query_id, unnest({sql_tokens('term')}) AS token FROM (SELECT query_id, unnest(terms) AS term FROM term_lists))"
POSTINGS = f"""words AS (SELECT group_id, edge_id, {sql_tokens('fact')} AS w FROM facts_doc), scope_stats AS (SELECT group_id, count(*) AS n_docs, avg(len(w)) AS avg_len FROM words GROUP BY group_id),
postings AS (SELECT group_id, edge_id, token, count(*) AS tf, any_value(dl) AS dl FROM (SELECT group_id, edge_id, len(w) AS dl, unnest(w) AS token FROM words) GROUP BY group_id, edge_id, token),
term_df AS (SELECT group_id, token, count(*) AS df FROM postings GROUP BY group_id, token)"""
ALL_POSTINGS = POSTINGS.replace("facts_doc", "facts_text")
BM25 = """bm25_all AS (SELECT query_id, group_id, edge_id, round(sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / greatest(avg_len, 1.0)))), 6) AS score
FROM postings JOIN term_df USING (group_id, token) JOIN scope_stats USING (group_id) JOIN query_tokens USING (token) GROUP BY query_id, group_id, edge_id),
bm25 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, edge_id) AS rank FROM bm25_all) WHERE rank <= 50)"""
VECTOR = """sims AS (SELECT query_id, edge_id, group_id, round(list_inner_product(q.vector, f.vector), 9) AS score FROM questions q, facts_doc f),
near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, CAST(edge_id AS VARCHAR)) AS rank FROM sims) WHERE rank <= 50 AND score >= 0.15)"""
TEXT_BASE = (fx.FACTS_TEXT, fx.QUESTIONS, TERM_LISTS, QUERY_TOKENS, ALL_POSTINGS, BM25)
BASE = (fx.FACTS_DOC, fx.QUESTIONS, TERM_LISTS, QUERY_TOKENS, POSTINGS, BM25, VECTOR)
LISTS = "lists AS (SELECT query_id, 'vector' AS list_id, 0 AS list_no, edge_id, rank FROM near UNION ALL SELECT query_id, 'lexical', 1, edge_id, rank FROM bm25)"


def sql_rrf(name: str, source: str, weight: str = "1.0") -> str:
    return f"""{name} AS (SELECT query_id, edge_id, fused, matched, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, list_no, first_rank, edge_id) AS rank FROM
(SELECT query_id, edge_id, round(sum({weight} / (60 + rank)), 9) AS fused, arg_min(list_no, list_no * 1000 + rank) AS list_no, arg_min(rank, list_no * 1000 + rank) AS first_rank, list_sort(list(DISTINCT list_id)) AS matched FROM {source} GROUP BY query_id, edge_id))"""


HYBRID = (*BASE, LISTS, sql_rrf("fused", "lists"))


# ---- validity and versions


@query(with_(fx.FACTS_EVT) + "SELECT * FROM facts_evt WHERE t_invalid IS NULL")
def live_facts(s, d):
    return temporal.live_facts(fx.facts_evt(s, d))


@query(with_(fx.FACTS_EVT) + f"SELECT * FROM facts_evt WHERE t_valid <= {fx.START + 864000} AND (t_invalid IS NULL OR t_invalid > {fx.START + 864000})")
def facts_as_of(s, d):
    return temporal.facts_as_of(fx.facts_evt(s, d), fx.START + 864000)


@query(with_(fx.FACTS_EVT) + f"SELECT q AS query_id, count(*) AS n, sum(end_id)::BIGINT AS bands FROM facts_evt, range(0, 30) r(q) WHERE t_valid <= {fx.START} + q * 86400 AND (t_invalid IS NULL OR t_invalid > {fx.START} + q * 86400) GROUP BY q")
def facts_as_of_each_day(s, d):
    moments = s.range(30).select(F.col("id").alias("query_id"), (F.lit(fx.START) + F.col("id") * 86400).alias("moment"))
    return temporal.as_of_many(fx.facts_evt(s, d), moments).groupBy("query_id").agg(F.count("*").alias("n"), F.sum("end_id").alias("bands"))


@query(with_(fx.FACTS_EVT) + "SELECT * FROM facts_evt WHERE t_invalid IS NULL ORDER BY t_valid DESC, edge_id DESC LIMIT 20")
def digest_recent(s, d):
    return temporal.digest(fx.facts_evt(s, d), 20)


@query(with_(fx.FACTS_EVT) + "SELECT * FROM facts_evt")
def supersession_intervals(s, d):
    return fx.facts_evt(s, d)


@query(with_(fx.STATEMENTS, f"w AS (SELECT *, lag(end_id) OVER {fx._W} AS before FROM statements)") + "SELECT group_id, relation_type, count(*) AS restated FROM w WHERE before = end_id GROUP BY group_id, relation_type")
def restatement_collapse(s, d):
    return temporal.restatements(fx.statements(s, d), fx.KEY, fx.VALUE, fx.ORDER).groupBy("group_id", "relation_type").agg(F.count("*").alias("restated"))


_AUDIT = f"audit AS (SELECT edge_id AS id, t_valid AS at, CASE WHEN prev IS NULL THEN 'created' ELSE 'fact_superseded' END AS mutation_type, prev, group_id, start_id, relation_type FROM (SELECT *, lag(edge_id) OVER {fx._W} AS prev FROM facts_evt))"


def _audit(s, d):
    return temporal.audit_trail(fx.facts_evt(s, d), fx.KEY)


@query(with_(fx.FACTS_EVT, _AUDIT) + "SELECT id, at, mutation_type, group_id, start_id, relation_type, CASE WHEN prev IS NULL THEN CAST(id AS VARCHAR) ELSE prev || ',' || id END AS affected FROM audit")
def audit_trail(s, d):
    return _audit(s, d).withColumn("affected", F.array_join(F.col("affected_edge_ids").cast("array<string>"), ",")).drop("affected_edge_ids")


@query(with_(fx.FACTS_EVT, _AUDIT, "pick AS (SELECT min(prev) AS e FROM audit WHERE prev IS NOT NULL)") + "SELECT id, at, mutation_type FROM audit, pick WHERE id = e OR prev = e")
def fact_history(s, d):
    a = _audit(s, d)
    first = a.where("mutation_type = 'fact_superseded'").agg(F.min(F.element_at("affected_edge_ids", 1)).alias("e"))
    return a.join(F.broadcast(first), F.array_contains("affected_edge_ids", F.col("e"))).select("id", "at", "mutation_type")


@query(with_(fx.FACTS_EVT, _AUDIT, f"w AS (SELECT id, at, mutation_type, row_number() OVER (ORDER BY at, id) AS nth FROM audit WHERE at >= {fx.START + 864000} ORDER BY at, id LIMIT 501)") + "SELECT id, at, mutation_type, (SELECT count(*) > 500 FROM w) AS truncated FROM w WHERE nth <= 500")
def audit_log_capped(s, d):
    return temporal.capped(_audit(s, d).select("id", "at", "mutation_type"), fx.START + 864000, 500)


@query(with_(fx.FACTS_EVT, _AUDIT) + "SELECT mutation_type, count(*) AS n, max(at) AS last_at FROM audit GROUP BY mutation_type")
def mutation_counts(s, d):
    return ops.counts_by(_audit(s, d))


# ---- text and the lexical channel


@query(with_(fx.QUESTIONS.replace("questions AS (SELECT item_id AS query_id, text, CAST(embedding AS DOUBLE[]) AS vector FROM benchmark JOIN embeddings ON item_id = vec_id)", "questions AS (SELECT doc_id AS query_id, text FROM documents)"), TERM_LISTS) + "SELECT query_id, array_to_string(terms, ' ') AS terms FROM term_lists")
def prompt_terms_docs(s, d):
    return fx.table(s, d, "documents").select(F.col("doc_id").alias("query_id"), F.array_join(tx.prompt_terms(F.col("text")), " ").alias("terms"))


@query(with_(fx.FACTS_TEXT, ALL_POSTINGS) + "SELECT * FROM term_df")
def term_stats(s, d):
    return lexical.term_stats(lexical.token_table(fx.facts_text(s, d)))


@query(with_(fx.FACTS_TEXT, ALL_POSTINGS) + "SELECT group_id, n_docs, round(avg_len, 6) AS avg_len FROM scope_stats")
def scope_stats(s, d):
    return lexical.scope_stats(fx.facts_text(s, d)).withColumn("avg_len", F.round("avg_len", 6))


@query(with_(*TEXT_BASE) + "SELECT query_id, group_id, edge_id, score, rank FROM bm25")
def bm25_topk(s, d):
    return lexical.bm25(fx.questions(s, d).select("query_id", "text"), fx.facts_text(s, d))


@query(with_(*TEXT_BASE, "m AS (SELECT query_id, edge_id, count(*) AS matched_terms, sum(tf)::BIGINT AS tf FROM postings JOIN query_tokens USING (token) GROUP BY query_id, edge_id)") + "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY matched_terms DESC, tf DESC, edge_id) AS rank FROM m) WHERE rank <= 50")
def match_count_topk(s, d):
    return lexical.match_count(fx.questions(s, d).select("query_id", "text"), fx.facts_text(s, d))


@query(with_(fx.FACTS_TEXT) + "SELECT group_id, count(*) AS refreshed_docs, sum(CAST(edge_id % 10 = 0 AS INTEGER))::BIGINT AS writes_since, count(*) >= 50 AND sum(CAST(edge_id % 10 = 0 AS INTEGER)) <= greatest(0.2 * count(*), 10) AS usable FROM facts_text GROUP BY group_id")
def bm25_staleness(s, d):
    return lexical.usable(fx.facts_text(s, d).groupBy("group_id").agg(F.count("*").alias("refreshed_docs"), F.sum((F.col("edge_id") % 10 == 0).cast("int")).alias("writes_since")))


# ---- the vector channel


@query(with_(*BASE[:2], VECTOR.replace(" AND score >= 0.15", "")) + "SELECT query_id, edge_id, round(score, 6) AS score, rank FROM near")
def vector_topk(s, d):
    return vector.vector_channel(fx.questions(s, d), fx.facts_doc(s, d), None).withColumn("score", F.round("score", 6))


@query(with_(*BASE[:2], VECTOR) + "SELECT query_id, edge_id, round(score, 6) AS score, rank FROM near")
def vector_floor_topk(s, d):
    return vector.vector_channel(fx.questions(s, d), fx.facts_doc(s, d)).withColumn("score", F.round("score", 6))


_FLOOR = "few AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings ORDER BY md5(CAST(vec_id AS VARCHAR)) LIMIT 200), pairs AS (SELECT list_inner_product(a.v, b.v) AS sim FROM few a JOIN few b ON a.vec_id < b.vec_id)"


def _vectors(s, d):
    return fx.table(s, d, "embeddings").select(F.col("vec_id").alias("edge_id"), F.col("embedding").cast("array<double>").alias("vector"), "label")


@query(with_(_FLOOR) + "SELECT count(*) AS n_pairs, round(CASE WHEN count(*) < 435 THEN 0.15 ELSE greatest(quantile_cont(sim, 0.95), 0.15) END, 6) AS floor FROM pairs")
def adaptive_floor(s, d):
    return vector.adaptive_floor(_vectors(s, d))


_DUPES = "v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), p AS (SELECT a.vec_id AS x, b.vec_id AS y, round(list_inner_product(a.v, b.v), 9) AS sim FROM v a JOIN v b ON a.vec_id <> b.vec_id), k AS (SELECT *, row_number() OVER (PARTITION BY x ORDER BY sim DESC, y) AS nth FROM p)"


@query(with_(_DUPES) + "SELECT least(x, y) AS a, greatest(x, y) AS b, round(max(sim), 6) AS similarity FROM k WHERE nth <= 5 AND sim >= 0.45 GROUP BY 1, 2")
def duplicate_pairs(s, d):
    return vector.duplicate_candidates(_vectors(s, d))


@query(with_(*BASE[:2], "sims AS (SELECT query_id, edge_id, group_id, list_inner_product(q.vector, f.vector) AS score FROM questions q, facts_doc f)", "n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, edge_id) AS nth FROM sims)", "k AS (SELECT query_id, group_id, count(*) AS hits FROM n WHERE nth <= 20 GROUP BY query_id, group_id)") + "SELECT * FROM k")
def scopes_of_neighbours(s, d):
    near = vector.nearest(fx.questions(s, d), fx.facts_doc(s, d), 20)
    return near.join(fx.facts_doc(s, d).select("edge_id", "group_id"), "edge_id").groupBy("query_id", "group_id").agg(F.count("*").alias("hits"))


# ---- fusion and the whole retrieval


def _lists(s, d):
    q, f = fx.questions(s, d), fx.facts_doc(s, d)
    return fusion.as_list(vector.vector_channel(q, f), "vector", 0).unionByName(fusion.as_list(lexical.bm25(q.select("query_id", "text"), f), "lexical", 1))


@query(with_(*HYBRID) + "SELECT query_id, edge_id, fused, rank FROM fused")
def rrf_fusion(s, d):
    return fusion.rrf(_lists(s, d)).drop("matched")


@query(with_(*BASE, LISTS, sql_rrf("fused", "lists", "CASE list_id WHEN 'vector' THEN 2.0 ELSE 0.5 END")) + "SELECT query_id, edge_id, fused, rank FROM fused")
def rrf_weighted(s, d):
    return fusion.rrf(_lists(s, d), weights={"vector": 2.0, "lexical": 0.5}).drop("matched")


@query(with_(*HYBRID) + "SELECT query_id, rank, edge_id, round(list_inner_product(q.vector, f.vector), 4) AS score, array_to_string(matched, ',') AS matched FROM fused JOIN questions q USING (query_id) JOIN facts_doc f USING (edge_id) WHERE rank <= 10")
def hybrid_topk(s, d):
    return retrieve.query_memory(fx.questions(s, d), fx.facts_doc(s, d)).withColumn("matched", F.array_join("matched", ","))


@query(with_(*HYBRID, fx.VERIFICATIONS, "kept AS (SELECT query_id, edge_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM fused f WHERE NOT EXISTS (SELECT 1 FROM states s WHERE s.edge_id = f.edge_id AND s.state = 'rejected'))") + "SELECT * FROM kept WHERE rank <= 10")
def suppress_then_topk(s, d):
    return advisory.suppress(fusion.rrf(_lists(s, d)).select("query_id", "edge_id", "rank"), advisory.trust_states(fx.verifications(s, d)), 10)


@query(with_(*HYBRID, "scored AS (SELECT query_id, edge_id, rank, round(list_inner_product(q.vector, f.vector), 9) AS score FROM fused JOIN questions q USING (query_id) JOIN facts_doc f USING (edge_id))") + "SELECT query_id, edge_id, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN rank <= 50 THEN 0 ELSE 1 END, CASE WHEN rank <= 50 THEN score END DESC, rank) AS rank FROM scored")
def cosine_rerank(s, d):
    fused = fusion.rrf(_lists(s, d)).select("query_id", "edge_id", "rank")
    return rerank.by_cosine(fused, retrieve.similarity(fused, fx.questions(s, d), fx.facts_doc(s, d))).select("query_id", "edge_id", "rank")


@query()
def mmr_select(s, d):
    fused = fusion.rrf(_lists(s, d)).where("rank <= 50")
    return rerank.mmr(fused, fx.facts_doc(s, d), 10)


_SALIENCE = f"slots AS (SELECT DISTINCT edge_id, (at // 60) * 60 AS slot FROM reads), act AS (SELECT edge_id, sum(power(CAST(greatest({fx.NOW} - slot, 1) AS DOUBLE), -0.5)) AS activation FROM slots GROUP BY edge_id)"


@query(with_(*HYBRID, fx.READS, _SALIENCE) + "SELECT query_id, edge_id, row_number() OVER (PARTITION BY query_id ORDER BY round(coalesce(activation, 0), 9) DESC, rank) AS salience_rank FROM fused LEFT JOIN act USING (edge_id)")
def salience_rank(s, d):
    return advisory.by_salience(fusion.rrf(_lists(s, d)), fx.reads(s, d), fx.NOW).select("query_id", "edge_id", "salience_rank")


_WEIGHTS = "CASE coalesce(state, 'unverified') " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in advisory.TRUST_WEIGHT.items()) + " END"


@query(with_(*HYBRID, fx.VERIFICATIONS) + f"SELECT query_id, edge_id, row_number() OVER (PARTITION BY query_id ORDER BY {_WEIGHTS} DESC, rank) AS trust_rank FROM fused LEFT JOIN states USING (edge_id)")
def trust_rank(s, d):
    return advisory.by_trust(fusion.rrf(_lists(s, d)), advisory.trust_states(fx.verifications(s, d))).select("query_id", "edge_id", "trust_rank")


@query(with_(fx.VERIFICATIONS) + f"SELECT edge_id, CASE WHEN state = 'verified' AND expires_at <= {fx.NOW} THEN 'stale' ELSE state END AS state FROM states")
def trust_state(s, d):
    return advisory.trust_states(fx.verifications(s, d), fx.NOW)


@query(with_(fx.VERIFICATIONS) + "SELECT name AS state, count(edge_id) AS n FROM unnest(['verified', 'evidence_backed', 'disputed', 'unverified', 'rejected', 'stale']) t(name) LEFT JOIN states ON state = name GROUP BY name")
def trust_summary(s, d):
    return advisory.trust_summary(advisory.trust_states(fx.verifications(s, d)))


_OBS = fx.VERIFICATIONS + ", observations AS (SELECT 'd' || (user_id % 400) AS decision, event_id AS edge_id, CASE event_type WHEN 'purchase' THEN 'success' WHEN 'error' THEN 'failure' WHEN 'click' THEN 'mixed' ELSE 'unknown' END AS sign, state FROM events LEFT JOIN states ON edge_id = event_id % 1000)"


def _observations(s, d):
    e = fx.table(s, d, "events")
    sign = F.when(F.col("event_type") == "purchase", "success").when(F.col("event_type") == "error", "failure").when(F.col("event_type") == "click", "mixed").otherwise("unknown")
    states = advisory.trust_states(fx.verifications(s, d)).withColumnRenamed("edge_id", "k")
    return e.select(F.concat(F.lit("d"), F.col("user_id") % 400).alias("decision"), F.col("event_id").alias("edge_id"), sign.alias("sign"), (F.col("event_id") % 1000).alias("k")).join(states, "k", "left").drop("k")


@query(with_(_OBS, "g AS (SELECT decision, sign, count(*) AS support, min(CAST(state = 'verified' AS INTEGER)) AS sure FROM observations WHERE state IN ('verified', 'evidence_backed') AND sign IN ('success', 'failure') GROUP BY decision, sign)", "b AS (SELECT *, round(support / sum(support) OVER (PARTITION BY decision), 4) AS agreement, row_number() OVER (PARTITION BY decision ORDER BY support DESC, sign) AS nth FROM g)") + "SELECT decision, sign, support, agreement, CASE WHEN sure = 1 THEN 'verified_causal' ELSE 'correlational' END AS basis FROM b WHERE nth = 1 AND support >= 2 AND agreement >= 0.6")
def lessons(s, d):
    return advisory.lessons(_observations(s, d), agreement=0.6)


@query(with_(_OBS) + "SELECT decision, count(*) AS failures FROM observations WHERE sign = 'failure' GROUP BY decision HAVING count(*) >= 3")
def repeated_failures(s, d):
    return advisory.repeated_failures(_observations(s, d), 3)


# ---- the graph


@query(with_(fx.NODES, fx.KG_EDGES) + "SELECT DISTINCT edge_id, start_id, end_id, relation_type FROM kg_edges WHERE start_id IN (SELECT node FROM nodes WHERE lower(name) = 'asia') OR end_id IN (SELECT node FROM nodes WHERE lower(name) = 'asia')")
def about_one(s, d):
    return retrieve.about(fx.kg_edges(s, d), fx.nodes(s, d), ["Asia"]).select("edge_id", "start_id", "end_id", "relation_type")


@query(with_(fx.NODES, fx.KG_EDGES, "a AS (SELECT node FROM nodes WHERE lower(name) = 'supplier#000000001')", "b AS (SELECT node FROM nodes WHERE lower(name) = 'red widget')") + "SELECT DISTINCT edge_id, start_id, end_id, relation_type FROM kg_edges WHERE (start_id IN (FROM a) AND end_id IN (FROM b)) OR (start_id IN (FROM b) AND end_id IN (FROM a))")
def about_pair(s, d):
    return retrieve.about(fx.kg_edges(s, d), fx.nodes(s, d), ["Supplier#000000001", "Red Widget"]).select("edge_id", "start_id", "end_id", "relation_type")


_DEGREE = "degree AS (SELECT node, count(*) AS degree FROM (SELECT start_id AS node FROM kg_edges UNION ALL SELECT end_id FROM kg_edges) GROUP BY node)"


@query(with_(fx.KG_EDGES, _DEGREE) + "SELECT * FROM degree")
def degree(s, d):
    return graph.degree(fx.kg_edges(s, d))


@query(with_(fx.NODES, fx.KG_EDGES, _DEGREE, "e AS (SELECT node, name, coalesce(degree, 0) AS degree FROM nodes LEFT JOIN degree USING (node))") + "SELECT * FROM e WHERE degree >= greatest(8, 4 * (SELECT avg(degree) FROM e))")
def degree_hubs(s, d):
    return graph.hubs(fx.nodes(s, d), fx.kg_edges(s, d))


@query(with_(fx.NODES, fx.KG_EDGES) + "SELECT * FROM nodes WHERE node NOT IN (SELECT start_id FROM kg_edges UNION SELECT end_id FROM kg_edges)")
def orphans(s, d):
    return graph.orphans(fx.nodes(s, d), fx.kg_edges(s, d))


@query(with_(fx.NODES, fx.KG_EDGES, _DEGREE, "e AS (SELECT coalesce(degree, 0) AS degree FROM nodes LEFT JOIN degree USING (node))") + "SELECT count(*) AS nodes, quantile_cont(CAST(degree AS DOUBLE), 0.5) AS median_degree, round(avg(CAST(degree <= 1 AS INTEGER)), 6) AS loose_share FROM e")
def connectivity(s, d):
    return graph.connectivity(fx.nodes(s, d), fx.kg_edges(s, d))


@query(with_(fx.FACTS_EVT, "ends AS (SELECT start_id AS n FROM facts_evt WHERE t_invalid IS NULL UNION ALL SELECT end_id + 1000000 FROM facts_evt WHERE t_invalid IS NULL)", "deg AS (SELECT n, count(*) AS c FROM ends GROUP BY n)") + "SELECT edge_id, a.c + b.c AS centrality FROM facts_evt JOIN deg a ON a.n = start_id JOIN deg b ON b.n = end_id + 1000000 WHERE t_invalid IS NULL ORDER BY centrality DESC, t_valid DESC, edge_id LIMIT 40")
def scratchpad(s, d):
    live = temporal.live_facts(fx.facts_evt(s, d)).withColumn("end_id", F.col("end_id") + 1_000_000)
    return graph.scratchpad(live.select("edge_id", "start_id", "end_id", "t_valid"), live).select("edge_id", "centrality")


@query()  # tested by union-find; all nodes and edges
def components(s, d):
    return graph.components(fx.nodes(s, d), fx.kg_edges(s, d))


@query()  # tested by a sequential form; one scope for each kind of the start's scope
def communities(s, d):
    names = fx.nodes(s, d)
    start, end = names.select(F.col("node").alias("start_id"), "group_id"), names.select(F.col("node").alias("end_id"))
    return graph.communities(fx.kg_edges(s, d).select("start_id", "end_id").join(start, "start_id").join(end, "end_id"), names.select("node", "name"))


@query()
def community_summary(s, d):
    return graph.summary(communities(s, d))


_ROUND = "r{n} AS (SELECT l.node, coalesce(b.best, l.label) AS label FROM r{p} l LEFT JOIN (SELECT node, arg_max(label, votes * 1000000000000 - label) AS best FROM (SELECT g.node, x.label, count(*) AS votes FROM givers g JOIN r{p} x ON x.node = g.other GROUP BY g.node, x.label) GROUP BY node) b USING (node))"
_GIVERS = "near AS (SELECT start_id AS node, end_id AS other FROM kg_edges WHERE start_id <> end_id UNION SELECT end_id, start_id FROM kg_edges WHERE start_id <> end_id), every_degree AS (SELECT node, coalesce(degree, 0) AS degree FROM nodes LEFT JOIN degree USING (node)), hub AS (SELECT node FROM every_degree WHERE degree >= greatest(8, 4 * (SELECT avg(degree) FROM every_degree))), plain AS (SELECT * FROM near WHERE other NOT IN (FROM hub)), givers AS MATERIALIZED (SELECT * FROM plain UNION ALL SELECT * FROM near WHERE node NOT IN (SELECT node FROM plain))"
# 40 rounds at most, as the operator has; a round that changes nothing goes on changing nothing
_SPREAD = with_(fx.NODES, fx.KG_EDGES, _DEGREE, _GIVERS, "r0 AS (SELECT node, node AS label FROM nodes)", *[_ROUND.format(n=k + 1, p=k).replace(" AS (", " AS MATERIALIZED (", 1) for k in range(graph.PASSES)]) + f"SELECT node, label FROM r{graph.PASSES}"


@query(_SPREAD)
def spread_labels(s, d):
    return graph.spread_labels(fx.nodes(s, d), fx.kg_edges(s, d))


@query(with_(fx.KG_EDGES) + "SELECT edge_id, CASE WHEN start_id = 22 THEN 12 ELSE start_id END AS start_id, CASE WHEN end_id = 22 THEN 12 ELSE end_id END AS end_id, relation_type FROM kg_edges")
def merge_repoint(s, d):
    nodes = fx.nodes(s, d).withColumn("aliases", F.array().cast("array<string>"))
    return graph.merge(nodes, fx.kg_edges(s, d), 12, 22)[1].select("edge_id", "start_id", "end_id", "relation_type")


_ALIASED = "aliased AS (SELECT node, name, group_id, CASE WHEN node % 10 = 4 THEN [lower(name), 'Supplier#' || lpad(CAST(node // 10 AS VARCHAR), 9, '0')] ELSE CAST([] AS VARCHAR[]) END AS aliases FROM nodes)"


def _aliased(s, d):
    name = F.concat(F.lit("Supplier#"), F.lpad(F.floor(F.col("node") / 10).cast("string"), 9, "0"))
    return fx.nodes(s, d).withColumn("aliases", F.when(F.col("node") % 10 == 4, F.array(F.lower("name"), name)).otherwise(F.array().cast("array<string>")))


@query(with_(fx.NODES, _ALIASED, "a AS (SELECT group_id, node, unnest(aliases) AS alias FROM aliased)") + "SELECT a.group_id, a.node, alias, n.node AS other FROM a JOIN nodes n ON n.group_id = a.group_id AND lower(n.name) = lower(alias) AND n.node <> a.node")
def foreign_aliases(s, d):
    return graph.foreign_aliases(_aliased(s, d))


# ---- expansion


_DOC_EDGES = "doc_edges AS (SELECT edge_id, label AS start_id, 100 + CAST(substr(project, 4) AS BIGINT) AS end_id, CASE WHEN edge_id % 9 = 0 THEN 'led_to' END AS causal_hint FROM facts_doc)"


def _doc_edges(s, d):
    f = fx.facts_doc(s, d)
    return f.select("edge_id", F.col("label").cast("bigint").alias("start_id"), (F.substring("project", 4, 9).cast("bigint") + 100).alias("end_id"), F.when(F.col("edge_id") % 9 == 0, "led_to").alias("causal_hint"))


def _seeds(s, d):
    return fusion.rrf(_lists(s, d)).where(F.col("rank") <= expand.SEEDS).select("query_id", "edge_id", "rank")


_SEED = "seeds AS (SELECT query_id, edge_id, rank FROM fused WHERE rank <= 5), ends AS (SELECT edge_id, start_id AS node FROM doc_edges UNION SELECT edge_id, end_id FROM doc_edges), touched AS (SELECT query_id, node, min(rank) AS seed_rank FROM seeds JOIN ends USING (edge_id) GROUP BY query_id, node)"


@query(with_(*HYBRID, _DOC_EDGES, _SEED, "n AS (SELECT query_id, e.edge_id, min(seed_rank) AS seed_rank FROM touched JOIN ends e USING (node) WHERE NOT EXISTS (SELECT 1 FROM seeds s WHERE s.query_id = touched.query_id AND s.edge_id = e.edge_id) GROUP BY query_id, e.edge_id)") + "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY seed_rank, edge_id) AS rank FROM n) WHERE rank <= 50")
def graph_hop(s, d):
    return expand.structural_hop(_seeds(s, d), _doc_edges(s, d))


@query(with_(*HYBRID, _DOC_EDGES, _SEED, "hinted AS (SELECT edge_id, node FROM ends JOIN doc_edges USING (edge_id) WHERE causal_hint IS NOT NULL)", "one AS (SELECT query_id, h.edge_id, min(seed_rank) AS seed_rank FROM touched JOIN hinted h USING (node) GROUP BY query_id, h.edge_id)", "far AS (SELECT one.query_id, h.node, min(one.seed_rank) AS seed_rank FROM one JOIN hinted h USING (edge_id) WHERE NOT EXISTS (SELECT 1 FROM touched t WHERE t.query_id = one.query_id AND t.node = h.node) GROUP BY one.query_id, h.node)", "two AS (SELECT query_id, e.edge_id, min(seed_rank) AS seed_rank FROM far JOIN ends e USING (node) GROUP BY query_id, e.edge_id)", "u AS (SELECT query_id, edge_id, 1 AS tier, seed_rank FROM one UNION ALL SELECT query_id, edge_id, 2, seed_rank FROM two)", "b AS (SELECT query_id, edge_id, min(tier) AS tier, arg_min(seed_rank, tier * 1000 + seed_rank) AS seed_rank FROM u GROUP BY query_id, edge_id)") + "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY tier, seed_rank, edge_id) AS rank FROM b WHERE NOT EXISTS (SELECT 1 FROM seeds s WHERE s.query_id = b.query_id AND s.edge_id = b.edge_id)) WHERE rank <= 50")
def authored_hop(s, d):
    return expand.authored_hop(_seeds(s, d), _doc_edges(s, d))


_COLOURS = "asked AS (SELECT c_custkey AS query_id, unnest(['red', lower(c_mktsegment), 'widget', 'n' || c_nationkey]) AS token FROM customer)"


def _colours(s, d):
    return fx.table(s, d, "customer").select(F.col("c_custkey").alias("query_id"), F.explode(F.array(F.lit("red"), F.lower("c_mktsegment"), F.lit("widget"), F.concat(F.lit("n"), F.col("c_nationkey")))).alias("token"))


_NEEDS = "named AS (SELECT query_id, node FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY node) AS nth FROM (SELECT DISTINCT query_id, node FROM asked JOIN nodes ON contains(lower(name), token))) WHERE nth <= 8), linked AS (SELECT a.query_id, count(DISTINCT edge_id) AS n_linked FROM kg_edges JOIN named a ON a.node = start_id JOIN named b ON b.node = end_id AND b.query_id = a.query_id GROUP BY a.query_id)"


@query(with_(fx.NODES, fx.KG_EDGES, "asked AS (SELECT n_nationkey AS query_id, unnest(['asia', lower(n_name), 'urop', 'tomer#00000000' || (n_nationkey % 7)]) AS token FROM nation)", _NEEDS) + "SELECT query_id, count(*) AS n_named, coalesce(any_value(n_linked), 0) AS n_linked, count(*) >= 2 AND coalesce(any_value(n_linked), 0) = 0 AS expand FROM named LEFT JOIN linked USING (query_id) GROUP BY query_id")
def needs_expansion(s, d):
    k = F.col("n_nationkey")
    asked = fx.table(s, d, "nation").select(k.alias("query_id"), F.explode(F.array(F.lit("asia"), F.lower("n_name"), F.lit("urop"), F.concat(F.lit("tomer#00000000"), (k % 7).cast("string")))).alias("token"))
    return expand.needs_expansion(asked, fx.nodes(s, d), fx.kg_edges(s, d))


# ---- scopes


_SCOPED = "scoped_edges AS (SELECT 'supply' AS group_id, edge_id, start_id, end_id FROM kg_edges WHERE start_id % 10 IN (2, 4) UNION ALL SELECT 'sales', edge_id, start_id, end_id FROM kg_edges WHERE start_id % 10 = 3 UNION ALL SELECT 'geo', edge_id, start_id, end_id FROM kg_edges WHERE start_id % 10 = 1)"
_SEGMENTS = "asked AS (SELECT DISTINCT hash_id AS query_id, unnest(['red', 'widget', 'asia', seg, 'customer']) AS token FROM (SELECT DISTINCT ascii(c_mktsegment) AS hash_id, lower(c_mktsegment) AS seg FROM customer))"
_SCORES = "scores AS (SELECT query_id, group_id, matched_terms, coalesce(candidate_facts, 0) AS candidate_facts, round(matched_terms / n_terms * (0.75 + 0.25 * coalesce(candidate_facts, 0) / (coalesce(candidate_facts, 0) + 10)), 6) AS score FROM (SELECT query_id, group_id, count(DISTINCT token) AS matched_terms FROM hits GROUP BY query_id, group_id) LEFT JOIN (SELECT query_id, h.group_id, count(DISTINCT edge_id) AS candidate_facts FROM few h JOIN scoped_edges e ON e.group_id = h.group_id AND (e.start_id = h.node OR e.end_id = h.node) GROUP BY query_id, h.group_id) USING (query_id, group_id) JOIN (SELECT query_id, count(DISTINCT token) AS n_terms FROM asked GROUP BY query_id) USING (query_id))"
_ROUTE = (fx.NODES, fx.KG_EDGES, _SCOPED, _SEGMENTS, "hits AS (SELECT query_id, token, group_id, node FROM asked JOIN nodes ON contains(lower(name), token))", "few AS (SELECT query_id, group_id, node FROM (SELECT *, row_number() OVER (PARTITION BY query_id, group_id ORDER BY node) AS nth FROM (SELECT DISTINCT query_id, group_id, node FROM hits)) WHERE nth <= 32)", _SCORES)


def _scores(s, d):
    seg = fx.table(s, d, "customer").select(F.ascii("c_mktsegment").alias("query_id"), F.lower("c_mktsegment").alias("seg")).distinct()
    asked = seg.select("query_id", F.explode(F.array(F.lit("red"), F.lit("widget"), F.lit("asia"), F.col("seg"), F.lit("customer"))).alias("token"))
    scope = F.when(F.col("start_id") % 10 == 3, "sales").when(F.col("start_id") % 10 == 1, "geo").otherwise("supply")
    return scopes.score_scopes(asked, fx.nodes(s, d), fx.kg_edges(s, d).withColumn("group_id", scope))


@query(with_(*_ROUTE) + "SELECT * FROM scores")
def scope_scores(s, d):
    return _scores(s, d)


@query(with_(*_ROUTE, "n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY (group_id = 'geo') DESC, (score > 0.3) DESC, score DESC, group_id) AS nth FROM scores)", "r AS (SELECT *, CASE WHEN group_id = 'geo' THEN 'default' WHEN score <= 0.3 THEN 'below_threshold' WHEN nth > 2 THEN 'over_limit' ELSE 'chosen' END AS reason FROM n)") + "SELECT query_id, group_id, score, reason, reason IN ('default', 'chosen') AS read FROM r")
def scope_choose(s, d):
    return scopes.choose(_scores(s, d), "geo", 2, 0.3)


@query(with_(*_ROUTE) + "SELECT query_id, group_id, round(CASE WHEN max(score) OVER (PARTITION BY query_id) > 0 THEN greatest(0.1, score / max(score) OVER (PARTITION BY query_id)) ELSE 1 END, 6) AS weight FROM scores")
def scope_weights(s, d):
    return scopes.weights(_scores(s, d)).select("query_id", "group_id", "weight")


_LANGS = "langs AS (SELECT lang AS group_id, row_number() OVER (ORDER BY lang) AS position FROM (SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL))"
_DOC_GRAPH = "doc_nodes AS (SELECT item_id AS node, text AS name, group_id FROM benchmark JOIN langs ON position = item_id % 4 + 1), doc_links AS (SELECT edge_id, group_id, CAST(label AS BIGINT) AS start_id, edge_id % 97 AS end_id, CASE WHEN edge_id % 9 = 0 THEN 'led_to' END AS causal_hint FROM facts_doc)"
_DOC_SCORES = _SCORES.replace("scoped_edges", "doc_links")
_DOC_ROUTE = (_LANGS, _DOC_GRAPH, "asked AS (SELECT query_id, unnest(terms) AS token FROM term_lists)", "hits AS (SELECT query_id, token, group_id, node FROM asked JOIN doc_nodes ON contains(lower(name), token))", "few AS (SELECT query_id, group_id, node FROM (SELECT *, row_number() OVER (PARTITION BY query_id, group_id ORDER BY node) AS nth FROM (SELECT DISTINCT query_id, group_id, node FROM hits)) WHERE nth <= 32)", _DOC_SCORES,
"every AS (SELECT q.query_id, l.group_id, l.position, coalesce(s.score, 0) AS score FROM questions q CROSS JOIN langs l LEFT JOIN scores s ON s.query_id = q.query_id AND s.group_id = l.group_id)",
"nths AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY (score > 0.5) DESC, score DESC, group_id) AS nth FROM every)",
"reasons AS (SELECT *, CASE WHEN score <= 0.5 THEN 'below_threshold' WHEN nth > 2 THEN 'over_limit' ELSE 'chosen' END AS why FROM nths)",
"lost AS (SELECT query_id FROM reasons GROUP BY query_id HAVING count(*) FILTER (WHERE why = 'chosen') = 0)",
"routing AS (SELECT query_id, group_id, position, score, CASE WHEN query_id IN (FROM lost) AND position <= 2 THEN 'fallback' ELSE why END AS reason FROM reasons)",
"reading AS (SELECT query_id, group_id, position, round(CASE WHEN max(score) OVER (PARTITION BY query_id) > 0 THEN greatest(0.1, score / max(score) OVER (PARTITION BY query_id)) ELSE 1 END, 6) AS weight FROM routing WHERE reason IN ('chosen', 'fallback'))")
_PER_SCOPE = (
"near_of AS (SELECT * FROM (SELECT s.query_id, s.group_id, edge_id, score, row_number() OVER (PARTITION BY s.query_id, s.group_id ORDER BY score DESC, CAST(edge_id AS VARCHAR)) AS rank FROM sims s JOIN reading USING (query_id, group_id)) WHERE rank <= 50 AND score >= 0.15)",
"bm25_of AS (SELECT * FROM (SELECT b.query_id, b.group_id, edge_id, row_number() OVER (PARTITION BY b.query_id, b.group_id ORDER BY score DESC, edge_id) AS rank FROM bm25_all b JOIN reading USING (query_id, group_id)) WHERE rank <= 50)",
"lists_of AS (SELECT query_id, group_id, 0 AS list_no, edge_id, rank FROM near_of UNION ALL SELECT query_id, group_id, 1, edge_id, rank FROM bm25_of)",
"per_scope AS (SELECT *, row_number() OVER (PARTITION BY query_id, group_id ORDER BY fused DESC, list_no, first_rank, edge_id) AS rank FROM (SELECT query_id, group_id, edge_id, round(sum(1.0 / (60 + rank)), 9) AS fused, arg_min(list_no, list_no * 1000 + rank) AS list_no, arg_min(rank, list_no * 1000 + rank) AS first_rank FROM lists_of GROUP BY query_id, group_id, edge_id))",
"across_ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, CAST(edge_id AS VARCHAR)) AS rank FROM (SELECT query_id, edge_id, any_value(p.group_id) AS group_id, round(sum(weight / (60 + rank)), 9) AS fused FROM per_scope p JOIN reading USING (query_id, group_id) WHERE rank <= 30 GROUP BY query_id, edge_id))")
_ACROSS = (*BASE, *_DOC_ROUTE, *_PER_SCOPE)


def _langs(s, d):
    return fx.table(s, d, "documents").where("lang IS NOT NULL").select(F.col("lang").alias("group_id")).distinct().withColumn("position", F.row_number().over(Window.orderBy("group_id")))  # four rows


def _doc_graph(s, d):
    nodes = fx.table(s, d, "benchmark").withColumn("position", F.col("item_id") % 4 + 1).join(_langs(s, d), "position").select(F.col("item_id").alias("node"), F.col("text").alias("name"), "group_id")
    links = fx.facts_doc(s, d).select("edge_id", "group_id", F.col("label").cast("bigint").alias("start_id"), (F.col("edge_id") % 97).alias("end_id"), F.when(F.col("edge_id") % 9 == 0, "led_to").alias("causal_hint"))
    return nodes, links


def _doc_scores(s, d):
    asked = fx.questions(s, d).select("query_id", F.explode(tx.prompt_terms(F.col("text"))).alias("token"))
    return scopes.score_scopes(asked, *_doc_graph(s, d))


@query(with_(*BASE[:3], *_DOC_ROUTE) + "SELECT r.query_id, r.group_id, round(r.score, 6) AS score, reason, weight FROM routing r LEFT JOIN reading USING (query_id, group_id)")
def scope_routing(s, d):
    routed = scopes.route(fx.questions(s, d), _langs(s, d), _doc_scores(s, d), most=2, least=0.5)
    return routed.select("query_id", "group_id", "score", "reason", "weight")


@query(with_(*_ACROSS) + "SELECT query_id, edge_id, group_id, fused, rank FROM across_ranked WHERE rank <= 10")
def query_across(s, d):
    read = scopes.route(fx.questions(s, d), _langs(s, d), _doc_scores(s, d), most=2, least=0.5).where("read")
    return scopes.query_across(fx.questions(s, d), fx.facts_doc(s, d), read).select("query_id", "edge_id", "group_id", "fused", "rank")


@query(with_(*_ACROSS, "spent AS (SELECT query_id, edge_id, rank, CAST(floor(sum(length(fact)) OVER (PARTITION BY query_id ORDER BY rank) / 4) AS BIGINT) AS spent FROM across_ranked JOIN facts_doc USING (edge_id) WHERE rank <= 10)") + "SELECT * FROM spent WHERE spent <= 2000")
def token_budget(s, d):
    found = scopes.assemble(fx.questions(s, d), fx.facts_doc(s, d), _langs(s, d), _doc_scores(s, d), budget=2000, most=2, least=0.5)
    return found["facts"].select("query_id", "edge_id", "rank", "spent")


# ---- causes


_ORIENTED = "steps AS (SELECT edge_id, CASE WHEN causal_hint = 'led_to' THEN start_id ELSE end_id END AS cause, CASE WHEN causal_hint = 'led_to' THEN end_id ELSE start_id END AS effect, causal_hint AS hint FROM causal_edges WHERE causal_hint <> 'contradicts')"


def _causal_seeds(s, d):
    top = fx.table(s, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(3)
    return top.select(F.lit(1).alias("query_id"), (F.col("o_orderkey") * 2).alias("node"))


def _sql_trace(known: str, wanted: str) -> str:
    hop = lambda n: f"hop{n} AS (SELECT edge_id, {n} AS hop, hint, {wanted} AS nxt, f.path || ',' || edge_id AS path FROM f{n} f JOIN steps ON {known} = f.node WHERE edge_id NOT IN (SELECT edge_id FROM used{n - 1})), used{n} AS (SELECT edge_id FROM used{n - 1} UNION ALL SELECT edge_id FROM hop{n}), f{n + 1} AS (SELECT nxt AS node, arg_min(path, edge_id) AS path FROM hop{n} WHERE nxt NOT IN (SELECT node FROM seen{n}) GROUP BY nxt), seen{n + 1} AS (SELECT node FROM seen{n} UNION ALL SELECT node FROM f{n + 1})"
    start = "f1 AS (SELECT o_orderkey * 2 AS node, '' AS path FROM (SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 3)), seen1 AS (SELECT node FROM f1), used0 AS (SELECT CAST(NULL AS BIGINT) AS edge_id WHERE false)"
    return with_(fx.CAUSAL_EDGES, _ORIENTED, start, hop(1), hop(2), hop(3)) + "SELECT edge_id, hop, hint, ltrim(path, ',') AS path FROM (SELECT * FROM hop1 UNION ALL SELECT * FROM hop2 UNION ALL SELECT * FROM hop3)"


def _trace(s, d, up):
    return causal.trace(_causal_seeds(s, d), fx.causal_edges(s, d), up).select("edge_id", "hop", "hint", F.array_join(F.col("path").cast("array<string>"), ",").alias("path"))


@query(_sql_trace("effect", "cause"))
def trace_cause_up(s, d):
    return _trace(s, d, True)


@query(_sql_trace("cause", "effect"))
def trace_cause_down(s, d):
    return _trace(s, d, False)


_CHAINS = "found AS (SELECT * FROM hop1 UNION ALL SELECT * FROM hop2 UNION ALL SELECT * FROM hop3)"


@query(_sql_trace("effect", "cause").rsplit("SELECT edge_id, hop, hint", 1)[0].rstrip() + ", " + _CHAINS + " SELECT edge_id, hop, ltrim(path, ',') AS path FROM found f WHERE NOT EXISTS (SELECT 1 FROM found x WHERE regexp_replace(x.path, ',[0-9]+$', '') = f.path)")
def trace_cause_chains(s, d):
    return causal.maximal(causal.trace(_causal_seeds(s, d), fx.causal_edges(s, d))).select("edge_id", "hop", F.array_join(F.col("path").cast("array<string>"), ",").alias("path"))


@query(with_(fx.CAUSAL_EDGES, "seeds AS (SELECT o_orderkey * 2 AS node FROM (SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 3))") + "SELECT DISTINCT edge_id FROM causal_edges JOIN seeds ON start_id = node OR end_id = node WHERE causal_hint = 'contradicts'")
def contradictions(s, d):
    return causal.contradictions(_causal_seeds(s, d), fx.causal_edges(s, d)).select("edge_id")
