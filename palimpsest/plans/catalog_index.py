"""Queries of kept indexes (postings with pruning, vectors), of names and intervals, of keyed chains and of arrays read in parts."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import expand, keychain, lineage, neargraph, nested, postings, retrieve, temporal
from ..sources import arrays
from . import fixtures as fx
from .catalog import ALL_POSTINGS, BM25, QUERY_TOKENS, TERM_LISTS, TEXT_BASE, query, sql_tokens, with_

# ---- postings


@query(with_(*TEXT_BASE) + "SELECT query_id, group_id, edge_id, score, rank FROM bm25")
def bm25_indexed(s, d):
    return postings.search(fx.lexical_index(s, d), fx.questions(s, d).select("query_id", "text"))


_EACH = "each AS (SELECT query_id, group_id, edge_id, score, row_number() OVER (PARTITION BY query_id, group_id ORDER BY score DESC, edge_id) AS rank FROM bm25_all)"


def _every_scope(s, d):
    """Each question asks each scope."""
    langs = fx.table(s, d, "documents").where("lang IS NOT NULL").select(F.col("lang").alias("group_id")).distinct()
    return fx.questions(s, d).select("query_id", "text").join(F.broadcast(langs))  # four rows


@query(with_(*TEXT_BASE, _EACH) + "SELECT * FROM each WHERE rank <= 20")
def bm25_indexed_scopes(s, d):
    return postings.search(fx.lexical_index(s, d), _every_scope(s, d), 20, by_scope=True)


_MATCHED = "m AS (SELECT query_id, edge_id, count(*) AS matched_terms, sum(tf)::BIGINT AS tf FROM postings JOIN query_tokens USING (token) GROUP BY query_id, edge_id), by_matches AS (SELECT query_id, edge_id, row_number() OVER (PARTITION BY query_id ORDER BY matched_terms DESC, tf DESC, edge_id) AS rank FROM m), fit AS (SELECT min(n_docs) >= 50 AS fit FROM scope_stats)"


@query(with_(*TEXT_BASE, _MATCHED) + "SELECT query_id, rank, edge_id, NULL::DOUBLE AS score, 'lexical' AS matched FROM (SELECT query_id, edge_id, rank FROM bm25, fit WHERE fit UNION ALL SELECT query_id, edge_id, rank FROM by_matches, fit WHERE NOT fit) WHERE rank <= 10")
def query_indexed(s, d):
    found = retrieve.query_memory(fx.questions(s, d), fx.facts_text(s, d), retrieve.Options(lexical_only=True), index=fx.lexical_index(s, d))
    return found.withColumn("matched", F.array_join("matched", ","))


# Documents are written in two turns: those of the sources before src5 and all others. Statistics are of the first turn, until they are due.
def _sql_turns(due: str) -> str:
    """Postings of all documents; statistics of the first turn, in scopes that are due of all."""
    head, rest = ALL_POSTINGS.split(", scope_stats AS", 1)
    lists = rest.split("postings AS", 1)[1].split(",\nterm_df AS", 1)[0]
    return f"""{head}, placed AS (SELECT edge_id, group_id, project < 'src5' AS old FROM facts_text),
turns AS (SELECT group_id, count(*) FILTER (WHERE old) AS before, count(*) FILTER (WHERE NOT old) AS since FROM placed GROUP BY group_id), dues AS (SELECT group_id, {due} AS due FROM turns),
counted AS (SELECT edge_id, p.group_id FROM placed p JOIN dues USING (group_id) WHERE old OR due),
scope_stats AS (SELECT w.group_id, count(*) AS n_docs, avg(len(w)) AS avg_len FROM words w JOIN counted USING (edge_id) GROUP BY w.group_id),
postings AS{lists}, term_df AS (SELECT p.group_id, token, count(c.edge_id) AS df FROM postings p LEFT JOIN counted c USING (edge_id) GROUP BY p.group_id, token)"""


def _two_turns(s, d):
    facts = fx.facts_text(s, d)
    return postings.append(postings.keep(facts.where("project < 'src5'")), facts.where("project >= 'src5'"))


_TURN_BASE = (fx.FACTS_TEXT, fx.QUESTIONS, TERM_LISTS, QUERY_TOKENS)


@query(with_(*_TURN_BASE, _sql_turns("false"), BM25) + "SELECT query_id, group_id, edge_id, score, rank FROM bm25")
def bm25_old_statistics(s, d):
    return postings.search(_two_turns(s, d), fx.questions(s, d).select("query_id", "text"))


@query(with_(*_TURN_BASE, _sql_turns("since > greatest(0.2 * before, 10)"), BM25) + "SELECT query_id, group_id, edge_id, score, rank FROM bm25")
def bm25_refreshed(s, d):
    return postings.search(postings.refresh_if_due(_two_turns(s, d)), fx.questions(s, d).select("query_id", "text"))


@query(with_(fx.FACTS_TEXT, "n AS (SELECT group_id, count(*) FILTER (WHERE project < 'src5') AS refreshed_docs, count(*) FILTER (WHERE project >= 'src5') AS writes_since FROM facts_text GROUP BY group_id)") + "SELECT group_id, refreshed_docs, writes_since, refreshed_docs >= 50 AND writes_since <= greatest(0.2 * refreshed_docs, 10) AS usable FROM n")
def index_staleness(s, d):
    return postings.staleness(_two_turns(s, d))


_FALLBACK = """m AS (SELECT query_id, group_id, edge_id, count(*) AS matched_terms, sum(tf)::BIGINT AS tf FROM postings JOIN query_tokens USING (token) GROUP BY query_id, group_id, edge_id),
m_ranked AS (SELECT query_id, group_id, edge_id, row_number() OVER (PARTITION BY query_id, group_id ORDER BY matched_terms DESC, tf DESC, edge_id) AS rank FROM m),
small AS (SELECT group_id, count(*) < 50 AS poor FROM facts_text GROUP BY group_id)"""


@query(with_(*TEXT_BASE, _EACH, _FALLBACK) + "SELECT query_id, group_id, edge_id, rank, 'bm25' AS ranker FROM each JOIN small USING (group_id) WHERE rank <= 50 AND NOT poor AND group_id <> 'de' UNION ALL SELECT query_id, group_id, edge_id, rank, 'matches' FROM m_ranked JOIN small USING (group_id) WHERE rank <= 50 AND (poor OR group_id = 'de')")
def lexical_fallback(s, d):
    """German has been written to since the refresh (half of its facts are new), the other scopes have not."""
    facts = fx.facts_text(s, d)
    late = (F.col("group_id") == "de") & (F.col("project") >= "src5")
    index = postings.append(postings.keep(facts.where(~late)), facts.where(late))
    return postings.lexical_channel(index, _every_scope(s, d), by_scope=True)


@query(with_(*TEXT_BASE, f"heads AS (SELECT group_id, token, CAST(floor(edge_id / {postings.WIDTH}) AS BIGINT) AS slot, count(*) AS n, max(tf) AS max_tf, min(dl) AS min_dl FROM postings GROUP BY ALL)") + "SELECT group_id, count(*) AS blocks, sum(n)::BIGINT AS entries, max(max_tf) AS max_tf, min(min_dl) AS min_dl FROM heads GROUP BY group_id")
def index_blocks(s, d):
    return fx.lexical_index(s, d).postings.groupBy("group_id").agg(F.count("*").alias("blocks"), F.sum("n").alias("entries"), F.max("max_tf").alias("max_tf"), F.min("min_dl").alias("min_dl"))


# ---- names


@query(with_("names AS (SELECT DISTINCT lower(text) AS name FROM documents)", fx.QUESTIONS, TERM_LISTS, "asked AS (SELECT DISTINCT unnest(terms) AS token FROM term_lists)") + "SELECT token, count(*) AS n_names FROM names, asked WHERE contains(name, token) GROUP BY token")
def names_holding(s, d):
    """Whole documents as names, the terms of all questions."""
    asked = fx.questions(s, d).select(F.explode(tx.prompt_terms(F.col("text"))).alias("token"))
    names = fx.table(s, d, "documents").select(F.lower("text").alias("name"))
    return expand.held_by(names, asked).groupBy("token").agg(F.count("*").alias("n_names"))


# ---- validity


@query(with_(fx.FACTS_EVT, "bounds AS (SELECT edge_id, CAST(floor(t_valid / 3600) AS BIGINT) AS lo, CAST(floor(least(coalesce(t_invalid - 1, 1706659200), 1706659200) / 3600) AS BIGINT) AS hi FROM facts_evt WHERE t_valid <= 1706659200)") + "SELECT group_id, count(*) AS n_facts, sum(hi - lo + 1)::BIGINT AS hours FROM bounds JOIN facts_evt USING (edge_id) GROUP BY group_id")
def hours_lived(s, d):
    """Hours that facts live until NOW, from their canonical intervals: these cover each hour once."""
    facts = fx.facts_evt(s, d).where(F.col("t_valid") <= fx.NOW)
    past = F.floor(F.least(F.coalesce(F.col("t_invalid") - 1, F.lit(fx.NOW)), F.lit(fx.NOW)) / 3600) + 1
    parts = facts.select("group_id", "edge_id", F.explode(temporal.canonical(F.floor(F.col("t_valid") / 3600), past, 12)).alias("i"))
    size = F.pow(F.lit(2.0), F.col("i.level")).cast("bigint")
    return parts.groupBy("group_id").agg(F.countDistinct("edge_id").alias("n_facts"), F.sum(size).alias("hours"))


# ---- a chain under keys that change

_RING = {"k1": "first key", "k2": "another key that is longer than a block of the hash, so that it is hashed itself before it is used", "k3": "third"}
_KEY_OF = "CASE WHEN id < 10000000 THEN CASE WHEN edge_id % 5 = 0 THEN 'unkeyed' ELSE 'k1' END WHEN edge_id % 3 = 0 THEN 'k3' ELSE 'k2' END"


def _claims(s, d):
    """Verifications as claims; the later ones are signed by other keys."""
    v = fx.verifications(s, d).withColumn("group_id", F.concat(F.lit("g"), F.col("edge_id") % 8))
    seq = F.row_number().over(Window.partitionBy("group_id").orderBy("id")).cast("bigint")
    return v.select("group_id", seq.alias("seq"), F.col("id").alias("verification_id"), F.expr(_KEY_OF).alias("key_id"), F.concat_ws("|", "edge_id", "state", "expires_at").alias("body"), "id")


def _hmac_sql(key: str, message: str) -> str:
    raw = key.encode()
    block = (hashlib.sha256(raw).digest() if len(raw) > 64 else raw).ljust(64, b"\0")
    inner, outer = (bytes(b ^ pad for b in block).hex() for pad in (0x36, 0x5C))
    return f"'hmac-sha256:' || sha256(unhex('{outer}' || sha256(unhex('{inner}' || hex({message})))))"


def _digest_sql(message: str, keys) -> str:
    return f"CASE key_id WHEN 'unkeyed' THEN 'sha256:' || sha256({message}) " + " ".join(f"WHEN '{k}' THEN {_hmac_sql(_RING[k], message)}" for k in keys) + " END"


_CHAIN_SQL = (
    f"claims AS (SELECT 'g' || (edge_id % 8) AS group_id, row_number() OVER (PARTITION BY edge_id % 8 ORDER BY id) AS seq, id, {_KEY_OF} AS key_id, edge_id || '|' || state || CASE WHEN expires_at IS NULL THEN '' ELSE '|' || expires_at END AS body FROM verifications)",
    f"chain(group_id, seq, digest) AS (SELECT DISTINCT group_id, 0::BIGINT, '{keychain.GENESIS}' FROM claims UNION ALL SELECT c.group_id, c.seq, {_digest_sql('p.digest || chr(10) || body', _RING)} FROM chain p JOIN claims c ON c.group_id = p.group_id AND c.seq = p.seq + 1)",
    "stored AS (SELECT c.*, p.digest AS prev_digest, n.digest FROM claims c JOIN chain p ON p.group_id = c.group_id AND p.seq = c.seq - 1 JOIN chain n ON n.group_id = c.group_id AND n.seq = c.seq)",
    "kept AS (SELECT *, lag(digest) OVER (PARTITION BY group_id ORDER BY seq) AS before FROM stored WHERE id % 29 <> 3)",  # links that somebody took out
    "now AS (SELECT * REPLACE (CASE WHEN id % 37 = 0 THEN body || '!' ELSE body END AS body) FROM kept)",
)


@query(with_(fx.VERIFICATIONS, *_CHAIN_SQL, f"found AS (SELECT *, coalesce(before, '{keychain.GENESIS}') <> prev_digest AS broken, CASE WHEN id % 41 = 0 THEN 'vanished' WHEN key_id = 'k3' THEN 'unverifiable' WHEN {_digest_sql('prev_digest || chr(10) || body', ('k1', 'k2'))} <> digest THEN 'altered' END AS finding FROM now)", recursive=True)
       + "SELECT group_id, count(*) AS n_attested, count_if(finding = 'altered')::BIGINT AS altered, count_if(finding = 'vanished')::BIGINT AS vanished, count_if(finding = 'unverifiable')::BIGINT AS unverifiable, count_if(broken)::BIGINT AS broken, min(key_id <> 'unkeyed') AS keyed, min(key_id <> 'unkeyed') <> max(key_id <> 'unkeyed') AS mixed_keying, array_to_string(list_sort(list(DISTINCT key_id)), ',') AS key_ids FROM found GROUP BY group_id")
def keyed_chain_report(s, d):
    """Made in two turns under three keys; checked without one of them, after links, claims and texts were changed."""
    claims = _claims(s, d)
    first = keychain.attest(claims.where("id < 10000000"), _RING)
    links = first.unionByName(keychain.attest(claims.where("id >= 10000000"), _RING, first)).where("verification_id % 29 != 3")
    body = F.when(F.col("id") % 37 == 0, F.concat("body", F.lit("!"))).otherwise(F.col("body"))
    now = claims.where("id % 41 != 0").select("verification_id", body.alias("body"))
    found = keychain.report(keychain.verify(links, now, {k: v for k, v in _RING.items() if k != "k3"}))
    return found.withColumn("key_ids", F.array_join("key_ids", ","))


# ---- arrays of JSON, vectors


@query("SELECT role, count(*) AS n, sum(length(text))::BIGINT AS chars, count(DISTINCT conv_id) AS conversations FROM conversations GROUP BY role")
def json_turns(s, d):
    """Conversations written as arrays of JSON and read back in parts."""
    turns = fx.table(s, d, "conversations")
    path = f"{lineage.shared_folder(s)}/turns-{uuid.uuid4().hex}"
    turns.groupBy("conv_id").agg(F.to_json(F.collect_list(F.struct("conv_id", "role", "text"))).alias("value")).select("value").write.text(path)
    read = arrays.json_array(s, path, "conv_id long, role string, text string")
    return read.groupBy("role").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"), F.countDistinct("conv_id").alias("conversations"))


@query()
def vector_graph_topk(s, d):
    vectors = fx.table(s, d, "embeddings").select(F.col("vec_id").alias("edge_id"), F.col("embedding").cast("array<double>").alias("vector"))
    return neargraph.search(neargraph.build(vectors), fx.questions(s, d).select("query_id", "vector"), 10).select("query_id", "edge_id", "score", "rank")


# ---- nested corpora

_SWEEP = f"""sizes(size) AS (SELECT count(*) FROM facts_text UNION ALL SELECT size // 2 FROM sizes WHERE size // 2 >= 24),
placed AS (SELECT edge_id, row_number() OVER (ORDER BY edge_id) AS place FROM facts_text),
words AS (SELECT size, edge_id, {sql_tokens('fact')} AS w FROM facts_text JOIN placed USING (edge_id) JOIN sizes ON place <= size),
scope_stats AS (SELECT size, count(*) AS n_docs, avg(len(w)) AS avg_len FROM words GROUP BY size),
postings AS (SELECT size, edge_id, token, count(*) AS tf, any_value(dl) AS dl FROM (SELECT size, edge_id, len(w) AS dl, unnest(w) AS token FROM words) GROUP BY size, edge_id, token),
term_df AS (SELECT size, token, count(*) AS df FROM postings GROUP BY size, token),
scored AS (SELECT query_id, size, edge_id, round(sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / greatest(avg_len, 1.0)))), 6) AS score
FROM postings JOIN term_df USING (size, token) JOIN scope_stats USING (size) JOIN query_tokens USING (token) GROUP BY query_id, size, edge_id)"""


@query(with_(fx.FACTS_TEXT, fx.QUESTIONS, TERM_LISTS, QUERY_TOKENS, _SWEEP, recursive=True) + "SELECT query_id, size, edge_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id, size ORDER BY score DESC, edge_id) AS rank FROM scored) WHERE rank <= 10")
def corpus_sweep(s, d):
    return nested.sweep(fx.questions(s, d), fx.facts_text(s, d), ["edge_id"], 10)


@query(with_(*TEXT_BASE, "upto AS (SELECT query_id, rank, CAST(floor(sum(length(fact)) OVER (PARTITION BY query_id ORDER BY rank) / 4) AS BIGINT) AS spent FROM bm25 JOIN facts_text USING (edge_id))") + "SELECT query_id, arm, count_if(spent <= 1000 * arm)::BIGINT AS n_facts, coalesce(max(spent) FILTER (WHERE spent <= 1000 * arm), 0) AS spent FROM upto, (SELECT unnest([1, 2, 4, 8, 16]) AS arm) GROUP BY query_id, arm")
def scratchpad_arms(s, d):
    ranked = postings.search(fx.lexical_index(s, d), fx.questions(s, d).select("query_id", "text"))
    return nested.arms(ranked, fx.facts_text(s, d), 1000)
