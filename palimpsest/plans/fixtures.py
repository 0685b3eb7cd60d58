"""Derived tables over the test data, each as DataFrame and as SQL of the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import lineage, postings, temporal

NOW = 1706659200  # 2024-01-31 00:00:00
START = 1704067200


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seconds(column: str):
    return F.floor(F.col(column).cast("timestamp").cast("double")).cast("bigint")


def facts_doc(spark: SparkSession, d: str) -> DataFrame:
    """Documents that have a vector, as facts: scope = language."""
    docs, vec = table(spark, d, "documents"), table(spark, d, "embeddings")
    return docs.join(vec, docs["doc_id"] == vec["vec_id"]).select(F.col("doc_id").alias("edge_id"), F.col("lang").alias("group_id"), F.col("text").alias("fact"), F.col("source").alias("project"), "label", F.col("embedding").cast("array<double>").alias("vector"))


FACTS_DOC = "facts_doc AS (SELECT doc_id AS edge_id, lang AS group_id, text AS fact, source AS project, label, CAST(embedding AS DOUBLE[]) AS vector FROM documents JOIN embeddings ON doc_id = vec_id)"


def facts_text(spark: SparkSession, d: str) -> DataFrame:
    """All documents as facts, with a vector or not: what the lexical channel ranks."""
    return table(spark, d, "documents").select(F.col("doc_id").alias("edge_id"), F.col("lang").alias("group_id"), F.col("text").alias("fact"), F.col("source").alias("project"))


FACTS_TEXT = "facts_text AS (SELECT doc_id AS edge_id, lang AS group_id, text AS fact, source AS project FROM documents)"


_INDEXES: dict[tuple[str, str, str], postings.Index] = {}


def lexical_index(spark: SparkSession, d: str) -> postings.Index:
    """The kept index of facts_text: made in the shared folder by the first query that asks for it, read by all others of the application."""
    key = (spark.sparkContext.applicationId, d, lineage.shared_folder(spark))
    if key not in _INDEXES:
        _INDEXES[key] = postings.keep(facts_text(spark, d))
    return _INDEXES[key]


def questions(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark passages as queries, with the vector of the same number."""
    b, v = table(spark, d, "benchmark"), table(spark, d, "embeddings")
    return b.join(v, b["item_id"] == v["vec_id"]).select(F.col("item_id").alias("query_id"), "text", F.col("embedding").cast("array<double>").alias("vector"))


QUESTIONS = "questions AS (SELECT item_id AS query_id, text, CAST(embedding AS DOUBLE[]) AS vector FROM benchmark JOIN embeddings ON item_id = vec_id)"


def statements(spark: SparkSession, d: str) -> DataFrame:
    """Events as statements: a user's band for each kind of event."""
    e = table(spark, d, "events")
    return e.select(F.col("event_id").alias("edge_id"), F.concat(F.lit("g"), F.col("user_id") % 8).alias("group_id"), F.col("user_id").alias("start_id"), F.col("event_type").alias("relation_type"), F.floor(F.col("value") / 100).cast("bigint").alias("end_id"), seconds("ts").alias("t_valid"))


STATEMENTS = "statements AS (SELECT event_id AS edge_id, 'g' || (user_id % 8) AS group_id, user_id AS start_id, event_type AS relation_type, CAST(floor(value / 100) AS BIGINT) AS end_id, CAST(floor(epoch(ts)) AS BIGINT) AS t_valid FROM events)"

KEY, VALUE, ORDER = ["group_id", "start_id", "relation_type"], ["end_id"], ["t_valid", "edge_id"]


def facts_evt(spark: SparkSession, d: str) -> DataFrame:
    return temporal.versions(statements(spark, d), KEY, VALUE, ORDER)


_W = "(PARTITION BY group_id, start_id, relation_type ORDER BY t_valid, edge_id)"
FACTS_EVT = STATEMENTS + f""", changed AS (SELECT * FROM (SELECT *, lag(end_id) OVER {_W} AS before FROM statements) WHERE before IS NULL OR before <> end_id),
facts_evt AS (SELECT edge_id, group_id, start_id, relation_type, end_id, t_valid, lead(t_valid) OVER {_W} AS t_invalid FROM changed)"""


def nodes(spark: SparkSession, d: str) -> DataFrame:
    """Entities: regions, nations, suppliers, customers, parts with ids that do not meet."""
    def part(name: str, key: str, label: str, base: int, scope: str) -> DataFrame:
        return table(spark, d, name).select((F.col(key) * 10 + base).cast("bigint").alias("node"), F.col(label).alias("name"), F.lit(scope).alias("group_id"))

    out = part("region", "r_regionkey", "r_name", 0, "geo")
    for args in (("nation", "n_nationkey", "n_name", 1, "geo"), ("supplier", "s_suppkey", "s_name", 2, "supply"), ("customer", "c_custkey", "c_name", 3, "sales"), ("part", "p_partkey", "p_name", 4, "supply")):
        out = out.unionByName(part(*args))
    return out


NODES = """nodes AS (SELECT CAST(r_regionkey * 10 AS BIGINT) AS node, r_name AS name, 'geo' AS group_id FROM region UNION ALL SELECT CAST(n_nationkey * 10 + 1 AS BIGINT), n_name, 'geo' FROM nation
UNION ALL SELECT s_suppkey * 10 + 2, s_name, 'supply' FROM supplier UNION ALL SELECT c_custkey * 10 + 3, c_name, 'sales' FROM customer UNION ALL SELECT p_partkey * 10 + 4, p_name, 'supply' FROM part)"""


def kg_edges(spark: SparkSession, d: str) -> DataFrame:
    """located_in, part_of and supplied_by edges; ids come from their ends, so no order is needed to number them."""
    c = table(spark, d, "customer").select((F.col("c_custkey") * 10 + 3).alias("start_id"), (F.col("c_nationkey") * 10 + 1).cast("bigint").alias("end_id"), F.lit("located_in").alias("relation_type"), (F.col("c_custkey") * 10 + 3).alias("edge_id"))
    s = table(spark, d, "supplier").select((F.col("s_suppkey") * 10 + 2).alias("start_id"), (F.col("s_nationkey") * 10 + 1).cast("bigint").alias("end_id"), F.lit("located_in").alias("relation_type"), (F.col("s_suppkey") * 10 + 2).alias("edge_id"))
    n = table(spark, d, "nation").select((F.col("n_nationkey") * 10 + 1).cast("bigint").alias("start_id"), (F.col("n_regionkey") * 10).cast("bigint").alias("end_id"), F.lit("part_of").alias("relation_type"), (F.col("n_nationkey") * 10 + 1).cast("bigint").alias("edge_id"))
    p = table(spark, d, "lineitem").select("l_partkey", "l_suppkey").distinct().select((F.col("l_partkey") * 10 + 4).alias("start_id"), (F.col("l_suppkey") * 10 + 2).alias("end_id"), F.lit("supplied_by").alias("relation_type"), (F.col("l_partkey") * 100_000_000 + F.col("l_suppkey") * 10 + 4).alias("edge_id"))
    return c.unionByName(s).unionByName(n).unionByName(p)


KG_EDGES = """kg_edges AS (SELECT c_custkey * 10 + 3 AS start_id, CAST(c_nationkey * 10 + 1 AS BIGINT) AS end_id, 'located_in' AS relation_type, c_custkey * 10 + 3 AS edge_id FROM customer
UNION ALL SELECT s_suppkey * 10 + 2, CAST(s_nationkey * 10 + 1 AS BIGINT), 'located_in', s_suppkey * 10 + 2 FROM supplier
UNION ALL SELECT CAST(n_nationkey * 10 + 1 AS BIGINT), CAST(n_regionkey * 10 AS BIGINT), 'part_of', CAST(n_nationkey * 10 + 1 AS BIGINT) FROM nation
UNION ALL SELECT l_partkey * 10 + 4, l_suppkey * 10 + 2, 'supplied_by', l_partkey * 100000000 + l_suppkey * 10 + 4 FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem))"""

HINTS = ["caused_by", "led_to", "enabled_by", "blocked_by", "contradicts"]


def causal_edges(spark: SparkSession, d: str) -> DataFrame:
    """Order lines as edges from order to part with a hint by line number. Repeated rows of a line are one edge."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber").distinct()
    hint = F.element_at(F.array(*[F.lit(h) for h in HINTS]), (F.col("l_linenumber") % 5 + 1).cast("int"))
    return li.select((F.col("l_orderkey") * 1_000_000_000 + F.col("l_partkey") * 100 + F.col("l_linenumber")).cast("bigint").alias("edge_id"), (F.col("l_orderkey") * 2).alias("start_id"), (F.col("l_partkey") * 2 + 1).alias("end_id"), hint.alias("causal_hint"))


CAUSAL_EDGES = f"causal_edges AS (SELECT CAST(l_orderkey * 1000000000 + l_partkey * 100 + l_linenumber AS BIGINT) AS edge_id, l_orderkey * 2 AS start_id, l_partkey * 2 + 1 AS end_id, {HINTS!r}[l_linenumber % 5 + 1] AS causal_hint FROM (SELECT DISTINCT l_orderkey, l_partkey, l_linenumber FROM lineitem))"


def reads(spark: SparkSession, d: str) -> DataFrame:
    """Views as reads that returned one fact."""
    e = table(spark, d, "events").where("event_type = 'view'")
    k = F.get_json_object("props", "$.k").cast("bigint")
    return e.select(F.col("event_id").alias("id"), seconds("ts").alias("at"), F.col("user_id").cast("string").alias("agent_id"), F.concat(F.lit("s"), F.col("user_id") % 20).alias("session_id"), F.floor("value").cast("bigint").alias("injected_chars"), F.array(k).alias("returned"), k.alias("edge_id"), F.when(F.col("event_id") % 7 == 0, "save").otherwise("recall").alias("kind"), (k % 3).cast("int").alias("n_facts"))


READS = "reads AS (SELECT event_id AS id, CAST(floor(epoch(ts)) AS BIGINT) AS at, CAST(user_id AS VARCHAR) AS agent_id, 's' || (user_id % 20) AS session_id, CAST(floor(value) AS BIGINT) AS injected_chars, CAST(json_extract(props, '$.k') AS BIGINT) AS edge_id, CASE WHEN event_id % 7 = 0 THEN 'save' ELSE 'recall' END AS kind, CAST(CAST(json_extract(props, '$.k') AS BIGINT) % 3 AS INTEGER) AS n_facts FROM events WHERE event_type = 'view')"


def verifications(spark: SparkSession, d: str) -> DataFrame:
    """Two rows a labelled document: the later one repeats or reverses the state."""
    la = table(spark, d, "labels")
    state = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "verified").when((F.col("quality") == 1) & (F.col("toxic") == 1), "rejected").when((F.col("quality") == 0) & (F.col("toxic") == 1), "disputed").otherwise("evidence_backed")
    one = la.select(F.col("doc_id").alias("id"), F.col("doc_id").alias("edge_id"), F.lit("unverified").alias("state"), F.lit(None).cast("bigint").alias("expires_at"))
    two = la.select((F.col("doc_id") + 10_000_000).alias("id"), F.col("doc_id").alias("edge_id"), state.alias("state"), (F.lit(START) + F.col("doc_id") * 86400).cast("bigint").alias("expires_at"))
    return one.unionByName(two)


VERIFICATIONS = f"""verifications AS (SELECT doc_id AS id, doc_id AS edge_id, 'unverified' AS state, CAST(NULL AS BIGINT) AS expires_at FROM labels UNION ALL
SELECT doc_id + 10000000, doc_id, CASE WHEN quality = 1 AND toxic = 0 THEN 'verified' WHEN quality = 1 AND toxic = 1 THEN 'rejected' WHEN quality = 0 AND toxic = 1 THEN 'disputed' ELSE 'evidence_backed' END, {START} + doc_id * 86400 FROM labels),
states AS (SELECT edge_id, arg_max(state, id) AS state, arg_max(expires_at, id) AS expires_at FROM verifications GROUP BY edge_id)"""

TYPES = ["decision.recorded", "action.executed", "outcome.observed", "deployment.completed", "test.completed", "evidence.attached", "claim.verified"]


def envelopes(spark: SparkSession, d: str) -> DataFrame:
    """Events as envelopes, some late, some broken, every tenth twice."""
    e = table(spark, d, "events")
    base = e.select(
        F.concat(F.lit("g"), F.col("user_id") % 8).alias("group_id"), F.when(F.col("event_id") % 97 == 0, F.concat(F.lit("e"), F.col("event_id") % 10)).otherwise(F.concat(F.lit("evt:"), F.lpad(F.col("event_id").cast("string"), 8, "0"))).alias("event_id"),
        F.when(F.col("event_id") % 89 == 0, F.lit("other")).otherwise(F.element_at(F.array(*[F.lit(t) for t in TYPES]), (F.col("event_id") % 7 + 1).cast("int"))).alias("event_type"), F.when(F.col("event_id") % 83 == 0, 2).otherwise(1).alias("schema_version"),
        seconds("ts").alias("occurred_at"), (seconds("ts") + (F.col("event_id") % 11) * 86400 - F.when(F.col("event_id") % 79 == 0, 3600).otherwise(0)).alias("received_at"), F.when(F.col("event_id") % 73 == 0, F.lit(" ")).otherwise(F.concat(F.lit("u"), F.col("user_id"))).alias("agent"),
        F.col("props").alias("payload"), F.lit(None).cast("string").alias("scope_group"), F.col("event_id").alias("arrival"), F.element_at(F.array(*[F.lit(s) for s in ("success", "failure", "mixed")]), (F.col("user_id") % 3 + 1).cast("int")).alias("sign"), F.concat(F.lit("d"), F.col("user_id") % 40).alias("subject"),
    )
    again = base.where("arrival % 10 = 0").withColumn("received_at", F.col("received_at") + 60).withColumn("arrival", F.col("arrival") + 100_000_000)
    return base.unionByName(again)


ENVELOPES = f"""once AS (SELECT 'g' || (user_id % 8) AS group_id, CASE WHEN event_id % 97 = 0 THEN 'e' || (event_id % 10) ELSE 'evt:' || lpad(CAST(event_id AS VARCHAR), 8, '0') END AS event_id,
CASE WHEN event_id % 89 = 0 THEN 'other' ELSE {TYPES!r}[event_id % 7 + 1] END AS event_type, CASE WHEN event_id % 83 = 0 THEN 2 ELSE 1 END AS schema_version, CAST(floor(epoch(ts)) AS BIGINT) AS occurred_at,
CAST(floor(epoch(ts)) AS BIGINT) + (event_id % 11) * 86400 - CASE WHEN event_id % 79 = 0 THEN 3600 ELSE 0 END AS received_at, CASE WHEN event_id % 73 = 0 THEN ' ' ELSE 'u' || user_id END AS agent, props AS payload, event_id AS arrival,
['success', 'failure', 'mixed'][user_id % 3 + 1] AS sign, 'd' || (user_id % 40) AS subject FROM events),
envelopes AS (SELECT * FROM once UNION ALL SELECT * REPLACE (received_at + 60 AS received_at, arrival + 100000000 AS arrival) FROM once WHERE arrival % 10 = 0),
judged AS (SELECT *, CASE WHEN schema_version <> 1 THEN 'schema_version' WHEN NOT regexp_matches(event_id, '^[A-Za-z0-9][A-Za-z0-9._:-]{{7,127}}$') THEN 'event_id' WHEN event_type = 'other' THEN 'event_type' WHEN occurred_at > received_at + 900 THEN 'future'
WHEN occurred_at < received_at - 604800 THEN 'late' WHEN trim(agent) = '' THEN 'actor' WHEN strlen(payload) > 65536 THEN 'payload' END AS reason FROM envelopes),
accepted AS (SELECT * EXCLUDE (nth) FROM (SELECT *, row_number() OVER (PARTITION BY group_id, event_id ORDER BY received_at, arrival) AS nth FROM judged WHERE reason IS NULL) WHERE nth = 1)"""


def turn_facts(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").where("role != 'system'")
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("edge_id"), F.concat(F.lit("conv:"), F.col("conv_id")).alias("group_id"), F.col("role").alias("source"), F.concat(F.lit("turn:"), F.col("conv_id"), F.lit("."), F.col("turn")).alias("target"), F.lit("said").alias("relation_type"), F.concat("role", F.lit(" said: "), "text").alias("fact"))


TURN_FACTS = "turn_facts AS (SELECT conv_id * 1000 + turn AS edge_id, 'conv:' || conv_id AS group_id, role AS source, 'turn:' || conv_id || '.' || turn AS target, 'said' AS relation_type, role || ' said: ' || text AS fact FROM conversations WHERE role <> 'system')"
