"""Upkeep of a store: evidence, policies, authors, chains, signatures, trials, calibration, ablation."""

from __future__ import annotations

import hashlib
import hmac
import itertools
import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.embedding import embed
from ..functions.text import instruction_like
from ..functions.vectors import dot

DAY = 86400


def fetch(ranked: DataFrame, facts: DataFrame) -> DataFrame:
    """The facts of a ranked list in one join; the rank stays."""
    return ranked.join(facts, "edge_id")


def export(nodes: DataFrame, facts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, live facts with the names of their ends, newest first, and nodes without a live fact."""
    live = facts.where(F.col("t_invalid").isNull())
    a, b = nodes.select(F.col("node").alias("start_id"), F.col("name").alias("source")), nodes.select(F.col("node").alias("end_id"), F.col("name").alias("target"))
    used = live.select(F.explode(F.array("start_id", "end_id")).alias("node")).distinct()
    return nodes, live.join(a, "start_id", "left").join(b, "end_id", "left").orderBy(F.desc("t_valid"), F.desc("edge_id")), nodes.join(used, "node", "left_anti")


def reindex(facts: DataFrame, embedder=None) -> DataFrame:
    """edge_id, vector of every live fact (every fact, where nothing says when one ends), computed anew."""
    facts = facts.where(F.col("t_invalid").isNull()) if "t_invalid" in facts.columns else facts
    return facts.select("edge_id", (embed(F.col("fact"), embedder) if embedder else embed(F.col("fact"))).alias("vector"))


def evidence_counts(facts: DataFrame, links: DataFrame) -> DataFrame:
    """Pieces of evidence by fact, with zeros."""
    n = links.groupBy("edge_id").agg(F.countDistinct("evidence_id").alias("n_evidence"))
    return facts.select("edge_id").join(n, "edge_id", "left").na.fill(0, ["n_evidence"])


def evidence_of(links: DataFrame, evidence: DataFrame) -> DataFrame:
    """Evidence of each fact, newest first, marked where its text reads like an instruction."""
    w = Window.partitionBy("edge_id").orderBy(F.desc("received_at"), "evidence_id")
    j = links.join(evidence, "evidence_id").withColumn("flagged", instruction_like(F.col("detail")))
    return j.select("edge_id", "evidence_id", "flagged", F.row_number().over(w).alias("position"))


def last_writes(audit: DataFrame) -> DataFrame:
    """One row: last write by an agent, last one by an import (session 'import:...')."""
    imported = F.col("session_id").startswith("import:")
    return audit.agg(F.max(F.when(~imported, F.col("at"))).alias("organic_at"), F.max(F.when(imported, F.col("at"))).alias("imported_at"))


def stale_writer(audit: DataFrame, running: str) -> DataFrame:
    """By scope: does the newest entry come from another version than the one that runs?"""
    return audit.groupBy("group_id").agg(F.max_by("writer_version", F.struct("at", "id")).alias("version")).withColumn("stale", F.col("version") != running)


def brief(facts: DataFrame, n: int = 4) -> DataFrame:
    """The newest facts of each project."""
    w = Window.partitionBy("project").orderBy(F.desc("t_valid"), F.desc("edge_id"))
    return facts.withColumn("position", F.row_number().over(w)).where(F.col("position") <= n)


def corpus_tokens(facts: DataFrame) -> DataFrame:
    return facts.agg(F.floor(F.sum(F.length("fact")) / 4).cast("bigint").alias("tokens"))


def set_policy(policies: DataFrame, group_id: str, days: int, at: int) -> DataFrame:
    """A scope's new retention policy; the one before retires. policies: group_id, days, created_at, retired_at."""
    old = policies.withColumn("retired_at", F.when((F.col("group_id") == group_id) & F.col("retired_at").isNull(), at).otherwise(F.col("retired_at")))
    return old.unionByName(policies.sparkSession.createDataFrame([(group_id, days, at, None)], "group_id string, days bigint, created_at bigint, retired_at bigint"))


def reattribute(facts: DataFrame, authors: DataFrame) -> DataFrame:
    """Facts with authors (edge_id, agent_id) filled in where they are unknown."""
    a = authors.select("edge_id", F.col("agent_id").alias("found"))
    known = F.col("agent_id").isNotNull() & (F.col("agent_id") != "unknown")
    return facts.join(a, "edge_id", "left").withColumn("agent_id", F.when(known, F.col("agent_id")).otherwise(F.coalesce("found", "agent_id"))).drop("found")


def chain_heads(chain: DataFrame) -> DataFrame:
    """Last number and digest of each scope's chain."""
    return chain.groupBy("group_id").agg(F.max("seq").alias("seq"), F.max_by("digest", "seq").alias("digest"))


def unattested(facts: DataFrame, chain: DataFrame) -> DataFrame:
    return facts.join(chain.select("edge_id"), "edge_id", "left_anti").select("edge_id")


def vanished(chain: DataFrame, facts: DataFrame, erased: DataFrame) -> DataFrame:
    """By scope: links whose fact is gone, facts erased on purpose (group_id, n_edges), and how many gone ones that leaves open."""
    gone = chain.join(facts.select("edge_id"), "edge_id", "left_anti").groupBy("group_id").agg(F.count("*").alias("gone"))
    told = erased.groupBy("group_id").agg(F.sum("n_edges").alias("erased"))
    j = gone.join(told, "group_id", "left").na.fill(0, ["erased"])
    return j.withColumn("open", F.when(F.col("erased") >= F.col("gone"), 0).otherwise(F.col("gone")))


def sign(manifest: dict, key: bytes) -> str:
    """HMAC over the canonical manifest (a few hundred bytes on the driver)."""
    return "hmac-sha256:" + hmac.new(key, json.dumps(manifest, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode(), hashlib.sha256).hexdigest()


def signed_by(manifest: dict, signature: str, key: bytes) -> bool:
    return hmac.compare_digest(sign(manifest, key), signature)


def trial_report(observations: DataFrame, saves: int = 3, duplicates: int = 1) -> DataFrame:
    """One row: counts of what a trial saw and whether it passes (observations: kind, retracted)."""
    live = observations.where(~F.col("retracted"))
    n = lambda k: F.count_if(F.col("kind") == k)
    row = live.agg(n("recall_save").alias("saves"), n("duplicate").alias("duplicates"), n("bad_merge").alias("bad_merges"))
    return row.withColumn("passed", (F.col("saves") >= saves) & (F.col("duplicates") <= duplicates) & (F.col("bad_merges") == 0))


def foreign_facts(facts: DataFrame, prefix: str) -> DataFrame:
    """One row: facts outside a benchmark's scopes."""
    return facts.agg(F.count_if(~F.col("group_id").startswith(prefix)).alias("foreign_facts"))


def accuracy(verdicts: DataFrame) -> DataFrame:
    """One row from (correct 1/0/null, cannot boolean): ungraded and unanswerable ones are counted apart."""
    graded = F.col("correct").isNotNull() & ~F.col("cannot")
    return verdicts.agg(F.count_if(graded).alias("graded"), F.count_if(F.col("correct").isNull() & ~F.col("cannot")).alias("ungraded"), F.count_if(F.col("cannot")).alias("cannot"), F.round(F.avg(F.when(graded, F.col("correct").cast("double"))), 6).alias("accuracy"))


def label_similarity(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """Judged pairs (a, b, label) with the similarity of their vectors: input of calibration."""
    v = vectors.select("edge_id", "vector")
    return pairs.join(v.toDF("a", "va"), "a").join(v.toDF("b", "vb"), "b").select("a", "b", "label", F.round(dot(F.col("va"), F.col("vb")), 6).alias("score"))


def findings(health: DataFrame) -> DataFrame:
    """Findings of a one-row health record, one row each."""
    rules = [("silent", F.col("quiet_days") > 7, "attention"), ("one_writer", F.col("writers") < 2, "attention"), ("unattributed", F.col("unattributed") > 0, "recommendation"), ("orphans", F.col("orphans") > 0, "recommendation"), ("healthy", F.col("score") >= 80, "strong")]
    every = F.array(*[F.when(c, F.struct(F.lit(n).alias("finding"), F.lit(k).alias("kind"))) for n, c, k in rules])
    return health.select(F.explode(F.filter(every, lambda x: x.isNotNull())).alias("f")).select("f.*")


def ablation() -> dict[str, dict]:
    """Named configurations of retrieval for comparison: each switch alone, and pairs of channels."""
    out: dict[str, dict] = {"default": {}, "vector_only": {"vector_only": True}, "no_floor": {"floor": None}, "match_count": {"lexical_bm25": False}, "rerank": {"rerank": True}, "mmr": {"use_mmr": True}, "trust": {"trust": True}}
    for e, w in itertools.product(("structural", "authored"), (None, 0.5, 0.2)):
        out[f"{e}_{w or 1.0}"] = {"expansion": e, "expansion_weight": w}
    return out | {f"rrf_{k}": {"rrf_k": k} for k in (10, 100)}
