"""Governance: redaction, erasure, retention, hash chains, bundles, imports."""

from __future__ import annotations

import hashlib
import hmac
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import secret_rule

GENESIS = "genesis"
# Entity types whose facts a minimal export leaves out.
PERSONAL_TYPES = ["person", "people", "individual"]
POLICIES = {
    "minimal": {"drop_types": PERSONAL_TYPES, "strip": ["agent_id", "provenance"]},
    "full": {"drop_types": [], "strip": []},
}
MAX_BUNDLE_FACTS = 10_000


def redact(facts: DataFrame, policy: str = "minimal", drop_relations: list[str] | None = None) -> DataFrame:
    """Adds `rule`: why a fact stays behind (first match), or null; strips what the policy strips. facts: fact, relation_type,
    source, target, source_type?, target_type?"""
    p = POLICIES[policy]
    text = F.concat_ws("\n", *[F.col(c) for c in ("fact", "source", "target") if c in facts.columns])
    typed = F.lit(None).cast("string")
    for c in ("source_type", "target_type"):
        if c in facts.columns and p["drop_types"]:
            typed = F.coalesce(typed, F.when(F.lower(c).isin(p["drop_types"]), "entity_type"))
    relation = F.when(F.col("relation_type").isin(drop_relations), "relation") if drop_relations else F.lit(None).cast("string")
    return facts.withColumn("rule", F.coalesce(relation, typed, secret_rule(text))).drop(*p["strip"])


def redaction_audit(redacted: DataFrame, preview: int = 10) -> DataFrame:
    """Facts by rule (kept ones as 'kept'), with the first ids of each. Ids are ranked in parts of a rule first, so that no rule's facts
    meet in one task."""
    ruled = redacted.select(F.coalesce("rule", F.lit("kept")).alias("rule"), "edge_id").withColumn("part", F.pmod(F.xxhash64("edge_id"), F.lit(64)))
    counts = ruled.groupBy("rule").agg(F.count("*").alias("n"))
    first = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy("edge_id"))
    few = ruled.withColumn("nth", first("rule", "part")).where(F.col("nth") <= preview)
    few = few.withColumn("nth", first("rule")).where(F.col("nth") <= preview).groupBy("rule").agg(F.array_sort(F.collect_list("edge_id")).alias("ids"))
    return counts.join(few, "rule").select("rule", "n", F.array_join(F.col("ids").cast("array<string>"), ",").alias("preview"))


def substring_candidates(facts: DataFrame, group_id: str, term: str) -> DataFrame:
    """edge_id, fact of a scope's facts that hold a term, whatever the case: what a person may then choose to erase."""
    return facts.where((F.col("group_id") == group_id) & F.contains(F.lower("fact"), F.lower(F.lit(term)))).select("edge_id", "fact")


def enforce_retention(facts: DataFrame, policies: DataFrame, now: int, audit: DataFrame, side: dict[str, DataFrame], dry_run: bool = True) -> dict[str, DataFrame]:
    """What the policies end: 'due' only, or (not dry_run) all tables without it."""
    due = retention_due(facts, policies, now).select("edge_id")
    return {"due": due} if dry_run else {"due": due, **erase(facts, due, audit, side)}


def segment_fault(name: Column) -> Column:
    """Why a name is no segment of a scope's address, or null: the separator in it would name other scopes."""
    return F.when(F.contains(name, F.lit(":")), "separator").when(F.trim(F.coalesce(name, F.lit(""))) == "", "empty")


def erasure_plan(facts: DataFrame, verb: str, subject: int | str) -> DataFrame:
    """edge_id of what goes. verb 'fact': all versions of the fact's triple; 'entity': all edges at the node; 'scope': the whole scope."""
    if verb == "fact":
        triple = facts.where(F.col("edge_id") == subject).select("group_id", "start_id", "end_id", "relation_type").distinct()
        return facts.join(F.broadcast(triple), ["group_id", "start_id", "end_id", "relation_type"], "left_semi").select("edge_id")
    if verb == "entity":
        return facts.where((F.col("start_id") == subject) | (F.col("end_id") == subject)).select("edge_id")
    return facts.where(F.col("group_id") == subject).select("edge_id")


def orphaned(facts: DataFrame, gone: DataFrame) -> DataFrame:
    """node: ends of erased facts that no other fact touches."""
    ends = lambda f: f.select(F.explode(F.array("start_id", "end_id")).alias("node")).distinct()
    return ends(facts.join(gone, "edge_id", "left_semi")).join(ends(facts.join(gone, "edge_id", "left_anti")), "node", "left_anti")


def erase(facts: DataFrame, gone: DataFrame, audit: DataFrame, side: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """All tables without the erased facts: rows go, ids leave arrays, audit texts are blanked."""
    ids = gone.select(F.col("edge_id").alias("gone_id"))
    out = {"facts": facts.join(ids, F.col("edge_id") == F.col("gone_id"), "left_anti")}
    for name, df in side.items():
        out[name] = df.join(ids, F.col("edge_id") == F.col("gone_id"), "left_anti")
    hit = audit.select("id", F.explode("affected_edge_ids").alias("gone_id")).join(ids, "gone_id").groupBy("id").agg(F.collect_set("gone_id").alias("hit"))
    joined = audit.join(hit, "id", "left")
    touched = F.col("hit").isNotNull()
    out["audit"] = joined.select(*[F.when(touched, F.array_except("affected_edge_ids", "hit")).otherwise(F.col(c)).alias(c) if c == "affected_edge_ids" else F.when(touched, F.lit("[erased]")).otherwise(F.col(c)).alias(c) if c in ("before_fact", "after_fact", "summary") else F.col(c) for c in audit.columns])
    return out


def retention_due(facts: DataFrame, policies: DataFrame, now: int) -> DataFrame:
    """Any version older than its scope's live policy allows (group_id, days)."""
    return facts.join(policies.select("group_id", "days"), "group_id").where(F.col("t_valid") < now - F.col("days") * 86400)


def canonical(*columns: str) -> Column:
    """A claim as JSON with sorted keys and no spaces."""
    return F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]))


def _chain(key: str | None):
    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("seq", kind="stable").reset_index(drop=True)
        prev, out = GENESIS, []
        for body in g["body"]:
            material = prev.encode() + b"\n" + body.encode()
            digest = "hmac-sha256:" + hmac.new(key.encode(), material, hashlib.sha256).hexdigest() if key else "sha256:" + hashlib.sha256(material).hexdigest()
            out.append((prev, digest))
            prev = digest
        g["prev_digest"], g["digest"] = [o[0] for o in out], [o[1] for o in out]
        return g[["group_id", "seq", "edge_id", "body", "prev_digest", "digest"]]

    return run


def attest(claims: DataFrame, key: str | None = None) -> DataFrame:
    """The chain of each scope: claims (group_id, seq, edge_id, body) get prev_digest and digest. A link needs the one before, so
    a scope is one task; scopes are many."""
    return claims.groupBy("group_id").applyInPandas(_chain(key), "group_id string, seq long, edge_id long, body string, prev_digest string, digest string")


def verify_chain(chain: DataFrame) -> DataFrame:
    """Checks every link at once: adds `broken` (prev is not the digest before) and `altered` (the digest is not that of the body
    behind the stored prev). Unkeyed links only are computed; keyed ones are left unverified."""
    before = F.coalesce(F.lag("digest").over(Window.partitionBy("group_id").orderBy("seq")), F.lit(GENESIS))
    made = F.concat(F.lit("sha256:"), F.sha2(F.concat_ws("\n", "prev_digest", "body").cast("binary"), 256))
    keyed = F.col("digest").startswith("hmac-")
    return chain.withColumn("broken", before != F.col("prev_digest")).withColumn("altered", F.when(~keyed, made != F.col("digest")))


def _content_digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    made, n = hashlib.sha256(), 0
    for b in batches:
        for h in b.column("h").to_pylist():
            made.update(("\n" if n else "").encode() + h.hex().encode())
            n += 1
    yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([made.hexdigest()])], names=["n_facts", "content_digest"])


def bundle_digest(facts: DataFrame) -> DataFrame:
    """One row: number of facts and sha256 over their digests in order of id. Lines are hashed where they are; one hash over all of them is
    sequential by nature, so one task reads the digests (32 bytes a fact) in order, and holds a batch of them."""
    lines = facts.select("edge_id", F.unhex(F.sha2(F.col("line").cast("binary"), 256)).alias("h"))
    made = lines.repartition(1).sortWithinPartitions("edge_id", "h").mapInArrow(_content_digest, "n_facts bigint, content_digest string")
    nothing = F.lit(hashlib.sha256().hexdigest())  # of an empty table no task may run
    return made.agg(F.coalesce(F.sum("n_facts"), F.lit(0)).alias("n_facts"), F.coalesce(F.max("content_digest"), nothing).alias("content_digest"))


def importable(facts: DataFrame) -> DataFrame:
    """Adds `reason` for facts that an import refuses; one such fact refuses the bundle."""
    from .ingest import refusal

    return refusal(facts)


def quarantine(facts: DataFrame, bundle: str, owner: str) -> DataFrame:
    """Imported facts: own scope, confidence 'inferred', origin recorded."""
    return facts.withColumn("group_id", F.lit(f"{owner}:import:{bundle}")).withColumn("confidence", F.lit("inferred")).withColumn("origin", F.lit(bundle)).withColumn("origin_t_valid", F.col("t_valid"))


# Moves between states of an imported bundle.
MOVES = {"promote": (["quarantined"], "promoted"), "reject": (["quarantined"], "rejected"), "revoke": (["promoted"], "revoked")}


def move(registry: DataFrame, bundle: str, verb: str) -> DataFrame:
    origin, goal = MOVES[verb]
    return registry.withColumn("state", F.when((F.col("bundle_id") == bundle) & F.col("state").isin(origin), goal).otherwise(F.col("state")))


def readable_scopes(scopes: DataFrame, registry: DataFrame, owner: str) -> DataFrame:
    """Scopes under an owner, imports only when promoted."""
    own = scopes.where(F.col("group_id").startswith(owner))
    imports = own.where(F.col("group_id").contains(":import:"))
    ok = registry.where("state = 'promoted'").select("group_id").distinct()
    return own.where(~F.col("group_id").contains(":import:")).unionByName(imports.join(ok, "group_id", "left_semi"))
