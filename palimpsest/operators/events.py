"""The event door: validation, lateness, idempotent intake, draining, application."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# What an envelope may be.
EVENT_ID = r"^[A-Za-z0-9][A-Za-z0-9._:-]{7,127}$"
EVENT_TYPES = ["decision.recorded", "action.executed", "outcome.observed", "deployment.completed", "test.completed", "evidence.attached", "claim.verified"]
VERSIONS = [1]
SKEW = 15 * 60
MAX_AGE = 7 * 86400
MAX_PAYLOAD = 64 * 1024
MAX_PENDING = 100


def reason(now: Column) -> Column:
    """The first rule that an envelope breaks, or null. Columns: schema_version, event_id, event_type, occurred_at (seconds), agent,
    payload (text), scope_group (a group id that the sender named, normally null); now: seconds."""
    at = F.col("occurred_at")
    return F.coalesce(
        F.when(~F.coalesce(F.col("schema_version").isin(VERSIONS), F.lit(False)), "schema_version"),
        F.when(~F.coalesce(F.col("event_id").rlike(EVENT_ID), F.lit(False)), "event_id"),
        F.when(~F.coalesce(F.col("event_type").isin(EVENT_TYPES), F.lit(False)), "event_type"),
        F.when(at.isNull(), "occurred_at"),
        F.when(at > now + SKEW, "future"),
        F.when(at < now - MAX_AGE, "late"),
        F.when(F.coalesce(F.trim("agent"), F.lit("")) == "", "actor"),
        F.when(F.octet_length("payload") > MAX_PAYLOAD, "payload"),
        F.when(F.col("scope_group").isNotNull(), "group_id"),
    )


def validate(envelopes: DataFrame) -> DataFrame:
    """Adds `reason`; each envelope is judged at its own received_at."""
    return envelopes.withColumn("reason", reason(F.col("received_at")))


def first_arrivals(envelopes: DataFrame) -> DataFrame:
    """One row for each (group_id, event_id): the one that came first."""
    w = Window.partitionBy("group_id", "event_id").orderBy("received_at", "arrival")
    return envelopes.withColumn("nth", F.row_number().over(w)).where("nth = 1").drop("nth")


def admitted(pending: DataFrame, most: int = MAX_PENDING) -> DataFrame:
    """Back-pressure: a scope takes `most` waiting events; later ones are refused (and may come again)."""
    nth = F.row_number().over(Window.partitionBy("group_id").orderBy("received_at", "event_id"))
    return pending.withColumn("admitted", nth <= most)


def drain_order(inbox: DataFrame, most: int = 100) -> DataFrame:
    """The oldest waiting events of each scope, in the order they are applied."""
    nth = F.row_number().over(Window.partitionBy("group_id").orderBy("received_at", "event_id"))
    return inbox.where("state = 'pending'").withColumn("position", nth).where(F.col("position") <= most)


def drain(inbox: DataFrame, limit: int = 100) -> dict[str, DataFrame]:
    """The oldest `limit` waiting events, applied one by one in effect: 'facts' of those that can be applied, 'inbox' with the new states.
    An event that breaks a rule when it is its turn (judged at the time it occurred, so waiting makes none late) is rejected with the
    reason and stops none of the others; each one taken counts an attempt. Waiting ones beyond the limit stay as they are."""
    order = [F.col("received_at"), F.col("event_id"), F.col("group_id")]
    turn = inbox.where("state = 'pending'").orderBy(*order).limit(limit).select("group_id", "event_id").withColumn("taken", F.lit(True))
    j = inbox.join(F.broadcast(turn), ["group_id", "event_id"], "left")  # `limit` rows
    wrong = F.coalesce(reason(F.col("occurred_at")), F.when(F.coalesce(F.trim("subject"), F.lit("")) == "", "subject"))
    taken = F.coalesce("taken", F.lit(False)) & (F.col("state") == "pending")
    judged = j.withColumn("error", F.when(taken, wrong)).withColumn("attempts", F.col("attempts") + taken.cast("int")).withColumn("was", taken)
    after = judged.withColumn("state", F.when(~F.col("was"), F.col("state")).when(F.col("error").isNull(), "applied").otherwise("rejected"))
    return {"facts": apply(after.where("was AND state = 'applied'")), "inbox": after.drop("taken", "was")}


def graph_rows(events: DataFrame) -> dict[str, DataFrame]:
    """What valid events write besides facts: 'nodes' (name, type), 'evidence' (fact of the subject, body) and 'verifications'."""
    kind = F.col("event_type")
    outcome = kind.isin("outcome.observed", "deployment.completed", "test.completed")
    named = F.when(kind == "decision.recorded", F.struct(F.col("subject").alias("name"), F.lit("decision").alias("type"))).when(kind == "action.executed", F.struct(F.col("subject").alias("name"), F.lit("action").alias("type")))
    named = named.when(outcome, F.struct(F.concat("subject", F.lit(" :: "), F.coalesce("sign", F.lit("unknown"))).alias("name"), F.lit("outcome").alias("type")))
    nodes = events.select("group_id", named.alias("n")).where("n IS NOT NULL").select("group_id", "n.name", "n.type").distinct()
    evidence = events.where(kind == "evidence.attached").select("group_id", "event_id", "subject", F.col("payload").alias("body"), "received_at")
    verified = events.where(kind == "claim.verified").select("group_id", "event_id", "subject", F.lit("verified").alias("state"), F.col("occurred_at").alias("at"))
    return {"nodes": nodes, "evidence": evidence, "verifications": verified}


def apply(events: DataFrame) -> DataFrame:
    """Valid events as facts: subject, relation, object. An outcome's object carries its sign behind ' :: '."""
    kind, at = F.col("event_type"), F.col("occurred_at")
    relation = F.when(kind == "decision.recorded", "decided").when(kind == "action.executed", "executed").when(kind.isin("outcome.observed", "deployment.completed", "test.completed"), "led_to").when(kind == "evidence.attached", "supported_by").otherwise("verified_by")
    sign = F.when(kind.isin("outcome.observed", "deployment.completed", "test.completed"), F.coalesce("sign", F.lit("unknown")))
    target = F.when(sign.isNotNull(), F.concat("subject", F.lit(" :: "), sign)).otherwise(F.col("subject"))
    return events.select("group_id", "event_id", F.col("agent").alias("source"), relation.alias("relation_type"), target.alias("target"), at.alias("t_valid"))


def counters(events: DataFrame) -> DataFrame:
    return events.groupBy("group_id", "event_type").agg(F.count("*").alias("n"), F.max("received_at").alias("last_at"))
