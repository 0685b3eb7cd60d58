"""Versions of facts: supersession, restatement, history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.validity import as_of, live


def versions(statements: DataFrame, key: list[str], value: list[str], order: list[str]) -> DataFrame:
    """Statements in order become versions: one that repeats the active value of its key is dropped (a restatement), and
    each version ends where the next begins. One shuffle by key serves both windows."""
    w = Window.partitionBy(*key).orderBy(*order)
    now = F.struct(*value)
    changed = statements.withColumn("before", F.lag(now).over(w)).where(F.col("before").isNull() | ~F.col("before").eqNullSafe(now)).drop("before")
    return changed.withColumn("t_invalid", F.lead("t_valid").over(w))


def restatements(statements: DataFrame, key: list[str], value: list[str], order: list[str]) -> DataFrame:
    """The statements that repeat what is active."""
    w = Window.partitionBy(*key).orderBy(*order)
    now = F.struct(*value)
    return statements.withColumn("before", F.lag(now).over(w)).where(F.col("before").eqNullSafe(now)).drop("before")


def live_facts(facts: DataFrame) -> DataFrame:
    return facts.where(live())


def facts_as_of(facts: DataFrame, moment: int) -> DataFrame:
    return facts.where(as_of(moment))


def canonical(first: Column, past: Column, levels: int) -> Column:
    """The interval [first, past) of whole numbers as canonical intervals (level, slot): slot covers slot * 2^level and the 2^level - 1 numbers
    after it. They are disjoint, and there are at most two a level."""
    parts = []
    for k in range(levels + 1):
        lo, hi = F.ceil(first / (1 << k)), F.floor(past / (1 << k))
        after = lo + F.pmod(lo, F.lit(2))  # where the next level begins
        low = (lo < hi) & (F.pmod(lo, F.lit(2)) == 1)
        if k == levels:  # the coarsest level takes what is left, one by one
            parts.append(F.when(lo < hi, F.transform(F.sequence(lo, hi - 1), lambda s: F.struct(F.lit(levels).alias("level"), s.alias("slot")))))
        else:
            parts.append(F.when(low, F.array(F.struct(F.lit(k).alias("level"), lo.alias("slot")))))
            parts.append(F.when((after < hi) & (F.pmod(hi, F.lit(2)) == 1), F.array(F.struct(F.lit(k).alias("level"), (hi - 1).alias("slot")))))
    return F.flatten(F.filter(F.array(*parts), lambda x: x.isNotNull()))


LEVELS = 14  # the coarsest slot is 2^14 buckets: 44 years of days


def as_of_many(facts: DataFrame, moments: DataFrame, bucket: int = 86400, levels: int = LEVELS) -> DataFrame:
    """Facts valid at each of many moments (query_id, moment). The buckets a fact lives in become canonical intervals, two a level at most, and a
    moment has one slot on each level: an equi-join on (level, slot) with the exact condition behind it. A fact that lives for n buckets is
    2 log2 n rows, not n; one that never ends lives until the last moment."""
    last = moments.agg(F.max("moment").alias("last"))  # one row
    past = F.floor(F.least(F.coalesce(F.col("t_invalid") - 1, F.col("last")), F.col("last")) / bucket) + 1
    spans = facts.join(F.broadcast(last)).where(F.col("t_valid") <= F.col("last")).withColumn("interval", F.explode(canonical(F.floor(F.col("t_valid") / bucket), past, levels)))
    at = moments.select(*moments.columns, F.explode(F.sequence(F.lit(0), F.lit(levels))).alias("level"))
    at = at.withColumn("slot", F.floor(F.floor(F.col("moment") / bucket) / F.pow(F.lit(2.0), F.col("level"))))
    parted = spans.select(*facts.columns, F.col("interval.level").alias("level"), F.col("interval.slot").alias("slot"))
    return parted.join(at, ["level", "slot"]).where(as_of(F.col("moment"))).drop("level", "slot")


def digest(facts: DataFrame, n: int) -> DataFrame:
    """The newest live facts."""
    return facts.where(live()).orderBy(F.desc("t_valid"), F.desc("edge_id")).limit(n)


def audit_trail(facts: DataFrame, key: list[str]) -> DataFrame:
    """One entry for each version: created, or superseding the version before."""
    w = Window.partitionBy(*key).orderBy("t_valid", "edge_id")
    before = F.lag("edge_id").over(w)
    return facts.select("*", before.alias("previous_id")).select(
        F.col("edge_id").alias("id"), F.col("t_valid").alias("at"), F.when(F.col("previous_id").isNull(), "created").otherwise("fact_superseded").alias("mutation_type"),
        F.when(F.col("previous_id").isNull(), F.array("edge_id")).otherwise(F.array("previous_id", "edge_id")).alias("affected_edge_ids"), *key,
    )


def fact_history(audit: DataFrame, edge_id: int) -> DataFrame:
    return audit.where(F.array_contains("affected_edge_ids", edge_id))


def capped(audit: DataFrame, since: int, n: int) -> DataFrame:
    """Entries from a moment on, oldest first, at most n, with the flag that there are more (one row more is read)."""
    rows = audit.where(F.col("at") >= since).orderBy("at", "id").limit(n + 1)
    numbered = rows.withColumn("nth", F.row_number().over(Window.orderBy("at", "id")))
    return numbered.withColumn("truncated", F.max(F.col("nth") > n).over(Window.partitionBy())).where(F.col("nth") <= n).drop("nth")
