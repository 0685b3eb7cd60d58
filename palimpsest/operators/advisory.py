"""Lists that reorder but never add: salience, trust, lessons; and suppression."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Weight of a fact's trust state, value of an outcome's sign, states that support a lesson.
TRUST_WEIGHT = {"verified": 1.0, "evidence_backed": 0.6, "disputed": 0.3, "unverified": 0.0, "rejected": 0.0, "stale": -0.3}
SIGN_VALUE = {"success": 1, "failure": -1, "mixed": 0, "unknown": 0}
SUPPORTING = ["verified", "evidence_backed"]
COOLDOWN = 60
DECAY = 0.5


def activation(reads: DataFrame, now: int) -> DataFrame:
    """edge_id, activation from (edge_id, at): reads in one minute count once; each weighs max(age, 1) ^ -0.5."""
    slots = reads.select("edge_id", (F.floor(F.col("at") / COOLDOWN) * COOLDOWN).alias("slot")).distinct()
    return slots.groupBy("edge_id").agg(F.sum(F.pow(F.greatest(F.lit(now) - F.col("slot"), F.lit(1)).cast("double"), F.lit(-DECAY))).alias("activation"))


def by_salience(ranked: DataFrame, reads: DataFrame, now: int) -> DataFrame:
    """The list in order of activation; ties keep their place."""
    joined = ranked.join(activation(reads, now), "edge_id", "left").withColumn("activation", F.round(F.coalesce("activation", F.lit(0.0)), 9))
    return joined.withColumn("salience_rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("activation"), "rank")))


def trust_states(verifications: DataFrame, now: int | None = None) -> DataFrame:
    """Current state of each fact: the row with the largest id wins; a verified one that has expired reads as stale."""
    newest = verifications.groupBy("edge_id").agg(F.max_by(F.struct("state", "expires_at"), "id").alias("s")).select("edge_id", "s.*")
    if now is None:
        return newest.select("edge_id", "state")
    stale = (F.col("state") == "verified") & (F.col("expires_at") <= now)
    return newest.select("edge_id", F.when(stale, "stale").otherwise(F.col("state")).alias("state"))


def weight_of(state):
    out = F.lit(0.0)
    for name, w in TRUST_WEIGHT.items():
        out = F.when(state == name, w).otherwise(out)
    return out


def by_trust(ranked: DataFrame, states: DataFrame) -> DataFrame:
    joined = ranked.join(states, "edge_id", "left").withColumn("trust", weight_of(F.coalesce("state", F.lit("unverified"))))
    return joined.withColumn("trust_rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("trust"), "rank")))


def trust_summary(states: DataFrame) -> DataFrame:
    """Facts by state, with zeros for states that do not occur."""
    every = states.sparkSession.createDataFrame([(s,) for s in TRUST_WEIGHT], "state string")
    return every.join(states.groupBy("state").agg(F.count("*").alias("n")), "state", "left").na.fill(0, ["n"])


def suppress(ranked: DataFrame, states: DataFrame, k: int) -> DataFrame:
    """Rejected facts leave before the list is cut."""
    kept = ranked.join(states.where("state = 'rejected'").select("edge_id"), "edge_id", "left_anti")
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).where(F.col("rank") <= k)


def lessons(observations: DataFrame, min_support: int = 2, agreement: float = 1.0) -> DataFrame:
    """decision, sign, support, agreement, basis from (decision, edge_id, sign, state): the sign most supported outcomes have."""
    good = observations.where(F.col("state").isin(SUPPORTING) & F.col("sign").isin([s for s, v in SIGN_VALUE.items() if v]))
    signs = good.groupBy("decision", "sign").agg(F.count("*").alias("support"), F.min((F.col("state") == "verified").cast("int")).alias("sure"))
    total = F.sum("support").over(Window.partitionBy("decision"))
    first = F.row_number().over(Window.partitionBy("decision").orderBy(F.desc("support"), "sign"))
    best = signs.withColumn("agreement", F.round(F.col("support") / total, 4)).withColumn("nth", first).where("nth = 1")
    basis = F.when(F.col("sure") == 1, "verified_causal").otherwise("correlational")
    return best.where((F.col("support") >= min_support) & (F.col("agreement") >= agreement)).select("decision", "sign", "support", "agreement", basis.alias("basis"))


def repeated_failures(observations: DataFrame, least: int = 2) -> DataFrame:
    return observations.where("sign = 'failure'").groupBy("decision").agg(F.count("*").alias("failures")).where(F.col("failures") >= least)


def by_lesson(ranked: DataFrame, behind: DataFrame) -> DataFrame:
    """Facts behind a lesson (edge_id, support, basis) first, the better supported before; a verified cause adds half a point."""
    weight = F.coalesce(F.col("support") + F.when(F.col("basis") == "verified_causal", 0.5).otherwise(0.0), F.lit(0.0))
    joined = ranked.join(behind, "edge_id", "left").withColumn("lesson_weight", weight)
    return joined.withColumn("lesson_rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("lesson_weight"), "rank")))


def lesson_bars(observations: DataFrame, min_support: int = 2, agreement: float = 1.0) -> DataFrame:
    """decision, bar: why a decision with outcomes has no lesson yet ('trust', 'support', 'agreement'), or 'met'."""
    signed = F.col("sign").isin([s for s, v in SIGN_VALUE.items() if v])
    good = signed & F.coalesce(F.col("state").isin(SUPPORTING), F.lit(False))
    counts = observations.where(signed).groupBy("decision", "sign").agg(F.count_if(good).alias("support"))
    best = counts.groupBy("decision").agg(F.max("support").alias("best"), F.sum("support").alias("total"))
    share = F.round(F.col("best") / F.greatest("total", F.lit(1)), 4)
    return best.select("decision", F.when(F.col("total") == 0, "trust").when(F.col("best") < min_support, "support").when(share < agreement, "agreement").otherwise("met").alias("bar"))


def history(verifications: DataFrame) -> DataFrame:
    """edge_id, nth, id, state of every verification of a fact, oldest first."""
    return verifications.select("edge_id", F.row_number().over(Window.partitionBy("edge_id").orderBy("id")).alias("nth"), "id", "state")
