"""Small record-keeping operators: upserts, judging sheets, trials, delivery, import, prompt-time recall."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import instruction_like
from . import fusion, govern, ingest, lexical

BANDS = [0.0, 0.15, 0.3, 0.45]


def upsert_questions(known: DataFrame, new: DataFrame) -> DataFrame:
    """Questions (group_id, text) by normalised text; the first one stays. Adds `created`."""
    flat = lambda df, c: df.select("group_id", F.trim(F.regexp_replace("text", r"\s+", " ")).alias("text"), F.lit(c).alias("created"))
    both = flat(known, False).unionByName(flat(new, True))
    return both.groupBy("group_id", "text").agg(F.min("created").alias("created"))


def last_judgements(judgements: DataFrame) -> DataFrame:
    """One judgement for each (query, fact, judge): the last by `at`, then by `id`."""
    return judgements.groupBy("query_id", "edge_id", "judged_by").agg(F.max_by("relevant", F.struct("at", "id")).alias("relevant"))


def judges(judgements: DataFrame) -> DataFrame:
    return judgements.groupBy("judged_by").agg(F.count("*").alias("labels"), F.count_if(F.col("relevant") == 1).alias("yes"))


def latest_runs(runs: DataFrame) -> DataFrame:
    """The newest list of each (query, configuration)."""
    return runs.groupBy("query_id", "configuration").agg(F.max_by("returned", F.struct("ran_at", "id")).alias("returned"))


def judging_sheet(pooled: DataFrame, facts: DataFrame) -> DataFrame:
    """Lines `[ ] query/fact  text` to be marked by hand."""
    j = pooled.join(facts.select("edge_id", "fact"), "edge_id")
    return j.select("query_id", "position", F.format_string("[ ] %d/%d  %s", F.col("query_id"), F.col("edge_id"), F.regexp_replace("fact", r"\s+", " ")).alias("line"))


def read_sheet(lines: DataFrame) -> DataFrame:
    """Marked lines (`line`) back as judgements: y or x is relevant, n is not; others are skipped."""
    shape = r"^\[\s*([ynxYNX])\s*\]\s+(\d+)/(\d+)\b"
    hit = lines.where(F.col("line").rlike(shape))
    return hit.select(F.regexp_extract("line", shape, 2).cast("bigint").alias("query_id"), F.regexp_extract("line", shape, 3).cast("bigint").alias("edge_id"), F.lower(F.regexp_extract("line", shape, 1)).isin("y", "x").cast("int").alias("relevant"))


def apportion(prompts: DataFrame) -> DataFrame:
    """Characters of a prompt's block shared out over its scopes by facts: whole shares, what is left over goes to the first
    scopes one by one. prompts: prompt_id, group_id, n_facts, chars."""
    w = Window.partitionBy("prompt_id")
    share = F.floor(F.col("chars") * F.col("n_facts") / F.greatest(F.sum("n_facts").over(w), F.lit(1))).cast("bigint")
    based = prompts.withColumn("base", share).withColumn("left", F.col("chars") - F.sum("base").over(w)).withColumn("nth", F.row_number().over(w.orderBy(F.desc("n_facts"), "group_id")))
    return based.select("prompt_id", "group_id", (F.col("base") + (F.col("nth") <= F.col("left")).cast("bigint")).alias("injected_chars"))


def sample_below(pairs: DataFrame, bar: float, per_band: int) -> DataFrame:
    """Pairs under the bar (a, b, similarity) by bands: population of each band, and its first pairs in an order that tells nothing."""
    band = F.lit(0.0)
    for low in BANDS[1:]:
        band = F.when(F.col("similarity") >= low, low).otherwise(band)
    key = F.md5(F.concat_ws(":", F.col("a").cast("string"), F.col("b").cast("string")).cast("binary"))
    low = pairs.where(F.col("similarity") < bar).withColumn("band", band)
    numbered = low.withColumn("population", F.count("*").over(Window.partitionBy("band"))).withColumn("nth", F.row_number().over(Window.partitionBy("band").orderBy(key, "a", "b")))
    return numbered.where(F.col("nth") <= per_band).drop("nth")


def suppressed_pairs(pairs: DataFrame, projects: DataFrame) -> DataFrame:
    """One row: pairs (a, b) whose entities share no project. projects: node, project."""
    of = projects.groupBy("node").agg(F.collect_set("project").alias("p"))
    j = pairs.join(of.toDF("a", "pa"), "a", "left").join(of.toDF("b", "pb"), "b", "left")
    return j.agg(F.count("*").alias("pairs"), F.count_if(F.col("pa").isNotNull() & F.col("pb").isNotNull() & ~F.arrays_overlap("pa", "pb")).alias("suppressed"))


def start_trial(trials: DataFrame, name: str, at: int) -> DataFrame:
    """One open trial: starting one closes another, with the reason. trials: name, started_at, ended_at, reason."""
    closed = trials.withColumn("reason", F.when(F.col("ended_at").isNull(), "restarted").otherwise(F.col("reason"))).withColumn("ended_at", F.coalesce("ended_at", F.lit(at)))
    return closed.unionByName(trials.sparkSession.createDataFrame([(name, at, None, None)], "name string, started_at bigint, ended_at bigint, reason string"))


def pair_key(a: Column, b: Column) -> Column:
    return F.concat_ws("|", F.array_sort(F.array(a, b)))


def recall_for_prompt(prompts: DataFrame, facts: DataFrame, first: str, second: str, k: int = 3, least: int = 12) -> DataFrame:
    """Lexical recall in the first scope, then the second; equal texts once, k facts in all. Prompts under `least` characters get none."""
    asked = prompts.where(F.length("text") >= least)
    each = facts.where(F.col("group_id").isin(first, second))
    best = fusion.topk(lexical.bm25_scores(asked, each).withColumn("score", F.round("score", 6)), ["query_id", "group_id"], [F.desc("score"), F.col("edge_id")], k)
    few = F.broadcast(best) if asked.count() * 2 * k <= lexical.SMALL else best  # so that the other texts stay where they are
    joined = each.select("edge_id", "fact").join(few, "edge_id").withColumn("scope_no", (F.col("group_id") != first).cast("int"))
    once = fusion.keep_first(joined, ["query_id", "fact"], [F.col("scope_no"), F.col("rank")])
    return fusion.topk(once.drop("rank"), ["query_id"], [F.col("scope_no"), F.desc("score"), F.col("edge_id")], k).select("query_id", "rank", "edge_id", "group_id")


def describe(facts: DataFrame) -> DataFrame:
    """Adds content_class: 'instruction_like' for texts that read like one, else 'memory'."""
    return facts.withColumn("content_class", F.when(instruction_like(F.col("fact")), "instruction_like").otherwise("memory"))


def erased_after(erasures: DataFrame, moment: int) -> DataFrame:
    """One row: facts erased after an as-of moment, in all."""
    return erasures.where((F.col("status") == "completed") & (F.col("completed_at") > moment)).agg(F.coalesce(F.sum("n_edges"), F.lit(0)).cast("bigint").alias("erased"))


def quote_filter(candidates: DataFrame, sources: DataFrame, least: int = 20, head: int = 60, per_batch: int = 8) -> DataFrame:
    """Candidate statements (batch, position, quote) whose quote is long enough and stands in the batch's text; the first ones of a batch."""
    j = candidates.join(sources.select("batch", "text"), "batch").where((F.length("quote") >= least) & F.contains(F.col("text"), F.substring("quote", 1, head))).drop("text")
    return fusion.topk(j, ["batch"], [F.col("position")], per_batch, "nth").drop("nth")


def import_bundle(facts: DataFrame, bundle: str, owner: str, faults: list[str], registry: DataFrame) -> tuple[DataFrame | None, str]:
    """Facts of a bundle in quarantine, or the reason for refusing it: what its reader found, a replay, or a fact that can't be imported."""
    if faults:
        return None, faults[0]
    if registry.where(F.col("bundle_id") == bundle).limit(1).count():
        return None, "replay"
    bad = govern.importable(facts).where("reason IS NOT NULL").select("reason").first()
    return (None, bad["reason"]) if bad else (govern.quarantine(facts, bundle, owner), "quarantined")


def fact_outcomes(batch: DataFrame, resolved: DataFrame) -> DataFrame:
    """Facts (edge_id, source, target, fact) against resolved mentions (name, decision): one with an ambiguous end is deferred, one
    that breaks a rule refused, the others are ready."""
    judged = ingest.refusal(batch)
    vague = resolved.where("decision = 'ambiguous'").select(F.col("name").alias("vague")).distinct()
    ends = batch.select("edge_id", F.explode(F.array("source", "target")).alias("vague")).join(vague, "vague", "left_semi").select(F.col("edge_id").alias("k")).distinct()
    j = judged.join(ends, F.col("edge_id") == F.col("k"), "left")
    return j.select("edge_id", F.when(F.col("reason").isNotNull(), "refused").when(F.col("k").isNotNull(), "deferred").otherwise("ready").alias("outcome"))


def causal_verdicts(facts: DataFrame, scanned: DataFrame, cue: Column, most: int) -> DataFrame:
    """Live facts that nobody has looked at yet: those that state a cue go to the extractor, the others are settled as no_cue."""
    todo = facts.join(scanned.select("edge_id"), "edge_id", "left_anti").orderBy("edge_id").limit(most)
    return todo.select("edge_id", F.when(cue, "ask").otherwise("no_cue").alias("verdict"))
