"""Operational analytics: reads, writers, health, attribution, ingest queue."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DAY = 86400


def read_summary(reads: DataFrame, now: int, days: int) -> DataFrame:
    """One row over the last days: reads, reads that returned facts, characters, tokens, saves."""
    recent = reads.where(F.col("at") >= now - days * DAY)
    chars = F.coalesce(F.sum("injected_chars"), F.lit(0)).cast("bigint")
    return recent.agg(F.count("*").alias("n_reads"), F.count_if(F.col("n_facts") > 0).alias("with_facts"), chars.alias("chars"), F.floor(chars / 4).cast("bigint").alias("tokens"), F.count_if(F.col("kind") == "save").alias("saves"))


def reads_by(reads: DataFrame, column: str) -> DataFrame:
    return reads.groupBy(F.coalesce(column, F.lit("unknown")).alias(column)).agg(F.count("*").alias("n_reads"), F.countDistinct("session_id").alias("sessions"), F.sum("injected_chars").cast("bigint").alias("chars"))


def unreturned(facts: DataFrame, reads: DataFrame, now: int, days: int) -> DataFrame:
    seen = reads.where(F.col("at") >= now - days * DAY).select(F.explode("returned").alias("edge_id")).distinct()
    return facts.join(seen, "edge_id", "left_anti")


def delivered(reads: DataFrame, edge_id: int, agent: str) -> DataFrame:
    """One row: was the fact returned to this agent, was it returned to anyone."""
    has = F.array_contains("returned", edge_id)
    return reads.agg(F.coalesce(F.max((has & (F.col("agent_id") == agent)).cast("int")), F.lit(0)).alias("to_agent"), F.coalesce(F.max(has.cast("int")), F.lit(0)).alias("to_any"))


def writers(facts: DataFrame) -> DataFrame:
    return facts.groupBy(F.coalesce("agent_id", F.lit("unknown")).alias("agent_id")).agg(F.count("*").alias("n"))


def counts_by(audit: DataFrame) -> DataFrame:
    return audit.groupBy("mutation_type").agg(F.count("*").alias("n"), F.max("at").alias("last_at"))


def attribution(facts: DataFrame) -> DataFrame:
    """Facts without an author whose session has exactly one known author: edge_id, agent_id."""
    known = facts.where("agent_id IS NOT NULL AND agent_id != 'unknown'").groupBy("session_id").agg(F.collect_set("agent_id").alias("who")).where(F.size("who") == 1).select("session_id", F.element_at("who", 1).alias("author"))
    return facts.where("agent_id IS NULL OR agent_id = 'unknown'").join(known, "session_id").select("edge_id", F.col("author").alias("agent_id"))


def gate_conversion(fired: DataFrame, audit: DataFrame) -> DataFrame:
    """One row: sessions stopped, and how many of them wrote a fact later. fired: session_id, at; audit: session_id, at, mutation_type."""
    wrote = audit.where("mutation_type = 'created'").select(F.col("session_id").alias("sid"), F.col("at").alias("wrote_at"))
    last = wrote.groupBy("sid").agg(F.max("wrote_at").alias("wrote_at"))
    first = fired.groupBy("session_id").agg(F.min("at").alias("at"))
    j = first.join(last, F.col("session_id") == F.col("sid"), "left")
    return j.agg(F.count("*").alias("fired"), F.count_if(F.col("wrote_at") > F.col("at")).alias("converted"))


def health(facts: DataFrame, nodes: DataFrame, edges: DataFrame, now: int) -> DataFrame:
    """One row of figures and a score of 0 to 100: silence, too few writers, unattributed facts and orphans cost points."""
    from .graph import orphans

    f = facts.agg(F.count("*").alias("facts"), F.floor((F.lit(now) - F.max("t_valid")) / DAY).alias("quiet_days"), F.countDistinct(F.when(F.col("agent_id") != "unknown", F.col("agent_id"))).alias("writers"), F.count_if(F.coalesce("agent_id", F.lit("unknown")) == "unknown").alias("unattributed"))
    n = nodes.agg(F.count("*").alias("nodes"))
    o = orphans(nodes, edges).agg(F.count("*").alias("orphans"))
    row = f.join(F.broadcast(n)).join(F.broadcast(o))
    quiet = F.when(F.col("quiet_days").isNull(), 40).when(F.col("quiet_days") > 7, F.least(F.lit(30), 10 + (F.col("quiet_days") - 7) * 2)).otherwise(0)
    loose = F.floor(F.least(F.lit(15.0), F.col("orphans") / F.greatest("nodes", F.lit(1)) * 50))
    points = 100 - quiet - F.when(F.col("writers") < 2, 20).otherwise(0) - loose - F.least(F.lit(15), F.col("unattributed"))
    return row.withColumn("score", F.when(F.col("facts") == 0, 0).otherwise(F.greatest(F.lit(0), F.least(F.lit(100), points))).cast("bigint"))


def queue_upsert(queue: DataFrame, seen: DataFrame) -> DataFrame:
    """The queue (path, digest, ingested_at, noticed_at) after documents (path, digest, noticed_at) were seen: a new digest opens an entry again."""
    j = queue.select("path", "digest", "ingested_at", "noticed_at").join(seen.select("path", F.col("digest").alias("new_digest"), F.col("noticed_at").alias("new_at")), "path", "full")
    changed = F.col("new_digest").isNotNull() & ~F.col("digest").eqNullSafe(F.col("new_digest"))
    return j.select("path", F.coalesce("new_digest", "digest").alias("digest"), F.when(changed, None).otherwise(F.col("ingested_at")).alias("ingested_at"), F.when(changed, F.col("new_at")).otherwise(F.col("noticed_at")).alias("noticed_at"))


def reconcile(disk: DataFrame, queue: DataFrame) -> DataFrame:
    """Documents on disk against the queue: new, changed, unchanged."""
    j = disk.select("path", "digest").join(queue.select("path", F.col("digest").alias("known")), "path", "left")
    state = F.when(F.col("known").isNull(), "new").when(F.col("known") != F.col("digest"), "changed").otherwise("unchanged")
    return j.groupBy(state.alias("state")).agg(F.count("*").alias("n"))


def worked_without_recording(activity: DataFrame, audit: DataFrame, edits: int = 5) -> DataFrame:
    wrote = audit.where("mutation_type = 'created'").select("session_id").distinct()
    return activity.where(F.col("n_edits") >= edits).join(wrote, "session_id", "left_anti")


def turn_batches(turns: DataFrame, size: int = 40) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy("session_id").orderBy("position"))
    return turns.withColumn("batch", F.floor((nth - 1) / size).cast("int"))


# Documents of these sources are read first.
SOURCE_ORDER = ["claude-memory", "project-instructions", "gstack-learnings"]


def pending_documents(queue: DataFrame, project: str | None = None) -> DataFrame:
    """Open entries (path, project, digest, noticed_at, source, ingested_at) with their position: by source, project, time noticed."""
    rank = F.lit(len(SOURCE_ORDER))
    for k, name in reversed(list(enumerate(SOURCE_ORDER))):
        rank = F.when(F.col("source") == name, k).otherwise(rank)
    todo = queue.where("ingested_at IS NULL")
    todo = todo if project is None else todo.where(F.col("project") == project)
    # one window a project and source; what comes before them is a count over few groups
    todo = todo.withColumn("source_rank", rank)
    groups = todo.groupBy("source_rank", "project").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("source_rank", "project").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    nth = F.row_number().over(Window.partitionBy("source_rank", "project").orderBy("noticed_at", "path"))
    placed = todo.withColumn("nth", nth).join(groups.withColumn("before", before).drop("n"), ["source_rank", "project"])
    return placed.select("path", "project", "digest", "noticed_at", "source", (F.col("before") + F.col("nth")).alias("position"))


def mark_ingested(queue: DataFrame, done: DataFrame, at: int, session_id: str | None = None) -> DataFrame:
    """The queue after the open ones of `done` (path) were read; `closed` says which rows that changed."""
    j = queue.join(done.select("path").distinct().withColumn("done", F.lit(True)), "path", "left")
    closed = F.coalesce("done", F.lit(False)) & F.col("ingested_at").isNull()
    return j.withColumn("closed", closed).withColumn("ingested_at", F.when(F.col("closed"), F.lit(at)).otherwise(F.col("ingested_at"))).withColumn("ingested_by_session", F.when(F.col("closed"), F.lit(session_id))).drop("done")


def session_activity(activity: DataFrame, audit: DataFrame) -> DataFrame:
    """session_id, n_edits, n_written: edits of a session and the facts that it created."""
    edits = activity.groupBy("session_id").agg(F.sum("n_edits").cast("bigint").alias("n_edits"))
    wrote = audit.where("mutation_type = 'created'").groupBy("session_id").agg(F.count("*").alias("n_written"))
    return edits.join(wrote, "session_id", "full").na.fill(0, ["n_edits", "n_written"])


def author_of(facts: DataFrame, asked: DataFrame) -> DataFrame:
    """edge_id, author of each fact asked for: its writer, 'unattributed' where it has none, 'unknown' where there is no such fact."""
    j = asked.select("edge_id").distinct().join(facts.select("edge_id", F.coalesce("agent_id", F.lit("unattributed")).alias("author")), "edge_id", "left")
    return j.select("edge_id", F.coalesce("author", F.lit("unknown")).alias("author"))


def record_reads(log: DataFrame, reads: DataFrame) -> DataFrame:
    """The read log with new reads: a read that returned nothing has a null instead of an empty list."""
    returned = F.when(F.size("returned") > 0, F.col("returned"))
    return log.unionByName(reads.withColumn("returned", returned), allowMissingColumns=True)


def unwritten_work(queue: DataFrame, audit: DataFrame, now: int) -> DataFrame:
    """One row: documents that wait, days since a fact was written, projects that wait."""
    waiting = queue.where("ingested_at IS NULL").agg(F.count("*").alias("pending"), F.count_distinct("project").alias("projects"))
    last = audit.where("mutation_type = 'created'").agg(F.floor((F.lit(now) - F.max("at")) / DAY).alias("days_since_write"))
    return waiting.join(F.broadcast(last))  # one row each


def recall_saves(saves: DataFrame, reads: DataFrame) -> DataFrame:
    """Saves (edge_id, written_by, recalled_by) that count: both named, different, once each; `delivered` where the read log shows
    that the reader was given the fact."""
    good = saves.where("trim(coalesce(written_by, '')) != '' AND trim(coalesce(recalled_by, '')) != '' AND written_by != recalled_by").select("edge_id", "written_by", "recalled_by").distinct()
    given = reads.select(F.explode("returned").alias("edge_id"), F.col("agent_id").alias("recalled_by")).distinct().withColumn("delivered", F.lit(True))
    return good.join(given, ["edge_id", "recalled_by"], "left").na.fill(False, ["delivered"])


def metrics(events: DataFrame, most: int = 1000) -> DataFrame:
    """name, label, n, total of counters (name, label, value): the first `most` labels of a name by time, the others under 'overflow'.
    Keys that would carry content are refused."""
    clean = events.where(~F.lower("name").rlike("(^|[._])(fact|text|query|prompt|content|payload)($|[._])"))
    first = clean.groupBy("name", "label").agg(F.min("at").alias("first_at"))
    nth = F.row_number().over(Window.partitionBy("name").orderBy("first_at", "label"))
    series = first.withColumn("series", F.when(nth <= most, F.col("label")).otherwise("overflow")).drop("first_at")
    return clean.join(series, ["name", "label"]).groupBy("name", F.col("series").alias("label")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))
