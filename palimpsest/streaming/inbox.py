"""The event inbox as streams: validated, deduplicated within the replay window, drained in micro-batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import events

SCHEMA = "group_id string, event_id string, event_type string, schema_version int, occurred_at bigint, received_at bigint, agent string, payload string, scope_group string, arrival bigint, sign string, subject string"


def source(spark: SparkSession, path: str, files: int = 1) -> DataFrame:
    """Envelopes from JSON files as they come."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files).json(path)


def accepted(stream: DataFrame) -> DataFrame:
    """Valid envelopes, each (group_id, event_id) once within the replay window. State is bounded by the watermark."""
    good = stream.withColumn("reason", events.reason(F.col("received_at"))).where("reason IS NULL").drop("reason")
    timed = good.withColumn("event_time", F.timestamp_seconds("received_at")).withWatermark("event_time", f"{events.MAX_AGE} seconds")
    return timed.dropDuplicatesWithinWatermark(["group_id", "event_id"])


def rejected(stream: DataFrame) -> DataFrame:
    return stream.withColumn("reason", events.reason(F.col("received_at"))).where("reason IS NOT NULL")


def counts(stream: DataFrame, width: str = "1 hour") -> DataFrame:
    """Events a scope, type and hour; a window closes when the watermark passes it."""
    timed = stream.withColumn("event_time", F.timestamp_seconds("received_at")).withWatermark("event_time", f"{events.MAX_AGE} seconds")
    return timed.groupBy(F.window("event_time", width), "group_id", "event_type").agg(F.count("*").alias("n"))


def drain(stream: DataFrame, sink: str, checkpoint: str, apply: Callable[[DataFrame], DataFrame] = events.apply) -> None:
    """Apply what there is, micro-batch by micro-batch, in order of arrival within each scope; a batch that is done again
    overwrites its own folder, so facts are written once."""
    def batch(df: DataFrame, number: int) -> None:
        ordered = df.repartition("group_id").sortWithinPartitions("group_id", "received_at", "event_id")
        apply(ordered).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    accepted(stream).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
