"""Bundles: a manifest and a file of canonical JSON lines under one digest; and the Markdown and JSON-lines sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import slug
from ..operators.govern import MAX_BUNDLE_FACTS, bundle_digest, canonical, redact

VERSION = 1
MAX_MANIFEST = 64 * 1024
MAX_BLOB = 16 * 1024 * 1024
CLAIM = ["relation_type", "fact", "confidence", "t_valid", "source", "target"]


def lines(facts: DataFrame) -> DataFrame:
    return facts.select("edge_id", canonical(*[c for c in (*CLAIM, "causal_hint", "source_type", "target_type") if c in facts.columns]).alias("line"))


def write(facts: DataFrame, path: str, bundle_id: str, policy: str = "minimal") -> DataFrame:
    """Redact, write lines in order of id and a manifest; returns the manifest."""
    kept = redact(facts, policy).where("rule IS NULL").drop("rule")
    body = lines(kept)
    manifest = bundle_digest(body).select(F.lit(bundle_id).alias("bundle_id"), F.lit(VERSION).alias("version"), F.lit(policy).alias("policy"), "n_facts", "content_digest")
    body.repartitionByRange(1 + kept.rdd.getNumPartitions() // 64, "edge_id").sortWithinPartitions("edge_id").select(F.to_json(F.struct("edge_id", "line")).alias("value")).write.mode("overwrite").text(f"{path}/facts")
    manifest.coalesce(1).write.mode("overwrite").json(f"{path}/manifest")
    return manifest


def read(spark: SparkSession, path: str) -> tuple[DataFrame, list[str]]:
    """Facts of a bundle and what is wrong with it, cheapest checks first: size of its files, version, number of facts, count, digest."""
    def size(part: str) -> int:
        files = spark.read.format("binaryFile").load(f"{path}/{part}").select("path", "length")  # contents are not read
        return files.agg(F.sum("length")).first()[0] or 0

    faults = [name for name, part, most in (("manifest too large", "manifest", MAX_MANIFEST), ("facts too large", "facts", MAX_BLOB)) if size(part) > most]
    body = spark.read.text(f"{path}/facts").select(F.from_json("value", "edge_id bigint, line string").alias("r")).select("r.*")
    if not faults:
        manifest = spark.read.schema("bundle_id string, version int, policy string, n_facts bigint, content_digest string").json(f"{path}/manifest").first()
        found = bundle_digest(body).first()
        if manifest is None or manifest["version"] != VERSION:
            faults.append("version")
        if found["n_facts"] > MAX_BUNDLE_FACTS:
            faults.append("too many facts")
        if manifest is not None and found["n_facts"] != manifest["n_facts"]:
            faults.append("count")
        if manifest is not None and found["content_digest"] != manifest["content_digest"]:
            faults.append("digest")
    claim = F.from_json("line", "relation_type string, fact string, confidence string, t_valid bigint, source string, target string, causal_hint string")
    return body.select("edge_id", claim.alias("c")).select("edge_id", "c.*"), faults


def pages(nodes: DataFrame, facts: DataFrame) -> DataFrame:
    """file, body: a Markdown page for each entity with its facts, newest first; equal slugs get numbers."""
    nth = F.row_number().over(Window.partitionBy("slug").orderBy("node"))
    named = nodes.withColumn("slug", F.when(slug(F.col("name")) != "", slug(F.col("name"))).otherwise("node")).withColumn("nth", nth)
    file = F.when(F.col("nth") == 1, F.concat("slug", F.lit(".md"))).otherwise(F.concat("slug", F.lit("-"), F.col("nth").cast("string"), F.lit(".md")))
    ends = facts.select("edge_id", "t_valid", "fact", F.explode(F.array_distinct(F.array("start_id", "end_id"))).alias("node"))
    bullets = ends.groupBy("node").agg(F.array_sort(F.collect_list(F.struct((-F.col("t_valid")).alias("k"), "edge_id", "fact"))).alias("rows"))
    text = F.array_join(F.transform("rows", lambda r: F.concat(F.lit("- "), r["fact"])), "\n")
    return named.join(bullets, "node", "left").select("node", file.alias("file"), F.concat(F.lit("# "), "name", F.lit("\n\n"), F.coalesce(text, F.lit("_No facts._"))).alias("body"))
