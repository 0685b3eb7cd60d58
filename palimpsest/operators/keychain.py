"""Chains of verifications under keys that change: each link names the key that signed it, and is checked with that key.

A digest covers the digest before it and the claim, by HMAC-SHA256 or, without a key, SHA-256. Making a chain is sequential by nature: scopes are
dealt to tasks and sorted, and a task reads its links as they come, holding one digest a scope. Checking is not: every link is compared with the
digest stored before it and recomputed behind it, all at once and with built-in functions only, so a change in one link is one finding.
"""

from __future__ import annotations

import hashlib
import hmac
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .govern import GENESIS

UNKEYED = "unkeyed"
CHAIN_VERSION = 1
Ring = dict[str, str]  # key id -> key


def hmac_sha256(key: str, message: Column) -> Column:
    """HMAC of a binary column, in hexadecimal digits."""
    raw = key.encode()
    block = (hashlib.sha256(raw).digest() if len(raw) > 64 else raw).ljust(64, b"\0")
    inner, outer = (F.lit(bytearray(b ^ pad for b in block)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message), 256))), 256)


def digest_of(prev: Column, body: Column, key_id: Column, ring: Ring) -> Column:
    """The digest that a link should have; null where its key is not in the ring."""
    message = F.concat(prev, F.lit("\n"), body).cast("binary")
    made = F.when(key_id == UNKEYED, F.concat(F.lit("sha256:"), F.sha2(message, 256)))
    for name, key in ring.items():
        made = made.when(key_id == name, F.concat(F.lit("hmac-sha256:"), hmac_sha256(key, message)))
    return made


def parse_ring(text: str) -> Ring:
    """`id:key,id:key`; an entry without an id or a key is an error, since a chain without a key must not pass for one with a key."""
    ring: Ring = {}
    for entry in filter(None, (e.strip() for e in text.split(","))):
        name, _, key = entry.partition(":")
        if not name.strip() or not key.strip():
            raise ValueError(f"{entry!r} is not id:key")
        ring[name.strip()] = key.strip()
    return ring


_LINKS = "group_id string, seq long, verification_id long, key_id string, prev_digest string, digest string, chain_version int"
_SCHEMA = pa.schema([("group_id", pa.string()), ("seq", pa.int64()), ("verification_id", pa.int64()), ("key_id", pa.string()), ("prev_digest", pa.string()), ("digest", pa.string()), ("chain_version", pa.int32())])


def _sign(ring: Ring):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, prev = None, GENESIS
        for b in batches:
            rows = []
            for r in b.to_pylist():
                if r["group_id"] != group:
                    group, prev = r["group_id"], GENESIS
                if r["head"] is not None:  # where an earlier chain ended
                    prev = r["head"]
                    continue
                message = f"{prev}\n{r['body']}".encode()
                if r["key_id"] == UNKEYED:
                    made = "sha256:" + hashlib.sha256(message).hexdigest()
                else:
                    made = "hmac-sha256:" + hmac.new(ring[r["key_id"]].encode(), message, hashlib.sha256).hexdigest()
                rows.append((group, r["seq"], r["verification_id"], r["key_id"], prev, made, CHAIN_VERSION))
                prev = made
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], f.type) for i, f in enumerate(_SCHEMA)], schema=_SCHEMA)

    return run


def attest(claims: DataFrame, ring: Ring, chain: DataFrame | None = None) -> DataFrame:
    """Links for claims (group_id, seq, verification_id, key_id, body), in order of seq. chain: what the scopes have already; new links go on
    from its heads. A key id that is not in the ring is an error: signing with another key would not be seen."""
    rows = claims.select("group_id", "seq", "verification_id", "key_id", "body", F.lit(None).cast("string").alias("head"))
    if chain is not None:
        heads = chain.where(F.col("chain_version") == CHAIN_VERSION).groupBy("group_id").agg(F.max(F.struct("seq", "digest")).alias("h"))
        none = F.lit(None).cast("string")
        rows = rows.unionByName(heads.select("group_id", "h.seq", F.lit(None).cast("long").alias("verification_id"), none.alias("key_id"), none.alias("body"), F.col("h.digest").alias("head")))
    # by a hash, not by the column: where both parts of the union are dealt by group_id already, Spark leaves such a shuffle out, and merges
    # partitions of each part on its own, so that a head can miss its claims
    dealt = rows.repartition(F.xxhash64("group_id")).sortWithinPartitions("group_id", "seq", F.col("head").isNull())
    return dealt.mapInArrow(_sign(ring), _LINKS)


def verify(chain: DataFrame, claims: DataFrame, ring: Ring) -> DataFrame:
    """chain with `broken` (its prev is not the digest stored before it) and `finding`: 'vanished' (the claim is gone), 'unverifiable' (its key is not in
    the ring), 'altered' (digest and claim differ) or null. claims as they are now: verification_id, body."""
    now = chain.where(F.col("chain_version") == CHAIN_VERSION)
    before = F.coalesce(F.lag("digest").over(Window.partitionBy("group_id").orderBy("seq")), F.lit(GENESIS))
    linked = now.withColumn("broken", before != F.col("prev_digest")).join(claims.select("verification_id", "body"), "verification_id", "left")
    made = digest_of(F.col("prev_digest"), F.col("body"), F.col("key_id"), ring)
    finding = F.when(F.col("body").isNull(), "vanished").when(made.isNull(), "unverifiable").when(made != F.col("digest"), "altered")
    return linked.withColumn("finding", finding).drop("body")


def report(verified: DataFrame) -> DataFrame:
    """What a scope's chain is worth: links, findings of each kind, whether it is keyed throughout or in part, and by which keys."""
    n = lambda kind: F.count_if(F.col("finding") == kind).alias(kind)
    keyed = F.col("key_id") != UNKEYED
    return verified.groupBy("group_id").agg(
        F.count("*").alias("n_attested"), n("altered"), n("vanished"), n("unverifiable"), F.count_if("broken").alias("broken"), F.min(keyed).alias("keyed"), (F.min(keyed) != F.max(keyed)).alias("mixed_keying"), F.array_sort(F.collect_set("key_id")).alias("key_ids")
    )
