"""Operator 8: mixing sources to target weights by pivotal dependent rounding.

Every source gets a target share of all words; its documents then each have the
same fractional number of copies (target / size, at most MAX_COPIES). The whole
part is granted at once. The fractional parts are rounded in pairs: words move at
random from one document to the other until one of the two fractions is 0 or 1, so the
expectation of each fraction and the words of the pair stay as they were. What is left
of a group is one document with a fraction; these residuals meet in the next level of
a reduction tree (FAN_IN groups a node) until one is left for each source, which is
rounded to the nearer side. So a source misses its target by less than one document.

Rows that agree in doc_id, source, text hash and size are one entry with a count (so a row that repeats a million
times, or lacks an id, makes no hot key); an entry counts GROUP rows at most, and entries are dealt by hash into groups of
a source, about GROUP rows each, so a source that holds a third of the rows is many groups. Random numbers
come from doc_id, text hash, the number among equal rows and the seed: reruns agree, however the input is cut into files. Texts
are not shuffled. The table of sources (one row a source) is ordered in one task.

A null text has size 0; a null source is a source of its own, ordered last; documents
without words are never taken; rows with an equal doc_id, or without one, are rounded on their own. An empty table gives an
empty table; long texts count whole. Other columns, whatever their names, are left out by mix and come back unchanged from
mixed_documents.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, map_columns, text_bytes

MAX_COPIES = 3
GROUP = 1000
FAN_IN = 64

_SIZED = pa.schema([("doc_id", pa.int64()), ("source", pa.string()), ("size", pa.int64()), ("mark", pa.int64())])


def _key(docs: DataFrame) -> list:
    """doc_id, source and the text's hash."""
    return [docs["doc_id"].cast("bigint").alias("doc_id"), docs["source"].cast("string").alias("source"), F.xxhash64(docs["text"]).alias("mark")]


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, mark (the text's hash): bytes.split() parts at exactly space and 09-0D."""
    return map_columns(docs.select(*_key(docs), docs["text"]), lambda c: {"doc_id": c["doc_id"], "source": c["source"], "size": [len(text_bytes(t).split()) for t in c["text"]], "mark": c["mark"]}, _SIZED)


def targets(rows: DataFrame, cycle: int = 3, max_copies: int = MAX_COPIES) -> DataFrame:
    """source, source_size, n_docs, target, of rows (source, size and, where given, n: how many such documents). Sources by code point (null last) weigh 1 .. cycle, repeating. A target over
    max_copies times its source stops there and its excess is shared out anew by weight. With the sources ordered by
    cap / weight, those that stop are a prefix; the others get one level times their weight."""
    rows = rows if "n" in rows.columns else rows.withColumn("n", F.lit(1))
    by_source = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("n_docs"))
    weighed = by_source.withColumn("weight", (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % cycle + 1)
    ratio = (max_copies * F.col("source_size") / F.col("weight")).alias("ratio")
    upto = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum(max_copies * F.col("source_size")).over(upto), F.lit(0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(upto), F.lit(0)))
    nth = F.row_number().over(Window.orderBy("ratio", F.col("source").asc_nulls_last()))
    found = weighed.withColumn("ratio", ratio).withColumn("level", level.cast("double")).withColumn("nth", nth)
    first = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("nth", "level"))).over(every)["level"]  # none from here on is above
    return found.select("source", "source_size", "n_docs", F.least((max_copies * F.col("source_size")).cast("double"), F.col("weight") * F.coalesce(first, F.lit(0.0))).alias("target"))


def _mix64(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def pivot(p: list[float], size: list[int], u: list[float]) -> tuple[list[int], int | None, float]:
    """Round fractions by pairs. Returns 0/1 for each document, and the index and fraction of the one that is left (its
    own 0/1 counts for nothing). Words p * size are kept exactly, but for that one."""
    out, left, f = [0] * len(p), None, 0.0
    for i in range(len(p)):
        if p[i] <= 0 or size[i] <= 0:
            continue
        if left is None:
            left, f = i, p[i]
            continue
        a, b = size[left], size[i]
        up = min((1 - f) * a, p[i] * b)  # words that can move to `left`
        down = min(f * a, (1 - p[i]) * b)  # and away from it
        if u[i] * (up + down) < down:
            g, q = f + up / a, p[i] - up / b
            full = up == (1 - f) * a
        else:
            g, q = f - down / a, p[i] + down / b
            full = down == f * a
        if full:  # `left` is integral now
            out[left] = int(g > 0.5)
            left, f = i, min(max(q, 0.0), 1.0)
        else:
            out[i] = int(q > 0.5)
            f = min(max(g, 0.0), 1.0)
        if f <= 1e-12 or f >= 1 - 1e-12:
            out[left] = int(f > 0.5)
            left, f = None, 0.0
    return out, left, f


_LEVEL = "doc_id bigint, source string, size bigint, mark bigint, nth bigint, n bigint, source_size bigint, target double, whole bigint, part double, bucket bigint, level int, done boolean"


def _round(seed: int, last: bool):
    """Rounds the fractions of a group. Ids stay Arrow columns: a null beside them leaves large ones as they are."""

    def run(g: pa.Table) -> pa.Table:
        n = g["n"].to_numpy()
        row = np.repeat(np.arange(len(n)), n)  # a row each
        nth = g["nth"].to_numpy()[row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        ids = g["doc_id"].fill_null(-1).to_numpy()[row].astype(np.int64).astype(np.uint64)
        mark, size, part = (g[c].to_numpy()[row] for c in ("mark", "size", "part"))
        level = g["level"][0].as_py()
        with np.errstate(over="ignore"):
            h = _mix64(ids * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed + 7919 * level))
            h = _mix64(h + _mix64(mark.astype(np.uint64) + nth.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)))
        order = np.lexsort((part, h, -size))  # long documents first: what is left is short, as a rule
        row, nth = row[order], nth[order]
        u = ((h[order] >> np.uint64(11)).astype(np.float64) / 2.0**53).tolist()
        taken, left, f = pivot(part[order].tolist(), size[order].tolist(), u)
        done, rest = np.ones(len(row), bool), np.zeros(len(row))
        if left is not None:
            if last:
                taken[left] = int(f >= 0.5)
            else:
                done[left], rest[left] = False, f
        new = {"nth": nth, "n": np.ones(len(row), np.int64), "whole": g["whole"].to_numpy()[row] + np.array(taken, dtype=np.int64) * done, "part": rest}
        new |= {"bucket": g["bucket"].to_numpy()[row] // FAN_IN, "level": np.full(len(row), level + 1, np.int32), "done": done}
        return pa.table({c: pa.array(new[c]) if c in new else g[c].take(pa.array(row)) for c in g.column_names})

    return run


def copies(docs: DataFrame, seed: int = 1, max_copies: int = MAX_COPIES) -> DataFrame:
    """doc_id, source, size, mark, source_size, target, copies: a row for each row of docs."""
    rows = cut(sized(docs).groupBy("doc_id", "source", "size", "mark").agg(F.count("*").alias("n")))
    goal = cut(targets(rows, max_copies=max_copies))
    most = goal.agg(F.max("n_docs")).first()[0] or 0
    each = rows.join(goal.withColumnRenamed("source", "goal_source"), F.col("source").eqNullSafe(F.col("goal_source"))).drop("goal_source")
    fraction = F.least(F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0), F.lit(float(max_copies)))
    each = each.withColumn("nth", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1, F.lit(GROUP).cast("bigint")))).withColumn("n", F.least(F.col("n") - F.col("nth"), F.lit(GROUP)).cast("bigint"))
    groups = F.greatest(F.ceil(F.col("n_docs") / GROUP), F.lit(1))
    todo = each.withColumn("f", fraction).select("doc_id", "source", "size", "mark", "nth", "n", "source_size", "target", F.floor("f").alias("whole"), (F.col("f") - F.floor("f")).alias("part"), F.pmod(F.xxhash64("doc_id", "mark", "nth"), groups).cast("bigint").alias("bucket"), F.lit(0).alias("level"), F.lit(False).alias("done"))
    finished, groups_left = [], max(1, math.ceil(most / GROUP))
    while True:
        last = groups_left == 1
        stage = todo.groupBy("source", "bucket").applyInArrow(_round(seed, last), _LEVEL)
        if last:
            finished.append(stage)
            break
        stage = cut(stage)
        finished.append(stage.where("done"))
        todo, groups_left = stage.where(~F.col("done")), math.ceil(groups_left / FAN_IN)
    out = finished[0]
    for more in finished[1:]:
        out = out.unionByName(more)
    return out.select("doc_id", "source", "size", "mark", "source_size", "target", F.col("whole").alias("copies"))


def mix(docs: DataFrame, seed: int = 1) -> DataFrame:
    """doc_id, size, source_size, target, taken."""
    return copies(docs, seed).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, seed: int = 1) -> DataFrame:
    """The rows of docs, each as often as the mix takes it. Rows that agree in doc_id, source and text share their copies."""
    taken = copies(docs, seed).groupBy("doc_id", "source", "mark").agg(F.sum("copies").alias("total"), F.count("*").alias("n")).where("total > 0")
    taken = taken.select(F.col("doc_id").alias("id"), F.col("source").alias("of"), F.col("mark").alias("like"), "total", "n")
    rows = docs.select(F.struct("*").alias("row"), *_key(docs))
    met = rows.join(taken, rows["doc_id"].eqNullSafe(taken["id"]) & rows["source"].eqNullSafe(taken["of"]) & (rows["mark"] == taken["like"]))
    once = met.where("n = 1").select("row", F.col("total").alias("times"))
    nth = F.row_number().over(Window.partitionBy("id", "of", "like").orderBy(F.xxhash64("row")))
    several = met.where("n > 1").select("row", (F.floor(F.col("total") / F.col("n")) + F.when(nth <= F.col("total") % F.col("n"), 1).otherwise(0)).alias("times"))
    every = once.unionByName(several).where("times >= 1")
    return every.select("row", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).select("row.*")
