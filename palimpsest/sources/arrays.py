"""JSON arrays that tasks read in parts, whatever their size.

Where a task begins in the middle of an array, it can't tell a brace in a string from one of the structure, nor how deep it is. So the file is read
twice. The first pass sums each block up for either case: how many quotes it holds (odd or even), and how far it goes down or up if it
begins outside a string, and if inside. Sums over the blocks before a block then say where it begins, and the second pass
cuts it into objects. Objects that lie across blocks are put together from their pieces. Spark's text reader does the reading (its lines end at
`}` here), so a block is what `spark.sql.files.maxPartitionBytes` says and any store that Spark reads will do.

Elements of the array that are no objects are left out. An object that never ends is a row too, with a broken text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TOKEN = re.compile(r'\\.|["{}\[\]]', re.S)
_STEP = {"{": 1, "[": 1, "}": -1, "]": -1}


def _sums(text: str) -> tuple[int, int, int]:
    """Quotes mod 2, change of depth if the text begins outside a string, and if inside one."""
    odd, depth = 0, [0, 0]
    for m in _TOKEN.finditer(text):
        if m[0] == '"':
            odd ^= 1
        elif m[0] in _STEP:
            depth[odd] += _STEP[m[0]]
    return odd, depth[0], depth[1]


_SUMMED = pa.schema([("file", pa.string()), ("block", pa.int64()), ("odd", pa.int32()), ("outside", pa.int64()), ("inside", pa.int64())])


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each block; a task reads its blocks whole and in order."""
    found: dict[tuple, tuple[int, int, int]] = {}
    for b in batches:
        for file, block, value in zip(*(b.column(c).to_pylist() for c in ("file", "block", "value"))):
            odd, out, inn = found.get((file, block), (0, 0, 0))
            o, x, y = _sums(value + "}")
            found[file, block] = (odd ^ o, out + (y if odd else x), inn + (x if odd else y))
    rows = [(*k, *v) for k, v in found.items()]
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_SUMMED)], schema=_SUMMED)


_PIECES = pa.schema([("file", pa.string()), ("block", pa.int64()), ("nth", pa.int64()), ("kind", pa.string()), ("json", pa.string())])


def _cut(table: pa.Table) -> pa.Table:
    """The pieces of a block: 'whole' objects, the 'end' of one that began before it, the 'begin' of one that goes on (or 'middle' of one that does both)."""
    table = table.sort_by("seq")
    file, block, within, depth = (table[c][0].as_py() for c in ("file", "block", "within", "depth"))
    text = "".join(v + "}" for v in table["value"].to_pylist())
    out, start, begun = [], 0 if depth > 1 else None, False
    for m in _TOKEN.finditer(text):
        if m[0] == '"':
            within ^= 1
        elif not within and m[0] in _STEP:
            depth += _STEP[m[0]]
            if m[0] == "{" and depth == 2:
                start, begun = m.start(), True
            elif m[0] == "}" and depth == 1 and start is not None:
                out.append(("whole" if begun else "end", text[start : m.end()]))
                start = None
    if start is not None:
        out.append(("begin" if begun else "middle", text[start:]))
    return pa.table([[file] * len(out), [block] * len(out), list(range(len(out))), [k for k, _ in out], [t for _, t in out]], schema=_PIECES)


def json_objects(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file, block, nth, json: the objects of JSON arrays as text; (file, block, nth) is their order in a file."""
    lines = spark.read.option("lineSep", "}").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    sums = lines.mapInArrow(_summed, "file string, block long, odd int, outside long, inside long")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row for each block of a file
    states = sums.withColumn("within", F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2)
    states = states.select("file", "block", F.col("within").cast("int").alias("within"), F.coalesce(F.sum(F.when(F.col("within") == 1, F.col("inside")).otherwise(F.col("outside"))).over(before), F.lit(0)).alias("depth"))
    numbered = lines.withColumn("seq", F.monotonically_increasing_id())  # lines of a block are read by one task, in order
    pieces = numbered.join(states, ["file", "block"]).groupBy("file", "block").applyInArrow(_cut, "file string, block long, nth long, kind string, json string")
    parts = pieces.where("kind != 'whole'")
    upto = Window.partitionBy("file").orderBy("block", "nth").rowsBetween(Window.unboundedPreceding, 0)  # two rows a block at most
    owned = parts.withColumn("owner", F.last(F.when(F.col("kind") == "begin", F.struct("block", "nth")), ignorenulls=True).over(upto)).where("owner IS NOT NULL")
    whole = owned.groupBy("file", "owner").agg(F.array_sort(F.collect_list(F.struct("block", "json"))).alias("p"))
    joined = whole.select("file", "owner.block", "owner.nth", F.array_join(F.transform("p", lambda x: x["json"]), "").alias("json"))
    return pieces.where("kind = 'whole'").drop("kind").unionByName(joined)


def json_array(spark: SparkSession, path: str | list[str], schema: str | T.StructType, limit: int | None = None) -> DataFrame:
    """The objects of JSON arrays, one row each, by the schema; limit: the first ones in the order of files and of each file."""
    found = json_objects(spark, path)
    if limit is not None:
        found = found.orderBy("file", "block", "nth").limit(limit)
    return found.select(F.from_json("json", schema).alias("o")).select("o.*")
