"""Helpers that the operators share: table access, checkpoint folder, Arrow batches."""

from __future__ import annotations

import ctypes
import inspect
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoints(spark: SparkSession) -> None:
    """Use the shared folder that the cluster names; a folder of our own only where none is set and all runs in one process (tests)."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints"))


def cut(df: DataFrame) -> DataFrame:
    """Write df to the checkpoint folder and read it from there: lineage ends, lost executors cost nothing."""
    ensure_checkpoints(df.sparkSession)
    return df.checkpoint(eager=True)


BATCH_ROWS = 2000
BATCH_BYTES = 32 << 20


def bounded(df: DataFrame) -> DataFrame:
    """df, with at most BATCH_ROWS rows and about BATCH_BYTES bytes of it in a worker's memory at once: texts may be long. Spark has these
    bounds for a session only; a smaller one that is set already stays, and no result depends on them."""
    conf = df.sparkSession.conf
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = "".join(c for c in str(conf.get(name)) if c.isdigit())
        if not 0 < int(now or 0) <= most:
            conf.set(name, str(most))
    return df


def tidied(df: DataFrame) -> DataFrame:
    """df; from now on Spark removes the shuffle files of a query when it ends. Else they stay until the driver happens to collect its garbage,
    and a chain of queries holds those of all its links. A frame that runs again makes them anew."""
    df.sparkSession.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    return df


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def same_bytes(a: np.ndarray, at_a: np.ndarray, b: np.ndarray, at_b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the strings of `size` bytes at at_a in a and at at_b in b are equal; both must go on for 8 bytes from the beginning of a
    string. Eight bytes of all strings are compared at once."""
    wide = [np.ndarray((max(len(x) - 7, 0),), "<u8", np.ascontiguousarray(x), strides=(1,)) for x in (a, b)]
    out = np.ones(len(size), bool)
    short = np.flatnonzero(size < 8)
    if len(short):
        mask = (np.uint64(1) << (np.uint64(8) * size[short].astype(np.uint64))) - np.uint64(1)
        out[short] = ((wide[0][at_a[short]] ^ wide[1][at_b[short]]) & mask) == 0
    live, step = np.flatnonzero(size >= 8), 0
    while len(live):
        at = np.minimum(step, size[live] - 8)
        out[live] &= wide[0][at_a[live] + at] == wide[1][at_b[live] + at]
        step += 8
        live = live[(size[live] > step) & out[live]]
    return out


def release() -> None:
    """Give memory that is free back to the system: idle workers keep theirs otherwise, beside those of the next stage."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def releasing(run):
    """A worker function that releases memory when it is done: of an iterator (mapInArrow), of a key and an iterator (groups), or of
    two tables (cogroups). Spark looks at the number of arguments and at the type hints."""
    if not inspect.isgeneratorfunction(run):

        def tables(left, right):
            out = run(left, right)
            release()
            return out

        return tables
    if len(inspect.signature(run).parameters) == 1:

        def batches(it):
            yield from run(it)
            release()

        return batches

    def group(key: tuple[pa.Scalar, ...], it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(key, it)
        release()

    return group


def text_bytes(value: str | None) -> bytes:
    return b"" if value is None else value.encode("utf-8", "surrogatepass")


def per_batch(fn: Callable[[dict], dict], schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A mapInArrow function from one that maps columns (lists) to columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = fn({n: b.column(i).to_pylist() for i, n in enumerate(b.schema.names)})
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in schema], schema=schema)

    return run


_SQL = {"int64": "bigint", "int32": "int", "double": "double", "string": "string", "binary": "binary", "bool": "boolean"}


def ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {_SQL[str(f.type)]}" for f in schema)


def map_columns(df: DataFrame, fn: Callable[[dict], dict], schema: pa.Schema) -> DataFrame:
    return bounded(df).mapInArrow(releasing(per_batch(fn, schema)), ddl(schema))
