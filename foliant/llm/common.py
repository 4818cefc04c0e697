"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java patterns of what separates words (the six ASCII white-space bytes), and of a word.
SPACES, WORD = r"[\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]+"

#: Rows in an Arrow batch; texts may be long, so fewer than Spark's own default.
BATCH_ROWS = 512
#: Bytes in an Arrow batch: many long texts, or packed rows, would take that much in the JVM and in Python each.
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session names none and runs in one process (local tests) a temporary one is set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='foliant-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/foliant-{name}-{uuid.uuid4().hex}"


def stage(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write ``df`` as a table in the shared folder, read it back."""
    path = new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have yet."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def column_at(df: DataFrame, name: str) -> int:
    """Where a column is; as in Spark, case doesn't matter unless only one of several matches exactly."""
    return df.columns.index(name) if name in df.columns else [c.lower() for c in df.columns].index(name.lower())


def small_batches(spark: SparkSession) -> None:
    """Bound the rows and bytes that one Arrow batch hands to Python; the settings stay with the session, as its later jobs read them."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def words(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once a row, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def fits(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` has at most so many rows; counts no further than that."""
    return df.limit(rows + 1).count() <= rows


def maybe_broadcast(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """Mark a checked small side for broadcast; a larger one stays for a shuffled join."""
    return F.broadcast(df) if fits(df, rows) else df


def skew_join(left: DataFrame, right: DataFrame, key: str, share: str, total: int, how: str = "inner") -> DataFrame:
    """``left`` joined with ``right`` (one row a key) on the key. ``share`` tells how many of the ``total`` rows of
    ``left`` a key has; keys with more than a thousandth of them, so less than a thousand keys, are broadcast."""
    hot = F.col(share) * 1000 > total
    often = F.broadcast(right.filter(hot))
    rest = left.join(often.select(key), key, "left_anti").join(right.filter(~hot), key, how)
    return left.join(often, key).unionByName(rest)


# Arrow side -----------------------------------------------------------------


def tidy(*memos: dict) -> Callable:
    """For functions that a task's batches run through: when they end, ``memos`` are emptied and what the worker has
    freed goes back to the system. A worker lives on for other stages, and what each leaves behind would add up."""

    def wrap(task):
        @wraps(task)
        def run(*args):
            try:
                yield from task(*args)
            finally:
                for memo in memos:
                    memo.clear()
                pa.default_memory_pool().release_unused()
                # Only glibc has it: numpy's arrays and Python's strings lie on its heap.
                if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
                    trim(0)

        return run

    return wrap


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenate the slices ``flat[start:start + length]``."""
    ends = np.cumsum(lengths)
    if not len(ends) or not ends[-1]:
        return flat[:0]
    at = np.repeat(starts - ends + lengths, lengths)
    at += np.arange(ends[-1])
    return flat[at]


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t.type) for c, t in zip(columns, schema, strict=True)], schema=schema)
