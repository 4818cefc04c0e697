"""The folder that driver and executors share, and tables written there to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession, name: str) -> str:
    """A new path below ``spark.checkpoint.dir``; only a session that runs in one process may name none."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        shared = f"file://{tempfile.mkdtemp(prefix='foliant-')}"
        spark.conf.set("spark.checkpoint.dir", shared)
    return f"{shared.rstrip('/')}/foliant-{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a table in the shared folder and read back."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a partition that ``dealt`` makes, about.
PART_ROWS = 500_000


def dealt(df: DataFrame, *keys: str, rows: int | None = None) -> DataFrame:
    """``df`` in partitions by its keys, as many as its rows (counted, unless given) ask for: what a task holds doesn't grow with the table."""
    n = df.count() if rows is None else rows
    return df.repartition(max(n // PART_ROWS + 1, df.sparkSession.sparkContext.defaultParallelism), *keys)


def small(df: DataFrame, rows: int = 100_000) -> bool:
    """Whether ``df`` has at most so many rows; counts no further."""
    return df.limit(rows + 1).count() <= rows
