"""Telemetry of fixed cardinality: histograms, count buckets, retry delays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bucket(value: Column, bounds: tuple[int, ...]) -> Column:
    """Index of the first inclusive upper bound that holds the value; one more than the last beyond all."""
    out = F.when(value <= bounds[0], 0)
    for i, b in enumerate(bounds[1:], 1):
        out = out.when(value <= b, i)
    return out.otherwise(len(bounds)).cast("long")


def histogram(attempts: DataFrame, column: str, bounds: tuple[int, ...]) -> DataFrame:
    return attempts.groupBy("class", "outcome", bucket(F.col(column), bounds).alias("bucket")).agg(F.count("*").cast("long").alias("attempts"))


def count_bucket(n: Column) -> Column:
    """Counts as ranges, so that exports tell no exact number beyond one."""
    return F.when(n == 0, "0").when(n == 1, "1").when(n <= 5, "2-5").when(n <= 20, "6-20").when(n <= 100, "21-100").when(n <= 1000, "101-1000").otherwise(">1000")


def retry_delay_ms(done: Column, entropy: Column, most: int = 3) -> Column:
    """250 ms doubled with each attempt after the first up to 2 s, and up to a fifth more by entropy; 0 after ``most`` attempts."""
    base = F.least(F.lit(2000), (250 * F.pow(F.lit(2), F.greatest(done - 1, F.lit(0)))).cast("int"))
    return F.when(done >= most, 0).otherwise(base + F.pmod(entropy, (base / 5).cast("int") + 1))


def sync_backoff_s(attempt: Column) -> Column:
    """Seconds before a sync is tried again; null once it isn't."""
    return F.when(attempt == 0, 30).when(attempt == 1, 120).when(attempt == 2, 600).cast("long")
