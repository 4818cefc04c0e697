"""Order over all rows without gathering them: places by ranges, keyset pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import staged

#: Rows of a partition are numbered in so many low bits of ``monotonically_increasing_id``.
LOW_BITS = 33


def placed(df: DataFrame, *order: Column, name: str = "place") -> DataFrame:
    """The rows with their place (from 1) in the order.

    Rows are dealt into ranges and sorted there, written once, and numbered by
    the sizes of the ranges before; so no task holds more than a range, and the
    driver holds a number for each.
    """
    ranges = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    kept = staged(ranges, "ranges").withColumn("_range", F.shiftright("_id", LOW_BITS))
    sizes = kept.groupBy("_range").agg(F.count("*").alias("_n"))
    before = sizes.select(F.col("_range"), F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))  # a row for each range
    place = F.col("_before") + F.col("_id").bitwiseAND((1 << LOW_BITS) - 1) + 1
    return kept.join(F.broadcast(before), "_range").withColumn(name, place.cast("long")).select(*df.columns, name)


def page_after(df: DataFrame, key: str, last, rows: int) -> DataFrame:
    """The next rows by key after the last one seen."""
    return (df if last is None else df.filter(F.col(key) > F.lit(last))).orderBy(key).limit(rows)
