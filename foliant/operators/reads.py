"""Reads of a source and what they prove: brackets, pairs, admission, assembly, corroboration, pace."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Pairs of reads a scan may take, pairs kept for each date partition that may turn out empty.
MOST_PAIRS, WITNESS_PAIRS = 128, 3
# Per cent within which reads compare, reads looked back on, ms and bytes a read should take at most, ms by which a rise counts.
COMPARABLE, HISTORY, TARGET_MS, TARGET_BYTES, RISE_MS = 25, 32, 15_000, 28 * 1024 * 1024, 1_000


def bracket(extents: DataFrame) -> DataFrame:
    """Reads between two looks at the source's high-water marks (``opened``, ``closed`` structs): stable, changed, or unavailable if a look is missing."""
    state = F.when(F.col("opened").isNull() | F.col("closed").isNull(), "unavailable").when(F.col("opened") == F.col("closed"), "stable").otherwise("changed")
    return extents.withColumn("bracket", state)


def cutoff(last_voucher: Column, as_of: Column, books_from: Column) -> Column:
    """(cutoff, reason): the earlier of the last voucher and the day asked for; partial where the books begin later."""
    day = F.least(last_voucher, as_of)
    return F.struct(F.when(day >= books_from, day).alias("cutoff"), F.when(day < books_from, "as_of_precedes_books_from").alias("reason"))


def planned_pairs(partitions: Column, high_water: Column, width: Column) -> Column:
    """Pairs of reads that a scan needs: tiles by ranges, and those kept for partitions found empty (none in a book without vouchers)."""
    return partitions * F.ceil(high_water / width) + F.when(high_water > 0, partitions * WITNESS_PAIRS).otherwise(0)


def paired(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Two reads of each window (rows, bytes, hash): whether they agree, or which is missing."""
    b = second.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_{c}") for c in ("rows", "bytes", "hash")])
    same = (F.col("rows") == F.col("_rows")) & (F.col("bytes") == F.col("_bytes")) & (F.col("hash") == F.col("_hash"))
    state = F.when(F.col("_key").isNull() | F.col(key).isNull(), "unpaired").when(same, "passed").otherwise("mismatch")
    return first.join(b, F.col(key) == F.col("_key"), "full_outer").select(F.coalesce(key, "_key").alias(key), state.alias("state"))


def assembly(segments: DataFrame, rows: DataFrame) -> DataFrame:
    """Per partition: whether its segments ``(partition, low, high, complete)`` join up and its rows ``(partition, guid, alter_id)`` are unique."""
    w = Window.partitionBy("partition").orderBy("low")
    gap = F.col("low") != F.coalesce(F.lag("high").over(w), F.lit(0))
    per = segments.withColumn("_gap", gap).groupBy("partition").agg(F.count_if("_gap").alias("gaps"), F.count_if(~F.col("complete")).alias("open"))
    ids = rows.groupBy("partition", "guid").agg(F.count("*").alias("n"), F.min("alter_id").alias("a"), F.max("alter_id").alias("z"))
    alters = rows.groupBy("partition", "alter_id").agg(F.count("*").alias("n"))
    twice = ids.groupBy("partition").agg(F.count_if(F.col("n") > 1).alias("guids")).join(alters.groupBy("partition").agg(F.count_if(F.col("n") > 1).alias("alters")), "partition")
    code = (
        F.when(F.col("open") > 0, "segment_incomplete").when(F.col("gaps") > 0, "segments_not_contiguous")
        .when(F.coalesce("guids", F.lit(0)) > 0, "duplicate_voucher_guid").when(F.coalesce("alters", F.lit(0)) > 0, "duplicate_alter_id").otherwise("complete")
    )
    return per.join(twice, "partition", "left").select("partition", code.alias("state"))


def corroborated(empty: DataFrame, control: DataFrame, reread: DataFrame, cover: DataFrame) -> DataFrame:
    """Empty windows ``(series, win_from, win_to)`` with the verdict of their witness.

    ``control`` names the nearest filled window's first row (``series, win_from, guid``; none: no control), ``reread`` holds
    the rows seen when that was read again, and ``cover`` the rows of the wider reads (``series, day``): one inside
    the window contradicts it.
    """
    seen = reread.select(F.col("series").alias("_s"), F.col("guid").alias("_g")).distinct().withColumn("_seen", F.lit(True))
    rows = empty.join(control.select("series", "win_from", "guid"), ["series", "win_from"], "left")
    rows = rows.join(seen, (F.col("series") == F.col("_s")) & (F.col("guid") == F.col("_g")), "left")
    # Days of a window are few, so the range becomes an equal join on days.
    days = empty.select("series", "win_from", F.explode(F.sequence("win_from", "win_to")).alias("day"))
    hit = days.join(cover.select("series", "day").distinct(), ["series", "day"], "left_semi").select("series", "win_from").distinct().withColumn("_hit", F.lit(True))
    state = (
        F.when(F.col("guid").isNull(), "empty_date_partition_no_control").when(F.col("_seen").isNull(), "empty_date_witness_control_missing_row")
        .when(F.col("_hit"), "empty_date_window_contradicted_by_wider_read").otherwise("corroborated")
    )
    return rows.join(hit, ["series", "win_from"], "left").select("series", "win_from", "win_to", state.alias("state"))


def contradicting(empty: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows ``(series, day, ...)`` of a wider read that lie inside windows ``(series, win_from, win_to)`` which another read gave as empty, with their window."""
    # Days of a window are few, so the range becomes an equal join on days.
    days = empty.select(F.col("series").alias("_s"), "win_from", F.explode(F.sequence("win_from", "win_to")).alias("_day"))
    return rows.join(days, (F.col("series") == F.col("_s")) & (F.col("day") == F.col("_day"))).drop("_s", "_day")


def _near(a: Column, b: Column) -> Column:
    return F.abs(a - b) * 100 <= F.greatest(a, b, F.lit(1)) * COMPARABLE


def pace(observed: DataFrame) -> DataFrame:
    """Reads ``(series, seq, width, rows, bytes, ms)`` with ``stop`` and ``next_width``.

    A read compares with earlier ones of about its width, rows and bytes, among the last HISTORY. Where it and the two
    comparable ones before rise strictly, to TARGET_MS or more and by RISE_MS, reading stops. After three comparable
    reads (itself included) the width shrinks so that the worst of them would have stayed within the targets.
    """
    w = Window.partitionBy("series").orderBy("seq").rowsBetween(-HISTORY, 0)
    me = F.struct("seq", "width", "rows", "bytes", "ms")
    like = F.filter("_h", lambda x: _near(x["width"], F.col("width")) & _near(x["rows"], F.col("rows")) & _near(x["bytes"], F.col("bytes")))
    three = F.slice(F.reverse(F.sort_array(like)), 1, 3)
    seen = observed.withColumn("_h", F.collect_list(me).over(w)).withColumn("_t", three)
    a, b, c = (F.get("_t", i)["ms"] for i in (2, 1, 0))
    full = F.size("_t") == 3
    stop = full & (a < b) & (b < c) & (c >= TARGET_MS) & (c - a >= RISE_MS)
    narrow, slow, big = F.array_min(F.transform("_t", lambda x: x["width"])), F.array_max(F.transform("_t", lambda x: x["ms"])), F.array_max(F.transform("_t", lambda x: x["bytes"]))
    bound = lambda worst, target: F.when(worst > 0, F.greatest(F.call_function("div", narrow * F.lit(target), worst), F.lit(1))).otherwise(narrow)
    width = F.when(full, F.greatest(F.least(narrow, bound(slow, TARGET_MS), bound(big, TARGET_BYTES)), F.lit(1)))
    return seen.withColumn("stop", F.coalesce(stop, F.lit(False))).withColumn("next_width", width.cast("long")).drop("_h", "_t")


def aliases(rows: DataFrame, keys: list[str], value: str, order: Column, prefix: str) -> DataFrame:
    """Values numbered in the order of their first appearance under each key, zero-padded after a prefix."""
    first = rows.groupBy(*keys, value).agg(F.min(order).alias("_first"))
    n = F.row_number().over(Window.partitionBy(*keys).orderBy("_first", value))
    return first.withColumn("alias", F.concat(F.lit(prefix), F.lpad(n.cast("string"), 4, "0"))).drop("_first")
