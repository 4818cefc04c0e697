"""Windows and proof: tiles, contiguity, evidence counts, digests, chains, freshness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Hex digits by which a digest's rows are dealt.
PREFIX = 3


def contiguity(ranges: DataFrame, keys: list[str], start: str, end: str, first: int, last: Column) -> DataFrame:
    """Half-open ranges per key: do they begin at ``first``, touch each other and end at ``last``?"""
    w = Window.partitionBy(*keys).orderBy(start, end)
    touched = ranges.withColumn("_before", F.lag(end).over(w))
    gap = F.when(F.col("_before").isNull(), F.col(start) != first).otherwise(F.col(start) != F.col("_before"))
    return touched.withColumn("_gap", gap).groupBy(*keys).agg(F.count("*").cast("long").alias("tiles"), F.count_if("_gap").cast("long").alias("gaps"), (F.max(end) == F.first(last)).alias("complete"))


def nearest(empty: DataFrame, filled: DataFrame) -> DataFrame:
    """For each empty window the filled one with the smallest gap of days, the earlier at ties.

    Both sides are windows of one reporting period (a row a month or so), so the
    nearest neighbours on each side come from one ordered pass over their union.
    """
    both = empty.select("series", "win_from", "win_to", F.lit(True).alias("empty")).unionByName(filled.select("series", "win_from", "win_to", F.lit(False).alias("empty")))
    w = Window.partitionBy("series").orderBy("win_from")
    own = F.when(~F.col("empty"), F.struct("win_from", "win_to"))
    seen = both.withColumn("_l", F.last(own, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))).withColumn("_r", F.first(own, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)))
    left, right = F.date_diff("win_from", F.col("_l.win_to")), F.date_diff(F.col("_r.win_from"), "win_to")
    use_left = F.col("_l").isNotNull() & (F.col("_r").isNull() | (left <= right))
    return seen.filter("empty").select("series", "win_from", F.when(use_left, F.col("_l.win_from")).otherwise(F.col("_r.win_from")).alias("nearest_from"), F.when(use_left, left).otherwise(right).cast("long").alias("gap_days"))


def ordered_digest(rows: DataFrame, keys: list[str], *parts: Column) -> DataFrame:
    """Per key: a digest of its rows whatever their order, and their number.

    Two levels, so that no list grows with a key: the sorted digests of its rows
    that begin with the same ``PREFIX`` hex digits give one digest, and those, in
    order, the key's. Each of the 4,096 lists has 64 bytes a row.
    """
    row = F.sha2(F.concat(*[F.concat(F.octet_length(p).cast("string"), F.lit(":"), p) for p in parts]), 256)
    joined = lambda c: F.sha2(F.array_join(c, ""), 256)
    low = rows.select(*keys, row.alias("_d")).groupBy(*keys, F.substring("_d", 1, PREFIX).alias("_p")).agg(joined(F.sort_array(F.collect_list("_d"))).alias("_low"), F.count("*").alias("_n"))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("_p", "_low"))), lambda x: x["_low"])
    return low.groupBy(*keys).agg(joined(ordered).alias("digest"), F.sum("_n").cast("long").alias("records"))


def across(observed: DataFrame, master: bool = False) -> DataFrame:
    """Identities in several windows: the same content is a duplicate (fine for masters), other content a change."""
    per = observed.groupBy("sid").agg(F.count_distinct("win").alias("windows"), F.count_distinct("hash").alias("hashes"))
    code = F.when(F.col("hashes") > 1, "source_changed_during_snapshot").when(F.lit(not master), "duplicate_record_across_windows")
    return per.filter("windows > 1").select("sid", code.alias("code")).filter("code is not null")


# Gap codes of a run are fixed values.
def gap_codes(windows: DataFrame) -> DataFrame:
    """Per run: the sorted set of gap codes of its windows, and whether it is verified (no code at all).

    Counts: parsed, accepted, rejected, deduped, duplicates, out_of_range, source_count (null: unavailable) and source_scope.
    """
    c = F.col
    codes = F.array(
        F.when(c("parsed") != c("accepted") + c("rejected"), "parse_accept_count_mismatch"),
        F.when((c("accepted") < c("deduped")) | (c("accepted") - c("deduped") != c("duplicates")), "accept_dedupe_count_mismatch"),
        F.when(c("rejected") > 0, "rejected_snapshot_records"),
        F.when(c("duplicates") > 0, "duplicate_source_identity"),
        F.when(c("out_of_range") > 0, "response_date_outside_window"),
        F.when(c("source_count").isNull(), "source_count_unavailable"),
        F.when((c("source_scope") == "window") & (c("source_count") != c("deduped")), "window_source_accepted_count_mismatch"),
        F.when(c("source_scope") == "window", "source_count_window_only"),
        F.when(c("stability") == "passed", "source_cut_atomicity_unavailable").when(c("stability") == "mismatch", "source_changed_during_run").otherwise("source_cut_consistency_unavailable"),
    )
    gaps = windows.select("run", F.explode(F.filter(codes, lambda x: x.isNotNull())).alias("gap"))
    found = gaps.groupBy(F.col("run").alias("_run")).agg(F.array_join(F.sort_array(F.collect_set("gap")), ",").alias("gaps"))
    runs = windows.select("run").distinct().join(found, F.col("run") == F.col("_run"), "left")
    return runs.select("run", F.coalesce("gaps", F.lit("")).alias("gaps"), F.when(F.col("gaps").isNull(), "verified").otherwise("partial").alias("state"))


def chain(entries: DataFrame) -> DataFrame:
    """Per chain: entries whose recorded previous digest isn't the one before, or whose own digest is wrong."""
    w = Window.partitionBy("chain").orderBy("seq")
    before = F.coalesce(F.lag("entry_hash").over(w), F.lit("genesis"))
    checked = entries.withColumn("_link", F.col("prev_hash") == before).withColumn("_own", F.col("entry_hash") == F.sha2(F.concat_ws("|", "prev_hash", "payload"), 256))
    return checked.groupBy("chain").agg(F.count("*").cast("long").alias("entries"), F.count_if(~F.col("_link")).cast("long").alias("broken_links"), F.count_if(~F.col("_own")).cast("long").alias("broken_entries"))


def freshness(last: DataFrame, completed: str, now: Column, target_s: int) -> DataFrame:
    """fresh, stale, clock_moved_backwards or never_verified."""
    age = F.unix_timestamp(now) - F.unix_timestamp(completed)
    state = F.when(F.col(completed).isNull(), "never_verified").when(age < 0, "clock_moved_backwards").when(age <= target_s, "fresh").otherwise("stale")
    return last.withColumn("age_s", age.cast("long")).withColumn("freshness", state)


def latest(rows: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The last n rows per key."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long")).filter(F.col("place") <= n)


def trend(performance: DataFrame, rise_s: float, least_s: float) -> DataFrame:
    """Where three reads of a series in a row rise strictly to at least ``least_s`` and by ``rise_s``, reading stops."""
    w = Window.partitionBy("series").orderBy("seq")
    a, b, c = F.lag("seconds", 2).over(w), F.lag("seconds", 1).over(w), F.col("seconds")
    return performance.withColumn("stop", F.coalesce((a < b) & (b < c) & (c >= least_s) & (c - a >= rise_s), F.lit(False)))
