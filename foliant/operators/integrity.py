"""Integrity checks: references, balances, polarity, tie-out, identities and bills confidence.

Checks return rows with a code, never raise; a caller turns any row into a gap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exact import MONEY, total


def posted(vouchers: DataFrame) -> DataFrame:
    """Vouchers in the ordinary books: neither cancelled nor optional."""
    return vouchers.filter("not cancelled and not optional")


def missing(rows: DataFrame, key: str, dimension: DataFrame, dimension_key: str, code: str) -> DataFrame:
    """Keys of ``rows`` without a match, with how many rows have them. A null key is missing only if rows must have it."""
    keys = rows.groupBy(F.col(key).alias("missing")).agg(F.count("*").cast("long").alias("rows"))
    return keys.join(dimension.select(F.col(dimension_key).alias("_k")).distinct(), F.col("missing") == F.col("_k"), "left_anti").select(F.lit(code).alias("code"), F.col("missing").cast("string").alias("missing"), "rows")


def voucher_balances(entries: DataFrame, vouchers: DataFrame) -> DataFrame:
    """Per posted voucher: sum of its entries, how many, and balanced, unbalanced or (without entries) unavailable."""
    sums = entries.groupBy(F.col("vid").alias("_vid")).agg(F.sum("amount").cast(MONEY).alias("balance"), F.count("*").cast("long").alias("entries"))
    rows = posted(vouchers).join(sums, F.col("vid") == F.col("_vid"), "left")
    state = F.when(F.col("entries").isNull(), "unavailable").when(F.col("balance") == 0, "balanced").otherwise("unbalanced")
    return rows.select("vid", "balance", F.coalesce("entries", F.lit(0)).cast("long").alias("entries"), state.alias("state"))


def polarity_matches(amount: Column, polarity: Column) -> Column:
    """Debits are negative, credits aren't; zero matches either."""
    return (amount == 0) | (F.when(polarity == "debit", amount < 0).when(polarity == "credit", amount >= 0).otherwise(F.lit(False)))


def movements(entries: DataFrame, vouchers: DataFrame) -> DataFrame:
    """Per ledger: the sum and number of its posted entries."""
    live = entries.join(posted(vouchers).select("vid"), "vid", "left_semi")
    return live.groupBy("ledger").agg(total(F.col("amount")).alias("movement"), F.count("*").cast("long").alias("entries"))


def tie_out(moved: DataFrame, periods: DataFrame) -> DataFrame:
    """Period balances against movements: closing less opening must be the movement exactly, no movement being zero."""
    rows = periods.join(moved.select(F.col("ledger").alias("_l"), "movement"), F.col("ledger") == F.col("_l"), "left")
    change = (F.col("closing") - F.col("opening")).cast(MONEY)
    own = F.coalesce("movement", F.lit(0).cast(MONEY))
    return rows.select("ledger", change.alias("period_change"), own.alias("movement"), F.when(change == own, "matched").otherwise("mismatch").alias("state"))


def coverage(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys that only one side has."""
    a, b = left.select(F.col(key).alias("_a")).distinct(), right.select(F.col(key).alias("_b")).distinct()
    rows = a.join(b, F.col("_a") == F.col("_b"), "full_outer").filter("_a is null or _b is null")
    return rows.select(F.coalesce("_a", "_b").alias(key), F.when(F.col("_b").isNull(), "left_only").otherwise("right_only").alias("side"))


def resolve(rows: DataFrame, name: str, dimension: DataFrame, dimension_name: str, dimension_id: str) -> DataFrame:
    """``rows`` with the id of a name and a status: resolved, blank, missing, or ambiguous when the name isn't unique."""
    ids = dimension.groupBy(F.col(dimension_name).alias("_n")).agg(F.min(dimension_id).alias("_id"), F.count("*").alias("_c"))
    out = rows.join(ids, F.col(name) == F.col("_n"), "left")
    status = F.when(F.trim(F.coalesce(name, F.lit(""))) == "", "blank").when(F.col("_id").isNull(), "missing").when(F.col("_c") > 1, "ambiguous").otherwise("resolved")
    return out.withColumn("resolved_id", F.when(F.col("_c") == 1, F.col("_id"))).withColumn("status", status).drop("_n", "_id", "_c")


def duplicates(rows: DataFrame, *keys: str) -> DataFrame:
    """Keys with more than one row, by digest, and their occurrences."""
    framed = F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys])
    return rows.groupBy(*keys).agg(F.count("*").cast("long").alias("occurrences")).filter("occurrences > 1").select(F.sha2(framed, 256).alias("identity"), "occurrences")


def identity_matches(incoming: DataFrame, stored: DataFrame, ids: tuple[str, ...]) -> DataFrame:
    """Incoming rows against stored ones that agree in any of the ids: none, one, or a collision of several.

    The disjunction is a union of equi-joins, so no join compares all pairs.
    """
    hits = None
    for c in ids:
        a = incoming.select("record", F.col(c).alias("_k")).filter("_k is not null")
        b = stored.select(F.col("record").alias("stored"), F.col(c).alias("_s")).filter("_s is not null")
        one = a.join(b, F.col("_k") == F.col("_s")).select("record", "stored")
        hits = one if hits is None else hits.unionByName(one)
    counted = hits.distinct().groupBy(F.col("record").alias("_r")).agg(F.count("*").cast("long").alias("matches"), F.min("stored").alias("first"))
    n = F.coalesce("matches", F.lit(0)).cast("long")
    return incoming.select("record").join(counted, F.col("record") == F.col("_r"), "left").select("record", n.alias("matches"), F.when(n == 1, F.col("first")).alias("matched"), F.when(n == 0, "new").when(n == 1, "known").otherwise("collision").alias("state"))


def bijection(records: DataFrame, evidence: DataFrame, key: str) -> DataFrame:
    """Counts that are all zero if evidence covers the records one to one."""
    r, e = records.select(F.col(key).alias("k")), evidence.select(F.col(key).alias("k"))
    tagged = r.withColumn("r", F.lit(1)).withColumn("e", F.lit(0)).unionByName(e.withColumn("r", F.lit(0)).withColumn("e", F.lit(1)))
    per = tagged.groupBy("k").agg(F.sum("r").alias("r"), F.sum("e").alias("e"))
    return per.agg(*[F.count_if(c).cast("long").alias(n) for n, c in (("without_evidence", F.expr("r > 0 and e = 0")), ("without_record", F.expr("r = 0 and e > 0")), ("repeated_records", F.expr("r > 1")), ("repeated_evidence", F.expr("e > 1")))])


def multiset_difference(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
    """Rows whose numbers differ between the sides, with the excess on the left."""
    tagged = left.select(*keys, F.lit(1).alias("_d")).unionByName(right.select(*keys, F.lit(-1).alias("_d")))
    return tagged.groupBy(*keys).agg(F.sum("_d").cast("long").alias("excess")).filter("excess <> 0")


def bills_confidence(parties: DataFrame, allocations: DataFrame, outstanding: DataFrame) -> DataFrame:
    """Each party's confidence: the first of its own reasons, else the worst of its references.

    parties: party, and the columns ``authority_complete``, ``bracket``,
    ``bill_wise``, ``allocations_complete``, ``outstanding_complete``;
    allocations: party, reference, kind, amount, polarity; outstanding: party,
    reference, kind, pending, opening, due_date, source_overdue, expected_overdue.
    Each reference needs one anchor (not an Agst Ref) of the right kind, at most
    one outstanding row, and allocations that add up to what is pending.
    """
    keys = ["party", "reference"]
    named = allocations.filter("reference is not null")
    a = named.groupBy(*keys).agg(F.sum("amount").cast(MONEY).alias("allocated"), F.count_if(F.col("kind") != "Agst Ref").alias("anchors"), F.max(F.when(F.col("kind") != "Agst Ref", F.col("kind"))).alias("anchor_kind"), F.bool_or(~polarity_matches(F.col("amount"), F.col("polarity"))).alias("bad_polarity"))
    o = outstanding.groupBy(F.col("party").alias("_p"), F.col("reference").alias("_r")).agg(F.count("*").alias("rows"), F.sum("pending").cast(MONEY).alias("pending"), F.sum("opening").cast(MONEY).alias("opening"), F.max("kind").alias("open_kind"), F.bool_or(F.col("due_date").isNull()).alias("no_due"), F.bool_or(~F.col("source_overdue").eqNullSafe(F.col("expected_overdue"))).alias("overdue_differs"))
    both = a.join(o, F.col("party").eqNullSafe(F.col("_p")) & (F.col("reference") == F.col("_r")), "full_outer")
    state = (
        F.when((F.coalesce("anchors", F.lit(0)) != 1) | (F.col("rows").isNotNull() & (F.col("open_kind") != F.col("anchor_kind"))), "mismatch:bill_reference_kind_composition_invalid")
        .when(F.col("rows") > 1, "mismatch:duplicate_outstanding_reference")
        .when(F.col("rows").isNull() & (F.col("allocated") == 0), "matched:")
        .when(F.col("rows").isNull() | (F.col("allocated") != F.col("pending")), "mismatch:bill_pending_amount_mismatch")
        .when(F.col("no_due"), "unavailable:bill_due_date_unavailable")
        .when(F.col("overdue_differs"), "mismatch:source_overdue_days_mismatch")
        .when((F.abs("pending") < F.abs("opening")) & (F.col("pending") * F.col("opening") >= 0), "partially_settled:")
        .otherwise("matched:")
    )
    rows = both.select(F.coalesce("party", "_p").alias("party"), F.coalesce("bad_polarity", F.lit(False)).alias("bad_polarity"), state.alias("state"))
    code = F.split("state", ":")
    rows = rows.select("party", "bad_polarity", F.get(code, 0).alias("s"), F.get(code, 1).alias("r"))
    rank = F.when(F.col("s") == "mismatch", 4).when(F.col("s") == "unavailable", 3).when(F.col("s") == "partially_settled", 2).otherwise(1)
    worst = rows.groupBy(F.col("party").alias("_party")).agg(F.max(rank).alias("rank"), F.min(F.when(F.col("r") != "", F.struct((-rank).alias("k"), F.col("r").alias("r")))).getField("r").alias("reason"), F.bool_or("bad_polarity").alias("bad"), F.count("*").cast("long").alias("references"), F.count_if(F.col("s") == "mismatch").cast("long").alias("mismatches"))
    p = parties.join(worst, F.col("party") == F.col("_party"), "left")
    own = (
        F.when(~F.col("authority_complete"), "profile_unobserved:bills_profile_unobserved")
        .when(F.col("bracket") == "changed", "source_changed:bills_source_changed_during_fetch")
        .when(F.col("bracket") == "unavailable", "unavailable:bills_fetch_bracket_unavailable")
        .when(F.col("bill_wise") == "disabled", "bill_wise_disabled:bill_wise_tracking_disabled")
        .when(F.col("bill_wise") == "unknown", "unavailable:bill_wise_tracking_state_unknown")
        .when(~F.col("allocations_complete") | ~F.col("outstanding_complete"), "coverage_incomplete:bills_source_coverage_incomplete")
        .when(F.col("bad"), "mismatch:bill_allocation_polarity_mismatch")
        .when(F.col("rank").isNull(), "matched:proven_empty_observation_scope")
        .when(F.col("rank") == 4, F.concat(F.lit("mismatch:"), F.coalesce("reason", F.lit(""))))
        .when(F.col("rank") == 3, F.concat(F.lit("unavailable:"), F.coalesce("reason", F.lit(""))))
        .when(F.col("rank") == 2, "partially_settled:")
        .otherwise("matched:")
    )
    final = F.split(own, ":")
    return p.select("party", F.get(final, 0).alias("state"), F.get(final, 1).alias("reason"), F.coalesce("references", F.lit(0)).cast("long").alias("references"), F.coalesce("mismatches", F.lit(0)).cast("long").alias("mismatches"))


def transitions(events: DataFrame, allowed: dict[str, tuple[str, ...]], start: str) -> DataFrame:
    """Per job: its last state, and the number of steps that the table of transitions doesn't allow."""
    w = Window.partitionBy("job").orderBy("seq")
    pairs = F.array(*[F.lit(f"{a}>{b}") for a, bs in allowed.items() for b in bs])
    stepped = events.withColumn("_before", F.coalesce(F.lag("state").over(w), F.lit(start)))
    bad = ~F.array_contains(pairs, F.concat_ws(">", "_before", "state"))
    return stepped.withColumn("_bad", bad).groupBy("job").agg(F.max_by("state", "seq").alias("state"), F.count("*").cast("long").alias("steps"), F.count_if("_bad").cast("long").alias("bad_steps"))
