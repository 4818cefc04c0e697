"""Outstandings: reports, residuals, lifecycles and statements over open bills.

Receivable bills have negative balances, payable ones positive. All grouping
keys may be led by a company column: one job serves any number of companies.
Bills are aggregated before they are joined, so joins never fan out.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import bucket, overdue_days
from ..functions.exact import MONEY, direction, total, total_if
from ..functions.ident import group_name, reserved_root
from ..sources.shared import small, staged

# Reserved names of groups whose ledgers are parties; codes of a walk that can't end.
PARTY_GROUPS = ("Sundry Debtors", "Sundry Creditors")
UNRESOLVED, CYCLE = "ledger_group_parent_unresolved", "group_parent_cycle"
BUCKETS = (("0-30", "b0_30"), ("31-60", "b31_60"), ("61-90", "b61_90"), ("90+", "b90_plus"))


def bill_totals(bills: DataFrame, age: Column, not_due_first: bool, keys: tuple[str, ...] = ()) -> DataFrame:
    """Totals by direction, and amounts and counts of receivable bills by age.

    With ``not_due_first`` a bill without an age (due in the future) goes to the
    first bucket; without it such a bill is in none.
    """
    b = F.coalesce(bucket(age), F.lit("0-30")) if not_due_first else bucket(age)
    open_, owed = bills.filter("closing <> 0").withColumn("_bucket", b), F.col("closing") < 0
    sums = [total_if(owed & (F.col("_bucket") == label), -F.col("closing")).alias(name) for label, name in BUCKETS]
    counts = [F.count_if(owed & (F.col("_bucket") == label)).cast("long").alias(f"n{name[1:]}") for label, name in BUCKETS]
    return open_.groupBy(*keys).agg(
        total_if(owed, -F.col("closing")).alias("receivable"),
        total_if(~owed, F.col("closing")).alias("payable"),
        *sums, *counts,
        F.count_if(owed).cast("long").alias("open_bills"),
        F.count_if(owed & age.isNull()).cast("long").alias("not_due"),
    )


def parties(bills: DataFrame, as_of: Column) -> DataFrame:
    """Per party: receivable, payable, their sum, and the largest age of a bill that is due."""
    owed = F.col("closing") < 0
    return bills.filter("closing <> 0").groupBy("party").agg(
        total_if(owed, -F.col("closing")).alias("receivable"),
        total_if(~owed, F.col("closing")).alias("payable"),
        total(F.abs("closing")).alias("total"),
        F.max(overdue_days(F.col("due_date"), as_of)).cast("long").alias("max_age"),
    )


def top(found: DataFrame, n: int = 10) -> DataFrame:
    return found.orderBy(F.desc("total"), F.asc("party")).limit(n)


def checked(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """Marked for broadcast if it has at most so many rows."""
    return F.broadcast(df) if small(df, rows) else df


#: Groups that are sent to every task at most.
SENT_GROUPS = 100_000


def ancestry(groups: DataFrame, most: int = 32) -> DataFrame:
    """``(name, ancestor, depth, reserved_name)`` for each group and all above it; the root, or a blank parent, ends a walk.

    A parent that no group has, and a walk of more than ``most`` steps (a
    cycle), yield a row with a null ancestor, whose reserved_name tells which:
    ``UNRESOLVED`` or ``CYCLE``. A small table of groups (the usual case, checked) is
    sent to the tasks, which walk it; of a larger one each level is written before the next is joined, by merging: none is sent.
    """
    keyed = groups.select(group_name(F.col("name")).alias("g"), group_name(F.col("parent")).alias("p"), "reserved_name", reserved_root(F.col("parent")).alias("top"))
    keyed = staged(keyed.withColumn("p", F.when(~F.col("top") & (F.col("p") != ""), F.col("p"))), "groups")
    if small(keyed, SENT_GROUPS):
        return _walked(keyed, most)
    up = keyed.select(F.col("g").alias("_g"), F.col("p").alias("_p"), F.col("reserved_name").alias("_r"))
    level = keyed.select(F.col("g").alias("name"), F.col("g").alias("ancestor"), F.lit(0).cast("long").alias("depth"), "reserved_name", F.col("p").alias("next"))
    found = level
    for d in range(1, most + 1):
        label = F.when(F.col("_g").isNull(), UNRESOLVED).otherwise(F.col("_r"))
        level = staged(level.filter("next is not null").join(up.hint("merge"), F.col("next") == F.col("_g"), "left").select("name", F.col("_g").alias("ancestor"), F.lit(d).cast("long").alias("depth"), label.alias("reserved_name"), F.col("_p").alias("next")), "ancestors")
        found = found.unionByName(level)
        if level.filter("next is not null").isEmpty():
            return found.drop("next")
    endless = level.filter("next is not null").select("name", F.lit(None).cast("string").alias("ancestor"), F.lit(most + 1).cast("long").alias("depth"), F.lit(CYCLE).alias("reserved_name"))
    return found.drop("next").unionByName(endless)


def _walked(keyed: DataFrame, most: int) -> DataFrame:
    """``ancestry`` of a table that each task can hold."""
    above: dict[str, list[tuple]] = {}
    for x in keyed.select("g", "p", "reserved_name").collect():
        above.setdefault(x["g"], []).append((x["p"], x["reserved_name"]))
    shared = keyed.sparkSession.sparkContext.broadcast(above)

    def walk(g, p, r):
        yield g, g, 0, r
        level = [p]
        for depth in range(1, most + 1):
            found = [(x, *up) for x in level if x is not None for up in shared.value.get(x, [(None, None)])]
            for x, _, reserved in found:
                yield (g, x, depth, reserved) if x in shared.value else (g, None, depth, UNRESOLVED)
            level = [up for _, up, _ in found]
        yield from ((g, None, most + 1, CYCLE) for x in level if x is not None)

    def run(batches):
        for b in batches:
            rows = [x for row in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True) for x in walk(*row)]
            for a in range(0, len(rows), 10_000):
                columns = zip(*rows[a : a + 10_000], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.string()), strict=True)], names=["name", "ancestor", "depth", "reserved_name"])

    return keyed.select("g", "p", "reserved_name").mapInArrow(run, "name string, ancestor string, depth long, reserved_name string")


def group_status(groups: DataFrame, reserved: tuple[str, ...] = PARTY_GROUPS) -> DataFrame:
    """``(name, status)``: party if the walk up meets a reserved group first, else UNRESOLVED or CYCLE if it meets that, else other."""
    event = F.when(F.col("reserved_name").isin(*reserved), "party").when(F.col("ancestor").isNull(), F.col("reserved_name"))
    first = F.min_by(event, F.when(event.isNotNull(), F.col("depth")))
    return ancestry(groups).groupBy("name").agg(F.coalesce(first, F.lit("other")).alias("status"))


def party_ledgers(ledgers: DataFrame, groups: DataFrame, reserved: tuple[str, ...] = PARTY_GROUPS) -> DataFrame:
    """The ledgers with ``in_party_group`` (an ancestor has one of the reserved names), ``is_party`` (that, or bill-wise),
    and ``group_error``: why a ledger that isn't bill-wise can't be told (its own parent isn't known, UNRESOLVED or CYCLE)."""
    known = checked(group_status(groups, reserved).select(F.col("name").alias("_g"), "status"))
    parent = F.when(~reserved_root(F.col("parent")), F.nullif(group_name(F.col("parent")), F.lit("")))
    rows = ledgers.withColumn("_p", parent).join(known, F.col("_p") == F.col("_g"), "left")
    rows = rows.withColumn("in_party_group", F.coalesce(F.col("status") == "party", F.lit(False)))
    error = F.when(F.col("_p").isNotNull() & F.col("_g").isNull(), UNRESOLVED).when(F.col("status").isin(UNRESOLVED, CYCLE), F.col("status"))
    return rows.withColumn("is_party", F.col("bill_wise") | F.col("in_party_group")).withColumn("group_error", F.when(~F.col("bill_wise"), error)).drop("_g", "_p", "status")


def residuals(ledgers: DataFrame, groups: DataFrame, bills: DataFrame) -> DataFrame:
    """Of each party ledger: its closing less its bills, what no bill explains. Zeros stay.

    Where a ledger's group can't be told, the residual is partial: its row has a null residual and the error as its status.
    """
    billed = bills.groupBy("party").agg(F.sum("closing").cast(MONEY).alias("billed"))
    found = party_ledgers(ledgers, groups).filter("is_party or group_error is not null").join(billed, F.col("name") == F.col("party"), "left")
    left = (F.col("closing") - F.coalesce("billed", F.lit(0).cast(MONEY))).cast(MONEY)
    return found.select(F.col("name").alias("party"), F.when(F.col("group_error").isNull(), left).alias("residual"), F.coalesce("group_error", F.lit("complete")).alias("status"))


def unallocated(found: DataFrame) -> DataFrame:
    """Residuals other than zero; the sign tells the direction."""
    return found.filter("residual <> 0").select("party", F.abs("residual").cast(MONEY).alias("amount"), direction(F.col("residual")).alias("direction"))


def lifecycle(allocs: DataFrame) -> DataFrame:
    """Open named bills: balance, when the present exposure began, and how often the sign flipped.

    In order, the start is set anew where the balance before was zero (to the
    bill's date) and where the sign flips (to the voucher's date); the last reset
    in order counts, whatever its date.
    """
    posted = allocs.filter("not cancelled and not optional and reference is not null and amount <> 0")
    w = Window.partitionBy("party", "reference").orderBy("vdate", "seq", "amount").rowsBetween(Window.unboundedPreceding, 0)
    running = posted.withColumn("balance", F.sum("amount").over(w).cast(MONEY)).withColumn("_n", F.row_number().over(Window.partitionBy("party", "reference").orderBy("vdate", "seq", "amount")))
    before = (F.col("balance") - F.col("amount")).cast(MONEY)
    flip = before * F.col("balance") < 0
    start = F.when((before == 0) & (F.col("balance") != 0), F.col("bill_date")).when(flip, F.col("vdate"))
    running = running.withColumn("_flip", flip).withColumn("_start", start)
    return running.groupBy("party", "reference").agg(
        F.max_by("balance", "_n").alias("balance"),
        F.max_by("_start", F.when(F.col("_start").isNotNull(), F.col("_n"))).alias("start_date"),
        F.count_if("_flip").cast("long").alias("flips"),
        F.count("*").cast("long").alias("allocations"),
    )


def on_account(allocs: DataFrame) -> DataFrame:
    """Unnamed allocations: one balance a party, apart from any bill however it is named."""
    posted = allocs.filter("not cancelled and not optional and reference is null and amount <> 0")
    return posted.groupBy("party").agg(total(F.col("amount")).alias("balance"), F.count("*").cast("long").alias("allocations"))


def open_bill_rows(bills: DataFrame, as_of: Column) -> DataFrame:
    """Bills as listed: magnitude, age (null while not due) and a label for blank references."""
    label = F.when(F.trim("reference") == "", "(no reference)").otherwise(F.col("reference"))
    return bills.filter("closing <> 0").select("party", label.alias("reference"), "bill_date", "due_date", F.abs("closing").cast(MONEY).alias("amount"), overdue_days(F.col("due_date"), as_of).cast("long").alias("age"), "kind")


#: Fixed value: bills of a party that a screen shows at most; exports show all.
DISPLAYED = 2000


def displayed(rows: DataFrame, most: int) -> DataFrame:
    """The first ``most`` bills of each party with their place, and whether the party has more (``capped``)."""
    w = Window.partitionBy("party")
    placed = rows.withColumn("place", F.row_number().over(w.orderBy(F.desc_nulls_last("age"), "due_date", "reference", "kind")).cast("long"))
    return placed.withColumn("capped", F.count("*").over(w) > most).filter(F.col("place") <= most)


def statement(rows: DataFrame) -> DataFrame:
    """Subtotals by party and direction: not due, the four buckets, and their sum."""
    tier = bucket(F.col("age"))
    sums = [total_if(tier == label, F.col("amount")).alias(name) for label, name in BUCKETS]
    return rows.groupBy("party", "kind").agg(total_if(F.col("age").isNull(), F.col("amount")).alias("not_due"), *sums, total(F.col("amount")).alias("total"), F.count("*").cast("long").alias("bills"))


def manifest(rows: DataFrame, loose: DataFrame) -> DataFrame:
    """Per party: receivable and payable, bills and unallocated money together."""
    b = rows.groupBy("party").agg(total_if(F.col("kind") == "receivable", F.col("amount")).alias("br"), total_if(F.col("kind") == "payable", F.col("amount")).alias("bp"), F.count("*").cast("long").alias("bills"))
    u = loose.groupBy(F.col("party").alias("_party")).agg(total_if(F.col("direction") == "receivable", F.col("amount")).alias("ur"), total_if(F.col("direction") == "payable", F.col("amount")).alias("up"))
    zero = F.lit(0).cast(MONEY)
    joined = b.join(u, F.col("party") == F.col("_party"), "full_outer")
    return joined.select(
        F.coalesce("party", "_party").alias("party"), F.coalesce("bills", F.lit(0)).cast("long").alias("bills"),
        (F.coalesce("br", zero) + F.coalesce("ur", zero)).cast(MONEY).alias("receivable"), (F.coalesce("bp", zero) + F.coalesce("up", zero)).cast(MONEY).alias("payable"),
    )
