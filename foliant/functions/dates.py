"""Dates: two wire forms, ageing, tiles and splits of windows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Days in a tile of a reporting window.
TILE_DAYS = 31


def parse_compact(text: Column) -> Column:
    """``YYYYMMDD`` of a real day, else null."""
    return F.when(text.rlike(r"^[0-9]{8}$") & ~text.startswith("0000"), F.try_to_date(text, "yyyyMMdd"))


def parse_display(text: Column, books_from: Column, latest: Column) -> Column:
    """``D-MMM-YY``: the century in which the day is not before the books begin nor after ``latest``; null unless exactly one is."""
    parts = F.split(text, "-")
    month = F.lpad(F.element_at(F.map_from_arrays(F.array(*[F.lit(m) for m in "JAN FEB MAR APR MAY JUN JUL AUG SEP OCT NOV DEC".split()]), F.array(*[F.lit(str(i)) for i in range(1, 13)])), F.upper(F.get(parts, 1))), 2, "0")
    old, new = (F.try_to_date(F.concat(F.lit(c), F.get(parts, 2), month, F.lpad(F.get(parts, 0), 2, "0")), "yyyyMMdd") for c in ("19", "20"))
    fits = lambda d: F.coalesce((d >= books_from) & (d <= latest), F.lit(False))
    return F.when(text.rlike(r"^[0-9]{1,2}-[A-Za-z]{3}-[0-9]{2}$"), F.when(fits(old), F.when(~fits(new), old)).when(fits(new), new))


def overdue_days(due: Column, as_of: Column) -> Column:
    """Days past due; null while due in the future."""
    return F.when(due <= as_of, F.date_diff(as_of, due))


def bucket(age: Column) -> Column:
    """Inclusive bounds 30, 60, 90; null without an age."""
    return F.when(age <= 30, "0-30").when(age <= 60, "31-60").when(age <= 90, "61-90").when(age > 90, "90+")


def due_state(due: Column, as_of: Column) -> Column:
    days = F.date_diff(as_of, due)
    return F.when(due.isNull(), "unavailable").when(days > 0, "overdue").when(days == 0, "due_today").otherwise("not_due")


def tiles(first: Column, last: Column, days: int = TILE_DAYS) -> Column:
    """Contiguous windows of at most so many days, as an array of (from, to)."""
    starts = F.transform(F.sequence(F.lit(0), F.call_function("div", F.date_diff(last, first), F.lit(days)).cast("int")), lambda i: F.date_add(first, i * days))
    return F.transform(starts, lambda d: F.struct(d.alias("from"), F.least(F.date_add(d, days - 1), last).alias("to")))


def witness_cover(first: Column, last: Column) -> Column:
    """Windows of 31 days that jointly cover a window of at most that and aren't it: one where it fits, else one a day before and one a day after."""
    window = lambda a, z: F.struct(F.date_add(first, a).alias("from"), F.date_add(first, z).alias("to"))
    return F.when(F.date_diff(last, first) < TILE_DAYS - 1, F.array(window(0, TILE_DAYS - 1))).otherwise(F.array(window(-1, TILE_DAYS - 2), window(1, TILE_DAYS)))


def midpoint(first: Column, last: Column) -> Column:
    """Last day of the left half; null for a single day."""
    return F.when(last > first, F.date_add(first, F.call_function("div", F.date_diff(last, first), F.lit(2)).cast("int")))
