"""Readers of captured books: bills, groups, currencies, vouchers, balances, extents, JSON collections.

A capture is a text of one response. Each reader gives its rows with a reason,
null for a good row; what breaks a whole capture is one row with the reason.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates, exact, ident
from .captures import repair


def unescaped(text: Column) -> Column:
    """The five named references of XML."""
    for name, char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("amp", "&")):
        text = F.replace(text, F.lit(f"&{name};"), F.lit(char))
    return text


def inside(text: Column, tag: str) -> Column:
    """What stands inside each such element, as an array; an empty element gives an empty text."""
    return F.transform(F.regexp_extract_all(text, F.lit(f"(?is)<{tag}(?:\\s[^>]*)?(?:/>|>(.*?)</{tag}>)"), 1), lambda x: F.coalesce(x, F.lit("")))


def bills(captures: DataFrame, books_from: Column, as_of: Column, xml: str = "xml", kept: tuple[str, ...] = ()) -> DataFrame:
    """Rows of a bills report, whose elements are flat siblings: BILLFIXED begins a row, its figures follow.

    ``(kept, party, reference, bill_date, due_date, closing, overdue, reason)``. A blank overdue is none; a missing one is an
    error, as are repeated fields. Due days lie within a century of the first of the books. A capture that has a STATUS reports a failure, and one that doesn't close its envelope is malformed.
    """
    text = repair(F.col(xml))
    whole = F.trim(F.col(xml)).rlike(r"(?is)^(<\?xml[^>]*\?>\s*)?<ENVELOPE>.*</ENVELOPE>$")
    failed = F.when(~whole, "bills_xml_malformed").when(F.col(xml).rlike("(?i)<STATUS[ >]"), "source_reported_failure")
    pieces = F.slice(F.split(text, "(?i)<BILLFIXED>"), 2, 1 << 30)
    listed = F.when(F.col("failed").isNotNull(), F.array(F.lit(""))).otherwise(pieces)
    rows = captures.select(*kept, xml, failed.alias("failed")).select(*kept, "failed", F.explode(listed).alias("p"))
    names = {"party": "BILLPARTY", "reference": "BILLREF", "bill": "BILLDATE", "closing": "BILLCL", "due": "BILLDUE", "overdue": "BILLOVERDUE"}
    rows = rows.select(*kept, "failed", *[inside(F.col("p"), tag).alias(n) for n, tag in names.items()])
    code = F.col("failed")
    for n, tag in names.items():
        where = "bills_fixed_" if n in ("party", "reference", "bill") else "bills_"
        missing = f"bills_fixed_missing_{tag.lower()}" if n in ("party", "reference", "bill") else f"bills_fixed_row_missing_{tag.lower()}"
        code = F.coalesce(code, F.when(F.size(n) == 0, missing).when(F.size(n) > 1, f"{where}duplicate_{tag.lower()}"))
    one = {n: F.trim(unescaped(F.get(n, 0))) for n in names}
    rows = rows.select(*kept, code.alias("code"), *[one[n].alias(n) for n in names])
    # Columns of their own: what is used several times is worked out once a row.
    rows = rows.withColumns({
        **{f"{n}_day": dates.parse_display(F.col(n), books_from, limit) for n, limit in (("bill", as_of), ("due", F.add_months(books_from, 1199)))},
        "money": exact.parse(F.col("closing"), exact.MONEY), "days": F.when(F.col("overdue").rlike("^[0-9]{1,9}$"), F.col("overdue")).try_cast("long"),
    })
    bill, due, closing, days = (F.col(c) for c in ("bill_day", "due_day", "money", "days"))
    code = F.coalesce(
        F.col("code"), F.when(F.col("party") == "", "bills_fixed_empty_billparty"), F.when(bill.isNull() | due.isNull(), "bills_date_invalid"),
        F.when(closing.isNull(), "bills_amount_invalid"), F.when((F.col("overdue") != "") & days.isNull(), "bills_overdue_invalid"),
    )
    rows = rows.withColumn("reason", code)
    good = lambda c: F.when(F.col("reason").isNull(), c)
    return rows.select(*kept, good(F.col("party")).alias("party"), good(F.col("reference")).alias("reference"), good(bill).alias("bill_date"), good(due).alias("due_date"), good(closing).alias("closing"), good(days).alias("overdue"), "reason")


def _collection(captures: DataFrame, xml: str, element: str, fields: str, kept: tuple[str, ...]) -> DataFrame:
    """``(kept, failed, r)``: the elements below ENVELOPE/BODY/DATA/COLLECTION. A capture without any is one row without an element
    that tells why: missing, malformed_xml, source_reported_failure (a STATUS other than 1), collection_missing, empty_collection."""
    row = f"struct<{fields}>"
    schema = f"HEADER struct<STATUS: string>, BODY struct<DATA: struct<COLLECTION: struct<{element}: array<{row}>>>>, _corrupt_record string"
    options = {"rowTag": "ENVELOPE", "columnNameOfCorruptRecord": "_corrupt_record", "ignoreSurroundingSpaces": "false"}
    text = F.col(xml)
    # What is exploded is worked out once; what is selected would be again in each filter that is pushed below it.
    once = F.struct(text.isNull().alias("none"), text.rlike("(?i)<COLLECTION[\\s/>]").alias("has"), F.from_xml(repair(text), schema, options).alias("x"))
    parsed = captures.select(*kept, F.explode(F.array(once)).alias("p")).select(*kept, "p.*")
    listed = F.col(f"x.BODY.DATA.COLLECTION.{element}")
    failed = (
        F.when(F.col("none"), "missing").when(F.col("x").isNull() | F.col("x._corrupt_record").isNotNull(), "malformed_xml").when(F.trim("x.HEADER.STATUS") != "1", "source_reported_failure")
        .when(~F.col("has"), "collection_missing").when(F.coalesce(F.size(listed), F.lit(0)) < 1, "empty_collection")
    )
    rows = parsed.select(*kept, failed.alias("failed"), listed.alias("l"))
    return rows.select(*kept, "failed", F.explode(F.when(F.col("failed").isNotNull(), F.array(F.lit(None).cast(row))).otherwise(F.col("l"))).alias("r"))


def groups(captures: DataFrame, company: Column, xml: str = "xml", kept: tuple[str, ...] = ()) -> DataFrame:
    """``(kept, name, parent, reserved_name, own, reason)``: a null reserved name wasn't exported, an empty one is none; ``own``
    tells whether the row's id is of the company. A capture that fails is one row, an empty one too; where none of a capture's rows is the company's, each is company_mismatch."""
    rows = _collection(captures, xml, "GROUP", "_NAME: string, _RESERVEDNAME: string, PARENT: string, GUID: string", kept)
    own = F.coalesce(ident.belongs_to(F.col("r.GUID"), company), F.lit(False))
    rows = rows.withColumn("own", own)
    bound = F.max("own").over(Window.partitionBy(*kept)) if kept else F.lit(True)
    rows = rows.withColumn("bound", bound)
    reason = F.coalesce("failed", F.when(F.coalesce(F.trim("r._NAME"), F.lit("")) == "", "group_name_missing_or_duplicate").when(~F.col("bound"), "company_mismatch"))
    return rows.select(*kept, F.col("r._NAME").alias("name"), F.col("r.PARENT").alias("parent"), F.col("r._RESERVEDNAME").alias("reserved_name"), "own", reason.alias("reason"))


def currency(captures: DataFrame, key: str, xml: str = "xml") -> DataFrame:
    """``(key, masters, inr, reason)``: currency masters of a company; rupees only if there is one, mailed as Indian Rupees. A capture that fails has no masters and a reason."""
    rows = _collection(captures, xml, "CURRENCY", "_NAME: string, MAILINGNAME: string", (key,))
    found = F.count_if(F.col("failed").isNull())
    return rows.groupBy(key).agg(found.cast("long").alias("masters"), F.coalesce((found == 1) & (F.lower(F.trim(F.first("r.MAILINGNAME"))) == "indian rupees"), F.lit(False)).alias("inr"), F.max("failed").alias("reason"))


ALLOCATION = "struct<NAME: string, BILLTYPE: string, AMOUNT: string>"
ENTRY = f"struct<LEDGERNAME: string, ISDEEMEDPOSITIVE: string, AMOUNT: string, `BILLALLOCATIONS.LIST`: array<{ALLOCATION}>>"


def vouchers(captures: DataFrame, company: Column, first: Column, last: Column, low: Column, high: Column, xml: str = "xml") -> DataFrame:
    """A row for each entry of each voucher: ``(guid, alter_id, vdate, ordinal, ledger, polarity, amount, allocations, allocated, reason)``.

    A capture that fails is one row with its reason; one whose collection is empty gives none, as a window may hold nothing.
    A voucher must be of the company, dated in the window and altered in the range ``[low, high)``. The entry's amount
    is its own, never that of an allocation below it; an entry's place counts from 1.
    """
    rows = _collection(captures, xml, "VOUCHER", f"_REMOTEID: string, GUID: string, ALTERID: string, DATE: string, `ALLLEDGERENTRIES.LIST`: array<{ENTRY}>", ())
    rows = rows.filter("failed is null or failed <> 'empty_collection'")
    day, alter = dates.parse_compact(F.trim("r.DATE")), F.trim("r.ALTERID").try_cast("long")
    reason = (
        F.when(F.col("failed").isNotNull(), F.col("failed")).when(~F.coalesce(ident.belongs_to(F.col("r.GUID"), company), F.lit(False)), "company_mismatch")
        .when(~F.coalesce(day.between(first, last), F.lit(False)), "row_outside_date_window").when(~F.coalesce((alter >= low) & (alter < high), F.lit(False)), "row_outside_alter_range")
    )
    rows = rows.select(F.col("r.GUID").alias("guid"), alter.alias("alter_id"), day.alias("vdate"), reason.alias("reason"), F.posexplode_outer("r.`ALLLEDGERENTRIES.LIST`").alias("p", "e"))
    nested = F.col("e.`BILLALLOCATIONS.LIST`")
    allocated = F.aggregate(nested, F.lit(0).cast("decimal(28,2)"), lambda a, x: (a + F.coalesce(exact.absent(x["AMOUNT"]), F.lit(0))).cast("decimal(28,2)")).cast(exact.MONEY)
    amount = exact.absent(F.col("e.AMOUNT"))
    polarity = F.when(ident.yes_no(F.col("e.ISDEEMEDPOSITIVE")), "debit").otherwise("credit")
    code = F.coalesce("reason", F.when(F.col("e").isNotNull() & amount.isNull(), "amount_invalid"))
    return rows.select("guid", "alter_id", "vdate", (F.col("p") + 1).cast("long").alias("ordinal"), F.col("e.LEDGERNAME").alias("ledger"), F.when(F.col("e").isNotNull(), polarity).alias("polarity"), amount.alias("amount"), F.greatest(F.size(nested), F.lit(0)).cast("long").alias("allocations"), F.coalesce(allocated, F.lit(0).cast(exact.MONEY)).alias("allocated"), code.alias("reason"))


def repeated_ids(rows: DataFrame) -> DataFrame:
    """Ids and alteration numbers that several vouchers of one read have."""
    own = rows.filter("guid is not null").select("guid", "alter_id").distinct()
    twice = lambda c, code: own.groupBy(F.col(c).cast("string").alias("id")).agg(F.count("*").cast("long").alias("vouchers")).filter("vouchers > 1").withColumn("reason", F.lit(code))
    return twice("guid", "duplicate_voucher_guid").unionByName(twice("alter_id", "duplicate_alter_id"))


def witnesses(captures: DataFrame, xml: str = "xml", kept: tuple[str, ...] = ()) -> DataFrame:
    """``(kept, guid, alter_id, vdate, reason)`` of a read of dates alone; a capture that fails is one row with its reason, one whose collection is empty gives none: that is what it is a witness of."""
    rows = _collection(captures, xml, "VOUCHER", "GUID: string, ALTERID: string, DATE: string", kept).filter("failed is null or failed <> 'empty_collection'")
    day = dates.parse_compact(F.trim("r.DATE"))
    reason = F.coalesce("failed", F.when(F.coalesce(F.trim("r.GUID"), F.lit("")) == "", "missing_guid").when(day.isNull(), "date_invalid"))
    return rows.select(*kept, F.col("r.GUID").alias("guid"), F.trim("r.ALTERID").try_cast("long").alias("alter_id"), day.alias("vdate"), reason.alias("reason"))


def balances(captures: DataFrame, key: str, xml: str = "xml") -> DataFrame:
    """``(key, name, opening, closing, reason)`` of ledgers over a window; names of a capture are unique. A capture that fails, or has no ledger, is one row."""
    rows = _collection(captures, xml, "LEDGER", "_NAME: string, OPENINGBALANCE: string, CLOSINGBALANCE: string", (key,))
    opening, closing = exact.or_zero(F.coalesce("r.OPENINGBALANCE", F.lit(""))), exact.or_zero(F.coalesce("r.CLOSINGBALANCE", F.lit("")))
    rows = rows.select(key, "failed", F.col("r._NAME").alias("name"), opening.alias("opening"), closing.alias("closing"))
    repeated = rows.groupBy(key, "name").agg(F.count("*").alias("_n")).filter("_n > 1").select(F.col(key).alias("_k"), F.col("name").alias("_name"))
    rows = rows.join(repeated, (F.col(key) == F.col("_k")) & (F.col("name") == F.col("_name")), "left")
    reason = F.when(F.col("failed").isNotNull(), F.col("failed")).when(F.col("_k").isNotNull(), "duplicate_identity").when(F.col("opening").isNull() | F.col("closing").isNull(), "bad_amount")
    return rows.select(key, "name", "opening", "closing", reason.alias("reason"))


def opening_coverage(rows: DataFrame, key: str) -> DataFrame:
    """Of ledgers ``(key, guid, opening, bill_wise)``: how many, how many ids, and how many bill-wise ones open with a balance."""
    return rows.groupBy(key).agg(F.count("*").cast("long").alias("ledgers"), F.count_distinct("guid").cast("long").alias("ids"), F.count_if(F.col("bill_wise") & (F.col("opening") != 0)).cast("long").alias("bill_wise_opening"))


def opening_coverages(captures: DataFrame, key: str, xml: str = "xml") -> DataFrame:
    """``opening_coverage`` of captures, with a reason: that of a capture that fails or is empty, or bad_ledger where a row has no id, flag or amount."""
    rows = _collection(captures, xml, "LEDGER", "GUID: string, OPENINGBALANCE: string, ISBILLWISEON: string", (key,))
    opening, on = exact.or_zero(F.coalesce("r.OPENINGBALANCE", F.lit(""))), ident.yes_no(F.col("r.ISBILLWISEON"))
    rows = rows.select(key, "failed", F.trim("r.GUID").alias("guid"), opening.alias("opening"), on.alias("bill_wise"))
    bad = F.col("failed").isNull() & ((F.coalesce("guid", F.lit("")) == "") | F.col("opening").isNull() | F.col("bill_wise").isNull())
    reason = F.coalesce(F.max("failed"), F.when(F.max(bad), "bad_ledger"))
    per = rows.groupBy(key).agg(F.count_if(F.col("failed").isNull()).cast("long").alias("ledgers"), F.count_distinct("guid").cast("long").alias("ids"), F.count_if(F.col("bill_wise") & (F.col("opening") != 0)).cast("long").alias("bill_wise_opening"), reason.alias("reason"))
    return per.select(key, *(F.when(F.col("reason").isNull(), F.col(c)).alias(c) for c in ("ledgers", "ids", "bill_wise_opening")), "reason")


def extents(captures: DataFrame, key: str, expected: Column, xml: str = "xml") -> DataFrame:
    """``(key, books_from, last_voucher, voucher_mark, master_mark, reason)``: exactly one company, with the id expected, whatever its case.
    A capture that fails is a row with its reason, as is one whose days or marks are none (extent_invalid)."""
    rows = _collection(captures, xml, "COMPANY", "GUID: string, BOOKSFROM: string, LASTVOUCHERDATE: string, ALTVCHID: string, ALTMSTID: string", (key,))
    per = rows.groupBy(key).agg(F.count_if(F.col("failed").isNull()).alias("n"), F.first("r").alias("r"), F.max("failed").alias("failed"))
    mark = lambda c: F.trim(c).try_cast("long")
    first, last = dates.parse_compact(F.trim("r.BOOKSFROM")), dates.parse_compact(F.trim("r.LASTVOUCHERDATE"))
    reason = F.coalesce(F.when(F.col("failed") != "empty_collection", F.col("failed")), F.when(F.col("n") != 1, "company_extent_not_unique").when(~F.coalesce(F.lower("r.GUID") == F.lower(expected), F.lit(False)), "company_mismatch").when(first.isNull() | last.isNull() | mark("r.ALTVCHID").isNull() | mark("r.ALTMSTID").isNull(), "extent_invalid"))
    return per.select(key, first.alias("books_from"), last.alias("last_voucher"), mark("r.ALTVCHID").alias("voucher_mark"), mark("r.ALTMSTID").alias("master_mark"), reason.alias("reason"))


def companies(captures: DataFrame, key: str, xml: str = "xml", most: int = 100) -> DataFrame:
    """``(key, name, guid, reason)`` of company discovery: a capture that fails is one row, one with more than ``most`` companies too_many_companies;
    a company without a name or an id is company_incomplete, one of several with an id (whatever its case) duplicate_company."""
    rows = _collection(captures, xml, "COMPANY", "_NAME: string, NAME: string, GUID: string", (key,))
    name, guid = F.trim(F.coalesce("r._NAME", "r.NAME")), F.trim("r.GUID")
    all_ = Window.partitionBy(key)
    rows = rows.select(key, "failed", name.alias("name"), guid.alias("guid"), F.count("*").over(all_).alias("n"))
    rows = rows.withColumn("same", F.count("*").over(Window.partitionBy(key, F.lower("guid"))))
    many = F.col("n") > most
    reason = F.coalesce("failed", F.when(many, "too_many_companies").when((F.coalesce("name", F.lit("")) == "") | (F.coalesce("guid", F.lit("")) == ""), "company_incomplete").when(F.col("same") > 1, "duplicate_company"))
    one = rows.select(key, F.when(~many, F.col("name")).alias("name"), F.when(~many, F.col("guid")).alias("guid"), reason.alias("reason"))
    return one.filter("reason is null or reason <> 'too_many_companies'").unionByName(one.filter("reason = 'too_many_companies'").distinct())


def catalogue(captures: DataFrame, key: str, company: Column, xml: str = "xml", most: int = 1000) -> DataFrame:
    """``(key, ledgers, reason)`` of the standard ledgers that confirm a company's context: at most ``most``, all of one company and that the expected one
    (context_mismatch), each with a name and an id, none twice whatever its case (duplicate_identity)."""
    rows = _collection(captures, xml, "LEDGER", "_NAME: string, GUID: string, COMPANYGUID: string", (key,))
    low = lambda c: F.lower(F.trim(c))
    per = rows.groupBy(key).agg(
        F.max("failed").alias("failed"), F.count_if(F.col("failed").isNull()).cast("long").alias("n"), F.count_distinct(low("r._NAME")).alias("names"), F.count_distinct(low("r.GUID")).alias("ids"),
        F.count_distinct(low("r.COMPANYGUID")).alias("contexts"), F.min(low("r.COMPANYGUID")).alias("context"), F.count_if((F.coalesce(low("r._NAME"), F.lit("")) == "") | (F.coalesce(low("r.GUID"), F.lit("")) == "")).alias("incomplete"),
    )
    reason = F.coalesce("failed", F.when(F.col("n") > most, "too_many_ledgers").when(F.col("incomplete") > 0, "ledger_incomplete").when((F.col("contexts") != 1) | ~F.coalesce(F.col("context") == F.lower(company), F.lit(False)), "context_mismatch").when((F.col("names") < F.col("n")) | (F.col("ids") < F.col("n")), "duplicate_identity"))
    return per.select(key, F.when(reason.isNull(), F.col("n")).alias("ledgers"), reason.alias("reason"))


CELL = "struct<type: string, value: string>"
JSON = f"vouchers array<struct<guid: {CELL}, amount: {CELL}, inventory: array<struct<batches: array<{CELL}>>>, entries: array<struct<amount: {CELL}, bills: array<{CELL}>>>>>"


def json_vouchers(captures: DataFrame, key: str, json: str = "json") -> DataFrame:
    """Vouchers of a JSON collection with typed cells: ``(key, guid, amount, items, batches, entries, bills, reason)``; the last
    counts are of nested lists. A broken text is one row with malformed_json, an amount of another type than amount is wrong_type."""
    parsed = captures.select(key, F.from_json(json, f"{JSON}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("x"))
    bad = F.col("x._bad").isNotNull() | F.col("x.vouchers").isNull()
    rows = parsed.select(key, bad.alias("bad"), F.explode_outer(F.when(~bad, F.col("x.vouchers"))).alias("v"))
    nested = lambda outer, inner: F.coalesce(F.aggregate(F.transform(F.col(outer), lambda x: F.greatest(F.size(x[inner]), F.lit(0))), F.lit(0), lambda a, n: a + n), F.lit(0)).cast("long")
    count = lambda c: F.greatest(F.size(c), F.lit(0)).cast("long")
    amount = F.when(F.col("v.amount.type") == "amount", exact.absent(F.col("v.amount.value")))
    reason = F.when(F.col("bad"), "malformed_json").when(F.col("v.amount.type") != "amount", "wrong_type").when(amount.isNull(), "amount_invalid")
    return rows.select(key, F.col("v.guid.value").alias("guid"), amount.alias("amount"), count("v.inventory").alias("items"), nested("v.inventory", "batches").alias("batches"), count("v.entries").alias("entries"), nested("v.entries", "bills").alias("bills"), reason.alias("reason"))
