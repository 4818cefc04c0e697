"""Strict readers of JSON collections: ledgers and vouchers in typed cells.

The text is parsed as a Variant, whose parser takes no repeated key. Depth and
values are counted on the text without its strings, before anything is read. All
is built-in functions. A capture that is refused is one row with a reason: missing,
too_large, embedded_null, malformed_json, duplicate_field, resource_limit_exceeded (depth,
values), status_missing, status_invalid, application_rejected, wrong_container,
record_limit_exceeded, profile_mismatch (metadata). A record that breaks its profile is a
row with profile_mismatch or typed_value_mismatch; others of the capture stay.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates, exact


@dataclass(frozen=True)
class Limits:
    bytes: int = 8 << 20
    depth: int = 32
    values: int = 250_000
    records: int = 25_000


STRING = r'"(?:[^"\\]++|\\.)*+"'


def shape(rows: DataFrame, json: Column) -> DataFrame:
    """The rows with ``depth`` of a text's containers, how many ``values`` it has (a scalar, object or array each), and whether it stands ``alone``: is one container and nothing else."""
    bare = F.col("_bare")
    brackets = F.regexp_replace(bare, r"[^\[\]{}]+", "")
    begin = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"), F.lit(0).alias("roots"))

    def step(a, c):
        now = a["now"] + F.when(c.isin("[", "{"), 1).when(c == "", 0).otherwise(-1)
        return F.struct(now.alias("now"), F.greatest(a["most"], now).alias("most"), (a["roots"] + F.when((now == 0) & (c != ""), 1).otherwise(0)).alias("roots"))

    # A column for each step, as Spark would walk the text again for each use.
    rows = rows.withColumn("_bare", F.regexp_replace(json, STRING, '""')).withColumn("_read", F.aggregate(F.split(brackets, ""), begin, step))
    alone = (F.col("_read.roots") == 1) & bare.rlike(r"(?s)^\s*[\[{].*[\]}]\s*$")
    full = F.regexp_count(bare, F.lit(r"[\[{](?=\s*+[^\s\]}])"))
    return rows.withColumns({"depth": F.col("_read.most"), "values": 1 + F.regexp_count(bare, F.lit(",")) + full, "alone": alone}).drop("_bare", "_read")


def get(v: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(v, path, kind)


def fields(v: Column) -> Column:
    """An object's fields; null if it is none, as nothing else casts to them. (A schema would be that of all below.)"""
    return get(v, "$", "map<string,variant>")


def text(v: Column) -> Column:
    """A string's value; null if it is none."""
    return F.when(F.schema_of_variant(v) == "STRING", get(v, "$", "string"))


def only(m: Column, *names: str) -> Column:
    """Whether an object has no other fields."""
    return F.size(F.array_except(F.map_keys(m), F.array(*map(F.lit, names)))) == 0


def items(v: Column) -> Column:
    """An array's items; null if it is none."""
    return get(v, "$", "array<variant>")


def at(m: Column, name: str) -> Column:
    return F.try_element_at(m, F.lit(name))


def cell(m: Column, name: str, kind: str) -> tuple[Column, Column]:
    """A typed cell ``{type, value}``: its text (null if the field is absent), and whether it is well-formed or absent."""
    v = at(m, name)
    inner = fields(v)
    good = only(inner, "type", "value") & text(at(inner, "type")).eqNullSafe(F.lit(kind)) & text(at(inner, "value")).isNotNull()
    return text(at(inner, "value")), v.isNull() | F.coalesce(good, F.lit(False))


def known_cell(m: Column, name: str, kind: str) -> tuple[Column, Column]:
    """``cell`` where a column of the same name holds the cell's fields."""
    inner = F.col(name)
    good = only(inner, "type", "value") & text(at(inner, "type")).eqNullSafe(F.lit(kind)) & text(at(inner, "value")).isNotNull()
    return text(at(inner, "value")), at(m, name).isNull() | F.coalesce(good, F.lit(False))


def decimal(value: Column, empty: bool = True) -> Column:
    """Whether a cell's text is an exact decimal, absent or, if allowed, empty."""
    return value.isNull() | value.rlike(exact.LEXEME) | (F.lit(empty) & (value == ""))


def envelopes(captures: DataFrame, key: str, json: str, limits: Limits) -> DataFrame:
    """``(key, reason, metadata, records)``: the object ``{status, data: {metadata, collection}}`` of each capture."""
    size = F.octet_length(json)
    fits = size <= limits.bytes
    guarded = captures.select(key, json, fits.alias("fits"), F.when(fits, F.try_parse_json(F.when(fits, F.col(json)))).alias("v"))
    # Only a text that gives no Variant is read again, to tell broken ones from those with a repeated field.
    bad = F.from_json(F.when(F.col("fits") & F.col("v").isNull(), F.col(json)), "_bad string", {"columnNameOfCorruptRecord": "_bad"})["_bad"].isNotNull()
    rows = shape(guarded.withColumns({"bad": bad, "root": fields(F.col("v"))}), F.when(F.col("v").isNotNull(), F.col(json)))
    rows = rows.withColumn("data", fields(at(F.col("root"), "data"))).withColumn("records", items(at(F.col("data"), "collection"))).withColumn("metadata", fields(at(F.col("data"), "metadata")))
    status = at(F.col("root"), "status")
    reason = (
        F.when(F.col(json).isNull(), "missing").when(~F.col("fits"), "too_large").when(F.col(json).contains("\x00"), "embedded_null")
        .when(F.col("v").isNull(), F.when(F.col("bad") | (F.trim(json) == ""), "malformed_json").otherwise("duplicate_field"))
        .when((F.col("depth") > limits.depth) | (F.col("values") > limits.values), "resource_limit_exceeded")
        .when(F.col("root").isNull() | ~F.col("alone"), "malformed_json").when(status.isNull(), "status_missing").when(text(status).isNull(), "status_invalid")
        .when(text(status) == "0", "application_rejected").when(text(status) != "1", "status_invalid")
        .when(~only(F.col("root"), "status", "data") | F.col("data").isNull() | ~only(F.col("data"), "metadata", "collection") | F.col("records").isNull() | at(F.col("data"), "metadata").isNull(), "wrong_container")
        .when(F.size("records") > limits.records, "record_limit_exceeded")
    )
    return rows.select(key, reason.alias("reason"), "metadata", "records")


def _records(found: DataFrame, key: str, wrong_metadata: Column) -> DataFrame:
    """``(key, ordinal, reason, m)``: the fields of each record, counted from 1; a refused capture is one row."""
    reason = F.coalesce("reason", F.when(wrong_metadata, "profile_mismatch"))
    none = F.array(F.lit(None).cast("variant"))
    rows = found.select(key, reason.alias("reason"), F.posexplode(F.when(reason.isNull(), F.col("records")).otherwise(none)).alias("p", "r"))
    return rows.select(key, F.when(F.col("reason").isNull(), F.col("p") + 1).cast("long").alias("ordinal"), "reason", fields(F.col("r")).alias("m"))


LEDGER_FIELDS = ("metadata", "parent", "ledgerphone", "ledgercontact", "closingbalance", "onaccountvalue", "tbalopening", "closingonacctvalue", "closingdronacctvalue", "ledopeningbalance", "languagename")
VOUCHER_FIELDS = (
    "metadata", "date", "guid", "vouchertypename", "vouchernumber", "reference", "serialmaster", "areserialmaster", "numberingstyle", "persistedview", "isdeleted", "asoriginal", "isdeemedpositive", "isinvoice",
    "aspayslip", "isdeletedvchretained", "isnegisposset", "masterid", "voucherkey", "voucherretainkey", "reuseholeid", "amount", "vouchernumberseries", "allledgerentries", "allinventoryentries", "ledgerentries",
)


def ledgers(captures: DataFrame, key: str, json: str = "json", limits: Limits = Limits()) -> DataFrame:  # noqa: B008
    """``(key, ordinal, name, parent, closing, opening, languages, reason)``: absent texts are null, empty ones empty; ``languages``
    counts the names that a ledger has in other languages."""
    m = F.col("metadata")
    kind = at(m, "is_mst_dep_type")
    wrong = ~(only(m, "is_mst_dep_type", "mst_dep_type") & (F.schema_of_variant(kind) == "BOOLEAN") & get(kind, "$", "boolean") & (text(at(m, "mst_dep_type")) == "8"))
    rows = _records(envelopes(captures, key, json, limits), key, F.coalesce(wrong, F.lit(True)))
    rows = rows.withColumn("own", fields(at(F.col("m"), "metadata")))
    r, own = F.col("m"), F.col("own")
    cells = {n: cell(r, n, "String") for n in ("parent", "ledgerphone", "ledgercontact")} | {n: cell(r, n, "Amount") for n in ("closingbalance", "onaccountvalue", "tbalopening", "closingonacctvalue", "ledopeningbalance")}
    named = items(at(r, "languagename"))
    entries = F.transform(named, lambda v: items(at(fields(v), "name")))
    names_good = at(r, "languagename").isNull() | F.forall(F.transform(named, lambda v: only(fields(v), "name", "languageid") & (F.size(items(at(fields(v), "name"))) >= 2)), lambda x: F.coalesce(x, F.lit(False)))
    profile = only(r, *LEDGER_FIELDS) & only(own, "type", "name", "reservedname") & (text(at(own, "type")) == "Ledger") & text(at(own, "name")).isNotNull() & text(at(own, "reservedname")).isNotNull() & F.coalesce(names_good, F.lit(False))
    typed = F.lit(True)
    for name, (value, good) in cells.items():
        typed = typed & good & (decimal(value) if name not in ("parent", "ledgerphone", "ledgercontact") else F.lit(True))
    reason = F.coalesce("reason", F.when(~F.coalesce(profile, F.lit(False)), "profile_mismatch").when(~F.coalesce(typed, F.lit(False)), "typed_value_mismatch"))
    rows, reason = rows.withColumn("reason", reason), F.col("reason")
    languages = F.aggregate(F.coalesce(entries, F.array().cast("array<array<variant>>")), F.lit(0).cast("long"), lambda a, x: a + F.size(x) - 1)
    good = lambda c: F.when(reason.isNull(), c)
    return rows.select(key, "ordinal", good(text(at(own, "name"))).alias("name"), *(good(cells[n][0]).alias(a) for n, a in (("parent", "parent"), ("closingbalance", "closing"), ("ledopeningbalance", "opening"))), good(languages).alias("languages"), reason.alias("reason"))


def vouchers(captures: DataFrame, key: str, json: str = "json", limits: Limits = Limits()) -> DataFrame:  # noqa: B008
    """``(key, ordinal, guid, remote_id, vdate, kind, amount, entries, invoice_entries, items, batches, accounts, bills, reason)``: the counts
    are of nested rows, each of which must be an object with typed amounts."""
    m = F.col("metadata")
    number = lambda name, n: (F.schema_of_variant(at(m, name)) == "BIGINT") & (get(at(m, name), "$", "bigint") == n)
    kind = at(m, "is_cmp_dep_type")
    wrong = ~(only(m, "is_cmp_dep_type", "cmp_locus", "cmp_dep_type") & (F.schema_of_variant(kind) == "BOOLEAN") & get(kind, "$", "boolean") & number("cmp_locus", 4) & number("cmp_dep_type", 64))
    rows = _records(envelopes(captures, key, json, limits), key, F.coalesce(wrong, F.lit(True)))
    # Columns of their own, step by step: what later steps use several times is worked out once a record.
    all_lists = ("allledgerentries", "ledgerentries", "allinventoryentries")
    rows = rows.select(key, "ordinal", "reason", "m", fields(at(F.col("m"), "metadata")).alias("own"), *(items(at(F.col("m"), n)).alias(n) for n in all_lists), *(fields(at(F.col("m"), n)).alias(n) for n in ("date", "amount")))
    r, own = F.col("m"), F.col("own")
    day, day_good = known_cell(r, "date", "Date")
    amount, amount_good = known_cell(r, "amount", "Amount")
    listed = lambda of, name: F.coalesce(items(at(of, name)), F.array().cast("array<variant>"))
    lists_good = F.lit(True)
    for name in all_lists:
        lists_good = lists_good & (at(r, name).isNull() | F.col(name).isNotNull())
    own_list = lambda name: F.coalesce(F.col(name), F.array().cast("array<variant>"))
    entry_good = lambda v: cell(fields(v), "amount", "Amount")[1] & at(fields(v), "amount").isNotNull() & decimal(cell(fields(v), "amount", "Amount")[0], False)
    nested_good = F.forall(F.concat(*map(own_list, all_lists[:2])), lambda v: F.coalesce(entry_good(v), F.lit(False)))
    nested = lambda outer, inner: F.aggregate(own_list(outer), F.lit(0).cast("long"), lambda a, v: a + F.size(listed(fields(v), inner)))
    strings = text(at(r, "guid")).isNotNull() & text(at(r, "vouchertypename")).isNotNull() & text(at(own, "remoteid")).isNotNull()
    profile = only(r, *VOUCHER_FIELDS) & only(own, "type", "remoteid", "vchkey", "vchtype", "objview") & (text(at(own, "type")) == "Voucher") & strings & lists_good
    rows = rows.withColumns({"profile": profile, "day": day, "sum": amount})
    rows = rows.withColumn("vdate", dates.parse_compact(F.col("day")))
    day, amount = F.col("vdate"), F.col("sum")
    typed = day_good & day.isNotNull() & amount_good & decimal(amount) & nested_good
    reason = F.coalesce("reason", F.when(~F.coalesce("profile", F.lit(False)), "profile_mismatch").when(~F.coalesce(typed, F.lit(False)), "typed_value_mismatch"))
    rows, reason = rows.withColumn("reason", reason), F.col("reason")
    count = lambda c: F.size(c).cast("long")
    out = {
        "guid": text(at(r, "guid")), "remote_id": text(at(own, "remoteid")), "vdate": day, "kind": text(at(r, "vouchertypename")), "amount": amount,
        "entries": count(own_list("allledgerentries")), "invoice_entries": count(own_list("ledgerentries")), "items": count(own_list("allinventoryentries")),
        "batches": nested("allinventoryentries", "batchallocations"), "accounts": nested("allinventoryentries", "accountingallocations"), "bills": nested("ledgerentries", "billallocations"),
    }
    return rows.select(key, "ordinal", *(F.when(reason.isNull(), c).alias(n) for n, c in out.items()), reason.alias("reason"))
