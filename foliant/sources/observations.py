"""Observations and write evidence: captures that claim what they hold, reconciled with the rows they do hold.

All four are plans over ``elements``: a capture's claims are one row, its records
another table, and the first reason found refuses the whole capture, in one row. A
refused capture gives no record. Records come with the digest of their original bytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates, exact, ident
from .elements import Structure, attribute, violations

#: Bytes of a field at most.
FIELD = 1024


def first_of(*cases: tuple[Column, str]) -> Column:
    out = F.lit(None).cast("string")
    for condition, code in reversed(cases):
        out = F.when(F.coalesce(condition, F.lit(True)), code).otherwise(out)
    return out


def good_text(c: Column) -> Column:
    return F.coalesce(ident.canonical_text(c, FIELD), F.lit(False))


def optional(c: Column, good: Column) -> Column:
    return c.isNull() | F.coalesce(good, F.lit(False))


def day(c: Column) -> Column:
    return dates.parse_compact(c).isNotNull()


def count(c: Column, least: int = 0) -> Column:
    """A plain number from ``least`` on; null if it is none."""
    n = F.when(c.rlike("^(0|[1-9][0-9]{0,17})$"), c).try_cast("long")
    return F.when(n >= least, n)


def decimal(c: Column, signed: bool = True) -> Column:
    return F.coalesce(c.rlike(exact.LEXEME) & (F.lit(signed) | ~c.startswith("-")) & (F.octet_length(c) <= 256), F.lit(False))


def twice(w_key: str, *by: Column | str) -> Column:
    return F.count("*").over(Window.partitionBy(w_key, *by)) > 1


def _children(rows: DataFrame, key: str, of: str, names: tuple[str, ...]) -> DataFrame:
    """``(key, parent, <names>)``: texts of an element's children, which must occur once each; ``_n`` counts them."""
    under = rows.filter(F.col("path").isin(*[f"{of}/{n}" for n in names]))
    return under.groupBy(F.col(key).alias("_key"), F.col("parent").alias("_parent")).agg(F.count("*").alias("_n"), F.count_distinct("name").alias("_d"), *[F.max(F.when(F.col("name") == n, F.col("text"))).alias(n.lower()) for n in names])


def _judged(rows: DataFrame, key: str, structure: Structure, context: str, claims: tuple[str, ...], wrong: Column, records: DataFrame, claimed: tuple[tuple[str, str], ...]) -> DataFrame:
    """``(key, <claims>, reason)``: the claims of each capture and why it is refused, if it is.

    ``records`` is ``(key, kind, bad)``: every record with its own fault; ``claimed`` pairs a kind with the claim that counts it.
    """
    odd = violations(rows.filter("reason is null"), key, structure).groupBy(F.col(key).alias("_o")).agg(F.count("*").alias("odd"))
    held = records.groupBy(F.col(key).alias("_h")).agg(F.min("bad").alias("bad"), *[F.count_if(F.col("kind") == k).alias(f"_{k}") for k, _ in claimed])
    at = F.col("path") == context
    per = rows.groupBy(key).agg(
        F.min("reason").alias("unreadable"), F.count_if(at).alias("contexts"), F.count_if(F.col("path") == "/ENVELOPE/HEADER/STATUS").alias("statuses"), F.max(F.when(F.col("path") == "/ENVELOPE/HEADER/STATUS", F.col("text"))).alias("status"),
        *[F.max(F.when(at, attribute(c.upper()))).alias(c) for c in claims],
    )
    per = per.join(odd, F.col(key).eqNullSafe(F.col("_o")), "left").join(held, F.col(key).eqNullSafe(F.col("_h")), "left")
    mismatch = F.lit(False)
    for kind, claim in claimed:
        mismatch = mismatch | (count(F.col(claim)) != F.coalesce(F.col(f"_{kind}"), F.lit(0)))
    uncounted = F.lit(False)
    for _, claim in claimed:
        uncounted = uncounted | count(F.col(claim)).isNull()
    reason = F.coalesce(
        "unreadable",
        first_of((F.coalesce("odd", F.lit(0)) > 0, "wrong_grammar"), ((F.col("contexts") != 1) | (F.col("statuses") != 1), "wrong_grammar"), (F.col("status") != "1", "application_rejected")),
        first_of((wrong, "profile_mismatch")), first_of((uncounted, "invalid_value"), (mismatch, "count_mismatch")), "bad",
    )
    return per.select(key, *claims, reason.alias("reason"))


def _kept(records: DataFrame, judged: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Records of captures that aren't refused, and a row with the reason for each that is."""
    good = judged.filter("reason is null").select(F.col(key).alias("_g"))
    kept = records.join(good, F.col(key).eqNullSafe(F.col("_g")), "left_semi").select(key, *columns, F.lit(None).cast("string").alias("reason"))
    refused = judged.filter("reason is not null").select(key, "reason")
    return kept.unionByName(refused, allowMissingColumns=True)


# Tax ----------------------------------------------------------------------------

TAX_CLAIMS = ("schema", "profile", "objecttype", "companyguid", "fromdate", "todate", "taxregistrationcount", "vouchertaxcount")
OWNER = ("OWNERKIND", "OWNERGUID", "OWNERREMOTEID", "OWNERMASTERID", "OWNERALTERID")
VOUCHER = ("VOUCHERGUID", "VOUCHERREMOTEID", "VOUCHERMASTERID", "VOUCHERALTERID", "TAXROWORDINAL")
TAX_TEXTS, REGISTRATION_TEXTS = ("PLACEOFSUPPLY", "ASSESSABLEVALUE", "TAXCOMPONENT", "TAXRATE", "TAXAMOUNT"), ("REGISTRATIONTYPE", "GSTIN")
BODY = "/ENVELOPE/BODY"


def _grammar(context: str, claims: tuple[str, ...], records: dict[str, tuple[tuple[str, ...], tuple[str, ...]]]) -> Structure:
    """Status, one context, and records with the attributes and text children listed."""
    none: tuple[frozenset[str], bool] = (frozenset(), False)
    paths = {p: none for p in ("/ENVELOPE", "/ENVELOPE/HEADER", BODY)} | {"/ENVELOPE/HEADER/STATUS": (frozenset[str](), True), f"{BODY}/{context}": (frozenset(c.upper() for c in claims), False)}
    for name, (attributes, texts) in records.items():
        paths[f"{BODY}/{name}"] = (frozenset(attributes), False)
        paths |= {f"{BODY}/{name}/{t}": (frozenset[str](), True) for t in texts}
    return Structure(paths)


def tax(rows: DataFrame, key: str, schema: str, profile: str) -> tuple[DataFrame, DataFrame]:
    """Claims ``(key, ..., reason)`` and records of tax observations: registrations and voucher tax lines.

    Records: ``(key, kind, owner_kind, guid, remote_id, master_id, ordinal, registration, gstin, place, value, component, rate, amount, sha256, reason)``.
    A company's registration has the company's id and no other, a ledger's and a tax line's one at least; tax numbers have
    their form, values are decimals (rates not below zero); no two registrations are equal, no two lines of a voucher have
    one ordinal. Reasons: what ``elements`` gives, wrong_grammar, application_rejected, profile_mismatch, count_mismatch,
    and of records duplicate_observation, invalid_value, missing_identity (of several the first by name).
    """
    structure = _grammar("INDIATAXCONTEXT", TAX_CLAIMS, {"TAXREGISTRATION": (OWNER, REGISTRATION_TEXTS), "VOUCHERTAX": (VOUCHER, TAX_TEXTS)})
    company = rows.filter(F.col("path") == f"{BODY}/INDIATAXCONTEXT").groupBy(F.col(key).alias("_c")).agg(F.max(attribute("COMPANYGUID")).alias("company"))
    owned = rows.filter(F.col("path") == f"{BODY}/TAXREGISTRATION").join(_children(rows, key, f"{BODY}/TAXREGISTRATION", REGISTRATION_TEXTS), F.col(key).eqNullSafe(F.col("_key")) & (F.col("id") == F.col("_parent")), "left")
    owned = owned.join(company, F.col(key).eqNullSafe(F.col("_c")), "left")
    guid, remote, master = (attribute(f"OWNER{n}") for n in ("GUID", "REMOTEID", "MASTERID"))
    own_kind = attribute("OWNERKIND")
    identity = F.when(own_kind == "COMPANY", guid.eqNullSafe(F.col("company")) & remote.isNull() & master.isNull()).otherwise(F.coalesce(guid, remote, master).isNotNull())
    values = (F.col("_n") == 2) & (F.col("_d") == 2) & own_kind.isin("COMPANY", "LEDGER") & good_text(F.col("registrationtype")) & ident.tax_number(F.col("gstin"))
    for c in (guid, remote, master, attribute("OWNERALTERID")):
        values = values & optional(c, ident.canonical_text(c, FIELD))
    same = twice(key, own_kind, guid, remote, master, "registrationtype", "gstin")
    empty = lambda *names, kind="string": [F.lit(None).cast(kind).alias(n) for n in names]
    registrations = owned.select(key, F.lit("registration").alias("kind"), own_kind.alias("owner_kind"), guid.alias("guid"), remote.alias("remote_id"), master.alias("master_id"), *empty("ordinal", kind="long"), F.col("registrationtype").alias("registration"), "gstin", *empty("place", "value", "component", "rate", "amount"), "sha256", first_of((~values, "invalid_value"), (~identity, "missing_identity"), (same, "duplicate_observation")).alias("bad"))
    lines = rows.filter(F.col("path") == f"{BODY}/VOUCHERTAX").join(_children(rows, key, f"{BODY}/VOUCHERTAX", TAX_TEXTS), F.col(key).eqNullSafe(F.col("_key")) & (F.col("id") == F.col("_parent")), "left")
    guid, remote, master = (attribute(f"VOUCHER{n}") for n in ("GUID", "REMOTEID", "MASTERID"))
    ordinal = count(attribute("TAXROWORDINAL"), 1)
    values = (F.col("_n") == 5) & (F.col("_d") == 5) & ordinal.isNotNull() & good_text(F.col("placeofsupply")) & good_text(F.col("taxcomponent")) & decimal(F.col("assessablevalue")) & decimal(F.col("taxrate"), False) & decimal(F.col("taxamount"))
    for c in (guid, remote, master, attribute("VOUCHERALTERID")):
        values = values & optional(c, ident.canonical_text(c, FIELD))
    same = twice(key, guid, remote, master, ordinal)
    taxes = lines.select(key, F.lit("tax").alias("kind"), *empty("owner_kind"), guid.alias("guid"), remote.alias("remote_id"), master.alias("master_id"), ordinal.alias("ordinal"), *empty("registration", "gstin"), F.col("placeofsupply").alias("place"), F.col("assessablevalue").alias("value"), F.col("taxcomponent").alias("component"), F.col("taxrate").alias("rate"), F.col("taxamount").alias("amount"), "sha256", first_of((~values, "invalid_value"), (F.coalesce(guid, remote, master).isNull(), "missing_identity"), (same, "duplicate_observation")).alias("bad"))
    records = registrations.unionByName(taxes)
    wrong = ~((F.col("schema") == schema) & (F.col("profile") == profile) & (F.col("objecttype") == "INDIATAXOBSERVATION") & good_text(F.col("companyguid")) & day(F.col("fromdate")) & day(F.col("todate")) & (F.col("fromdate") <= F.col("todate")))
    judged = _judged(rows, key, structure, f"{BODY}/INDIATAXCONTEXT", TAX_CLAIMS, wrong, records, (("registration", "taxregistrationcount"), ("tax", "vouchertaxcount")))
    return judged, _kept(records, judged, key, [c for c in records.columns if c not in (key, "bad")])


# Bills and payments -------------------------------------------------------------

BILL_CLAIMS = ("schema", "profile", "objecttype", "companyguid", "partyledger", "fromdate", "todate", "asofdate", "direction", "queryprofile", "billwisestate", "allocationcount", "outstandingcount")
ALLOCATION = ("ORIGIN", "VOUCHERIDENTITY", "PARTYENTRYORDINAL", "ROWORDINAL", "REFERENCEKIND", "REFERENCENAME", "BILLDATE", "EFFECTIVEDATE", "DUEDATE", "AMOUNT", "POLARITY", "CURRENCY")
OUTSTANDING = ("ROWORDINAL", "REFERENCEKIND", "REFERENCENAME", "BILLDATE", "EFFECTIVEDATE", "DUEDATE", "OPENINGAMOUNT", "PENDINGAMOUNT", "POLARITY", "CURRENCY", "OVERDUEDAYS")
# Kinds of reference, as the source words them.
REFERENCES = {"Advance": "advance", "Agst Ref": "against_reference", "New Ref": "new_reference", "On Account": "on_account"}


def reference_kind(c: Column) -> Column:
    out = F.lit("unclassified")
    for word, kind in REFERENCES.items():
        out = F.when(c == word, kind).otherwise(out)
    return out


def payments(rows: DataFrame, key: str, schema: str, profile: str) -> tuple[DataFrame, DataFrame]:
    """Claims and records of what one party owes: allocations and outstanding rows.

    Records: ``(key, kind, origin, voucher, entry_ordinal, ordinal, reference_kind, reference, bill_date, due_date, opening, amount, polarity, overdue_days, sha256, reason)``.
    A voucher's allocation names its voucher and entry, one of a ledger's opening neither; an on-account row names no reference, a
    row of another known kind one; ordinals count from 1 and aren't repeated (of allocations, within a voucher). Reasons as of ``tax``.
    """
    structure = _grammar("BILLSPARTYCONTEXT", BILL_CLAIMS, {"BILLALLOCATION": (ALLOCATION, ()), "BILLOUTSTANDING": (OUTSTANDING, ())})
    a = attribute
    kind = reference_kind(a("REFERENCEKIND"))
    named = F.when(kind == "on_account", a("REFERENCENAME").isNull()).when(kind == "unclassified", F.lit(True)).otherwise(a("REFERENCENAME").isNotNull())
    values = count(a("ROWORDINAL"), 1).isNotNull() & good_text(a("REFERENCEKIND")) & named & optional(a("POLARITY"), a("POLARITY").isin("DEBIT", "CREDIT"))
    for n in ("REFERENCENAME", "CURRENCY"):
        values = values & optional(a(n), ident.canonical_text(a(n), FIELD))
    for n in ("BILLDATE", "EFFECTIVEDATE", "DUEDATE"):
        values = values & optional(a(n), day(a(n)))
    voucher = a("ORIGIN") == "VOUCHER"
    origin = a("ORIGIN").isin("VOUCHER", "LEDGEROPENING") & F.when(voucher, a("VOUCHERIDENTITY").isNotNull() & count(a("PARTYENTRYORDINAL"), 1).isNotNull()).otherwise(a("VOUCHERIDENTITY").isNull() & a("PARTYENTRYORDINAL").isNull())
    origin = origin & optional(a("VOUCHERIDENTITY"), ident.canonical_text(a("VOUCHERIDENTITY"), FIELD)) & decimal(a("AMOUNT"))
    days = count(a("OVERDUEDAYS"))
    pending = decimal(a("PENDINGAMOUNT")) & optional(a("OPENINGAMOUNT"), decimal(a("OPENINGAMOUNT"))) & (a("OVERDUEDAYS").isNull() | (days < 1 << 32))

    def record(name: str, own: str, good: Column, same: Column, amount: str) -> DataFrame:
        of = rows.filter(F.col("path") == f"{BODY}/{name}")
        allocated = own == "allocation"
        only = lambda c, given: c if given else F.lit(None).cast("string")
        return of.select(
            key, F.lit(own).alias("kind"), F.lower(only(a("ORIGIN"), allocated)).alias("origin"), only(a("VOUCHERIDENTITY"), allocated).alias("voucher"), count(only(a("PARTYENTRYORDINAL"), allocated), 1).alias("entry_ordinal"), count(a("ROWORDINAL"), 1).alias("ordinal"), kind.alias("reference_kind"), a("REFERENCENAME").alias("reference"),
            a("BILLDATE").alias("bill_date"), a("DUEDATE").alias("due_date"), only(a("OPENINGAMOUNT"), not allocated).alias("opening"), a(amount).alias("amount"), F.lower(a("POLARITY")).alias("polarity"), (F.lit(None).cast("long") if allocated else days).alias("overdue_days"), "sha256",
            first_of((~(values & good), "invalid_value"), (same, "duplicate_observation")).alias("bad"),
        )

    allocations = record("BILLALLOCATION", "allocation", origin, twice(key, a("ORIGIN"), a("VOUCHERIDENTITY"), a("ROWORDINAL")), "AMOUNT")
    outstanding = record("BILLOUTSTANDING", "outstanding", pending, twice(key, a("ROWORDINAL")), "PENDINGAMOUNT")
    records = allocations.unionByName(outstanding)
    wrong = ~((F.col("schema") == schema) & (F.col("profile") == profile) & (F.col("objecttype") == "PARTYOUTSTANDING") & good_text(F.col("companyguid")) & good_text(F.col("partyledger")) & good_text(F.col("queryprofile")) & F.col("direction").isin("RECEIVABLE", "PAYABLE") & F.col("billwisestate").isin("ENABLED", "DISABLED", "UNKNOWN") & day(F.col("fromdate")) & day(F.col("todate")) & day(F.col("asofdate")) & (F.col("fromdate") <= F.col("todate")) & (F.col("todate") <= F.col("asofdate")))
    judged = _judged(rows, key, structure, f"{BODY}/BILLSPARTYCONTEXT", BILL_CLAIMS, wrong, records, (("allocation", "allocationcount"), ("outstanding", "outstandingcount")))
    return judged, _kept(records, judged, key, [c for c in records.columns if c not in (key, "bad")])


# Imports and their read-back ----------------------------------------------------

COUNTERS = ("CREATED", "ALTERED", "DELETED", "IGNORED", "ERRORS", "CANCELLED", "EXCEPTIONS")
MORE = ("LINEERROR", "LASTVCHID", "LASTMID", "COMBINED", "VCHNUMBER", "DESC")


def imports(rows: DataFrame, key: str) -> DataFrame:
    """``(key, status, created, altered, deleted, ignored, errors, cancelled, exceptions, line_errors, line_error_sha256, reason)``.

    Seven counters below RESPONSE, or below an ENVELOPE's DATA or IMPORTRESULT (not both), once each; line errors are counted and
    known by the digest of their texts in order. Absent counters are 0, but one of the first three must be given. Reasons: what ``elements`` gives, wrong_root, wrong_grammar,
    repeated_field, counter_invalid, no_counters.
    """
    parents = ("/RESPONSE", "/ENVELOPE/BODY/DATA", "/ENVELOPE/BODY/DATA/IMPORTRESULT")
    listed = [f"{p}/{n}" for p in parents for n in COUNTERS + MORE]
    wrappers = (*parents, "/ENVELOPE", "/ENVELOPE/HEADER", "/ENVELOPE/HEADER/VERSION", "/ENVELOPE/HEADER/STATUS", "/ENVELOPE/BODY")
    number = F.when(F.trim("text").rlike("^[0-9]{1,18}$"), F.trim("text")).try_cast("long")
    is_counter = F.col("path").isin(*[f"{p}/{n}" for p in parents for n in COUNTERS])
    numeric = is_counter | F.col("path").isin(*[f"{p}/LASTVCHID" for p in parents])
    single = F.col("path").isin(*listed) & (F.col("name") != "LINEERROR") | F.col("path").isin("/ENVELOPE/HEADER/STATUS", "/ENVELOPE/HEADER", "/ENVELOPE/BODY", "/ENVELOPE/BODY/DATA", parents[2])
    repeated = rows.filter(single).groupBy(F.col(key).alias("_r"), "name").agg(F.count("*").alias("_n")).filter("_n > 1").select("_r").distinct().withColumn("twice", F.lit(True))
    errors = F.array_sort(F.collect_list(F.when(F.col("name") == "LINEERROR", F.struct("id", "text"))))
    per = rows.groupBy(key).agg(
        F.min("reason").alias("unreadable"), F.max(F.when(F.col("depth") == 1, F.col("name"))).alias("root"), F.count_if(~F.col("path").isin(*wrappers, *listed) | (F.size("attributes") > 0)).alias("odd"),
        F.count_if(F.col("path").isin(*[f"{parents[1]}/{n}" for n in COUNTERS + MORE])).alias("direct"), F.count_if(F.col("path") == parents[2]).alias("wrapped"),
        F.count_if(numeric & number.isNull()).alias("bad"), F.max(F.when(F.col("path") == "/ENVELOPE/HEADER/STATUS", F.trim("text"))).alias("status"),
        *[F.max(F.when(is_counter & (F.col("name") == n), number)).alias(n.lower()) for n in COUNTERS], errors.alias("lines"),
    ).join(repeated, F.col(key).eqNullSafe(F.col("_r")), "left")
    reason = F.coalesce("unreadable", first_of((~F.col("root").isin("RESPONSE", "ENVELOPE"), "wrong_root"), ((F.col("odd") > 0) | (F.col("direct") > 0) & (F.col("wrapped") > 0), "wrong_grammar"), (F.coalesce("twice", F.lit(False)), "repeated_field"), (F.col("bad") > 0, "counter_invalid"), (F.coalesce("created", "altered", "deleted").isNull(), "no_counters")))
    good = lambda c: F.when(reason.isNull(), c)
    line_digest = F.sha2(F.array_join(F.transform("lines", lambda x: F.concat(F.octet_length(x["text"]).cast("string"), F.lit(":"), x["text"])), ""), 256)
    return per.select(key, good(F.col("status")).alias("status"), *[good(F.coalesce(F.col(n.lower()), F.lit(0))).alias(n.lower()) for n in COUNTERS], good(F.size("lines").cast("long")).alias("line_errors"), good(line_digest).alias("line_error_sha256"), reason.alias("reason"))


def set_sha256(ids: Column) -> Column:
    """The digest of a set of identities, whatever their order."""
    return F.sha2(F.array_join(F.transform(F.array_sort(F.array_distinct(ids)), lambda x: F.concat(F.octet_length(x).cast("string"), F.lit(":"), x)), ""), 256)


def read_backs(rows: DataFrame, key: str) -> DataFrame:
    """``(key, claimed, ids, set_sha256, reason)`` of a read of what was written: the digest of the asked set that its context echoes, and that of the
    identities (GUID, else REMOTEID, else MASTERID) of its ledgers. Reasons: what ``elements`` gives, wrong_grammar, source_reported_failure, missing_identity, duplicate_identity."""
    structure = Structure({p: (frozenset[str](), p.count("/") == 3) for p in ("/ENVELOPE", "/ENVELOPE/HEADER", "/ENVELOPE/HEADER/VERSION", "/ENVELOPE/HEADER/STATUS", BODY)} | {f"{BODY}/LEDGER": (frozenset({"NAME", "GUID", "REMOTEID", "MASTERID", "ALTERID"}), False), f"{BODY}/COMPANYCONTEXT": (frozenset({"NAME", "GUID", "QUERYIDENTITYSETSHA256"}), False)} | {f"{BODY}/LEDGER/{n}": (frozenset[str](), True) for n in ("PARENT", "OPENINGBALANCE", "PARTYGSTIN")})
    odd = violations(rows.filter("reason is null"), key, structure).groupBy(F.col(key).alias("_o")).agg(F.count("*").alias("odd"))
    ledger, context = F.col("path") == f"{BODY}/LEDGER", F.col("path") == f"{BODY}/COMPANYCONTEXT"
    own = F.coalesce(attribute("GUID"), attribute("REMOTEID"), attribute("MASTERID"))
    per = rows.groupBy(key).agg(F.min("reason").alias("unreadable"), F.count_if(context).alias("contexts"), F.max(F.when(context, attribute("QUERYIDENTITYSETSHA256"))).alias("claimed"), F.max(F.when(F.col("path") == "/ENVELOPE/HEADER/STATUS", F.trim("text"))).alias("status"), F.count_if(ledger).cast("long").alias("n"), F.collect_list(F.when(ledger, own)).alias("ids"))
    per = per.join(odd, F.col(key).eqNullSafe(F.col("_o")), "left")
    reason = F.coalesce("unreadable", first_of(((F.coalesce("odd", F.lit(0)) > 0) | (F.col("contexts") != 1), "wrong_grammar"), (F.col("status") != "1", "source_reported_failure"), (F.size("ids") < F.col("n"), "missing_identity"), (F.size(F.array_distinct("ids")) < F.col("n"), "duplicate_identity")))
    good = lambda c: F.when(reason.isNull(), c)
    return per.select(key, good(F.col("claimed")).alias("claimed"), good(F.col("n")).alias("ids"), good(set_sha256(F.col("ids"))).alias("set_sha256"), reason.alias("reason"))


def outcomes(asked: DataFrame, imported: DataFrame, read: DataFrame, key: str) -> DataFrame:
    """``(key, outcome)`` of writes ``(key, created, altered, deleted, set_sha256)``: ``unknown`` where an answer or its read-back is missing or refused,
    ``applied`` where both say all of it, ``partial`` where the counters say less or report errors, ``contradicted`` where they say all
    and the read-back another set than was asked for."""
    joined = asked.alias("a").join(imported.alias("i"), F.col(f"a.{key}").eqNullSafe(F.col(f"i.{key}")), "left").join(read.alias("r"), F.col(f"a.{key}").eqNullSafe(F.col(f"r.{key}")), "left")
    clean = F.lit(True)
    for n in ("created", "altered", "deleted"):
        clean = clean & (F.col(f"i.{n}") == F.col(f"a.{n}"))
    for n in ("ignored", "errors", "cancelled", "exceptions", "line_errors"):
        clean = clean & (F.col(f"i.{n}") == 0)
    some = (F.col("a.created") > 0) | (F.col("a.altered") > 0) | (F.col("a.deleted") > 0)
    known = F.col("i.created").isNotNull() & F.col("r.set_sha256").isNotNull()
    echoed = F.col("r.claimed").eqNullSafe(F.col("a.set_sha256"))
    same = F.col("r.set_sha256") == F.col("a.set_sha256")
    outcome = F.when(~known | ~echoed, "unknown").when(~(clean & some), "partial").when(same, "applied").otherwise("contradicted")
    return joined.select(F.col(f"a.{key}").alias(key), outcome.alias("outcome"))
