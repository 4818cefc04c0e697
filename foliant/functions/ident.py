"""Identities: domain-separated digests, canonical rows, validators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def domain_sha256(domain: str, *parts: Column) -> Column:
    """SHA-256 over a domain and its parts, a zero byte between."""
    return F.sha2(F.concat_ws("\x00", F.lit(domain), *[p.cast("string") for p in parts]), 256)


def record_token(source_id: Column) -> Column:
    return F.concat(F.lit("record:"), F.substring(domain_sha256("record", source_id), 1, 24))


def window_id(pack: Column, first: Column, last: Column) -> Column:
    return F.concat(F.lit("window:"), F.substring(domain_sha256("window", pack, first, last), 1, 24))


def framed(*parts: Column) -> Column:
    """Each part after its length, so that no two rows read alike."""
    return F.concat(*[F.concat(F.octet_length(p).cast("string"), F.lit(":"), p) for p in parts])


def belongs_to(guid: Column, company: Column, suffix: bool = True) -> Column:
    """Company id, a dash (and, if asked, something after it), whatever the case."""
    found = F.lower(guid).startswith(F.concat(F.lower(company), F.lit("-")))
    return found & (F.length(guid) > F.length(company) + 1) if suffix else found


def canonical_text(value: Column, most: int = 512) -> Column:
    return (F.octet_length(value).between(1, most)) & (F.trim(value) == value) & ~value.rlike(r"\p{Cc}")


def tax_number(value: Column) -> Column:
    """The upper-case form only; another check elsewhere takes any case."""
    return value.rlike(r"^[0-9]{2}[A-Z]{5}[0-9]{4}[A-Z][0-9A-Z]Z[0-9A-Z]$")


def tax_number_any_case(value: Column) -> Column:
    return tax_number(F.upper(value))


def permanent_number(value: Column) -> Column:
    return value.rlike(r"^[A-Z]{5}[0-9]{4}[A-Z]$")


def sha256_shape(value: Column) -> Column:
    return value.rlike(r"^[0-9a-f]{64}$")


def reserved_root(name: Column) -> Column:
    """The reserved root group, whatever its marker, case and blanks."""
    return F.lower(F.trim(F.regexp_replace(name, "�(#[0-9]+;)?", ""))) == "primary"


def group_name(name: Column) -> Column:
    return F.lower(F.trim(name))


def yes_no(text: Column) -> Column:
    """yes and no only; null otherwise."""
    t = F.lower(F.trim(text))
    return F.when(t == "yes", True).when(t == "no", False)


def yes_true_one(text: Column) -> Column:
    return F.lower(F.trim(text)).isin("yes", "true", "1")


def slug(name: Column) -> Column:
    """Lower-case ASCII letters and digits, runs of others as one dash, at most 120 characters."""
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, 120)


def csv_guard(cell: Column) -> Column:
    """Text that a spreadsheet would take for a formula gets an apostrophe."""
    return F.when(cell.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), cell)).otherwise(cell)


def csv_cell(cell: Column) -> Column:
    quoted = F.concat(F.lit('"'), F.replace(cell, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(cell.rlike('[",\r\n]'), quoted).otherwise(cell)
