"""Row rules: validity, directions, identities, diagnostics. All are Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

#: What a document's extension says of its content.
MIME_TYPES = {
    ".pdf": "application/pdf", ".doc": "application/msword",
    ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    ".xls": "application/vnd.ms-excel", ".xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    ".csv": "text/csv", ".txt": "text/plain", ".png": "image/png", ".jpg": "image/jpeg", ".jpeg": "image/jpeg",
    ".zip": "application/zip", ".json": "application/json", ".xml": "application/xml",
}

#: Extensions that a document scan leaves out.
EXCLUDED = (
    ".exe .dll .msi .app .dmg .pkg .deb .rpm .sh .bat .cmd .ps1 .vbs .js .jar .com .scr .tmp .temp .log .cache .pyc .class .o .obj .so .dylib .crdownload .part"
).split()


def one_of(code: Column, allowed: dict[str, str], otherwise: str) -> Column:
    pairs = [F.lit(x) for kv in allowed.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), code), F.lit(otherwise))


def extension(path: Column) -> Column:
    """The lower-case extension with its dot, of the last part of a path; null without one."""
    return F.lower(F.nullif(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1), F.lit("")))


def mime_type(ext: Column) -> Column:
    return one_of(ext, MIME_TYPES, "application/octet-stream")


def admission(path: Column, size: Column, most: int) -> Column:
    """Why a document is left out of a scan: empty, too_large, hidden, excluded_extension; null if it's taken."""
    return (
        F.when(size <= 0, "empty").when(size > most, "too_large")
        .when(path.rlike(r"(^|/)\.[^/]+"), "hidden").when(extension(path).isin(*EXCLUDED), "excluded_extension")
    )


def direction_matches(amount: Column, direction: Column) -> Column:
    """Receivable amounts are negative, payable ones positive; zero matches neither."""
    return F.when(direction == "receivable", amount < 0).otherwise(amount > 0)


def reference_direction_matches(kind: Column, amount: Column, direction: Column) -> Column:
    """As ``direction_matches`` for new references and on account; an advance has the other sign; other kinds never match."""
    return F.when(kind.isin("New Ref", "On Account"), direction_matches(amount, direction)).when(kind == "Advance", direction_matches(-amount, direction)).otherwise(False)


def reference_valid(kind: Column, name: Column, raw_kind: Column) -> Column:
    """On account names no bill, the named kinds do, and only an unclassified kind keeps its raw text."""
    return F.when(kind == "On Account", name.isNull() & raw_kind.isNull()).when(kind == "Unclassified", raw_kind.isNotNull()).otherwise(name.isNotNull() & raw_kind.isNull())


def due_evidence_valid(due: Column, evidence: Column) -> Column:
    return (evidence == "unavailable") == due.isNull()


def source_count_valid(complete: Column, reported: Column, parsed: Column) -> Column:
    return F.when(complete, reported == parsed).otherwise(reported >= parsed)


def likely_spelling(value: Column) -> Column:
    """Of text with control characters: what its characters spell if they are bytes of UTF-8; null if that is no other text.

    A suggestion for a reader; the text itself is never replaced.
    """
    read = F.try_validate_utf8(F.encode(value, "ISO-8859-1").cast("string"))
    return F.when(value.rlike(r"\p{Cc}") & value.rlike("^[\\u0000-\\u00ff]*$") & (read != value), read)


def preferred_identity(guid: Column, remote_id: Column, master_id: Column) -> Column:
    """The first that is there, and its kind."""
    there = lambda c: F.nullif(F.trim(c), F.lit(""))
    kind = F.when(there(guid).isNotNull(), "guid").when(there(remote_id).isNotNull(), "remote_id").when(there(master_id).isNotNull(), "master_id")
    return F.struct(F.coalesce(there(guid), there(remote_id), there(master_id)).alias("identity"), kind.alias("kind"))


def _ordered(value: Column, kind: DataType) -> Column:
    if isinstance(kind, StructType):
        fields = sorted(kind.fields, key=lambda f: f.name)
        return F.when(value.isNotNull(), F.struct(*[_ordered(value[f.name], f.dataType).alias(f.name) for f in fields]))
    if isinstance(kind, ArrayType):
        return F.transform(value, lambda x: _ordered(x, kind.elementType))
    return value


def canonical_json(value: Column, kind: DataType) -> Column:
    """Compact JSON with the fields of every struct in order of their names, nulls written out."""
    return F.to_json(_ordered(value, kind), {"ignoreNullFields": "false"})


def content_type(value: Column, expected: Column | str) -> Column:
    """Why a response of such a content type isn't read: unsupported_content_type (other than text/xml with at most a charset of
    utf-8 or utf-16, or none given), declared_encoding_mismatch (another charset than ``expected``); null if it is."""
    parts = F.split(value, ";", -1)
    more = F.slice(parts, 2, 1 << 30)
    named = F.forall(more, lambda p: p.rlike(r"(?i)^\s*charset\s*="))
    declared = F.lower(F.trim(F.regexp_replace(F.get(more, 0), "^[^=]*=", "")))
    media = F.lower(F.trim(F.get(parts, 0))) == "text/xml"
    good = media & ~value.rlike(r"\p{Cc}") & named & (F.size(more) <= 1) & (declared.isNull() | declared.isin("utf-8", "utf-16"))
    wanted = F.lit(expected) if isinstance(expected, str) else expected
    return F.when(~F.coalesce(good, F.lit(False)), "unsupported_content_type").when(declared != wanted, "declared_encoding_mismatch")


def label_file(json: Column, version: int = 1) -> Column:
    """A client label file as ``(labels, state)``: ``loaded`` with trimmed labels, blank ones dropped; else no labels and missing,
    empty_file, corrupt_file or unsupported_version. For reading any but loaded is no label; a writer must stop unless it is loaded or missing."""
    v = F.try_parse_json(json)
    none = F.create_map().cast("map<string,string>")
    is_object = lambda x: F.schema_of_variant(x).startswith("OBJECT")
    root = F.when(is_object(v), F.try_variant_get(v, "$", "map<string,variant>"))
    number, held = F.try_element_at(root, F.lit("version")), F.try_element_at(root, F.lit("labels"))
    found = F.try_variant_get(number, "$", "int")
    labels = F.when(is_object(held), F.try_variant_get(held, "$", "map<string,variant>"))
    whole = (F.size(root) == 2) & (F.schema_of_variant(number) == "BIGINT") & found.between(0, 255) & F.forall(F.map_values(labels), lambda x: F.schema_of_variant(x) == "STRING")
    texts = F.transform_values(labels, lambda _, x: F.trim(F.try_variant_get(x, "$", "string")))
    kept = F.map_filter(F.transform_keys(texts, lambda k, _: F.trim(k)), lambda k, x: (k != "") & (x != ""))
    state = F.when(json.isNull(), "missing").when(F.trim(json) == "", "empty_file").when(~F.coalesce(whole, F.lit(False)), "corrupt_file").when(found != version, "unsupported_version").otherwise("loaded")
    return F.struct(F.when(state == "loaded", kept).otherwise(none).alias("labels"), state.alias("state"))
