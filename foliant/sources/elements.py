"""XML captures as a table of elements: places, attributes, texts and byte-exact fragments.

Every reader that needs evidence (guards, scoped exports, observations) is a plan
over these rows: a path is compared, counts are aggregates, parents are joined.
Offsets and fragments are those of the original bytes, whatever was repaired.
"""

from __future__ import annotations

import codecs
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from xml.parsers import expat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .captures import ILLEGAL, MOST_BYTES
from .shared import dealt

#: Elements below one another, and elements of a capture, at most.
MOST_DEPTH, MOST_ELEMENTS = 64, 1_000_000
#: Elements handed on at once.
ROWS = 10_000
ELEMENT = "id int, parent int, path string, name string, depth int, attributes map<string,string>, text string, first long, last long, sha256 string, reason string"
KINDS = pa.schema(
    [("id", pa.int32()), ("parent", pa.int32()), ("path", pa.string()), ("name", pa.string()), ("depth", pa.int32()), ("attributes", pa.map_(pa.string(), pa.string())),
     ("text", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("sha256", pa.string()), ("reason", pa.string())]
)
REFERENCE = re.compile(ILLEGAL.encode())
START = re.compile(rb"<[^<>\"']*(?:\"[^\"]*\"[^<>\"']*|'[^']*'[^<>\"']*)*>")
#: Bytes by which a repaired reference is longer than the given one: U+FFFD has three for the ampersand's one.
LONGER = len("�".encode()) - 1


def repaired(raw: bytes) -> tuple[bytes, np.ndarray]:
    """The capture with illegal references marked, and where each marked one stands in the given bytes."""
    at = np.fromiter((m.start() for m in REFERENCE.finditer(raw)), np.int64)
    return (REFERENCE.sub(lambda m: "�".encode() + b"#" + m.group(1) + b";", raw) if len(at) else raw), at


def original(places: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Places in the given bytes of places in the repaired ones; those inside a marker's U+FFFD are at its reference."""
    marks = at + LONGER * np.arange(len(at))
    before = np.searchsorted(marks, places, side="left")
    return np.maximum(places - LONGER * before, np.concatenate([[0], at])[before])


@dataclass
class Refused(Exception):
    reason: str


@dataclass
class _Open:
    id: int
    parent: int | None
    path: str
    name: str
    attributes: dict
    first: int
    end: int | None
    text: list[str] = field(default_factory=list)


def parse(raw: bytes, most_depth: int = MOST_DEPTH, most_elements: int = MOST_ELEMENTS) -> list[tuple]:
    """The elements of a capture (UTF-8, whatever it declares; ``chunks`` and ``captures`` decode others) in document order; raises ``Refused``. Names are in upper case, as they are compared whatever their case."""


    if raw[:2] in (codecs.BOM_UTF16_LE, codecs.BOM_UTF16_BE):
        raise Refused("not_utf8")
    data, at = repaired(raw)
    parser = expat.ParserCreate("utf-8")
    parser.buffer_text = True
    open_: list[_Open] = []
    done: list[tuple] = []
    count = 0

    def start(name, attributes):
        nonlocal count
        if len(open_) >= most_depth:
            raise Refused("too_deep")
        if count >= most_elements:
            raise Refused("too_many_elements")
        first = parser.CurrentByteIndex
        tag = START.match(data, first)
        own = name.upper()
        end = tag.end() if tag and data[tag.end() - 2 : tag.end()] == b"/>" else None
        upper = {k.upper(): v for k, v in attributes.items()}
        if len(upper) < len(attributes):
            raise Refused("repeated_attribute")
        open_.append(_Open(count, open_[-1].id if open_ else None, f"{open_[-1].path if open_ else ''}/{own}", own, upper, first, end))
        count += 1

    def stop(name):
        e = open_.pop()
        last = e.end if e.end is not None else data.index(b">", parser.CurrentByteIndex) + 1
        done.append((e.id, e.parent, e.path, e.name, len(open_) + 1, list(e.attributes.items()), "".join(e.text), e.first, last))

    def refuse(*_):
        raise Refused("forbidden_construct")

    parser.StartElementHandler, parser.EndElementHandler = start, stop
    parser.CharacterDataHandler = lambda text: open_[-1].text.append(text)
    parser.StartDoctypeDeclHandler = parser.ProcessingInstructionHandler = refuse
    try:
        parser.Parse(data, True)
    except expat.ExpatError:
        raise Refused("malformed_xml") from None
    done.sort()
    places = original(np.array([x[7:9] for x in done], np.int64).reshape(-1), at).reshape(-1, 2)
    return [(*x[:7], int(a), int(z), hashlib.sha256(raw[a:z]).hexdigest(), None) for x, (a, z) in zip(done, places, strict=True)]


def elements(captures: DataFrame, key: str, raw: str = "raw", most: int = MOST_BYTES, most_depth: int = MOST_DEPTH, most_elements: int = MOST_ELEMENTS) -> DataFrame:
    """``(key, id, parent, path, name, depth, attributes, text, first, last, sha256, reason)``, a row an element.

    ``first`` and ``last`` bound the element's bytes, ``sha256`` is theirs, ``text`` its own direct text.
    A capture that can't be read is one row with a reason and nothing else: missing, too_large, not_utf8, malformed_xml,
    forbidden_construct (document types and processing instructions), too_deep, too_many_elements, repeated_attribute.
    A task holds one capture's elements, bounded by ``most`` and ``most_elements``.
    """

    def rows(raw_: bytes | None, refused: str | None) -> Iterator[list[tuple]]:
        try:
            if refused is not None:
                raise Refused(refused)
            found = parse(raw_, most_depth, most_elements)
        except Refused as e:
            found = [(*[None] * 10, e.reason)]
        for a in range(0, len(found), ROWS):
            yield found[a : a + ROWS]

    def run(batches):
        for b in batches:
            for i, (raw_, refused) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)):
                for part in rows(raw_, refused):
                    columns = [pa.array(c, t) for c, t in zip(zip(*part, strict=True), KINDS.types, strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.repeat(b.column(0)[i], len(part)), *columns], names=[key, *KINDS.names])

    data = F.col(raw).cast("binary")
    refused = F.when(data.isNull(), "missing").when(F.octet_length(data) > most, "too_large")
    return captures.select(key, F.when(refused.isNull(), data).alias("raw"), refused.alias("refused")).mapInArrow(run, f"{captures.select(key).schema[0].simpleString().replace(':', ' ', 1)}, {ELEMENT}")


def marker_offsets(captures: DataFrame, key: str, xml: str = "xml") -> DataFrame:
    """``(key, ordinal, reference, repaired_at, original_at)``: each illegal reference of a text, and where (in bytes) it and its
    marker stand, by running sums of the lengths of what is between. JVM only."""
    pieces = F.split(F.col(xml), ILLEGAL, -1)
    references = F.regexp_extract_all(F.col(xml), F.lit(f"({ILLEGAL})"), 1)
    pairs = F.arrays_zip(F.slice(pieces, 1, F.size(references)).alias("piece"), references.alias("reference"))
    rows = captures.select(key, F.posexplode(pairs).alias("ordinal", "p")).select(key, "ordinal", F.col("p.piece").alias("piece"), F.col("p.reference").alias("reference"))
    before = Window.partitionBy(key).orderBy("ordinal").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    between, own = F.sum(F.octet_length("piece")).over(before), F.sum(F.octet_length("reference")).over(before) - F.octet_length("reference")
    at = (between + own).cast("long")
    return rows.select(key, (F.col("ordinal") + 1).cast("long").alias("ordinal"), "reference", (at + LONGER * F.col("ordinal")).cast("long").alias("repaired_at"), at.alias("original_at"))


# Guards and evidence -------------------------------------------------------------


@dataclass(frozen=True)
class Structure:
    """What a capture may hold: of each path its attributes and whether it may have text of its own. Below a path in ``free`` all is allowed."""

    paths: dict[str, tuple[frozenset[str], bool]]
    free: tuple[str, ...] = ()


def export_structure(row: str) -> Structure:
    """The skeleton of a selected export whose rows are such elements, directly in BODY, in DATA or in a collection."""
    bare: tuple[frozenset[str], bool] = (frozenset(), False)
    wrappers = ("/ENVELOPE", "/ENVELOPE/HEADER", "/ENVELOPE/BODY", "/ENVELOPE/BODY/DATA", "/ENVELOPE/BODY/DATA/COLLECTION")
    said = {f"/ENVELOPE/HEADER/{n}": (frozenset[str](), True) for n in ("VERSION", "STATUS")}
    free = [f"{p}/{n}" for p in wrappers[2:] for n in (row, "COMPANYCONTEXT") if not (n == "COMPANYCONTEXT" and p.endswith("COLLECTION"))]
    return Structure(dict.fromkeys(wrappers, bare) | said, tuple(free))


def violations(rows: DataFrame, key: str, structure: Structure) -> DataFrame:
    """``(key, place, path, reason, detail)``: a row for each unexpected element, attribute or text of ``elements``, and for each unreadable capture."""
    spark = rows.sparkSession
    listed = [(p, sorted(a), t) for p, (a, t) in structure.paths.items()]
    allowed = F.broadcast(spark.createDataFrame(listed, "_path string, _attributes array<string>, _text boolean"))
    inside = F.lit(False)
    for p in structure.free:
        inside = inside | (F.col("path") == p) | F.col("path").startswith(f"{p}/")
    known = rows.filter(F.col("reason").isNotNull() | ~inside).join(allowed, F.col("path") == F.col("_path"), "left")
    extra = F.array_sort(F.array_except(F.map_keys("attributes"), "_attributes"))
    said = F.trim(F.regexp_replace("text", r"\s+", " "))
    kinds = F.array(
        F.when(F.col("reason").isNotNull(), F.struct(F.col("reason").alias("reason"), F.lit(None).cast("string").alias("detail"))),
        F.when(F.col("path").isNotNull() & F.col("_path").isNull(), F.struct(F.lit("unexpected_element").alias("reason"), F.col("name").alias("detail"))),
        F.when(F.size(extra) > 0, F.struct(F.lit("unexpected_attribute").alias("reason"), F.array_join(extra, ",").alias("detail"))),
        F.when(F.col("_path").isNotNull() & ~F.col("_text") & (said != ""), F.struct(F.lit("unexpected_text").alias("reason"), said.alias("detail"))),
    )
    found = known.select(key, F.col("first").alias("place"), "path", F.explode(F.filter(kinds, lambda x: x.isNotNull())).alias("v"))
    return found.select(key, "place", "path", "v.reason", "v.detail")


def attribute(name: str) -> Column:
    return F.try_element_at("attributes", F.lit(name))


def identities(rows: DataFrame, key: str, kind: str) -> DataFrame:
    """``(key, identity_sha256, occurrences)``: identities (GUID, REMOTEID or MASTERID of an element of a kind) that a capture has more than once."""
    each = F.explode(F.array(*[F.when(attribute(n).isNotNull(), F.concat_ws("\x00", F.lit(kind), F.lit(n), attribute(n))) for n in ("GUID", "REMOTEID", "MASTERID")]))
    of = rows.filter(F.col("name") == kind).select(key, each.alias("i")).filter("i is not null")
    return of.groupBy(key, F.sha2("i", 256).alias("identity_sha256")).agg(F.count("*").alias("occurrences")).filter("occurrences > 1")


def scoped_exports(rows: DataFrame, key: str, schema: str, kind: str, prefix: Column | None = None) -> DataFrame:
    """A row a capture of a scoped export: ``(key, records, identified, matching, other, duplicates, reason)``.

    The context's SCHEMA, OBJECTTYPE and RECORDCOUNT must be those expected and counted, each row needs an identity, and with
    ``prefix`` (a company's id) rows whose GUID begins so are counted apart. The first reason found counts:
    that of an unreadable capture, status_missing, source_reported_failure, context_missing, repeated_context,
    schema_mismatch, object_type_mismatch, count_missing, count_mismatch, missing_identity, duplicate_identity.
    """
    at = lambda p: F.col("path") == p
    is_row = (F.col("name") == kind) & F.col("path").isin(*[f"/ENVELOPE/BODY{p}/{kind}" for p in ("", "/DATA", "/DATA/COLLECTION")])
    context = F.col("path").isin("/ENVELOPE/BODY/COMPANYCONTEXT", "/ENVELOPE/BODY/DATA/COMPANYCONTEXT")
    known = F.coalesce(attribute("GUID"), attribute("REMOTEID"), attribute("MASTERID")).isNotNull()
    own = F.lower(attribute("GUID")).startswith(F.concat(F.lower(prefix), F.lit("-"))) if prefix is not None else F.lit(None).cast("boolean")
    per = rows.groupBy(key).agg(
        F.min("reason").alias("bad"), F.max(F.when(at("/ENVELOPE/HEADER/STATUS"), F.trim("text"))).alias("status"), F.count_if(context).alias("contexts"),
        *[F.max(F.when(context, attribute(n))).alias(n.lower()) for n in ("SCHEMA", "OBJECTTYPE", "RECORDCOUNT")],
        F.count_if(is_row).cast("long").alias("records"), F.count_if(is_row & known).cast("long").alias("identified"),
        F.count_if(is_row & F.coalesce(own, F.lit(False))).cast("long").alias("matching"),
    )
    # Dealt by capture: a task holds the identities of some captures, however many there are.
    twice = identities(dealt(rows.filter(is_row), key), key, kind).groupBy(F.col(key).alias("_k")).agg(F.count("*").cast("long").alias("duplicates"))
    per = per.join(twice, F.col(key).eqNullSafe(F.col("_k")), "left").withColumn("duplicates", F.coalesce("duplicates", F.lit(0)))
    reason = (
        F.when(F.col("bad").isNotNull(), F.col("bad")).when(F.col("status").isNull(), "status_missing").when(F.col("status") != "1", "source_reported_failure")
        .when(F.col("contexts") == 0, "context_missing").when(F.col("contexts") > 1, "repeated_context")
        .when(~F.col("schema").eqNullSafe(F.lit(schema)), "schema_mismatch").when(~F.col("objecttype").eqNullSafe(F.lit(kind)), "object_type_mismatch")
        .when(~F.coalesce(F.col("recordcount").rlike("^[0-9]{1,18}$"), F.lit(False)), "count_missing").when(F.col("recordcount").try_cast("long") != F.col("records"), "count_mismatch")
        .when(F.col("identified") < F.col("records"), "missing_identity").when(F.col("duplicates") > 0, "duplicate_identity")
    )
    return per.select(key, "records", "identified", "matching", (F.col("records") - F.col("matching")).alias("other"), "duplicates", reason.alias("reason"))


def fragments(rows: DataFrame, key: str, kind: str) -> DataFrame:
    """``(key, ordinal, name, guid, alter_id, bytes, sha256)`` of each such element: its place among its like from 1, and the digest of its original bytes."""
    ordinal = F.row_number().over(Window.partitionBy(key).orderBy("id")).cast("long")
    of = rows.filter(F.col("name") == kind)
    return of.select(key, ordinal.alias("ordinal"), attribute("NAME").alias("name"), attribute("GUID").alias("guid"), attribute("ALTERID").try_cast("long").alias("alter_id"), (F.col("last") - F.col("first")).alias("bytes"), "sha256")
