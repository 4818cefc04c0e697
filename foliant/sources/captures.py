"""Readers of raw captures: text decoding, reference repair and ledger snapshots in XML."""

from __future__ import annotations

import codecs

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from ..functions import exact, ident

#: Largest capture in bytes.
MOST_BYTES = 32 * 1024 * 1024
#: Captures, and their bytes, that one Arrow batch hands to Python: what a worker holds doesn't grow with the table.
BATCH_ROWS, BATCH_BYTES = 512, 4 << 20

# Byte order marks.
MARKS = ((codecs.BOM_UTF8, "utf-8"), (codecs.BOM_UTF16_LE, "utf-16-le"), (codecs.BOM_UTF16_BE, "utf-16-be"))

# Numbers of characters that XML 1.0 doesn't allow, without leading zeros.
DECIMAL = (
    r"[1-8]?|1[124-9]|2[0-9]|3[01]"  # 0 to 31 but for 9, 10 and 13
    r"|5529[6-9]|55[3-9]\d\d|56\d{3}|57[0-2]\d\d|573[0-3]\d|5734[0-3]"  # surrogates
    r"|6553[45]"
    r"|111411[2-9]|11141[2-9]\d|1114[2-9]\d\d|111[5-9]\d{3}|11[2-9]\d{4}|1[2-9]\d{5}|[2-9]\d{6}|[1-9]\d{7,}"
)
HEX = r"[1-8]?|[bcefBCEF]|1[\da-fA-F]|[dD][89a-fA-F][\da-fA-F]{2}|[fF]{3}[efEF]|1[1-9a-fA-F][\da-fA-F]{4}|[2-9a-fA-F][\da-fA-F]{5}|[1-9a-fA-F][\da-fA-F]{6,}"
ILLEGAL = rf"&#((?=\d)0*+(?:{DECIMAL})|x(?=[\da-fA-F])0*+(?:{HEX}));"

LEDGER = "struct<_NAME: string, PARENT: string, ISBILLWISEON: string, CLOSINGBALANCE: string, OPENINGBALANCE: string>"
ENVELOPE = f"BODY struct<DATA: struct<COLLECTION: struct<LEDGER: array<{LEDGER}>>>>, _corrupt_record string"


@F.arrow_udf(StructType().add("text", StringType()).add("encoding", StringType()).add("reason", StringType()))
def _decoded(raw: pa.Array, declared: pa.Array) -> pa.Array:
    def one(data, charset):
        mark, found = next(((m, e) for m, e in MARKS if data.startswith(m)), (b"", None))
        if charset and found and charset != found:
            return None, found, "conflicting_charset"
        encoding = found or charset or "utf-8"
        try:
            return str(memoryview(data)[len(mark) :], encoding), encoding, None
        except UnicodeDecodeError:
            return None, encoding, "malformed"
        except LookupError:
            return None, encoding, "unknown_charset"

    rows = [(None, None, None) if not d.is_valid else one(d.as_py(), c.as_py()) for d, c in zip(raw, declared, strict=True)]
    return pa.StructArray.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)] or [pa.array([], pa.string())] * 3, ["text", "encoding", "reason"])


def small_batches(spark: SparkSession) -> None:
    """Bound the rows and bytes of an Arrow batch; the settings stay with the session, as its later jobs read them."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def decode(captures: DataFrame, raw: str = "raw", declared: Column | None = None, most: int = MOST_BYTES) -> DataFrame:
    """The rows with text, encoding and reason: by byte order mark, else the declared charset, else UTF-8.

    text is null where reason says why: missing, too_large, malformed,
    conflicting_charset or unknown_charset. Too large captures never reach Python.
    """
    small_batches(captures.sparkSession)
    size = F.octet_length(raw)
    charset = F.lower(declared) if declared is not None else F.lit(None).cast("string")
    head = F.hex(F.substring(raw, 1, 3))
    wide, marked = head.startswith("FFFE") | head.startswith("FEFF"), head == "EFBBBF"
    # UTF-8, by mark or by default, is decoded by built-in functions; what else there is goes to Python in batches.
    plain = (size <= most) & ~wide & F.coalesce(charset == "utf-8", F.lit(True))
    body = F.try_validate_utf8(F.when(marked, F.expr(f"substring(`{raw}`, 4)")).otherwise(F.col(raw)).cast("string"))
    here = F.struct(body.alias("text"), F.lit("utf-8").alias("encoding"), F.when(body.isNull(), "malformed").alias("reason"))
    there = _decoded(F.when((size <= most) & ~plain, F.col(raw)), charset)
    rows = captures.withColumn("_d", F.when(plain, here).otherwise(there))
    reason = F.when(F.col(raw).isNull(), "missing").when(size > most, "too_large").otherwise(F.col("_d.reason"))
    return rows.select(*captures.columns, F.col("_d.text").alias("text"), F.col("_d.encoding").alias("encoding"), reason.alias("reason"))


def repair(xml: Column) -> Column:
    """Numeric references to characters that XML 1.0 doesn't allow become U+FFFD and the reference's own number, so that different ones stay apart."""
    return F.regexp_replace(xml, ILLEGAL, "�#$1;")


def repairs(xml: Column) -> Column:
    """How many references ``repair`` replaces."""
    return F.regexp_count(xml, F.lit(ILLEGAL)).cast("long")


def ledgers(captures: DataFrame, xml: str = "xml") -> DataFrame:
    """Ledgers below ENVELOPE/BODY/DATA/COLLECTION, a row each; counters elsewhere that use the same names aren't read.

    An empty balance is zero. reason is null for a whole row, else malformed_xml
    (one row for the capture), missing_name, missing_flag or bad_amount. A
    capture without ledgers, or a null one, gives no row.
    """
    parsed = captures.select(F.from_xml(repair(F.col(xml)), ENVELOPE, {"rowTag": "ENVELOPE", "columnNameOfCorruptRecord": "_corrupt_record", "ignoreSurroundingSpaces": "false"}).alias("x"))
    broken = F.col("x._corrupt_record").isNotNull()
    listed = F.when(broken, F.array(F.lit(None).cast(LEDGER))).otherwise(F.col("x.BODY.DATA.COLLECTION.LEDGER"))
    rows = parsed.select(broken.alias("broken"), F.explode(listed).alias("r"))

    def amount(field):
        text = F.trim(F.coalesce(F.col(f"r.{field}"), F.lit("")))
        return F.when(text == "", F.lit(0).cast(exact.MONEY)).otherwise(exact.parse(text, exact.MONEY))

    whole = rows.select("broken", F.col("r._NAME").alias("name"), F.col("r.PARENT").alias("parent"), amount("CLOSINGBALANCE").alias("closing_balance"), amount("OPENINGBALANCE").alias("opening_balance"), ident.yes_no(F.col("r.ISBILLWISEON")).alias("bill_wise_on"))
    reason = (
        F.when(F.col("broken"), "malformed_xml")
        .when(F.coalesce(F.trim("name"), F.lit("")) == "", "missing_name")
        .when(F.col("bill_wise_on").isNull(), "missing_flag")
        .when(F.col("closing_balance").isNull() | F.col("opening_balance").isNull(), "bad_amount")
    )
    money = [F.when(~F.col("broken"), F.col(c)).alias(c) for c in ("closing_balance", "opening_balance")]
    return whole.select("name", "parent", *money, "bill_wise_on", reason.alias("reason"))
