"""WARC records in ZIP-packaged archives: written by partition, read by ranges.

An archive is a ZIP file with two stored members: ``archive/data.warc.gz``, one
gzip member a record, and ``indexes/index.cdxj``, one line a record with its
offset and length. The reader finds the end-of-directory record (and the ZIP64
one), parses the central directory, locates both members in the file, and reads
each record by its range; nothing is extracted.

Of records with equal payloads of at least ``LEAST`` bytes, that with the
smallest page_id is a response and the others are revisits of it; rows that
share that page_id are all responses. Null payloads are empty. A null page_id
comes last; a group without any page_id has responses only. Long payloads are
records like others; an empty table gives no archive and no rows. Other columns
of the pages are ignored but for ``url`` (null: empty target).
"""

from __future__ import annotations

import hashlib
import struct
import zipfile
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_folder, skew_join, small_batches, stage
from .files import Counted, create, open_random

#: Payload bytes from which a repeat is a revisit.
LEAST = 100
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
ROWS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def plan(pages: DataFrame) -> DataFrame:
    """Each page with its payload, digest, record type and the page it refers to."""
    html = F.coalesce("html", F.lit(""))
    digests = pages.select("page_id", F.sha2(html, 256).alias("digest"), F.octet_length(html).alias("n")).filter(F.col("n") >= LEAST)
    first = stage(pages.sparkSession, digests.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("copies")).filter("copies > 1 and first is not null"), "first-pages")
    rows = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), html.alias("payload"), F.sha2(html, 256).alias("digest"))
    rows = skew_join(rows, first, "digest", "copies", first.agg(F.sum("copies")).first()[0] or 0, "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return rows.select("page_id", "url", "payload", "digest", F.when(revisit, F.col("first")).alias("refers_to"))


def record(page_id, url: str, payload: bytes, digest: str, refers_to) -> bytes:
    kind = "response" if refers_to is None else "revisit"
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n" + (payload if refers_to is None else b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Target-URI: {' '.join(url.split())}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"Payload-Length: {len(payload)}",
        "Content-Type: application/http;msgtype=response",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join([*head, f"Content-Length: {len(body)}", "", ""]).encode() + body + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Named fields and the payload (after the HTTP head) of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record at this range")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    body = rest[: int(fields["Content-Length"])]
    return fields, body.partition(b"\r\n\r\n")[2]


def write_archives(rows: DataFrame, folder: str) -> DataFrame:
    """One archive a partition; returns ``(archive, records, task)``."""
    small_batches(rows.sparkSession)

    def run(batches):
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        uri, stream = create(folder, ".wacz")
        index, n = [], 0
        with zipfile.ZipFile(Counted(stream), "w", zipfile.ZIP_STORED) as z:
            with z.open(DATA, "w", force_zip64=True) as out:
                at = 0
                b = first
                while b is not None:
                    for page_id, url, payload, digest, refers_to in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                        packer = zlib.compressobj(1, wbits=31)
                        data = packer.compress(record(page_id, url, payload.encode(), digest, refers_to)) + packer.flush()
                        out.write(data)
                        index.append(f"{'-' if page_id is None else page_id} {at} {len(data)}\n")
                        at += len(data)
                        n += 1
                    b = next(batches, None)
            z.writestr(INDEX, "".join(index))
        stream.close()
        yield pa.RecordBatch.from_arrays([pa.array([uri]), pa.array([n], pa.int64()), pa.array([TaskContext.get().partitionId()], pa.int32())], names=["archive", "records", "task"])

    return rows.mapInArrow(run, "archive string, records long, task int")


def directory(f, size: int) -> dict[str, tuple[int, int, int]]:
    """Of a ZIP file: each member's (local header offset, stored size, method), from the central directory."""
    tail = read_at(f, max(0, size - 65_557 - 20), min(size, 65_557 + 20))
    end = tail.rfind(b"PK\x05\x06")
    if end < 0:
        raise ValueError("no end of central directory")
    count, length, offset = struct.unpack_from("<HII", tail, end + 10)
    if end >= 20 and tail[end - 20 : end - 16] == b"PK\x06\x07":
        (at,) = struct.unpack_from("<Q", tail, end - 12)
        end64 = read_at(f, at, 56)
        if end64[:4] != b"PK\x06\x06":
            raise ValueError("no ZIP64 end of central directory")
        count, length, offset = struct.unpack_from("<QQQ", end64, 32)
    entries, at, found = read_at(f, offset, length), 0, {}
    for _ in range(count):
        if entries[at : at + 4] != b"PK\x01\x02":
            raise ValueError("broken central directory")
        (method,) = struct.unpack_from("<H", entries, at + 10)
        packed, plain, n, m, k = struct.unpack_from("<IIHHH", entries, at + 20)
        (header,) = struct.unpack_from("<I", entries, at + 42)
        name = entries[at + 46 : at + 46 + n].decode()
        extra, x = entries[at + 46 + n : at + 46 + n + m], 0
        while x + 4 <= len(extra):
            tag, size_ = struct.unpack_from("<HH", extra, x)
            if tag == 1:  # ZIP64: the fields that overflowed, in this order
                values = iter(struct.unpack_from(f"<{size_ // 8}Q", extra, x + 4))
                plain = next(values) if plain == 0xFFFFFFFF else plain
                packed = next(values) if packed == 0xFFFFFFFF else packed
                header = next(values) if header == 0xFFFFFFFF else header
            x += 4 + size_
        found[name] = (header, packed, method)
        at += 46 + n + m + k
    return found


def read_at(f, offset: int, length: int) -> bytes:
    f.seek(offset)
    return f.read(length)


def stored(f, entry: tuple[int, int, int]) -> tuple[int, int]:
    """(first byte, length) of a stored member's data in the file."""
    header, length, method = entry
    if method != 0:
        raise ValueError("the member is not stored")
    n, m = struct.unpack_from("<HH", read_at(f, header, 30), 26)
    return header + 30 + n + m, length


def read_archive(uri: str):
    """Yields (page_id, payload bytes, digest, type, refers_to) of each indexed record."""
    with open_random(uri) as f:
        members = directory(f, f.size())
        data, _ = stored(f, members[DATA])
        for line in read_at(f, *stored(f, members[INDEX])).decode().splitlines():
            page_id, at, length = line.split()
            fields, payload = parse_record(zlib.decompress(read_at(f, data + int(at), int(length)), wbits=31))
            kind, digest, n = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha256:"), int(fields["Payload-Length"])
            if kind == "response" and (len(payload) != n or hashlib.sha256(payload).hexdigest() != digest):
                raise ValueError(f"payload of page {page_id} differs from its digest")
            refers = fields.get("WARC-Refers-To")
            yield None if page_id == "-" else int(page_id), n, digest, kind, refers and int(refers[len("<urn:page:") : -1])


def read_archives(archives: DataFrame) -> DataFrame:
    """Every record of every archive, a task for each archive."""
    tasks = 1 + (archives.agg(F.max("task")).first()[0] or 0)

    def run(batches):
        for b in batches:
            for uri in b.column(0).to_pylist():
                rows = list(read_archive(uri))
                for a in range(0, len(rows), 10_000):
                    columns = zip(*rows[a : a + 10_000], strict=True)
                    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return archives.select("archive", "task").repartitionById(tasks, "task").mapInArrow(run, ROWS)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write all pages to archives in the shared folder and read every record back."""
    spark = pages.sparkSession
    made = stage(spark, write_archives(plan(pages), new_folder(spark, "warc")), "archives")
    return read_archives(made)


ORACLE = f"""
with p as (select row_number() over () as r, page_id, encode(coalesce(html, '')) as b from pages),
d as (select page_id, octet_length(b) as n, sha256(b) as digest from p),
f as (select digest, min(page_id) as first from d where n >= {LEAST} group by digest having count(*) > 1)
select page_id, cast(n as bigint) as payload_bytes, d.digest as payload_digest,
  case when first is not null and page_id is distinct from first then 'revisit' else 'response' end as record_type,
  case when first is not null and page_id is distinct from first then first end as refers_to
from d left join f on d.digest = f.digest and d.n >= {LEAST}
"""
