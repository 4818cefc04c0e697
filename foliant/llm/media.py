"""Media columns: content-addressed payloads in tar shards.

A text's UTF-8 bytes, filled with spaces to rows of 192 samples, become an
8-bit greyscale PNG image, named by the payload's SHA-256 in a tar shard of the
task that wrote it (once a shard). Rows carry digest, shard, offset and length;
metadata columns come from range reads of the image's header alone, features
from its decoded samples.

Null and empty texts are one row of spaces; long texts are long images. Equal
texts have equal values wherever they are stored, so ties don't matter. Rows are
independent; repeated rows give repeated results, an empty table none. Columns
but ``doc_id`` and ``text`` are not looked at. Rows are read back by stretches of
about ``STRETCH`` bytes of a shard, so readers grow in number with the media.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_folder, small_batches, stage
from .files import Counted, create, open_random

#: Samples in a row of the image.
WIDTH = 192
SIGNATURE = b"\x89PNG\r\n\x1a\n"
HEADER_BYTES = 33
#: Bytes of a shard that a reading task is given.
STRETCH = 32 << 20


def chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes) -> bytes:
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)  # filter type 0 before each row
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + chunk(b"IEND", b"")


def png_header(head: bytes) -> tuple[int, int, int]:
    """(width, height, bits a sample) from the first HEADER_BYTES of an image."""
    if head[:8] != SIGNATURE or head[12:16] != b"IHDR" or zlib.crc32(head[12:29]) != struct.unpack(">I", head[29:33])[0]:
        raise ValueError("no PNG header at this offset")
    return struct.unpack(">IIB", head[16:25])


def from_png(image: bytes) -> np.ndarray:
    """The samples, as rows; for greyscale 8-bit images without filters, as written here."""
    width, height, bits = png_header(image[:HEADER_BYTES])
    at, data = HEADER_BYTES, []
    while at < len(image):
        (n,) = struct.unpack_from(">I", image, at)
        kind, body = image[at + 4 : at + 8], image[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack_from(">I", image, at + 8 + n)[0]:
            raise ValueError("broken PNG chunk")
        if kind == b"IDAT":
            data.append(body)
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, width + 1)
    if bits != 8 or lines[:, 0].any():
        raise ValueError("not an image of this writer")
    return lines[:, 1:]


def features(samples: np.ndarray) -> str:
    """Mean, deviation, entropy of the samples, and mean step between neighbours."""
    counts = np.bincount(samples.ravel(), minlength=256)
    p = counts[counts > 0] / counts.sum()
    level = np.arange(256)
    mean = float((counts * level).sum() / counts.sum())
    deviation = float(np.sqrt((counts * (level - mean) ** 2).sum() / counts.sum()))
    step = float(np.abs(np.diff(samples.ravel().astype(np.int16))).mean())
    return f"mean={mean:.4f};deviation={deviation:.4f};entropy={float(-(p * np.log2(p)).sum()):.4f};step={step:.4f}"


def store(docs: DataFrame, folder: str) -> DataFrame:
    """``(doc_id, n_bytes, digest, shard, offset, length)``; the images are in the folder's shards."""
    small_batches(docs.sparkSession)

    def run(batches):
        uri, stream, held = None, None, {}
        for b in batches:
            out = []
            for text in b.column(1).to_pylist():
                raw = (text or "").encode()
                payload = raw + b" " * (-len(raw) % WIDTH or (0 if raw else WIDTH))
                digest = hashlib.sha256(payload).digest()
                if digest not in held:
                    if stream is None:
                        uri, file = create(folder, ".tar")
                        stream = Counted(file)
                    image = to_png(payload)
                    entry = tarfile.TarInfo(f"{digest.hex()[:2]}/{digest.hex()}.png")
                    entry.size = len(image)
                    stream.write(entry.tobuf(tarfile.PAX_FORMAT))
                    held[digest] = (stream.at, len(image))
                    stream.write(image + bytes(-len(image) % 512))
                out.append((len(raw), digest.hex(), uri, *held[digest]))
            columns = list(zip(*out, strict=True)) or [[]] * 5
            kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names=["doc_id", "n_bytes", "digest", "shard", "offset", "length"])
        if stream is not None:
            stream.write(bytes(1024))
            stream.stream.close()

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, digest string, shard string, offset long, length long")


OUT = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, width long, height long"


def measure(f, offset: int, length: int) -> tuple:
    f.seek(offset)
    width, height, _ = png_header(f.read(HEADER_BYTES))
    f.seek(offset)
    image = f.read(length)
    samples = from_png(image)
    payload = samples.tobytes()
    return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(image), hashlib.sha256(image).hexdigest(), features(samples), width, height


def read_back(stored: DataFrame) -> DataFrame:
    """Every row with what its stored image holds."""

    def run(batches):
        for b in batches:
            shards, known, out = {}, {}, []
            try:
                for doc_id, n, digest, shard, offset, length in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
                    if digest not in known:
                        if shard not in shards:
                            shards[shard] = open_random(shard)
                        known[digest] = measure(shards[shard], offset, length)
                        if known[digest][1] != digest:
                            raise ValueError(f"{shard} at {offset} holds another payload")
                    out.append((doc_id, n, *known[digest]))
            finally:
                for f in shards.values():
                    f.close()
            if out:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64())
                names = [x.split()[0] for x in OUT.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return stored.mapInArrow(run, OUT)


def round_trip(docs: DataFrame) -> DataFrame:
    spark = docs.sparkSession
    stored = stage(spark, store(docs, new_folder(spark, "media")), "media")
    # Rows of one stored image, however many, are dealt by document too: each part of them reads it once.
    media = stored.agg(F.sum("length")).first()[0] or 0
    tasks = max(1, -(-media // STRETCH))
    stretch = stored.withColumn("_stretch", F.floor(F.col("offset") / STRETCH))
    return read_back(stretch.repartition(tasks, "shard", "_stretch", F.pmod(F.xxhash64("doc_id"), F.lit(4))).sortWithinPartitions("shard", "offset").drop("_stretch"))
