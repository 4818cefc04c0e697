"""Text decoding of captures that arrive in chunks, cut anywhere.

Chunks of a capture are read in the order of their numbers by a decoder that
carries what a cut splits (bytes of a mark, of a character, surrogates), and both
digests, from one to the next; so memory is bounded by a chunk, however long a
capture is, and any cuts give what the whole gives. A digest is sequential by
nature: one capture's chunks stream through one task.
"""

from __future__ import annotations

import codecs
import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .captures import MARKS, MOST_BYTES

#: Codes of bytes that are no text in an encoding.
INVALID = {"utf-8": "invalid_utf8", "utf-16-le": "invalid_utf16le", "utf-16-be": "invalid_utf16be"}


class Refused(Exception):
    pass


class ChunkDecoder:
    """``push`` each chunk in order, then ``finish``; both give text, or raise ``Refused`` with a code. What was given before isn't evidence then."""

    def __init__(self, expected: str | None = None, most: int = MOST_BYTES):
        self.expected, self.most = expected, most
        self.encoding: str | None = None
        self.marked = False
        self.head = b""
        self.encoded, self.decoded = hashlib.sha256(), hashlib.sha256()
        self.encoded_bytes = self.decoded_bytes = 0
        self._decoder = None

    def _choose(self, final: bool) -> None:
        """Choose the encoding once the mark is whole, or can't be one."""
        mark = next((m for m in MARKS if self.head.startswith(m[0])), None)
        if mark is None and not final and any(m.startswith(self.head) for m, _ in MARKS):
            return
        found = mark[1] if mark else self.expected or "utf-8"
        if self.expected not in (None, found):
            raise Refused("encoding_mismatch")
        self.encoding, self.marked = found, mark is not None
        self._decoder = codecs.getincrementaldecoder(found)()
        self.head = self.head[len(mark[0]) :] if mark else self.head

    def push(self, chunk: bytes, final: bool = False) -> str:
        self.encoded.update(chunk)
        self.encoded_bytes += len(chunk)
        if self._decoder is None:
            self.head += chunk
            self._choose(final)
            if self._decoder is None:
                return ""
            chunk, self.head = self.head, b""
        try:
            text = self._decoder.decode(chunk, final)
        except UnicodeDecodeError:
            raise Refused(INVALID[self.encoding]) from None
        # Two bytes a letter read as UTF-8 where that was promised: zeros between letters, which no capture may hold.
        if self.expected == "utf-8" and "\x00" in text:
            raise Refused("encoding_mismatch")
        data = text.encode()
        self.decoded.update(data)
        self.decoded_bytes += len(data)
        if self.decoded_bytes > self.most:
            raise Refused("too_large")
        return text

    def finish(self) -> str:
        return self.push(b"", True)


EVIDENCE = "encoding string, marked boolean, chunks long, encoded_bytes long, decoded_bytes long, encoded_sha256 string, decoded_sha256 string, reason string"
PIECE = "number long, text string"


def _runs(batches, expected: str | None, most: int):
    """For each capture in turn: its id, and a generator of ``(number, text)`` that ends in a decoder and a reason."""
    now, decoder, count, last, reason = None, None, 0, None, None
    for b in batches:
        for i, (number, data) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)):
            own = b.column(0)[i]
            if now is None or own != now:
                if now is not None:
                    yield from _ended(now, decoder, count, reason)
                now, decoder, count, last, reason = own, ChunkDecoder(expected, most), 0, None, None
            text = ""
            if reason is None:
                try:
                    if number is None or data is None:
                        raise Refused("missing_chunk")
                    if number == last:
                        raise Refused("repeated_chunk")
                    if number != (0 if last is None else last + 1):
                        raise Refused("missing_chunk")
                    text = decoder.push(data)
                except Refused as e:
                    reason = str(e)
            count, last = count + 1, number
            yield now, number, text, None
    if now is not None:
        yield from _ended(now, decoder, count, reason)


def _ended(own, decoder: ChunkDecoder, count: int, reason: str | None):
    text = ""
    if reason is None:
        try:
            text = decoder.finish()
        except Refused as e:
            reason = str(e)
    good = reason is None
    evidence = (decoder.encoding, decoder.marked, count, *(x if good else None for x in (decoder.encoded_bytes, decoder.decoded_bytes, decoder.encoded.hexdigest(), decoder.decoded.hexdigest())), reason)
    yield own, None, text, evidence


def _dealt(chunks: DataFrame, key: str, number: str, data: str) -> DataFrame:
    return chunks.select(key, F.col(number).cast("long").alias("number"), F.col(data).alias("data")).repartition(key).sortWithinPartitions(key, F.col("number").asc_nulls_first())


def _kind(chunks: DataFrame, key: str) -> str:
    return f"`{key}` {chunks.schema[key].dataType.simpleString()}"


def evidence(chunks: DataFrame, key: str, number: str = "number", data: str = "data", expected: str | None = None, most: int = MOST_BYTES) -> DataFrame:
    """``(key, encoding, marked, chunks, encoded_bytes, decoded_bytes, encoded_sha256, decoded_sha256, reason)`` of each capture.

    Numbers count from 0. The encoding is the mark's, else the expected one, else UTF-8. With a reason there are no
    sizes and digests: missing_chunk (a gap, a null number or chunk), repeated_chunk, encoding_mismatch,
    invalid_utf8, invalid_utf16le, invalid_utf16be (at the end of the last chunk too), too_large (decoded).
    """
    names = [key, *(x.split()[0] for x in EVIDENCE.split(", "))]
    kinds = (pa.string(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())

    def run(batches):
        for own, _, _, found in _runs(batches, expected, most):
            if found is not None:
                yield pa.RecordBatch.from_arrays([pa.array([own.as_py()], own.type), *(pa.array([v], t) for v, t in zip(found, kinds, strict=True))], names=names)

    return _dealt(chunks, key, number, data).mapInArrow(run, f"{_kind(chunks, key)}, {EVIDENCE}")


def texts(chunks: DataFrame, key: str, number: str = "number", data: str = "data", expected: str | None = None, most: int = MOST_BYTES) -> DataFrame:
    """``(key, number, text)``: what each chunk adds to its capture's text; what a cut split comes with the chunk that ends it.
    Only captures whose ``evidence`` has no reason may be used."""

    def run(batches):
        for own, n, text, found in _runs(batches, expected, most):
            if found is None or text:
                yield pa.RecordBatch.from_arrays([pa.array([own.as_py()], own.type), pa.array([n], pa.int64()), pa.array([text])], names=[key, "number", "text"])

    return _dealt(chunks, key, number, data).mapInArrow(run, f"{_kind(chunks, key)}, {PIECE}")
