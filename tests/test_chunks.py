"""Chunked decoding: any cuts give what the whole gives."""

import hashlib
import random

import pytest

from foliant.sources import chunks

TEXT = "a&é€\U0001f600\U0010ffff中\n" * 3


@pytest.mark.parametrize("encoding", ["utf-8", "utf-8-sig", "utf-16-le", "utf-16-be"])
def test_any_cuts(spark, encoding):
    mark = {"utf-16-le": b"\xff\xfe", "utf-16-be": b"\xfe\xff"}.get(encoding, b"")
    whole, rnd, rows = mark + TEXT.encode(encoding), random.Random(1), []
    for k in range(60):
        cuts = sorted(rnd.sample(range(len(whole) + 1), min(k, 40))) if k else []
        cuts = list(range(len(whole))) if k == 59 else cuts
        rows += [(k, i, bytearray(whole[a:z])) for i, (a, z) in enumerate(zip([0, *cuts], [*cuts, len(whole)], strict=True))]
    rnd.shuffle(rows)
    docs = spark.createDataFrame(rows, "k long, number long, data binary")
    found = chunks.evidence(docs, "k").collect()
    sha = lambda b: hashlib.sha256(b).hexdigest()
    plain = encoding.removesuffix("-sig")
    assert {(r["encoding"], r["encoded_bytes"], r["decoded_bytes"], r["encoded_sha256"], r["decoded_sha256"], r["reason"]) for r in found} == {(plain, len(whole), len(TEXT.encode()), sha(whole), sha(TEXT.encode()), None)}
    assert len(found) == 60 and all(r["marked"] == (encoding != "utf-8") for r in found)
    pieces = {}
    for r in sorted(chunks.texts(docs, "k").collect(), key=lambda r: (r["k"], r["number"] is None, r["number"])):
        pieces[r["k"]] = pieces.get(r["k"], "") + r["text"]
    assert set(pieces.values()) == {TEXT}


def test_reasons(spark):
    cases = {
        "empty": ([b""], None, None), "short mark": ([b"\xef\xbb"], None, "invalid_utf8"), "one byte of a mark": ([b"\xff"], None, "invalid_utf8"),
        "cut character": ([b"a", "é".encode()[:1]], None, "invalid_utf8"), "bad byte": ([b"a\xff", b"b"], None, "invalid_utf8"), "odd": ([b"\xff\xfea"], None, "invalid_utf16le"),
        "lone surrogate": ([b"\xfe\xff\xd8", b"\x00"], None, "invalid_utf16be"), "gap": ([b"a", None, b"c"], None, "missing_chunk"), "large": ([b"a" * 50, b"b" * 51], None, "too_large"),
        "expected": (["é".encode("utf-16-le")], "utf-16-le", None), "mismatch": ([b"\xff\xfea\x00"], "utf-8", "encoding_mismatch"), "two bytes a letter": ([b"<\x00", b"a\x00"], "utf-8", "encoding_mismatch"),
    }
    for name, (parts, expected, reason) in cases.items():
        rows = spark.createDataFrame([(name, i, p) for i, p in enumerate(parts)], "k string, number int, data binary")
        (found,) = chunks.evidence(rows, "k", expected=expected, most=100).collect()
        assert (found["reason"], found["chunks"]) == (reason, len(parts)), name
        assert (found["decoded_sha256"] is None) == (reason is not None)
    twice = spark.createDataFrame([("k", 0, b"a"), ("k", 0, b"a"), (None, 1, b"x"), ("n", None, b"x")], "k string, number int, data binary")
    assert {r["k"]: r["reason"] for r in chunks.evidence(twice, "k").collect()} == {"k": "repeated_chunk", None: "missing_chunk", "n": "missing_chunk"}
    assert chunks.evidence(twice.limit(0), "k").count() == 0
