"""The table of elements on small captures: places, fragments, refusals, guards."""

import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from foliant.sources import captures, elements


def table(spark, *raws, **limits):
    rows = spark.createDataFrame([(i, r) for i, r in enumerate(raws)], "k long, raw binary")
    return elements.elements(rows, "k", **limits)


def test_fragments_are_the_original_bytes(spark):
    raw = '<a X="1>2" y=\'"\'><b/><c>t &#4; &#x1;<b  />é</c><B></B ></a>'.encode()
    found = {r["id"]: r for r in table(spark, raw).collect()}
    cut = [raw[found[i]["first"] : found[i]["last"]] for i in range(5)]
    assert cut == [raw, b"<b/>", '<c>t &#4; &#x1;<b  />é</c>'.encode(), b"<b  />", b"<B></B >"]
    assert all(r["sha256"] == hashlib.sha256(c).hexdigest() for r, c in zip((found[i] for i in range(5)), cut, strict=True))
    assert [(r["path"], r["parent"], r["depth"]) for _, r in sorted(found.items())] == [("/A", None, 1), ("/A/B", 0, 2), ("/A/C", 0, 2), ("/A/C/B", 2, 3), ("/A/B", 0, 2)]
    assert found[0]["attributes"] == {"X": "1>2", "Y": '"'} and found[2]["text"] == "t �#4; �#x1;é"


def test_places_lead_back_through_any_number_of_marks():
    rnd = random.Random(1)
    for _ in range(300):
        raw = b"".join(rnd.choice((b"&#1;", b"&#x00;", b"a", b"&#65;", "é".encode(), b"&#99999999;")) for _ in range(rnd.randint(0, 30)))
        new, at = elements.repaired(raw)
        marks = [i for i in range(len(new)) if new[i : i + 4] == "�#".encode()]
        assert elements.original(np.array([*marks, len(new)]), at).tolist() == [*at.tolist(), len(raw)]
        plain = [i for i in range(len(new)) if new[i] == 97]
        assert all(raw[i] == 97 for i in elements.original(np.array(plain, np.int64), at))


def test_what_cannot_be_read_is_a_row_with_a_reason(spark):
    deep = b"<a>" * 6 + b"</a>" * 6
    raws = [None, b"x" * 301, b"", b"<a>", b"<a></b>", b"<!DOCTYPE a><a/>", b"<a><?x y?></a>", deep, b"<a>" + b"<b/>" * 40 + b"</a>", b'<a x="1" X="2"/>', b"<a/><a/>", b"<a>&#4;</a>", b"\xff\xfe<\x00a\x00/\x00>\x00"]
    found = {r["k"]: r["reason"] for r in table(spark, *raws, most=300, most_depth=5, most_elements=30).collect()}
    assert found == {0: "missing", 1: "too_large", 2: "malformed_xml", 3: "malformed_xml", 4: "malformed_xml", 5: "forbidden_construct", 6: "forbidden_construct", 7: "too_deep", 8: "too_many_elements", 9: "repeated_attribute", 10: "malformed_xml", 11: None, 12: "not_utf8"}
    assert table(spark).count() == 0


def test_guard_lists_every_violation(spark):
    good = b'<ENVELOPE><HEADER><VERSION>1</VERSION><STATUS>1</STATUS></HEADER><BODY>\n<DATA><COLLECTION><LEDGER any="x"><FREE y="z">text</FREE></LEDGER></COLLECTION><COMPANYCONTEXT a="b"><C>t</C></COMPANYCONTEXT></DATA></BODY></ENVELOPE>'
    bad = b'<ENVELOPE x="1" y="2"><HEADER><STATUS z="1"><DEEP/></STATUS>lost</HEADER><BODY><DATA><COLLECTION><GROUP/><COMPANYCONTEXT/></COLLECTION></DATA></BODY><TAIL/></ENVELOPE>'
    found = elements.violations(table(spark, good, bad, b"<OTHER/>", None), "k", elements.export_structure("LEDGER")).collect()
    assert sorted((r["k"], r["path"] or "", r["reason"], r["detail"] or "") for r in found) == sorted([
        (1, "/ENVELOPE", "unexpected_attribute", "X,Y"), (1, "/ENVELOPE/HEADER/STATUS", "unexpected_attribute", "Z"), (1, "/ENVELOPE/HEADER/STATUS/DEEP", "unexpected_element", "DEEP"),
        (1, "/ENVELOPE/HEADER", "unexpected_text", "lost"), (1, "/ENVELOPE/BODY/DATA/COLLECTION/GROUP", "unexpected_element", "GROUP"), (1, "/ENVELOPE/BODY/DATA/COLLECTION/COMPANYCONTEXT", "unexpected_element", "COMPANYCONTEXT"),
        (1, "/ENVELOPE/TAIL", "unexpected_element", "TAIL"), (2, "/OTHER", "unexpected_element", "OTHER"), (3, "", "missing", ""),
    ])


def test_scoped_exports_name_the_first_reason(spark):
    def capture(status="<STATUS>1</STATUS>", context='<COMPANYCONTEXT SCHEMA="s" OBJECTTYPE="LEDGER" RECORDCOUNT="{}"/>', rows='<LEDGER GUID="c-1"/><LEDGER REMOTEID="r"/>', n="2"):
        return f"<ENVELOPE><HEADER>{status}</HEADER><BODY>{context.replace("{}", n)}{rows}<LOOSE><LEDGER/></LOOSE></BODY></ENVELOPE>".encode()

    two = '<COMPANYCONTEXT SCHEMA="s" OBJECTTYPE="LEDGER" RECORDCOUNT="{}"/>'
    raws = [capture(), capture(status=""), capture(status="<STATUS>0</STATUS>"), capture(context=""), capture(context=two * 2), capture(context=two.replace('"s"', '"x"')), capture(context=two.replace("LEDGER", "GROUP")),
            capture(n="x"), capture(n="3"), capture(rows='<LEDGER NAME="n"/><LEDGER GUID="c-2"/>'), capture(rows='<LEDGER GUID="c-1"/><LEDGER GUID="c-1"/>'), None]
    found = {r["k"]: r for r in elements.scoped_exports(table(spark, *raws), "k", "s", "LEDGER", F.lit("C")).collect()}
    assert [found[i]["reason"] for i in range(12)] == [None, "status_missing", "source_reported_failure", "context_missing", "repeated_context", "schema_mismatch", "object_type_mismatch", "count_missing", "count_mismatch", "missing_identity", "duplicate_identity", "missing"]
    assert (found[0]["records"], found[0]["identified"], found[0]["matching"], found[0]["other"]) == (2, 2, 1, 1)


def test_marker_offsets_agree_with_the_byte_map(spark):
    texts = ["é&#4;x&#x1;&#4;&#65;", "&#0;", "none", "", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "k long, xml string")
    found = sorted((r["k"], r["ordinal"], r["reference"], r["repaired_at"], r["original_at"]) for r in elements.marker_offsets(rows, "k").collect())
    assert found == [(0, 1, "&#4;", 2, 2), (0, 2, "&#x1;", 9, 7), (0, 3, "&#4;", 16, 12), (1, 1, "&#0;", 0, 0)]
    assert captures.repairs(F.col("xml")) is not None
