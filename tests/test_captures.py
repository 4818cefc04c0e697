"""Raw captures and the circuit breaker on small inputs with known rows."""

from decimal import Decimal

import pyarrow as pa
from pyspark.sql import functions as F

from foliant.sources import captures
from foliant.streaming import breaker


def test_decoding_by_mark_charset_and_limit(spark):
    cases = [
        (1, b"\xef\xbb\xbfcaf\xc3\xa9", None, ("café", "utf-8", None)),
        (2, "a\U0001f600".encode("utf-16-le"), "UTF-16-LE", ("a\U0001f600", "utf-16-le", None)),
        (3, b"\xfe\xff\xd8\x00", None, (None, "utf-16-be", "malformed")),
        (4, b"\xff\xfea\x00", "utf-8", (None, "utf-16-le", "conflicting_charset")),
        (5, b"a", "no-such", (None, "no-such", "unknown_charset")),
        (6, b"", None, ("", "utf-8", None)),
        (7, None, None, (None, None, "missing")),
        (8, b"x" * 101, None, (None, None, "too_large")),
    ]
    rows = spark.createDataFrame([c[:3] for c in cases], "k int, raw binary, charset string")
    found = {r["k"]: (r["text"], r["encoding"], r["reason"]) for r in captures.decode(rows, declared=F.col("charset"), most=100).collect()}
    assert found == {c[0]: c[3] for c in cases}


def test_decoding_hands_python_small_batches(spark, monkeypatch):
    def probe(raw: pa.Array, declared: pa.Array) -> pa.Array:
        size = pa.array([f"{len(raw)} {raw.nbytes}"] * len(raw))
        return pa.StructArray.from_arrays([size, size, size], ["text", "encoding", "reason"])

    monkeypatch.setattr(captures, "_decoded", F.arrow_udf(probe, "struct<text: string, encoding: string, reason: string>"))
    names = [f"spark.sql.execution.arrow.max{x}PerBatch" for x in ("Records", "Bytes")]
    before = [spark.conf.get(n) for n in names]
    for n, default in zip(names, ("10000", "64m"), strict=True):
        spark.conf.set(n, default)
    wide = F.concat(F.unhex(F.lit("FFFE")), F.encode(F.repeat(F.lit("x"), 20_000), "UTF-16LE"))
    found = captures.decode(spark.range(0, 3000, 1, 1).select("id", wide.alias("raw"))).select("text").distinct().collect()
    for n, value in zip(names, before, strict=True):
        spark.conf.set(n, value)
    for rows, size in (map(int, r["text"].split()) for r in found):
        assert rows <= 512 and size < 8 << 20


def test_repair_keeps_different_references_apart(spark):
    cases = {
        "&#1;&#4;": "�#1;�#4;",
        "&#00000065;&#x0041;&#0;&#x00;": "&#00000065;&#x0041;�#0;�#x00;",
        "&#;&#x;&#xD800;&amp;&#1": "&#;&#x;�#xD800;&amp;&#1",
        "&#00000000000000000000031;": "�#00000000000000000000031;",
        "": "",
        None: None,
    }
    rows = spark.createDataFrame([(k,) for k in cases], "x string").select("x", captures.repair(F.col("x")).alias("y"))
    assert {r["x"]: r["y"] for r in rows.collect()} == cases


def test_repair_agrees_with_the_definition_over_all_numbers(spark):
    n = F.col("id")
    legal = n.isin(9, 10, 13) | n.between(32, 55295) | n.between(57344, 65533) | n.between(65536, 1114111)
    ref = lambda x, body: F.concat(F.lit(x), body, F.lit(";"))
    texts = [ref("&#", n.cast("string")), ref("&#x", F.hex(n)), ref("&#x", F.lower(F.hex(n)))]
    wrong = F.lit(False)
    for t in texts:
        wrong = wrong | ((captures.repairs(t) == 0) != legal)
    assert spark.range(1_200_000).filter(wrong).count() == 0


def test_ledgers_with_missing_parts(spark):
    def envelope(rows):
        return f'<ENVELOPE><BODY><DESC><LEDGER NAME="not a row"/></DESC><DATA><COLLECTION>{rows}</COLLECTION></DATA></BODY></ENVELOPE>'

    flag = "<ISBILLWISEON>Yes</ISBILLWISEON>"
    texts = [
        envelope(f'<LEDGER NAME="a &#4; b"><PARENT>p</PARENT>{flag}<CLOSINGBALANCE>-1.50</CLOSINGBALANCE></LEDGER><LEDGER NAME="  ">{flag}</LEDGER>'),
        envelope('<LEDGER NAME="c"/>'),
        envelope(f'<LEDGER NAME="d">{flag}<OPENINGBALANCE>1e5</OPENINGBALANCE></LEDGER>'),
        envelope(""),
        "<ENVELOPE><BODY>",
        None,
    ]
    found = captures.ledgers(spark.createDataFrame([(t, 1) for t in texts], "xml string, reason int")).collect()
    zero = Decimal("0.00")
    assert sorted((tuple(r) for r in found), key=str) == sorted(
        [
            ("a �#4; b", "p", Decimal("-1.50"), zero, True, None),
            ("  ", None, zero, zero, True, "missing_name"),
            ("c", None, zero, zero, None, "missing_flag"),
            ("d", None, zero, None, True, "bad_amount"),
            (None, None, None, None, None, "malformed_xml"),
        ],
        key=str,
    )
    assert captures.ledgers(spark.createDataFrame([], "xml string")).count() == 0


def test_breaker_keeps_its_state_between_micro_batches(spark, tmp_path):
    schema = "endpoint string, at_us long, attempt_id long, outcome string"
    steps = [  # (time, outcome, phase, failures)
        (0, "failure", "closed", 1), (1, "rejected", "closed", 1), (2, "failure", "closed", 2), (3, "failure", "closed", 3), (4, "success", "open", 3),
        (12, "success", "open", 3), (13, "failure", "half_open", 4), (14, "success", "open", 4), (23, "success", "half_open", 0), (24, "failure", "closed", 1),
    ]
    rows = [("a", t, i, o) for i, (t, o, _, _) in enumerate(steps)]
    for part, name in ((rows[:3], "1"), (rows[3:7][::-1], "2"), (rows[7:] + [("b", None, 99, "failure")], "3")):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{name}")
        stream = breaker.states(spark.readStream.schema(schema).parquet(f"{tmp_path}/in/*"), cooldown_us=10)
        stream.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/progress").trigger(availableNow=True).start(f"{tmp_path}/out").awaitTermination()
    found = spark.read.parquet(f"{tmp_path}/out").orderBy("attempt_id").collect()
    assert [(r["at_us"], r["phase"], r["failures"]) for r in found] == [(t, p, n) for t, _, p, n in steps]
