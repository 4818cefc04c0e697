"""Strict JSON: each refusal, and cells of every kind."""

from foliant.sources import strict

ENVELOPE = '{"status":"1","data":{"metadata":{"is_mst_dep_type":true,"mst_dep_type":"8"},"collection":[%s]}}'
RECORD = '{"metadata":{"type":"Ledger","name":"n","reservedname":""},"parent":{"type":"String","value":"p, {\\"q\\": ["},"closingbalance":{"type":"Amount","value":"-1.50"},"languagename":[{"name":[{"metadata":true,"type":"String"},"a","b"]}]%s}'


def reasons(spark, *texts, **limits):
    rows = spark.createDataFrame(list(enumerate(texts)), "k long, json string")
    return {r["k"]: r["reason"] for r in strict.ledgers(rows, "k", limits=strict.Limits(**limits)).collect()}


def test_refusals(spark):
    good = ENVELOPE % (RECORD % "")
    cases = {
        good: None, f" {good}\n": None, good + " x": "malformed_json", good + good: "malformed_json", "": "malformed_json", " ": "malformed_json", '"s"': "malformed_json", "[1]": "malformed_json", good[:-1]: "malformed_json",
        None: "missing", good.replace('"p,', '"\\u0000p,'): None, ENVELOPE % (RECORD % ',"parent":{"type":"String","value":"q"}'): "duplicate_field", good.replace('{"status"', '{"status":"1","status"'): "duplicate_field",
        '{"a":' + "[" * 40 + "]" * 40 + "}": "resource_limit_exceeded", '{"status":"0"}': "application_rejected", "{}": "status_missing", '{"status":1}': "status_invalid", '{"status":"2"}': "status_invalid", '{"status":"1","data":{}}': "wrong_container",
        '{"status":"1","data":{"metadata":{},"collection":{}}}': "wrong_container", good.replace('"data":{', '"data":{"more":1,'): "wrong_container", good.replace("true", "false"): "profile_mismatch", good.replace('"8"', "8"): "profile_mismatch",
        ENVELOPE % (RECORD % ',"x":1'): "profile_mismatch", ENVELOPE % "5": "profile_mismatch", ENVELOPE % "null": "profile_mismatch", ENVELOPE % (RECORD % ',"tbalopening":{"type":"Amount","value":"1e5"}'): "typed_value_mismatch",
        ENVELOPE % (RECORD % ',"tbalopening":{"type":"Amount","value":""}'): None, ENVELOPE % (RECORD % ',"ledgerphone":"x"'): "typed_value_mismatch", ENVELOPE % (RECORD % ',"ledgerphone":{"type":"String","value":"x","y":1}'): "typed_value_mismatch",
        good.replace('"a","b"', ""): "malformed_json", good.replace(',"a","b"', ""): "profile_mismatch",
    }
    found = reasons(spark, *cases)
    assert [found[i] for i in range(len(cases))] == list(cases.values())
    assert reasons(spark, ENVELOPE % "") == {}


def test_limits(spark):
    record = RECORD % ""
    assert reasons(spark, ENVELOPE % record, bytes=50) == {0: "too_large"}
    assert reasons(spark, ENVELOPE % f"{record},{record}", records=1) == {0: "record_limit_exceeded"}
    # Root, status, data, metadata and its two, collection; of the record 1 + 4 + 3 + 3 + 1 + 1 + 1 + 3 + 2.
    assert reasons(spark, ENVELOPE % record, values=26) == {0: None} and reasons(spark, ENVELOPE % record, values=25) == {0: "resource_limit_exceeded"}
    assert reasons(spark, ENVELOPE % record, depth=8) == {0: None} and reasons(spark, ENVELOPE % record, depth=7) == {0: "resource_limit_exceeded"}


def test_absent_and_empty_cells_differ(spark):
    rows = spark.createDataFrame([(1, ENVELOPE % ",".join(RECORD % "" for _ in range(2)).replace("-1.50", "", 1)), (2, ENVELOPE % '{"metadata":{"type":"Ledger","name":"m","reservedname":"r"}}')], "k long, json string")
    found = sorted(tuple(r) for r in strict.ledgers(rows, "k").fillna("absent", ["parent", "closing", "opening"]).collect())
    assert found == [(1, 1, "n", 'p, {"q": [', "", "absent", 2, None), (1, 2, "n", 'p, {"q": [', "-1.50", "absent", 2, None), (2, 1, "m", "absent", "absent", "absent", 0, None)]
