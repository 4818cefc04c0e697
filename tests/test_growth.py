"""Steps whose work or memory grew faster than their tables: what their plans hold once, by capture, or not at all."""

import re

import pytest

from foliant.operators import outstandings
from foliant.plans.catalog import QUERIES
from foliant.sinks import reports
from foliant.sources import shared

from .compare import SMALL


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["entry_ordinals", "recovery_outcome", "scoped_exports"])
def test_tasks_hold_parts_that_do_not_grow(spark, monkeypatch, name):
    monkeypatch.setattr(shared, "PART_ROWS", 50, raising=False)
    seen = []
    write = shared.staged
    monkeypatch.setattr("foliant.plans.exports.shared.staged", lambda df, n: (seen.append(plan(df)), write(df, n))[1])
    text = "".join([*seen, plan(QUERIES[name](spark, SMALL))]) + "".join(seen)
    # 6,000 lines, or 1,500 orders.
    assert re.search(r"RepartitionByExpression \[[^]]*\], (121|31)\b", text)


def test_bills_parse_each_date_once(spark):
    assert plan(QUERIES["native_bill_rows"](spark, SMALL)).count("yyyyMMdd") <= 20


def test_strict_vouchers_walk_a_text_once(spark):
    spark.conf.set("spark.sql.debug.maxToStringFields", "2000")
    text = plan(QUERIES["json_strict_vouchers"](spark, SMALL))
    spark.conf.unset("spark.sql.debug.maxToStringFields")
    assert text.count("schemaOfVariant") <= 40 and text.count("split(") == 1


@pytest.mark.parametrize("name", ["voucher_entries", "witness_rows", "group_rows"])
def test_collections_are_parsed_once(spark, name):
    spark.conf.set("spark.sql.debug.maxToStringFields", "2000")
    text = plan(QUERIES[name](spark, SMALL))
    spark.conf.unset("spark.sql.debug.maxToStringFields")
    assert text.count("from_xml") == 1


def test_captures_are_repaired_once_not_for_each_reference(spark):
    text = plan(QUERIES["repaired_offsets"](spark, SMALL))
    assert not re.search(r"regexp_replace\(xml", text) and not re.search(r"regexp_replace\(concat", text)


def test_large_group_tables_are_not_sent(spark, monkeypatch):
    monkeypatch.setattr(outstandings, "SENT_GROUPS", 0)
    seen = []
    write = outstandings.staged
    monkeypatch.setattr(outstandings, "staged", lambda df, n: (seen.append(df._jdf.queryExecution().executedPlan().toString()), write(df, n))[1])
    rows = [(f"g{i}", f"g{i - 1}" if i else "Primary", "Sundry Debtors" if i == 0 else "") for i in range(6)]
    found = outstandings.group_status(spark.createDataFrame(rows, "name string, parent string, reserved_name string"))
    assert {r["status"] for r in found.collect()} == {"party"} and found.count() == 6
    assert len(seen) > 5 and not any("Broadcast" in p for p in seen)


def test_statements_are_written_by_tasks_and_can_be_written_again(spark, tmp_path):
    lines = spark.createDataFrame([(f"f{i % 3}", i, f"é,{i}") for i in range(9)], "file string, n long, line string")
    one, two = (shared.staged(reports.write_statements(lines, f"file://{tmp_path}/out"), "written") for _ in range(2))
    paths = [r["path"] for df in (one, two) for r in df.collect()]
    assert len(set(paths)) == 6
    for df in (one, two):
        assert {r["file"]: r["value"] for r in reports.read_statements(df).collect()} == {f"f{k}": "".join(f"é,{i}\n" for i in range(k, 9, 3)) for k in range(3)}
    assert reports.write_statements(lines.limit(0), f"file://{tmp_path}/none").count() == 0
