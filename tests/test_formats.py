"""Formats of money against their SQL on amounts that lie half way between two texts."""

import duckdb

from foliant.plans.catalog import ORACLE_SQL, QUERIES

from .compare import difference


def test_halves_of_compact_amounts_are_rounded_as_by_sql(spark, tmp_path):
    # Every key's remainder scales the price, so that lakhs and crores end in a half of their second decimal.
    duckdb.sql(f"copy (select 4 * i + j as o_orderkey, case j when 0 then 10050.0 + 100 * i when 1 then 100500.0 + 1000 * i when 2 then 0.11 + i else 10050.0 + 100 * i end as o_totalprice from range(3000) a(i), range(4) b(j)) to '{tmp_path}/orders.parquet' (format parquet)")
    assert difference(QUERIES["inr_format"](spark, str(tmp_path)), ORACLE_SQL["inr_format"], str(tmp_path)) == ""
