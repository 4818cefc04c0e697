"""Every query of the reference's own operators against its DuckDB oracle."""

import pytest

from foliant.plans.catalog import ORACLE_SQL, QUERIES

from .compare import SMALL, difference


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_its_oracle(spark, name):
    assert name in ORACLE_SQL
    assert difference(QUERIES[name](spark, SMALL), ORACLE_SQL[name], SMALL) == ""


def test_entry_point(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
