"""Every registered query of the library against its DuckDB oracle on the smallest tables, or the next where these give no row."""

import compare
import pytest
from conftest import SMALL

from lorekeep.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_equals_oracle(spark, name):
    problem = compare.differences(spark, catalogue.QUERIES, catalogue.ORACLE_SQL, name, SMALL)
    if problem == "no rows":
        problem = compare.differences(spark, catalogue.QUERIES, catalogue.ORACLE_SQL, name, "/root/testdata/sf0.01")
    assert problem == ""


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns
    assert set(entry.oracle_sql()) <= set(entry.queries())
