"""Every registered query against its SQL, row for row."""

import pytest

import __spark_entry__ as entry
from compare import connect, difference, reference_queries

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", [n for n in reference_queries(entry) if n in entry.oracle_sql()])
def test_query_equals_sql(spark, con, name):
    df = entry.queries()[name](spark, SF_DIR)
    assert difference(df, con, entry.oracle_sql()[name]) is None


def test_no_query_of_the_reference_lacks_sql():
    assert set(reference_queries(entry)) <= set(entry.oracle_sql())


def test_entry_has_a_row_per_day(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 30 and rows == sorted(rows)
