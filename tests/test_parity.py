"""Every registered query against its SQL in DuckDB, on whole tables."""

import pytest

import __spark_entry__ as driver
from workload.queries import QUERIES
from tests.parity import connect, rows_of_duck, rows_of_spark

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows(spark, duck, name):
    frame = driver.queries()[name](spark, SF_DIR)
    ours = rows_of_spark(frame)
    assert ours, "a query without rows proves nothing"
    assert ours == rows_of_duck(duck, driver.oracle_sql()[name], frame.columns)


def test_every_query_has_an_oracle():
    assert set(QUERIES) <= set(driver.oracle_sql())


def test_entry_has_rows(spark):
    frame = driver.entry(spark)
    assert frame.columns == ["date", "sales", "wages"]
    assert frame.count() > 0
