"""Registered queries against their SQL, and that all are there."""

import pytest

import __spark_entry__ as driver
from tallyhouse.llm.oracles import ORACLES
from tests.parity import connect, rows_of_duck, rows_of_spark

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, name):
    frame = driver.queries()[name](spark, SF_DIR)
    ours = rows_of_spark(frame)
    assert ours
    assert ours == rows_of_duck(connect(SF_DIR), driver.oracle_sql()[name], frame.columns)


def test_every_operator_is_registered():
    found = [n for n in driver.queries() if n == "pipeline" or n.startswith("op")]
    assert sorted(n.split("_")[0] for n in found) == sorted(["pipeline", *(f"op{i}" for i in range(1, 14))])
