"""Every query of the analysis operators against its SQL."""

import pytest

import __spark_entry__
from flowfacts.queries import ORACLES, QUERIES

from .compare import differences

SF = "/root/testdata/sf0.001"


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    assert differences(QUERIES[name](spark, SF), SF, ORACLES[name]) == ""


def test_entry(spark):
    found = __spark_entry__.entry(spark)
    assert found.columns == ["path", "line", "rule", "severity", "symbol"] and found.count() > 0
