"""Every registered query against its SQL on the smallest tables."""

import os

import pytest

from hubmetrics.queries import ORACLES, QUERIES
from oracle import connect, differences

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_agrees_with_sql(spark, con, name):
    problem, rows = differences(spark, con, SF_DIR, QUERIES[name], ORACLES.get(name))
    assert problem == ""


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
