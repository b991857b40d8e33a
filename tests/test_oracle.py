"""Every registered query against its SQL over the smallest data folder."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as contract
import check_oracle

SF_DIR = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test data not present")


@pytest.fixture(scope="module")
def duck():
    return check_oracle.connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(contract.queries()))
def test_query_matches_oracle(spark, duck, name):
    ok, message, _ = check_oracle.compare(spark, duck, SF_DIR, name)
    assert ok, message


def test_every_oracle_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_entry_has_rows(spark):
    assert contract.entry(spark).count() > 0
