"""Every registered query against its SQL."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import oracle

from framequarry.plans.queries import ORACLES, QUERIES

pytestmark = pytest.mark.skipif(not os.path.isdir(oracle.SF), reason="no test tables here")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, name):
    oracle.compare(spark, QUERIES[name], ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, oracle.SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
