"""The text operators' queries with SQL, against it."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import oracle

from framequarry.llm.queries import ORACLES, QUERIES

pytestmark = pytest.mark.skipif(not os.path.isdir(oracle.SF), reason="no test tables here")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, name):
    assert oracle.compare(spark, QUERIES[name], ORACLES[name]) > 0


def test_all_are_registered():
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries()) and {f"op{n}" for n in range(1, 14)} == {q.split("_")[0] for q in QUERIES if q != "pipeline"}
