"""Every registered query against its SQL on the small test tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
import oracle
from tests.compare import differences, duck
from tests.conftest import DATA


@pytest.fixture(scope="module")
def connection():
    return duck(DATA)


# The text-preparation queries have tests of their own.
NAMES = list(oracle.queries())


def test_every_query_has_its_sql():
    assert set(NAMES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    others = set(entry.queries()) - set(NAMES)
    assert all(n.startswith("op") or n == "pipeline" for n in others)


def test_entry_returns_the_loss_report(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 10 and all(r.profit < 0 for r in rows)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, connection, name):
    problem = differences(
        entry.queries()[name](spark, DATA), connection, entry.oracle_sql()[name]
    )
    assert problem is None, problem


@pytest.mark.parametrize("name", NAMES)
def test_plan_stays_in_the_engine(spark, name):
    """No Python rows, no pairing of everything with everything."""
    plan = entry.queries()[name](spark, DATA)._jdf.queryExecution().toString()
    for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"):
        assert word not in plan
