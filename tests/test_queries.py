import pytest

import tallyroom.plans.more_queries  # noqa: F401
from tallyroom.plans.queries import ORACLE_SQL, QUERIES
from tests.compare import compare, connect


@pytest.fixture(scope="module")
def sf():
    return "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, sf, name):
    if name in ORACLE_SQL:
        assert compare(spark, con, QUERIES[name], ORACLE_SQL[name], sf) > 0
    else:
        assert QUERIES[name](spark, sf).count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_plan(spark, sf, name):
    """No Cartesian product and no Python in the plan."""
    plan = QUERIES[name](spark, sf)._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("CartesianProduct", "PythonUDF", "ArrowEvalPython", "MapInArrow", "MapInPandas"))
