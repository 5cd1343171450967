"""Every registered query against its SQL in a second engine; no plan may hold Python code or a product of tables."""

import pytest

import __spark_entry__ as entry
from breachlens.catalog.queries import ORACLES, QUERIES

from . import parity

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return parity.duck(FOLDER)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, FOLDER)
    found, problem = parity.compare_frame(duck, df, ORACLES.get(name))
    assert problem is None
    plan = df._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    for word in ("Python", "Pandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert word not in plan
    assert found > 0 or name == "leak_by_reporter"


def test_every_query_has_sql():
    assert set(ORACLES) == set(QUERIES)


def test_entry_is_the_flagship(spark):
    assert entry.entry(spark).count() == 34
