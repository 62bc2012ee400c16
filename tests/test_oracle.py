"""Every registered query with SQL gives the same rows on Spark and on DuckDB."""

import pytest

from __spark_entry__ import entry
from folioflow.plans.registry import all_queries
from tests.oracle import connect, difference

SMALL = "/root/testdata/sf0.001"
BUILDS = {name: q.build for name, q in all_queries().items()}
ORACLES = {name: q.sql for name, q in all_queries().items() if q.sql}


@pytest.fixture(scope="module")
def db():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, db, name):
    assert difference(BUILDS[name](spark, SMALL), db, ORACLES[name]) is None


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(BUILDS)
    assert set(BUILDS) - set(ORACLES) == {"recommend", "fit_logistic"}


def test_entry_returns_rows(spark):
    found = entry(spark)
    assert found.columns == ["id", "title", "updated", "score", "show"]
    shown = [r["show"] for r in found.collect()]
    assert shown and sum(shown) == max(1, int(len(shown) * 0.05))
