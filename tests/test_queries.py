"""Every named query runs; those with SQL give DuckDB's rows."""

import __spark_entry__
import pytest
from parity import compare, connect

from provena.plans import registry

registry.load()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_rows_as_sql(spark, sf, con, name):
    compare(registry.QUERIES[name](spark, sf), con, registry.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_runs_twice_alike(spark, sf, name):
    first = sorted(map(str, registry.QUERIES[name](spark, sf).collect()))
    assert first
    assert first == sorted(map(str, registry.QUERIES[name](spark, sf).collect()))


def test_entry(spark):
    assert __spark_entry__.entry(spark).limit(1).count() == 1


def test_names_are_registered():
    assert set(registry.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
