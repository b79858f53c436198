"""Every registered query against its SQL on the smallest driver tables."""

import oracle
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_each_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, con, name):
    fn, sql = entry.queries()[name], entry.oracle_sql().get(name)
    if sql is None:
        assert fn(spark, SF).count() > 0
        return
    assert not oracle.compare(spark, con, SF, fn, sql)
