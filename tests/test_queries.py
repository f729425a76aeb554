"""Every registered query runs on the smallest tables, and equals its SQL where there is one."""

from pathlib import Path

import compare
import pytest

import __spark_entry__ as entry

D = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(D).exists(), reason="no test tables here")


@pytest.fixture(scope="module")
def con():
    return compare.connection(D)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, name):
    ok, n, m, diff = compare.compare(spark, con, D, entry.queries()[name], entry.oracle_sql().get(name))
    assert ok is not False, (n, m, diff)


def test_entry(spark):
    assert entry.entry(spark).columns
