"""Every registered query against its SQL statement in DuckDB."""

import pytest

from harness.catalogue import registered
from harness.check import compare, connect
from harness.oracle import statements

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_every_query_has_a_statement():
    assert set(registered()) == set(statements())


@pytest.mark.parametrize("name", list(registered()))
def test_query(spark, con, name):
    verdict, n = compare(spark, con, SF_DIR, name, registered()[name], statements()[name])
    assert verdict == "ok" and n > 0


def test_entry(spark):
    from __spark_entry__ import entry

    assert entry(spark).count() > 0
