"""Every registered query against its SQL on the smallest tables."""

import os

import pytest
from oracle import compare, connect

import __spark_entry__ as entry
from tapewright.plans import catalog, oracles

SF_DIR = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not there")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_every_event_query_has_its_sql():
    assert set(catalog.QUERIES) == set(oracles.ORACLES)
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query(spark, con, name):
    rows, problem = compare(entry.queries()[name](spark, SF_DIR), con, entry.oracle_sql()[name])
    assert not problem, problem
    assert rows > 0 or name in ("stream_discovery", "tick_sample")


def test_entry(spark):
    assert entry.entry(spark).count() == 1989
