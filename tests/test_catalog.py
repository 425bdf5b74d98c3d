"""Every registered query runs on the smallest tables and equals its SQL."""

from __future__ import annotations

from pathlib import Path

import pytest

import __spark_entry__ as entry
from panel_engine.catalog import load
from tests.check_catalog import difference, oracle_connection

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="needs the driver tables")


@pytest.fixture(scope="module")
def con():
    return oracle_connection(SF)


def test_every_query_has_sql():
    assert set(load()[0]) == set(load()[1])
    assert set(load()[0]) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(load()[0]))
def test_query(spark, con, name):
    assert difference(load()[0][name](spark, SF), con, load()[1][name]) is None


def test_entry(spark):
    assert entry.entry(spark).count() > 0
