"""Every query runs on the smallest tables; those with SQL match it."""

from __future__ import annotations

from pathlib import Path

import pytest

import __spark_entry__ as entry_points
from check import compare

DATA = Path("/root/testdata/sf0.001")
NAMES = sorted(entry_points.queries())


def test_sql_names_are_query_names():
    assert set(entry_points.oracle_sql()) <= set(NAMES)


@pytest.mark.skipif(not DATA.exists(), reason="test tables are not here")
@pytest.mark.parametrize("name", NAMES)
def test_query(spark, name):
    problem = compare(spark, name, str(DATA))
    assert problem is None, problem


@pytest.mark.skipif(not DATA.exists(), reason="test tables are not here")
def test_entry(spark):
    assert entry_points.entry(spark).count() > 0
