"""Every query with an SQL twin gives the same rows as DuckDB on the smallest tables."""

from __future__ import annotations

import os

import pytest

import tools_oracle
from oddrank import queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    return tools_oracle.duck(SF)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_equal(spark, duck, name):
    said = tools_oracle.compare(spark, duck, SF, name)
    assert said.startswith("equal"), said
