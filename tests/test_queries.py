"""Every registered query against DuckDB, on the smallest tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from tests.compare import connect, difference

# trees and searches have no SQL counterpart; their invariants are tested in test_models.py
ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, sf_dir, con, name):
    assert difference(entry.queries()[name](spark, sf_dir), con, ORACLES[name]) is None


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(entry.queries())


def test_entry_has_rows_per_segment(spark):
    rows = {r["segment"]: r for r in entry.entry(spark).collect()}
    assert set(rows) == {"F", "O", "all"}
    assert rows["all"]["rows"] == rows["F"]["rows"] + rows["O"]["rows"]
