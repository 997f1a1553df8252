"""Queries that SQL can express, against it."""

from __future__ import annotations

import pytest
from tests.conftest import rows_of, rows_of_sql

from siftmark.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, duck, small, name):
    df = QUERIES[name](spark, small)
    names, want = rows_of_sql(duck, ORACLES[name])
    assert sorted(df.columns) == names
    assert rows_of(df) == want


def test_all_are_there():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
