"""Every query against its SQL."""

from __future__ import annotations

import pytest
from tests.conftest import rows_of, rows_of_sql

from siftmark.plans.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, duck, small, name):
    df = QUERIES[name](spark, small)
    names, want = rows_of_sql(duck, ORACLES[name])
    assert sorted(df.columns) == names
    got = rows_of(df)
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert a == pytest.approx(b, abs=2e-6, nan_ok=True) if all(isinstance(x, float) for x in a) else a == b


def test_classifier_separates(spark, small):
    out = QUERIES["pkri_train"](spark, small).toPandas()
    assert len(out) and out.probability.between(0, 1).all() and out.confidence.between(0, 1).all()


def test_entry_runs(spark, small):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() >= 0
