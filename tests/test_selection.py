"""Exact quantiles, monotone fits and numbering, against numpy and plain Python."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftmark.operators import cleaning, credibility, fusion, monotone, selection


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema).repartition(5)


@pytest.mark.parametrize("q", [0.5, 0.25, 1.0])
def test_quantiles_of_groups(spark, q):
    rnd = random.Random(3)
    rows = [(rnd.choice(["a", "b", None]), rnd.choice([rnd.gauss(0, 1), 0.25, 0.25, None, -1e300, rnd.random() * 1e-9])) for _ in range(4000)]
    rows += [("one", 5.0), ("two", 1.0), ("two", 2.0), ("none", None), ("same", 7.0)] + [("same", 7.0)] * 900
    want = {}
    for g in {g for g, v in rows if v is not None}:
        want[g] = np.quantile([v for h, v in rows if h == g and v is not None], q)
    for left in (10**6, 40):  # at once, and with ranges refined again and again
        got = {r["g"]: r["quantile"] for r in selection.quantiles(frame(spark, rows, "g string, v double"), "v", ["g"], q, left).collect()}
        assert got == pytest.approx(want, rel=1e-12)


def test_refinement_without_groups_and_with_many(spark):
    x = spark.range(60_000).select(F.col("id"), (F.pmod(F.col("id") * 7919, F.lit(60_000)) / 7.0).alias("v"))
    assert selection.quantiles(x, "v", left=100).first()["quantile"] == pytest.approx(np.median(np.arange(60_000) / 7.0))
    by = x.withColumn("g", F.col("id") % 50)
    got = {r["g"]: r["quantile"] for r in selection.quantiles(by, "v", ["g"], left=100, few_groups=10).collect()}
    v = {r["g"]: r["m"] for r in by.groupBy("g").agg(F.median("v").alias("m")).collect()}
    assert got == pytest.approx(v)
    assert [tuple(r) for r in selection.quantiles(x.limit(0), "v").collect()] == [(None,)]
    assert selection.quantiles(by.limit(0), "v", ["g"]).collect() == []


def test_what_is_left_of_a_group_is_small(spark, monkeypatch):
    """With distinct values, a round leaves a few hundredths of the rows."""
    left = []
    real = selection.stored

    def seen(df, name):
        out = real(df, name)
        if "__n" in out.columns and "__share" in out.columns and "__lo" in out.columns:
            left.append(out.agg(F.max("__n")).first()[0])
        return out

    monkeypatch.setattr(selection, "stored", seen)
    x = spark.range(40_000).select(F.sqrt("id").alias("v"))
    assert selection.quantiles(x, "v", left=2000).first()["quantile"] == pytest.approx((np.sqrt(19_999) + np.sqrt(20_000)) / 2)
    assert left[-1] <= 40_000 * 0.04


def test_distribution_as_numpy_has_it(spark):
    rng = np.random.default_rng(1)
    rows = [(float(a), float(b)) for a, b in rng.random((501, 2))]
    got = {r["name"]: r for r in credibility.distribution(frame(spark, rows, "a double, b double"), {"a": (0.9, 0.7, 0.3), "b": (0.5, 0.2, 0.1)}).collect()}
    for k, c in enumerate("ab"):
        v = np.array([r[k] for r in rows])
        assert (got[c]["median"], got[c]["std"], got[c]["mean"]) == pytest.approx((np.median(v), v.std(), v.mean()))
    assert got["b"]["share_low"] == pytest.approx(np.mean([r[1] < 0.1 for r in rows]))


def least_squares(y: list[float], decreasing: bool) -> list[float]:
    """The fit by its formula: the largest over starts of the least over ends of means."""
    y = np.array(y) * (-1 if decreasing else 1)
    c = np.r_[0, np.cumsum(y)]
    n = len(y)
    mean = np.full((n, n), np.inf)
    for j in range(n):
        mean[j, j:] = (c[j + 1 :] - c[j]) / np.arange(1, n - j + 1)
    least = np.minimum.accumulate(mean[:, ::-1], axis=1)[:, ::-1]
    return [max(least[: k + 1, k]) * (-1 if decreasing else 1) for k in range(n)]


SHAPES = {
    "random": lambda r, n: [r.random() for _ in range(n)],
    "ties": lambda r, n: [r.choice([0.1, 0.5, 0.5, 0.9]) for _ in range(n)],
    "down": lambda r, n: [1 - k / n for k in range(n)],
    "up": lambda r, n: [k / n for k in range(n)],
    "steps": lambda r, n: [((k * 13) % 40) / 40 + k / n for k in range(n)],
    "valley": lambda r, n: [abs(k - n / 2) / n for k in range(n)],
}


@pytest.mark.parametrize("shape", SHAPES)
@pytest.mark.parametrize("decreasing", [True, False])
def test_windows_give_the_whole_fit(spark, shape, decreasing):
    rnd = random.Random(7)
    y = SHAPES[shape](rnd, 400)
    u = sorted(rnd.choice([k / 400, k // 3 / 300]) for k in range(400))
    rows = sorted(zip(u, y, strict=True))
    want = least_squares([b for _, b in rows], decreasing)
    for window in ((60,) if decreasing else (10_000, 60)):
        got = sorted((r["u"], r["alpha"], r["fitted"]) for r in monotone.fit(frame(spark, rows, "u double, a double"), "u", "a", decreasing, window).collect())
        want_rows = sorted((a, b, f) for (a, b), f in zip(rows, want, strict=True))
        assert np.allclose([g[2] for g in got], [w[2] for w in want_rows], atol=1e-9)


def test_many_points_in_bounded_windows(spark):
    n, window = 200_000, 20_000
    x = spark.range(n).select((F.col("id") / n).alias("u"), (F.col("id") / n + F.rand(5) * 0.2).alias("a"))
    got = monotone.fit(x, "u", "a", False, window)
    rows = got.orderBy("u").toPandas()
    first, s, w = monotone.pooled(rows.alpha.to_numpy(), np.ones(n))
    assert np.allclose(rows.fitted, np.repeat(s / w, np.diff(np.r_[first, n])))
    assert (np.diff(rows.fitted) >= -1e-12).all()


def test_table_of_many_points(spark):
    rnd = random.Random(2)
    rows = [(rnd.random(), 0.0) for _ in range(3000)]
    rows = [(u, 1 - u * u) for u, _ in rows]
    fitted = frame(spark, rows, "u double, fitted double")
    got = fusion.lut(fitted, 50).orderBy("pos").collect()
    u = np.array(sorted(a for a, _ in rows))
    assert [r["alpha"] for r in got] == pytest.approx(np.interp([r["u"] for r in got], u, 1 - u * u))


def test_numbering_needs_no_kept_rows(spark, monkeypatch):
    monkeypatch.setattr(cleaning, "BOUNDS_FROM", 300)
    n = 30_000
    rows = spark.range(0, n, 1, 7).select(F.md5(F.col("id").cast("string")).alias("path"))
    want = {p: f"s{k + 5}" for k, p in enumerate(sorted(r["path"] for r in rows.collect()))}
    out = cleaning.assign_ids(rows, "path", 5)
    for _ in range(2):
        assert {r["path"]: r["id"] for r in out.collect()} == want
        spark.catalog.clearCache()
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == 0
    assert "InMemory" not in out._jdf.queryExecution().executedPlan().toString()
