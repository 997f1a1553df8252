"""Codes of vectors against plain Python over all rows."""

from __future__ import annotations

import hashlib
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftmark.llm import vector_codes as V
from tests.llm.helpers import CLASHES

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, parts=V.PARTS, entries=V.ENTRIES, rounds=V.ROUNDS):
    kept = [(i, [math.floor(256 * x) for x in v], y) for i, v, y in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    w = len(kept[0][1]) // parts
    cut = [[tuple(v[p * w : p * w + w]) for p in range(parts)] for _, v, _ in kept]
    first = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, kept[k][1]))[:entries]
    books = [[cut[k][p] for k in first] for p in range(parts)]

    def best(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, e, strict=True)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            of = [best(c[p], books[p])[1] for c in cut]
            for k in set(of):
                mine = [c[p] for c, o in zip(cut, of, strict=True) if o == k]
                books[p][k] = tuple(sum(x) // len(mine) for x in zip(*mine, strict=True))
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    found = [[best(c[p], books[p]) for p in range(parts)] for c in cut]
    errors = Counter()
    for (_, _, y), f in zip(kept, found, strict=True):
        errors[y] += sum(e for e, _ in f)
    return [(i, "".join(f"{k:02x}" for _, k in f), sum(e for e, _ in f), errors[y], digest) for (i, _, y), f in zip(kept, found, strict=True)]


def got(df):
    return sorted((tuple(r[c] for c in ("vec_id", "code", "error", "label_error", "codebooks_sha256")) for r in df.collect()), key=repr)


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def test_random_vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(int(i), rng.normal(0, 0.1, 32).round(2).tolist(), int(rng.integers(0, 3))) for i in rng.permutation(200)]
    assert got(V.compress(table(spark, rows))) == sorted(brute(rows), key=repr)


def test_nulls_ties_repeats_hot_vectors_and_clashing_columns(spark):
    nan, inf = float("nan"), float("inf")
    hot = [0.5, -0.001] * 16
    rows = [(1, None, 1), (2, [], 1), (3, [None] * 32, 1), (4, [nan] + [0.0] * 31, None), (5, [0.0] * 31 + [inf], 2), (None, [0.25] * 32, None), (6, [-0.0] * 32, None), (7, [1e-9] * 32, 1)]
    rows += [(8, hot, 1)] * 3 + [(9 + i, hot, None if i % 2 else 5) for i in range(60)] + [(100 + i, [i / 256 - 0.1] * 32, i % 4) for i in range(80)]
    rows += [(7, [0.3] * 32, 1), (None, [0.1] * 32, 9)]
    df = table(spark, rows).withColumns({c: F.lit(f"own {c}") for c in [*CLASHES, "v", "row", "pos", "part", "code", "error", "of", "weight"]})
    assert got(V.compress(df)) == sorted(brute(rows), key=repr)


def test_few_rows_and_none(spark):
    rows = [(5, [0.1 * i for i in range(16)], 1), (3, [-0.1 * i for i in range(16)], None)]
    assert got(V.compress(table(spark, rows))) == sorted(brute(rows), key=repr)
    assert got(V.compress(table(spark, rows[:1]))) == sorted(brute(rows[:1]), key=repr)
    assert V.compress(table(spark, [])).collect() == []
    assert V.compress(table(spark, [(1, None, 1)])).collect() == []


def test_other_parameters(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(0, 1, 12).tolist(), 0) for i in range(50)]
    assert got(V.compress(table(spark, rows), parts=3, entries=7, rounds=4)) == sorted(brute(rows, 3, 7, 4), key=repr)


def test_lengths_that_do_not_fit_are_an_error(spark):
    for rows in ([(1, [0.0] * 16, 1), (2, [0.0] * 32, 1)], [(1, [0.0] * 15, 1)], [(1, [1e30] * 16, 1)]):
        with pytest.raises(ValueError):
            V.compress(table(spark, rows))


def test_nearest_in_steps(monkeypatch):
    rng = np.random.default_rng(3)
    rows, book = rng.integers(-9, 9, (101, 4)), rng.integers(-9, 9, (16, 4))
    want = V.nearest(rows, book)
    monkeypatch.setattr(V, "STEP", 100)
    assert all((a == b).all() for a, b in zip(V.nearest(rows, book), want, strict=True))


def test_parts_that_are_equal_are_assigned_once(spark):
    """The rounds see a row for each distinct part, however often it occurs."""
    rows = [(i, [0.25, 0.5] * 16, 1) for i in range(500)]
    seen = []
    real = V.lloyd_round

    def counted(distinct, books):
        seen.append((distinct.count(), distinct.agg(F.sum("weight")).first()[0]))
        return real(distinct, books)

    V.lloyd_round = counted
    try:
        V.compress(table(spark, rows)).collect()
    finally:
        V.lloyd_round = real
    assert seen == [(16, 16 * 500)] * 2
