"""Tokenised batches against plain Python."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest

from siftmark.operators import dataset


class Words:
    def ids(self, texts):
        return [[len(w) for w in t.split()] for t in texts]


@pytest.mark.parametrize("deal_rows", [100_000, 40])
def test_batches(spark, deal_rows):
    rnd = random.Random(1)
    texts = [" ".join("x" * rnd.randint(1, 9) for _ in range(rnd.choice([0, 1, 5, 30, 31, 200, 700]))) for _ in range(500)]
    rows = [(i, t, rnd.choice([0, 1])) for i, t in enumerate(texts)] + [(900, None, 1), (901, "no label", None), (3, texts[3], 1)]
    df = spark.createDataFrame(rows, "id long, text string, coarse_label int").repartition(3)
    out = dataset.padded(dataset.tokenised(df, Words(), label="coarse_label"), "id", deal_rows=deal_rows)
    got, batches = defaultdict(list), defaultdict(list)
    for r in out.collect():
        got[r["id"]].append((r["coarse_label"], [i for i, m in zip(r["input_ids"], r["mask"], strict=True) if m]))
        batches[r["width"], r["deal"], r["batch"]].append(r["place"])
        assert len(r["input_ids"]) == len(r["mask"]) == r["width"] in dataset.ladder()
        assert r["mask"] == sorted(r["mask"], reverse=True) and sum(r["mask"]) == r["n_tokens"] and not any(r["input_ids"][r["n_tokens"] :])
    want = defaultdict(list)
    for i, t, y in rows:
        if t is not None and y is not None:
            want[i].append((y, Words().ids([t])[0][:512]))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    for (w, deal, b), places in batches.items():
        assert sorted(places) == list(range(len(places))) and len(places) <= 16
        assert len(places) == 16 or (w, deal, b + 1) not in batches
    p = dataset.padding(out).first()
    empty = sum(not ids for v in want.values() for _, ids in v)
    assert p["rows"] == sum(map(len, want.values())) and p["tokens"] == sum(len(ids) for v in want.values() for _, ids in v)
    assert p["cells"] - empty <= 1.05 * p["tokens"] and p["batches"] == len(batches)


def test_ladder_bounds_padding():
    for most in (1, 7, 512, 4096):
        steps = dataset.ladder(most)
        assert steps[-1] == most and all(a < b for a, b in zip(steps, steps[1:], strict=False))
        for n in range(1, most + 1):
            assert min(w for w in steps if w >= n) <= max(n, n * 1.05)
    assert dataset.CodePoints(5).ids(["abcdef", ""]) == [[1, 100, 101, 102, 2], [1, 2]]


def test_no_rows(spark):
    df = spark.createDataFrame([], "id long, text string")
    assert dataset.padded(dataset.tokenised(df, Words()), "id").collect() == []
