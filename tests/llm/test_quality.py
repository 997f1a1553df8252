"""Quality: word vectors and scores by brute force, gradients, calibration, held-out accuracy."""

from __future__ import annotations

import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftmark.llm import quality as Q
from tests.llm.helpers import AWKWARD, awkward, no_rows

LABELS = "doc_id long, quality int, toxic int"


def brute_table(texts) -> np.ndarray:
    index = Q.index_vectors()
    out = np.zeros((Q.ROWS, Q.DIMS + 1), np.int64)
    for t in texts:
        h = [zlib.crc32(w.encode()) % Q.ROWS for w in Q.WORD.findall(t or "")]
        for i, x in enumerate(h):
            out[x, -1] += 1
            for j in range(max(0, i - Q.REACH), min(len(h), i + Q.REACH + 1)):
                if j != i:
                    out[x, :-1] += index[h[j]]
    return out


def brute_features(table: np.ndarray, text: str) -> np.ndarray:
    n, total = table[:, -1], table[:, -1].sum()
    mean = table[:, :-1].sum(axis=0) / total
    v, w, h = [], [], [zlib.crc32(x.encode()) % Q.ROWS for x in Q.WORD.findall(text)]
    if not h:
        return np.zeros(2 * Q.DIMS + Q.EXTRA)
    for x in h:
        u = table[x, :-1] / max(1, n[x]) - mean if n[x] else np.zeros(Q.DIMS)
        v.append(u / max(1e-9, math.sqrt(u @ u)))
        w.append(Q.COMMON / (Q.COMMON + n[x] / total))
    v, w = np.array(v), np.array(w)
    mean = (v * w[:, None]).sum(axis=0) / w.sum()
    spread = np.sqrt(np.maximum(0, (v * v * w[:, None]).sum(axis=0) / w.sum() - mean**2))
    alike = sum(a @ b for a, b in zip(v, v[1:], strict=False)) / len(h)
    return np.r_[mean, spread, alike, sum(a == b for a, b in zip(h, h[1:], strict=False)) / len(h), math.log1p(len(h))]


def test_word_table_and_features_by_brute_force(spark):
    texts = [r[1] for r in AWKWARD if r[1] != AWKWARD[5][1]] + ["one two, one -- two three", "one", "a b a b a b"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    table = Q.word_table(df)
    assert (table == brute_table(texts)).all()
    words = Q.Words(table)
    for t in texts:
        assert words.features(t or "") == pytest.approx(brute_features(table, t or ""), abs=1e-3)


def test_pieces_and_steps_change_nothing(spark, monkeypatch):
    rnd = random.Random(3)
    texts = [" ".join(rnd.choice(["ab", "c", "d!", "é", "12"]) for _ in range(rnd.randint(0, 90))) for _ in range(40)]
    want = brute_table(texts)
    index = Q.index_vectors()
    for piece, step in ((1 << 18, 1 << 17), (7, 16), (1, 5)):
        monkeypatch.setattr(Q, "PIECE", piece)
        monkeypatch.setattr(Q, "STEP", step)
        out = np.zeros((Q.ROWS + 1, Q.DIMS + 1), np.int64)
        for h, first, behind in Q.stretches(iter(texts)):
            found, n, sums = Q.contexts(h, first, behind, index)
            out[found, :-1] += sums
            out[found, -1] += n
        assert (out[: Q.ROWS] == want).all()


def test_gradient_is_the_losses(monkeypatch):
    rng = np.random.default_rng(1)
    net = Q.Network(5, rng)
    x, y, w = rng.normal(size=(9, 5)), rng.integers(0, 2, 9).astype(float), rng.random(9)

    def loss():
        p = net.score(x)
        return -(w * (y * np.log(p) + (1 - y) * np.log(1 - p))).mean()

    for p, g in zip(net.params, net.gradient(x, y, w), strict=True):
        for at in np.ndindex(p.shape):
            old = p[at]
            p[at] = old + 1e-6
            up = loss()
            p[at] = old - 1e-6
            down = loss()
            p[at] = old
            assert (up - down) / 2e-6 == pytest.approx(g[at], abs=1e-7)


def test_temperature_minimises_the_loss():
    rng = np.random.default_rng(2)
    net = Q.Network(3, rng)
    x = rng.normal(size=(4000, 3))
    true = Q.sigmoid(net.logit(x) / 2.5)
    net.calibrate(x, (rng.random(4000) < true).astype(float), np.ones(4000))
    assert net.temperature == pytest.approx(2.5, rel=0.25)


def test_learns_from_what_it_may_and_tells_held_out_rows(spark):
    rnd = random.Random(1)
    good = ["river", "stone", "light", "walks", "under", "green", "hills", "slowly"]
    rows, labels = [], []
    for i in range(400):
        bad = i % 3 == 0
        text = " ".join([rnd.choice(good)] * 30) + " !!" if bad else " ".join(rnd.choice(good) for _ in range(40)) + "."
        rows.append((i, text))
        held = zlib.crc32(str(i).encode()) % 5 == 0
        labels.append((i, int(bad) if held else 1 - int(bad), 0))  # held-out labels are wrong on purpose
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, LABELS)
    for r in Q.score(docs, Q.train(docs, marks)).collect():
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert r["predicted"] == int(r["doc_id"] % 3 != 0) == int(r["score"] >= Q.THRESHOLD)


def test_awkward_rows_tables_without_labels_and_none(spark):
    df = awkward(spark, clash=True)
    marks = spark.createDataFrame([(1, 1, 0), (7, 0, 0), (8, 0, 0), (9, 1, 1), (None, 1, 0), (10, None, 0), (11, 5, 0)], LABELS)
    for labels in (marks, marks.filter("quality = 1"), marks.limit(0)):
        got = Q.score(df, Q.train(df, labels)).collect()
        assert len(got) == len(AWKWARD) and all(0 <= r["score"] <= 1 for r in got)
        assert len({r["score"] for r in got if r["doc_id"] == 1}) == 1
    assert Q.score(no_rows(spark), Q.train(no_rows(spark), marks)).collect() == []
    extra = marks.withColumn("text", F.lit("own"))
    assert len(Q.score(df, Q.train(df, extra)).collect()) == len(AWKWARD)


def test_held_out_documents(spark):
    d = "/root/testdata/sf0.01"
    from siftmark.llm.queries import QUERIES

    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    held = [(labels[r["doc_id"]], r["predicted"]) for r in QUERIES["op11_quality"](spark, d).collect() if r["held_out"] and r["doc_id"] in labels]
    for kind in (0, 1):
        same = [p == kind for y, p in held if y == kind]
        assert np.mean(same) >= 0.9
