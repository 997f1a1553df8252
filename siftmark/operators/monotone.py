"""Monotone least-squares fits of any number of points.

Neighbours out of order are pooled to blocks with a mean and a weight. Pooling ranges of points first and then the blocks of
neighbouring ranges gives the same fit, so ranges are pooled side by side, and their blocks again in windows that are shifted
by half a window each time, until no two neighbours are out of order. No task sees more than a window.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftmark.operators.cleaning import numbered
from siftmark.sources.scratch import stored

#: Points or blocks that a task pools.
WINDOW = 50_000


def pooled(sums: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first index, sum, weight) of the blocks of an increasing fit, given blocks in order."""
    first, s, w = [], [], []
    for k, (a, b) in enumerate(zip(sums.tolist(), weights.tolist(), strict=True)):
        at = k
        while s and s[-1] * b >= a * w[-1]:  # the mean before isn't smaller
            at, a, b = first.pop(), a + s.pop(), b + w.pop()
        first.append(at)
        s.append(a)
        w.append(b)
    return np.array(first, np.int64), np.array(s, float), np.array(w, float)


def _pool(t: pa.Table) -> pa.Table:
    """Blocks of a window: first and last rank, sum, weight."""
    t = t.sort_by("first")
    sums, weights, last = (t.column(c).to_numpy() for c in ("sum", "weight", "last"))
    first, s, w = pooled(sums, weights)
    ends = np.r_[first[1:], len(sums)] - 1
    return pa.table({"first": t.column("first").to_numpy()[first], "last": last[ends], "sum": s, "weight": w})


BLOCKS = "first long, last long, sum double, weight double"


def blocks(points: DataFrame, window: int = WINDOW) -> DataFrame:
    """(first, last, sum, weight) of the increasing fit of points (rank from 0 without gaps, value)."""
    found = points.select(F.col("rank").alias("first"), F.col("rank").alias("last"), F.col("value").alias("sum"), F.lit(1.0).alias("weight"), F.col("rank").alias("at"))
    shift = 0
    while True:
        dealt = found.withColumn("w", F.floor((F.col("at") + shift) / window))
        found = stored(dealt.select("w", "first", "last", "sum", "weight").groupBy("w").applyInArrow(_pool_kept, f"w long, {BLOCKS}"), "blocks")
        # the ends of windows tell whether neighbours are out of order: a row for each window
        mean = F.col("sum") / F.col("weight")
        ends = found.groupBy("w").agg(F.min_by(mean, "first").alias("a"), F.max_by(mean, "first").alias("b"), F.count(F.lit(1)).alias("n")).orderBy("w").collect()
        if all(p["b"] < q["a"] for p, q in zip(ends, ends[1:], strict=False)):
            return found.drop("w")
        before, n = [], 0
        for r in ends:
            before.append((r["w"], n))
            n += r["n"]
        # blocks are ranked by their place in their window and the blocks of windows before
        spark = found.sparkSession
        offsets = F.broadcast(spark.createDataFrame(before, "__w long, __before long"))  # a row for each window
        place = F.row_number().over(Window.partitionBy("w").orderBy("first")) - 1
        found = found.withColumn("__k", place).join(offsets, F.col("w") == F.col("__w")).select("first", "last", "sum", "weight", (F.col("__before") + F.col("__k")).alias("at"))
        shift = window // 2 - shift


def _pool_kept(t: pa.Table) -> pa.Table:
    out = _pool(t)
    return out.add_column(0, "w", pa.array(np.full(out.num_rows, t.column("w")[0].as_py()), pa.int64()))


def fit(points: DataFrame, u: str, value: str, decreasing: bool = True, window: int = WINDOW) -> DataFrame:
    """u, alpha, fitted of all points in order of ``u`` and, where that is equal, of the value; nulls are left out."""
    sign = -1.0 if decreasing else 1.0
    p = stored(points.select(F.col(u).cast("double").alias("u"), F.col(value).cast("double").alias("alpha")).filter("u IS NOT NULL AND alpha IS NOT NULL"), "points")
    if p.count() <= window:

        def whole(t: pa.Table) -> pa.Table:
            t = t.select(["u", "alpha"]).sort_by([("u", "ascending"), ("alpha", "ascending")])
            y = t.column("alpha").to_numpy() * sign
            first, s, w = pooled(y, np.ones(len(y)))
            return t.append_column("fitted", pa.array(np.repeat(s / w, np.diff(np.r_[first, len(y)])) * sign))

        return p.groupBy(F.lit(0).alias("g")).applyInArrow(whole, "u double, alpha double, fitted double")
    p = stored(numbered(p, ["u", "alpha"], "rank"), "ranked")
    found = blocks(p.select("rank", (F.col("alpha") * sign).alias("value")), window)
    # points and the blocks that reach into their stretch meet by stretch
    cell = F.explode(F.sequence(F.floor(F.col("first") / window), F.floor(F.col("last") / window))).alias("w")
    reach = found.select(cell, "first", (F.col("sum") / F.col("weight") * sign).alias("fitted"))

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        b = b.sort_by("first")
        at = np.searchsorted(b.column("first").to_numpy(), a.column("rank").to_numpy(), "right") - 1
        return pa.table({"u": a.column("u"), "alpha": a.column("alpha"), "fitted": b.column("fitted").to_numpy()[at]})

    stretch = p.withColumn("w", F.floor(F.col("rank") / window))
    return stretch.groupBy("w").cogroup(reach.groupBy("w")).applyInArrow(meet, "u double, alpha double, fitted double")
