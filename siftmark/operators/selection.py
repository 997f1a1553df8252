"""Exact quantiles of any number of values: ranges are counted, and only the range that holds the rank is refined.

Each round takes mergeable quantile sketches for cuts, counts exactly what lies below and inside the range between two of
them, and goes on with the rows inside. What is sorted in one place in the end is the few values of the last range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftmark.sources.scratch import stored

#: Cuts of a round and the accuracy of their sketch: a cut's rank is off by a quarter of the distance of cuts at most.
CUTS, ACCURACY = 200, 800
#: Rows of a group that are no longer refined.
LEFT = 200_000


def _same(a: DataFrame, by: list[str]) -> tuple[DataFrame, Column]:
    """``a`` with its group columns renamed, and the condition that they equal those of another frame."""
    out, on = a, F.lit(True)
    for c in by:
        out = out.withColumnRenamed(c, f"__of_{c}")
        on = on & F.col(c).eqNullSafe(F.col(f"__of_{c}"))
    return out, on


def _joined(x: DataFrame, state: DataFrame, by: list[str], few: bool) -> DataFrame:
    other, on = _same(state, by)
    return x.join(F.broadcast(other) if few else other, on).drop(*[f"__of_{c}" for c in by])


def quantiles(rows: DataFrame, value: str, by: list[str] | None = None, q: float = 0.5, left: int = LEFT, few_groups: int = 100_000) -> DataFrame:
    """``by`` and ``quantile``: the exact value at ``q`` (between the two around it in proportion) of each group's values.

    Nulls don't count; a group without values isn't there (without ``by`` there is one row, of null then). Values are written
    once, narrow, and read by each round; groups are broadcast up to ``few_groups``. A round leaves about four in ``CUTS`` of
    the distinct values of a group, and there is none where all groups are small.
    """
    by = by or []
    x = stored(rows.select(*by, F.col(value).cast("double").alias("__v")).filter(F.col("__v").isNotNull()), "values")
    n, v = F.col("__n"), F.col("__v")
    state = stored(x.groupBy(*by).agg(F.count(F.lit(1)).alias("__n")), "groups")
    few = state.count() <= few_groups
    at = (n - 1) * F.lit(q)
    low = F.floor(at)
    # ranks of the two values around the place, counted inside the rows that are left, and the share of the upper one
    state = state.select(*by, "__n", low.alias("__r1"), F.ceil(at).alias("__r2"), (at - low).alias("__share"))
    while state.agg(F.max("__n")).first()[0] is not None and state.agg(F.max("__n")).first()[0] > left:
        cuts = x.groupBy(*by).agg(F.percentile_approx("__v", [k / CUTS for k in range(CUTS + 1)], ACCURACY).alias("__cuts"), F.min("__v").alias("__min"), F.max("__v").alias("__max"))
        first, last = F.floor(F.col("__r1") * CUTS / n).cast("int") - 1, F.ceil((F.col("__r2") + 1) * CUTS / n).cast("int") + 1
        cell = F.col("__cuts")
        s = _joined(cuts, state, by, few).select(
            *by, "__n", "__r1", "__r2", "__share",
            F.when(first <= 0, F.col("__min")).otherwise(F.get(cell, first)).alias("__lo"), F.when(last >= CUTS, F.col("__max")).otherwise(F.get(cell, last)).alias("__hi"),
        )
        s = stored(s, "ranges")
        y = _joined(x, s, by, few)
        inside = y.groupBy(*by).agg(F.count_if(v < F.col("__lo")).alias("__below"), F.count_if(v.between(F.col("__lo"), F.col("__hi"))).alias("__in"))
        s = _joined(inside, s, by, few)
        # counts decide: were a range off, all rows of the group would stay
        held = (F.col("__below") <= F.col("__r1")) & (F.col("__r2") < F.col("__below") + F.col("__in"))
        minus = F.when(held, F.col("__below")).otherwise(0)
        s = stored(
            s.select(
                *by, F.when(held, F.col("__in")).otherwise(n).alias("__n"), (F.col("__r1") - minus).alias("__r1"), (F.col("__r2") - minus).alias("__r2"), "__share",
                F.when(held, F.col("__lo")).alias("__lo"), F.when(held, F.col("__hi")).alias("__hi"),
            ),
            "ranges",
        )
        before = state.agg(F.sum("__n")).first()[0]
        y = _joined(x, s.select(*by, "__lo", "__hi"), by, few)
        x = y.filter(F.col("__lo").isNull() | v.between(F.col("__lo"), F.col("__hi"))).drop("__lo", "__hi")
        state = s.drop("__lo", "__hi")
        if state.agg(F.sum("__n")).first()[0] == before:  # equal values alone are left
            break
    counted = x.groupBy(*by, "__v").agg(F.count(F.lit(1)).alias("__k"))
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    below = F.coalesce(F.sum("__k").over(w.orderBy("__v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = _joined(counted.withColumn("__below", below), state, by, few)

    def value_at(rank: str) -> Column:
        r = F.col(rank)
        return F.max(F.when((F.col("__below") <= r) & (r < F.col("__below") + F.col("__k")), v))

    found = placed.groupBy(*by).agg(value_at("__r1").alias("__a"), value_at("__r2").alias("__b"), F.first("__share").alias("__share"))
    return found.select(*by, ((1 - F.col("__share")) * F.col("__a") + F.col("__share") * F.col("__b")).alias("quantile"))
