"""Classification metrics as aggregate expressions, for any groupBy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPS = 2.220446049250313e-16


def confusion(y: Column, pred: Column) -> dict[str, Column]:
    """tp, fp, fn, tn; rows without label or prediction don't count."""
    return {
        "tp": F.count_if((y == 1) & (pred == 1)), "fp": F.count_if((y == 0) & (pred == 1)),
        "fn": F.count_if((y == 1) & (pred == 0)), "tn": F.count_if((y == 0) & (pred == 0)),
    }


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.coalesce(a / F.when(b != 0, b), F.lit(0.0))


def binary(y: Column, pred: Column) -> dict[str, Column]:
    """n, accuracy, precision, recall and f1 of class 1, with the confusion counts."""
    c = confusion(y, pred)
    tp, fp, fn, tn = c["tp"], c["fp"], c["fn"], c["tn"]
    return {
        "n": tp + fp + fn + tn, "accuracy": ratio(tp + tn, tp + fp + fn + tn), "precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn),
        "f1": ratio(2 * tp, 2 * tp + fp + fn), **c,
    }


def nll(y: Column, p1: Column) -> Column:
    """Mean negative log of the true class's probability, clipped away from 0 and 1."""
    p = F.when(y == 1, p1).when(y == 0, 1 - p1)
    return F.avg(-F.log(F.greatest(F.least(p, F.lit(1 - EPS)), F.lit(EPS))))


def brier(y: Column, p1: Column) -> Column:
    return F.avg((p1 - y) * (p1 - y))


def named(columns: dict[str, Column], digits: int | None = None) -> list[Column]:
    """The expressions under their names, doubles rounded."""
    whole = {"n", "tp", "fp", "fn", "tn", "support"}
    return [(c if digits is None or k in whole else F.round(c, digits)).alias(k) for k, c in columns.items()]


def per_class(rows: DataFrame, y: str, pred: str) -> DataFrame:
    """class, precision, recall, f1, support for classes 0 and 1."""
    c = rows.agg(*[x.alias(k) for k, x in confusion(F.col(y), F.col(pred)).items()])

    def of(cls: int, tp: str, fp: str, fn: str) -> Column:
        t, p, n = F.col(tp), F.col(fp), F.col(fn)
        return F.struct(F.lit(cls).alias("class"), ratio(t, t + p).alias("precision"), ratio(t, t + n).alias("recall"), ratio(2 * t, 2 * t + p + n).alias("f1"), (t + n).alias("support"))

    return c.select(F.inline(F.array(of(0, "tn", "fn", "fp"), of(1, "tp", "fp", "fn"))))


def auc(rows: DataFrame, y: str, score: str) -> DataFrame:
    """One row: area under the ROC curve by rank sums, ties at their mean; 0 if a class is missing.

    Scores are first counted by value, so what is ranked has a row per distinct score; positives
    below a value come from sums over ranges of values, never from one partition of all rows.
    """
    by = rows.filter(F.col(y).isin(0, 1)).groupBy(F.col(score).alias("s")).agg(F.count_if(F.col(y) == 1).alias("pos"), F.count_if(F.col(y) == 0).alias("neg"))
    part = F.floor(F.col("s") * 1000)
    by = by.withColumn("r", F.coalesce(part, F.lit(0)))
    ranges = by.groupBy("r").agg(F.sum("neg").alias("n"))
    below = F.coalesce(F.sum("n").over(Window.orderBy("r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = ranges.select(F.col("r").alias("r2"), below.alias("below"))
    inside = F.coalesce(F.sum("neg").over(Window.partitionBy("r").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    won = F.col("pos") * (F.col("below") + F.col("inside") + F.col("neg") / 2)
    x = by.withColumn("inside", inside).join(ranges, F.col("r") == F.col("r2"))
    return x.agg(ratio(F.sum(won), (F.sum("pos") * F.sum("neg")).cast("double")).alias("auc"))
