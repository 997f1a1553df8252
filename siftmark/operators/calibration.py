"""Buckets of uncertainty and of probability, and calibration errors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftmark.functions.scores import bucket, edges
from siftmark.operators.selection import quantiles


def _bounds(n: int):
    e = F.array(*[F.lit(x) for x in [0.0, *edges(n), 1.0]])
    return e[F.col("bucket_id")], e[F.col("bucket_id") + 1]


def uncertainty_buckets(rows: DataFrame, n: int = 10, y: str = "coarse_label", pred: str = "pred_label", u: str = "uncertainty", conf: str = "pred_prob", median: bool = True) -> DataFrame:
    """Equal-width buckets of labelled rows: bounds, mean and exact median of u (without ``median`` null), errors and mean confidence; empty ones are left out."""
    rows = rows.filter(F.col(y).isNotNull()).withColumn("bucket_id", bucket(F.col(u), n))
    err = F.count_if(F.col(pred) != F.col(y))
    x = rows.groupBy("bucket_id").agg(F.avg(u).alias("u_mean"), F.count("*").alias("n_samples"), err.alias("n_errors"), F.avg(conf).alias("avg_confidence"))
    if median:
        middle = quantiles(rows, u, ["bucket_id"]).select(F.col("bucket_id").alias("__b"), F.col("quantile").alias("u_median"))
        x = x.join(F.broadcast(middle), F.col("bucket_id") == F.col("__b"), "left")  # a row for each bucket
    else:
        x = x.withColumn("u_median", F.lit(None).cast("double"))
    lo, hi = _bounds(n)
    return x.select("bucket_id", lo.alias("u_min"), hi.alias("u_max"), "u_mean", "u_median", "n_samples", "n_errors", (F.col("n_errors") / F.col("n_samples")).alias("error_rate"), "avg_confidence", F.col("u_mean").alias("avg_uncertainty"))


def auto_buckets(rows: DataFrame, n: int = 10, u: str = "uncertainty") -> DataFrame:
    """Buckets of all rows with u in [0, 1]: bounds, mean, count."""
    x = rows.filter(F.col(u).between(0.0, 1.0)).groupBy(bucket(F.col(u), n).alias("bucket_id")).agg(F.avg(u).alias("u_mean"), F.count("*").alias("n_samples"))
    lo, hi = _bounds(n)
    return x.select("bucket_id", lo.alias("u_min"), hi.alias("u_max"), "u_mean", "n_samples")


def quantile_buckets(rows: DataFrame, n: int = 10, u: str = "uncertainty") -> DataFrame:
    """Buckets of about equal counts, by approximate quantiles: bounds, mean, count."""
    q = rows.stat.approxQuantile(u, [i / n for i in range(1, n)], 1e-4)
    cut = F.size(F.filter(F.array(*[F.lit(x) for x in q]), lambda e: e < F.col(u)))
    return rows.filter(F.col(u).isNotNull()).groupBy(cut.alias("bucket_id")).agg(F.min(u).alias("u_min"), F.max(u).alias("u_max"), F.avg(u).alias("u_mean"), F.count("*").alias("n_samples"))


def calibration_buckets(rows: DataFrame, by: list[str] | None = None, n: int = 10, y: str = "coarse_label", p: str = "p1") -> DataFrame:
    """Buckets of the probability of class 1 with accuracy, confidence, gap and share of the calibration error, for each value of ``by``."""
    by = by or []
    x = rows.filter(F.col(y).isNotNull()).groupBy(*by, bucket(F.col(p), n).alias("bucket_id"))
    x = x.agg(F.avg(p).alias("prob_mean"), F.count("*").alias("n_samples"), F.count_if(F.col(y) == 1).alias("n_correct"))
    # a row per bucket is left, so the totals' window is small
    total = F.sum("n_samples").over(Window.partitionBy(*by))
    acc = F.col("n_correct") / F.col("n_samples")
    gap = F.abs(acc - F.col("prob_mean"))
    lo, hi = _bounds(n)
    return x.select(*by, "bucket_id", lo.alias("prob_min"), hi.alias("prob_max"), "prob_mean", "n_samples", "n_correct", acc.alias("accuracy"), F.col("prob_mean").alias("avg_confidence"), gap.alias("gap"), (F.col("n_samples") / total * gap).alias("ece_contribution"))


def calibration_errors(rows: DataFrame, by: list[str] | None = None, n: int = 10, y: str = "coarse_label", p: str = "p1") -> DataFrame:
    """ece, mce and brier, for each value of ``by``: one pass, partial sums by bucket."""
    by = by or []
    x = rows.filter(F.col(y).isNotNull()).groupBy(*by, bucket(F.col(p), n).alias("bucket_id"))
    x = x.agg(F.sum(p).alias("sp"), F.count("*").alias("k"), F.sum(F.col(y).cast("double")).alias("sy"), F.sum((F.col(p) - F.col(y)) * (F.col(p) - F.col(y))).alias("sq"))
    gap = F.abs(F.col("sy") - F.col("sp"))
    zero = F.lit(0.0)
    k = F.sum("k")
    return x.groupBy(*by).agg(
        F.coalesce(F.sum(gap) / k, zero).alias("ece"), F.coalesce(F.max(gap / F.col("k")), zero).alias("mce"), F.coalesce(F.sum("sq") / k, zero).alias("brier")
    )


def error_correlation(buckets: DataFrame) -> DataFrame:
    """Pearson correlation of mean uncertainty and error rate over bucket rows."""
    return buckets.agg(F.corr("u_mean", "error_rate").alias("correlation"))
