"""Disagreements between a model and a teacher, and confident errors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def disagreements(pred: DataFrame, teacher: DataFrame, high: float = 0.8, key: str = "id") -> DataFrame:
    """Rows with at least one disagreement, typed in an array; rows without a teacher label are left out.

    ``teacher`` has key and teacher_label. Types: baseline_wrong_teacher_correct, high_conf_error, prediction_mismatch.
    """
    t = teacher.filter(F.col("teacher_label").isNotNull()).select(F.col(key).alias("__k"), "teacher_label")
    x = pred.join(t, F.col(key) == F.col("__k")).drop("__k")
    y, p, g = F.col("coarse_label"), F.col("pred_label"), F.col("teacher_label")
    kinds = F.array_compact(
        F.array(
            F.when((p != y) & (g == y), "baseline_wrong_teacher_correct"),
            F.when((F.col("pred_prob") >= high) & (p != y), "high_conf_error"),
            F.when(p != g, "prediction_mismatch"),
        )
    )
    return x.withColumn("disagreement_type", kinds).filter(F.size("disagreement_type") > 0)


def hard_set(found: DataFrame, most: int = 2000, key: str = "id") -> DataFrame:
    """The most confident disagreements, ties by id downwards."""
    return found.orderBy(F.desc("pred_prob"), F.desc(key)).limit(most)


def high_confidence_errors(pred: DataFrame, threshold: float = 0.8, key: str = "id") -> DataFrame:
    """Wrong predictions of at least a probability, most confident first."""
    return pred.filter((F.col("pred_prob") >= threshold) & (F.col("pred_label") != F.col("coarse_label"))).orderBy(F.desc("pred_prob"), key)
