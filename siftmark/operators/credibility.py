"""Credibility of knowledge: features, the calibrated classifier, and comparison of posteriors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftmark.config import CATEGORIES
from siftmark.functions import scores as S
from siftmark.functions.text import word_count
from siftmark.operators.selection import quantiles
from siftmark.sources.scratch import stored

#: The features in order.
FEATURES = (
    *[f"lexicon_match_{c}" for c in CATEGORIES], "total_matches", "match_ratio", *[f"has_{c}_match" for c in CATEGORIES],
    *[f"subtype_match_{c}" for c in CATEGORIES], "subtype_match_score", "match_density", "match_span_ratio",
    *[f"max_match_category_{c}" for c in CATEGORIES], *[f"source_confidence_{c}" for c in CATEGORIES], "weighted_source_confidence",
)


def with_features(rows: DataFrame, text: str = "text", labels: str = "subtype_label") -> DataFrame:
    """Rows that have match counts with the 21 features; missing ids get a name by position, ``label`` follows coarse_label."""
    n = {c: F.col(f"n_{c}") for c in CATEGORIES}
    return rows.withColumns(S.features(n, word_count(F.col(text)), F.length(text), F.col(labels)))


def train(rows: DataFrame, label: str = "label", max_iter: int = 1000):
    """A logistic regression (L2, C = 1) with a second one on its probability, as a pipeline.

    The weight of the penalty is 1/n, as losses are averaged here.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler, VectorSlicer

    n = max(1, rows.count())
    options = {"labelCol": label, "maxIter": max_iter, "regParam": 1.0 / n, "elasticNetParam": 0.0, "standardization": False}
    first = LogisticRegression(featuresCol="__x", probabilityCol="__p1", rawPredictionCol="__r1", predictionCol="__y1", **options)
    take = VectorSlicer(inputCol="__p1", outputCol="__x2", indices=[1])
    second = LogisticRegression(featuresCol="__x2", probabilityCol="__p2", rawPredictionCol="__r2", predictionCol="__y2", **options)
    stages = [VectorAssembler(inputCols=list(FEATURES), outputCol="__x"), first, take, second]
    return Pipeline(stages=stages).fit(rows.na.fill(0.0, list(FEATURES)))


def predict(model, rows: DataFrame, mapping: str = "tanh") -> DataFrame:
    """``rows`` with calibrated probability, prediction (>= 0.5) and confidence."""
    from pyspark.ml.functions import vector_to_array

    out = model.transform(rows.na.fill(0.0, list(FEATURES))).withColumn("probability", vector_to_array("__p2")[1])
    out = out.withColumns({"prediction": (F.col("probability") >= 0.5).cast("int"), "confidence": S.confidence(F.col("probability"), mapping)})
    return out.drop("__x", "__p1", "__r1", "__y1", "__x2", "__p2", "__r2", "__y2")


def confidence_stats(rows: DataFrame, p: str = "p", confidence: str = "confidence") -> DataFrame:
    """One row: mean, population deviation, least and most of the confidence, and the mean probability."""
    c = F.col(confidence)
    return rows.agg(F.avg(c).alias("mean"), F.stddev_pop(c).alias("std"), F.min(c).alias("min"), F.max(c).alias("max"), F.avg(p).alias("avg_p"))


def distribution(rows: DataFrame, columns: dict[str, tuple[float, ...]]) -> DataFrame:
    """name, mean, median, std, min, max and the shares above thresholds (the last one: below) for several columns.

    Columns become rows of (name, value), written once; the medians are exact and of any number of values.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("x")) for c in columns])).alias("p")
    x = stored(rows.select(pairs).select("p.*"), "columns")
    limits = [F.create_map(*[z for c, t in columns.items() for z in (F.lit(c), F.lit(float(t[k])))])[F.col("name")] for k in range(3)]
    v, (hi, mid, lo) = F.col("x"), limits
    out = x.groupBy("name").agg(
        F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"),
        F.avg((v > hi).cast("double")).alias("share_high"), F.avg((v > mid).cast("double")).alias("share_mid"), F.avg((v < lo).cast("double")).alias("share_low"),
    )
    middle = quantiles(x, "x", ["name"]).select(F.col("name").alias("__n"), F.col("quantile").alias("median"))
    out = out.join(F.broadcast(middle), F.col("name") == F.col("__n"), "left")  # a row for each column
    return out.select("name", "mean", "median", "std", "min", "max", "share_high", "share_mid", "share_low")


def slice_means(rows: DataFrame, u: str, columns: list[str]) -> DataFrame:
    """Counts and means by low (< 0.1), medium (< 0.3) and high uncertainty."""
    s = F.when(F.col(u) < 0.1, "low").when(F.col(u) < 0.3, "medium").otherwise("high")
    return rows.groupBy(s.alias("slice")).agg(F.count("*").alias("n"), *[F.avg(c).alias(f"avg_{c}") for c in columns])


def accuracies(rows: DataFrame, predictors: dict[str, Column], confidence: str, y: str = "coarse_label") -> DataFrame:
    """Accuracy of several predictors and the mean confidence on rows that each has right and wrong: a row per predictor."""
    options = F.array(*[F.struct(F.lit(k).alias("predictor"), v.cast("int").alias("pred")) for k, v in predictors.items()])
    x = rows.filter(F.col(y).isNotNull()).select(y, confidence, F.explode(options).alias("o")).select(y, confidence, "o.*")
    right = F.col("pred") == F.col(y)
    c = F.col(confidence)
    return x.groupBy("predictor").agg(
        F.avg(right.cast("double")).alias("accuracy"), F.avg(F.when(right, c)).alias("conf_right"), F.avg(F.when(~right, c)).alias("conf_wrong")
    )


def extremes(rows: DataFrame, diff: str, least: float = 0.1, most: int = 10, key: str = "id") -> DataFrame:
    """The top rows of either direction by size of a difference: direction and all columns."""
    d = F.col(diff)
    up = rows.filter(d > least).orderBy(F.desc(d), key).limit(most).withColumn("direction", F.lit("up"))
    down = rows.filter(d < -least).orderBy(d, key).limit(most).withColumn("direction", F.lit("down"))
    return up.unionByName(down)
