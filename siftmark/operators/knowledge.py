"""The lexicon-based knowledge posterior, its statistics and its parameter search."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftmark.config import CATEGORIES, KnowledgeConfig
from siftmark.functions.scores import knowledge, pair
from siftmark.functions.text import word_count
from siftmark.operators import metrics
from siftmark.operators.matching import Lexicon, matched_words, regex_hits, with_counts

#: The searched grids, in order: (min_matches, base, max, politics weight, abuse weight).
GRIDS = {
    "fast": ((1, 2), (0.1, 0.15), (0.85, 0.9, 0.95), (0.6,), (0.5,)),
    "refined": ((1,), (0.13, 0.14, 0.15, 0.16, 0.17), (0.82, 0.83, 0.85, 0.87, 0.88), (0.6,), (0.5,)),
    "full": ((1, 2), (0.1, 0.15, 0.2, 0.25), (0.8, 0.85, 0.9, 0.95), (0.4, 0.5, 0.6, 0.8), (0.3, 0.4, 0.5, 0.6)),
}


def _n() -> dict[str, Column]:
    return {c: F.col(f"n_{c}") for c in CATEGORIES}


def with_q0(docs: DataFrame, lexicon: Lexicon, config: KnowledgeConfig = KnowledgeConfig(), rules: list[tuple[str, str]] | None = None, details: bool = False, text: str = "text") -> DataFrame:
    """``docs`` with q0 ([1 - p, p]) and the match counts it comes from; rows with empty text are left out.

    ``details`` adds a struct of the matched words, the total and the score.
    """
    rows = with_counts(docs.filter(F.length(text) > 0), lexicon, text)
    hits = regex_hits(F.col(text), rules or []) if config.use_regex else F.array().cast("array<string>")
    rows = rows.withColumns({"regex_matches": hits, "words": word_count(F.col(text))})
    p, total, score = knowledge(_n(), F.size("regex_matches"), F.col("words"), config)
    out = rows.withColumns({"q0": pair(p), "total_matches": total.cast("int"), "match_score": score})
    if details:
        words = [matched_words(F.col(text), lexicon.get(c, ())).alias(f"{c}_matches") for c in CATEGORIES]
        out = out.withColumn("q0_details", F.struct(*words, "regex_matches", "total_matches", "match_score"))
    return out.drop("regex_matches", "words")


def q0_stats(docs: DataFrame, scored: DataFrame) -> DataFrame:
    """One row: rows in, rows scored, mean probability, rows above and not above 0.5."""
    p = F.col("q0")[1]
    return scored.agg(F.count("*").alias("processed"), F.avg(p).alias("avg_p"), F.count_if(p > 0.5).alias("sensitive"), F.count_if(p <= 0.5).alias("non_sensitive")).crossJoin(
        docs.agg(F.count("*").alias("total"))
    )


def q0_quality(scored: DataFrame, y: str = "coarse_label") -> DataFrame:
    """Binary metrics of p > 0.5, mean probability and what to think of both."""
    p = F.col("q0")[1]
    m = metrics.binary(F.col(y), (p > 0.5).cast("int"))
    x = scored.filter(F.col(y).isNotNull()).agg(*metrics.named(m), F.avg(p).alias("avg_p"))
    precision = F.when(F.col("precision") >= 0.75, "good").when(F.col("precision") >= 0.70, "fair").otherwise("low")
    level = F.when(F.col("avg_p") > 0.8, "high").when(F.col("avg_p") >= 0.5, "balanced").otherwise("low")
    return x.withColumns({"precision_verdict": precision, "level_verdict": level})


def labels_or_fallback(q: DataFrame, baseline: DataFrame, has_labels: bool) -> DataFrame:
    """Labels of ``q`` itself, or of the baseline by id where ``q`` has none at all."""
    return q if has_labels else q.drop("coarse_label").join(baseline.select("id", "coarse_label"), "id")


def grid_search(counted: DataFrame, mode: str = "fast", y: str = "coarse_label") -> DataFrame:
    """Metrics of every parameter set over rows with match counts and ``words``, best F1 first.

    The parameters don't change matches, so texts are matched once; rows meet the grid (512 sets
    at most) in one pass, and only partial sums by set are shuffled. Rows with the same counts,
    words and label are one row with a weight.
    """
    grid = [(i, *g) for i, g in enumerate(product(*GRIDS[mode]))]
    spark = counted.sparkSession
    g = spark.createDataFrame(grid, "param_id int, min_matches int, base_prob double, max_prob double, politics_weight double, abuse_weight double")
    rows = counted.filter(F.col(y).isin(0, 1)).groupBy(*[f"n_{c}" for c in CATEGORIES], "words", y).agg(F.count("*").alias("w"))
    x = rows.join(F.broadcast(g))
    total = F.col("n_porn") + F.col("n_politics") + F.col("n_abuse")
    score = (F.col("n_porn") * 1.0 + F.col("n_politics") * F.col("politics_weight") + F.col("n_abuse") * F.col("abuse_weight")) / F.col("words")
    p = F.when(total < F.col("min_matches"), F.col("base_prob")).otherwise(F.col("base_prob") + (F.col("max_prob") - F.col("base_prob")) * (F.tanh(score * 5) + 1) / 2)
    x = x.withColumn("pred", (p > 0.5).cast("int"))
    w, pred, t = F.col("w"), F.col("pred"), F.col(y)
    sums = x.groupBy(*g.columns).agg(*[F.sum(F.when((t == a) & (pred == b), w).otherwise(0)).alias(k) for k, a, b in (("tp", 1, 1), ("fp", 0, 1), ("fn", 1, 0), ("tn", 0, 0))])
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    out = sums.withColumns({"precision": metrics.ratio(tp, tp + fp), "recall": metrics.ratio(tp, tp + fn), "f1": metrics.ratio(2 * tp, 2 * tp + fp + fn)})
    return out.orderBy(F.desc("f1"), "param_id")
