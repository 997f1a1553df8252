"""Splits and samples that depend on nothing but the seed and the ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftmark.config import SplitConfig


def ticket(key: str, seed: int) -> Column:
    """The place of a row in the draw."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def stratified_split(rows: DataFrame, key: str, by: str | None = None, config: SplitConfig = SplitConfig()) -> DataFrame:
    """``rows`` with ``split`` (train, dev or test), in the ratios of the config within each stratum.

    Without ``by``, or where any row has none, all rows are one stratum. Each stratum is ranked by
    a hash of seed and key; ranks come from counts of hash ranges, so that a stratum of very many
    rows is ranked in many tasks.
    """
    s = F.col(by) if by else F.lit(None)
    if by:
        whole = rows.agg(F.count_if(F.col(by).isNull()).alias("n")).first()["n"] == 0
        s = s if whole else F.lit(None)
    x = rows.withColumns({"__s": s.cast("string"), "__t": ticket(key, config.seed)}).withColumn("__r", F.substring("__t", 1, 2))
    sizes = x.groupBy("__s", "__r").agg(F.count("*").alias("n"))
    w = Window.partitionBy("__s")
    before = F.coalesce(F.sum("n").over(w.orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # 256 ranges a stratum
    offsets = sizes.select(F.col("__s").alias("__s2"), F.col("__r").alias("__r2"), before.alias("__before"), F.sum("n").over(w).alias("__n"))
    k = F.row_number().over(Window.partitionBy("__s", "__r").orderBy("__t", key))
    x = x.withColumn("__k", k).join(offsets, F.col("__s").eqNullSafe(F.col("__s2")) & (F.col("__r") == F.col("__r2")))
    place, n = F.col("__before") + F.col("__k"), F.col("__n")
    train, dev = F.round(n * config.train), F.round(n * (config.train + config.dev))
    split = F.when(place <= train, "train").when(place <= dev, "dev").otherwise("test")
    return x.withColumn("split", split).select(*rows.columns, "split")


def split_stats(rows: DataFrame, y: str = "coarse_label") -> DataFrame:
    """split, n, positives and ratio, share of all rows."""
    x = rows.groupBy("split").agg(F.count("*").alias("n"), F.count_if(F.col(y) == 1).alias("positives"))
    total = F.sum("n").over(Window.partitionBy())  # over three rows
    return x.select("split", "n", "positives", (F.col("positives") / F.col("n")).alias("positive_ratio"), (F.col("n") / total).alias("share"))


def label_distribution(rows: DataFrame, y: str = "coarse_label") -> DataFrame:
    return rows.groupBy(F.col(y).alias("label")).agg(F.count("*").alias("n"))


def sample(rows: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows by the draw of seed and key (all, if there are fewer)."""
    return rows.orderBy(ticket(key, seed), key).limit(n)


def category_sample(rows: DataFrame, category: str, n: int, key: str = "id", seed: int = 42) -> DataFrame:
    """A sample of positive rows that carry a subtype."""
    hit = (F.col("coarse_label") == 1) & F.array_contains(F.coalesce("subtype_label", F.array().cast("array<string>")), category)
    return sample(rows.filter(hit), key, n, seed)
