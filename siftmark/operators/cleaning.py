"""Cleaning, exact deduplication and surrogate ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftmark.config import CleanConfig
from siftmark.functions import text as T


def clean_rows(docs: DataFrame, config: CleanConfig = CleanConfig(), text: str = "text") -> DataFrame:
    """Rows with cleaned text; rows that cleaning drops are gone."""
    # exploding drops nulls with the text computed once; a filter would compute it again
    kept = F.explode(F.array_compact(F.array(T.clean(F.col(text), config)))).alias(text)
    return docs.select(*[kept if c == text else F.col(c) for c in docs.columns])


def dedup_keep_first(docs: DataFrame, order: list[str | Column], text: str = "text") -> DataFrame:
    """The first row in input order of each exact text.

    Rows are dealt by the text's hash. Copies are dropped before they are dealt but for the first of each task, so a frequent
    text is no hot key; the first ones move with their texts.
    """
    w = Window.partitionBy(T.text_hash(F.col(text))).orderBy(*order)
    return docs.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")


def clean_stats(docs: DataFrame, config: CleanConfig = CleanConfig(), text: str = "text") -> DataFrame:
    """One row: total, processed, filtered, deduplicated, output."""
    x = docs.select(T.text_hash(T.clean(F.col(text), config)).alias("h")).groupBy("h").agg(F.count("*").alias("n"))
    kept = F.col("h").isNotNull()
    total, filtered = F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.when(~kept, F.col("n"))), F.lit(0))
    out = F.count_if(kept)
    return x.agg(total.alias("total"), (total - filtered).alias("processed"), filtered.alias("filtered"), (total - filtered - out).alias("deduplicated"), out.alias("output"))


def max_id(rows: DataFrame, col: str = "id") -> DataFrame:
    """One row: the largest n of ids "sn"; -1 if there is none."""
    n = F.regexp_extract(F.col(col), r"^s(-?\d+)$", 1).try_cast("long")
    return rows.agg(F.coalesce(F.max(n), F.lit(-1).cast("long")).alias("max_id"))


#: Ranges that rows are numbered by; values that their bounds are taken from.
RANGES, BOUNDS_FROM = 128, 20_000


def numbered(rows: DataFrame, order: list[str], name: str, ranges: int = RANGES) -> DataFrame:
    """``rows`` with their place in the order of columns, from 0 without gaps.

    Bounds of ranges are fixed first, as literals, from values whose hash is lowest; then rows are counted by range and
    numbered inside each, with what lies before it added. Nothing is kept between the steps but literals, so a lost executor
    or a step computed anew changes nothing, as long as ``rows`` gives the same rows and no two are equal in ``order``.
    """
    key = F.struct(*[F.col(c) for c in order])
    n = rows.count()
    step = max(1, n // BOUNDS_FROM)
    some = sorted(tuple(r) for r in rows.select(*order).filter(F.pmod(F.xxhash64(*order), F.lit(step)) == 0).filter(" AND ".join(f"`{c}` IS NOT NULL" for c in order)).collect())
    cuts = [some[len(some) * k // ranges] for k in range(1, ranges)] if n > ranges * 100 else []
    kinds = [rows.schema[c].dataType for c in order]
    bounds = [F.struct(*[F.lit(v).cast(t).alias(c) for c, v, t in zip(order, cut, kinds, strict=True)]) for cut in dict.fromkeys(cuts)]
    part = F.size(F.filter(F.array(*bounds), lambda b: b <= key)) if bounds else F.lit(0)
    dealt = rows.withColumn("__part", part)
    before, total = [], 0
    for r in sorted(dealt.groupBy("__part").count().collect()):  # a row for each range
        before.append((r[0], total))
        total += r[1]
    offsets = F.broadcast(rows.sparkSession.createDataFrame(before, "__p int, __before long"))
    place = F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1
    out = dealt.withColumn("__k", place).join(offsets, F.col("__part") == F.col("__p"))
    return out.withColumn(name, F.col("__before") + F.col("__k")).drop("__part", "__p", "__before", "__k")


def assign_ids(rows: DataFrame, order: str, start: int = 0, name: str = "id") -> DataFrame:
    """``rows`` with ids "s<start>", "s<start+1>" ... in order of a column of distinct values; see :func:`numbered`."""
    out = numbered(rows, [order], "__place")
    return out.withColumn(name, F.concat(F.lit("s"), (F.col("__place") + start).cast("string"))).drop("__place")


def last_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row in input order of each key."""
    whole = F.struct(*rows.columns)
    return rows.groupBy(key).agg(F.max_by(whole, F.col(order)).alias("__r")).select("__r.*")
