"""Tokenised datasets: batches of rows of equal padded width, as fixed-width arrays with masks.

A tokenizer is any object with ``ids(texts) -> list[list[int]]``; it is given to the executors, so it has to pickle. Widths
are a fixed ladder, each a twentieth above the last, so padding is bounded whatever the lengths. A width with many rows is
dealt to several tasks by the key's hash: no batch waits for a global order, and only the counts of widths are collected.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftmark.sources.scratch import stored

#: Most tokens of a row (fixed value: as the models take them), rows of a batch, rows of one width that one task puts in order.
MOST_TOKENS, BATCH_ROWS, DEAL_ROWS = 512, 16, 100_000


class Tokenizer(Protocol):
    def ids(self, texts: list[str]) -> list[list[int]]: ...


class CodePoints:
    """A stand-in that needs no vocabulary: 1, each character's code point and 3 more, then 2; cut to a length with the 2 kept."""

    def __init__(self, most: int = MOST_TOKENS):
        self.most = most

    def ids(self, texts: list[str]) -> list[list[int]]:
        return [[1, *[ord(c) + 3 for c in t[: self.most - 2]], 2] for t in texts]


def ladder(most: int = MOST_TOKENS) -> list[int]:
    """Widths up to ``most``: every number up to 20, then each a twentieth more than the last."""
    out = [1]
    while out[-1] < most:
        out.append(min(most, max(out[-1] + 1, out[-1] * 21 // 20)))
    return out


def tokenised(rows: DataFrame, tokenizer: Tokenizer, text: str = "text", label: str | None = None, most: int = MOST_TOKENS) -> DataFrame:
    """Rows that have text (and, with ``label``, a label that isn't null) with their ids, cut to ``most``, and ``n_tokens``."""
    rows = rows.filter(F.col(text).isNotNull())
    if label:
        rows = rows.filter(F.col(label).isNotNull())
    at = rows.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                ids = [i[:most] for i in tokenizer.ids(part.column(at).to_pylist())]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(ids, pa.list_(pa.int32())), pa.array([len(i) for i in ids], pa.int32())], [*part.schema.names, "ids", "n_tokens"])

    from pyspark.sql import types as T

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.IntegerType())]))


def padded(rows: DataFrame, key: str, batch_rows: int = BATCH_ROWS, most: int = MOST_TOKENS, pad: int = 0, deal_rows: int = DEAL_ROWS) -> DataFrame:
    """Rows of :func:`tokenised` in batches: ``width``, ``deal`` and ``batch`` name a batch, ``place`` a row of it; input_ids and mask are ``width`` long.

    Rows of a batch have one width, the least of the ladder that holds them; all batches but the last of each (width, deal)
    have ``batch_rows`` rows. Padded cells are at most a twentieth more than tokens, but for rows without any (width 1).
    """
    steps = ladder(most)
    width = F.array_min(F.filter(F.array(*map(F.lit, steps)), lambda w: w >= F.col("n_tokens")))
    x = stored(rows.withColumn("width", width), "tokens")
    counts = {r["width"]: r["count"] for r in x.groupBy("width").count().collect()}  # a row for each width
    deals = F.create_map(*[F.lit(v) for w, n in counts.items() for v in (w, -(-n // deal_rows))])[F.col("width")] if counts else F.lit(1)
    x = x.withColumn("deal", F.pmod(F.xxhash64(key), deals.cast("long")).cast("int"))
    k = F.row_number().over(Window.partitionBy("width", "deal").orderBy(key, "ids")) - 1
    x = x.withColumn("__k", k).withColumns({"batch": F.floor(F.col("__k") / batch_rows).cast("int"), "place": (F.col("__k") % batch_rows).cast("int")})
    rest = F.col("width") - F.col("n_tokens")
    return x.withColumns({
        "input_ids": F.concat("ids", F.array_repeat(F.lit(pad), rest)), "mask": F.concat(F.array_repeat(F.lit(1), F.col("n_tokens")), F.array_repeat(F.lit(0), rest)),
    }).drop("ids", "__k")


def padding(batches: DataFrame) -> DataFrame:
    """One row: rows, batches, tokens, cells."""
    per = batches.groupBy("width", "deal", "batch").agg(F.count("*").alias("n"), F.sum("n_tokens").alias("t"))
    return per.agg(F.sum("n").alias("rows"), F.count("*").alias("batches"), F.sum("t").alias("tokens"), F.sum(F.col("n") * F.col("width")).alias("cells"))
