"""Matches of a word table of any size in texts of any length, by rare q-grams.

Each word is found by one of its q-grams, the anchor: the one that occurs least in the texts. Texts give a row for each place
where an anchor's gram stands, with what lies around it, and those rows meet the words by their grams; a row counts if the
word stands around the place. Everything else about texts and words stays where it is.

Grams are known by a hash cell (of ``CELLS``): counts of cells have a fixed size, and equal cells of different grams are told
apart by the comparison of the whole word. Texts are read in blocks of ``BLOCK`` code points.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftmark.config import CATEGORIES
from siftmark.operators.seen import FEW_KEYS
from siftmark.sources.scratch import stored

#: Code points of a gram (words that are shorter are their own gram); cells, a power of two; code points of a text that are read at once.
GRAM, CELLS, BLOCK = 3, 1 << 20, 1 << 18


def cells(points: np.ndarray, size: int) -> np.ndarray:
    """The cell of each gram of ``size`` code points."""
    n = len(points) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    h = np.full(n, size, np.uint64)
    for k in range(size):
        h = (h ^ points[k : k + n].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return (h & np.uint64(CELLS - 1)).astype(np.int64)


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _blocks(text: str, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """(place of its first gram, cells) of the blocks of a text."""
    for at in range(0, max(0, len(text) - size + 1), BLOCK):
        yield at, cells(_points(text[at : at + BLOCK + size - 1]), size)


def gram_counts(docs: DataFrame, text: str, sizes: list[int]) -> DataFrame:
    """(cell, n) of the grams of all texts; a task adds up in a table of fixed size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, held, n = np.zeros(CELLS, np.int64), [np.zeros(0, np.int64)], 0
        for batch in batches:
            for t in batch.column(0).to_pylist():
                for size in sizes:
                    for _, c in _blocks(t, size):
                        held.append(c)
                        n += len(c)
                        if n >= CELLS:
                            table += np.bincount(np.concatenate(held), minlength=CELLS)
                            held, n = [], 0
        table += np.bincount(np.concatenate([np.zeros(0, np.int64), *held]), minlength=CELLS)
        at = np.flatnonzero(table)
        for k in range(0, len(at), 65_536):
            some = at[k : k + 65_536]
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(table[some])], ["cell", "n"])

    counted = docs.select(F.lower(text).alias("t")).filter("t IS NOT NULL").mapInArrow(run, "cell long, n long")
    return counted.groupBy("cell").agg(F.sum("n").alias("n"))


def anchored(words: DataFrame, counts: DataFrame) -> DataFrame:
    """(category, word, cell, before): each word with the cell of its rarest gram and the code points before that; the first one of equal rarity."""

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 1024):
                part = batch.slice(k, 1024)
                found = [cells(_points(w), min(GRAM, len(w))) for w in part.column("word").to_pylist()]
                of = np.repeat(np.arange(len(found)), [len(c) for c in found])
                rows = part.take(pa.array(of))
                cell, before = np.concatenate([np.zeros(0, np.int64), *found]), np.concatenate([np.zeros(0, np.int64), *[np.arange(len(c)) for c in found]])
                yield pa.RecordBatch.from_arrays([rows.column("category"), rows.column("word"), pa.array(cell), pa.array(before)], ["category", "word", "cell", "before"])

    every = words.select("category", "word").mapInArrow(grams, "category string, word string, cell long, before long")
    every = every.join(counts.withColumnRenamed("cell", "__c"), F.col("cell") == F.col("__c"), "left")
    best = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "before", "cell")).alias("a")
    # a word none of whose grams is in a text isn't in one either
    return every.groupBy("category", "word").agg(best).filter("a.n > 0").select("category", "word", F.col("a.cell").alias("cell"), F.col("a.before").alias("before"))


def word_matches(docs: DataFrame, words: DataFrame, id_col: str = "id", text: str = "text") -> DataFrame:
    """(id, category, word, n): how often each word of a (category, word) table occurs in each text, overlapping occurrences too.

    Both are compared in lower case; words are distinct by category, blank ones and nulls left out; a null text has none, and
    rows with an equal id count as one text's parts. Words and texts of any length and number: a place of a text makes a row
    only where the gram of an anchor stands (told by a map of ``CELLS`` bits), with as many characters around it as the
    longest words need.
    """
    spark = docs.sparkSession
    words = words.select("category", F.lower("word").alias("word")).filter(F.trim("word") != "").distinct()
    sizes = sorted(r[0] for r in words.select(F.least(F.length("word"), F.lit(GRAM)).alias("s")).distinct().collect())  # three numbers at most
    kind = docs.schema[id_col].dataType.simpleString()
    anchors = stored(anchored(words, gram_counts(docs, text, sizes)), "anchors")
    left, right, n = anchors.agg(F.max("before"), F.max(F.length("word") - F.col("before")), F.count(F.lit(1))).first()
    if not n:
        return spark.createDataFrame([], f"{id_col} {kind}, category string, word string, n long")
    held = np.zeros(CELLS, bool)
    held[anchors.select("cell").distinct().toArrow().column("cell").to_numpy()] = True  # at most CELLS rows
    shared = spark.sparkContext.broadcast(np.packbits(held))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.unpackbits(shared.value).astype(bool)
        for batch in batches:
            of, cell, around, at = [], [], [], []

            def rows() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of, pa.int64())), pa.array(cell, pa.int64()), pa.array(around, pa.string()), pa.array(at, pa.int64())], ["id", "cell", "around", "at"])

            for row, t in enumerate(batch.column(1).to_pylist()):
                for size in sizes:
                    for first, c in _blocks(t, size):
                        for p in np.flatnonzero(held[c]).tolist():
                            of.append(row)
                            cell.append(int(c[p]))
                            around.append(t[max(0, first + p - left) : first + p + right])
                            at.append(min(first + p, left))
                            if len(of) >= 8192:
                                yield rows()
                                of, cell, around, at = [], [], [], []
            yield rows()

    texts = docs.select(F.col(id_col).alias("id"), F.lower(text).alias("t")).filter("t IS NOT NULL")
    found = texts.mapInArrow(places, f"id {kind}, cell long, around string, at long")
    joined = found.join(F.broadcast(anchors) if n <= FEW_KEYS else anchors, "cell")
    same = F.substring("around", (F.col("at") - F.col("before") + 1).cast("int"), F.length("word")) == F.col("word")
    joined = joined.filter((F.col("at") >= F.col("before")) & same)
    return joined.groupBy(F.col("id").alias(id_col), "category", "word").agg(F.count(F.lit(1)).alias("n"))


def table_counts(docs: DataFrame, words: DataFrame, id_col: str = "id", text: str = "text") -> DataFrame:
    """id and n_porn, n_politics, n_abuse for each distinct id of ``docs``, for lexicons that are tables."""
    found = word_matches(docs, words, id_col, text).groupBy(F.col(id_col).alias("__id")).agg(*[F.sum(F.when(F.col("category") == c, F.col("n"))).alias(f"__{c}") for c in CATEGORIES])
    out = docs.select(id_col).distinct().join(found, F.col(id_col) == F.col("__id"), "left")
    return out.select(id_col, *[F.coalesce(f"__{c}", F.lit(0)).alias(f"n_{c}") for c in CATEGORIES])
