"""Lexicon maintenance: a lexicon table has category and word."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftmark.functions.parsing import answer_lines
from siftmark.functions.text import strip
from siftmark.operators.cleaning import numbered
from siftmark.operators.labeling import LabelBackend, LabelTask, asked, run_task


def stats(lines: DataFrame) -> DataFrame:
    """original, unique, duplicate and removal percentage by category, and a row ``total`` of all."""
    per = lines.select("category", strip(F.col("word")).alias("word")).filter("word <> ''").groupBy("category").agg(F.count("*").alias("o"), F.count_distinct("word").alias("u"))
    x = per.rollup("category").agg(F.sum("o").alias("original"), F.sum("u").alias("unique"), F.grouping("category").alias("g"))
    lost = F.col("original") - F.col("unique")
    return x.select(F.when(F.col("g") == 1, "total").otherwise(F.col("category")).alias("category"), "original", "unique", lost.alias("duplicate"), F.coalesce(lost / F.col("original") * 100, F.lit(0.0)).alias("removed_pct"))


def dedup(lines: DataFrame) -> DataFrame:
    """Distinct words by category, in order of length and then of the word without case."""
    return lines.select("category", strip(F.col("word")).alias("word")).filter("word <> ''").distinct().orderBy("category", F.length("word"), F.lower("word"), "word")


def merge(old: DataFrame, new: DataFrame) -> DataFrame:
    """Union of distinct words."""
    return old.select("category", "word").union(new.select("category", "word")).distinct()


def added(old: DataFrame, new: DataFrame) -> DataFrame:
    """Words of ``new`` that ``old`` lacks."""
    return new.select("category", "word").distinct().join(old.select("category", "word"), ["category", "word"], "left_anti")


def words_of_answers(answers: DataFrame, response: str = "response") -> DataFrame:
    """(category, word) of a generator's answers, a word per line."""
    return answers.select("category", F.explode(answer_lines(F.col(response))).alias("word"))


def keep_returned(batch: DataFrame, answers: DataFrame, response: str = "response") -> DataFrame:
    """Words of a cleaning batch that its answer returns; a failed batch returns none."""
    return batch.join(words_of_answers(answers, response).distinct(), ["category", "word"], "left_semi")


class _Cleaner:
    """A backend whose empty answers are failures, to be asked again."""

    def __init__(self, backend: LabelBackend):
        self.backend = backend

    def answer(self, texts: list[str]) -> list[str]:
        out = self.backend.answer(texts)
        if not all(o and o.strip() for o in out):
            raise ValueError("an empty answer")
        return out


def word_batches(words: DataFrame, size: int) -> DataFrame:
    """(category, words, text): up to ``size`` distinct words of one category, and their lines; words stay in their tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        category, held = None, []

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([category]), pa.array([held], pa.list_(pa.string())), pa.array(["\n".join(held)])], ["category", "words", "text"])

        for batch in batches:
            for c, w in zip(batch.column("category").to_pylist(), batch.column("word").to_pylist(), strict=True):
                if held and (c != category or len(held) == size):
                    yield out()
                    held = []
                category = c
                held.append(w)
        if held:
            yield out()

    words = words.select("category", strip(F.col("word")).alias("word")).filter("category IS NOT NULL AND word <> ''").distinct()
    return words.sortWithinPartitions("category", F.length("word"), F.lower("word"), "word").mapInArrow(run, "category string, words array<string>, text string")


def clean_words(words: DataFrame, backend: LabelBackend, size: int = 50, task: LabelTask = LabelTask("cleaning", lambda c: c, 1, batch_chars=None)) -> DataFrame:
    """(category, word) of the words that a backend returns, a word per line, when it is given them by batches of a category.

    What it returns beside the words of its batch isn't taken. A batch without an answer, after the task's calls, keeps none.
    The task's limits (calls in flight, time, rate, repeats) hold as for labelling.
    """
    answers = asked(word_batches(words, size), _Cleaner(backend), replace(task, batch_size=1)).filter(F.col("__status") == "answered")
    kept = F.array_intersect("words", answer_lines(F.col("__answer")))
    return answers.select("category", F.explode(kept).alias("word"))


def ordered(words: DataFrame) -> DataFrame:
    """Distinct words with their ``place``, from 0, in order of category, length, the word without case, and the word."""
    x = words.select("category", strip(F.col("word")).alias("word")).filter("word <> ''").distinct()
    return numbered(x.withColumns({"__size": F.length("word"), "__low": F.lower("word")}), ["category", "__size", "__low", "word"], "place").drop("__size", "__low")


def generate(samples: DataFrame, backend: LabelBackend, old: DataFrame | None = None, batch_size: int = 10, max_retries: int = 3) -> DataFrame:
    """New (category, word) rows that a backend names for sample texts of a category (id, text, category), less those of ``old``."""
    answers = run_task(samples.select("id", "text", "category"), backend, LabelTask("words", lambda c: c, batch_size, max_retries, batch_chars=None))
    found = words_of_answers(answers, "words_response").distinct()
    return found if old is None else added(old, found)


def generate_rules(samples: DataFrame, backend: LabelBackend, max_retries: int = 3) -> DataFrame:
    """(pattern, description) rows of answers whose lines have a bar."""
    answers = run_task(samples.select("id", "text"), backend, LabelTask("rules", lambda c: c, 1, max_retries, batch_chars=None))
    line = answers.select(F.explode(answer_lines(F.col("rules_response"))).alias("line")).filter(F.contains("line", F.lit("|")))
    parts = F.split("line", r"\|", 2)
    return line.select(strip(parts[0]).alias("pattern"), strip(parts[1]).alias("description")).filter("pattern <> ''").distinct()
