"""Lexicon and regex matching.

A lexicon is a small dict of category -> words, held on the driver; words are matched as
substrings, without regard to case. Two ways give the same counts: built-in expressions
(one pass of the text per word, for small lexicons) and an automaton in Arrow batches (one
pass for all words that fit into a task). Words that are a table of any size are matched by
:mod:`.anchors`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftmark.config import CATEGORIES

Lexicon = dict[str, tuple[str, ...]]
#: Up to so many words are counted with built-in expressions.
FEW_WORDS = 200
#: Up to so many words are a lexicon; more are a table.
MOST_WORDS = 200_000


def lexicon_of(rows: DataFrame) -> Lexicon:
    """A lexicon from a (category, word) table of up to MOST_WORDS words: lower case, without blanks and repeats; a category may be empty."""
    words = rows.select("category", F.lower(F.trim("word")).alias("word")).filter("word <> ''").distinct().limit(MOST_WORDS + 1).collect()
    if len(words) > MOST_WORDS:
        raise ValueError(f"over {MOST_WORDS} words: match them as a table, by anchors.word_matches")
    return {c: tuple(sorted(r["word"] for r in words if r["category"] == c)) for c in CATEGORIES}


def _overlaps_itself(word: str) -> bool:
    return any(word[:k] == word[-k:] for k in range(1, len(word)))


def occurrences(low: Column, word: str) -> Column:
    """How often a word occurs in a lower-case text, overlapping occurrences too."""
    if _overlaps_itself(word):
        return F.regexp_count(low, F.lit(f"(?={re.escape(word)})"))
    return ((F.length(low) - F.length(F.replace(low, F.lit(word), F.lit("")))) / len(word)).cast("int")


def counts(text: Column, lexicon: Lexicon, mode: str = "occurrence") -> dict[str, Column]:
    """Matches by category: every occurrence, or each distinct word once."""
    low, out = F.lower(text), {}
    for c in CATEGORIES:
        n = F.lit(0)
        for w in lexicon.get(c, ()):
            n = n + (occurrences(low, w) if mode == "occurrence" else F.contains(low, F.lit(w)).cast("int"))
        out[c] = n
    return out


def matched_words(text: Column, words: tuple[str, ...], mode: str = "occurrence") -> Column:
    """The matched words of one category, in lexicon order, as often as they occur."""
    low = F.lower(text)
    if not words:
        return F.array().cast("array<string>")
    if mode == "distinct":
        return F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(low, w))
    return F.flatten(F.array(*[F.array_repeat(F.lit(w), occurrences(low, w)) for w in words]))


def with_counts(docs: DataFrame, lexicon: Lexicon, text: str = "text", mode: str = "occurrence") -> DataFrame:
    """``docs`` with n_porn, n_politics and n_abuse, by the way that suits the lexicon's size."""
    if sum(map(len, lexicon.values())) <= FEW_WORDS:
        return docs.withColumns({f"n_{c}": n for c, n in counts(F.col(text), lexicon, mode).items()})
    return automaton_counts(docs, lexicon, text, mode)


def automaton_counts(docs: DataFrame, lexicon: Lexicon, text: str = "text", mode: str = "occurrence") -> DataFrame:
    """As :func:`with_counts`, with one automaton for all words, built once per task."""
    from pyspark.sql import types as T

    at = docs.columns.index(text)
    schema = T.StructType([*docs.schema.fields, *[T.StructField(f"n_{c}", T.IntegerType()) for c in CATEGORIES]])
    pairs = [(c, w) for c in CATEGORIES for w in lexicon.get(c, ())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        found = ahocorasick.Automaton()
        owners: dict[str, list[int]] = {}
        for c, w in pairs:
            owners.setdefault(w, []).append(CATEGORIES.index(c))
        for w, o in owners.items():
            found.add_word(w, (w, o))
        found.make_automaton() if owners else None
        for batch in batches:
            out: list[list[int]] = [[], [], []]
            for t in batch.column(at).to_pylist():
                n, seen = [0, 0, 0], set()
                for _, (w, o) in found.iter((t or "").lower()) if owners else ():
                    if mode == "occurrence" or w not in seen:
                        seen.add(w)
                        for k in o:
                            n[k] += 1
                for k in range(3):
                    out[k].append(None if t is None else n[k])
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(x, pa.int32()) for x in out]], [*batch.schema.names, *[f"n_{c}" for c in CATEGORIES]])

    return docs.mapInArrow(run, schema)


def valid_rules(rules: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """Rules (pattern, description) whose pattern compiles where it will run: in the JVM."""
    out = []
    compiler = SparkSession.active().sparkContext._jvm.java.util.regex.Pattern
    for p, d in rules:
        try:
            compiler.compile(f"(?iu){p}")
        except (Py4JJavaError, IllegalArgumentException):
            continue
        out.append((p, d))
    return out


def regex_hits(text: Column, rules: list[tuple[str, str]]) -> Column:
    """Descriptions of the rules that a text matches anywhere, without regard to case."""
    rules = valid_rules(rules)
    if not rules:
        return F.array().cast("array<string>")
    return F.array_compact(F.array(*[F.when(text.rlike(f"(?iu){p}"), d) for p, d in rules]))
