"""Word tables against texts, by anchors, against the automaton and plain Python."""

from __future__ import annotations

import random

import ahocorasick
import pytest
from pyspark.sql import functions as F

from siftmark.operators import anchors, matching


def automaton_counts(texts: dict, words: set[tuple[str, str]]) -> dict:
    a = ahocorasick.Automaton()
    owners: dict[str, set] = {}
    for c, w in words:
        owners.setdefault(w.lower(), set()).add(c)
    for w in owners:
        a.add_word(w, w)
    a.make_automaton()
    out: dict = {}
    for i, t in texts.items():
        for _, w in a.iter((t or "").lower()):
            for c in owners[w]:
                out[i, c, w] = out.get((i, c, w), 0) + 1
    return out


def got(df) -> dict:
    return {(r["id"], r["category"], r["word"]): r["n"] for r in df.collect()}


@pytest.mark.parametrize("block", [1 << 18, 5])
def test_random_texts_and_words(spark, monkeypatch, block):
    monkeypatch.setattr(anchors, "BLOCK", block)
    rnd = random.Random(block)
    letters = "ababcé中\U0001F600 X"
    texts = {i: "".join(rnd.choice(letters) for _ in range(rnd.choice([0, 1, 2, 3, 40, 200]))) for i in range(120)} | {500: None}
    words = {(rnd.choice(["porn", "abuse"]), "".join(rnd.choice(letters) for _ in range(rnd.randint(1, 7)))) for _ in range(300)}
    words = {(c, w) for c, w in words if w.strip(" ")} | {("porn", "aaaa"), ("abuse", "zzz"), ("politics", "ab")}
    df = spark.createDataFrame(list(texts.items()), "id long, text string").repartition(3)
    table = spark.createDataFrame([*words, ("porn", None), ("porn", " "), ("porn", "aaaa")], "category string, word string")
    want = automaton_counts(texts, words)
    assert got(anchors.word_matches(df, table)) == want
    counts = {r["id"]: (r["n_porn"], r["n_politics"], r["n_abuse"]) for r in anchors.table_counts(df, table).collect()}
    assert counts == {i: tuple(sum(n for (j, c, _), n in want.items() if (i, k) == (j, c)) for k in ("porn", "politics", "abuse")) for i in texts}


def test_many_words_in_a_long_text(spark, monkeypatch):
    """Tens of thousands of words, a text of a megabyte; words shuffled as if they were too many to broadcast, too."""
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(3, 9)))
    words = {("abuse", word()) for _ in range(60_000)}
    some = [w for _, w in sorted(words)]
    texts = {1: " ".join(rnd.choice(some) if rnd.random() < 0.2 else word() for _ in range(150_000)), 2: "abc " * 50, 3: ""}
    assert len(texts[1]) > 1_000_000
    df = spark.createDataFrame(list(texts.items()), "id long, text string").repartition(2)
    table = spark.createDataFrame(list(words), "category string, word string")
    want = automaton_counts(texts, words)
    assert got(anchors.word_matches(df, table)) == want
    monkeypatch.setattr(anchors, "FEW_KEYS", 0)
    assert got(anchors.word_matches(df, table)) == want


def test_nothing_to_match(spark):
    df = spark.createDataFrame([(1, "text"), (2, None)], "id long, text string")
    for words in ([], [("porn", "xyz")], [("porn", None)]):
        out = anchors.word_matches(df, spark.createDataFrame(words, "category string, word string"))
        assert out.collect() == [] and out.columns == ["id", "category", "word", "n"]
    table = spark.createDataFrame([("porn", "ex")], "category string, word string")
    assert anchors.word_matches(df.limit(0), table).collect() == []


def test_the_rarest_gram_is_the_anchor(spark):
    df = spark.createDataFrame([(1, "the the the the theory"), (2, "the")], "id long, text string")
    table = spark.createDataFrame([("porn", "theory")], "category string, word string")
    row = anchors.anchored(table, anchors.gram_counts(df, "text", [3])).first()
    assert row["before"] == 1  # "heo", not "the"
    assert got(anchors.word_matches(df, table)) == {(1, "porn", "theory"): 1}


def test_too_many_words_for_the_driver(spark, monkeypatch):
    monkeypatch.setattr(matching, "MOST_WORDS", 5)
    table = spark.range(6).select(F.lit("porn").alias("category"), F.concat(F.lit("w"), "id").alias("word"))
    with pytest.raises(ValueError):
        matching.lexicon_of(table)
    assert len(matching.lexicon_of(table.limit(5))["porn"]) == 5
