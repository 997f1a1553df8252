"""Calls, durable labelling and keys that are known."""

from __future__ import annotations

import random
import threading
import time
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from siftmark.functions import parsing as P
from siftmark.operators import calls, labeling, seen
from siftmark.streaming import incremental, labelling

TASK = labeling.LabelTask("coarse", P.binary_label, 5, 1)


# --- calls

def test_calls_go_out_together_and_come_back_in_order():
    out, most, lock = [0], [0], threading.Lock()

    def slow(x):
        with lock:
            out[0] += 1
            most[0] = max(most[0], out[0])
        time.sleep(0.1)
        with lock:
            out[0] -= 1
        return x

    began = time.monotonic()
    assert list(calls.fan_out(slow, range(25), 5)) == list(range(25))
    took = time.monotonic() - began
    assert most[0] == 5 and 0.5 <= took < 1.5  # 25 calls of 0.1 s, five at once


def test_a_call_over_its_time_frees_its_place():
    began = time.monotonic()
    got = list(calls.fan_out(lambda x: time.sleep(30) if x % 4 == 0 else x, range(12), 2, 0.3))
    assert time.monotonic() - began < 5
    assert [isinstance(g, TimeoutError) if k % 4 == 0 else g == k for k, g in enumerate(got)] == [True] * 12


def test_slow_first_calls_dont_hold_back_others_and_the_window_is_bounded():
    asked = []

    def call(x):
        asked.append(x)
        if x == 0:
            time.sleep(0.5)
        return x

    results = calls.fan_out(call, iter(range(10_000)), 2)
    assert next(results) == 0
    assert 2 < len(asked) <= 16
    assert list(results) == list(range(1, 10_000))


def test_nothing_is_asked_of_an_exhausted_backend():
    asked = []

    def answer(x):
        asked.append(x)
        if x >= 10:
            raise calls.Exhausted("spent")
        return x

    for at_once in (1, 3):
        asked.clear()
        call = calls.retried(answer, 5)
        got = list(calls.fan_out(call, range(50), at_once))
        assert got[:10] == list(range(10)) and all(isinstance(g, calls.Exhausted) for g in got[10:])
        assert len(asked) <= 10 + at_once
        n = len(asked)
        assert isinstance(next(calls.fan_out(call, [1], at_once)), calls.Exhausted) and len(asked) == n


def test_repeats_and_refusals():
    tried = []

    def answer(x):
        tried.append(x)
        if x == "no":
            raise calls.Refused("safety")
        if len(tried) < 3:
            raise OSError
        return x

    assert calls.retried(answer, 3)("a") == "a" and len(tried) == 3
    with pytest.raises(calls.Refused):
        calls.retried(answer, 3)("no")
    assert len(tried) == 4
    tried.clear()
    with pytest.raises(calls.Unanswered):
        calls.retried(answer, 2)("a")


def test_slots_of_all_tasks_are_apart():
    now = [1000.3]

    def sleep(s):
        now[0] += s

    tasks = [calls.Slots(0.5, k, 4, lambda: now[0], sleep) for k in range(4)]
    rnd, taken = random.Random(1), []
    for _ in range(200):
        now[0] = 1000.3 + rnd.random() * 3  # tasks live side by side
        taken.append(rnd.choice(tasks).wait())
    assert len(set(taken)) == len(taken)
    for k, t in enumerate(tasks):
        assert t.wait() % 4 == k


class Timed:
    """Answers with the time of the call."""

    def answer(self, texts):
        return [f"{time.time()}"] * len(texts)


def test_the_rate_holds_for_all_tasks_and_scans_keep_theirs(spark):
    rows = spark.range(0, 120, 1, 12).select("id", F.concat(F.lit("text "), "id").alias("text"))
    task = labeling.LabelTask("timed", lambda c: c, 4, 1, calls_per_minute=1200)
    answers = labeling.asked(rows, Timed(), task)
    times = sorted({float(r["__answer"]) for r in answers.collect()})
    assert len(times) == 30 + (len(times) - 30)  # calls of up to four texts
    assert len(times) >= 30
    for a, b in zip(times, times[10:], strict=False):
        assert b - a >= 9.5 * 0.05  # ten calls take at least ten slots of 50 ms, less what a call is late by
    assert rows.rdd.getNumPartitions() == 12  # nothing before the calls is squeezed into few tasks


class Slow(labeling.RuleBackend):
    def answer(self, texts):
        if any("slow" in t for t in texts):
            time.sleep(5)
        return super().answer(texts)


def test_batches_over_time_are_asked_again_text_by_text(spark):
    rows = spark.createDataFrame([(i, f"{'slow' if i == 13 else 'bad' if i % 3 == 0 else 'good'} {i}") for i in range(40)], "id long, text string")
    task = replace(TASK, calls_at_once=4, call_limit_s=1.0)
    got = {r["id"]: (r["coarse_response"], r["coarse_label"]) for r in labeling.run_task(rows.coalesce(1), Slow({"abuse": ("bad",)}), task).collect()}
    assert got.pop(13) == (None, None)
    assert got == {i: (str(int(i % 3 == 0)), int(i % 3 == 0)) for i in range(40) if i != 13}


# --- durable labelling

class Counting(labeling.RuleBackend):
    """Writes each text that it is asked for to a file of its own; gives up after so many calls."""

    def __init__(self, folder, left=10**9):
        super().__init__({"abuse": ("bad",)})
        self.folder, self.left = str(folder), left

    def answer(self, texts):
        self.left -= 1
        if self.left < 0:
            raise labeling.Exhausted("spent")
        if any("fails" in t for t in texts):
            raise OSError
        for t in texts:
            with open(f"{self.folder}/{t.split()[-1]}", "a") as f:
                f.write("x")
        return super().answer(texts)


def test_interrupted_runs_ask_only_for_what_is_missing(spark, tmp_path):
    asked, target = tmp_path / "asked", str(tmp_path / "out")
    asked.mkdir()
    rows = [(i, None if i % 50 == 7 else f"{'bad' if i % 3 == 0 else 'good'} text {i}") for i in range(300)]
    spark.createDataFrame(rows, "id long, text string").repartition(10).write.parquet(str(tmp_path / "in"))

    def run(left=10**9):
        stream = labelling.table_stream(spark, str(tmp_path / "in"), "id long, text string", 2)
        return labelling.label_stream(stream, target, Counting(asked, left), TASK)

    first = run(3)
    assert 0 < first["answered"] < 294 and first["unasked"] > 0 and first["skipped"] == 0
    assert spark.read.parquet(target).count() == first["answered"]
    second = run()
    assert second == {"total": 300, "empty": 6, "skipped": first["answered"], "answered": 294 - first["answered"], "blocked": 0, "failed": 0, "unasked": 0}
    assert all(f.read_text() == "x" for f in asked.iterdir())  # no text was paid for twice
    got = [tuple(r) for r in spark.read.parquet(target).select("id", "coarse_label").collect()]
    assert sorted(got) == [(i, int(i % 3 == 0)) for i, t in rows if t]
    third = run()
    assert third["answered"] == 0 and third["skipped"] == 294


def test_failed_rows_stay_to_be_asked(spark, tmp_path):
    asked, target = tmp_path / "asked", str(tmp_path / "out")
    asked.mkdir()
    schema = "id long, text string"
    spark.createDataFrame([(1, "good 1"), (2, "fails 2"), (3, "bad 3")], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = lambda: labelling.table_stream(spark, str(tmp_path / "in"), schema)
    first = labelling.label_stream(stream(), target, Counting(asked), TASK)
    assert (first["answered"], first["failed"]) == (2, 1)
    second = labelling.label_stream(stream(), target, labeling.RuleBackend({"abuse": ("fails",)}), TASK)
    assert (second["answered"], second["skipped"]) == (1, 2)
    assert {r["id"]: r["coarse_label"] for r in spark.read.parquet(target).collect()} == {1: 0, 2: 1, 3: 1}


# --- known keys

@pytest.mark.parametrize("kind", ["long", "string"])
def test_rows_without_known_keys(spark, kind):
    rnd = random.Random(4)
    known = spark.createDataFrame([(k,) for k in rnd.sample(range(20_000), 6000)] + [(None,), (5,), (5,)], "id long").select(F.col("id").cast(kind))
    rows = spark.range(20_000).select(F.col("id").cast(kind), F.lit("text").alias("text"))
    rows = rows.unionByName(rows.limit(50)).unionByName(rows.limit(1).withColumn("id", F.lit(None).cast(kind)))
    want = sorted((r["id"] for r in rows.join(known, "id", "left_anti").collect()), key=str)
    for few in (10**6, 5000, 0):
        got = seen.without_known(rows, known, "id", few)
        assert got.columns == ["id", "text"]
        assert sorted((r["id"] for r in got.collect()), key=str) == want
    # more false hits than are looked up, in a sketch that is far too small
    x = seen.flagged(rows, "id", seen.sketch(known, "id", 1), 1)
    assert sorted((r["id"] for r in seen.settled(x, "id", known.select(F.col("id").alias("__known"))).collect()), key=str) == want
    assert sorted((r["id"] for r in seen.settled(x, "id", known.select(F.col("id").alias("__known")), few=10).collect()), key=str) == want


def test_rows_with_known_keys(spark):
    known = spark.createDataFrame([(1,), (1,), (7,), (None,)], "id long")
    rows = spark.range(10).select("id", F.lit("text").alias("text")).unionByName(spark.createDataFrame([(None, "x"), (7, "y")], "id long, text string"))
    for few in (100, 0):
        assert sorted(tuple(r) for r in seen.with_known(rows, known, "id", few).collect()) == [(1, "text"), (7, "text"), (7, "y")]


def test_a_sketch_holds_its_keys_and_few_others(spark):
    keys, others = spark.range(10_000).select("id"), spark.range(10_000, 60_000).select("id")
    blocks = seen.blocks_for(10_000)
    assert blocks == 16 and seen.blocks_for(0) == 1 and seen.blocks_for(10**12) == seen.MOST_BLOCKS
    found = seen.sketch(keys, "id", blocks)
    assert seen.flagged(keys, "id", found, blocks).filter("NOT __maybe").count() == 0
    assert seen.flagged(others, "id", found, blocks).filter("__maybe").count() < 50_000 * 0.002
    half = seen.merged(seen.sketch(keys.filter("id < 5000"), "id", blocks), seen.sketch(keys.filter("id >= 5000"), "id", blocks))
    assert sorted(map(tuple, half.collect())) == sorted(map(tuple, found.collect()))


def test_no_text_is_shuffled_for_the_labelled(spark):
    rows = spark.range(1000).select("id", F.repeat(F.lit("text "), 100).alias("text"))
    plan = labeling.pending(rows, spark.range(10).select("id"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "SortMergeJoin" not in plan


def test_new_rows_dont_scan_the_table(spark, tmp_path):
    target = str(tmp_path / "t")
    known = seen.SeenKeys(spark, target, "id")
    for k in range(4):
        rows = known.new(spark.range(100 * k, 100 * k + 150).select("id"))  # half of each batch is there already
        got = sorted(r["id"] for r in rows.collect())
        assert got == (list(range(150)) if k == 0 else list(range(100 * k + 50, 100 * k + 150)))
        known.remember(rows)
        rows.write.mode("append").parquet(target)
    path = known._versions()
    assert 1 <= len(path) <= 2
    plan = known.new(spark.range(10**6, 10**6 + 10).select("id"))._jdf.queryExecution().optimizedPlan().toString()
    assert "__known" not in plan
    # a run that ended between the sketch and the rows loses nothing
    known.remember(spark.range(5000, 5010).select("id"))
    assert known.new(spark.range(5000, 5010).select("id")).count() == 10


def test_ingestion_appends_each_key_once(spark, tmp_path):
    folder, target = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    for k in range(6):
        (folder / f"{k}.txt").write_text(f"text {k}")
    for state in ("a", "a", "b"):
        incremental.ingest_new(incremental.text_stream(spark, str(folder)), target, str(tmp_path / state), "path")
    (folder / "7.txt").write_text("text 7")
    incremental.ingest_new(incremental.text_stream(spark, str(folder)), target, str(tmp_path / "b"), "path")
    assert sorted(r["text"] for r in spark.read.parquet(target).collect()) == [f"text {k}" for k in (0, 1, 2, 3, 4, 5, 7)]
