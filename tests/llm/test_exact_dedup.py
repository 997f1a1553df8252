from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from siftmark.llm import exact_dedup as D
from siftmark.llm.shared import saved
from tests.llm.helpers import AWKWARD, awkward, no_rows


def test_awkward(spark):
    got = D.exact_dedup(awkward(spark, clash=True)).collect()
    assert len(got) == len(AWKWARD)
    ones = [r for r in got if r["doc_id"] == 1]
    # rows 1, 1 and 7 are equal without white space; 7 has as many code points as 1, so the smaller id stays, once
    assert sum(r["kept"] for r in ones) == 1 and {r["group_size"] for r in ones} == {3}
    by = {r["doc_id"]: r for r in got}
    assert by[7]["keep_id"] == 1 and not by[7]["kept"]
    # null and empty texts are one group; the one with most code points stays
    assert by[2]["keep_id"] == by[3]["keep_id"] == 4 and by[4]["kept"] and by[4]["group_size"] == 3
    assert by[8]["group_size"] == 1 and by[9]["group_size"] == 1
    assert D.exact_dedup(no_rows(spark)).count() == 0


def test_filter_keeps_one_row_of_each_group(spark):
    df = awkward(spark, clash=True)
    out = D.dedup_filter(df)
    assert out.columns == df.columns
    assert sorted(r["doc_id"] for r in out.collect()) == [1, 4, 5, 6, 8, 9, 10, 11, 12]
    assert D.dedup_filter(no_rows(spark)).count() == 0


def test_many_runs_and_a_hot_group(spark):
    rows = [(k, "same text" if k % 3 == 0 else f"text {k}") for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(100)
    got = {r["doc_id"]: r for r in D.exact_dedup(df).collect()}
    assert got[99]["keep_id"] == 0 and got[99]["group_size"] == 100 and sum(r["kept"] for r in got.values()) == 201


def test_runs_are_merged_in_binomial_rounds(spark):
    rows = [(k, f"text {k % 50}") for k in range(400)]
    runs = D.digest_runs(spark.createDataFrame(rows, "doc_id long, text string").repartition(70))
    assert runs.select("run").distinct().count() > 60
    for n_runs in (70, 513, 4097):
        merged = D.merge_runs(runs, n_runs).collect()
        assert len(merged) == 50 and all(r["group_size"] == 8 and r["mismatches"] == 0 and r["best"]["doc_id"] < 50 for r in merged)


def test_numbers_of_runs_far_apart_meet(spark):
    # runs 0, 7, 8, 63, 64, 511, 512 and 4095 meet in different rounds
    runs = D.digest_runs(spark.createDataFrame([(k, "same") for k in range(8)], "doc_id long, text string"))
    far = F.element_at(F.array(*map(F.lit, (0, 7, 8, 63, 64, 511, 512, 4095))), (F.col("doc_id") + 1).cast("int")).cast("long")
    (one,) = D.merge_runs(runs.withColumn("run", far), 4096).collect()
    assert one["group_size"] == 8 and one["best"]["doc_id"] == 0 and one["mismatches"] == 0


def test_rounds_keep_the_order_of_the_runs(spark):
    runs = saved(D.digest_runs(spark.range(100).selectExpr("id AS doc_id", "concat('text ', id) AS text")), "runs")

    def steps(n_runs: int) -> tuple[int, int, int]:
        plan = D.merge_runs(runs, n_runs)._jdf.queryExecution().sparkPlan()
        plan = runs.sparkSession._jvm.org.apache.spark.sql.execution.QueryExecution.prepareExecutedPlan(runs.sparkSession._jsparkSession, plan).toString()
        lines = [x.strip(" +-:*()0123456789") for x in plan.splitlines()]
        return tuple(sum(x.startswith(name) for x in lines) for name in ("Exchange", "Sort ", "SortAggregate"))

    # one round: a sorted run per partition, a shuffle, the merge
    assert steps(8) == (1, 2, 2)
    # any number of rounds: one more shuffle and one more sort in all
    for n_runs in (64, 512, 1 << 20):
        exchanges, sorts, merges = steps(n_runs)
        assert (exchanges, sorts) == (2, 3) and merges >= 1 + len(f"{n_runs - 1:o}")


def test_mismatches_are_counted_and_kept_apart(spark, monkeypatch):
    # a digest of sixteen values only: what meets is verified by the second hash and the length
    monkeypatch.setattr(D, "digest", lambda norm: F.substring(F.sha2(norm, 256), 1, 1))
    rows = [(k, f"text {k % 60}") for k in range(240)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(20)
    merged = D.merge_runs(D.digest_runs(df), 20).collect()
    texts: dict[str, set] = {}
    for _, t in rows:
        texts.setdefault(hashlib.sha256(t.replace(" ", "").encode()).hexdigest()[0], set()).add(t)
    assert {r["text_sha256"]: r["mismatches"] > 0 for r in merged} == {k: len(v) > 1 for k, v in texts.items()}
    got = {r["doc_id"]: r for r in D.exact_dedup(df).collect()}
    assert {i: (r["keep_id"], r["group_size"], r["kept"]) for i, r in got.items()} == {i: (i % 60, 4, i < 60) for i in range(240)}
