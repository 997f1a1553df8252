"""Operators on small fixtures, with awkward rows."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from siftmark.config import SplitConfig
from siftmark.functions import parsing as P
from siftmark.operators import anchors, calibration, cleaning, credibility, fusion, hardset, knowledge, labeling, lexicon, matching, metrics, sampling
from siftmark.sources import files
from siftmark.streaming import incremental


def test_clean_stats_and_dedup(spark):
    df = spark.createDataFrame([("s0", "这是一个测试文本"), ("s1", "短"), ("s2", "这是一个测试文本")], "id string, text string")
    assert cleaning.clean_stats(df).first().asDict() == {"total": 3, "processed": 2, "filtered": 1, "deduplicated": 1, "output": 1}
    assert [r["id"] for r in cleaning.dedup_keep_first(cleaning.clean_rows(df), ["id"]).collect()] == ["s0"]
    empty = df.filter("false")
    assert cleaning.clean_stats(empty).first()["output"] == 0


def test_ids(spark):
    df = spark.createDataFrame([("s12",), ("s7",), ("x9",), (None,)], "id string")
    assert cleaning.max_id(df).first()["max_id"] == 12
    assert cleaning.max_id(df.filter("false")).first()["max_id"] == -1
    rows = spark.range(100).select(F.format_string("f%03d", "id").alias("path"))
    got = {r["path"]: r["id"] for r in cleaning.assign_ids(rows, "path", 13).collect()}
    assert got["f000"] == "s13" and got["f099"] == "s112" and len(set(got.values())) == 100


def brute(text: str, words) -> int:
    return sum(text.lower().startswith(w, i) for w in words for i in range(len(text)))


LEX = {"porn": ("aa", "xyz"), "politics": (), "abuse": ("aba", "é")}


def test_matching_ways_agree(spark):
    texts = ["aaaa", "ABABA xyzé", "", None, "none", "aabaa" * 50]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    cols = ["n_porn", "n_politics", "n_abuse"]
    built_in = {r["id"]: [r[c] for c in cols] for r in matching.with_counts(df, LEX).collect()}
    automaton = {r["id"]: [r[c] for c in cols] for r in matching.automaton_counts(df, LEX).collect()}
    for i, t in enumerate(texts):
        if t is not None:
            want = [brute(t, LEX[c]) for c in ("porn", "politics", "abuse")]
            assert built_in[i] == want and automaton[i] == want
    words = spark.createDataFrame([(c, w) for c, ws in LEX.items() for w in ws], "category string, word string")
    grams = {(r["id"], r["word"]): r["n"] for r in anchors.word_matches(df, words).collect()}
    assert grams[(0, "aa")] == 3 and grams[(1, "aba")] == 2 and (3, "aa") not in grams
    distinct = matching.with_counts(df, LEX, mode="distinct").filter("id = 0").first()
    assert distinct["n_porn"] == 1


def test_rules(spark):
    rules = [("f[u*]ck", "a"), ("(", "bad"), ("cao", "b")]
    df = spark.createDataFrame([("F*CK cao",), ("none",)], "t string")
    assert [r[0] for r in df.select(matching.regex_hits(F.col("t"), rules)).collect()] == [["a", "b"], []]


def test_q0_details(spark):
    df = spark.createDataFrame([(1, "xyz aaa"), (2, "none"), (3, "")], "id int, text string")
    rows = {r["id"]: r for r in knowledge.with_q0(df, LEX, details=True).collect()}
    assert set(rows) == {1, 2}
    assert rows[1]["q0_details"]["porn_matches"] == ["aa", "aa", "xyz"] and rows[2]["q0"][1] == 0.17
    assert sum(rows[1]["q0"]) == pytest.approx(1)


@pytest.mark.parametrize("seed", [42, 7])
def test_split(spark, seed):
    df = spark.range(100).select(F.col("id").cast("string").alias("id"), (F.col("id") % 2).cast("int").alias("y"))
    config = SplitConfig(seed=seed)
    got = sampling.stratified_split(df, "id", "y", config)
    n = {r["split"]: r["n"] for r in sampling.split_stats(got, "y").collect()}
    assert n == {"train": 80, "dev": 10, "test": 10}
    again = {r["id"]: r["split"] for r in sampling.stratified_split(df.repartition(3), "id", "y", config).collect()}
    assert again == {r["id"]: r["split"] for r in got.collect()}
    assert got.filter("split = 'dev' AND y = 1").count() == 5
    some = df.withColumn("y", F.when(F.col("id") != "3", F.col("y")))
    assert sampling.stratified_split(some, "id", "y", config).count() == 100
    assert sampling.stratified_split(df.filter("false"), "id", "y", config).count() == 0


def test_metrics_edge_cases(spark):
    df = spark.createDataFrame([(1, 0), (None, 1)], "y int, p int")
    row = df.agg(*metrics.named(metrics.binary(F.col("y"), F.col("p")))).first()
    assert row["precision"] == 0 and row["f1"] == 0 and row["n"] == 1
    one_class = spark.createDataFrame([(1, 0.4), (1, 0.2)], "y int, s double")
    assert metrics.auc(one_class, "y", "s").first()["auc"] == 0
    tied = spark.createDataFrame([(1, 0.5), (0, 0.5), (1, 0.9), (0, 0.1)], "y int, s double")
    assert metrics.auc(tied, "y", "s").first()["auc"] == pytest.approx(0.875)


def test_calibration(spark):
    df = spark.createDataFrame([(1, 0.85)] * 10 + [(0, 0.15)] * 10, "coarse_label int, p1 double")
    r = calibration.calibration_errors(df).first()
    assert r["ece"] == pytest.approx(0.15) and r["mce"] == pytest.approx(0.15) and r["brier"] == pytest.approx(0.0225)
    assert calibration.calibration_errors(df.filter("false")).first()["ece"] == 0
    assert calibration.quantile_buckets(df.withColumnRenamed("p1", "uncertainty"), 2).count() == 2


def test_monotone_fit(spark):
    pts = spark.createDataFrame([(0.05, 0.8), (0.15, 0.9), (0.25, 0.5), (0.35, 0.3), (0.45, 0.2)], "u double, alpha double")
    fit = [r["fitted"] for r in fusion.fit_monotone(pts).orderBy("u").collect()]
    assert fit == pytest.approx([0.85, 0.85, 0.5, 0.3, 0.2])
    table = fusion.lut(fusion.fit_monotone(pts), 20).orderBy("pos").collect()
    assert table[0]["alpha"] == pytest.approx(0.85) and table[-1]["alpha"] == pytest.approx(0.2) and len(table) == 20
    assert fusion.lut(fusion.fit_monotone(pts.filter("false"))).count() == 0


def test_best_alpha_takes_the_first_of_equals(spark):
    s = spark.createDataFrame([(0, 0, 0.5, 0.9, 0.1), (0, 1, 0.75, 0.9, 0.05), (0, 2, 1.0, 0.8, 0.05)], "b int, pos int, alpha double, f1 double, nll double")
    assert fusion.best_alpha(s, ["b"]).first()["alpha_star"] == 0.5
    assert fusion.best_alpha(s, ["b"], "nll").first()["alpha_star"] == 0.75


def test_evaluate_and_gates(spark):
    rows = [("s1", 1, 0.2, 0.8, 0.2, 0.1, 0.9), ("s2", 0, 0.9, 0.1, 0.1, 0.8, 0.2), ("s3", None, 0.5, 0.5, 0.5, 0.5, 0.5)]
    df = spark.createDataFrame(rows, "id string, coarse_label int, p0 double, p1 double, uncertainty double, q0 double, q1 double")
    out = {r["method"]: r for r in fusion.evaluate(df, {"baseline": None, "emg": F.lit(0.5)}).collect()}
    assert out["baseline"]["accuracy"] == 1 and out["emg"]["n_samples"] == 2 and out["emg"]["nll"] < out["baseline"]["nll"]
    assert fusion.evaluate(df.filter("false"), {"baseline": None}).count() == 0
    gate = df.select(fusion.gated(df, F.lit(0.5), 0.85, True).alias("a")).collect()
    assert [r["a"] for r in gate] == [0.5, 1.0, 1.0]
    assert fusion.compare_methods(fusion.evaluate(df, {"baseline": None, "emg": F.lit(0.5)})).first()["nll_reduction"] > 0


def test_hard_set(spark):
    p = [("s1", 1, 0, 0.5), ("s2", 1, 0, 0.9), ("s3", 1, 0, 0.7), ("s4", 1, 1, 0.9)]
    df = spark.createDataFrame(p, "id string, coarse_label int, pred_label int, pred_prob double")
    teacher = spark.createDataFrame([("s1", 1), ("s2", 1), ("s3", 1), ("s4", None)], "id string, teacher_label int")
    found = hardset.disagreements(df, teacher)
    assert [r["id"] for r in hardset.hard_set(found).collect()] == ["s2", "s3", "s1"]
    assert hardset.hard_set(found, 1).count() == 1
    assert found.filter("id = 's2'").first()["disagreement_type"] == ["baseline_wrong_teacher_correct", "high_conf_error", "prediction_mismatch"]


class Backend:
    """Refuses some texts, breaks on others, and gives short batches."""

    def __init__(self, mode: str):
        self.mode = mode

    def answer(self, texts):
        if "bad" in texts:
            raise labeling.Refused("安全")
        if "down" in texts:
            raise OSError("no network")
        return ["1"] if self.mode == "short" and len(texts) > 1 else ["1"] * len(texts)


@pytest.mark.parametrize("mode", ["whole", "short"])
def test_label_task(spark, mode):
    df = spark.createDataFrame([(1, "a"), (2, "bad"), (3, "down"), (4, ""), (5, None), (6, "b")], "id int, text string").coalesce(1)
    done = spark.createDataFrame([(6, 1)], "id int, coarse_label int")
    out = labeling.run_task(df, Backend(mode), labeling.LabelTask("coarse", P.binary_label, max_retries=2), done)
    got = {r["id"]: (r["coarse_label"], r["coarse_response"]) for r in out.collect()}
    assert got == {1: (1, "1"), 2: (1, "[BLOCKED: 安全]"), 3: (None, None)}
    assert labeling.task_stats(df, out, done, "coarse").first().asDict() == {"total": 6, "skipped": 1, "success": 2, "failed": 1}


class LastWord:
    """Answers with the last word of each text; gives a short batch if told so."""

    def __init__(self, short: bool = False):
        self.short = short

    def answer(self, texts):
        return [t.split()[-1] for t in texts][: 1 if self.short else None]


def test_only_label_batches_are_shortened(spark):
    df = spark.createDataFrame([(i, "x " * n + f"end{i}", "c") for i, n in enumerate([5, 497, 2000, 3000])], "id int, text string, category string").coalesce(1)
    whole = {i: f"end{i}" for i in range(4)}

    def said(backend, **k):
        return {r["id"]: r["t_response"] for r in labeling.run_task(df, backend, labeling.LabelTask("t", lambda c: c, **k)).collect()}

    assert said(LastWord()) == whole | {2: "...[截断]", 3: "...[截断]"}
    assert said(LastWord(short=True)) == said(LastWord(), batch_size=1) == whole
    assert {r["word"] for r in lexicon.generate(df, LastWord()).collect()} == set(whole.values())
    bars = df.withColumn("text", F.concat("text", F.lit("|d")))
    assert {r["pattern"] for r in lexicon.generate_rules(bars, LastWord()).collect()} == set(whole.values())


def test_subtype_merge(spark):
    rows = spark.createDataFrame([("s0", 1), ("s1", 0), ("s2", 1), ("s3", None), ("s4", 1)], "id string, coarse_label int")
    sub = spark.createDataFrame([("s0", ["porn", "abuse"], "r"), ("s2", ["politics"], "r")], "id string, subtype_label array<string>, subtype_response string")
    got = {r["id"]: (r["subtype_label"], r["subtype_response"]) for r in labeling.merge_subtypes(rows, sub).collect()}
    assert got == {"s0": (["porn", "abuse"], "r"), "s1": ([], ""), "s2": (["politics"], "r"), "s3": (None, None), "s4": (None, None)}


def test_category_sample(spark):
    rows = spark.createDataFrame([(str(i), int(i > 0), ["porn"] if i % 2 else ["abuse"]) for i in range(150)], "id string, coarse_label int, subtype_label array<string>")
    assert sampling.category_sample(rows, "porn", 50).count() == 50
    assert sampling.category_sample(rows, "politics", 50).count() == 0


def test_lexicon(spark):
    rows = spark.createDataFrame([("a", "x"), ("a", " x "), ("a", ""), ("b", "yy"), ("b", "z")], "category string, word string")
    got = {r["category"]: (r["original"], r["unique"], r["duplicate"]) for r in lexicon.stats(rows).collect()}
    assert got == {"a": (2, 1, 1), "b": (2, 2, 0), "total": (4, 3, 1)}
    assert [r["word"] for r in lexicon.dedup(rows).filter("category = 'b'").collect()] == ["z", "yy"]
    answers = spark.createDataFrame([("b", "1. z\n2. new")], "category string, response string")
    assert [r["word"] for r in lexicon.keep_returned(rows, answers).collect()] == ["z"]


def test_credibility_empty_and_unlabelled(spark):
    df = spark.createDataFrame([("", None, 0, 0, 0), ("abc def", ["porn"], 0, 2, 2)], "text string, subtype_label array<string>, n_porn int, n_politics int, n_abuse int")
    a, b = credibility.with_features(df).collect()
    assert a["subtype_match_score"] == 1.0 and a["match_density"] == 0 and a["max_match_category_porn"] == 1
    assert b["subtype_match_score"] == 0 and b["max_match_category_politics"] == 1 and b["weighted_source_confidence"] == pytest.approx(0.7)


def test_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, text in (("b.txt", "这是测试文本内容\n"), ("a.txt", "first"), ("c.txt", "  ")):
        (tmp_path / "in" / name).write_text(text, "utf-8")
    got = {r["id"]: r["text"] for r in files.text_files(spark, str(tmp_path / "in"), 5).collect()}
    assert got == {"s5": "first", "s6": "这是测试文本内容"}
    (tmp_path / "p.jsonl").write_text('{"id": "1", "pred_probs": [0.7, 0.3], "uncertainty": 0.3}\n\nbroken\n{"id": "1", "pred_probs": [0.1, 0.9], "uncertainty": 0.1}\n{"id": "2"}\n')
    p = files.predictions(spark, str(tmp_path / "p.jsonl")).collect()
    assert [(r["id"], r["pred_label"]) for r in p] == [("1", 1)]
    with pytest.raises(Exception):  # noqa: B017
        files.json_lines(spark, str(tmp_path / "p.jsonl"), "id string", strict=True).collect()
    (tmp_path / "r.txt").write_text("cao|草|desc\nnobar\n|empty\n")
    assert [tuple(r) for r in files.rule_lines(spark, str(tmp_path / "r.txt")).collect()] == [("cao", "草|desc")]
    (tmp_path / "w.txt").write_text("x\n\n x \ny\n")
    words = files.lexicon_lines(spark, {"porn": str(tmp_path / "w.txt"), "abuse": str(tmp_path / "none.txt")})
    assert matching.lexicon_of(words) == {"porn": ("x", "y"), "politics": (), "abuse": ()}
    files.write_json_lines(words, str(tmp_path / "out"))
    files.write_json_lines(words, str(tmp_path / "out"), append=True)
    assert files.line_count(spark, str(tmp_path / "out")) == 4
    files.write_csv(words, str(tmp_path / "csv"))
    assert files.csv_table(spark, str(tmp_path / "csv")).count() == 2


def test_ingest_twice(spark, tmp_path):
    src, out = tmp_path / "src", str(tmp_path / "out")
    src.mkdir()
    (src / "a.txt").write_text("one")
    for _ in range(2):
        incremental.ingest_new(incremental.text_stream(spark, str(src)), out, str(tmp_path / "cp"), "path")
    (src / "b.txt").write_text("two")
    incremental.ingest_new(incremental.text_stream(spark, str(src)), out, str(tmp_path / "cp2"), "path")
    assert sorted(r["text"] for r in spark.read.parquet(out).collect()) == ["one", "two"]


def test_rules_are_validated_where_they_run(spark):
    rules = [("(?P<x>a)", "python only"), (r"b++", "java only"), ("(", "neither"), ("c", "both")]
    assert [d for _, d in matching.valid_rules(rules)] == ["java only", "both"]
    df = spark.createDataFrame([("abbc",)], "t string")
    assert df.select(matching.regex_hits(F.col("t"), rules)).first()[0] == ["java only", "both"]


def test_words_are_counted_as_by_matching(spark):
    from siftmark.functions import text as T

    texts = ["", " ", "a", " a  b\t\n", "a　b\x1cc d", "\x1f", "中文 x", "a​b", "x " * 1000, None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    want = F.greatest(F.regexp_count("t", F.lit(f"[^{T.BLANKS}]+")), F.lit(1))
    assert all(a == b for a, b in df.filter("t IS NOT NULL").select(T.word_count(F.col("t")), want).collect())


def test_keys_of_the_knowledge_section(tmp_path):
    from siftmark.config import KnowledgeConfig, load

    (tmp_path / "c.yaml").write_text("q0:\n  base_sensitive_prob: 0.2\n  max_sensitive_prob: 0.9\n  min_matches_for_sensitive: 3\n  porn_weight: 2\n")
    got = load(KnowledgeConfig, str(tmp_path / "c.yaml"), "q0", base_prob=0.3)
    assert (got.base_prob, got.max_prob, got.min_matches, got.porn_weight) == (0.3, 0.9, 3, 2)


def test_last_prediction_by_file_and_place(spark, tmp_path):
    for name, p in (("b", 0.2), ("a", 0.9), ("c", 0.4)):
        (tmp_path / f"{name}.jsonl").write_text("".join(f'{{"id": "x{k}", "pred_probs": [{1 - q}, {q}], "uncertainty": 0.1}}\n' for q in (0.7, p) for k in range(50 if name != "c" else 20)))
    got = {r["id"]: r["pred_probs"][1] for r in files.predictions(spark, f"{tmp_path}/*.jsonl").collect()}
    assert got == {f"x{k}": 0.4 if k < 20 else 0.2 for k in range(50)}


def test_calls_are_limited_over_all_tasks(spark):
    import time

    rows = spark.range(6).select(F.col("id"), F.lit("some text").alias("text")).repartition(8)
    t = time.monotonic()
    out = labeling.run_task(rows, labeling.RuleBackend(LEX), labeling.LabelTask("coarse", lambda c: c, 1, calls_per_minute=240))
    assert out.rdd.getNumPartitions() <= labeling.LIMITED and out.count() == 6 and time.monotonic() - t >= 1.0


def test_predictions_drop_what_is_no_id(spark, tmp_path):
    """The number 0 and the empty text are no ids, the text "0" is one; the last of an id wins."""
    from siftmark.sources import files

    lines = ['"id": "0"', '"id": 0', '"id": ""', '"id": null', '"x": 1', '"id": 0.0', '"id": false', '"id": 12', '"id": "12"', '"id": "s5"', '"id": 0.5']
    path = tmp_path / "p.jsonl"
    path.write_text("\n".join(f'{{{x}, "pred_probs": [0.{k + 10}, 0.5], "uncertainty": 0.1}}' for k, x in enumerate(lines)))
    got = {r["id"]: r["pred_probs"][0] for r in files.predictions(spark, str(path)).collect()}
    assert got == {"0": 0.10, "12": 0.18, "s5": 0.19, "0.5": 0.20}
    every = {r["id"] for r in files.predictions(spark, str(path), drop_falsy_id=False).collect()}
    assert {"0", "", "12", "s5", "0.5"} <= every and None not in every


def test_classifier_is_the_minimum_of_its_loss(spark):
    """The gradient of the mean log loss with its penalty is 0 at the fitted coefficients."""
    import numpy as np

    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, len(credibility.FEATURES)))
    y = (x[:, 0] - x[:, 3] + rng.normal(size=300) > 0).astype(float)
    rows = spark.createDataFrame([(*map(float, a), float(b)) for a, b in zip(x, y, strict=True)], [*credibility.FEATURES, "label"])
    model = credibility.train(rows)
    first, second = model.stages[1], model.stages[3]

    def gradient(m, z):
        p = 1 / (1 + np.exp(-(z @ m.coefficients.toArray() + m.intercept)))
        return np.r_[z.T @ (p - y) / len(y) + m.coefficients.toArray() / len(y), (p - y).mean()], p

    g, p = gradient(first, x)
    assert np.abs(g).max() < 1e-6
    g, p = gradient(second, p[:, None])
    assert np.abs(g).max() < 1e-6
    got = np.array([r["probability"] for r in credibility.predict(model, rows).collect()])
    assert got == pytest.approx(p)
