"""Command line: ``python -m siftmark.cli COMMAND --help``. Inputs and outputs are paths that Spark can open."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftmark.config import CATEGORIES, CleanConfig, FusionConfig, KnowledgeConfig, SplitConfig, load
from siftmark.functions import parsing as P
from siftmark.functions import scores as S
from siftmark.functions.text import word_count
from siftmark.operators import calibration, cleaning, credibility, fusion, hardset, knowledge, labeling, lexicon, matching, metrics, sampling
from siftmark.sources import files
from siftmark.sources.scratch import stored

TEXTS = "id string, text string, coarse_label int, subtype_label array<string>, coarse_response string, subtype_response string, split string"


def _texts(spark: SparkSession, path: str) -> DataFrame:
    return files.json_lines(spark, path, TEXTS)


def _lexicon(spark: SparkSession, folder: str) -> matching.Lexicon:
    return matching.lexicon_of(files.lexicon_lines(spark, {c: f"{folder}/{c}.txt" for c in CATEGORIES}))


def _rules(spark: SparkSession, folder: str) -> list[tuple[str, str]]:
    path = f"{folder}/regex_patterns.txt"
    return [tuple(r) for r in files.rule_lines(spark, path).collect()] if files.exists(spark, path) else []


def _joined(spark: SparkSession, a) -> DataFrame:
    p = files.predictions(spark, a.predictions)
    p = p.withColumns({"p0": F.col("pred_probs")[0], "p1": F.col("pred_probs")[1]})
    q = files.posteriors(spark, a.knowledge, a.knowledge_source).withColumnRenamed(a.knowledge_source, "q0")
    return fusion.join_posteriors(p, q)


def ingest(spark, a):
    """Text files to JSON lines; ids go on after the largest one in the output."""
    last = -1
    if files.exists(spark, a.output):
        last = cleaning.max_id(files.json_lines(spark, a.output, "id string")).first()["max_id"]
    files.write_json_lines(files.text_files(spark, a.input, max(a.start_id, last + 1)), a.output, append=True)


def clean(spark, a):
    if a.skip_existing and files.exists(spark, a.output):
        return
    config = load(CleanConfig, a.config, "data_cleaning", min_length=a.min_length, max_length=a.max_length)
    rows = cleaning.clean_rows(_texts(spark, a.input).select("id", "text", files.position().alias("__pos")), config)
    files.write_json_lines(cleaning.dedup_keep_first(rows, ["__pos"]).drop("__pos"), a.output)


def label(spark, a):
    """Coarse labels or subtypes by the rule backend; what the output has already isn't asked again."""
    rows = _texts(spark, a.input)
    done = _texts(spark, a.output).select("id") if files.exists(spark, a.output) else None
    words = _lexicon(spark, a.lexicon_dir)
    if a.subtypes:
        task = labeling.LabelTask("subtype", P.subtypes, a.batch_size, a.max_retries)
        rows = labeling.sensitive(rows).drop("subtype_label", "subtype_response")
    else:
        task = labeling.LabelTask("coarse", P.binary_label, a.batch_size, a.max_retries)
        rows = rows.drop("coarse_label", "coarse_response")
    files.write_json_lines(labeling.run_task(rows, labeling.RuleBackend(words, a.subtypes), task, done), a.output, append=True)


def split(spark, a):
    config = SplitConfig(a.train_ratio, a.dev_ratio, a.test_ratio, a.random_seed)
    rows = _texts(spark, a.input).drop("split")
    sampling.stratified_split(rows, "id", a.stratify_field or None, config).write.mode("overwrite").partitionBy("split").json(a.output)


def q0(spark, a):
    given = {k: getattr(a, k) for k in ("porn_weight", "politics_weight", "abuse_weight", "base_prob", "max_prob", "min_matches")}
    config = load(KnowledgeConfig, a.config, "q0", **given, use_regex=a.use_regex or None)
    rows = knowledge.with_q0(_texts(spark, a.input), _lexicon(spark, a.lexicon_dir), config, _rules(spark, a.lexicon_dir), not a.no_details)
    files.write_json_lines(rows.drop("n_porn", "n_politics", "n_abuse"), a.output)


def eval_q0(spark, a):
    x = files.json_lines(spark, a.input, "id string, coarse_label int, q0 array<double>")
    if a.baseline:
        base = files.json_lines(spark, a.baseline, "id string, coarse_label int")
        x = knowledge.labels_or_fallback(x, base, bool(x.filter("coarse_label IS NOT NULL").head(1)))
    files.write_report(knowledge.q0_quality(x), a.output)


def search_q0(spark, a):
    rows = matching.with_counts(_texts(spark, a.input).filter(F.length("text") > 0), _lexicon(spark, a.lexicon_dir))
    files.write_csv(knowledge.grid_search(rows.withColumn("words", word_count(F.col("text"))), a.mode), a.output)


def uncertainty(spark, a):
    """Predictions with u added, or their bucket table."""
    x = files.json_lines(spark, a.input, "id string, text string, coarse_label int, pred_label int, pred_prob double, pred_probs array<double>")
    x = x.withColumns({"uncertainty": S.uncertainty(F.col("pred_probs"), a.metric), "max_prob": F.array_max("pred_probs")})
    if a.buckets:
        files.write_csv(calibration.uncertainty_buckets(x, a.n_buckets), a.buckets)
    files.write_json_lines(x, a.output)


def calibrate(spark, a):
    x = files.predictions(spark, a.input, drop_falsy_id=False).withColumn("p1", F.col("pred_probs")[1])
    files.write_csv(calibration.calibration_buckets(x, n=a.n_buckets), a.output)
    files.write_report(calibration.calibration_errors(x, n=a.n_buckets), f"{a.output}.errors")


def report(spark, a):
    """Classification metrics, and the confident errors if asked for."""
    x = files.predictions(spark, a.input, drop_falsy_id=False)
    files.write_report(x.agg(*metrics.named(metrics.binary(F.col("coarse_label"), F.col("pred_label")))), a.output)
    if a.errors:
        files.write_json_lines(hardset.high_confidence_errors(x, a.confidence_threshold), a.errors)


def hard(spark, a):
    teacher = files.json_lines(spark, a.teacher, "id string, teacher_label int")
    files.write_json_lines(hardset.hard_set(hardset.disagreements(files.predictions(spark, a.input), teacher), a.max_size), a.output)


def alpha_search(spark, a):
    rows = _joined(spark, a)
    buckets = files.csv_table(spark, a.buckets) if a.buckets and files.exists(spark, a.buckets) else calibration.auto_buckets(rows)
    found = fusion.alpha_grid_search(fusion.assign_buckets(rows, buckets), ["bucket_id"], tuple(a.alpha_grid), a.metric)
    best = fusion.best_alpha(found, ["bucket_id"], a.metric)
    files.write_csv(buckets.join(best, "bucket_id").join(fusion.alpha_pivot(found, ["bucket_id"], tuple(a.alpha_grid)), "bucket_id"), a.output)


def alpha_fit(spark, a):
    fitted = fusion.fit_monotone(files.csv_table(spark, a.input), "u_mean", "alpha_star")
    files.write_report(fusion.lut(fitted, a.lut_points).orderBy("pos"), a.output)


def _alpha(spark, path):
    table = spark.read.json(path)
    return S.lut_alpha(F.col("uncertainty"), fusion.lut_pairs(table))


def evaluate(spark, a):
    """Baseline, fixed and fused metrics, over all rows and by slice, and what fusion gains."""
    rows = _joined(spark, a)
    alpha = fusion.gated(rows, _alpha(spark, a.lut), a.knowledge_threshold, a.use_consistency_gating)
    methods = {"baseline": None, "emg": alpha} | {f"fixed_alpha_{x}": F.lit(float(x)) for x in a.fixed_alpha}
    every = fusion.evaluate(rows, methods)
    sliced = fusion.evaluate(rows.withColumn("dataset", fusion.u_slice(F.col("uncertainty"))), {"baseline": None, "emg": alpha}, ["dataset"])
    files.write_csv(every.withColumn("dataset", F.lit("all")).unionByName(sliced), a.output)
    files.write_report(fusion.compare_methods(every, against=tuple(m for m in methods if m != "emg")), f"{a.output}.gain")


def threshold(spark, a):
    found = fusion.threshold_search(_joined(spark, a), _alpha(spark, a.lut), tuple(a.threshold_grid))
    files.write_csv(found, a.output)
    files.write_report(fusion.best_threshold(found, a.metric), f"{a.output}.best")


def features(spark, a):
    rows = matching.with_counts(_texts(spark, a.input).filter(F.length("text") > 0), _lexicon(spark, a.lexicon_dir))
    x = credibility.with_features(rows).withColumn("label", F.col("coarse_label"))
    files.write_csv(x.select("id", "text", "coarse_label", *credibility.FEATURES, "label"), a.output)


def credible(spark, a):
    """Trains the credibility classifier on a features table and writes q_PKRI of all its rows; the model goes beside it."""
    x = files.csv_table(spark, a.input).withColumn("label", F.coalesce("label", "coarse_label", F.lit(0)).cast("double"))
    model = credibility.train(x)
    model.write().overwrite().save(f"{a.output}.model")
    n = {c: F.col(f"lexicon_match_{c}") for c in CATEGORIES}
    out = credibility.predict(model, x, a.mapping)
    q = None
    if a.q0:
        known = files.posteriors(spark, a.q0).select(F.col("id").alias("__q"), F.col("q0")[1].alias("__p"))
        out, q = out.join(known, F.col("id") == F.col("__q"), "left"), F.col("__p")
    p = S.credible(n, F.col("confidence"), a.build_method, q)
    files.write_json_lines(out.select(F.col("id").cast("string").alias("id"), S.pair(p).alias("qpkri"), "confidence"), a.output)


def clean_lexicon(spark, a):
    """Lexicon files without repeats, by length and then by word; in place with a backup copy, unless an output folder is given. Statistics go beside them."""
    to = a.output or a.lexicon_dir
    words = stored(files.lexicon_lines(spark, {c: f"{a.lexicon_dir}/{c}.txt" for c in CATEGORIES}, distinct=False), "lexicon")
    files.write_report(lexicon.stats(words), f"{to.rstrip('/')}.stats")
    for c in CATEGORIES:
        if files.exists(spark, f"{a.lexicon_dir}/{c}.txt"):
            files.write_words(lexicon.dedup(words.filter(F.col("category") == c)), f"{to}/{c}.txt", backup=not a.no_backup)


#: command -> (function, options as (name, settings)); options without a default are required.
PAIR = (("input", {}), ("output", {}))
KNOWN = (("predictions", {}), ("knowledge", {}), ("output", {}), ("knowledge-source", {"default": "q0", "choices": ["q0", "qpkri"]}))
FUSION = FusionConfig()
COMMANDS = {
    "ingest": (ingest, (*PAIR, ("start-id", {"type": int, "default": 0}))),
    "clean": (clean, (*PAIR, ("config", {"default": ""}), ("min-length", {"type": int, "default": None}), ("max-length", {"type": int, "default": None}), ("skip-existing", {"action": "store_true"}))),
    "label": (label, (*PAIR, ("lexicon-dir", {}), ("batch-size", {"type": int, "default": 10}), ("max-retries", {"type": int, "default": 3}), ("subtypes", {"action": "store_true"}))),
    "split": (split, (*PAIR, ("train-ratio", {"type": float, "default": 0.8}), ("dev-ratio", {"type": float, "default": 0.1}), ("test-ratio", {"type": float, "default": 0.1}),
                      ("random-seed", {"type": int, "default": 42}), ("stratify-field", {"default": "coarse_label"}))),
    "q0": (q0, (*PAIR, ("lexicon-dir", {}), ("config", {"default": ""}), *((n, {"type": float, "default": None}) for n in ("porn-weight", "politics-weight", "abuse-weight", "base-prob", "max-prob")),
                ("min-matches", {"type": int, "default": None}), ("use-regex", {"action": "store_true"}), ("no-details", {"action": "store_true"}))),
    "eval-q0": (eval_q0, (*PAIR, ("baseline", {"default": ""}))),
    "search-q0": (search_q0, (*PAIR, ("lexicon-dir", {}), ("mode", {"default": "fast", "choices": list(knowledge.GRIDS)}))),
    "uncertainty": (uncertainty, (*PAIR, ("metric", {"default": "u_max", "choices": ["u_max", "u_entropy", "u_margin"]}), ("n-buckets", {"type": int, "default": 10}), ("buckets", {"default": ""}))),
    "calibrate": (calibrate, (*PAIR, ("n-buckets", {"type": int, "default": 10}))),
    "report": (report, (*PAIR, ("errors", {"default": ""}), ("confidence-threshold", {"type": float, "default": 0.8}))),
    "hard-set": (hard, (*PAIR, ("teacher", {}), ("max-size", {"type": int, "default": 2000}))),
    "alpha-search": (alpha_search, (*KNOWN, ("buckets", {"default": ""}), ("alpha-grid", {"type": float, "nargs": "+", "default": list(FUSION.alpha_grid)}), ("metric", {"default": "f1", "choices": ["f1", "nll"]}))),
    "alpha-fit": (alpha_fit, (*PAIR, ("lut-points", {"type": int, "default": FUSION.lut_points}))),
    "evaluate": (evaluate, (*KNOWN, ("lut", {}), ("fixed-alpha", {"type": float, "nargs": "*", "default": [0.5]}), ("knowledge-threshold", {"type": float, "default": None}), ("use-consistency-gating", {"action": "store_true"}))),
    "threshold-search": (threshold, (*KNOWN, ("lut", {}), ("threshold-grid", {"type": float, "nargs": "+", "default": list(FUSION.threshold_grid)}), ("metric", {"default": "f1", "choices": ["f1", "nll"]}))),
    "features": (features, (*PAIR, ("lexicon-dir", {}))),
    "credibility": (credible, (*PAIR, ("mapping", {"default": "tanh", "choices": ["raw", "tanh", "piecewise"]}),
                               ("build-method", {"default": "improved_weighted", "choices": ["original", "improved_weighted", "offset", "q0_based"]}), ("q0", {"default": ""}))),
    "clean-lexicon": (clean_lexicon, (("lexicon-dir", {}), ("output", {"default": ""}), ("no-backup", {"action": "store_true"}))),
}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="siftmark", description=__doc__)
    sub = top.add_subparsers(dest="command", required=True)
    for name, (f, options) in COMMANDS.items():
        p = sub.add_parser(name, help=f.__doc__)
        for option, settings in options:
            p.add_argument(f"--{option}", **settings, **({} if "default" in settings or "action" in settings else {"required": True}))
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(argv)
    COMMANDS[a.command][0](spark or SparkSession.builder.appName("siftmark").getOrCreate(), a)


if __name__ == "__main__":
    main()
