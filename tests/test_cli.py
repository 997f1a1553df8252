"""The commands, one after another, over files."""

from __future__ import annotations

import json

from siftmark import cli
from siftmark.operators import lexicon


def test_from_files_to_evaluation(spark, tmp_path):
    src, lex = tmp_path / "src", tmp_path / "lex"
    src.mkdir()
    lex.mkdir()
    for k in range(40):
        (src / f"{k:02d}.txt").write_text(f"text number {k} " + ("idiot scum" if k % 4 == 0 else "nice day"))
    (lex / "abuse.txt").write_text("idiot\nscum\nidiot\n")

    def run(command: str, **options):
        args = [command]
        for k, v in options.items():
            args += [f"--{k.replace('_', '-')}", *([] if v is True else map(str, v if isinstance(v, list) else [v]))]
        cli.main(args, spark)

    at = {n: str(tmp_path / n) for n in "raw clean coarse sub split q0 q0e q0s pred u b cal rep hard alpha lut eval thr feat cred lexout teacher".split()}
    run("ingest", input=src, output=at["raw"])
    run("clean", input=at["raw"], output=at["clean"])
    run("clean", input=at["raw"], output=at["clean"], skip_existing=True)
    assert spark.read.json(at["clean"]).count() == 40
    for _ in range(2):  # the second run finds nothing to do
        run("label", input=at["clean"], output=at["coarse"], lexicon_dir=lex)
    rows = {r["id"]: r["coarse_label"] for r in spark.read.json(at["coarse"]).collect()}
    assert len(rows) == 40 and sum(rows.values()) == 10
    run("label", input=at["coarse"], output=at["sub"], lexicon_dir=lex, subtypes=True)
    assert spark.read.json(at["sub"]).count() == 10
    run("split", input=at["coarse"], output=at["split"])
    assert spark.read.json(at["split"]).filter("split = 'train'").count() == 32
    run("q0", input=at["coarse"], output=at["q0"], lexicon_dir=lex)
    run("eval-q0", input=at["q0"], output=at["q0e"])
    assert spark.read.json(at["q0e"]).first()["recall"] == 1
    run("search-q0", input=at["coarse"], output=at["q0s"], lexicon_dir=lex)
    preds = [{"id": i, "text": "t", "coarse_label": y, "pred_label": int(k % 3 == 0), "pred_prob": 0.6 + k / 200, "pred_probs": [0.4 - k / 200, 0.6 + k / 200] if k % 3 == 0 else [0.6 + k / 200, 0.4 - k / 200]} for k, (i, y) in enumerate(sorted(rows.items()))]
    (tmp_path / "pred").write_text("\n".join(map(json.dumps, preds)))
    run("uncertainty", input=at["pred"], output=at["u"], buckets=at["b"])
    run("calibrate", input=at["u"], output=at["cal"])
    run("report", input=at["u"], output=at["rep"], errors=at["rep"] + "e")
    (tmp_path / "teacher").write_text("\n".join(json.dumps({"id": i, "teacher_label": y}) for i, y in rows.items()))
    run("hard-set", input=at["u"], output=at["hard"], teacher=at["teacher"])
    assert spark.read.json(at["hard"]).count() > 0
    known = {"predictions": at["u"], "knowledge": at["q0"]}
    run("alpha-search", **known, output=at["alpha"], buckets=at["b"])
    run("alpha-fit", input=at["alpha"], output=at["lut"])
    run("evaluate", **known, output=at["eval"], lut=at["lut"], use_consistency_gating=True, fixed_alpha=[0.25, 0.5])
    assert spark.read.option("header", True).csv(at["eval"]).filter("method = 'emg' AND dataset = 'all'").count() == 1
    run("threshold-search", **known, output=at["thr"], lut=at["lut"])
    run("features", input=at["coarse"], output=at["feat"], lexicon_dir=lex)
    run("credibility", input=at["feat"], output=at["cred"], build_method="q0_based", q0=at["q0"])
    assert spark.read.json(at["cred"]).count() == 40
    (lex / "porn.txt").write_text("bb\na\n\nbb \nA\na\n")
    run("clean-lexicon", lexicon_dir=lex)
    assert (lex / "porn.txt").read_text().split("\n")[:-1] == ["A", "a", "bb"] and (lex / "porn.txt.backup").read_text().startswith("bb")
    assert (lex / "abuse.txt").read_text() == "scum\nidiot\n"
    stats = {r["category"]: (r["original"], r["unique"], r["duplicate"]) for r in spark.read.json(f"{lex}.stats").collect()}
    assert stats == {"porn": (5, 3, 2), "abuse": (3, 2, 1), "total": (8, 5, 3)}
    run("clean-lexicon", lexicon_dir=lex, output=at["lexout"], no_backup=True)
    assert (tmp_path / "lexout" / "porn.txt").read_text() == "A\na\nbb\n"


class Words:
    def answer(self, texts):
        return ["1. spam\n2. old"] * len(texts)


class Rules:
    def answer(self, texts):
        return ["f[u*]n|fun\nnobar"] * len(texts)


def test_generation(spark):
    samples = spark.createDataFrame([("1", "t", "abuse"), ("2", "u", "abuse")], "id string, text string, category string")
    old = spark.createDataFrame([("abuse", "old")], "category string, word string")
    assert [tuple(r) for r in lexicon.generate(samples, Words(), old).collect()] == [("abuse", "spam")]
    assert [tuple(r) for r in lexicon.generate_rules(samples, Rules()).collect()] == [("f[u*]n", "fun")]
