from __future__ import annotations

import re

import corpus_pipeline as C
from siftmark.llm import packing, vocab
from tests.llm.helpers import awkward, base_spans, links


def test_stages_one_by_one(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns = docs.columns
    rows = {0: {r["doc_id"]: r for r in docs.collect()}}
    for k, (name, stage) in enumerate(C.STAGES[:-1], 1):
        stage(spark, docs, small).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == columns
        rows[k] = {r["doc_id"]: r for r in docs.collect()}
    # language: texts with letters stay, unless they lie between languages
    assert len(rows[1]) >= 0.98 * sum(bool(re.search("[A-Za-z]", r["text"] or "")) for r in rows[0].values())
    # copies: one of each text without white space, the longest, then the smallest id
    groups: dict[str, list] = {}
    for i, r in rows[1].items():
        groups.setdefault(re.sub("[\x20\x09-\x0d]", "", r["text"]), []).append((-len(r["text"]), i))
    assert set(rows[2]) == {min(g)[1] for g in groups.values()}
    # near copies: the smallest of each component
    assert set(rows[3]) == {i for i, (_, root, _) in links([(i, r["text"]) for i, r in rows[2].items()]).items() if i == root}
    # personal data: gone, and texts without any are as they were
    for i, r in rows[3].items():
        new = rows[4][i]["text"]
        if base_spans(r["text"]):
            assert not any(v in new for *_, v in base_spans(r["text"])) and rows[4][i]["n_chars"] == len(new)
        else:
            assert new == r["text"]
    tokenizer, _ = vocab.load(vocab.default_path(packing.TOKENIZER))
    packed = C.STAGES[-1][1](spark, docs, small).collect()
    want = {i: len(tokenizer.encode(r["text"], add_special_tokens=False).ids) + 1 for i, r in rows[4].items()}
    got: dict[int, int] = {}
    for r in packed:
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["length"]
    assert got == want


def test_run(spark, small):
    assert C.run(spark, small).count() > 0


def test_awkward_rows_go_through(spark, small):
    docs = awkward(spark, clash=True)
    for _, stage in C.STAGES:
        docs = stage(spark, docs, small)
    left = {r["doc_id"] for r in docs.collect()}
    # texts without letters, copies (7) and near copies (6, 9) are gone
    assert {1, 5} <= left <= {1, 5, 8, 11, 12}


def test_empty(spark, small):
    docs = awkward(spark).filter("false")
    for _, stage in C.STAGES:
        docs = stage(spark, docs, small)
    assert docs.count() == 0
