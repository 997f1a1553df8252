from __future__ import annotations

import hashlib
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from siftmark.llm import pii
from tests.llm.helpers import AWKWARD, all_spans, awkward, base_spans, no_rows


def digest(text: str) -> str:
    names = list(pii.KINDS)
    return hashlib.sha256(",".join(f"{names[k]}:{s}:{e}" for s, k, e, _ in base_spans(text)).encode()).hexdigest()


def test_base_spans_of_random_texts(spark):
    rnd = random.Random(3)
    parts = [*"abZ09 1234567890.-+()@%_é\n\U0001F600", "a@b.c", "1.2.3.4", "4111 1111 1111 1111", "+1 (555) 123-4567", "@", "300.1.1.1"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 60))) for _ in range(3000)]
    texts += ["1 " * 5000, "a" * 50_000 + "@", "a@b" + ".c" * 5000, "+1" + " " * 20_000, "1." * 10_000, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r[0]: r[1] for r in pii.find_spans(df).select("doc_id", F.sha2(pii.joined(F.col("base")), 256)).collect()}
    assert [t for i, t in enumerate(texts) if got[i] != digest(t)] == []


def test_documents_against_brute_force(spark, small):
    rows = [(r[0], r[1] or "") for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    got = {r["doc_id"]: r for r in pii.op6_pii(spark, small).collect()}
    assert {i: r["spans"] for i, r in got.items()} == all_spans(rows)
    assert all(got[i]["base_sha256"] == digest(t) for i, t in rows)


def test_revealing_terms(spark):
    rows = [(k, f"Reach agent Zerko at top@secret.org please, number {k}.") for k in range(6)] + [(k, f"Please reach the agent at home {k}.") for k in range(6, 40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r[0]: r[1] for r in pii.find_spans(df).select("doc_id", pii.joined(F.col("spans"))).collect()}
    assert got == all_spans(rows) and "removed:12:17" in got[0] and got[20] == ""
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(df).collect()}
    assert "Zerko" not in clean[0] and "secret.org" not in clean[0] and "[EMAIL]" in clean[0] and clean[20] == rows[20][1]


@pytest.mark.parametrize("forms", [64, 1])
def test_terms_beyond_the_context(spark, monkeypatch, forms):
    monkeypatch.setattr(pii, "FORMS", forms)
    far = "all sorts of words " * 10
    rows = [(k, f"Zerko signs. {far} 12345678 Write to top@secret.org now, ZERKO {far} Zerko") for k in range(5)]
    rows += [(5, "Only Zerko is named here."), (6, "zerkos aren't meant, \U0001F600 ZERKO is"), (7, f"{far} 12345678 now")]
    rows += [(k, f"Write to nobody now, {far} signs {k}") for k in range(8, 200)]
    df = spark.createDataFrame([*rows, rows[0]], "doc_id long, text string").repartition(3)
    got = pii.find_spans(df).select("doc_id", "text_hash", "spans").join(df.select("doc_id", "text").distinct(), "doc_id").collect()
    assert len(got) == len(rows) + 1
    for r in got:
        added = [(r["text"][s["start"] : s["end"]].lower(), s["kind"]) for s in r["spans"] if s["kind"] > 3]
        places = [m.start() for m in re.finditer(r"(?i)\bzerko\b", r["text"])]
        # in 6 of 8 texts beside the entity: ln(201 * 6 / (8 * 6)) / ln(201 / 6) = 0.918
        assert added == [("zerko", 4)] * len(places) and [s["start"] for s in r["spans"] if s["kind"] > 3] == places
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(df).collect()}
    assert not any(re.search(r"(?i)\bzerko\b", t) for t in clean.values()) and clean[5] == "Only [GENERALISED] is named here." and clean[7] == rows[7][1]


def slow_replaced(text: str, spans: list[tuple[int, int, int]]) -> str:
    names, out, at = ["[EMAIL]", "[IP]", "[CARD]", "[PHONE]", "[GENERALISED]", ""], "", 0
    for s, k, e in spans:
        if s >= at:
            out += text[at:s] + names[k]
        at = max(at, e)
    return out + text[at:]


def test_rewriting_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(pii, "BLOCK", 7)
    rnd = random.Random(8)
    parts = [*"ab 09 .-+()@%é\U0001F600", "a@b.c", "1.2.3.4", "4111 1111 1111 1111", "+1 (555) 123-4567", "1.1.1.1.1.1.1.1@x.y", "+1 1.1.1.1 2345678", "éa@b.co"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 40))) for _ in range(600)]
    df = spark.createDataFrame([*enumerate(texts), (1000, None)], "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["text"] for r in pii.sanitise(df).collect()}
    spans = {r["doc_id"]: [(s["start"], s["kind"], s["end"]) for s in r["spans"]] for r in pii.find_spans(df).collect()}
    assert len(got) == 601 and got[1000] is None
    for i, t in enumerate(texts):
        assert [s for s in spans[i] if s[1] < 4] == [x[:3] for x in base_spans(t)] and got[i] == slow_replaced(t, spans[i])
        assert not any(s < z and b < e for s, k, e in spans[i] if k > 3 for b, kk, z in spans[i] if kk < 4)


def test_many_spans_in_one_text_cost_no_more(spark):
    one = [f"Write to user{k}@mail.example.org or call +1 (555) 123-4567 now, {k} times. " for k in range(50_000)]
    giant = spark.createDataFrame([(1, "".join(one))], "doc_id long, text string")
    many = spark.createDataFrame([(k, "".join(one[k * 50 : k * 50 + 50])) for k in range(1000)], "doc_id long, text string").coalesce(1)

    def took(df) -> float:
        t = time.perf_counter()
        assert pii.find_spans(df).select(F.sum(F.size("base"))).first()[0] == 100_000
        assert sum(r["text"].count("[EMAIL]") for r in pii.sanitise(df).select("text").collect()) == 50_000
        return time.perf_counter() - t

    took(many)
    a, b = took(many), took(giant)
    assert b < 2.5 * a + 5, (a, b)


def test_awkward(spark):
    df = awkward(spark, clash=True)
    assert pii.find_spans(df).count() == len(AWKWARD)
    out = pii.sanitise(df)
    assert out.columns == df.columns and sorted(map(tuple, out.select("doc_id", "text").collect()), key=str) == sorted(((r[0], r[1]) for r in AWKWARD), key=str)
    assert pii.find_spans(no_rows(spark)).count() == 0 and pii.sanitise(no_rows(spark)).count() == 0
    two = spark.createDataFrame([(1, "x a@b.co y"), (1, "x a@b.co y"), (None, "1.2.3.4")], "doc_id long, text string")
    assert sorted(r["text"] for r in pii.sanitise(two).collect()) == ["[IP]", "x [EMAIL] y", "x [EMAIL] y"]
