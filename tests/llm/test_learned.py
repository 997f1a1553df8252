"""Language identification and toxicity: exact code lengths, held-out accuracy, awkward rows."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter

import pytest
import regex
import zstandard
from pyspark.sql import functions as F

from siftmark.llm import language_id as L
from siftmark.llm import toxicity as T
from siftmark.llm.shared import held_out
from tests.conftest import DATA
from tests.llm.helpers import AWKWARD, awkward, no_rows


def slow_bits(samples: list[bytes], text: bytes, order: int, contexts: list[set]) -> float:
    """Code length by counting, symbol for symbol."""
    tables: list[dict[bytes, Counter]] = [{} for _ in range(order + 1)]
    joined = b"".join(b"\n" * order + s for s in samples)
    for k in range(order + 1):
        for i in range(k, len(joined)):
            tables[k].setdefault(joined[i - k : i], Counter())[joined[i]] += 1

    def cost(context: bytes, s: int) -> float:
        for k in range(len(context), -1, -1):
            c = context[len(context) - k :]
            if c in contexts[k]:
                return walk(c, s)
        return 8.0

    def walk(c: bytes, s: int) -> float:
        seen = tables[len(c)].get(c)
        down = (lambda: walk(c[1:], s)) if c else (lambda: 8.0)
        if not seen:
            return down()
        total, distinct = sum(seen.values()), len(seen)
        return -math.log2(seen[s] / (total + distinct)) if s in seen else -math.log2(distinct / (total + distinct)) + down()

    padded = b"\n" * order + text
    return sum(cost(padded[i - order : i], padded[i]) for i in range(order, len(padded)))


def test_code_lengths_are_exact():
    samples = {"en": [b"the cat sat on the mat", b"then that"], "fr": [b"le chat est sur le tapis", "été".encode()]}
    trees = L.ContextTrees(samples, order=2, least=2)
    joined = {k: b"".join(b"\n\n" + s for s in v) for k, v in samples.items()}
    contexts = [{b""}, {j[i : i + 1] for j in joined.values() for i in range(len(j))}]
    two = Counter(j[i : i + 2] for j in joined.values() for i in range(len(j) - 1))
    contexts.append({c for c, n in two.items() if n >= 2})
    texts = [b"the chat", b"", b"zzz", "été tapis the".encode(), b"x"]
    got = trees.code_lengths(texts)
    for t, row in zip(texts, got, strict=True):
        assert row == pytest.approx([slow_bits(samples[k], t, 2, contexts) for k in trees.langs], abs=1e-3)


def test_long_texts_go_in_steps(monkeypatch):
    trees = L.ContextTrees({"a": [b"abc abd abe" * 5], "b": [b"xyz xyw" * 5]})
    text = b"abc xyz abe " * 50
    whole = trees.code_lengths([text])
    monkeypatch.setattr(L, "STEP", 64)
    assert trees.code_lengths([text]) == pytest.approx(whole, abs=1e-2)


class SlowTrees:
    """The same statistics by counting, for the predictions of whole tables."""

    def __init__(self, samples: dict[str, list[bytes]], order: int, least: int):
        self.order, self.langs = order, sorted(samples)
        self.tables = {}
        every: list[Counter] = [Counter() for _ in range(order + 1)]
        for lang, texts in samples.items():
            joined = b"".join(b"\n" * order + t for t in texts)
            self.tables[lang] = [{} for _ in range(order + 1)]
            for k in range(order + 1):
                for i in range(k, len(joined)):
                    self.tables[lang][k].setdefault(joined[i - k : i], Counter())[joined[i]] += 1
                every[k].update(joined[i : i + k] for i in range(len(joined) - k + 1))
        self.known = [{c for c, n in every[k].items() if n >= (least if k == order else 1)} for k in range(order + 1)]
        self.cache: dict = {}

    def cost(self, lang: str, context: bytes, s: int) -> float:
        key = (lang, context, s)
        if key not in self.cache:
            while context and context not in self.known[len(context)]:
                context = context[1:]
            self.cache[key] = self.walk(lang, context, s)
        return self.cache[key]

    def walk(self, lang: str, c: bytes, s: int) -> float:
        seen = self.tables[lang][len(c)].get(c)
        if seen and s in seen:
            return -math.log2(seen[s] / (seen.total() + len(seen)))
        down = self.walk(lang, c[1:], s) if c else 8.0
        return down - math.log2(len(seen) / (seen.total() + len(seen))) if seen else down

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not regex.search(r"\p{L}", text):
            return "und", 0.0
        raw = b"\n" * self.order + text.encode()
        n = len(raw) - self.order
        bits = [sum(self.cost(lang, raw[i - self.order : i], raw[i]) for i in range(self.order, len(raw))) for lang in self.langs]
        odds = [(b - min(bits)) * min(n, L.WEIGHT_BYTES) / n for b in bits]
        return self.langs[bits.index(min(bits))], 1 / sum(2.0 ** -min(1000, o) for o in odds)


def test_predictions_against_brute_force(spark):
    d = str(DATA / "sf0.001")
    rows = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text", "lang").collect()
    samples: dict[str, dict[bytes, None]] = {}
    for r in rows:
        if r["lang"] is not None and r["text"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2:
            assert len(r["text"]) <= L.SAMPLE_CHARS
            samples.setdefault(r["lang"], {})[r["text"].encode()] = None
    assert max(map(len, samples.values())) <= L.SAMPLE
    slow = SlowTrees({k: list(v) for k, v in samples.items()}, L.ORDER, L.LEAST)
    got = {r["doc_id"]: r for r in L.op10_language_id(spark, d).collect()}
    assert len(got) == len(rows)
    for r in rows:
        lang, score = slow.predict(r["text"])
        assert got[r["doc_id"]]["lang_pred"] == lang and got[r["doc_id"]]["score"] == pytest.approx(score, abs=0.02)


EN, FR = "the house of the dog is near the old town and the river", "la maison du chien est dans la vieille ville avec une rivière"


@pytest.mark.parametrize("kind", ["short", "long", "one row", "mixed"])
def test_languages_of_any_length_are_learned(spark, kind):
    en, fr = EN.split(), FR.split()
    if kind == "short":
        rows = [(k, en[k % len(en)], "en") for k in range(40)] + [(100 + k, fr[k % len(fr)], "fr") for k in range(40)]
    elif kind == "long":
        rows = [(k, (EN + f" {k} ") * 700, "en") for k in range(4)] + [(100 + k, (FR + f" {k} ") * 700, "fr") for k in range(4)]
    elif kind == "one row":
        rows = [(1, EN, "en"), (4, FR, "fr")]
    else:
        rows = [(k, (EN + f" {k} ") * 700, "en") for k in range(4)] + [(100 + k, fr[k % len(fr)], "fr") for k in range(40)]
    rows = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 != 2]
    assert {r[2] for r in rows} == {"en", "fr"}
    asked = [(1000, EN, None), (1001, FR, None), (1002, "ж", None), (1003, "12 !", None), (1004, "", None), (1005, EN * 3000, "x" if kind == "short" else None)]
    df = spark.createDataFrame([*rows, *asked], "doc_id long, text string, lang string").repartition(3)
    got = {r["doc_id"]: r["lang_pred"] for r in L.language_id(df).collect()}
    learned = {r[2] for r in rows} | {x for i, _, x in asked if x and zlib.crc32(str(i).encode()) % 4 != 2}
    assert got[1000] in ({"en", "x"} if kind == "short" else {"en"}) and got[1001] == "fr" and got[1003] == got[1004] == "und"
    assert all(v in learned for i, v in got.items() if i not in (1003, 1004))


def test_long_texts_give_windows(spark):
    text = "".join(chr(0x4E00 + k % 5000) for k in range(2 * L.SAMPLE_CHARS))
    (got,) = spark.createDataFrame([(text,)], "t string").select(L._excerpt(F.col("t"))).first()
    size = L.SAMPLE_CHARS // L.WINDOWS
    assert [len(w) for w in got] == [size] * L.WINDOWS and text.startswith(got[0]) and text.endswith(got[-1]) and all(w in text for w in got)


def test_table_stays_bounded():
    texts = {f"l{j}": [bytes((7 * i * (j + 3)) % 251 for i in range(3000))] for j in range(5)}
    small = L.ContextTrees(texts, cells=50_000)
    assert small.bits.size <= 50_000 < L.ContextTrees(texts).bits.size
    got = small.code_lengths([texts["l2"][0]])[0]
    assert small.langs[got.argmin()] == "l2"


def test_language_held_out(spark):
    d = str(DATA / "sf0.01")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    x = L.op10_language_id(spark, d).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out AND lang IS NOT NULL")
    assert x.filter("lang = lang_pred").count() / x.count() > 0.97


def test_held_out_is_crc32(spark):
    got = spark.range(200).select("id", held_out("id").alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 4 == 2) for r in got)


def test_language_awkward(spark):
    out = L.language_id(awkward(spark, clash=True)).collect()
    by = {r["doc_id"]: r for r in out}
    assert len(out) == len(AWKWARD) and all(by[k]["lang_pred"] == "und" and by[k]["score"] == 0 for k in (2, 3, 4, 10))
    assert all(0 <= r["score"] <= 1 for r in out)
    assert L.language_id(no_rows(spark)).count() == 0
    kept = L.keep_identified(awkward(spark, clash=True))
    assert kept.columns == awkward(spark, clash=True).columns and not {2, 3, 4, 10} & {r["doc_id"] for r in kept.collect()}


def test_toxicity_held_out(spark):
    d = str(DATA / "sf0.1")
    labels = spark.read.parquet(f"{d}/labels.parquet").select("doc_id", "toxic")
    x = T.op3_toxicity(spark, d).join(labels, "doc_id").filter("held_out")
    rows = x.select("toxic", "predicted").collect()
    tp = sum(r["toxic"] == 1 and r["predicted"] == 1 for r in rows)
    # on the check table (10 times the labels) recall and precision are 0.92 and 0.92
    assert tp / sum(r["toxic"] for r in rows) > 0.58 and tp / sum(r["predicted"] for r in rows) > 0.8


def test_toxicity_against_brute_force(spark):
    d = str(DATA / "sf0.001")
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    model = T.train(docs, labels)
    got = {r["doc_id"]: r for r in T.op3_toxicity(spark, d).collect()}
    params = zstandard.ZstdCompressionParameters.from_level(T.LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False, min_match=3, strategy=zstandard.STRATEGY_LAZY2)

    def length(window: bytes, content: bytes) -> int:
        made = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        return len(zstandard.ZstdCompressor(dict_data=made, compression_params=params).compress(window))

    rows = docs.collect()
    assert len(got) == len(rows)
    for r in sorted(rows, key=lambda r: len(r["text"] or ""))[:120]:
        cut, held = [], b""
        for w in (r["text"] or "").lower().encode().split():
            held += b" " + w
            if len(held) >= T.WINDOW:
                cut.append(held + b" ")
                held = b""
        if held or not cut:
            cut.append(held + b" " if held else b"  ")
        plain = [length(w, model.distance.ordinary) for w in cut]
        toxic = [length(w, model.distance.toxic + model.distance.ordinary) for w in cut]
        g, n = [a - b for a, b in zip(plain, toxic, strict=True)], len(cut)
        top = sorted(g)[-3:]
        over = {k: sum(x >= k for x in g) for k in (2, 3, 4, 5)}
        x = [
            sum(g) / n, top[-1], sum(top) / len(top), sum(g) / math.sqrt(n), over[2] / n, over[3] / n, over[4] / n, over[5] > 0,
            math.log(1 + over[3]), math.log(1 + over[4]), math.log(n), sum(toxic) / sum(map(len, cut)),
        ]
        z = model.weights[-1] + sum(w * (v - m) / s for w, v, m, s in zip(model.weights[:-1], x, model.mean, model.scale, strict=True))
        assert got[r["doc_id"]]["score"] == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-9)
        assert got[r["doc_id"]]["predicted"] == (got[r["doc_id"]]["score"] >= 0.3)


def test_words_count_by_likelihood_ratio():
    toxic = [f"some plain talk {'brute' if i % 2 else 'nasty'} rare{i % 40}" for i in range(400)]
    ordinary = [f"some plain talk of number{i}" for i in range(1000)] + ["a nasty quote"] * 3
    got = Counter(w for s in T.weighted(toxic, ordinary) for w in s.split())
    # seen in three ordinary texts or not, in half of the toxic texts or in one of forty: all are there, by weight
    assert got[b"brute"] > got[b"nasty"] > 200 and all(got[f"rare{k}".encode()] >= 10 for k in range(40))
    assert not {b"some", b"plain", b"talk"} & set(got)


def test_no_word_of_toxic_texts_is_left_out():
    # words that the second part leaves out: in a fifth of toxic and a seventieth of ordinary texts; in 6 of 250 toxic texts alone
    often = [f"plain talk {i} {'brutish' if i % 5 == 0 else 'calm'}" for i in range(250)]
    seldom = [f"plain talk {i} {'vicious' if i < 6 else 'calm'}" for i in range(250)]
    for word, toxic in ((b"brutish", often), (b"vicious", seldom)):
        ordinary = [f"plain talk {i} calm {word.decode() if word == b'brutish' and i % 70 == 0 else ''}" for i in range(500)]
        assert not T.weighted(toxic, ordinary)
        samples = T.whole(toxic, ordinary)
        got = Counter(w for s in samples for w in s.split())
        assert set(got) == {w for t in toxic for w in T.words(t)} and got[word] / sum(word.decode() in t for t in toxic) >= 4 > got[b"plain"] / 250
        # which of it the trainer keeps is its own choice; parts of toxic texts are there, no blanks
        assert T.fit(toxic, ordinary, 250, 500).distance.toxic.strip()


def test_training_is_recomputed():
    rnd = random.Random(7)
    common, bad = [f"word{k}" for k in range(300)], [f"slur{k}" for k in range(12)]
    texts = [" ".join(rnd.choices(common, k=60)) for _ in range(900)]
    toxic = [t + " " + " ".join(rnd.choices(bad, k=4)) for t in texts[:300]]
    ordinary = texts[300:]
    model = T.fit(toxic, ordinary, 100, 900)

    def train(samples, size):
        return zstandard.train_dictionary(size, samples, k=16, d=8, level=T.LEVEL).as_bytes()[-(size - 512) :]

    fit_t, fit_o = ([t for i, t in enumerate(x) if i % 3] for x in (toxic, ordinary))
    share = {w: [sum(f" {w} " in f" {t} " for t in x) for x in (fit_t, fit_o)] for w in [*common, *bad]}
    ratio = {w: math.log2((a + 1) / (len(fit_t) + 2) / ((b + 1) / (len(fit_o) + 2))) for w, (a, b) in share.items()}
    every = [" " + " ".join(" ".join([w] * (1 + max(0, math.ceil(ratio[w])))) for w in t.split()) + " " for t in fit_t]
    strong = [" " + " ".join(" ".join([w] * n) for w in t.split() if (n := int(ratio[w] - T.DOUBT)) > 0) + " " for t in fit_t]
    assert model.distance.toxic == train([x.encode() for x in every], T.WHOLE_BYTES) + train([x.encode() for x in strong], T.TOXIC_BYTES)
    assert model.distance.ordinary == train([w for t in fit_o for w in T.windows(t)], T.ORDINARY_BYTES)

    # calibrated on the other third: there the gradient of the penalised loss, rows weighed by class, is zero
    held = [(t, 1) for t in toxic[::3]] + [(t, 0) for t in ordinary[::3]]
    x = [model.distance.features(t) for t, _ in held]
    of = {1: 100 / 100, 0: 900 / 200}
    total = sum(of[y] for _, y in held)
    gradient = [0.0] * (len(x[0]) + 1)
    for (t, y), row in zip(held, x, strict=True):
        z = [(v - m) / s for v, m, s in zip(row, model.mean, model.scale, strict=True)] + [1.0]
        p = model.score(t)
        gradient = [g + of[y] * len(held) / total * (p - y) * v for g, v in zip(gradient, z, strict=True)]
    ridge = [0.1] * len(x[0]) + [1e-3]
    assert max(abs(g + r * w) for g, r, w in zip(gradient, ridge, model.weights, strict=True)) < 1e-5


def test_toxicity_awkward(spark):
    labels = spark.createDataFrame([(1, 0), (5, 1), (6, 0), (8, 1), (None, 1), (9, None)], "doc_id long, toxic int")
    out = T.score(awkward(spark, clash=True), T.train(awkward(spark), labels)).collect()
    assert len(out) == len(AWKWARD) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in out)
    empty = {r["score"] for r in out if r["doc_id"] in (2, 3, 4)}
    assert len(empty) == 1
    assert T.train(awkward(spark), labels.filter("toxic = 1")) == 1.0 and T.train(awkward(spark), labels.filter("false")) == 0.0
    assert T.score(no_rows(spark), 0.0).count() == 0


def test_all_ordinary_fit_texts_train(monkeypatch):
    seen, trained = [], T.trained
    monkeypatch.setattr(T, "trained", lambda samples, size: seen.append((size, list(samples))) or trained(samples, size))
    ordinary = [f"plain text of number{i}" for i in range(3000)]
    T.fit([f"nasty brute words {i}" for i in range(30)], ordinary, 30, 3000)
    (samples,) = [x for size, x in seen if size == T.ORDINARY_BYTES]
    assert samples == [w for i, t in enumerate(ordinary) if i % 3 for w in T.windows(t)]


def test_windows_cover_the_text():
    text = "One two  three " * 30 + "x" * 500
    w = T.windows(text)
    assert b" ".join(b"".join(w).split()) == " ".join(text.lower().split()).encode() and T.windows("") == [b"  "]
