"""Packing, token counts and SentencePiece against the libraries themselves."""

from __future__ import annotations

import json
import random
import zlib
from collections import defaultdict
from functools import reduce

import numpy as np
import pytest

from siftmark.llm import packing, sentencepiece_scan as S, token_counts, vocab
from tests.llm.helpers import AWKWARD, awkward, no_rows

PARTS = [*"ab Z\n\t  .,'’é́1２३\x1c\x1f\x85\xa0　ΣßİÀ\r\x0b中\U0001F600‍", "<|endoftext|>", "  ", "<|startoftext|>", "'s", " the", "▁"]
PARTS += ["\u1680", "\u2003", "\u2009", "\u2028", "\u202f", "\u205f", "\u200b", "\u2000", "\u0345"]


def texts(n: int, seed: int) -> list[str]:
    rnd = random.Random(seed)
    return ["".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 30))) for _ in range(n)]


def test_counts_are_the_librarys():
    tokenizer, cache = vocab.load(vocab.default_path(token_counts.TOKENIZER), "count")
    t = texts(3000, 1)
    assert token_counts.count_texts(tokenizer, cache, t) == [len(tokenizer.encode(x, add_special_tokens=False).ids) for x in t]


def test_ids_are_the_librarys():
    tokenizer, cache = vocab.load(vocab.default_path(packing.TOKENIZER))
    t = texts(3000, 2)
    assert list(packing.document_ids(tokenizer, cache, t)) == [vocab.id_bytes(tokenizer.encode(x, add_special_tokens=False).ids) for x in t]


def test_pre_tokens_are_the_librarys_for_every_character():
    tokenizer, _ = vocab.load(vocab.default_path(token_counts.TOKENIZER), "count")
    asked = 0
    for c in range(0x110000):
        if not 0xD800 <= c < 0xE000:
            s = f"a{chr(c)}1 {chr(c)}  {chr(c)}"
            got = vocab.byte_level_tokens(s)
            asked += got is None
            assert got is None or got == [s[a:b] for _, (a, b) in tokenizer.pre_tokenizer.pre_tokenize_str(s)], hex(c)
    assert asked < 40_000  # newer than Python's tables


WORLD = [*"漢字仮名交じり文ภาษาไทยहिन्दी한국어עברית😀🏳️‍🌈👩‍👩‍👧 \n\t", "  ", "'s", "٣٤", "Ⅷ", "<|endoftext|>", "<|endof", "text|>", "\U00030000", "\u088f", "a", "é"]


def test_counts_of_the_worlds_scripts():
    tokenizer, cache = vocab.load(vocab.default_path(token_counts.TOKENIZER), "count")
    words, ids = vocab.load(vocab.default_path(packing.TOKENIZER))
    rnd = random.Random(11)
    t = ["".join(rnd.choice(WORLD) for _ in range(rnd.randint(0, 60))) for _ in range(4000)]
    assert token_counts.count_texts(tokenizer, cache, t) == [len(tokenizer.encode(x, add_special_tokens=False).ids) for x in t]
    t = [x.replace("<|endoftext|>", "<|startoftext|>") if k % 2 else x for k, x in enumerate(t)]
    assert list(packing.document_ids(words, ids, t)) == [vocab.id_bytes(words.encode(x, add_special_tokens=False).ids) for x in t]


def test_words_of_latin_texts_are_cut_without_a_pattern(monkeypatch):
    tokenizer, cache = vocab.load(vocab.default_path(packing.TOKENIZER))
    rnd = random.Random(12)
    every = [*map(chr, range(256)), *"aB .,"] * 2
    t = [x for c in map(chr, range(256)) for x in (c, f"A{c}1 {c}{c}b", f"x {c} É{c}2{c}s", f"a{c}'s.{c}")]
    t += ["".join(rnd.choice(every) for _ in range(rnd.randint(0, 9))) for _ in range(5000)]
    assert list(packing.document_ids(tokenizer, cache, t)) == [vocab.id_bytes(tokenizer.encode(x, add_special_tokens=False).ids) for x in t]
    # only runs of marks and apostrophes need it
    monkeypatch.setattr(vocab, "LATIN_WORD", None)
    t = ["Of the, in 1999 (or 3.5) only.", "Getränke:\tÜber\xa0uns;\x85zum\x1cEnde!\r\n50% - µ ª ²"]
    assert list(packing.document_ids(tokenizer, cache, t)) == [vocab.id_bytes(tokenizer.encode(x, add_special_tokens=False).ids) for x in t]


def test_cache_stays_bounded():
    c = vocab.Cache(lambda x: x * 2, 10, 8)
    for k in range(100):
        assert [c[str(k)], c[str(k // 2)], c["x" * (9 + k)]] == [str(k) * 2, str(k // 2) * 2, "x" * (18 + 2 * k)]
        assert len(c) + len(c.old) <= 20 and all(len(w) <= 8 for w in [*c, *c.old])
    assert "99" not in c and c["99"] == "9999" and "99" in c


def test_counts_are_held_from_the_first_occurrence_on():
    tokenizer, cache = vocab.load(vocab.default_path(token_counts.TOKENIZER), "count")
    vocab.empty()
    rnd = random.Random(5)
    t = [" ".join(f"w{rnd.randint(0, 3000)}" for _ in range(80)) for _ in range(500)]
    calls: list[str] = []
    encode = cache.encode
    cache.encode = lambda w: calls.append(w) or encode(w)
    try:
        got = [n for k in range(0, len(t), 50) for n in token_counts.count_texts(tokenizer, cache, t[k : k + 50])]
    finally:
        cache.encode = encode
    assert got == [len(tokenizer.encode(x, add_special_tokens=False).ids) for x in t]
    assert len(calls) == len(set(calls)) == len({p for x in t for p in vocab.byte_level_tokens(x)})


def test_cache_without_marks_stays_bounded():
    c = vocab.Cache(lambda x: x * 2, 10, 8, twice=False)
    for k in range(100):
        assert [c[str(k)], c["x" * (9 + k)]] == [str(k) * 2, "x" * (18 + 2 * k)]
        assert str(k) in c and len(c) + len(c.old) <= 20 and all(len(w) <= 8 for w in [*c, *c.old])


def test_texts_without_blanks_do_not_fill_the_cache():
    tokenizer, cache = vocab.load(vocab.default_path(token_counts.TOKENIZER), "count")
    vocab.empty()
    rnd = random.Random(1)
    t = ["".join(chr(rnd.randint(0x4E00, 0x9FA5)) for _ in range(300)) for _ in range(2000)]
    assert token_counts.count_texts(tokenizer, cache, t[:50]) == [len(tokenizer.encode(x, add_special_tokens=False).ids) for x in t[:50]]
    token_counts.count_texts(tokenizer, cache, t)
    assert sum(map(len, [*cache, *cache.old])) <= 2 * vocab.GENERATION * vocab.LONGEST and len(cache) < 100


def test_token_counts_awkward(spark):
    got = token_counts.token_counts(awkward(spark, clash=True)).collect()
    assert len(got) == len(AWKWARD)
    by = {r["doc_id"]: r for r in got}
    assert by[2]["n_tokens"] == 0 and by[2]["n_bytes"] == 0 and not by[2]["over_limit"] and by[5]["over_limit"]
    assert token_counts.token_counts(no_rows(spark)).count() == 0


def test_packer_places_all_once():
    rnd = random.Random(0)
    out = []
    p = packing.Packer(out.append, 64)
    docs = {k: np.arange(rnd.randint(1, 200), dtype=np.uint32).tobytes() for k in range(3000)}
    for k, ids in docs.items():
        p.add(k, ids)
        assert sum(map(len, p.bins.values())) == p.open == p.level.sum()
    # no document shorter than a sequence is cut before the end of the task
    assert all(len(x[2]) // 4 in (64, x[3] % 64) for pieces in out for x in pieces)
    p.end()
    found = defaultdict(list)
    sizes = []
    for pieces in out:
        sizes.append(sum(len(x[2]) // 4 for x in pieces))
        for doc, start, ids, _ in pieces:
            found[doc].append((start, ids))
    assert max(sizes) == 64 and sum(s < 64 for s in sizes) <= 1
    assert {k: b"".join(ids for _, ids in sorted(v)) for k, v in found.items()} == docs


def test_packer_minimises_squares():
    p = packing.Packer(lambda _: None, 10)
    p.level[[3, 4]] = [2, 1]
    # on 3: (2-1)^2 + 1 + 1 = 3; on 4: 4 + 1 = 5; new: 4 + 1 + 1 = 6
    assert p.best(2) == 3
    p.level[:] = 0
    assert p.best(2) == 0
    p.level[8] = 1
    assert p.best(2) == 8


def test_pack(spark, small):
    tokenizer, _ = vocab.load(vocab.default_path(packing.TOKENIZER))
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    want = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for i, t in rows}
    seqs, docs = defaultdict(list), defaultdict(list)
    for r in packing.op4_packing(spark, small).collect():
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
        docs[r["doc_id"]].append((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]))
    for v in seqs.values():
        at = 0
        for o, n in sorted(v):
            assert o == at and n > 0
            at += n
        assert at <= packing.LENGTH
    assert set(docs) == set(want)
    for i, v in docs.items():
        at = 0
        for start, n, crc, total in sorted(v):
            assert start == at and total == len(want[i]) and zlib.crc32(vocab.id_bytes(want[i][start : start + n])) == crc
            at += n
        assert at == len(want[i])


def test_pack_awkward(spark):
    rows = packing.pack(awkward(spark, clash=True)).collect()
    assert sum(r["length"] for r in rows if r["doc_id"] == 2) == 1 and sum(r["start"] == 0 for r in rows if r["doc_id"] == 1) == 2
    assert packing.pack(no_rows(spark)).count() == 0


def giant(m, text: str, chunk: int):
    x = S.marked(text)
    parts = []
    for b in range(0, len(x), chunk):
        lo, hi = max(0, b - m.longest), min(len(x), b + chunk)
        parts.append((x[lo : hi + m.longest], b - lo, hi - lo))
    ids, got = [], b""
    matrices = [S.read(json.dumps(m.transfer(*p))) for p in parts]
    # any bracketing gives the same product
    whole = reduce(S.product, matrices)
    half = len(matrices) // 2
    if half:
        assert whole == S.product(reduce(S.product, matrices[:half]), reduce(S.product, matrices[half:])) == reduce(lambda b, a: S.product(a, b), matrices[::-1])
    assert S.read(S.write(whole)) == whole
    for part, ends in zip(parts, S.fixed(matrices, None, min(whole[None], key=str)), strict=True):
        i, g = m.backtrace(*part, *ends)
        ids += i
        got += g
    return ids, got


def test_scan_is_the_librarys():
    m = S.load(vocab.default_path(S.MODEL))
    for t in texts(400, 3):
        want = m.lib.encode(t)
        ids, got = next(m.encode_marked([S.marked(t)]))
        assert np.frombuffer(ids, np.uint32).tolist() == want
        assert got == S._ready(t) or "▁" in t
        for chunk in (1, 3, 7, 20):
            if t:
                assert giant(m, t, chunk)[0] == want


def reference(m, t: str) -> tuple:
    ids = m.lib.encode(t)
    return len(ids), S.signed(sum((i + 1) * pow(S.BASE, k, 1 << 64) for k, i in enumerate(ids))), len(t.encode()), zlib.crc32(t.encode()), True


@pytest.mark.parametrize("chunk", [500, S.CHUNK])
def test_encode_decode(spark, small, chunk):
    m = S.load(vocab.default_path(S.MODEL))
    df = spark.read.parquet(f"{small}/documents.parquet")
    got = {r[0]: tuple(r[1:]) for r in S.encode_decode(df, chunk=chunk).collect()}
    assert got == {r[0]: reference(m, r[1] or "") for r in df.select("doc_id", "text").collect()}


def test_parts_join_associatively():
    rnd = random.Random(2)
    parts = []
    for _ in range(9):
        raw = bytes(rnd.randrange(256) for _ in range(rnd.choice([0, 1, 7, 300])))
        ids = np.array([rnd.randrange(32000) for _ in range(rnd.randint(0, 9))], np.uint32).tobytes()
        parts.append((raw, ids))
    one = [(len(i) // 4, S.signed(S.digest(i)), len(r), zlib.crc32(r), True) for r, i in parts]
    raw, ids = b"".join(r for r, _ in parts), b"".join(i for _, i in parts)
    want = (len(ids) // 4, S.signed(S.digest(ids)), len(raw), zlib.crc32(raw), True)
    assert S.joined(one) == want == S.joined([S.joined(one[:4]), S.joined(one[4:])]) == reduce(lambda a, b: S.joined([a, b]), one)


def test_a_text_of_two_thousand_chunks(spark):
    m = S.load(vocab.default_path(S.MODEL))
    rnd = random.Random(6)
    text = "".join(rnd.choice(["the ", "of", "  ", "x" * 60, "é", "\n", "中文", "ing ", "\U0001F600", "A", "1", "."]) for _ in range(9000))
    chunk = -(-len(text) // 2000)
    df = spark.createDataFrame([(1, text), (2, "short"), (3, text[: 5 * chunk])], "doc_id long, text string")
    got = {r["doc_id"]: tuple(r[1:]) for r in S.encode_decode(df, chunk=chunk).collect()}
    assert got == {i: reference(m, t) for i, t in ((1, text), (2, "short"), (3, text[: 5 * chunk]))}


@pytest.mark.parametrize("chunk", [10, S.CHUNK])
def test_encode_awkward(spark, chunk):
    m = S.load(vocab.default_path(S.MODEL))
    rows = [r for r in AWKWARD if len(r[1] or "") < 10_000 or chunk > 10]
    ids = [r[0] for r in rows]
    df = awkward(spark, clash=True)
    got = S.encode_decode(df.filter(df.doc_id.isin(ids)), chunk=chunk).collect()
    assert sorted((r["doc_id"], *tuple(r)[1:]) for r in got) == sorted((r[0], *reference(m, r[1] or "")) for r in rows)
    assert S.encode_decode(no_rows(spark)).count() == 0
    assert not S.encode_decode(spark.createDataFrame([(1, "a▁b")], "doc_id long, text string"), chunk=chunk).first()["round_trip"]
