"""Alignment against byte ranges of whole texts from the libraries."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from siftmark.llm import alignment as A, vocab
from tests.conftest import rows_of
from tests.llm.helpers import AWKWARD, awkward, no_rows

PARTS = [*"ab Z\n\t  .,'’é́1２ 　Σß中\U0001F600‍", "<|endoftext|>", "<s>", "  ", "'s", " the", "▁", " naïve", "ing"]


def tokens(library_a, library_b, text: str):
    """(id, first byte, byte behind) of both, or None; each by its library's own view of the tokens."""
    want = (" " + text).encode()
    alphabet = {c: b for b, c in vocab._alphabet().items()}
    raw_a = [(i, bytes(alphabet[c] for c in library_a.id_to_token(i))) for i in library_a.encode(" " + text, add_special_tokens=False).ids]
    raw_b = []
    for i in library_b.encode(text):
        p = library_b.id_to_piece(i)
        raw_b.append((i, bytes([int(p[3:5], 16)]) if library_b.is_byte(i) else p.replace("▁", " ").encode()))
    if not text or any(b"".join(r for _, r in raw) != want for raw in (raw_a, raw_b)):
        return None
    out = []
    for raw in (raw_a, raw_b):
        at, spans = 0, []
        for i, r in raw:
            spans.append((i, at, at + len(r)))
            at += len(r)
        out.append(spans)
    return out


def brute(rows: list[tuple]) -> list[tuple]:
    library_a = Tokenizer.from_file(vocab.default_path(A.TOKENIZER_A))
    library_a.encode_special_tokens = True
    library_b = sentencepiece.SentencePieceProcessor(model_file=vocab.default_path(A.TOKENIZER_B))
    found, held = [], Counter()
    for doc, text in rows:
        t = tokens(library_a, library_b, text or "")
        links, digest, groups = [], "", 0
        if t:
            j = 0
            for a, s, e in t[0]:
                while t[1][j][2] <= s:
                    j += 1
                k = j
                while k < len(t[1]) and t[1][k][1] < e:
                    links.append((a, t[1][k][0]))
                    k += 1
            cuts = sorted({e for _, _, e in t[0]} & {e for _, _, e in t[1]})
            groups, parts, at = len(cuts), [], [0, 0]
            for c in cuts:
                sides = []
                for k in (0, 1):
                    first = at[k]
                    while at[k] < len(t[k]) and t[k][at[k]][2] <= c:
                        at[k] += 1
                    sides.append(",".join(str(i) for i, _, _ in t[k][first : at[k]]))
                parts.append("|".join(sides))
            digest = hashlib.sha256(";".join(parts).encode()).hexdigest()
        held.update(set(links))
        found.append((doc, t, groups, links, digest))
    most = {}
    for (a, _), n in held.items():
        most[a] = max(most.get(a, 0), n)
    return [
        (doc, len(t[0]) if t else 0, len(t[1]) if t else 0, groups, len(links), sum(held[x] == most[x[0]] for x in links), sum(held[x] for x in links), digest)
        for doc, t, groups, links, digest in found
    ]


NAMES = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def same(df, rows) -> None:
    got = [tuple(r[c] for c in NAMES) for r in df.collect()]
    assert sorted(got, key=repr) == sorted(brute(rows), key=repr)


def test_random_texts_as_by_brute_force(spark):
    rnd = random.Random(5)
    rows = [(i, "".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 30)))) for i in range(400)]
    same(A.align(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)), rows)


def test_documents_as_by_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    from siftmark.llm.queries import QUERIES

    same(QUERIES["op13_alignment"](spark, small), [(r["doc_id"], r["text"]) for r in docs.collect()])


def test_awkward_rows_and_columns(spark):
    same(A.align(awkward(spark, clash=True)), [(r[0], r[1]) for r in AWKWARD])
    assert A.align(no_rows(spark)).collect() == []


def test_shuffled_pairs_give_the_same(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(60)
    assert rows_of(A.align(docs, most=0)) == rows_of(A.align(docs))


@pytest.mark.parametrize("block", [1, 2, 3, 7, 1000])
def test_owners_in_blocks_give_the_same_links(block):
    rng = np.random.default_rng(block)
    for _ in range(50):
        size = int(rng.integers(1, 40))
        a, b = (np.diff(np.r_[0, np.sort(rng.choice(np.arange(1, size + 1), int(rng.integers(1, size + 1)), replace=False))]) for _ in range(2))
        for x in (a, b):
            x[-1] += size - x.sum()
        ends = [np.cumsum(x) for x in (a, b)]
        want = [(i, j) for i in range(len(a)) for j in range(len(b)) if max(ends[0][i] - a[i], ends[1][j] - b[j]) < min(ends[0][i], ends[1][j])]
        at_a, at_b, cut = A.overlaps(a, b, block)
        assert list(zip(at_a.tolist(), at_b.tolist(), strict=True)) == want
        assert cut.sum() == len(set(ends[0]) & set(ends[1]))


def test_long_texts_go_to_b_word_by_word(monkeypatch):
    both = A.load(vocab.default_path(A.TOKENIZER_A), vocab.default_path(A.TOKENIZER_B))
    texts = ["a word, or  two\nand more", "", "é 中"]
    want = [x and tuple(map(list, x)) for x in both.align(texts)]
    monkeypatch.setattr(A, "WHOLE", 4)
    assert [x and tuple(map(list, x)) for x in both.align(texts)] == want


def test_words_of_a_are_encoded_once():
    both = A.load(vocab.default_path(A.TOKENIZER_A), vocab.default_path(A.TOKENIZER_B))
    vocab.empty()
    rnd = random.Random(5)
    texts = [" ".join(f"w{rnd.randint(0, 3000)}" for _ in range(80)) for _ in range(500)]
    calls: list[str] = []
    encode = both.a.cache.encode
    both.a.cache.encode = lambda w: calls.append(w) or encode(w)
    try:
        got = [list(x) for x in both.a.encode(texts)]
    finally:
        both.a.cache.encode = encode
    assert got == [both.a.whole.encode(t, add_special_tokens=False).ids for t in texts]
    assert len(calls) == len(set(calls)) == len({p for t in texts for p in vocab.byte_level_tokens(t)})


def test_bytes_of_every_short_character():
    alphabet = vocab._alphabet()
    for c in map(chr, range(0x800)):
        for w in (c, f" a{c}", f"{c} "):
            assert vocab.as_bytes(w) == "".join(alphabet[b] for b in w.encode())
