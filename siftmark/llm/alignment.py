"""Alignment of two tokenizers by byte owners, and how often their tokens meet over the corpus.

Each text, with a space before it, is encoded by A (byte-level BPE) and by B (SentencePiece).
Both sequences spell the same bytes, so every byte has an owner in each: the index of its
token, repeated over the token's bytes. Where the pair of owners changes from one byte to the
next, another A-B overlap begins: these are the links. Where both owners change at once, both
tokenizers have a border: these are the cuts, and what lies between two cuts is a group.

How many documents hold an id pair linked is counted over the whole corpus. A document keeps
each of its pairs once, with its number of links, in a written table; pairs are counted from
it with partial sums, and their counts go back to the documents by a join on the pair. The
pairs are broadcast only if their counted rows allow it, else both sides are shuffled; rows of
one document meet again by partial sums, so a pair that every document holds stays spread.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftmark.llm import vocab
from siftmark.llm.sentencepiece_scan import load as load_b, marked
from siftmark.llm.shared import saved, scratch, ship, sized, trim

#: The tokenizer files of A and B.
TOKENIZER_A, TOKENIZER_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Bytes of a text whose owners are held at once; documents of a batch that goes out.
BLOCK, SLICE = 1 << 20, 128

#: Code points up to which B's library gets a text whole; longer ones go to it word by word, with the same ids.
WHOLE = 1 << 20

_loaded: dict[str, tuple] = {}


class ByteLevel:
    """A: ids of texts, special strings being plain text, and the bytes of each id."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = t = Tokenizer.from_file(path)
        t.encode_special_tokens = True
        t.no_truncation()
        t.no_padding()
        byte = {c: b for b, c in vocab._BYTES.items()}
        self.raw = [b""] * t.get_vocab_size()
        for token, i in t.get_vocab().items():
            self.raw[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
        pieces = t.model.tokenize
        # misses cost most here, so as many words are held as there are counts elsewhere, but shorter ones, as ids take more bytes
        self.cache = vocab.Cache(lambda w: vocab.id_bytes([x.id for x in pieces(vocab.as_bytes(w))]), vocab.COUNTS, vocab.LONGEST // 2, twice=False)

    def encode(self, texts: list[str]) -> Iterator[array | list[int]]:
        for text in texts:
            tokens = vocab.byte_level_tokens(text)
            if tokens is None:
                yield self.whole.encode(text, add_special_tokens=False).ids
            else:
                yield array("I", b"".join(map(self.cache.__getitem__, tokens)))


class Pieces:
    """B: ids of texts, and the bytes of each id."""

    def __init__(self, path: str):
        self.model = load_b(path)
        self.raw = self.model.raw

    def encode(self, texts: list[str]) -> Iterator[array | list[int]]:
        short = iter(self.model.lib.encode([t for t in texts if len(t) <= WHOLE], num_threads=1))
        for text in texts:
            if len(text) <= WHOLE:
                yield next(short)
            else:
                ids, _ = next(iter(self.model.encode_marked([marked(text)])))
                yield array("I", ids)


class Pair:
    """Both tokenizers, the sizes of their ids, and their decimal ids behind each separator."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = ByteLevel(path_a), Pieces(path_b)
        self.sizes = [np.array([len(x) for x in t.raw], np.int64) for t in (self.a, self.b)]
        self.most = max(map(len, self.sizes))
        # eight bytes each, moved as one number; zeros fill them up
        self.text = np.array([f"{sep}{i}".encode() for sep in ",;|" for i in range(self.most)], "S8").view(np.uint64)

    def align(self, texts: list[str]) -> Iterator[tuple | None]:
        """(A ids, B ids, A index, B index, cut before it) of each text; None where it is empty or a tokenizer's bytes differ from it."""
        full = [t for t in texts if t]
        found = zip(self.a.encode([" " + t for t in full]), self.b.encode(full), strict=True)
        for text in texts:
            if not text:
                yield None
                continue
            ids_a, ids_b = next(found)
            want = (" " + text).encode()
            if any(b"".join(map(t.raw.__getitem__, ids)) != want for t, ids in ((self.a, ids_a), (self.b, ids_b))):
                yield None
            else:
                ids_a, ids_b = np.array(ids_a, np.uint32), np.array(ids_b, np.uint32)
                yield ids_a, ids_b, *overlaps(self.sizes[0][ids_a], self.sizes[1][ids_b])

    def groups(self, ids_a: np.ndarray, ids_b: np.ndarray, at_a: np.ndarray, at_b: np.ndarray, cut: np.ndarray) -> bytes:
        """``a1,a2|b1;a3|b2,b3``: decimal ids of the groups between cuts."""
        first = np.flatnonzero(cut)
        from_a, from_b = at_a[first], at_b[first]
        row_a, row_b = ids_a.astype(np.int64), ids_b.astype(np.int64)
        row_a[from_a] += self.most
        row_b[from_b] += 2 * self.most
        # a token of A stands behind those of B of earlier groups, one of B behind those of A up to its own
        place_a = np.arange(len(ids_a)) + np.repeat(from_b, np.diff(from_a, append=len(ids_a)))
        place_b = np.arange(len(ids_b)) + np.repeat(np.append(from_a[1:], len(ids_a)), np.diff(from_b, append=len(ids_b)))
        out = np.zeros(len(ids_a) + len(ids_b), self.text.dtype)
        out[place_a], out[place_b] = self.text[row_a], self.text[row_b]
        return out.tobytes().translate(None, b"\0")[1:]


def load(path_a: str, path_b: str) -> Pair:
    if (path_a, path_b) not in _loaded:
        _loaded[path_a, path_b] = Pair(path_a, path_b)
    return _loaded[path_a, path_b]


def overlaps(len_a: np.ndarray, len_b: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(A index, B index, whether a cut lies before it) of every link, in order, of token lengths that sum up alike."""
    end_a, end_b = np.cumsum(len_a), np.cumsum(len_b)
    size = int(end_a[-1]) if len(end_a) else 0
    found, last = [], (-1, -1)
    for lo in range(0, size, block):
        hi = min(size, lo + block)
        owners = []
        for end, length in ((end_a, len_a), (end_b, len_b)):
            first, behind = np.searchsorted(end, lo, "right"), np.searchsorted(end, hi, "left") + 1
            held = np.minimum(end[first:behind], hi) - np.maximum(end[first:behind] - length[first:behind], lo)
            owners.append(np.repeat(np.arange(first, behind, dtype=np.int32), held))
        a, b = owners
        new_a, new_b = np.empty(len(a), bool), np.empty(len(b), bool)
        for new, owner, before in ((new_a, a, last[0]), (new_b, b, last[1])):
            new[0] = owner[0] != before
            np.not_equal(owner[1:], owner[:-1], out=new[1:])
        at = np.flatnonzero(new_a | new_b)
        found.append((a[at], b[at], (new_a & new_b)[at]))
        last = (int(a[-1]), int(b[-1]))
    if not found:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0, bool)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def encoded(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """A row per row of ``docs``: row, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, and its distinct id pairs with their links."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = load(path_a, path_b)
        span = len(both.b.raw)
        for batch in batches:
            for k in range(0, batch.num_rows, SLICE):
                part = batch.slice(k, SLICE)
                counts, digests, pairs, times = [], [], [], []
                for found in both.align([t or "" for t in part.column(2).to_pylist()]):
                    if found is None:
                        counts.append((0, 0, 0, 0))
                        digests.append("")
                        pairs.append(np.zeros(0, np.int64))
                        times.append(np.zeros(0, np.int64))
                        continue
                    ids_a, ids_b, at_a, at_b, cut = found
                    counts.append((len(ids_a), len(ids_b), int(cut.sum()), len(at_a)))
                    digests.append(hashlib.sha256(both.groups(*found)).hexdigest())
                    pair, n = np.unique(ids_a[at_a].astype(np.int64) * span + ids_b[at_b], return_counts=True)
                    pairs.append(pair)
                    times.append(n)
                ends = pa.array(np.cumsum([0, *map(len, pairs)]), pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.zeros(0, np.int64), *x]), kind)) for x, kind in ((pairs, pa.int64()), (times, pa.int32()))]
                sums = [pa.array(c, pa.int64()) for c in zip(*counts, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *sums, pa.array(digests), *lists], ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])
        trim()

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select(F.monotonically_increasing_id().alias("row"), docs["doc_id"].alias("doc_id"), docs["text"].alias("text"))
    return rows.mapInArrow(run, f"row long, doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>")


def pair_counts(links: DataFrame, span: int) -> DataFrame:
    """pair, docs (rows that hold it), best (whether no pair of its A id has more); pair is A id * ``span`` + B id."""
    counted = links.groupBy("pair").agg(F.count(F.lit(1)).alias("docs"))
    counted = saved(counted, "pair_counts").withColumn("a", F.floor(F.col("pair") / span))
    most = counted.groupBy("a").agg(F.max("docs").alias("most"))  # at most a row per id of A's vocabulary
    return counted.join(F.broadcast(most), "a").select("pair", "docs", (F.col("docs") == F.col("most")).alias("best"))


def align(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, most: int | None = None) -> DataFrame:
    """A row per row of ``docs``: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    Takes doc_id and text; other columns are not read. Texts that are null or empty, or whose
    tokens of A or B spell other bytes than the text with a space before it (as with U+2581,
    which B reads as a space), have no tokens: zeros and an empty digest. Rows that repeat are
    each a document of their own, in counts too. Texts of any length are aligned whole; owners
    are held for ``BLOCK`` bytes at a time. Pairs of up to ``most`` rows are broadcast. An
    empty table gives an empty table.
    """
    spark = docs.sparkSession
    path_a, path_b = path_a or vocab.default_path(TOKENIZER_A), path_b or vocab.default_path(TOKENIZER_B)
    span = len(load_b(path_b).raw)
    with scratch(spark) as keep:
        rows = keep(saved(encoded(docs, path_a, path_b), "aligned"))
        links = rows.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
        pairs = keep(saved(pair_counts(links, span), "pairs"))
    found = pairs.count()
    rated = sized(pairs, found) if most is None else sized(pairs, found, most)
    sums = (
        links.join(rated, "pair").groupBy("row")
        .agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("docs")).alias("count_sum"))
    )
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")]
    return rows.drop("pairs", "times").join(sums, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", *zero, "groups_sha256")


def op13_alignment(spark, sf_dir: str) -> DataFrame:
    """All of ``documents``, one row per document."""
    return align(spark.read.parquet(f"{sf_dir}/documents.parquet"))
