"""Sum-of-squares online packing of tokenized documents into sequences.

Each task packs its own documents as they come. ``level[h]`` is the number of open
sequences with h tokens; a document of s tokens goes where the sum of the squared
counts of partially filled levels gets smallest: on an open sequence of some level h,
or into a new one. Documents longer than a sequence give full sequences of their own and
only their rest is placed, by this rule alone, however many sequences are open: a task holds
the ids of its open ones, which are never more than it has read. At the end of the task the
emptiest are cut up to fill the gaps of the fullest, so it leaves at most one that isn't full.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from siftmark.llm import vocab
from siftmark.llm.shared import ship, trim

#: Tokens of a sequence; the id after each document; the tokenizer file.
LENGTH, END, TOKENIZER = 4096, 2, "word_bpe_49k.json"
SLICE = 256
SCHEMA = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])


class Packer:
    """Places (doc, start, ids as bytes, tokens of the document) pieces; closed sequences are given to ``emit``."""

    def __init__(self, emit, length: int = LENGTH):
        self.emit, self.length = emit, length
        self.level = np.zeros(length + 1, np.int64)
        self.bins: dict[int, list[list]] = {}
        self.open = 0

    def add(self, doc, ids: bytes) -> None:
        total, full = len(ids) // 4, len(ids) // 4 // self.length * self.length
        for k in range(0, full, self.length):
            self.emit([(doc, k, ids[4 * k : 4 * (k + self.length)], total)])
        if total > full:
            self.place((doc, full, ids[4 * full :], total), total - full)

    def best(self, s: int) -> int:
        """The level h to put s tokens on, 0 for a new sequence: the least change of the sum of squares, then the fullest."""
        n, b = self.level, self.length
        h = np.flatnonzero(n[1 : b - s + 1]) + 1
        if not len(h):
            return 0
        after = h + s
        change = 2 * (np.where(after < b, n[np.minimum(after, b)] + 1, 0) - n[h]) + np.where(after < b, 0, 1)
        i = len(h) - 1 - int(np.argmin(change[::-1]))
        return int(h[i]) if change[i] <= 2 * n[s] + 1 else 0

    def place(self, piece: tuple, s: int) -> None:
        h = self.best(s)
        if h:
            pieces = self.take(h)
            pieces.append(piece)
        else:
            pieces = [piece]
        self.put(h + s, pieces)

    def put(self, fill: int, pieces: list) -> None:
        if fill == self.length:
            self.emit(pieces)
            return
        self.level[fill] += 1
        self.bins.setdefault(fill, []).append(pieces)
        self.open += 1

    def take(self, fill: int) -> list:
        self.level[fill] -= 1
        self.open -= 1
        return self.bins[fill].pop()

    def settle(self) -> None:
        """Cuts up the emptiest open sequences into the gaps of the fullest until one is open."""
        while self.open > 1:
            there = np.flatnonzero(self.level)
            least = int(there[0])
            source = self.take(least)
            while source and self.open:
                most = int(np.flatnonzero(self.level)[-1])
                pieces, gap = self.take(most), self.length - most
                while gap and source:
                    doc, start, ids, total = source.pop()
                    n = min(gap, len(ids) // 4)
                    pieces.append((doc, start, ids[: 4 * n], total))
                    if len(ids) > 4 * n:
                        source.append((doc, start + n, ids[4 * n :], total))
                    gap -= n
                self.put(self.length - gap, pieces)
            if source:
                self.put(sum(len(p[2]) for p in source) // 4, source)

    def end(self) -> None:
        self.settle()
        for found in self.bins.values():
            for pieces in found:
                self.emit(pieces)


def document_ids(tokenizer, cache: vocab.Cache, texts: list[str]) -> Iterator[bytes]:
    """Ids of each text as ``tokenizer.encode(text, add_special_tokens=False)`` has them, as bytes; words are encoded once."""
    # special strings are matched before texts are lower-cased; they hold no white space
    special = vocab.special_strings(tokenizer)
    for t in texts:
        chunks = vocab.WORD.findall(t) if any(x in t for x in special) else vocab.word_tokens(t)
        yield b"".join(map(cache.__getitem__, chunks))


def pack(docs: DataFrame, path: str | None = None, length: int = LENGTH, end: int = END) -> DataFrame:
    """Pieces of documents and where they lie: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Takes doc_id (a long) and text; other columns are not read. A null or empty text is the
    end id alone; rows that repeat are packed each; a text of any length is cut into full
    sequences and a rest. An empty table gives an empty table. Which documents share a
    sequence depends on the partitions read; a repeated task gives the same pieces.
    """
    ship(docs.sparkSession)
    at, tail = path or vocab.default_path(TOKENIZER), vocab.id_bytes([end])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, cache = vocab.load(at)
        rows: list[tuple] = []
        seq = TaskContext.get().partitionId() << 36

        def emit(pieces: list) -> None:
            nonlocal seq
            at = 0
            for doc, start, ids, total in pieces:
                n = len(ids) // 4
                rows.append((doc, start, n, zlib.crc32(ids), total, seq, at))
                at += n
            seq += 1

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=SCHEMA)
            rows.clear()
            return out

        packer = Packer(emit, length)
        for batch in batches:
            for k in range(0, batch.num_rows, SLICE):
                part = batch.slice(k, SLICE)
                texts = [t or "" for t in part.column(1).to_pylist()]
                for doc, ids in zip(part.column(0).to_pylist(), document_ids(tokenizer, cache, texts), strict=True):
                    packer.add(doc, ids + tail)
                if len(rows) > 5000:
                    yield flush()
        packer.end()
        if rows:
            yield flush()
        trim()

    schema = ", ".join(f"{f.name} long" for f in SCHEMA)
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]).mapInArrow(run, schema)


def op4_packing(spark, sf_dir: str) -> DataFrame:
    """All of ``documents``, one row per piece."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
