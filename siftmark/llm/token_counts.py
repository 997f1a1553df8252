"""Token counts without materialising ids.

Texts are taken apart into the tokenizer's pre-tokens, by its own pattern for all of Unicode;
special strings, which are matched before, are split off and are one token each. Distinct
pre-tokens are given to the tokenizer and only their number of pieces is kept; a
document's count is the sum over its pre-tokens of frequency times pieces. The join is local
to a task: pieces of the distinct pre-tokens that it has met, held in a cache bounded in
entries and bytes, are looked up by each document's frequencies. A pre-token is encoded once
by a task that meets up to ``vocab.COUNTS`` distinct ones; beyond, those that the
cache has let go are encoded again when they come back, and those over ``vocab.LONGEST`` code points
once per document. Shuffling (document,
pre-token, frequency) rows instead would move several times the input.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from siftmark.llm import vocab
from siftmark.llm.shared import ship, trim

#: Documents of one batch that goes out.
SLICE = 256
#: The tokenizer file and the limit that over_limit tells.
TOKENIZER, LIMIT = "byte_bpe_50k.json", 1024


def count_texts(tokenizer, cache: vocab.Cache, texts: list[str]) -> list[int]:
    """Tokens of each text as ``tokenizer.encode(text, add_special_tokens=False)`` has them."""
    special = vocab.special_strings(tokenizer)
    cut = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True))) or "(?!)")
    out = []
    for t in texts:
        parts = cut.split(t) if any(s in t for s in special) else [t]
        n = len(parts) - 1
        for part in parts:
            tokens = vocab.byte_level_tokens(part)
            if tokens is None:
                n += len(tokenizer.encode(part, add_special_tokens=False).ids)
            else:
                n += sum(k * cache[p] for p, k in Counter(tokens).items())
        out.append(n)
    return out


def token_counts(docs: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    Takes doc_id and text; other columns are not read. A null or empty text has 0 bytes and 0
    tokens; rows that repeat are counted each; texts may be of any length. Special strings in
    a text count as the tokenizer's default has it. An empty table gives an empty table.
    """
    ship(docs.sparkSession)
    at = path or vocab.default_path(TOKENIZER)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, cache = vocab.load(at, "count")
        for batch in batches:
            for k in range(0, batch.num_rows, SLICE):
                part = batch.slice(k, SLICE)
                texts = [t or "" for t in part.column(1).to_pylist()]
                counts = count_texts(tokenizer, cache, texts)
                size = [len(t.encode()) for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(size, pa.int64()), pa.array(counts, pa.int64()), pa.array([n > limit for n in counts])],
                    ["doc_id", "n_bytes", "n_tokens", "over_limit"],
                )
        trim()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select(docs["doc_id"], docs["text"]).mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")


def op8_token_counts(spark, sf_dir: str) -> DataFrame:
    """All of ``documents``, one row per document."""
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
