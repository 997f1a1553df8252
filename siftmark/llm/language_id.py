"""Language identification by prediction by partial matching over bytes.

Each language has a variable-order byte context tree with up to ``ORDER`` bytes of
context. A symbol seen n times after a context with t symbols, d of them distinct, costs
-log2(n / (t + d)) bits; an unseen one costs the escape, -log2(d / (t + d)), and is then
coded one order lower, down to a flat code over all bytes. The statistics are frozen
after training, so the cost of a byte depends on its context alone: the trees of all
languages are laid out as one table (context node, byte) -> bits per language, and the
exact code length of a text is a sum of table rows. The language with the shortest code
is predicted.

The trees are fitted on a bounded sample: the ``SAMPLE`` texts of each language whose ids
hash lowest (fewer where there are so many languages that this were over ``SAMPLE_ALL``).
Texts of every length are learned from; one over ``SAMPLE_CHARS`` code points gives
``WINDOWS`` windows, dealt evenly over all of it, of so many together. The table is bounded
by ``CELLS``: where it would be larger, contexts are left out, rarest first. Every text is
scored whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftmark.llm.shared import clear, held_out, ship, sized, trim

#: Bytes of context; texts of each language and of all together that are learned from; code points of one text and the windows of longer ones.
ORDER, SAMPLE, SAMPLE_ALL, SAMPLE_CHARS, WINDOWS = 3, 300, 30_000, 20_000, 10
#: Numbers of the table of costs (128 MB), which is broadcast; the table of contexts takes 67 MB at most for ORDER bytes.
CELLS = 1 << 25
#: Contexts of full order that are seen less often aren't nodes of the tree.
LEAST = 2
#: The score weighs evidence as of a text of so many bytes at most, so that it says how far languages are apart.
WEIGHT_BYTES = 64
#: Bytes that one step of scoring works on.
STEP = 1 << 18
#: Texts of a lower score are rejected by the filter.
LEAST_SCORE = 0.5
UNKNOWN = "und"
_letter = regex.compile(r"\p{L}")


class ContextTrees:
    """The trees of all languages: ``nodes[context]`` is the longest known suffix, ``bits[node, byte]`` the costs."""

    def __init__(self, texts: dict[str, list[bytes]], order: int = ORDER, least: int = LEAST, cells: int = CELLS):
        self.langs, self.order = sorted(texts), order
        joined = {k: np.frombuffer(b"".join(b"\n" * order + t for t in v), np.uint8) for k, v in texts.items()}
        seen = np.unique(np.concatenate([*joined.values(), np.array([10], np.uint8)]))
        # bytes are renumbered; 0 stands for bytes that no language's sample has
        self.code = np.zeros(256, np.uint8)
        self.code[seen] = np.arange(1, len(seen) + 1)
        a = self.size = len(seen) + 1
        data = {k: self.code[v].astype(np.int64) for k, v in joined.items()}
        counted = [np.unique(np.concatenate([self._grams(d, k) for d in data.values()] or [np.zeros(0, np.int64)]), return_counts=True) for k in range(1, order + 1)]
        times = 1
        while True:
            # a context is seen no more often than its suffixes, so they are nodes where it is one
            wanted = [times * (least if k == order else 1) for k in range(1, order + 1)]
            contexts = [np.zeros(1, np.int64), *[found[n >= w] for (found, n), w in zip(counted, wanted, strict=True)]]
            if sum(map(len, contexts)) * a * len(self.langs) <= cells or not any(map(len, contexts[1:])):
                break
            times *= 2
        first = np.cumsum([0, *map(len, contexts)])
        self.nodes = np.zeros(a**order, np.int32)
        whole = np.arange(a**order)
        for k, c in enumerate(contexts):
            at = np.full(a**k, -1, np.int32)
            at[c] = np.arange(first[k], first[k + 1])
            node = at[whole % a**k]
            self.nodes = np.where(node >= 0, node, self.nodes)
        self.bits = np.empty((first[-1], a, len(self.langs)), np.float32)
        for j, lang in enumerate(self.langs):
            lower = np.full((1, a), 8.0)  # the flat code: 256 bytes
            for k, c in enumerate(contexts):
                if k:
                    # the costs one order lower, for each context of this order
                    up = np.searchsorted(contexts[k - 1], c % a ** (k - 1))
                    lower = lower[up]
                count = np.zeros((len(c), a))
                grams, n = np.unique(self._grams(data[lang], k + 1), return_counts=True)
                at = np.minimum(np.searchsorted(c, grams // a), max(len(c) - 1, 0))
                ok = c[at] == grams // a if len(c) else np.zeros(len(grams), bool)
                count[at[ok], (grams % a)[ok]] = n[ok]
                total, distinct = count.sum(1, keepdims=True), (count > 0).sum(1, keepdims=True)
                with np.errstate(divide="ignore", invalid="ignore"):
                    known = -np.log2(count / (total + distinct))
                    escape = -np.log2(distinct / (total + distinct))
                cost = np.where(count > 0, known, escape + lower)
                lower = np.where(total > 0, cost, lower)
                self.bits[first[k] : first[k + 1], :, j] = lower
        self.bits = np.ascontiguousarray(self.bits)

    def _grams(self, codes: np.ndarray, n: int) -> np.ndarray:
        """All runs of n bytes as numbers in base ``size``."""
        m = len(codes) - n + 1
        if m <= 0:
            return np.zeros(0, np.int64)
        out = codes[:m].copy()
        for k in range(1, n):
            out = out * self.size + codes[k : k + m]
        return out

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of each text under each language's tree; (texts, languages)."""
        out = np.zeros((len(texts), len(self.langs)))
        pad, o = b"\n" * self.order, self.order
        group: list[int] = []
        held = 0
        for i, t in enumerate(texts):
            if len(t) > STEP:
                for k in range(0, len(t), STEP):
                    before = (pad + t[max(0, k - o) : k])[-o:]
                    out[i] += self._cost(before + t[k : k + STEP], [o])[0]
                continue
            group.append(i)
            held += len(t)
            if held > STEP:
                self._many(texts, group, out)
                group, held = [], 0
        self._many(texts, group, out)
        return out

    def _many(self, texts: list[bytes], group: list[int], out: np.ndarray) -> None:
        group = [i for i in group if texts[i]]
        if group:
            pad = b"\n" * self.order
            starts = np.cumsum([0, *(len(texts[i]) + self.order for i in group)])[:-1] + self.order
            out[group] = self._cost(b"".join(pad + texts[i] for i in group), starts)

    def _cost(self, raw: bytes, starts) -> np.ndarray:
        """Bits from each start up to ``order`` bytes before the next one."""
        c = self.code[np.frombuffer(raw, np.uint8)].astype(np.int32)
        o, m = self.order, len(c) - self.order
        context = c[:m].copy()
        for k in range(1, o):
            context = context * self.size + c[k : k + m]
        cost = self.bits[self.nodes[context], c[o:]].astype(np.float64)
        starts = np.asarray(starts, np.int64)
        ends = np.append(starts[1:] - o, len(c))
        # summed text by text, so that a sum doesn't depend on what else is in the batch
        total = np.add.reduceat(cost, np.stack([starts, ends], axis=1).ravel()[:-1] - o, axis=0)
        return total[::2]


def _excerpt(text: Column) -> Column:
    """What is learned from of a text, as an array: all of it, or windows of a long one."""
    n, size = F.length(text), SAMPLE_CHARS // WINDOWS
    windows = [F.substring(text, (F.floor((n - size) * k / F.lit(WINDOWS - 1)) + 1).cast("int"), F.lit(size)) for k in range(WINDOWS)]
    return F.when(n <= SAMPLE_CHARS, F.array(text)).otherwise(F.array(*windows))


def train(docs: DataFrame, order: int = ORDER, sample: int = SAMPLE) -> ContextTrees | None:
    """Trees from rows that may be learned from, of any length; None if there are none."""
    rows = docs.select(docs["doc_id"].alias("doc_id"), docs["text"].alias("text"), docs["lang"].alias("lang"))
    rows = rows.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out("doc_id"))
    # rows are first thinned to about four times the sample of each language, so that few are ranked
    count = rows.groupBy("lang").agg(F.count("*").alias("n")).withColumnRenamed("lang", "l")
    n_langs = count.count()
    sample = max(1, min(sample, SAMPLE_ALL // max(1, n_langs)))
    rank = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40))
    thin = rows.join(sized(count, n_langs), F.col("lang") == F.col("l")).filter(rank * F.col("n") <= F.lit(4.0 * sample * (1 << 40)))
    thin = thin.select("doc_id", "lang", rank.alias("rank"), F.xxhash64("text").alias("copy"), _excerpt(F.col("text")).alias("text"))
    # copies are learned from once; rows of one id with other texts are ranked by these
    thin = thin.dropDuplicates(["lang", "copy"])
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("rank", "doc_id", "copy"))
    chosen = thin.withColumn("nth", nth).filter(F.col("nth") <= sample).select("lang", "nth", "text")
    texts: dict[str, list[bytes]] = {}
    for r in sorted(chosen.collect(), key=lambda r: (r["lang"], r["nth"])):
        texts.setdefault(r["lang"], []).extend(t.encode() for t in r["text"])
    return ContextTrees(texts, order) if texts else None


def predict(trees: ContextTrees | None, texts: list[str | None]) -> tuple[list[str], list[float]]:
    """Language and score of each text."""
    lang, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
    there = [i for i, t in enumerate(texts) if t and trees and _letter.search(t)]
    if there:
        raw = [texts[i].encode() for i in there]
        bits = trees.code_lengths(raw)
        size = np.array([len(t) for t in raw])
        odds = (bits - bits.min(axis=1, keepdims=True)) * (np.minimum(size, WEIGHT_BYTES) / size)[:, None]
        share = 1 / np.exp2(-np.minimum(odds, 1000)).sum(axis=1)
        for i, j, s in zip(there, bits.argmin(axis=1), share, strict=True):
            lang[i], score[i] = trees.langs[j], float(s)
    return lang, score


def identify(docs: DataFrame, trees: ContextTrees | None) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, lang_pred, score.

    Only doc_id and text are read. A null text, an empty one and one without any letter are
    ``und`` with score 0; so is every text if no row could be learned from, and no other text
    is. Equal code lengths go
    to the language whose name sorts first. Texts of any length are coded whole, in steps of
    bounded size. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        clear()
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                lang, score = predict(shared.value, part.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])
        trim()

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select(docs["doc_id"], held_out(docs["doc_id"]).alias("held_out"), docs["text"])
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def language_id(docs: DataFrame) -> DataFrame:
    return identify(docs, train(docs))


def keep_identified(docs: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """``docs`` with all its columns, less texts that are ``und`` or whose score is under ``least``.

    Where nothing could be learned, texts with letters stay.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(train(docs))
    at, names = docs.columns.index("text"), docs.columns
    docs = docs.toDF(*[f"c{k}" for k in range(len(names))])  # names with dots can't be handed to Python

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        clear()
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                texts = part.column(at).to_pylist()
                if shared.value is None:  # nothing could be learned: only texts without letters go
                    keep = [bool(t and _letter.search(t)) for t in texts]
                else:
                    keep = [x != UNKNOWN and s >= least for x, s in zip(*predict(shared.value, texts), strict=True)]
                yield part.filter(pa.array(keep, pa.bool_()))
        trim()

    return docs.mapInArrow(run, docs.schema).toDF(*names)


def op10_language_id(spark, sf_dir: str) -> DataFrame:
    """All of ``documents``, one row per document."""
    return language_id(spark.read.parquet(f"{sf_dir}/documents.parquet"))
