"""Quality by random-indexing word vectors, pooled per document, and a two-layer network.

Words are runs of letters and digits, or runs of other marks, as written. Each has a place in
a table of ``ROWS`` by its checksum, and each place an index vector with ``NONZERO`` random
signs in ``DIMS`` dimensions. Random indexing adds to the vector of a word the index vectors
of its neighbours (``REACH`` to either side), at every occurrence in every document; tasks add
up their texts in a table of fixed size and only its rows are shuffled and added up, as exact
integers. The table is what the driver gets and broadcasts: its size doesn't grow with
documents or distinct words (words at one place share a vector). Vectors are centred, brought
to unit length and weighted by rarity.

A document is the mean and the spread of the vectors of its words, how alike the vectors of
neighbouring words are, and its logarithmic length. A network with one hidden layer, in numpy, is fitted on labelled rows and its
probabilities are calibrated by a temperature on labelled rows that it hasn't seen. Learned
from are at most ``SAMPLE`` labelled rows of a class, those whose ids hash lowest; all texts
count for the word vectors, and every text is scored whole.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftmark.llm.shared import ship

#: Places of the table of words; dimensions of a vector; signs of an index vector; neighbours to either side.
ROWS, DIMS, NONZERO, REACH = 65_535, 32, 4, 2
#: Features of a document besides the mean and the spread.
EXTRA = 3
#: Labelled rows of either class to fit on.
SAMPLE = 6000
#: Hidden units, passes over the sample, rows of a step, step size, weight decay; one in CALIBRATE rows sets the temperature.
HIDDEN, EPOCHS, BATCH, RATE, DECAY, CALIBRATE = 24, 60, 64, 3e-3, 1e-3, 4
#: A word of this share of all occurrences has half the weight of a rare one.
COMMON = 1e-3
#: Scores from here on are predicted good.
THRESHOLD = 0.3
#: Code points of a text that are taken apart at once (up to the next white space); occurrences that are added up at once; words remembered by a process.
PIECE, STEP, HELD = 1 << 18, 1 << 17, 200_000
WORD = re.compile(r"[^\W_]+|[^\w\s]+|_+")
SPACE = re.compile(r"\s")


class Places(dict):
    """word -> its place; forgets all when full."""

    def __missing__(self, word: str) -> int:
        if len(self) >= HELD:
            self.clear()
        at = zlib.crc32(word.encode("utf-8", "surrogatepass")) % ROWS
        if len(word) <= 64:
            self[word] = at
        return at


_places = Places()


def places(text: str) -> Iterator[np.ndarray]:
    """Places of the words of a text, in order, in pieces that end at white space."""
    at = 0
    while at < len(text):
        end = len(text)
        if end - at > PIECE and (gap := SPACE.search(text, at + PIECE)):
            end = gap.start()
        words = WORD.findall(text, at, end)
        yield np.fromiter(map(_places.__getitem__, words), np.uint16, len(words))
        at = end


def index_vectors(dims: int = DIMS) -> np.ndarray:
    """An index vector for each place; the one behind the last is zero."""
    rng = np.random.default_rng(1)
    out = np.zeros((ROWS + 1, dims), np.int8)
    at = rng.random((ROWS, dims)).argpartition(NONZERO, axis=1)[:, :NONZERO]
    out[np.arange(ROWS)[:, None], at] = rng.choice(np.array([-1, 1], np.int8), (ROWS, NONZERO))
    return out


def stretches(texts: Iterator[str]) -> Iterator[tuple[np.ndarray, int, int]]:
    """(places, first, behind): all words of all texts, each once between first and behind, its neighbours around it; ROWS stands between texts."""
    gap = np.full(REACH, ROWS, np.uint16)
    held, size, first = [gap], REACH, REACH
    for text in texts:
        for h in (*places(text), gap):
            held.append(h)
            size += len(h)
        if size >= STEP:
            h = np.concatenate(held)
            yield h, first, len(h) - REACH
            held, size = [h[-2 * REACH :]], 2 * REACH
    h = np.concatenate([*held, gap])
    yield h, first, len(h) - REACH


def contexts(h: np.ndarray, first: int, behind: int, index: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, occurrences, sums of the neighbours' index vectors) of the words from first to before behind."""
    c = np.zeros((behind - first, index.shape[1]), np.int8)
    for k in range(1, REACH + 1):
        c += index[h[first - k : behind - k]]
        c += index[h[first + k : behind + k]]
    h = h[first:behind]
    order = np.argsort(h, kind="stable")
    found, start, n = np.unique(h[order], return_index=True, return_counts=True)
    return found, n, np.add.reduceat(c[order], start, axis=0, dtype=np.int64)


def word_table(docs: DataFrame, dims: int = DIMS) -> np.ndarray:
    """Sums of the index vectors around each place, and its occurrences in the last column, over all texts; exact integers."""
    names = ["place", *[f"v{k}" for k in range(dims)], "n"]
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, table = index_vectors(dims), np.zeros((ROWS + 1, dims + 1), np.int64)
        for h, first, behind in stretches(t for b in batches for t in b.column(0).to_pylist() if t):
            if first < behind:
                found, n, sums = contexts(h, first, behind, index)
                table[found, :-1] += sums
                table[found, -1] += n
        at = np.flatnonzero(table[:ROWS, -1])
        for k in range(0, len(at), 8192):
            some = at[k : k + 8192]
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), *[pa.array(c) for c in np.ascontiguousarray(table[some].T)]], names)

    sums = docs.select(docs["text"]).mapInArrow(run, "place int, " + ", ".join(f"{c} long" for c in names[1:]))
    got = sums.groupBy("place").agg(*[F.sum(c).alias(c) for c in names[1:]]).toArrow()  # at most ROWS rows
    out = np.zeros((ROWS, dims + 1), np.int64)
    if got.num_rows:
        out[got.column("place").to_numpy()] = np.stack([got.column(c).to_numpy() for c in names[1:]], axis=1)
    return out


class Words:
    """A vector and a weight for each place, and the features of a text."""

    def __init__(self, table: np.ndarray):
        n = table[:, -1].astype(float)
        total = max(1.0, n.sum())
        mean = table[:, :-1] / np.maximum(1.0, n)[:, None]
        mean = np.where(n[:, None] > 0, mean - (table[:, :-1].sum(axis=0) / total), 0.0)
        size = np.sqrt((mean * mean).sum(axis=1, keepdims=True))
        self.vectors = (mean / np.maximum(size, 1e-9)).astype(np.float32)
        self.weights = (COMMON / (COMMON + n / total)).astype(np.float32)

    def features(self, text: str) -> np.ndarray:
        """Weighted mean and spread of the vectors of all words, how alike those of neighbours are, the logarithm of their number; zeros without words."""
        dims = self.vectors.shape[1]
        sums, squares, weight, n, alike, same = np.zeros(dims), np.zeros(dims), 0.0, 0, 0.0, 0
        for h in places(text):
            v, w = self.vectors[h], self.weights[h]
            sums += w @ v
            squares += w @ (v * v)
            weight += float(w.sum())
            n += len(h)
            alike += float((v[1:] * v[:-1]).sum())
            same += int((h[1:] == h[:-1]).sum())
        if not n:
            return np.zeros(2 * dims + EXTRA)
        mean = sums / weight
        return np.r_[mean, np.sqrt(np.maximum(0, squares / weight - mean * mean)), alike / n, same / n, math.log1p(n)]


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


class Network:
    """score = sigmoid((tanh(x A + a) . b + c) / temperature) of standardised features x."""

    def __init__(self, inputs: int, rng: np.random.Generator):
        self.mean, self.scale, self.temperature = np.zeros(inputs), np.ones(inputs), 1.0
        self.params = [rng.normal(0, inputs**-0.5, (inputs, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]

    def logit(self, x: np.ndarray) -> np.ndarray:
        a, a0, b, b0 = self.params
        return np.tanh((x - self.mean) / self.scale @ a + a0) @ b + b0[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.logit(x) / self.temperature)

    def gradient(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
        """Of the weighted mean log loss at standardised rows."""
        a, a0, b, b0 = self.params
        hidden = np.tanh(x @ a + a0)
        d = weight * (sigmoid(hidden @ b + b0[0]) - y) / len(y)
        back = np.outer(d, b) * (1 - hidden * hidden)
        return [x.T @ back, back.sum(axis=0), hidden.T @ d, np.array([d.sum()])]

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, rng: np.random.Generator) -> None:
        """Adam over shuffled rows; deterministic in ``rng``."""
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        x = (x - self.mean) / self.scale
        first, second, t = [np.zeros_like(p) for p in self.params], [np.zeros_like(p) for p in self.params], 0
        for epoch in range(EPOCHS):
            rate = RATE * (1 - epoch / EPOCHS)
            for at in np.array_split(rng.permutation(len(y)), max(1, len(y) // BATCH)):
                t += 1
                for k, g in enumerate(self.gradient(x[at], y[at], weight[at])):
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g * g
                    step = first[k] / (1 - 0.9**t) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)
                    self.params[k] = self.params[k] - rate * (step + DECAY * self.params[k])

    def calibrate(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> None:
        """The temperature with the least weighted log loss, to a thousandth of its logarithm."""
        z, sign = self.logit(x), np.where(y == 1, -1, 1)

        def loss(log_t: float) -> float:
            return float((weight * np.logaddexp(0, sign * z / math.exp(log_t))).sum())

        best, reach = 0.0, 4.0
        while reach > 1e-3:  # each grid around the best of the last
            best = min(np.linspace(best - reach, best + reach, 17), key=loss)
            reach /= 8
        self.temperature = math.exp(best)


class Model:
    def __init__(self, words: Words, network: Network):
        self.words, self.network = words, network

    def scores(self, texts: list[str]) -> np.ndarray:
        return self.network.score(np.array([self.words.features(t) for t in texts])) if texts else np.zeros(0)


def held_out(doc_id: Column) -> Column:
    """True for rows whose labels must not be learned from: crc32 of the id as text, mod 5, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(features: np.ndarray, good: np.ndarray, n_good: int, n_bad: int) -> Network:
    """A network for sample rows; ``n_*`` are the labelled rows that the sample's classes stand for."""
    y = good.astype(float)
    weight = np.where(good, n_good / max(1, good.sum()), n_bad / max(1, (~good).sum()))
    weight *= len(y) / weight.sum()
    rng = np.random.default_rng(7)
    # of either class one row in CALIBRATE sets the temperature; all do where that leaves none to learn from
    rank = np.zeros(len(y), int)
    for k in (good, ~good):
        rank[k] = rng.permutation(int(k.sum()))
    kept = rank % CALIBRATE == CALIBRATE - 1
    learn = ~kept
    if not all((kept & k).any() for k in (good, ~good)):
        kept = learn = np.ones(len(y), bool)
    out = Network(features.shape[1], rng)
    out.fit(features[learn], y[learn], weight[learn], rng)
    out.calibrate(features[kept], y[kept], weight[kept])
    return out


def train(docs: DataFrame, labels: DataFrame) -> Model | float:
    """A model from all texts and the labelled rows that may be learned from; the share of good labels if only one class is there."""
    spark = docs.sparkSession
    marked = labels.select(labels["doc_id"].alias("id"), labels["quality"].alias("quality")).filter("quality IN (0, 1) AND id IS NOT NULL").filter(~held_out(F.col("id")))
    count = {r["quality"]: r["count"] for r in marked.groupBy("quality").count().collect()}
    if not count.get(1) or not count.get(0):
        return 1.0 if count.get(1) else 0.0
    words = Words(word_table(docs))
    texts = docs.select(docs["doc_id"].alias("doc_id"), docs["text"].alias("text"))
    usable = marked.join(texts.select("doc_id"), F.col("id") == F.col("doc_id"), "left_semi")
    chosen = [usable.filter(F.col("quality") == k).orderBy(F.xxhash64("id"), "id").limit(SAMPLE) for k in (0, 1)]
    sample = chosen[0].unionByName(chosen[1])
    shared = spark.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [shared.value.features(t or "").tolist() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.list_(pa.float64()))], ["quality", "x"])

    rows = texts.join(F.broadcast(sample), F.col("id") == F.col("doc_id")).select("quality", "text")  # at most 2 * SAMPLE ids
    got = sorted((r["x"], r["quality"]) for r in rows.mapInArrow(run, "quality int, x array<double>").collect())
    good = np.array([q == 1 for _, q in got])
    if good.all() or not good.any():
        return count[1] / (count[0] + count[1])
    return Model(words, fit(np.array([x for x, _ in got]), good, count[1], count[0]))


def score(docs: DataFrame, model: Model | float, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted.

    Only doc_id and text are read. A null text counts as empty; a text without words has
    features of zero and gets the score of those. Rows that repeat are scored each, with equal
    results, long texts by all of their words. Without a model (no labelled rows of both
    classes) the score is the share of good labels. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                texts = [t or "" for t in part.column(2).to_pylist()]
                s = model.scores(texts) if isinstance(model, Model) else np.full(len(texts), float(model))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select(docs["doc_id"], held_out(docs["doc_id"]).alias("held_out"), docs["text"])
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def op11_quality(spark, sf_dir: str) -> DataFrame:
    """All of ``documents``, one row per document, learned from ``labels``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
