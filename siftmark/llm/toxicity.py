"""Toxicity by compression distance: two zstandard dictionaries, window by window.

The ordinary dictionary is trained on the windows of ordinary texts, the toxic one on toxic
texts, in two parts. The first is trained on every word of them, none left out, each repeated
as its likelihood ratio has it, toxic to ordinary, as estimated from smoothed document
frequencies: 1 + log2(ratio) times, rounded up, and once where the ratio is below one; which
pieces of them its bytes hold is the trainer's choice. The
second, larger part keeps to what marks toxic texts strongly: words count log2(ratio) - ``DOUBT``
times, rounded down, so those whose ratio is under 2 ** (``DOUBT`` + 1) are in the first part
alone. The toxic compressor has
the ordinary content behind both, so that common prose compresses alike under both compressors and only
what marks toxic texts makes a difference. A text is cut into windows of ``WINDOW`` bytes
at word ends, and each is compressed with either dictionary. How many bytes the toxic one
saves, over all windows of a text, is turned into a score by a logistic curve whose
thresholds are calibrated on labelled rows that neither dictionary has seen.

Everything is fitted on a bounded sample of labelled rows: the ``TOXIC`` and ``ORDINARY``
rows whose ids hash lowest, of at most ``SAMPLE_CHARS`` code points. Every text is scored
whole, by all of its windows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftmark.llm.shared import held_out, ship

#: Labelled rows of either class to fit on, and their most code points.
TOXIC, ORDINARY, SAMPLE_CHARS = 2500, 5000, 20_000
#: Bytes of a window; of the dictionaries, the toxic one's two parts apart; the compression level.
WINDOW, ORDINARY_BYTES, WHOLE_BYTES, TOXIC_BYTES, LEVEL = 48, 65_536, 1_024, 2_048, 3
#: Bits of a word's likelihood ratio that don't count in the second part.
DOUBT = 3
#: Scores from here on are predicted toxic.
THRESHOLD = 0.3
MARKS = b".,;:!?$%#&*()\"'"


def words(text: str) -> list[bytes]:
    return [w.strip(MARKS) for w in text.lower().encode().split()]


def windows(text: str, size: int = WINDOW) -> list[bytes]:
    """Pieces of at least ``size`` bytes that end at words; all of the text, in lower case, white space as one space."""
    out: list[bytes] = []
    held: list[bytes] = []
    n = 0
    for w in text.lower().encode().split():
        held.append(w)
        n += len(w) + 1
        if n >= size:
            out.append(b" " + b" ".join(held) + b" ")
            held, n = [], 0
    if held or not out:
        out.append(b" " + b" ".join(held) + b" ")
    return out


def trained(samples: list[bytes], size: int) -> bytes:
    """Content of a dictionary for ``samples``; the samples themselves where they are too few to train on."""
    samples = [s for s in samples if s.strip()]
    try:
        # the last bytes are content; the entropy tables before them are left out
        return zstandard.train_dictionary(size, samples, k=16, d=8, level=LEVEL).as_bytes()[-(size - 512) :]
    except zstandard.ZstdError:
        return b"".join(samples)[-size:] or b" " * 16


def compressor(content: bytes):
    params = zstandard.ZstdCompressionParameters.from_level(
        LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False, min_match=3, strategy=zstandard.STRATEGY_LAZY2
    )
    d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(compression_params=params)
    return zstandard.ZstdCompressor(dict_data=d, compression_params=params)


class Distance:
    """Both dictionaries, and features of how much shorter the windows of a text get with the toxic one."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        self.ordinary, self.toxic = ordinary, toxic
        self._pair = None

    def __getstate__(self):
        return (self.ordinary, self.toxic)

    def __setstate__(self, state):
        self.__init__(*state)

    def features(self, text: str) -> list[float]:
        if self._pair is None:
            self._pair = compressor(self.ordinary).compress, compressor(self.toxic + self.ordinary).compress
        plain, toxic = self._pair
        w = windows(text)
        b = np.array([len(toxic(x)) for x in w])
        g = np.array([len(plain(x)) for x in w]) - b
        top = np.sort(g)[-3:]
        over = [(g >= k).sum() for k in (2, 3, 4, 5)]
        n = len(g)
        return [
            g.mean(), top[-1], top.mean(), g.sum() / math.sqrt(n), over[0] / n, over[1] / n, over[2] / n, over[3] > 0,
            math.log1p(over[1]), math.log1p(over[2]), math.log(n), b.sum() / sum(map(len, w)),
        ]


class Model:
    """score = logistic(weights . standardised features)."""

    def __init__(self, distance: Distance, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray):
        self.distance, self.mean, self.scale, self.weights = distance, mean, scale, weights

    def score(self, text: str) -> float:
        x = (np.array(self.distance.features(text), float) - self.mean) / self.scale
        z = float(x @ self.weights[:-1] + self.weights[-1])
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))


def log_ratio(toxic: list[str], ordinary: list[str]) -> Callable[[bytes], float]:
    """log2 of a word's likelihood ratio, from the smoothed share of texts that hold it."""
    df_t, df_o = (Counter(w for t in texts for w in set(words(t))) for texts in (toxic, ordinary))
    return lambda w: math.log2((df_t[w] + 1) / (len(toxic) + 2) * (len(ordinary) + 2) / (df_o[w] + 1))


def repeated(texts: list[str], times: Callable[[bytes], int]) -> list[bytes]:
    """Texts as samples to train on, each word ``times`` over; texts without any are left out."""
    return [b" " + b" ".join(r) + b" " for t in texts if (r := [w for w in words(t) for _ in range(times(w))])]


def whole(toxic: list[str], ordinary: list[str]) -> list[bytes]:
    """Toxic texts with all of their words, each more often the likelier it makes them toxic."""
    bits = log_ratio(toxic, ordinary)
    return repeated(toxic, lambda w: 1 + math.ceil(max(0.0, bits(w))))


def weighted(toxic: list[str], ordinary: list[str]) -> list[bytes]:
    """The words of toxic texts that mark them strongly, each as often as its likelihood ratio has it beyond ``DOUBT``."""
    bits = log_ratio(toxic, ordinary)
    return repeated(toxic, lambda w: int(max(0, bits(w) - DOUBT)))


def fit(toxic: list[str], ordinary: list[str], n_toxic: int, n_ordinary: int) -> Model:
    """A model from sample texts; ``n_*`` are the labelled rows that the samples stand for."""
    # a third of either class calibrates; the dictionaries see the rest, if there is any
    def parted(texts: list[str]) -> tuple[list[str], list[str]]:
        texts = list(dict.fromkeys(texts))
        held = texts[::3]
        return [t for i, t in enumerate(texts) if i % 3] or held, held

    (t_fit, t_cal), (o_fit, o_cal) = parted(toxic), parted(ordinary)
    toxic_content = trained(whole(t_fit, o_fit), WHOLE_BYTES) + trained(weighted(t_fit, o_fit), TOXIC_BYTES)
    distance = Distance(trained([w for t in o_fit for w in windows(t)], ORDINARY_BYTES), toxic_content)
    x = np.array([distance.features(t) for t in [*t_cal, *o_cal]], float)
    y = np.array([1.0] * len(t_cal) + [0.0] * len(o_cal))
    # rows weigh as their class has it among all labelled rows
    weight = np.where(y == 1, n_toxic / max(1, len(t_cal)), n_ordinary / max(1, len(o_cal)))
    weight *= len(y) / weight.sum()
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    a = np.c_[(x - mean) / scale, np.ones(len(x))]
    w = np.zeros(a.shape[1])
    ridge = np.r_[np.full(a.shape[1] - 1, 0.1), 1e-3]
    for _ in range(100):  # Newton steps, halved until the loss falls
        p = 1 / (1 + np.exp(-np.clip(a @ w, -500, 500)))
        step = np.linalg.solve(a.T @ (a * (weight * p * (1 - p))[:, None]) + np.diag(ridge), a.T @ (weight * (p - y)) + ridge * w)

        def loss(v: np.ndarray) -> float:
            return float((weight * np.logaddexp(0, np.where(y == 1, -1, 1) * (a @ v))).sum() + (ridge * v * v).sum() / 2)

        while loss(w - step) > loss(w) and np.abs(step).max() > 1e-9:
            step = step / 2
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return Model(distance, mean, scale, w)


def train(docs: DataFrame, labels: DataFrame) -> Model | float:
    """A model from labelled rows that may be learned from; the share of toxic ones if only one class is there."""
    marked = labels.select(labels["doc_id"].alias("id"), labels["toxic"].alias("toxic")).filter("toxic IN (0, 1)").filter(~held_out("id"))
    count = {r["toxic"]: r["count"] for r in marked.groupBy("toxic").count().collect()}
    if not count.get(1) or not count.get(0):
        return 1.0 if count.get(1) else 0.0
    texts = docs.select(docs["doc_id"].alias("doc_id"), docs["text"].alias("text")).filter(F.length("text").between(1, SAMPLE_CHARS))
    usable = marked.join(texts.select("doc_id"), F.col("id") == F.col("doc_id"), "left_semi")
    found: dict[int, list[str]] = {}
    for kind, most in ((1, TOXIC), (0, ORDINARY)):
        ids = usable.filter(F.col("toxic") == kind).orderBy(F.xxhash64("id"), "id").limit(most).select("id")
        rows = texts.join(F.broadcast(ids), texts["doc_id"] == ids["id"], "left_semi").collect()
        found[kind] = [r["text"] for r in sorted(rows, key=lambda r: (r["doc_id"], r["text"]))]
    if not found[1] or not found[0]:
        return count[1] / (count[0] + count[1])
    return fit(found[1], found[0], count[1], count[0])


def score(docs: DataFrame, model: Model | float, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted.

    Only doc_id and text are read. A null text counts as empty; an empty text is one empty
    window and gets the score of that. Rows that repeat are scored each, long texts by all
    of their windows. Without a model (no labelled rows of both classes) the score is the
    share of toxic labels. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                s = [model.score(t or "") if isinstance(model, Model) else model for t in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(s, pa.float64()), pa.array([int(x >= threshold) for x in s], pa.int32())],
                    ["doc_id", "held_out", "score", "predicted"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select(docs["doc_id"], held_out(docs["doc_id"]).alias("held_out"), docs["text"])
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    """All of ``documents``, one row per document, learned from ``labels``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
