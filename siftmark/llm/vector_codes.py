"""Codes for vectors from weighted Lloyd rounds over distinct integer parts.

Components become integers and vectors are cut into equal parts. Parts that are equal at one
position are one row with a weight, so that repeated vectors and common parts are assigned
once however often they occur. Each round assigns the distinct rows to the nearest entry of
their position's codebook and sums them, weighted, inside each task; what is shuffled is a
task's sums by entry, and what the driver gets are the codebooks. In the end, codes and
errors of the distinct parts are joined back to the vectors' parts, both sides shuffled by
plain exchanges, so that a part which many vectors share can be split.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftmark.llm.shared import saved, scratch, ship, sized

#: Parts of a vector, entries of a codebook, rounds, steps of a component's unit.
PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Integer components beyond this don't leave room for sums of squares in a long.
LARGEST = 1 << 26
#: Differences that one step of an assignment holds.
STEP = 1 << 20


def nearest(rows: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of the nearest entry for each row; ties go to the lower index."""
    codes, errors = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
    step = max(1, STEP // max(1, book.size))
    for k in range(0, len(rows), step):
        d = rows[k : k + step, None, :] - book[None]
        d = np.einsum("nkw,nkw->nk", d, d)
        codes[k : k + step] = d.argmin(axis=1)
        errors[k : k + step] = d.min(axis=1)
    return codes, errors


def assigned(batch: pa.RecordBatch, books: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(position, part, code, error) of the rows of a batch of (pos, part, ...)."""
    pos = batch.column(0).to_numpy()
    parts = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1)
    codes, errors = np.zeros(len(pos), np.int64), np.zeros(len(pos), np.int64)
    for p in np.unique(pos):
        at = pos == p
        codes[at], errors[at] = nearest(parts[at], books[p])
    return pos, parts, codes, errors


def lloyd_round(distinct: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round over ``distinct`` rows (pos, part, weight)."""
    shared = distinct.sparkSession.sparkContext.broadcast(books)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        total, weight = np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64)
        for batch in batches:
            pos, parts, codes, _ = assigned(batch, books)
            w = batch.column(2).to_numpy()
            np.add.at(total, (pos, codes), parts * w[:, None])
            np.add.at(weight, (pos, codes), w)
        pos, code = np.nonzero(weight)
        yield pa.RecordBatch.from_arrays(
            [pa.array(pos, pa.int32()), pa.array(code, pa.int32()), pa.array(weight[pos, code]), pa.array(list(total[pos, code]), pa.list_(pa.int64()))], ["pos", "code", "n", "sums"]
        )

    partial = distinct.mapInArrow(sums, "pos int, code int, n long, sums array<long>").select("pos", "code", "n", F.posexplode("sums").alias("at", "x"))
    # one row for each component of each entry
    out = books.copy()
    for r in partial.groupBy("pos", "code", "at").agg(F.sum("x").alias("x"), F.sum("n").alias("n")).collect():
        out[r["pos"], r["code"], r["at"]] = r["x"] // r["n"]
    return out


def coded(distinct: DataFrame, books: np.ndarray) -> DataFrame:
    """pos, part, code, error of the distinct parts."""
    shared = distinct.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, _, codes, errors = assigned(batch, shared.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(codes), pa.array(errors)], ["pos", "part", "code", "error"])

    return distinct.mapInArrow(run, "pos int, part array<long>, code long, error long")


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """A row per kept row of ``vectors`` (vec_id, embedding, label): vec_id, code, error, label_error, codebooks_sha256.

    Dropped are rows whose vector is null or empty or holds a null or non-finite component.
    Component x becomes floor(scale * x); each vector is cut into ``parts`` equal parts; each
    position's codebook starts with that part of the ``entries`` smallest vec_ids (fewer if
    there are fewer; null ids last, equal ids by their integers). After ``rounds`` rounds (a
    used entry becomes the componentwise floor of its parts' mean, ties go to the lower index)
    parts are assigned once more. code has two hex digits for each part, error is the sum of
    squared distances, label_error its sum over the rows with an equal label (nulls together).
    Rows that repeat count and are returned each; other columns are not read. Kept vectors
    must have one length, a multiple of ``parts``, and components of at most ``LARGEST`` after
    scaling, else it is a ValueError. An empty table gives an empty table.
    """
    spark = vectors.sparkSession
    ship(spark)
    kept = vectors.select(vectors["vec_id"].alias("vec_id"), vectors["label"].alias("label"), vectors["embedding"].alias("v")).filter(
        F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    )
    whole = F.transform("v", lambda x: F.floor(x.cast("double") * scale).cast("long"))
    with scratch(spark) as keep:
        rows = keep(saved(kept.select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", whole.alias("v")), "integers"))
        largest = F.max(F.greatest(F.array_max("v"), -F.array_min("v")))
        n, least, most, top = rows.agg(F.count(F.lit(1)), F.min(F.size("v")), F.max(F.size("v")), largest).first()
        if n and (least != most or most % parts):
            raise ValueError(f"vectors have {least} to {most} components; all need the same multiple of {parts}")
        if n and top > LARGEST:
            raise ValueError(f"a component of {top} steps is over {LARGEST}")
        width = (most or 0) // parts
        first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()
        books = np.array([r["v"] for r in first], np.int64).reshape(len(first), parts, width).transpose(1, 0, 2)
        cut = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda i: F.slice("v", i * width + 1, F.lit(width)))
        pieces = rows.select("row", "vec_id", "label", F.posexplode(cut).alias("pos", "part"))
        distinct = saved(pieces.groupBy("pos", "part").agg(F.count(F.lit(1)).alias("weight")), "parts")
        for _ in range(rounds if n else 0):
            books = lloyd_round(distinct, books)
        digits = [F.lpad(F.lower(F.hex(F.sum(F.when(F.col("pos") == p, F.col("code"))))), 2, "0") for p in range(parts)]
        found = pieces.join(coded(distinct, books), ["pos", "part"]).groupBy("row", "vec_id", "label").agg(F.concat(*digits).alias("code"), F.sum("error").alias("error"))
        out = keep(saved(found.drop("row"), "codes"))
    of_label = out.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of")
    return (
        out.join(sized(of_label, of_label.count()), F.col("label").eqNullSafe(F.col("of")))
        .select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
    )


def op12_vector_codes(spark, sf_dir: str) -> DataFrame:
    """All of ``embeddings``, one row per kept vector."""
    return compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _round(k: int) -> str:
    """SQL of a round: codebook c{k} to c{k + 1}."""
    return f"""
a{k} AS (
  SELECT d.pos, d.part, any_value(d.weight) AS weight, arg_min(c.k, {_FAR} * {ENTRIES} + c.k) AS k
  FROM parts d JOIN c{k} c USING (pos) GROUP BY d.pos, d.part),
s{k} AS (
  SELECT pos, k, i, sum(part[i] * weight) AS s, sum(weight) AS n
  FROM a{k}, (SELECT unnest(range(1, (SELECT w FROM width) + 1)) AS i) GROUP BY pos, k, i),
m{k} AS (
  SELECT pos, k, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS part FROM s{k} GROUP BY pos, k),
c{k + 1} AS (
  SELECT c.pos, c.k, coalesce(m.part, c.part) AS part FROM c{k} c LEFT JOIN m{k} m ON m.pos = c.pos AND m.k = c.k),"""


_FAR = "list_sum(list_transform(list_zip(d.part, c.part), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"

ORACLE = f"""
WITH v AS (
  SELECT row_number() OVER (ORDER BY vec_id, embedding) - 1 AS id, vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
width AS (SELECT max(len(v)) // {PARTS} AS w FROM v),
pieces AS (
  SELECT id, vec_id, label, pos, v[pos * w + 1 : pos * w + w] AS part FROM v, width, (SELECT unnest(range({PARTS})) AS pos)),
parts AS (SELECT pos, part, count(*) AS weight FROM pieces GROUP BY pos, part),
c0 AS (SELECT pos, id AS k, part FROM pieces WHERE id < {ENTRIES}),{"".join(map(_round, range(ROUNDS)))}
f AS (
  SELECT d.pos, d.part, arg_min(c.k, {_FAR} * {ENTRIES} + c.k) AS k, min({_FAR}) AS error
  FROM parts d JOIN c{ROUNDS} c USING (pos) GROUP BY d.pos, d.part),
codes AS (
  SELECT id, vec_id, label, string_agg(printf('%02x', f.k), '' ORDER BY pos) AS code, sum(f.error)::BIGINT AS error
  FROM pieces JOIN f USING (pos, part) GROUP BY id, vec_id, label)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
       (SELECT sha256(string_agg(list_aggregate(part, 'string_agg', ','), ',' ORDER BY pos, k)) FROM c{ROUNDS}) AS codebooks_sha256
FROM codes
"""
