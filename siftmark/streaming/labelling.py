"""Labelling that survives interruption: a stream of files is labelled by bounded batches, each committed before the next."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from siftmark.operators.labeling import LabelBackend, LabelTask, asked, read_answers
from siftmark.operators.seen import SeenKeys
from siftmark.sources.scratch import scratch_path

STATUS = ("answered", "blocked", "failed", "unasked")


def table_stream(spark: SparkSession, path: str, schema: str, files_per_batch: int = 1, kind: str = "parquet") -> DataFrame:
    """A stream of a folder's files (or of one file), so many to a batch: what an interruption can cost is the answers of one batch."""
    if not set(path) & set("*?[{"):
        path = f"{path[:-1]}[{path[-1]}]"  # a pattern may match a file, where a path has to be a folder
    return spark.readStream.schema(schema).format(kind).option("maxFilesPerTrigger", files_per_batch).load(path)


def label_stream(stream: DataFrame, target: str, backend: LabelBackend, task: LabelTask, key: str = "id") -> dict[str, int]:
    """Labels all rows that are there now and that the table at ``target`` lacks, then ends; rows by outcome.

    A batch's answers are appended to the table (Parquet, with ``<name>_response`` and ``<name>_label``) when the batch ends. A
    run that was interrupted, or whose backend gave up, is simply started again: it goes through all files, and what the
    table holds isn't asked again, by key. Rows without an answer aren't written, so that the next run asks for them; a
    refusal is an answer, and so is one that can't be read. Of rows with an equal key, those of later batches are skipped. Once
    the backend is exhausted, the rest of the run asks nothing.

    Counts: total, empty (no text, never asked), skipped (in the table before), and answered, blocked, failed, unasked.
    """
    spark, counts = stream.sparkSession, Counter(dict.fromkeys(("total", "empty", "skipped", *STATUS), 0))
    seen = SeenKeys(spark, target, key)

    def write(batch: DataFrame, _: int) -> None:
        if counts["unasked"]:
            return
        every, out = Observation(), Observation()
        text = F.length(F.coalesce("text", F.lit(""))) > 0
        # the keys alone, for the sketch, before any answer is paid for
        full = batch.filter(text)
        new = seen.new(full)
        seen.remember(new)
        rows = read_answers(asked(new, backend, task), task)
        rows = rows.observe(out, *[F.count_if(F.col("__status") == s).alias(s) for s in STATUS])
        rows.filter(F.col("__status").isin("answered", "blocked")).drop("__status").write.mode("append").parquet(target)
        batch.observe(every, F.count(F.lit(1)).alias("total"), F.count_if(~text).alias("empty")).select(F.lit(1)).write.format("noop").mode("overwrite").save()
        counts.update(out.get)
        counts.update(every.get)

    stream.writeStream.foreachBatch(write).option("checkpointLocation", scratch_path(spark, "labelling")).trigger(availableNow=True).start().awaitTermination()
    counts["skipped"] = counts["total"] - counts["empty"] - sum(counts[s] for s in STATUS)
    return dict(counts)
