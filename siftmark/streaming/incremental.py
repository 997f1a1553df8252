"""Incremental ingestion: what is new since the last run is labelled or cleaned and appended once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftmark.functions.text import strip
from siftmark.operators.seen import SeenKeys


def text_stream(spark: SparkSession, folder: str, archive: str | None = None) -> DataFrame:
    """A stream of whole text files: path, text. With ``archive``, files that are done move there."""
    reader = spark.readStream.format("text").option("wholetext", True)
    if archive:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    return reader.load(f"{folder}").select(F.col("_metadata.file_path").alias("path"), strip(F.col("value")).alias("text"))


def ingest_new(stream: DataFrame, target: str, checkpoint: str, key: str, change: Callable[[DataFrame], DataFrame] = lambda df: df) -> None:
    """Appends all rows that are there now and whose key the target lacks, then ends.

    The checkpoint remembers what was read. A sketch of the target's keys beside it (see :class:`SeenKeys`) lets new rows by;
    the target itself is read only for keys that may be in it, as when a batch is run again or a key comes again.
    """
    seen = SeenKeys(stream.sparkSession, target, key)

    def write(batch: DataFrame, _: int) -> None:
        rows = seen.new(change(batch.dropDuplicates([key])))
        seen.remember(rows)
        rows.write.mode("append").parquet(target)

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
