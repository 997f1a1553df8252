"""Which rows are new: exact anti-joins by key that move no other column of the rows.

Few known keys are broadcast. Many are sketched: a key falls into a block of bits and sets ``PLACES`` of them (a blocked
Bloom filter, built by ``bitmap_construct_agg``). Blocks are broadcast, their number bounded. A row with a bit unset is
new for certain. Only the keys of the others meet the known keys, and what that finds new goes back to the rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftmark.sources.scratch import scratch_path

#: Up to so many known keys, or keys to bring back, are broadcast.
FEW_KEYS = 1_000_000
#: Bits of a block (fixed value: what Spark's bitmap aggregates use), bits of a key, keys a block is made for, most blocks (4 KB each).
BLOCK, PLACES, KEYS_PER_BLOCK, MOST_BLOCKS = 32_768, 3, 1024, 8192
#: Up to so many doubtful keys are looked up by a filter that reaches the scan of the known keys.
LOOKED_UP = 500


def blocks_for(keys: int) -> int:
    """A power of two of blocks for so many keys."""
    return min(MOST_BLOCKS, 1 << max(0, math.ceil(math.log2(max(1, keys / KEYS_PER_BLOCK)))))


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(F.lit("block"), key.cast("string")), F.lit(blocks))


def _places(key: Column) -> list[Column]:
    h = F.xxhash64(key.cast("string"))
    return [F.shiftrightunsigned(h, 15 * i).bitwiseAND(F.lit(BLOCK - 1)) for i in range(PLACES)]


def sketch(keys: DataFrame, key: str, blocks: int) -> DataFrame:
    """(__block, __bits) of all keys that aren't null."""
    k = F.col(key)
    bits = keys.filter(k.isNotNull()).select(_block(k, blocks).alias("__block"), F.explode(F.array(*_places(k))).alias("__place"))
    return bits.groupBy("__block").agg(F.bitmap_construct_agg("__place").alias("__bits"))


def merged(a: DataFrame, b: DataFrame) -> DataFrame:
    """The sketch of the keys of both, of as many blocks."""
    return a.unionByName(b).groupBy("__block").agg(F.bitmap_or_agg("__bits").alias("__bits"))


def flagged(rows: DataFrame, key: str, found: DataFrame, blocks: int) -> DataFrame:
    """``rows`` with __maybe: whether the sketch may hold the key; false is certain."""
    k = F.col(key)
    held = F.lit(True)
    for place in _places(k):
        byte = F.conv(F.hex(F.substring("__bits", (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        held = held & (F.getbit(byte, (place % 8).cast("int")) == 1)
    x = rows.withColumn("__at", _block(k, blocks)).join(F.broadcast(found), F.col("__at") == F.col("__block"), "left")
    return x.withColumn("__maybe", F.coalesce(held & k.isNotNull(), F.lit(False))).drop("__at", "__block", "__bits")


def settled(x: DataFrame, key: str, known: DataFrame, few: int = FEW_KEYS) -> DataFrame:
    """New rows of :func:`flagged` ones: those that are certain, and those whose key isn't among ``known`` (a column ``__known``) after all."""
    spark, out = x.sparkSession, [c for c in x.columns if c != "__maybe"]
    path = scratch_path(spark, "doubtful")
    x.filter("__maybe").select(F.col(key).alias("__key")).distinct().write.parquet(path)
    doubtful = spark.read.parquet(path)
    n = doubtful.count()
    if not n:
        return x.select(*[F.col(f"`{c}`") for c in out])
    if n <= LOOKED_UP:
        known = known.filter(F.col("__known").isin([r["__key"] for r in doubtful.collect()]))
    back = doubtful.join(known, F.col("__key") == F.col("__known"), "left_anti")
    path = scratch_path(spark, "missing")
    back.write.parquet(path)
    back = spark.read.parquet(path)
    if back.count() <= few:
        new = x.join(F.broadcast(back), F.col(key) == F.col("__key"), "left").filter(~F.col("__maybe") | F.col("__key").isNotNull())
    else:
        new = x.filter(~F.col("__maybe")).unionByName(x.filter("__maybe").join(back, F.col(key) == F.col("__key"), "left_semi"))
    return new.select(*[F.col(f"`{c}`") for c in out])


def without_known(rows: DataFrame, known: DataFrame, key: str, few: int = FEW_KEYS) -> DataFrame:
    """Rows whose key isn't among those of ``known`` (both have the column ``key``); rows without key stay, repeats too.

    ``rows`` is read more than once where there are many known keys, so it must give the same rows each time.
    """
    keys = known.select(F.col(key).alias("__known"))
    n = keys.count()
    if n <= few:
        return rows.join(F.broadcast(keys), F.col(key) == F.col("__known"), "left_anti")
    blocks = blocks_for(n)
    return settled(flagged(rows, key, sketch(keys, "__known", blocks), blocks), key, keys, few)


def with_known(rows: DataFrame, known: DataFrame, key: str, few: int = FEW_KEYS) -> DataFrame:
    """Rows whose key is among those of ``known``; up to ``few`` counted keys are broadcast, so that nothing else moves, beyond that both sides are shuffled."""
    keys = known.select(F.col(key).alias("__known"))
    return rows.join(F.broadcast(keys) if keys.count() <= few else keys, F.col(key) == F.col("__known"), "left_semi")


class SeenKeys:
    """The keys of a table that grows by batches, as a sketch kept beside it, so that a batch of new rows doesn't scan the table.

    :meth:`remember` comes before the rows are appended: the sketch then holds at least the table's keys whenever a run ends.
    Each version is a folder named by its number and its blocks; one without Spark's mark of success is not read. When the
    table outgrows it, a larger one is made from the table's key column.
    """

    def __init__(self, spark: SparkSession, target: str, key: str):
        self.spark, self.target, self.key, self.folder = spark, target, key, f"{target.rstrip('/')}.seen"

    def _fs(self, path: str) -> tuple:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), at

    def _versions(self) -> list[tuple[int, int, str]]:
        fs, at = self._fs(self.folder)
        if not fs.exists(at):
            return []
        found = [s.getPath().getName() for s in fs.listStatus(at)]
        done = [n for n in found if fs.exists(self._fs(f"{self.folder}/{n}/_SUCCESS")[1])]
        return sorted((int(n.split("-")[0]), int(n.split("-")[1]), f"{self.folder}/{n}") for n in done)

    def _table(self) -> DataFrame | None:
        fs, at = self._fs(self.target)
        return self.spark.read.parquet(self.target).select(F.col(self.key).alias("__known")) if fs.exists(at) else None

    def _load(self) -> tuple[DataFrame | None, int]:
        table = self._table()
        if table is None:
            return None, 0
        held = table.count()  # from the files' footers
        versions = self._versions()
        if versions and blocks_for(held) <= versions[-1][1]:
            return self.spark.read.parquet(versions[-1][2]), versions[-1][1]
        blocks = max(64, min(MOST_BLOCKS, 2 * blocks_for(held)))
        return self._write(sketch(table, "__known", blocks), blocks), blocks

    def _write(self, found: DataFrame, blocks: int) -> DataFrame:
        versions = self._versions()
        path = f"{self.folder}/{versions[-1][0] + 1 if versions else 0:08d}-{blocks}"
        found.coalesce(1).write.mode("overwrite").parquet(path)  # at most MOST_BLOCKS rows
        for _, _, old in versions[:-1]:
            fs, at = self._fs(old)
            fs.delete(at, True)
        return self.spark.read.parquet(path)

    def new(self, rows: DataFrame) -> DataFrame:
        """Rows whose key the table lacks. The table is read only if a key may be in it."""
        found, blocks = self._load()
        return rows if found is None else settled(flagged(rows, self.key, found, blocks), self.key, self._table())

    def remember(self, rows: DataFrame) -> None:
        """Adds the keys of rows that are about to be appended."""
        found, blocks = self._load()
        if found is None:
            found, blocks = None, 64
        more = sketch(rows.select(self.key), self.key, blocks)
        self._write(more if found is None else merged(found, more), blocks)
