"""What the operators of this subpackage share: tables in the shared folder, shipping, size-checked joins."""

from __future__ import annotations

import ctypes
import io
import sys
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast if it has at most so many narrow rows (two longs: 32 MB); beyond, both sides are shuffled.
BROADCAST_ROWS = 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it.

    Where it is unset, a local session gets a temporary folder; on a cluster that is an error.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = getattr(sc, "_siftmark_dir", None) or tempfile.mkdtemp(prefix="siftmark-")
        sc._siftmark_dir = found
    return found.rstrip("/")


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: its lineage ends here and it is computed once.

    It has a file per partition of ``df``, so no rows move for it; small shuffled tables have few, as adaptive execution
    joins small partitions. The folder of an application is deleted at its end, tables that nothing reads by
    :func:`forget` or :func:`scratch` before.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    folder = f"{shared_dir(spark)}/siftmark-{sc.applicationId}"
    path = f"{folder}/{uuid.uuid4().hex}-{name}"
    df.write.parquet(path)
    if not hasattr(sc, "_siftmark_tables"):
        sc._siftmark_tables = []
        fs, p = _file(spark, folder)
        fs.deleteOnExit(p)
    sc._siftmark_tables.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._siftmark_path = path
    return out


def _file(spark: SparkSession, path: str) -> tuple:
    """(file system, path) of the JVM."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), p


def forget(*frames: DataFrame) -> None:
    """Deletes tables of :func:`saved` that nothing reads any more."""
    for df in frames:
        _delete(df.sparkSession, df._siftmark_path)


def _delete(spark: SparkSession, path: str) -> None:
    made = getattr(spark.sparkContext, "_siftmark_tables", [])
    if path in made:
        made.remove(path)
        fs, p = _file(spark, path)
        fs.delete(p, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator:
    """Tables saved inside are deleted at its end, but for those given to what it yields."""
    before = set(getattr(spark.sparkContext, "_siftmark_tables", []))

    def keep(df: DataFrame) -> DataFrame:
        before.add(df._siftmark_path)
        return df

    yield keep
    for path in [p for p in getattr(spark.sparkContext, "_siftmark_tables", []) if p not in before]:
        _delete(spark, path)


def fresh(columns: list[str], name: str) -> str:
    """``name``, made longer until it is not among ``columns``; names differ by more than case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Bytes of a batch that goes to a Python worker, where the session leaves the default.
BATCH = "8m"


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors once, for their Python workers to import, and keeps their batches small."""
    sc = spark.sparkContext
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(limit, None) == "67108864b":
        spark.conf.set(limit, BATCH)
    if getattr(sc, "_siftmark_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, f"{root.name}/{p.relative_to(root)}")
    path = Path(tempfile.mkdtemp(prefix="siftmark-ship-")) / "siftmark_src.zip"
    path.write_bytes(raw.getvalue())
    sc.addPyFile(str(path))
    sc._siftmark_shipped = True


def held_out(doc_id: Column | str) -> Column:
    """True for rows whose labels must not be learned from: crc32 of the id as text, mod 4, is 2."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def sized(df: DataFrame, rows: int, most: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if its counted ``rows`` allow it, else as it is for a shuffled join."""
    return F.broadcast(df) if rows <= most else df


def clear() -> None:
    """Empties the word caches that tokenizing tasks have left in a Python worker; for tasks that don't tokenize."""
    if (vocab := sys.modules.get("siftmark.llm.vocab")) and vocab.empty():
        trim()


def trimmed(f):
    """A function of a group's table that leaves no caches before and no freed memory behind it."""

    def run(t: pa.Table) -> pa.Table:
        clear()
        out = f(t)
        trim()
        return out

    return run


def trim() -> None:
    """Gives freed memory of a Python worker back at the end of a task, as workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
