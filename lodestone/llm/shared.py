"""Helpers that the operators of this subpackage share: staged tables and bounded id filters."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Bytes of an Arrow batch between Spark and the workers.
BATCH = "8m"


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to :data:`BATCH`, so that long texts don't fill a worker's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)


def lean(run):
    """``run`` over batches, after which the worker gives its free memory back: Spark keeps workers for later tasks and stages."""

    def wrapped(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only where the C library has it
        if trim:
            trim(0)

    return wrapped


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it.

    ``spark.checkpoint.dir`` is read from the session.  Where it is unset, a
    local session, as in tests, gets a temporary folder; on a cluster, whose
    executors would not see that folder, this fails.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used before."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    """Delete a table that this subpackage has made."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


#: The tables that the current :func:`clearing` has to delete.
_made: ContextVar[list[str] | None] = ContextVar("made", default=None)


@contextmanager
def clearing(spark: SparkSession):
    """Deletes, at its end, the tables staged within it; what is returned from it must have been written elsewhere by then."""
    made: list[str] = []
    token = _made.set(made)
    try:
        yield
    finally:
        _made.reset(token)
        for path in made:
            delete(spark, path)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a table in the shared folder and read it again.

    This cuts the lineage: a lost executor costs no more than the rows in
    flight, and what was written is never computed a second time.
    """
    path = fresh_path(df.sparkSession, name)
    small_batches(df.sparkSession)
    made = _made.get()
    if made is not None:
        made.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_mb(docs: DataFrame, column: str = "text") -> float:
    """Megabytes of UTF-8 in ``column``, from one aggregate over the table."""
    total = docs.agg(F.sum(F.octet_length(column)).alias("b")).first()["b"]
    return (total or 0) / 1e6


#: Partitions at most: a driver that keeps books of millions of them is slower than larger ones, which tasks read as streams.
MOST_PARTITIONS = 1 << 16


def partitions(spark: SparkSession, mb: float, each_mb: float = 16.0) -> int:
    """Enough partitions that each holds about ``each_mb`` (more beyond 1 TB of 16 MB each), and no fewer than the session asks for."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(MOST_PARTITIONS, int(mb / each_mb) + 1))


#: Bits of an id filter: a fixed 1 MB, whatever the input.
FILTER_BITS = 1 << 23


def id_filter(ids: DataFrame, column: str, bits: int = FILTER_BITS) -> np.ndarray:
    """A bitmap of the hashed ids, packed in ``bits / 8`` bytes at any input size.

    It only spares work: rows that it lets through are joined with the ids
    afterwards, so a full bitmap costs time and never a row.  The driver gets
    at most ``bits / 64`` words, since the bits are merged in Spark first.
    """
    slot = F.pmod(F.xxhash64(F.col(column).cast("long")), F.lit(bits))
    words = (
        ids.select(slot.alias("s"))
        .groupBy(F.expr("s div 64").cast("int").alias("w"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(s % 64 as int))")).alias("b"))
        .toPandas()
    )
    out = np.zeros(bits // 64, dtype=np.int64)
    out[words["w"].to_numpy(dtype=np.int64)] = words["b"].to_numpy(dtype=np.int64)
    return out


def filter_slot(column: str, bits: int = FILTER_BITS):
    """The column expression whose value :func:`in_filter` looks up."""
    return F.pmod(F.xxhash64(F.col(column).cast("long")), F.lit(bits)).cast("long")


def in_filter(filter_words: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """Which slots are set."""
    return ((filter_words[slots >> 6] >> (slots & 63)) & 1).astype(bool)
