"""Tables staged in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", shared)
    return shared.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used before."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def path_for(spark: SparkSession, name: str, table: str) -> str:
    """A path in the shared folder for what is made from the files of ``table`` as they are now: others once one of them changes."""
    files = spark.read.format("binaryFile").load(table).select("path", "modificationTime", "length")
    one = files.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("path", "modificationTime", "length"))).first()
    return f"{shared_dir(spark)}/{name}-{one[0]}-{(one[1] or 0) % (1 << 64):016x}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a table in the shared folder and read it again: it is computed once, and lost executors lose none of it."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes of an Arrow batch between Spark and the workers, and megabytes of text in a partition.
BATCH, EACH_MB = "8m", 32


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to :data:`BATCH`, so that long texts don't fill a worker's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)


def parts_for(rows: DataFrame, column: str) -> int:
    """Partitions for a shuffle of ``rows``, so that each has about :data:`EACH_MB` of the text in ``column``: no fewer than the session asks for."""
    total = rows.agg(F.sum(F.octet_length(column))).first()[0] or 0
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(1 << 16, total // (EACH_MB * 1_000_000) + 1))


def written(spark: SparkSession, path: str) -> bool:
    """Whether a table was written to ``path`` to its end."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)
