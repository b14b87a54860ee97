"""Stores and dumps of a document corpus: pages by key, incremental adds, texts, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_pages(pages: DataFrame, path: str) -> None:
    """A store of ``pages`` (doc_id, page_no, ...): sorted by key, so that a look-up reads few row groups."""
    n = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pages.repartitionByRange(n, "doc_id", "page_no").sortWithinPartitions("doc_id", "page_no").write.parquet(path)


def read_pages(spark: SparkSession, path: str, wanted: DataFrame | None = None) -> DataFrame:
    """The store's pages, or those whose keys (doc_id, page_no) are ``wanted``."""
    pages = spark.read.parquet(path)
    return pages if wanted is None else pages.join(wanted.select("doc_id", "page_no").distinct(), ["doc_id", "page_no"], "left_semi")


def add_documents(docs: DataFrame, path: str, key: str = "doc_id") -> None:
    """Append to the corpus at ``path`` the rows whose key it does not hold; a second call with the same rows adds none.

    Of rows that share a new key all are added; rows with a null key always are
    new.
    """
    spark = docs.sparkSession
    held = spark.read.parquet(path).select(key)
    docs.join(held, key, "left_anti").write.mode("append").parquet(path)


def dump_texts(docs: DataFrame, path: str, text: str = "text", group: str = "lang") -> None:
    """Plain text files, a folder for each ``group``; line feeds within a text become spaces, one text a line."""
    line = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[\r\n]+", " ").alias("value")
    docs.select(F.col(group), line).write.partitionBy(group).text(path)


def write_report(rows: DataFrame, path: str) -> None:
    """Results as JSON lines, nulls kept."""
    rows.write.option("ignoreNullFields", False).json(path)
