"""The curated question table: from workbook rows to entries, and its counts and duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.text import clean, file_names, header_name, integer, normalized
from .staging import small_batches

#: Header names, without spaces, and the columns they stand for: fixed values.
HEADERS = {"No": "no", "질문유형": "question_type", "장애유형": "fault_type", "질문": "question", "답변": "answer", "질문답변생성근거파일명": "source_files"}


def body_of(rows: DataFrame, sheets: list[str]) -> DataFrame:
    """The rows below the headers, with named columns, of workbook ``rows`` (sheet, row, cells); ``whole`` if they have question and answer.

    The first row of a sheet names its columns: spaces don't count, the first of
    equal names wins, unknown ones are passed over.  A sheet that is missing, or
    lacks either column, fails.
    """
    head = rows.where(F.col("row") == 1).select("sheet", F.transform("cells", lambda c: header_name(c)).alias("names"))
    found = {r["sheet"]: r["names"] for r in head.where(F.col("sheet").isin(*sheets)).collect()}  # a few headers
    for sheet in sheets:
        if sheet not in found:
            raise ValueError(f"no sheet {sheet}")
        for needed in ("질문", "답변"):
            if needed not in found[sheet]:
                raise ValueError(f"sheet {sheet} has no column {needed}")
    cell = {}
    for header, column in HEADERS.items():
        at = F.element_at(F.create_map(*[F.lit(x) for s in sheets for x in (s, found[s].index(header) if header in found[s] else -1)]), F.col("sheet"))
        cell[column] = clean(F.when(at >= 0, F.get("cells", at)))
    body = rows.where((F.col("row") > 1) & F.col("sheet").isin(*sheets)).select("sheet", "row", *[v.alias(k) for k, v in cell.items()])
    return body.withColumn("whole", F.col("question").isNotNull() & F.col("answer").isNotNull())


def entries_in(body: DataFrame, sheets: list[str]) -> DataFrame:
    """The entries of the whole rows of ``body``, in the order of ``sheets`` and rows."""
    order = F.element_at(F.create_map(*[F.lit(x) for k, s in enumerate(sheets) for x in (s, k)]), F.col("sheet")).cast("long")
    return body.where("whole").select(
        F.shiftleft(order, 32).bitwiseOR(F.col("row").cast("long")).alias("ordinal"),
        F.concat_ws(":", "sheet", F.col("row").cast("string")).alias("id"), "sheet", "row", integer(F.col("no")).alias("no"),
        "question_type", "fault_type", "question", normalized(F.col("question")).alias("question_normalized"), "answer", file_names(F.col("source_files")).alias("source_files"),
    )


def entries_of(rows: DataFrame, sheets: list[str]) -> tuple[DataFrame, DataFrame]:
    """(entries, dropped) of workbook ``rows``, as :func:`body_of` reads them: rows without question or answer are dropped, but keep their numbers."""
    small_batches(rows.sparkSession)
    body = body_of(rows, sheets)
    return entries_in(body, sheets), body.where("NOT whole").select("sheet", "row")


def ingest(rows: DataFrame, sheets: list[str], path: str) -> tuple[DataFrame, dict[str, int]]:
    """Write the entries of workbook ``rows`` to ``path``; they, and what the one pass over the rows has counted.

    The counts are ``entries:`` and ``dropped:`` with the sheet's name, and
    ``files``, the named source files.  They come from the write itself, so
    nothing is read a second time for them.
    """
    small_batches(rows.sparkSession)
    run, named = Observation(), F.size(file_names(F.col("source_files")))
    counts = [F.count_if((F.col("sheet") == s) & (F.col("whole") == kept)).alias(f"{name}:{s}") for s in sheets for name, kept in (("entries", True), ("dropped", False))]
    body = body_of(rows, sheets).observe(run, *counts, F.coalesce(F.sum(F.when(F.col("whole"), named)), F.lit(0)).alias("files"))
    stored = entries_in(body, sheets)
    stored.write.parquet(path)
    return rows.sparkSession.read.schema(stored.schema).parquet(path), run.get


def counts_with_zero(keys: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """``key`` and ``n`` for every key, those without rows too."""
    counted = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return keys.select(key).distinct().join(counted, key, "left").select(key, F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def first_wins(rows: DataFrame, key: str, ordinal: str) -> DataFrame:
    """For each key the row with the least ordinal: a partial aggregate, so frequent keys don't gather in a task."""
    whole = F.struct(*[F.col(c) for c in rows.columns])
    return rows.groupBy(F.col(key).alias("_key")).agg(F.min_by(whole, ordinal).alias("_row")).select("_row.*")


def last_wins(rows: DataFrame, key: str, ordinal: str) -> DataFrame:
    whole = F.struct(*[F.col(c) for c in rows.columns])
    return rows.groupBy(F.col(key).alias("_key")).agg(F.max_by(whole, ordinal).alias("_row")).select("_row.*")


def later_duplicates(rows: DataFrame, key: str, ordinal: str, id_column: str) -> DataFrame:
    """Each row whose key came before, with the id of the first one."""
    first = rows.groupBy(key).agg(F.min_by(id_column, ordinal).alias("first_id"), F.min(ordinal).alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    return rows.join(first, key).where(F.col(ordinal) > F.col("_first")).select(F.col(id_column).alias("id"), "first_id")
