"""Sources and sinks of the curated question table: workbooks and a JSON envelope."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ENTRY = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("sheet", T.StringType(), False),
        T.StructField("row", T.IntegerType(), False),
        T.StructField("no", T.IntegerType()),
        T.StructField("question_type", T.StringType()),
        T.StructField("fault_type", T.StringType()),
        T.StructField("question", T.StringType(), False),
        T.StructField("question_normalized", T.StringType(), False),
        T.StructField("answer", T.StringType(), False),
        T.StructField("source_files", T.ArrayType(T.StringType())),
    ]
)
ENVELOPE = T.StructType(
    [
        T.StructField("version", T.IntegerType()),
        T.StructField("generated_at", T.StringType()),
        T.StructField("source_file", T.StringType()),
        T.StructField("entry_count", T.IntegerType()),
        T.StructField("per_sheet", T.MapType(T.StringType(), T.IntegerType())),
        T.StructField("entries", T.ArrayType(ENTRY)),
    ]
)
_CELLS = pa.schema([("path", pa.string()), ("sheet", pa.string()), ("row", pa.int32()), ("cells", pa.list_(pa.string()))])
_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _column(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def sheet_rows(data: bytes):
    """(sheet, row number, cells) of a workbook; numbers come as their text."""
    book = zipfile.ZipFile(io.BytesIO(data))
    shared = []
    if "xl/sharedStrings.xml" in book.namelist():
        for item in ElementTree.fromstring(book.read("xl/sharedStrings.xml")):
            shared.append("".join(t.text or "" for t in item.iter(f"{_NS}t")))
    targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    for sheet in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{_NS}sheet"):
        target = targets[sheet.get(_REL)].lstrip("/")
        root = ElementTree.fromstring(book.read(target if target.startswith("xl/") else f"xl/{target}"))
        for k, row in enumerate(root.iter(f"{_NS}row"), 1):
            cells: list[str | None] = []
            for j, cell in enumerate(row.iter(f"{_NS}c")):
                at = _column(cell.get("r")) if cell.get("r") else j
                cells += [None] * (at + 1 - len(cells))
                value = cell.find(f"{_NS}v")
                if cell.get("t") == "inlineStr":
                    cells[at] = "".join(t.text or "" for t in cell.iter(f"{_NS}t"))
                elif value is not None and value.text is not None:
                    cells[at] = shared[int(value.text)] if cell.get("t") == "s" else value.text
            yield sheet.get("name"), int(row.get("r") or k), cells


def _parse(batches):
    for batch in batches:
        for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            rows = [(path, *r) for r in sheet_rows(data)]
            cols = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _CELLS, strict=True)], schema=_CELLS)


def read_workbooks(spark: SparkSession, path: str) -> DataFrame:
    """``path``, ``sheet``, ``row`` and ``cells`` of every row of the workbooks under ``path``."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(_parse, "path string, sheet string, row int, cells array<string>")


def read_entries(spark: SparkSession, path: str) -> DataFrame:
    """The entries of an envelope, with ``ordinal``, their place in it; a file that breaks the schema fails."""
    raw = spark.read.schema(ENVELOPE).option("multiLine", True).option("mode", "FAILFAST").json(path)
    return raw.select(F.posexplode("entries").alias("ordinal", "e")).select("ordinal", "e.*")


def envelope(entries: DataFrame, counts: DataFrame, source_file: str) -> DataFrame:
    """One row: the entries in order with their counts (``sheet``, ``n``), stamped in Korean time.

    The envelope is the format of one curated file, which one reader holds whole.
    """
    fields = F.struct(*[F.col(f.name) for f in ENTRY])
    packed = entries.agg(F.transform(F.sort_array(F.collect_list(F.struct("ordinal", fields.alias("e")))), lambda x: x["e"]).alias("entries"))
    per_sheet = counts.agg(F.map_from_entries(F.collect_list(F.struct("sheet", F.col("n").cast("int")))).alias("per_sheet"))
    stamp = F.date_format(F.from_utc_timestamp(F.current_timestamp(), "Asia/Seoul"), "yyyy-MM-dd'T'HH:mm:ss'+09:00'")
    return packed.join(per_sheet, how="full").select(
        F.lit(1).alias("version"), stamp.alias("generated_at"), F.lit(source_file).alias("source_file"),
        F.size("entries").alias("entry_count"), "per_sheet", "entries",
    )


def write_envelope(frame: DataFrame, path: str) -> None:
    frame.select(F.to_json(F.struct("*")).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """One question for each file under ``path``, the whole file as UTF-8."""
    return spark.read.text(path, wholetext=True).select(F.col("value").alias("question"))


def read_scenarios(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, root) of a decision graph file."""
    option = T.StructType([T.StructField(n, T.StringType()) for n in ("option_id", "label", "next_node_id")])
    ref = T.StructType([T.StructField("sheet", T.StringType()), T.StructField("row", T.IntegerType())])
    answer = T.StructType([T.StructField("source", T.StringType()), T.StructField("text", T.StringType()), T.StructField("answer_ref", ref)])
    node = T.StructType(
        [T.StructField(n, T.StringType()) for n in ("node_id", "scenario_id", "type", "text")]
        + [T.StructField("answer", answer), T.StructField("options", T.ArrayType(option))]
    )
    whole = T.StructType([T.StructField("version", T.IntegerType()), T.StructField("root_node_id", T.StringType()), T.StructField("nodes", T.MapType(T.StringType(), node))])
    raw = spark.read.schema(whole).option("multiLine", True).option("mode", "FAILFAST").json(path)
    flat = raw.select(F.explode("nodes").alias("key", "v"))
    nodes = flat.select(
        "key", F.coalesce("v.node_id", "key").alias("node_id"), "v.scenario_id", F.coalesce("v.type", F.lit("question")).alias("type"), "v.text",
        F.col("v.answer.text").alias("answer_text"), F.col("v.answer.source").alias("answer_source"),
        F.col("v.answer.answer_ref.sheet").alias("ref_sheet"), F.col("v.answer.answer_ref.row").alias("ref_row"),
    )
    edges = flat.select("key", F.posexplode("v.options").alias("ord", "o")).select(F.col("key").alias("node_id"), "ord", "o.option_id", "o.label", "o.next_node_id")
    return nodes, edges, raw.select(F.col("root_node_id").alias("node_id"))
