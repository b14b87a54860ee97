"""Workbooks as a data source of Spark: ``spark.read.format("workbook")`` and ``frame.write.format("workbook")``.

A reader has one partition for each sheet of each file, and reads its rows as
they come.  A writer makes one workbook a task, in a folder of its own; the files
leave it when all tasks have ended, and a failed write takes it away.  What a killed task
writes after that stays there and is never read.
Paths are those that ``pyarrow.fs`` reaches from driver and executors.
"""

from __future__ import annotations

import re
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

import pyarrow.fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from .faq import _NS, _REL, _column

SCHEMA = "path string, sheet string, row int, cells array<string>"
#: What XML cannot hold is written as _xHHHH_, and so is what looks like it: a rule of the format.
_BARE = re.compile("[\x00-\x08\x0b-\x1f￾￿]|_(?=x[0-9A-Fa-f]{4}_)")
_CODED = re.compile("_x([0-9A-Fa-f]{4})_")


def _coded(text: str) -> str:
    return escape(_BARE.sub(lambda m: f"_x{ord(m[0]):04X}_", text))


def _decoded(text: str) -> str:
    return _CODED.sub(lambda m: chr(int(m[1], 16)), text) if "_x" in text else text


def _letters(column: int) -> str:
    out, n = "", column + 1
    while n:
        n, rest = divmod(n - 1, 26)
        out = chr(65 + rest) + out
    return out


def _system(path: str):
    return pyarrow.fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pyarrow.fs.LocalFileSystem(), path)


@dataclass
class Sheet(InputPartition):
    """One sheet of one file, and its part of the archive."""

    path: str
    sheet: str
    member: str


class WorkbookReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[Sheet]:
        files, base = _system(self.path)
        info = files.get_file_info(base)
        if info.type == pyarrow.fs.FileType.File:
            found = [base]
        else:
            found = sorted(f.path for f in files.get_file_info(pyarrow.fs.FileSelector(base, allow_not_found=True)) if f.is_file and f.base_name.endswith(".xlsx") and not f.base_name.startswith(("_", ".")))
        out = []
        for path in found:
            with files.open_input_file(path) as data, zipfile.ZipFile(data) as book:
                targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
                for sheet in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{_NS}sheet"):
                    target = targets[sheet.get(_REL)].lstrip("/")
                    out.append(Sheet(path, sheet.get("name"), target if target.startswith("xl/") else f"xl/{target}"))
        return out or [Sheet("", "", "")]

    def read(self, part: Sheet) -> Iterator[tuple]:
        if not part.path:
            return
        files, _ = _system(self.path)
        with files.open_input_file(part.path) as data, zipfile.ZipFile(data) as book:
            shared: list[str] = []
            if "xl/sharedStrings.xml" in book.namelist():
                for item in ElementTree.fromstring(book.read("xl/sharedStrings.xml")):
                    shared.append(_decoded("".join(t.text or "" for t in item.iter(f"{_NS}t"))))
            with book.open(part.member) as xml:
                last = 0
                for _, row in ElementTree.iterparse(xml):
                    if row.tag != f"{_NS}row":
                        continue
                    cells: list[str | None] = []
                    for cell in row.iter(f"{_NS}c"):
                        at = _column(cell.get("r")) if cell.get("r") else len(cells)
                        cells += [None] * (at + 1 - len(cells))
                        value = cell.find(f"{_NS}v")
                        if cell.get("t") == "inlineStr":
                            cells[at] = _decoded("".join(t.text or "" for t in cell.iter(f"{_NS}t")))
                        elif value is not None and value.text is not None:
                            cells[at] = shared[int(value.text)] if cell.get("t") == "s" else value.text
                    last = int(row.get("r") or last + 1)
                    yield part.path, part.sheet, last, cells
                    row.clear()


@dataclass
class Written(WriterCommitMessage):
    temporary: str | None


class WorkbookWriter(DataSourceWriter):
    """Rows (sheet, row, cells) to workbooks; a task's rows must come sheet by sheet, in the order of their numbers."""

    def __init__(self, path: str):
        self.path, self.run = path, uuid.uuid4().hex

    def _room(self, base: str) -> str:
        """The folder of what this write has not committed."""
        return f"{base.rstrip('/')}/_temporary-{self.run}"

    def write(self, rows: Iterator) -> Written:
        files, base = _system(self.path)
        temporary, names = None, []
        try:
            rows = iter(rows)
            first = next(rows, None)
            if first is None:
                return Written(None)
            files.create_dir(self._room(base), recursive=True)
            temporary = f"{self._room(base)}/part-{uuid.uuid4().hex}.xlsx"
            with files.open_output_stream(temporary) as data, zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as book:
                row = first
                while row is not None:
                    if row["sheet"] in names:
                        raise ValueError(f"the rows of sheet {row['sheet']} are apart")
                    names.append(row["sheet"])
                    with book.open(f"xl/worksheets/sheet{len(names)}.xml", "w", force_zip64=True) as xml:
                        row = self._sheet(xml, row, rows)
                self._frame(book, names)
            return Written(temporary)
        except BaseException:
            if temporary and files.get_file_info(temporary).is_file:
                files.delete_file(temporary)
            raise

    @staticmethod
    def _sheet(xml, row, rows):
        """Write the rows of one sheet; returns the first row of the next one."""
        name, last = row["sheet"], 0
        xml.write(f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{_NS[1:-1]}"><sheetData>'.encode())
        while row is not None and row["sheet"] == name:
            if row["row"] <= last:
                raise ValueError(f"row {row['row']} of sheet {name} comes after row {last}")
            last = row["row"]
            cells = "".join(f'<c r="{_letters(k)}{last}" t="inlineStr"><is><t xml:space="preserve">{_coded(c)}</t></is></c>' for k, c in enumerate(row["cells"]) if c is not None)
            xml.write(f'<row r="{last}">{cells}</row>'.encode())
            row = next(rows, None)
        xml.write(b"</sheetData></worksheet>")
        return row

    @staticmethod
    def _frame(book: zipfile.ZipFile, names: list[str]) -> None:
        head, kinds = '<?xml version="1.0" encoding="UTF-8"?>', "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
        package = "http://schemas.openxmlformats.org/package/2006"
        sheets = "".join(f'<sheet name={quoteattr(n)} sheetId="{k}" r:id="rId{k}"/>' for k, n in enumerate(names, 1))
        book.writestr("xl/workbook.xml", f'{head}<workbook xmlns="{_NS[1:-1]}" xmlns:r="{kinds}"><sheets>{sheets}</sheets></workbook>')
        links = "".join(f'<Relationship Id="rId{k}" Type="{kinds}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in range(1, len(names) + 1))
        book.writestr("xl/_rels/workbook.xml.rels", f'{head}<Relationships xmlns="{package}/relationships">{links}</Relationships>')
        book.writestr("_rels/.rels", f'{head}<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{kinds}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        sheet = "application/vnd.openxmlformats-officedocument.spreadsheetml"
        parts = "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="{sheet}.worksheet+xml"/>' for k in range(1, len(names) + 1))
        book.writestr("[Content_Types].xml", f'{head}<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{sheet}.sheet.main+xml"/>{parts}</Types>')

    def commit(self, messages: list[Written | None]) -> None:
        files, base = _system(self.path)
        for m in messages:
            if m is not None and m.temporary:
                files.move(m.temporary, f"{base.rstrip('/')}/{m.temporary.rpartition('/')[2]}")
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        """Delete what is not committed, also what tasks have left that were killed as they wrote."""
        files, base = _system(self.path)
        if files.get_file_info(self._room(base)).type == pyarrow.fs.FileType.Directory:
            files.delete_dir(self._room(base))


class WorkbookSource(DataSource):
    """The format ``workbook``: reads a file or the files of a folder; writes to a folder."""

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WorkbookReader:
        return WorkbookReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> WorkbookWriter:
        if overwrite:
            raise ValueError("workbooks are only appended")
        return WorkbookWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    """Make the format known to the session."""
    spark.dataSource.register(WorkbookSource)
