"""Workbooks (XLSX): rows in by a Python function over batches of the files' bytes, sheets out by a Python data source.

Files come through Spark's own reader, a file a row, so that they may be in any store; each is unzipped and parsed in its task.
A written folder has a workbook for each partition, as a cluster cannot write one file from many tasks.
"""

from __future__ import annotations

import io
import os
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

# Names of the format.
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
KIND = "http://schemas.openxmlformats.org"
MOST_ROWS, MOST_LETTERS = 1_048_575, 32_767
#: Bytes that a workbook may unpack to.
MOST_BYTES = 1 << 30
#: Rows that are handed on at once.
ROWS_A_BATCH = 1_000
ILLEGAL = re.compile("[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\ud800-\\udfff\\ufffe\\uffff]")


def column_number(reference: str) -> int:
    """0 for A, 26 for AA."""
    n = 0
    for c in reference:
        if not c.isalpha():
            break
        n = n * 26 + ord(c.upper()) - 64
    return n - 1


def text_in(node: ElementTree.Element) -> str:
    return "".join(t.text or "" for t in node.iter(f"{MAIN}t"))


def sheets_of(z: zipfile.ZipFile) -> list[tuple[str, str]]:
    """Names and paths of the sheets, in order."""
    links = {r.get("Id"): r.get("Target", "") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    book = ElementTree.fromstring(z.read("xl/workbook.xml"))
    paths = ((s.get("name", ""), links.get(s.get(LINK), "")) for s in book.iter(f"{MAIN}sheet"))
    return [(name, p.lstrip("/") if p.startswith("/") else f"xl/{p}") for name, p in paths if p]


def cells_of(z: zipfile.ZipFile, path: str, shared: list[str]) -> Iterator[tuple[int, list[str | None]]]:
    """Number and values of each row that has any, as texts."""
    with z.open(path) as f:
        data = None
        for event, row in ElementTree.iterparse(f, ("start", "end")):
            if event == "start":
                data = row if row.tag == f"{MAIN}sheetData" else data
                continue
            if row.tag != f"{MAIN}row":
                continue
            values: list[str | None] = []
            for k, c in enumerate(row.iter(f"{MAIN}c")):
                at = column_number(c.get("r")) if c.get("r") else k
                values += [None] * (at + 1 - len(values))
                kind, v = c.get("t"), c.find(f"{MAIN}v")
                if kind == "inlineStr":
                    values[at] = text_in(c)
                elif v is not None and v.text is not None:
                    values[at] = shared[int(v.text)] if kind == "s" else v.text
            yield int(row.get("r") or 0), values
            # Rows that are read leave nothing behind, not even their places.
            row.clear() if data is None else data.clear()


def rows_of(content: bytes) -> Iterator[tuple[str, int, int, list[str | None]]]:
    """The rows of all sheets of a workbook given as bytes. One that is none, or unpacks to too much, is refused."""
    z = zipfile.ZipFile(io.BytesIO(content))
    if sum(i.file_size for i in z.infolist()) > MOST_BYTES:
        raise ValueError(f"the workbook unpacks to more than {MOST_BYTES} bytes")
    shared = [text_in(s) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in z.namelist() else []
    for number, (name, path) in enumerate(sheets_of(z), 1):
        for row, values in cells_of(z, path, shared):
            yield name, number, row, values


def batches_of(files: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of workbooks, handed on by the batch: a task never holds all rows of one."""
    for batch in files:
        for path, content in zip(batch["path"], batch["content"]):
            found = rows_of(content.as_py())
            while rows := list(islice(found, ROWS_A_BATCH)):
                yield pa.RecordBatch.from_arrays([pa.array([path.as_py()] * len(rows), pa.string()), *(pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int32(), pa.int32(), pa.list_(pa.string()))))], names=["path", "sheet", "sheet_number", "row_number", "cells"])


def workbook_rows(spark: SparkSession, path: str) -> DataFrame:
    """path, sheet, sheet_number, row_number, cells (texts) of all rows of the workbooks at a path."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(batches_of, "path string, sheet string, sheet_number int, row_number int, cells array<string>")


def read_workbook(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """One sheet of the workbooks at a path (without a name the only one) as columns of texts, named by its first row.

    Refused if there is no such sheet, if without a name there are several, or if workbooks have different first rows."""
    rows = workbook_rows(spark, path)
    found = rows.where(F.col("sheet") == sheet) if sheet is not None else rows
    first = found.groupBy("path", "sheet_number").agg(F.min_by("cells", "row_number").alias("title"), F.min("row_number").alias("row_number"))
    titles = first.groupBy("title").agg(F.max("sheet_number").alias("last")).limit(2).collect()
    if len(titles) != 1 or (sheet is None and titles[0].last != 1):
        raise ValueError(f"{len(titles)} kinds of sheets where one is wanted: {[t.title for t in titles]}")
    body = found.join(first.select("path", "sheet_number", F.col("row_number").alias("title_row")), ["path", "sheet_number"]).where("row_number > title_row")
    return body.select(*(F.get("cells", F.lit(i)).alias(t or f"column_{i + 1}") for i, t in enumerate(titles[0].title)))


def letters(n: int) -> str:
    out = ""
    while n >= 0:
        out, n = chr(65 + n % 26) + out, n // 26 - 1
    return out


def cell(value: object, reference: str) -> str:
    """A cell: numbers as such, all else as text that no spreadsheet takes for a formula, without characters that XML forbids."""
    if value is None:
        return ""
    if isinstance(value, bool):
        return f'<c r="{reference}" t="b"><v>{int(value)}</v></c>'
    if isinstance(value, (int, float)) and abs(value) < 10**15:
        return f'<c r="{reference}"><v>{value!r}</v></c>'
    x = str(value)
    x = ILLEGAL.sub("", "'" + x if x[:1] in ("=", "+", "-", "@", "\t", "\r") and isinstance(value, str) else x)[:MOST_LETTERS]
    return f'<c r="{reference}" t="inlineStr"><is><t xml:space="preserve">{escape(x)}</t></is></c>'


def write_parts(z: zipfile.ZipFile, sheet: str) -> None:
    """All of a workbook but the rows of its one sheet."""
    types = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    z.writestr("[Content_Types].xml", f'{head}<Types xmlns="{KIND}/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{types}.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{types}.worksheet+xml"/></Types>')
    z.writestr("_rels/.rels", f'{head}<Relationships xmlns="{KIND}/package/2006/relationships"><Relationship Id="r1" Type="{KIND}/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>')
    z.writestr("xl/workbook.xml", f'{head}<workbook xmlns="{MAIN[1:-1]}" xmlns:r="{LINK[1:-3]}"><sheets><sheet name="{escape(sheet[:31], {chr(34): "&quot;"})}" sheetId="1" r:id="r1"/></sheets></workbook>')
    z.writestr("xl/_rels/workbook.xml.rels", f'{head}<Relationships xmlns="{KIND}/package/2006/relationships"><Relationship Id="r1" Type="{KIND}/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet1.xml"/></Relationships>')


@dataclass
class Written(WriterCommitMessage):
    name: str | None


class WorkbookWriter(DataSourceWriter):
    """A task writes under a name of its own; on success of all the driver names the files, and else removes them."""

    def __init__(self, folder: str, sheet: str, columns: list[str], overwrite: bool):
        self.folder, self.sheet, self.columns, self.overwrite = folder, sheet, columns, overwrite

    def write(self, rows: Iterator) -> Written:
        import uuid

        from pyspark import TaskContext

        os.makedirs(self.folder, exist_ok=True)
        number = TaskContext.get().partitionId()
        name = f".part-{number:05d}-{uuid.uuid4().hex}.xlsx"
        n = 0
        with zipfile.ZipFile(f"{self.folder}/{name}", "w", zipfile.ZIP_DEFLATED) as z:
            write_parts(z, self.sheet)
            with z.open("xl/worksheets/sheet1.xml", "w", force_zip64=True) as f:
                f.write(f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?><worksheet xmlns="{MAIN[1:-1]}"><sheetData>'.encode())
                for n, row in enumerate([self.columns]):
                    f.write(line(n + 1, row).encode())
                for n, row in enumerate(rows, 1):
                    if n > MOST_ROWS:
                        raise ValueError(f"a sheet holds {MOST_ROWS} rows; repartition to write more workbooks")
                    f.write(line(n + 1, row).encode())
                f.write(b"</sheetData></worksheet>")
        if not n and number:  # the first partition has the header even if there are no rows
            os.remove(f"{self.folder}/{name}")
            return Written(None)
        return Written(name)

    def commit(self, messages: list) -> None:
        names = [m.name for m in messages if m and m.name]
        if self.overwrite:
            for old in os.listdir(self.folder):
                if old.endswith(".xlsx") and old not in names:
                    os.remove(f"{self.folder}/{old}")
        for name in names:
            os.replace(f"{self.folder}/{name}", f"{self.folder}/{name[1:]}")

    def abort(self, messages: list) -> None:
        for m in messages:
            if m and m.name and os.path.exists(f"{self.folder}/{m.name}"):
                os.remove(f"{self.folder}/{m.name}")


def line(number: int, row) -> str:
    return f'<row r="{number}">' + "".join(cell(v, f"{letters(i)}{number}") for i, v in enumerate(row)) + "</row>"


class WorkbookSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "offerlens_xlsx"

    def writer(self, schema, overwrite: bool) -> WorkbookWriter:
        return WorkbookWriter(self.options["path"], self.options.get("sheet", "Sheet1"), schema.names, overwrite)


def write_workbooks(sheets: dict[str, DataFrame], folder: str) -> None:
    """A folder of workbooks for each sheet, one a partition. The folder must be one that the driver and all executors share."""
    for name, df in sheets.items():
        df.sparkSession.dataSource.register(WorkbookSource)
        df.write.format("offerlens_xlsx").option("sheet", name).mode("overwrite").save(f"{folder}/{name}")
