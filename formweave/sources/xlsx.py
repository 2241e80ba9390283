"""Spreadsheets as a Spark data source: sheets of .xlsx files are read and written with the standard library."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from formweave.catalog import KEYS, header_names
from formweave.operators.records import map_headers

MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def column_number(ref: str) -> int:
    n = 0
    for ch in re.match("[A-Z]*", ref)[0]:
        n = 26 * n + ord(ch) - 64
    return n - 1


def column_letters(n: int) -> str:
    out = ""
    while n >= 0:
        out, n = chr(65 + n % 26) + out, n // 26 - 1
    return out


def sheet_cells(content: bytes) -> Iterator[tuple[int, int, str]]:
    """row, col, text of the cells of the active sheet that have a value."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        book = ElementTree.fromstring(z.read("xl/workbook.xml"))
        view = book.find(f"{MAIN}bookViews/{MAIN}workbookView")
        sheets = book.findall(f"{MAIN}sheets/{MAIN}sheet")
        wanted = sheets[int(view.get("activeTab", 0)) if view is not None else 0].get(LINK)
        rels = ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))
        target = next(r.get("Target") for r in rels if r.get("Id") == wanted).lstrip("/")
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{MAIN}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))]
        sheet = ElementTree.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}"))
        for r, row in enumerate(sheet.iter(f"{MAIN}row")):
            r = int(row.get("r", r + 1)) - 1
            for c, cell in enumerate(row.iter(f"{MAIN}c")):
                c = column_number(cell.get("r")) if cell.get("r") else c
                kind, value = cell.get("t"), cell.find(f"{MAIN}v")
                if kind == "inlineStr":
                    yield r, c, "".join(t.text or "" for t in cell.iter(f"{MAIN}t"))
                elif value is not None and value.text is not None:
                    yield r, c, shared[int(value.text)] if kind == "s" else value.text


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    """sheet (path of the file), row, col, text; one task reads a file, which is small."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch["path"].to_pylist(), batch["content"].to_pylist()):
                cells = list(sheet_cells(content))
                columns = [[name] * len(cells), [c[0] for c in cells], [c[1] for c in cells], [c[2] for c in cells]]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.string(), pa.int32(), pa.int32(), pa.string()))], names=["sheet", "row", "col", "text"])

    return files.select("path", "content").mapInArrow(run, "sheet string, row int, col int, text string")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """sheet, pos and a column for each field from sheets whose first row has headers; missing values are empty.

    Sheets without a record number (or ID) column give no records.
    """
    cells = read_cells(spark, path)
    headers = cells.where("row = 0").select("sheet", "col", F.col("text").alias("header"))
    columns = map_headers(headers, header_names(spark))
    named = columns.join(columns.where("key = 'record_no'").select("sheet"), "sheet", "left_semi")
    values = cells.where("row > 0").join(named, ["sheet", "col"], "left")
    wide = values.withColumn("text", F.trim("text")).groupBy("sheet", "row").pivot("key", KEYS).agg(F.first("text"))
    wide = wide.join(named.select("sheet").distinct(), "sheet", "left_semi")
    place = F.row_number().over(W.partitionBy("sheet").orderBy("row")).cast("long") - 1
    return wide.select("sheet", place.alias("pos"), *(F.coalesce(k, F.lit("")).alias(k) for k in KEYS))


PARTS = {
    "[Content_Types].xml": '<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>',
    "_rels/.rels": '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>',
    "xl/_rels/workbook.xml.rels": '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
}


def workbook(rows: list[list], name: str = "Sheet") -> bytes:
    """A file with one sheet; numbers are number cells, other values text."""
    lines = []
    for r, row in enumerate(rows, 1):
        cells = []
        for c, v in enumerate(row):
            ref = f"{column_letters(c)}{r}"
            if isinstance(v, (int, float)):
                cells.append(f'<c r="{ref}"><v>{v}</v></c>')
            elif v not in (None, ""):
                cells.append(f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>')
        lines.append(f'<row r="{r}">{"".join(cells)}</row>')
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for path, text in PARTS.items():
            z.writestr(path, text)
        z.writestr("xl/workbook.xml", f'<?xml version="1.0" encoding="UTF-8"?><workbook xmlns="{MAIN[1:-1]}" xmlns:r="{LINK[1:-3]}"><sheets><sheet name="{escape(name)}" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/worksheets/sheet1.xml", f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{MAIN[1:-1]}"><sheetData>{"".join(lines)}</sheetData></worksheet>')
    return out.getvalue()


def as_workbooks(rows: DataFrame, by: str, order: str, most: int = 1_000_000) -> DataFrame:
    """by, content: one workbook for each value of a column, its rows in order under a header.

    A sheet holds 1 048 576 rows at most, so larger groups go into several workbooks of `most` rows.
    """
    names = [c for c in rows.columns if c not in (by, order)]
    part = F.floor((F.row_number().over(W.partitionBy(by).orderBy(order)) - 1) / most).cast("long")

    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by(order)
        body = list(zip(*(table[n].to_pylist() for n in names)))
        name = re.sub(r"[\\/?*\[\]:]", "", str(key[0].as_py()))[:31] or "Sheet"
        return pa.table({by: pa.array([key[0].as_py()], table[by].type), "part": [key[1].as_py()], "content": pa.array([workbook([names, *body], name)], pa.binary())})

    return rows.withColumn("part", part).groupBy(by, "part").applyInArrow(run, f"{by} {dict(rows.dtypes)[by]}, part long, content binary")
