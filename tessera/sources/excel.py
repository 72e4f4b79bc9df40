"""Excel workbooks (.xlsx) from any file system that Spark reads.

Workbooks come as binary files, one row each, and their first sheet is
parsed in the task by the standard library (zip + XML, the sheet as a stream
of rows), so no workbook passes through the driver; only the headers do.
The first row is the header.  Workbooks are united by column name; a column
that one lacks is null in its rows.  Cells whose style is a date format
become timestamps where all values of a column are such; other values are
typed by the rules of delimited text.
"""

from __future__ import annotations

import io
import posixpath
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.types import qcol
from tessera.session import stored
from tessera.sources.delimited import apply_null_tokens, fix_names, infer_types, list_files

NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main",
      "r": "http://schemas.openxmlformats.org/officeDocument/2006/relationships",
      "rel": "http://schemas.openxmlformats.org/package/2006/relationships"}
MAIN = f"{{{NS['m']}}}"
# The built-in number formats that show dates or times.
DATE_FORMAT_IDS = {14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47}
#: Put before the text of a date, until the types of the columns are known.
DATE_MARK = "\x00"
ROWS_PER_BATCH = 4096


def _local(path: str) -> str:
    return path[5:] if path.startswith("file:") else path


def _col_index(ref: str) -> int:
    letters = re.match(r"[A-Z]+", ref).group(0)
    n = 0
    for ch in letters:
        n = n * 26 + (ord(ch) - 64)
    return n - 1


def _is_date_code(code: str) -> bool:
    """Whether a custom number format shows a date or time: a letter of one outside quotes, brackets and escapes."""
    bare = re.sub(r'"[^"]*"|\\.|_.|\*.|\[(?!h+\]|m+\]|s+\])[^\]]*\]', "", code.split(";")[0])
    return bool(re.search(r"[ymdhs]", bare, re.IGNORECASE)) and bare.strip().lower() != "general"


class Workbook:
    """First sheet of a workbook given as bytes: ``rows`` gives lists of cell
    texts, None where a cell is missing, dates as ISO text behind DATE_MARK."""

    def __init__(self, content: bytes) -> None:
        self.zip = zipfile.ZipFile(io.BytesIO(content))
        names = set(self.zip.namelist())
        self.shared = []
        if "xl/sharedStrings.xml" in names:
            for si in ET.fromstring(self.zip.read("xl/sharedStrings.xml")).findall("m:si", NS):
                self.shared.append("".join(t.text or "" for t in si.iter(MAIN + "t")))
        book = ET.fromstring(self.zip.read("xl/workbook.xml"))
        props = book.find("m:workbookPr", NS)
        since_1904 = props is not None and props.get("date1904") in ("1", "true")
        self.epoch = datetime(1904, 1, 1) if since_1904 else datetime(1899, 12, 30)
        rid = book.find("m:sheets/m:sheet", NS).get(f"{{{NS['r']}}}id")
        rels = ET.fromstring(self.zip.read("xl/_rels/workbook.xml.rels"))
        target = next(r.get("Target") for r in rels.findall("rel:Relationship", NS) if r.get("Id") == rid)
        self.sheet = target.lstrip("/") if target.startswith("/") else posixpath.normpath(posixpath.join("xl", target))
        self.dates = self._date_styles(ET.fromstring(self.zip.read("xl/styles.xml"))) if "xl/styles.xml" in names else set()

    @staticmethod
    def _date_styles(styles: ET.Element) -> set[int]:
        """Numbers of the cell styles whose format shows a date or time."""
        own = {int(f.get("numFmtId")) for f in styles.findall("m:numFmts/m:numFmt", NS) if _is_date_code(f.get("formatCode") or "")}
        formats = [int(x.get("numFmtId") or 0) for x in styles.findall("m:cellXfs/m:xf", NS)]
        return {i for i, f in enumerate(formats) if f in own or f in DATE_FORMAT_IDS}

    def _text(self, c: ET.Element) -> str | None:
        kind, v = c.get("t"), c.find("m:v", NS)
        if kind == "inlineStr":
            return "".join(x.text or "" for x in c.iter(MAIN + "t"))
        if v is None or v.text is None:
            return None
        if kind == "s":
            return self.shared[int(v.text)]
        if kind == "b":
            return "True" if v.text == "1" else "False"
        if kind in (None, "n") and int(c.get("s") or 0) in self.dates:
            when = self.epoch + timedelta(milliseconds=round(float(v.text) * 86_400_000))
            return DATE_MARK + when.isoformat(sep=" ")
        return v.text

    def rows(self) -> Iterator[list[str | None]]:
        with self.zip.open(self.sheet) as stream:
            for _, row in ET.iterparse(stream):
                if row.tag != MAIN + "row":
                    continue
                cells: dict[int, str | None] = {}
                for at, c in enumerate(row.findall("m:c", NS)):
                    cells[_col_index(c.get("r")) if c.get("r") else at] = self._text(c)
                row.clear()  # a sheet is never held as a tree
                if cells:
                    yield [cells.get(i) for i in range(max(cells) + 1)]


def _names(header: list[str | None]) -> list[str]:
    return fix_names([(h or "").removeprefix(DATE_MARK) for h in header])


def _headers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
            header = next(Workbook(content.as_py()).rows(), None)
            if header is not None:
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([_names(header)], pa.list_(pa.string()))], names=["path", "names"])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def made(rows: list[list[tuple]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(rows, pa.map_(pa.string(), pa.string()))], names=["cells"])

    for batch in batches:
        for content in batch.column("content"):
            sheet = Workbook(content.as_py()).rows()
            names, rows = _names(next(sheet, [])), []
            for values in sheet:
                rows.append([(n, v) for n, v in zip(names, values) if v is not None])
                if len(rows) == ROWS_PER_BATCH:
                    yield made(rows)
                    rows = []
            if rows:
                yield made(rows)


def read_excel(spark: SparkSession, path: str) -> DataFrame:
    """First sheet of every workbook under ``path``."""
    files = [f for f in list_files(spark, path) if f.lower().endswith((".xlsx", ".xlsm"))]
    if not files:
        raise ValueError(f"no .xlsx workbooks at {path}")
    books = spark.read.format("binaryFile").load(files).select("path", "content")
    try:
        found = books.mapInArrow(_headers, "path string, names array<string>").orderBy("path").collect()
        cells = stored(books.select("content").mapInArrow(_rows, "cells map<string,string>"), "workbooks")
    except Exception as e:  # noqa: BLE001
        raise ValueError(f"could not read Excel file: {e}") from e
    names = list(dict.fromkeys(n for r in found for n in r["names"]))
    table = cells.select(*[F.try_element_at("cells", F.lit(n)).alias(n) for n in names])
    if not names:
        return table
    dated = table.agg(*[(F.count_if(F.startswith(qcol(n), F.lit(DATE_MARK))) == F.count(qcol(n))).alias(f"d{i}") for i, n in enumerate(names)],
                      *[F.count(qcol(n)).alias(f"n{i}") for i, n in enumerate(names)]).first()
    bare = [F.regexp_replace(qcol(n), f"^{DATE_MARK}", "") for n in names]
    return infer_types(apply_null_tokens(table.select(*[
        (x.cast("timestamp_ntz") if dated[f"n{i}"] and dated[f"d{i}"] else x).alias(n) for i, (n, x) in enumerate(zip(names, bare))])))


def _xlsx_bytes(header: list[str], rows: list[list]) -> bytes:
    """Minimal one-sheet workbook with inline strings and numbers."""
    def cell(ref, v):
        if v is None:
            return ""
        if isinstance(v, bool):
            return f'<c r="{ref}" t="b"><v>{int(v)}</v></c>'
        if isinstance(v, (int, float)):
            return f'<c r="{ref}"><v>{v!r}</v></c>'
        from xml.sax.saxutils import escape
        return f'<c r="{ref}" t="inlineStr"><is><t>{escape(str(v))}</t></is></c>'

    def ref(ci, ri):
        s, n = "", ci + 1
        while n:
            n, rem = divmod(n - 1, 26)
            s = chr(65 + rem) + s
        return f"{s}{ri}"

    body = []
    for ri, r in enumerate([header] + rows, start=1):
        body.append(f'<row r="{ri}">' + "".join(cell(ref(ci, ri), v) for ci, v in enumerate(r)) + "</row>")
    sheet = ('<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="%s"><sheetData>%s</sheetData></worksheet>'
             % (NS["m"], "".join(body)))
    files = {
        "[Content_Types].xml": '<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>',
        "_rels/.rels": '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="%s"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>' % NS["rel"],
        "xl/workbook.xml": '<?xml version="1.0" encoding="UTF-8"?><workbook xmlns="%s" xmlns:r="%s"><sheets><sheet name="Sheet1" sheetId="1" r:id="rId1"/></sheets></workbook>' % (NS["m"], NS["r"]),
        "xl/_rels/workbook.xml.rels": '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="%s"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet1.xml"/></Relationships>' % NS["rel"],
        "xl/worksheets/sheet1.xml": sheet,
    }
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in files.items():
            z.writestr(name, text)
    return buf.getvalue()


def write_xlsx_parts(df: DataFrame, folder: str) -> str:
    """Write each partition of ``df`` as one workbook in ``folder`` (a
    shared location), from the tasks themselves."""
    import os
    import uuid

    header = list(df.columns)
    target = _local(folder)

    def write(it):
        rows = [list(r) for r in it]
        if rows:
            os.makedirs(target, exist_ok=True)
            with open(os.path.join(target, f"part-{uuid.uuid4().hex}.xlsx"), "wb") as fh:
                fh.write(_xlsx_bytes(header, rows))

    df.foreachPartition(write)
    return folder
