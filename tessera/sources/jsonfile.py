"""JSON tables: an array of records, newline-delimited records, or one
column-oriented object ``{column: {row: value}}`` per file.

A column-oriented file is one document, but never one string here: it is read
in pieces between commas, the pieces of a file are brought together in
order (a shuffle by file and a sort in its partition), and a parser takes
them as a stream and gives a row per cell. Rows are put together by file and
row key, so files may share keys."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.types import qcol
from tessera.session import stored
from tessera.sources.delimited import infer_types, list_files

PIECE_END = ","
BLANK = " \t\r\n﻿"
_TEXT = json.JSONDecoder(parse_float=str, parse_int=str, parse_constant=str)


class ColumnStream:
    """Cells of one column-oriented document that arrives in pieces.

    ``feed`` gives the (column number, column, row, value) that a piece
    completes; values are text as delimited files have it, None for null, and
    JSON text for lists and objects.  Anything else raises ValueError."""

    def __init__(self) -> None:
        self.rest, self.state, self.column, self.number, self.retry = "", "start", "", -1, 0

    def _skip(self, at: int) -> int:
        while at < len(self.rest) and self.rest[at] in BLANK:
            at += 1
        return at

    def _key(self, at: int) -> tuple[str, int]:
        """A key and the place of its value; IndexError where the text ends before that."""
        if self.rest[at] != '"':
            raise ValueError(f"a key was expected, not {self.rest[at : at + 20]!r}")
        key, at = _TEXT.raw_decode(self.rest, at)
        at = self._skip(at)
        if self.rest[at] != ":":
            raise ValueError("a colon was expected")
        return key, self._skip(at + 1)

    def _value(self, at: int) -> tuple[str | None, int]:
        value, end = _TEXT.raw_decode(self.rest, at)
        if isinstance(value, (dict, list)):
            return self.rest[at:end], end
        return (None if value is None else str(value)), end

    def _step(self, at: int, last: bool) -> tuple[int, tuple | None]:
        """Take one mark or one cell; where the text ends before that, IndexError or JSONDecodeError."""
        mark, cell = self.rest[at], None
        if self.state == "end":
            raise ValueError("text after the document")
        if self.state == "start":
            if mark != "{":
                raise ValueError("not an object")
            self.state, at = "column", at + 1
        elif mark == "}" and self.state != "start":  # of a column, or of the document
            inside = self.state in ("row", "after cell")
            self.state, at = "after column" if inside else "end", at + 1
        elif self.state.startswith("after"):
            if mark != ",":
                raise ValueError("a comma or a brace was expected")
            self.state, at = "row" if self.state == "after cell" else "column", at + 1
        elif self.state == "column":
            name, at = self._key(at)
            if self.rest[at] != "{":
                raise ValueError("a column is no object")
            self.column, self.number, self.state, at = name, self.number + 1, "row", at + 1
        else:
            row, at = self._key(at)
            value, at = self._value(at)
            if at == len(self.rest) and not last:
                raise IndexError  # a number may go on
            self.state, cell = "after cell", (self.number, self.column, row, value)
        return at, cell

    def feed(self, piece: str, last: bool = False) -> Iterator[tuple[int, str, str, str | None]]:
        self.rest += piece
        if len(self.rest) < self.retry and not last:
            return  # a long value goes on; it is not tried again at each piece
        self.retry, at = 0, 0
        try:
            while (at := self._skip(at)) < len(self.rest):
                at, cell = self._step(at, last)
                if cell is not None:
                    yield cell
        except (IndexError, json.JSONDecodeError):
            self.retry = 2 * (len(self.rest) - at)
        self.rest = self.rest[at:]
        if last and (self.state != "end" or self.rest):
            raise ValueError("the document is broken or ends early")


def _pieces(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, start, at, value): the text between commas, in the order of (start, at) within a file."""
    text = spark.read.option("lineSep", PIECE_END).text(path)
    meta = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")]
    return text.select("value", *meta).withColumn("at", F.monotonically_increasing_id())


def _first_mark(spark: SparkSession, file: str) -> str:
    """The first character that is not blank; only that leaves the task."""
    row = (spark.read.option("lineSep", "{").text(file)
           .select(F.substring(F.ltrim(F.translate("value", "\t\r\n﻿", "    ")), 1, 1).alias("c")).first())
    return "" if row is None else (row["c"] or "{")


def _decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whether the first block of a file reads as columns: 'columns' or 'records'."""
    stream, held, found = ColumnStream(), None, "columns"
    try:
        for batch in batches:
            for value in batch.column("value").to_pylist():
                if held is not None:  # a piece is followed by its comma once the next one is there
                    list(stream.feed(held + PIECE_END))
                held = value
        list(stream.feed(held or ""))
    except ValueError:
        found = "records"
    if held is not None:
        yield pa.RecordBatch.from_arrays([pa.array([found])], names=["layout"])


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """The layout is that of the first file. Values of column-oriented files
    are typed by the rules of delimited text, their rows ordered by file and
    key; a column that a file lacks is null in its rows."""
    files = list_files(spark, path)
    if not files:
        raise ValueError(f"no files at {path}")
    try:
        if _first_mark(spark, files[0]) == "[":
            return spark.read.option("multiLine", True).json(path)
        layout = _pieces(spark, files[0]).where("start = 0").mapInArrow(_decide, "layout string").first()
        if layout is not None and layout["layout"] == "columns":
            return _columnar(spark, path)
        df = spark.read.json(path)
        if "_corrupt_record" in df.columns:
            raise ValueError("malformed JSON records")
        return df
    except ValueError:
        raise
    except Exception as e:  # noqa: BLE001
        raise ValueError(f"could not read JSON at {path}: {e}") from e


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, number, column, row, value) of the files whose pieces come in order, one file after another."""
    name, stream, held = None, ColumnStream(), None
    rows: list[tuple] = []

    def flush() -> pa.RecordBatch:
        columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int32(), pa.string(), pa.string(), pa.string()))]
        rows.clear()
        return pa.RecordBatch.from_arrays(columns, names=["file", "number", "column", "row", "value"])

    for batch in batches:
        for file, value in zip(batch.column("file").to_pylist(), batch.column("value").to_pylist()):
            if file != name:
                if held is not None:
                    rows.extend((name, *cell) for cell in stream.feed(held, last=True))
                name, stream, held = file, ColumnStream(), None
            if held is not None:
                rows.extend((name, *cell) for cell in stream.feed(held + PIECE_END))
            held = value
        if rows:
            yield flush()
    if held is not None:
        rows.extend((name, *cell) for cell in stream.feed(held, last=True))
        yield flush()


def _columnar(spark: SparkSession, path: str) -> DataFrame:
    """{col: {row: value}} of each file -> rows ordered by file and row key."""
    ordered = _pieces(spark, path).repartition("file").sortWithinPartitions("file", "start", "at")
    schema = "file string, number int, column string, row string, value string"
    cells = stored(ordered.select("file", "value").mapInArrow(_cells, schema), "json-cells")
    first = cells.groupBy("column").agg(F.min(F.struct("file", "number")).alias("at")).orderBy("at").collect()
    names = [r["column"] for r in first]
    keys = [F.col("file").alias("__file"), F.col("row").alias("__row")]
    wide = cells.groupBy(*keys).pivot("column", names).agg(F.first("value"))
    rows = wide.orderBy("__file", F.col("__row").try_cast("bigint"), "__row")
    return infer_types(rows.select(*[qcol(n) for n in names]))
