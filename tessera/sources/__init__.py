"""Readers for delimited text, JSON, Excel and Parquet tables."""

from tessera.sources.delimited import detect_separator, read_delimited
from tessera.sources.dispatch import read_table, table_metadata
from tessera.sources.excel import read_excel
from tessera.sources.jsonfile import read_json

__all__ = ["detect_separator", "read_delimited", "read_excel", "read_json", "read_table", "table_metadata"]
