"""Format dispatch and table metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.types import nan_to_null
from tessera.sources.delimited import read_delimited
from tessera.sources.excel import read_excel
from tessera.sources.jsonfile import read_json

SUPPORTED = (".xlsx", ".xls", ".json", ".tsv", ".csv", ".parquet")


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Pick a reader from the (lower-cased) extension of ``path``."""
    name = path.rstrip("/").lower()
    if name.endswith((".xlsx", ".xls")):
        df = read_excel(spark, path)
    elif name.endswith(".json"):
        df = read_json(spark, path)
    elif name.endswith(".tsv"):
        df = read_delimited(spark, path, sep="\t")
    elif name.endswith(".csv"):
        df = read_delimited(spark, path)
    elif name.endswith(".parquet"):
        df = spark.read.parquet(path)
    else:
        raise ValueError(f"unsupported format: {path!r}; use CSV, TSV, JSON, XLSX or Parquet")
    return nan_to_null(df)


_WIDTH = {T.ByteType: 1, T.ShortType: 2, T.IntegerType: 4, T.LongType: 8, T.FloatType: 4, T.DoubleType: 8,
          T.BooleanType: 1, T.DateType: 4, T.TimestampType: 8, T.TimestampNTZType: 8, T.DecimalType: 16}


def _bytes(f: T.StructField):
    c = F.col(f"`{f.name}`")
    if isinstance(f.dataType, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0)).cast("long")
    for t, w in _WIDTH.items():
        if isinstance(f.dataType, t):
            return F.lit(w).cast("long")
    return F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0)).cast("long")


def table_metadata(df: DataFrame) -> DataFrame:
    """One row: n_rows, n_cols, columns, dtypes, memory_mb.  memory_mb is
    the logical size (fixed widths, UTF-8 bytes of text) in MiB, 3 dp; it
    is not an in-memory footprint."""
    fields = df.schema.fields
    total = F.lit(0).cast("long")
    for f in fields:
        total = total + _bytes(f)
    a = df.agg(F.count(F.lit(1)).alias("n_rows"), F.sum(total).alias("b"))
    return a.select(
        "n_rows", F.lit(len(fields)).alias("n_cols"),
        F.lit(",".join(df.columns)).alias("columns"),
        F.lit(",".join(f.dataType.simpleString() for f in fields)).alias("dtypes"),
        F.bround(F.coalesce(F.col("b"), F.lit(0)) / F.lit(1048576.0), 3).alias("memory_mb"))
