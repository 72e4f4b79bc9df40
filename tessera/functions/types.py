"""Type rules.

Three different notions of "numeric" matter (see README):

* ``numeric_cols``      -- NumericType, booleans excluded (statistics,
  outliers, scaling, cluster profiles, correlation);
* ``profiler-numeric``  -- numeric plus boolean (semantic type);
* ``categorical_cols``  -- strings only (encoding).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def numeric_cols(df: DataFrame, columns: list[str] | None = None) -> list[str]:
    """Numeric (non-boolean) columns; when ``columns`` is given, keep its
    order and drop the non-numeric names."""
    num = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    if columns is None:
        return num
    numset = set(num)
    return [c for c in columns if c in numset]


def string_cols(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def non_numeric_cols(df: DataFrame) -> list[str]:
    """Everything that is not NumericType (booleans, dates, strings, ...)."""
    return [f.name for f in df.schema.fields if not isinstance(f.dataType, T.NumericType)]


def is_datetime_type(dt: T.DataType) -> bool:
    return isinstance(dt, (T.TimestampType, T.TimestampNTZType, T.DateType))


def nan_to_null(df: DataFrame) -> DataFrame:
    """Turn NaN into null once, at the boundary; operators then only see null."""
    out = []
    changed = False
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            out.append(F.nanvl(qcol(f.name), F.lit(None).cast(f.dataType)).alias(f.name))
            changed = True
        else:
            out.append(qcol(f.name))
    return df.select(*out) if changed else df


def as_text(col: Column, dt: T.DataType) -> Column:
    """Render a value as the string pandas' ``str()`` would show."""
    if isinstance(dt, T.BooleanType):
        return F.when(col, F.lit("True")).when(~col, F.lit("False"))
    return col.cast("string")


def qcol(name: str) -> Column:
    """Column reference that tolerates dots, spaces and backticks in the name."""
    return F.col("`" + name.replace("`", "``") + "`")


def melt(df: DataFrame, cells: Sequence[tuple[str, Column]], keep: Sequence[str] = (), name: str = "column",
         value: str = "value") -> DataFrame:
    """(keep..., name, value): a row per input row and cell; any column names will do."""
    pairs = [x for n, c in cells for x in (F.lit(n), c)]
    return df.select(*[qcol(k) for k in keep], F.stack(F.lit(len(cells)), *pairs).alias(name, value))


ROWS_PER_TASK = 500_000


def spread(df: DataFrame, rows: int = 0) -> DataFrame:
    """Give an input of few partitions (e.g. one Parquet row group) at least
    one partition per core before heavy per-row work, and one for each
    ``ROWS_PER_TASK`` of its ``rows``, so that what a task reads does not grow
    with the input.  Inputs that have that many are untouched, unless one of
    their partitions holds more rows: a file is cut into splits by bytes, and
    all rows of a row group are in one of them, others are empty."""
    wanted = max(df.sparkSession.sparkContext.defaultParallelism, math.ceil(rows / ROWS_PER_TASK))
    if df.rdd.getNumPartitions() < wanted:
        return df.repartition(wanted)
    return df.repartition(wanted) if rows > ROWS_PER_TASK and largest_partition(df) > ROWS_PER_TASK else df


def largest_partition(df: DataFrame) -> int:
    """Rows of the largest partition."""
    return df.groupBy(F.spark_partition_id().alias("partition")).count().agg(F.max("count")).first()[0] or 0
