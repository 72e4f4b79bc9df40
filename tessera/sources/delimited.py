"""Delimited text (CSV / TSV) with encoding and separator detection.

One scan of the lines (`survey`) gives, per file, its header line, whether all
of it is valid UTF-8, and whether a quoted value may run over a line end.
Files are then read in groups of the same header, encoding and layout, and the
groups are united by column name, so files need not agree in the order
of their columns; a column that a file lacks is null in its rows.

* encoding: a file with a line that is not valid UTF-8 is read as ISO-8859-1.
  cp1252 is not offered (Spark's CSV reader rejects it).
* separator: of ``,`` ``;`` tab ``|``, the most frequent over the first
  five lines of the first file; ties go to that order.
* records: values may be quoted with ``"``, doubled inside. A line that is no
  whole record by itself, as where a quoted value holds a line end, makes its
  file one that is read as a stream by one task; all other files are split.
* header: taken from the first line of each file; empty names become
  ``Unnamed: i`` and repeats get ``_1``, ``_2`` suffixes.
* a record with more values than its file's header is an error; missing
  values at a record's end are null; blank lines are skipped.
* nulls: the usual missing-value tokens (below) become null.
* types: one aggregate pass counts, per column, the values written as whole
  numbers, numbers and booleans; a column takes the narrowest type every
  non-null value fits, else stays text.
"""

from __future__ import annotations

import csv
import re
from collections.abc import Sequence
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.types import qcol

# Strings read as missing (pandas' default missing-value
# tokens), candidate separators in tie-break order, and the boolean words.
NULL_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
               "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]
SEPARATORS = [",", ";", "\t", "|"]
TRUE_WORDS = ["True", "TRUE", "true"]
FALSE_WORDS = ["False", "FALSE", "false"]
SNIFF_LINES = 5
# Names of the reader's own columns.
OVERFLOW, RECORD = "__overflow", "__record"
# How a number is written; Java's own parser would also take 12D, 7F or 0x1p3.
WHOLE = r"^\s*[+-]?[0-9]+\s*$"
NUMBER = r"(?i)^\s*[+-]?([0-9]+\.?[0-9]*(e[+-]?[0-9]+)?|\.[0-9]+(e[+-]?[0-9]+)?|inf|infinity)\s*$"


def list_files(spark: SparkSession, path: str) -> list[str]:
    """Data files under a path or glob (directories expanded, hidden and
    underscore files skipped), sorted, via the cluster's file system."""
    jvm = spark._jvm
    conf = spark._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(conf)
    stats = fs.globStatus(p) or []
    out = []
    for st in stats:
        if st.isDirectory():
            out += [c.getPath().toString() for c in fs.listStatus(st.getPath()) if c.isFile()]
        else:
            out.append(st.getPath().toString())
    keep = [f for f in out if not f.rsplit("/", 1)[-1].startswith(("_", "."))]
    return sorted(keep)


def _whole_record(line: Column, sep: str) -> Column:
    """Whether a line is a record by itself: every quote that opens a value is closed in it."""
    s = "\\t" if sep == "\t" else re.escape(sep)
    value = f'(?:"(?:[^"]++|"")*+"(?={s}|$)|(?!")[^{s}]*+)'
    return ~F.contains(line, F.lit('"')) | line.rlike(f"^{value}(?:{s}{value})*+$")


def survey(spark: SparkSession, path: str, sep: str) -> list[Row]:
    """(file, header, latin, streamed) of every file that has a line with text, in the order of their names."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"),
                                         F.col("_metadata.file_block_start").alias("start"))
    lines = lines.withColumn("at", F.monotonically_increasing_id())  # grows with the lines of a task's blocks
    valid = F.is_valid_utf8("value")
    text = F.when(valid, F.col("value")).otherwise(F.decode(F.col("value").cast("binary"), "ISO-8859-1"))
    first = (F.col("start") == 0) & (F.length(F.trim(text)) > 0)
    per = lines.groupBy("file").agg(F.min_by(F.when(first, text), F.when(first, F.col("at"))).alias("header"),
                                    F.bool_or(~valid).alias("latin"),
                                    F.bool_or(~_whole_record(text, sep)).alias("streamed"))
    return per.where("header IS NOT NULL").orderBy("file").collect()


def separator_counts(spark: SparkSession, first_file: str, encoding: str = "UTF-8") -> DataFrame:
    """One row per candidate separator: (separator, count, rank) over the
    first lines of one file."""
    # separators are ASCII, so the byte-level UTF-8 text reader counts them
    # correctly for single-byte encodings too
    lines = spark.read.text(first_file).limit(SNIFF_LINES)
    cnt = lines.agg(*[F.sum(F.length("value") - F.length(F.replace("value", F.lit(s), F.lit("")))).alias(f"s{i}")
                      for i, s in enumerate(SEPARATORS)])
    stack = F.array(*[F.struct(F.lit(s).alias("separator"), F.coalesce(F.col(f"s{i}"), F.lit(0)).alias("count"),
                               F.lit(i).alias("rank")) for i, s in enumerate(SEPARATORS)])
    return cnt.select(F.explode(stack).alias("x")).select("x.*")


def detect_separator(spark: SparkSession, path: str, encoding: str = "UTF-8") -> str:
    """The most frequent candidate in the first lines of the first file."""
    files = list_files(spark, path)
    if not files:
        raise ValueError(f"no files at {path}")
    rows = separator_counts(spark, files[0], encoding).collect()
    best = max(rows, key=lambda r: (r["count"], -r["rank"]))
    return best["separator"]


def fix_names(names: Sequence[str], case_sensitive: bool = False) -> list[str]:
    """Empty -> 'Unnamed: i'; repeats -> name_1, name_2, ... Names that differ
    in case only are repeats unless the session tells them apart."""
    out, taken, seen = [], set(), {}
    key = (lambda n: n) if case_sensitive else str.lower
    for i, n in enumerate(names):
        n = (n or "").strip() or f"Unnamed: {i}"
        base = key(n)
        while key(n) in taken:
            seen[base] = seen.get(base, 0) + 1
            n = f"{names[i].strip() if names[i] else f'Unnamed: {i}'}_{seen[base]}"
        taken.add(key(n))
        out.append(n)
    return out


def apply_null_tokens(df: DataFrame, tokens: Sequence[str] = NULL_TOKENS) -> DataFrame:
    """Text columns with the missing-value tokens turned into null."""
    return df.select(*[F.when(~qcol(f.name).isin(list(tokens)), qcol(f.name)).alias(f.name)
                       if isinstance(f.dataType, T.StringType) else qcol(f.name) for f in df.schema.fields])


def infer_types(df: DataFrame, broken: Column | None = None) -> DataFrame:
    """Cast text columns to long / double / boolean when every non-null
    value fits; one aggregate pass decides for all; others stay as they are.  Rows
    where ``broken`` holds are counted in the same pass and are an error."""
    cols = [f.name for f in df.schema.fields if f.name != OVERFLOW and isinstance(f.dataType, T.StringType)]
    typed = [f.name for f in df.schema.fields if f.name != OVERFLOW and f.name not in cols]
    if not cols:
        return df
    aggs = [F.count_if(broken if broken is not None else F.lit(False)).alias("broken")]
    for i, c in enumerate(cols):
        x = qcol(c)
        aggs += [F.count(x).alias(f"n{i}"),
                 F.count_if(x.rlike(WHOLE) & F.trim(x).try_cast("bigint").isNotNull()).alias(f"l{i}"),
                 F.count_if(x.rlike(NUMBER)).alias(f"d{i}"),
                 F.count_if(x.isin(TRUE_WORDS + FALSE_WORDS)).alias(f"b{i}")]
    r = df.agg(*aggs).first()
    if r["broken"]:
        raise ValueError(f"{r['broken']} records have more values than their header has names")
    out = {c: qcol(c) for c in typed}
    for i, c in enumerate(cols):
        x = qcol(c)
        n = r[f"n{i}"]
        if n > 0 and r[f"l{i}"] == n:
            out[c] = F.trim(x).cast("bigint")
        elif n > 0 and r[f"d{i}"] == n:
            out[c] = F.trim(x).cast("double")
        elif n > 0 and r[f"b{i}"] == n:
            out[c] = x.isin(TRUE_WORDS)
        else:
            out[c] = x
    return df.select(*[out[c].alias(c) for c in df.columns if c != OVERFLOW])


def _read_group(spark: SparkSession, files: list[str], names: list[str], sep: str, encoding: str,
                streamed: bool) -> DataFrame:
    """Text columns of files with one header, and whether a record has more values than that.

    The schema has one column more than the header. A record as long as the
    header is then short, and the reader keeps its text; one that fills
    the extra column, or more, shows there or has no text kept."""
    extra = [OVERFLOW, RECORD]
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, *extra]])
    raw = (spark.read.schema(schema).option("header", True).option("enforceSchema", True).option("sep", sep)
           .option("encoding", encoding).option("quote", '"').option("escape", '"').option("multiLine", streamed)
           .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", RECORD).csv(files))
    return raw.select(*[qcol(n) for n in names], (F.col(OVERFLOW).isNotNull() | F.col(RECORD).isNull()).alias(OVERFLOW))


def _read_header(spark: SparkSession, row: Row, sep: str, encoding: str) -> list[str]:
    """The names in a file's header; one with a line end inside a name is read as a record."""
    fields = next(csv.reader([row["header"].removeprefix("\ufeff")], delimiter=sep), [])
    if row["streamed"] and row["header"].count('"') % 2:
        read = spark.read.option("sep", sep).option("encoding", encoding).option("escape", '"').option("multiLine", True)
        fields = [v or "" for v in read.csv(unquote(row["file"])).first()]
    return fix_names(fields, spark.conf.get("spark.sql.caseSensitive") == "true")


def read_delimited(spark: SparkSession, path: str, sep: str | None = None, encoding: str | None = None,
                   null_tokens: Sequence[str] = NULL_TOKENS, infer: bool = True) -> DataFrame:
    """Read CSV/TSV files (a file, folder or glob) with detection as above.
    ``encoding`` must write ASCII as ASCII.  Without ``infer`` all columns
    stay text; too long records are found in a pass of their own."""
    files = list_files(spark, path)
    if not files:
        raise ValueError(f"no files at {path}")
    sep = sep or detect_separator(spark, path)
    groups: dict[tuple, list[str]] = {}
    for row in survey(spark, path, sep):
        enc = encoding or ("ISO-8859-1" if row["latin"] else "UTF-8")
        names = _read_header(spark, row, sep, enc)
        groups.setdefault((tuple(names), enc, row["streamed"]), []).append(unquote(row["file"]))
    if not groups:
        raise ValueError(f"no header in the files at {path}")
    parts = [_read_group(spark, found, list(names), sep, enc, streamed)
             for (names, enc, streamed), found in groups.items()]
    raw = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts)
    df, broken = apply_null_tokens(raw, null_tokens), F.col(OVERFLOW)
    if infer:
        return infer_types(df, broken)
    n = df.agg(F.count_if(broken)).first()[0]
    if n:
        raise ValueError(f"{n} records have more values than their header has names")
    return df.drop(OVERFLOW)
