"""Dataset profiling: semantic types, nulls, duplicates, cardinality,
descriptive statistics and target suggestion.

The full profile reads the data twice:

* ``typed_frequencies`` -- a row per distinct value of every column with its
  count, numbers as numbers and the rest as text, written to the shared
  folder.  Nulls, cardinality, moments, top values and date patterns are
  aggregates over it; quartiles come from running totals of its counts.
* ``duplicate_count`` -- the rows grouped by all columns.

Each single figure can also be had on its own by the functions below.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.ranking import running_totals
from tessera.functions.stats import exact_quantiles, rank_of
from tessera.functions.types import (
    as_text,
    is_datetime_type,
    melt,
    non_numeric_cols,
    numeric_cols,
    qcol,
)
from tessera.session import stored

# Date patterns tried on text columns (one pattern must parse
# every non-null value), and the text-column thresholds.
DATE_FORMATS = [
    "yyyy-MM-dd",
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy/MM/dd",
    "MM/dd/yyyy",
    "dd/MM/yyyy",
    "dd-MM-yyyy",
    "dd.MM.yyyy",
]
TEXT_UNIQUE_RATIO = 0.8
TEXT_MIN_UNIQUE = 20
TARGET_MAX_NULL_FRACTION = 0.3


# ---------------------------------------------------------------------------
# value frequencies
# ---------------------------------------------------------------------------

def one_zero(col: Column, dtype: T.DataType) -> Column:
    """-0.0 as 0.0, so that they count as one value."""
    return F.when(col == 0, F.lit(0.0).cast(dtype)).otherwise(col) if isinstance(dtype, (T.FloatType, T.DoubleType)) else col


def value_frequencies(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, value, n) for every non-null value of every column, values
    rendered as text.  Map-side partial counts keep hot values cheap."""
    columns = list(df.columns if columns is None else columns)
    types = {f.name: f.dataType for f in df.schema.fields}
    long = melt(df, [(c, as_text(one_zero(qcol(c), types[c]), types[c])) for c in columns]).where(F.col("value").isNotNull())
    return long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def frequency_summary(freq: DataFrame) -> DataFrame:
    """Per column: n_unique, top_value (most frequent, ties -> smallest
    value), top_freq."""
    top = F.min(F.struct((-F.col("n")).alias("neg"), F.col("value").alias("v")))
    return (freq.groupBy("column")
            .agg(F.count(F.lit(1)).alias("n_unique"), top.alias("_top"))
            .select("column", "n_unique", F.col("_top.v").alias("top_value"),
                    (-F.col("_top.neg")).alias("top_freq")))


def _positions(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    spark = df.sparkSession
    rows = [(i, c) for i, c in enumerate(df.columns) if c in set(columns)]
    return spark.createDataFrame(rows, "position int, column string")


def _attach(df: DataFrame, per_col: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Join per-column results to (position, column) so columns with no
    rows in ``per_col`` still appear."""
    return _positions(df, columns).join(per_col, "column", "left")


# ---------------------------------------------------------------------------
# P2 nulls
# ---------------------------------------------------------------------------

def null_percentages(df: DataFrame, rounded: bool = True) -> DataFrame:
    """(position, column, null_pct): share of null cells, in percent."""
    cols = df.columns
    row = df.select(*[F.avg(qcol(c).isNull().cast("double")).alias(f"c{i}") for i, c in enumerate(cols)])
    long = melt(row, [(c, F.col(f"c{i}")) for i, c in enumerate(cols)], (), "column", "frac")
    pct = F.col("frac") * 100.0
    out = long.select("column", (F.bround(pct, 2) if rounded else pct).alias("null_pct"))
    return _attach(df, out, cols)


# ---------------------------------------------------------------------------
# P3 duplicates
# ---------------------------------------------------------------------------

def duplicate_count(df: DataFrame, with_rows: bool = False) -> DataFrame:
    """One row: n_duplicates (rows beyond the first copy), pct_duplicates; ``with_rows`` adds n_rows."""
    groups = df.groupBy(*[qcol(c) for c in df.columns]).agg(F.count(F.lit(1)).alias("_n"))
    agg = groups.agg(F.sum("_n").alias("n_rows"), F.sum(F.col("_n") - 1).alias("n_dup"))
    return agg.select(
        F.coalesce(F.col("n_dup"), F.lit(0)).cast("long").alias("n_duplicates"),
        F.when(F.coalesce(F.col("n_rows"), F.lit(0)) > 0,
               F.bround(F.col("n_dup") / F.col("n_rows") * 100.0, 2))
        .otherwise(F.lit(0.0)).alias("pct_duplicates"),
        *([F.coalesce("n_rows", F.lit(0)).alias("n_rows")] if with_rows else []))


# ---------------------------------------------------------------------------
# P1 semantic types
# ---------------------------------------------------------------------------

def date_shape(x: Column) -> Column:
    """Whether a text has the length and the first character that all date patterns have; null has."""
    return F.coalesce(F.substring(x, 1, 1).between("0", "9") & F.length(x).between(8, 19), F.lit(True))


def _date_columns(df: DataFrame, strs: Sequence[str]) -> tuple[dict, dict]:
    """({column: non-null count}, {column: parses with one pattern}).

    Every pattern starts with a digit and is 8-19 characters long, so one
    cheap pass rules out most text columns; only the survivors are parsed
    with each pattern, in a second pass."""
    txt = {c: qcol(c).cast("string") for c in strs}
    aggs = []
    for c in strs:
        x = txt[c]
        aggs += [F.count(x).alias(f"nn::{c}"), F.count_if(~date_shape(x)).alias(f"bad::{c}")]
    r = df.agg(*aggs).first()
    nn = {c: r[f"nn::{c}"] for c in strs}
    is_date = {c: True for c in strs if nn[c] == 0}  # all-null parses trivially
    cands = [c for c in strs if nn[c] > 0 and r[f"bad::{c}"] == 0]
    for c in strs:
        is_date.setdefault(c, False)
    if cands:
        aggs = []
        for c in cands:
            for i, fmt in enumerate(DATE_FORMATS):
                bad = txt[c].isNotNull() & F.try_to_timestamp(txt[c], F.lit(fmt)).isNull()
                aggs.append(F.count_if(bad).alias(f"b{i}::{c}"))
        r2 = df.agg(*aggs).first()
        for c in cands:
            is_date[c] = any(r2[f"b{i}::{c}"] == 0 for i in range(len(DATE_FORMATS)))
    return nn, is_date


def semantic_types(df: DataFrame, freq_summary: DataFrame | None = None) -> DataFrame:
    """(position, column, semantic_type) in numeric | categorical |
    datetime | text.  Booleans count as numeric here."""
    fields = df.schema.fields
    strs = [f.name for f in fields if not (isinstance(f.dataType, (T.NumericType, T.BooleanType))
                                           or is_datetime_type(f.dataType))]
    kinds: dict[str, str] = {}
    for f in fields:
        if is_datetime_type(f.dataType):
            kinds[f.name] = "datetime"
        elif isinstance(f.dataType, (T.NumericType, T.BooleanType)):
            kinds[f.name] = "numeric"
    if strs:
        nn, is_date = _date_columns(df, strs)
        rest = [c for c in strs if not is_date[c]]
        for c in strs:
            if is_date[c]:
                kinds[c] = "datetime"
        if rest:
            fs = freq_summary if freq_summary is not None else frequency_summary(value_frequencies(df, rest))
            nu = {r["column"]: r["n_unique"] for r in fs.where(F.col("column").isin(rest)).collect()}
            for c in rest:
                u = nu.get(c, 0)
                kinds[c] = "text" if nn[c] > 0 and u / nn[c] > TEXT_UNIQUE_RATIO and u > TEXT_MIN_UNIQUE \
                    else "categorical"
    rows = [(i, c, kinds[c]) for i, c in enumerate(df.columns)]
    return df.sparkSession.createDataFrame(rows, "position int, column string, semantic_type string")


# ---------------------------------------------------------------------------
# P4 cardinality
# ---------------------------------------------------------------------------

def cardinality(df: DataFrame, types: DataFrame | None = None) -> DataFrame:
    """(position, column, n_unique) for categorical and text columns."""
    types = types if types is not None else semantic_types(df)
    chosen = [r["column"] for r in types.where(F.col("semantic_type").isin("categorical", "text"))
              .select("column").collect()]
    if not chosen:
        return _positions(df, []).withColumn("n_unique", F.lit(None).cast("long"))
    fs = frequency_summary(value_frequencies(df, chosen))
    out = _attach(df, fs.select("column", "n_unique"), chosen)
    return out.select("position", "column", F.coalesce("n_unique", F.lit(0)).alias("n_unique"))


# ---------------------------------------------------------------------------
# P5 / P6 descriptive statistics
# ---------------------------------------------------------------------------

QUARTILES = [0.25, 0.5, 0.75]


def describe_numeric(df: DataFrame, digits: int = 4) -> DataFrame:
    """Per numeric column: count, mean, std (sample), min, 25%, 50%, 75%,
    max (exact, linear interpolation), rounded half-to-even."""
    cols = numeric_cols(df)
    spark = df.sparkSession
    schema = ("position int, column string, count long, mean double, std double, min double, "
              "q25 double, q50 double, q75 double, max double")
    if not cols:
        return spark.createDataFrame([], schema)
    aggs = []
    for c in cols:
        x = qcol(c).cast("double")
        aggs += [F.count(x).alias(f"n::{c}"), F.avg(x).alias(f"mean::{c}"),
                 F.stddev_samp(x).alias(f"std::{c}"), F.min(x).alias(f"min::{c}"),
                 F.max(x).alias(f"max::{c}")]
    a = df.agg(*aggs)
    q = exact_quantiles(df, cols, QUARTILES)
    qdf = spark.createDataFrame(
        [(c, q[(c, 0.25)], q[(c, 0.5)], q[(c, 0.75)]) for c in cols],
        "column string, q25 double, q50 double, q75 double")
    stack = [F.struct(F.lit(c).alias("column"), qcol(f"n::{c}").alias("count"),
                      qcol(f"mean::{c}").alias("mean"), qcol(f"std::{c}").alias("std"),
                      qcol(f"min::{c}").alias("min"), qcol(f"max::{c}").alias("max"))
             for c in cols]
    long = a.select(F.explode(F.array(*stack)).alias("s")).select("s.*").join(F.broadcast(qdf), "column")
    r = lambda c: F.bround(F.col(c), digits).alias(c)
    out = long.select("column", "count", r("mean"), r("std"), r("min"), r("q25"), r("q50"), r("q75"), r("max"))
    return _attach(df, out, cols).select("position", "column", "count", "mean", "std", "min",
                                         "q25", "q50", "q75", "max")


def describe_categorical(df: DataFrame, freq_summary: DataFrame | None = None,
                         n_rows: int | None = None) -> DataFrame:
    """Per non-numeric column (booleans and datetimes included): n_unique,
    top_value, top_freq and pct_top (share of *all* rows, 2 dp)."""
    cols = non_numeric_cols(df)
    if not cols:
        return df.sparkSession.createDataFrame(
            [], "position int, column string, n_unique long, top_value string, top_freq long, pct_top double")
    fs = freq_summary if freq_summary is not None else frequency_summary(value_frequencies(df, cols))
    n_rows = n_rows if n_rows is not None else df.count()
    out = _attach(df, fs, cols).withColumn("n_rows", F.lit(n_rows))
    return out.select(
        "position", "column", F.coalesce("n_unique", F.lit(0)).alias("n_unique"), "top_value",
        F.coalesce("top_freq", F.lit(0)).alias("top_freq"),
        F.when(F.col("top_freq").isNotNull() & (F.col("n_rows") > 0),
               F.bround(F.col("top_freq") / F.col("n_rows") * 100.0, 2)).otherwise(F.lit(0.0)).alias("pct_top"))


# ---------------------------------------------------------------------------
# P7 target suggestion
# ---------------------------------------------------------------------------

def suggest_target(df: DataFrame, types: DataFrame | None = None, freq_summary: DataFrame | None = None,
                   nulls: DataFrame | None = None) -> DataFrame:
    """Ranked candidate targets: (rank, position, column, priority).

    priority 0: exactly two distinct values; 1: categorical with 3-10;
    2: numeric with at most 10 (two is already priority 0).  Columns with
    more than 30% nulls are skipped.  Stable by column order."""
    fs = freq_summary if freq_summary is not None else frequency_summary(value_frequencies(df))
    types = types if types is not None else semantic_types(df, fs)
    nulls = nulls if nulls is not None else null_percentages(df, rounded=False)
    j = (types.join(nulls.select("column", "null_pct"), "column")
         .join(fs.select("column", "n_unique"), "column", "left"))
    nu = F.coalesce(F.col("n_unique"), F.lit(0))
    prio = (F.when(nu == 2, 0)
            .when((F.col("semantic_type") == "categorical") & nu.between(3, 10), 1)
            .when((F.col("semantic_type") == "numeric") & nu.between(2, 10), 2))
    c = (j.where(F.col("null_pct") / 100.0 <= TARGET_MAX_NULL_FRACTION)
         .select("position", "column", prio.alias("priority")).where(F.col("priority").isNotNull()))
    from pyspark.sql import Window
    w = Window.orderBy("priority", "position")  # at most one row per column
    return c.select((F.row_number().over(w) - 1).alias("rank"), "position", "column", "priority")


# ---------------------------------------------------------------------------
# P8 full profile
# ---------------------------------------------------------------------------

def typed_frequencies(df: DataFrame) -> DataFrame:
    """(col, l, d, s, n): count of every non-null value of the column at
    position ``col``: whole numbers in ``l``, doubles in ``d``, the rest as text in ``s``."""
    parts: list[Column] = []
    for i, f in enumerate(df.schema.fields):
        x = one_zero(qcol(f.name), f.dataType)
        whole, real = isinstance(f.dataType, T.IntegralType), isinstance(f.dataType, (T.FloatType, T.DoubleType))
        none = F.lit(None)
        parts += [F.lit(i), (x if whole else none).cast("long"), (x if real else none).cast("double"),
                  none.cast("string") if whole or real else as_text(x, f.dataType)]
    long = df.select(F.stack(F.lit(len(df.columns)), *parts).alias("col", "l", "d", "s"))
    return (long.where("l IS NOT NULL OR d IS NOT NULL OR s IS NOT NULL").groupBy("col", "l", "d", "s")
            .agg(F.count(F.lit(1)).alias("n")))


def _by_position(values: dict, width: int) -> Column:
    """A literal per column position, for rows of the frequency table."""
    return F.get(F.array(*[F.lit(values.get(i)).cast("double") for i in range(width)]), F.col("col"))


def _weighted_quartiles(numbers: DataFrame, sizes: dict[int, int]) -> dict[tuple[int, float], float]:
    """{(col, p): quantile} of the numbers (col, x, n), by running totals of the counts."""
    wanted = {(i, p): rank_of(n, p) for i, n in sizes.items() for p in QUARTILES}
    ranks = sorted({(i, r + k) for (i, _), (r, frac) in wanted.items() for k in (0, 1) if k == 0 or (frac > 0 and r + 1 < sizes[i])})
    if not ranks:
        return {}
    run = running_totals(numbers, "x", ["n"], ["col"], written=True)
    asked = numbers.sparkSession.createDataFrame(ranks, "col int, rank long")  # a few rows per column
    met = run.join(F.broadcast(asked), "col").where("cum_n - n <= rank AND rank < cum_n").select("col", "rank", "x").collect()
    at = {(r["col"], r["rank"]): r["x"] for r in met}
    return {(i, p): at[i, r] + frac * (at.get((i, r + 1), at[i, r]) - at[i, r]) if frac else at[i, r]
            for (i, p), (r, frac) in wanted.items()}


def profile(df: DataFrame) -> DataFrame:
    """One row per column with type, nulls, cardinality, top value, numeric
    statistics and target rank; table-level duplicate figures repeated.  The
    driver sees a few figures per column."""
    spark, fields, width = df.sparkSession, df.schema.fields, len(df.columns)
    freq = stored(typed_frequencies(df), "frequencies")
    dup = duplicate_count(df, with_rows=True).first()
    n_rows = dup["n_rows"]

    numeric = [i for i, f in enumerate(fields) if isinstance(f.dataType, T.NumericType)]
    texts = [i for i, f in enumerate(fields) if not isinstance(f.dataType, (T.NumericType, T.BooleanType)) and not is_datetime_type(f.dataType)]
    x = F.when(F.col("col").isin(numeric), F.coalesce("d", F.col("l").cast("double"), F.col("s").try_cast("double")))
    cells = freq.select("col", "s", "n", x.alias("x"))
    first = {r["col"]: r for r in cells.groupBy("col").agg(
        F.count(F.lit(1)).alias("n_unique"), F.sum("n").alias("nn"), F.sum(F.col("x") * F.col("n")).alias("total"),
        F.min("x").alias("min"), F.max("x").alias("max"), F.count_if(~date_shape(F.col("s"))).alias("odd"),
        F.min(F.struct((-F.col("n")).alias("neg"), F.col("s").alias("v"))).alias("top")).collect()}
    means = {i: first[i]["total"] / first[i]["nn"] for i in numeric if i in first}
    maybe = [i for i in texts if i in first and first[i]["odd"] == 0]
    gap = F.col("x") - _by_position(means, width)
    tries = [F.count_if(F.try_to_timestamp("s", F.lit(f)).isNull()).alias(f"f{k}") for k, f in enumerate(DATE_FORMATS)]
    second = {r["col"]: r for r in cells.where(F.col("col").isin(numeric + maybe)).groupBy("col").agg(
        F.sum(gap * gap * F.col("n")).alias("ss"), *(tries if maybe else [])).collect()}
    quart = _weighted_quartiles(cells.where("x IS NOT NULL").select("col", "x", "n"), {i: first[i]["nn"] for i in means})

    rows = []
    for i, f in enumerate(fields):
        got = first.get(i)
        nn, unique = (got["nn"], got["n_unique"]) if got else (0, 0)
        if i not in texts:
            kind = "datetime" if is_datetime_type(f.dataType) else "numeric"
        elif nn == 0 or (i in maybe and any(second[i][f"f{k}"] == 0 for k in range(len(DATE_FORMATS)))):
            kind = "datetime"
        else:
            kind = "text" if unique / nn > TEXT_UNIQUE_RATIO and unique > TEXT_MIN_UNIQUE else "categorical"
        std = (second[i]["ss"] / (nn - 1)) ** 0.5 if i in means and nn > 1 else None
        stats = (nn, means[i], std, got["min"], *(quart[i, p] for p in QUARTILES), got["max"]) if i in means else \
            ((0 if i in numeric else None), *[None] * 7)
        top = (None, None) if i in numeric else (got["top"]["v"], -got["top"]["neg"]) if got else (None, 0)
        rows.append((i, f.name, kind, (n_rows - nn) / n_rows * 100.0 if n_rows else None, unique, *stats, *top))
    raw = spark.createDataFrame(rows, "position int, column string, semantic_type string, null_pct double, n_unique long, "
                                      "n_numeric long, mean double, std double, min double, q25 double, q50 double, q75 double, "
                                      "max double, top_value string, top_freq long")
    rank = suggest_target(df, raw.select("position", "column", "semantic_type"), raw.select("column", "n_unique"),
                          raw.select("column", "null_pct")).select("column", F.col("rank").alias("target_rank"))
    r4 = lambda c: F.bround(c, 4).alias(c)
    pct = F.when(F.col("top_freq") > 0, F.bround(F.col("top_freq") / n_rows * 100.0, 2)).when(F.col("top_freq").isNotNull(), 0.0)
    return raw.join(rank, "column", "left").select(
        "position", "column", "semantic_type", F.bround("null_pct", 2).alias("null_pct"), "n_unique", "n_numeric",
        r4("mean"), r4("std"), r4("min"), r4("q25"), r4("q50"), r4("q75"), r4("max"), "top_value", "top_freq",
        pct.alias("pct_top"), "target_rank", F.lit(dup["n_duplicates"]).cast("long").alias("n_duplicates"),
        F.lit(dup["pct_duplicates"]).cast("double").alias("pct_duplicates"))
