"""Cleaning: imputation, de-duplication, outlier detection and handling.

Fill values and outlier bounds are *fitted parameters*: computed once by
aggregates over the input (one pass for means/deviations, the exact
quantile helper for medians and quartiles, one grouped count per mode
column) and then applied as literals in a single projection, so the data
itself is read once more and never shuffled.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.stats import exact_quantiles
from tessera.functions.types import melt, numeric_cols, qcol

METHODS = ("iqr", "zscore")
ACTIONS = ("keep", "remove", "cap")
IQR_FACTOR = 1.5
Z_THRESHOLD = 3.0


# ---------------------------------------------------------------------------
# C1 imputation
# ---------------------------------------------------------------------------

def _mode_value(df: DataFrame, c: str):
    """Most frequent non-null value, ties -> smallest; None if no values.
    A grouped count (map-side combined) then one min over the groups."""
    counts = df.where(qcol(c).isNotNull()).groupBy(qcol(c).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    row = counts.agg(F.min(F.struct((-F.col("n")).alias("neg"), F.col("v").alias("v"))).alias("m")).first()
    return None if row is None or row["m"] is None else row["m"]["v"]


def fits(value: int, dtype: T.DataType) -> bool:
    """Whether an integer is in the range of an integer type."""
    bits = {T.ByteType: 8, T.ShortType: 16, T.IntegerType: 32, T.LongType: 64}[type(dtype)]
    return -(1 << bits - 1) <= value < 1 << bits - 1


def fit_imputer(df: DataFrame, strategy: Mapping[str, object]) -> dict[str, tuple[str, object]]:
    """{column: (kind, fill)} for kinds mean | median | mode | drop | const | wide.
    Unknown columns are ignored; statistics include rows later dropped."""
    types = {f.name: f.dataType for f in df.schema.fields}
    plan = {c: s for c, s in strategy.items() if c in types}
    means = [c for c, s in plan.items() if s == "mean"]
    medians = [c for c, s in plan.items() if s == "median"]
    for c in means + medians:
        if not isinstance(types[c], T.NumericType):
            raise TypeError(f"{plan[c]} imputation needs a numeric column: {c!r}")
    fitted: dict[str, tuple[str, object]] = {}
    if means:
        row = df.agg(*[F.avg(qcol(c).cast("double")).alias(c) for c in means]).first()
        fitted.update({c: ("mean", row[c]) for c in means})
    if medians:
        q = exact_quantiles(df, medians, [0.5])
        fitted.update({c: ("median", q[(c, 0.5)]) for c in medians})
    for c, s in plan.items():
        if s == "mode":
            fitted[c] = ("mode", _mode_value(df, c))
        elif s == "drop":
            fitted[c] = ("drop", None)
        elif c not in fitted:
            dt = types[c]
            if isinstance(dt, T.NumericType) and not isinstance(s, (int, float)) or \
               isinstance(dt, T.StringType) and not isinstance(s, str):
                raise TypeError(f"constant {s!r} does not fit column {c!r} of type {dt.simpleString()}")
            fitted[c] = ("const", s)
            if isinstance(dt, T.IntegralType):
                fitted[c] = ("const", int(s)) if float(s).is_integer() else ("wide", float(s))
    return fitted


def apply_imputer(df: DataFrame, fitted: Mapping[str, tuple[str, object]]) -> DataFrame:
    types = {f.name: f.dataType for f in df.schema.fields}
    out = []
    for c in df.columns:
        kind, val = fitted.get(c, (None, None))
        col = qcol(c)
        if kind in ("mean", "median") and val is not None:
            out.append(F.coalesce(col.cast("double"), F.lit(float(val))).alias(c))
        elif kind == "wide":  # a fraction in an integer column, which becomes double
            out.append(F.coalesce(col.cast("double"), F.lit(val)).alias(c))
        elif kind == "const" and isinstance(types[c], T.IntegralType) and not fits(val, types[c]):
            out.append(F.coalesce(col.cast("long"), F.lit(val).cast("long")).alias(c))
        elif kind in ("mode", "const") and val is not None:
            out.append(F.coalesce(col, F.lit(val).cast(types[c])).alias(c))
        else:
            out.append(col)
    res = df.select(*out)
    drops = [c for c, (k, _) in fitted.items() if k == "drop"]
    for c in drops:
        res = res.where(qcol(c).isNotNull())
    return res


def handle_missing(df: DataFrame, strategy: Mapping[str, object]) -> DataFrame:
    """Fill or drop nulls per column: 'mean', 'median', 'mode', 'drop', or a
    constant.  Drops happen after all fills are computed."""
    return apply_imputer(df, fit_imputer(df, strategy))


# ---------------------------------------------------------------------------
# C2 de-duplication
# ---------------------------------------------------------------------------

def remove_duplicates(df: DataFrame) -> DataFrame:
    """Exact duplicate rows removed (hash aggregate with map-side combine,
    so a hot group of copies never reaches one task whole)."""
    return df.dropDuplicates()


# ---------------------------------------------------------------------------
# C3-C8 outliers
# ---------------------------------------------------------------------------

def _check_method(method: str) -> None:
    if method not in METHODS:
        raise ValueError(f"unsupported method {method!r}; use 'iqr' or 'zscore'")


def _select(df: DataFrame, columns: Sequence[str] | None) -> list[str]:
    return numeric_cols(df) if columns is None else numeric_cols(df, list(columns))


def fit_iqr_bounds(df: DataFrame, columns: Sequence[str], factor: float = IQR_FACTOR) -> dict[str, tuple]:
    q = exact_quantiles(df, columns, [0.25, 0.75])
    out = {}
    for c in columns:
        q1, q3 = q[(c, 0.25)], q[(c, 0.75)]
        if q1 is None:
            out[c] = (None, None)
        else:
            iqr = q3 - q1
            out[c] = (q1 - factor * iqr, q3 + factor * iqr)
    return out


def fit_moments(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple]:
    """{column: (mean, std_pop, std_samp)} in one pass."""
    if not columns:
        return {}
    aggs = []
    for c in columns:
        x = qcol(c).cast("double")
        aggs += [F.avg(x).alias(f"m::{c}"), F.stddev_pop(x).alias(f"p::{c}"), F.stddev_samp(x).alias(f"s::{c}")]
    row = df.agg(*aggs).first()
    return {c: (row[f"m::{c}"], row[f"p::{c}"], row[f"s::{c}"]) for c in columns}


def column_flags(df: DataFrame, method: str = "iqr", columns: Sequence[str] | None = None,
                 threshold: float = Z_THRESHOLD) -> dict[str, Column]:
    """Per column, a boolean Column (never null) marking outlier cells."""
    _check_method(method)
    cols = _select(df, columns)
    flags: dict[str, Column] = {}
    if method == "iqr":
        for c, (lo, hi) in fit_iqr_bounds(df, cols).items():
            x = qcol(c).cast("double")
            flags[c] = F.lit(False) if lo is None else F.coalesce((x < F.lit(lo)) | (x > F.lit(hi)), F.lit(False))
    else:
        for c, (m, sp, _) in fit_moments(df, cols).items():
            x = qcol(c).cast("double")
            if m is None or sp is None or sp == 0:
                flags[c] = F.lit(False)
            else:
                flags[c] = F.coalesce(F.abs((x - F.lit(m)) / F.lit(sp)) > F.lit(float(threshold)), F.lit(False))
    return flags


def outlier_flag(df: DataFrame, method: str = "iqr", columns: Sequence[str] | None = None,
                 threshold: float = Z_THRESHOLD) -> Column:
    flags = list(column_flags(df, method, columns, threshold).values())
    out = F.lit(False)
    for f in flags:
        out = out | f
    return out


def detect_outliers(df: DataFrame, method: str = "iqr", columns: Sequence[str] | None = None,
                    threshold: float = Z_THRESHOLD) -> DataFrame:
    """Rows with at least one outlying cell in the selected numeric columns."""
    return df.where(outlier_flag(df, method, columns, threshold))


def handle_outliers(df: DataFrame, method: str = "iqr", action: str = "keep",
                    columns: Sequence[str] | None = None, threshold: float = Z_THRESHOLD) -> DataFrame:
    """keep: unchanged; remove: drop flagged rows; cap: clip each column to
    IQR fences (iqr) or mean +- threshold * sample std (zscore)."""
    _check_method(method)
    if action not in ACTIONS:
        raise ValueError(f"unsupported action {action!r}; use 'keep', 'remove' or 'cap'")
    if action == "keep":
        return df
    cols = _select(df, columns)
    if not cols:
        return df
    if action == "remove":
        return df.where(~outlier_flag(df, method, cols, threshold))
    if method == "iqr":
        bounds = fit_iqr_bounds(df, cols)
    else:
        bounds = {}
        for c, (m, _, ss) in fit_moments(df, cols).items():
            bounds[c] = (None, None) if m is None or ss is None else (m - threshold * ss, m + threshold * ss)
    types = {f.name: f.dataType for f in df.schema.fields}
    out = []
    for c in df.columns:
        lo, hi = bounds.get(c, (None, None))
        if c in bounds and lo is not None:
            x = qcol(c).cast("double")
            clipped = F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(lo)), F.lit(hi)))
            out.append(clipped.alias(c) if isinstance(types[c], (T.DoubleType, T.FloatType))
                       else clipped.alias(c))
        else:
            out.append(qcol(c))
    return df.select(*out)


def outlier_summary(df: DataFrame, method: str = "iqr", threshold: float = Z_THRESHOLD) -> DataFrame:
    """(column, n_outliers, pct_outliers) for every numeric column; pct is
    of all rows, 2 dp.  One counting pass for all columns."""
    flags = column_flags(df, method, None, threshold)
    spark = df.sparkSession
    if not flags:
        return spark.createDataFrame([], "column string, n_outliers long, pct_outliers double")
    a = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.count_if(f).alias(f"n{i}") for i, f in enumerate(flags.values())])
    long = melt(a, [(c, F.col(f"n{i}")) for i, c in enumerate(flags)], ["_rows"], "column", "n_outliers")
    return long.select(
        "column", F.col("n_outliers").cast("long").alias("n_outliers"),
        F.when(F.col("_rows") > 0, F.bround(F.col("n_outliers") / F.col("_rows") * 100.0, 2))
        .otherwise(F.lit(0.0)).alias("pct_outliers"))
