"""The data behind each chart (drawing itself is out of scope).

All statistics are computed in one or two passes; bin and grid tables are
bounded by the number of bins / grid points.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.stats import exact_quantiles
from tessera.functions.types import melt, numeric_cols, qcol
from tessera.operators.profile import null_percentages

KDE_GRID = 100
SQRT_2PI = math.sqrt(2.0 * math.pi)
#: A spread below this share of the squares is rounding: the column is constant.
FLAT = 1e-12


def missing_ranked(df: DataFrame) -> DataFrame:
    """(column, null_pct) unrounded, highest first."""
    return (null_percentages(df, rounded=False).select("column", "null_pct")
            .orderBy(F.col("null_pct").desc(), "column"))


def _gram(width: int, shift: Sequence[float]):
    """Per pair of columns, over the rows where both are present: rows, sums, products, squares.

    With M the mask of present values and X the shifted values (0 where
    absent), these are the matrix products M'M, X'M, X'X and (X*X)'M of a batch."""
    import numpy as np
    import pyarrow as pa

    def run(batches):
        sums, seen = np.zeros((4, width, width)), TaskContext.get().partitionId() == 0  # an empty table gives a row per pair too
        for batch in batches:
            seen = seen or batch.num_rows > 0
            cells = np.column_stack([c.to_numpy(zero_copy_only=False).astype(np.float64) for c in batch.columns])
            mask = ~np.isnan(cells)
            x = np.where(mask, cells - np.array(shift), 0.0)
            m = mask.astype(np.float64)
            for k, part in enumerate((m.T @ m, x.T @ m, x.T @ x, (x * x).T @ m)):
                sums[k] += part
        if not seen:
            return
        i, j = (v.ravel() for v in np.indices((width, width)))
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), *(pa.array(s.ravel()) for s in sums)],
                                         names=["i", "j", "n", "s", "p", "q"])

    return run


def correlation(df: DataFrame, columns: Sequence[str] | None = None, digits: int = 3) -> DataFrame:
    """Pearson correlation of every pair of numeric columns over rows where
    both are present, long form (col_a, col_b, corr), rounded.  A column
    that is constant over those rows gives null.

    One pass for the means, one for the blocked Gram matrices of the values
    less their means: a task adds up width x width products and gives a row
    per pair, however many rows it read."""
    cols = numeric_cols(df, list(columns) if columns is not None else None)
    if not cols:
        return df.sparkSession.createDataFrame([], "col_a string, col_b string, corr double")
    cells = df.select(*[F.nanvl(qcol(c).cast("double"), F.lit(None)).alias(f"c{i}") for i, c in enumerate(cols)])
    means = cells.agg(*[F.avg(c) for c in cells.columns]).first()
    parts = cells.mapInArrow(_gram(len(cols), [m or 0.0 for m in means]), "i int, j int, n double, s double, p double, q double")
    sums = parts.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in "nspq"])
    both = sums.alias("a").join(sums.alias("b"), F.expr("a.i = b.j AND a.j = b.i"))  # a row per pair on either side
    spread = lambda t: F.col(f"{t}.q") - F.col(f"{t}.s") * F.col(f"{t}.s") / F.col("a.n")
    cov = F.col("a.p") - F.col("a.s") * F.col("b.s") / F.col("a.n")
    varies = (F.col("a.n") > 1) & (spread("a") > F.col("a.q") * FLAT) & (spread("b") > F.col("b.q") * FLAT)
    r = F.when(varies, cov / F.sqrt(spread("a") * spread("b")))
    names = F.array(*[F.lit(c) for c in cols])
    return both.select(F.get(names, F.col("a.i")).alias("col_a"), F.get(names, F.col("a.j")).alias("col_b"),
                       (F.bround(r, digits) + F.lit(0.0)).alias("corr"))  # no signed zero


def _range(df: DataFrame, col: str):
    x = qcol(col).cast("double")
    return df.agg(F.count(x).alias("n"), F.min(x).alias("lo"), F.max(x).alias("hi"),
                  F.stddev_samp(x).alias("sd")).first()


def sturges_bins(n: int) -> int:
    return max(1, int(math.ceil(math.log2(n) + 1))) if n > 0 else 1


def histogram(df: DataFrame, col: str, bins: int | None = None) -> DataFrame:
    """Equal-width density histogram over [min, max]: (bin, lower, upper,
    count, density) with density = count / (n * width); Sturges' rule by
    default; empty bins kept."""
    spark = df.sparkSession
    st = _range(df, col)
    if not st["n"]:
        return spark.createDataFrame([], "bin int, lower double, upper double, count long, density double")
    n, lo, hi = st["n"], st["lo"], st["hi"]
    k = bins or sturges_bins(n)
    width = (hi - lo) / k if hi > lo else 1.0
    x = qcol(col).cast("double")
    idx = F.least(F.floor((x - F.lit(lo)) / F.lit(width)).cast("int"), F.lit(k - 1))
    counts = df.where(x.isNotNull()).groupBy(idx.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    grid = spark.range(k).select(F.col("id").cast("int").alias("bin"))
    out = grid.join(F.broadcast(counts), "bin", "left")
    return out.select(
        "bin", (F.lit(lo) + F.col("bin") * F.lit(width)).alias("lower"),
        (F.lit(lo) + (F.col("bin") + 1) * F.lit(width)).alias("upper"),
        F.coalesce("count", F.lit(0)).cast("long").alias("count"),
        (F.coalesce("count", F.lit(0)) / F.lit(n * width)).alias("density"))


def kde(df: DataFrame, col: str, grid: int = KDE_GRID, digits: int | None = 10) -> DataFrame:
    """Gaussian kernel density on ``grid`` points spanning [min, max] with
    Scott's bandwidth (sample std * n^(-1/5)).  Exact: one aggregate with
    a sum of kernels per grid point, in the scan of the rows; no row is
    multiplied and a task gives one row."""
    spark = df.sparkSession
    st = _range(df, col)
    if not st["n"] or not st["sd"]:
        return spark.createDataFrame([], "point int, x double, density double")
    n, lo, hi, sd = st["n"], st["lo"], st["hi"], st["sd"]
    h = sd * n ** (-0.2)
    step = (hi - lo) / (grid - 1) if grid > 1 else 0.0
    v = qcol(col).cast("double")

    def kernel(k: int) -> Column:
        z = (F.lit(lo) + F.lit(float(k)) * F.lit(step) - v) / F.lit(h)
        return F.sum(F.exp(F.lit(-0.5) * z * z)).alias(f"s{k}")

    sums = df.where(v.isNotNull()).agg(*[kernel(k) for k in range(grid)])
    dens = melt(sums.select(*[F.struct(F.lit(k).alias("point"), F.col(f"s{k}").alias("s")).alias(f"s{k}") for k in range(grid)]),
                [("", F.col(f"s{k}")) for k in range(grid)]).select("value.point", "value.s")
    val = F.col("s") / F.lit(n * h * SQRT_2PI)
    return dens.select("point", (F.lit(lo) + F.col("point") * F.lit(step)).alias("x"),
                       (F.bround(val, digits) if digits is not None else val).alias("density"))


def boxplot(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Per numeric column: q1, median, q3 (exact, linear), whiskers (most
    extreme values inside 1.5 IQR of the quartiles) and outlier count."""
    cols = numeric_cols(df, list(columns) if columns is not None else None)
    spark = df.sparkSession
    if not cols:
        return spark.createDataFrame([], "column string, q1 double, median double, q3 double, "
                                         "lower_whisker double, upper_whisker double, n_outliers long")
    q = exact_quantiles(df, cols, [0.25, 0.5, 0.75])
    aggs, meta = [], []
    for c in cols:
        q1, med, q3 = q[(c, 0.25)], q[(c, 0.5)], q[(c, 0.75)]
        if q1 is None:
            continue
        iqr = q3 - q1
        lo, hi = q1 - 1.5 * iqr, q3 + 1.5 * iqr
        x = qcol(c).cast("double")
        aggs += [F.min(F.when(x >= F.lit(lo), x)).alias(f"lw::{c}"), F.max(F.when(x <= F.lit(hi), x)).alias(f"uw::{c}"),
                 F.count_if((x < F.lit(lo)) | (x > F.lit(hi))).alias(f"no::{c}")]
        meta.append((c, q1, med, q3))
    row = df.agg(*aggs)
    stack = [F.struct(F.lit(c).alias("column"), F.lit(q1).alias("q1"), F.lit(med).alias("median"),
                      F.lit(q3).alias("q3"), F.col(f"`lw::{c}`").alias("lower_whisker"),
                      F.col(f"`uw::{c}`").alias("upper_whisker"), F.col(f"`no::{c}`").alias("n_outliers"))
             for c, q1, med, q3 in meta]
    return row.select(F.explode(F.array(*stack)).alias("s")).select("s.*")


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """(value, frequency) of non-null values, most frequent first."""
    return (df.where(qcol(col).isNotNull()).groupBy(qcol(col).alias("value"))
            .agg(F.count(F.lit(1)).alias("frequency"))
            .orderBy(F.col("frequency").desc(), "value"))
