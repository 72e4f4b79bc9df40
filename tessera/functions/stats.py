"""Exact order statistics without a single-task merge.

``percentile(x, p)`` is exact but its final step merges a value->count map
of every distinct value into one task, which does not survive a column
with billions of distinct values.  ``exact_quantiles`` instead works in
three bounded steps, all on executors:

1. one aggregate per (group, column): ``count``, ``min`` and ``max``;
2. for columns larger than ``max_bracket`` a ``percentile_approx`` sketch
   (Greenwald-Khanna, bounded memory, merged map-side) names two values of
   the column around each wanted rank; one counting pass tells whether the
   rank falls on one of them, and is known, or in the open interval between,
   below or above them.  Both values leave the interval, so that any number
   of equal values narrows it, and it shrinks in each round until it holds
   at most ``max_bracket`` rows;
3. the rows of those intervals are ranked with a window partitioned by
   interval, and the two neighbouring order statistics are interpolated
   linearly (``x_lo + f * (x_hi - x_lo)``, the pandas / NumPy default).

Only small parameter rows (one per group x column x probability) reach
the driver.
"""

from __future__ import annotations

import functools
import math
import operator
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.types import melt, qcol

DEFAULT_ACCURACY = 10000
DEFAULT_MAX_BRACKET = 1_000_000


def long_values(df: DataFrame, columns: Sequence[str], group_cols: Sequence[str] = ()) -> DataFrame:
    """(group..., column, x) with x as double, nulls dropped."""
    long = melt(df, [(c, qcol(c).cast("double")) for c in columns], group_cols, "column", "x")
    return long.where(F.col("x").isNotNull() & ~F.isnan("x"))


def rank_of(n: int, p: float) -> tuple[int, float]:
    h = (n - 1) * p
    r = int(math.floor(h))
    return r, h - r


def exact_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probs: Sequence[float],
    group_cols: Sequence[str] = (),
    accuracy: int = DEFAULT_ACCURACY,
    max_bracket: int = DEFAULT_MAX_BRACKET,
) -> dict[tuple, float | None]:
    """Exact linear-interpolation quantiles.

    Returns ``{(*group_values, column, p): value}``; ``None`` for a column
    (or group) without non-null values.
    """
    columns = list(columns)
    probs = [float(p) for p in probs]
    if not columns or not probs:
        return {}
    spark = df.sparkSession
    long = long_values(df, columns, group_cols)
    seen = {tuple(r[g] for g in group_cols) + (r["column"],): r["n"] for r in long.groupBy(*group_cols, "column").agg(
        F.count("x").alias("n")).collect()}
    groups_seen = {k[:-1] for k in seen} or ({()} if not group_cols else set())
    ranks = {}  # (key, p) -> neighbouring ranks and the fraction between them
    for key in (gk + (c,) for gk in groups_seen for c in columns):
        for p in probs if seen.get(key) else ():
            r, frac = rank_of(seen[key], p)
            ranks[key, p] = (r, r + 1 if frac > 0 and r + 1 < seen[key] else r, frac)
    found = _values_at(spark, long, group_cols, seen, {(k, r) for (k, _), rs in ranks.items() for r in rs[:2]}, accuracy, max_bracket)
    result: dict[tuple, float | None] = {}
    for key in (gk + (c,) for gk in groups_seen for c in columns):
        for p in probs:
            if (key, p) not in ranks:
                result[key + (p,)] = None
                continue
            r0, r1, frac = ranks[key, p]
            x0, x1 = found[key, r0], found[key, r1]
            result[key + (p,)] = x0 + frac * (x1 - x0) if frac else x0
    return result


def _interval_frame(spark, long, group_cols, intervals, **more) -> DataFrame:
    """A row an interval: its group and column, number, open ends (null: none) and further values."""
    kinds = {"ranks": T.ArrayType(T.LongType()), "a": T.DoubleType(), "b": T.DoubleType()}
    schema = T.StructType([*[long.schema[g] for g in group_cols], T.StructField("column", T.StringType()), T.StructField("bid", T.IntegerType()),
                           T.StructField("lo", T.DoubleType()), T.StructField("hi", T.DoubleType()), *[T.StructField(m, kinds[m]) for m in more]])
    rows = [(*key, i, lo, hi, *[v[i] for v in more.values()]) for i, (key, lo, hi) in enumerate(intervals)]
    return spark.createDataFrame(rows, schema)


def _inside(long, group_cols, frame) -> DataFrame:
    """Rows of each interval."""
    keys = [*group_cols, "column"]
    frame = frame.withColumnsRenamed({c: f"__{c}" for c in keys})
    same = functools.reduce(operator.and_, [qcol(c).eqNullSafe(qcol(f"__{c}")) for c in keys])
    return (long.join(F.broadcast(frame), same)
            .where((F.col("lo").isNull() | (F.col("x") > F.col("lo"))) & (F.col("hi").isNull() | (F.col("x") < F.col("hi")))))


def _values_at(spark, long, group_cols, counts, wanted, accuracy, max_bracket) -> dict:
    """{(key, rank): value}. An interval is (key, lo, hi), its ends not inside;
    with it go the rows up to its low end, the rows inside and the ranks sought."""
    found: dict = {}
    live: dict[tuple, list] = {}
    for key, r in wanted:
        live.setdefault((key, None, None), [0, counts[key], set()])[2].add(r)
    ready: dict[tuple, list] = {}
    while True:
        ready |= {k: v for k, v in live.items() if v[1] <= max_bracket}
        live = {k: v for k, v in live.items() if v[1] > max_bracket}
        if not live:
            return found | _pick(spark, long, group_cols, ready)
        keys = list(live)
        delta = 3.0 / accuracy
        at = {(i, r, s): min(1.0, max(0.0, (r - live[k][0]) / live[k][1] + s * delta))
              for i, k in enumerate(keys) for r in live[k][2] for s in (-1, 1)}
        grid = sorted(set(at.values()))
        sketch = {x["bid"]: dict(zip(grid, x["g"])) for x in _inside(long, group_cols, _interval_frame(spark, long, group_cols, keys))
                  .groupBy("bid").agg(F.percentile_approx("x", grid, accuracy).alias("g")).collect()}
        probes: dict[tuple, list] = {}  # (interval, value below, value above) -> ranks
        for i, k in enumerate(keys):
            for r in live[k][2]:
                probes.setdefault((k, sketch[i][at[i, r, -1]], sketch[i][at[i, r, 1]]), []).append(r)
        frame = _interval_frame(spark, long, group_cols, [k for k, _, _ in probes], a=[va for _, va, _ in probes], b=[vb for _, _, vb in probes])
        x, a, b = F.col("x"), F.col("a"), F.col("b")
        told = {c["bid"]: c for c in _inside(long, group_cols, frame).groupBy("bid").agg(
            F.count_if(x < a).alias("lt_a"), F.count_if(x <= a).alias("le_a"),
            F.count_if(x < b).alias("lt_b"), F.count_if(x <= b).alias("le_b")).collect()}
        narrower: dict[tuple, list] = {}
        for c, (k, va, vb), r in [(told[i], p, r) for i, (p, rs) in enumerate(probes.items()) for r in rs]:
            (key, lo, hi), (below, rows, _) = k, live[k]
            rel = r - below
            if c["lt_a"] <= rel < c["le_a"]:
                found[key, r] = va
            elif c["lt_b"] <= rel < c["le_b"]:
                found[key, r] = vb
            else:
                part = ((key, lo, va), 0, c["lt_a"]) if rel < c["lt_a"] else ((key, va, vb), c["le_a"], c["lt_b"]) if rel < c["lt_b"] \
                    else ((key, vb, hi), c["le_b"], rows)
                narrower.setdefault(part[0], [below + part[1], part[2] - part[1], set()])[2].add(r)
        live = narrower


def _pick(spark, long, group_cols, intervals) -> dict:
    if not intervals:
        return {}
    keys = list(intervals)
    frame = _interval_frame(spark, long, group_cols, keys, ranks=[sorted(int(r - intervals[k][0]) for r in intervals[k][2]) for k in keys])
    # one task per interval: an explicit partition count is not coalesced by
    # AQE, so their sorts run side by side
    inside = _inside(long, group_cols, frame).select("bid", "x", "ranks").repartition(len(keys), "bid")
    w = Window.partitionBy("bid").orderBy("x")
    ranked = (inside.withColumn("rk", F.row_number().over(w) - 1)
              .where(F.array_contains("ranks", F.col("rk").cast("long")))
              .select("bid", "rk", "x").collect())
    return {(keys[r["bid"]][0], intervals[keys[r["bid"]]][0] + r["rk"]): r["x"] for r in ranked}


def quantile_table(df: DataFrame, columns: Sequence[str], probs: Sequence[float]) -> dict[str, list]:
    """{column: [q(p) for p in probs]} for ungrouped use."""
    q = exact_quantiles(df, columns, probs)
    return {c: [q[(c, float(p))] for p in probs] for c in columns}
