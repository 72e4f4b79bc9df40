"""Distributed running totals and ranks.

A global ``sum() over (order by ...)`` runs in one task.  Here the order
values are cut into buckets -- so one hot group is still cut into many parts
-- summed locally per (bucket, group), and shifted by the totals of the
earlier buckets of the same group.  The totals table has at most ``buckets x
groups`` rows; it also carries the last row of each bucket, so that a row's
neighbour in the bucket before needs no join of the rows.

The input is written to the shared folder once, and all passes read that. The
bucket bounds, as many as shuffle partitions, are drawn from the order values
with the smallest hashes; one literal table of them enters the expression
that finds a row's bucket by halving.  A bucket is thus a function of the
value alone; nothing depends on an exchange being reused.
Order values must be unique within a group (aggregate first).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.types import qcol
from tessera.session import stored

SAMPLE_PER_BUCKET = 32


def bucket_bounds(df: DataFrame, order_col: str, buckets: int, repeated: bool = True) -> list:
    """At most ``buckets - 1`` ascending cut points of near-even buckets. ``repeated``: values may occur twice."""
    if buckets < 2:
        return []
    values = df.select(qcol(order_col).alias("v")).where(F.col("v").isNotNull())
    values = values.distinct() if repeated else values
    drawn = sorted(r.v for r in values.orderBy(F.xxhash64("v"), "v").limit(SAMPLE_PER_BUCKET * buckets).collect())
    step = len(drawn) / buckets
    return sorted({drawn[int(k * step)] for k in range(1, buckets) if drawn})


def _literal(value, kind: T.DataType) -> Column:
    if isinstance(kind, T.StructType):
        return F.struct(*[_literal(v, f.dataType).alias(f.name) for v, f in zip(value, kind.fields)])
    return F.lit(value).cast(kind)


def bucket_of(x: Column, bounds: Sequence, kind: T.DataType) -> Column:
    """Number of bounds <= x: halving steps over one literal array."""
    if not bounds:
        return F.lit(0)
    table = F.array(*[_literal(b, kind) for b in bounds])
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(bounds).bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda n, p: F.when(F.get(table, n + p - 1) <= x, n + p).otherwise(n))


def running_totals(
    df: DataFrame,
    order_col: str,
    value_cols: Sequence[str],
    group_cols: Sequence[str] = (),
    num_partitions: int | None = None,
    prefix: str = "cum_",
    totals: bool = False,
    previous: bool = False,
    written: bool = False,
) -> DataFrame:
    """Add ``cum_<v>`` = inclusive sum of ``v`` over rows of the same group
    whose ``order_col`` is <= this row's (ascending order).  ``totals`` adds
    ``total_<v>``, the sum over the group; ``previous`` adds ``prev_<v>``, the
    value in the group's row before (null in its first).  ``written``: ``df`` is
    read from storage as it is, and need not be written."""
    if num_partitions is None:
        num_partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    columns, groups = df.columns, [qcol(g) for g in group_cols]
    held = df if written else stored(df, "ranked")
    bounds = bucket_bounds(held, order_col, num_partitions, bool(group_cols))
    part = held.withColumn("_pid", bucket_of(qcol(order_col), bounds, df.schema[order_col].dataType))
    part = part.repartition("_pid", *groups)  # read by the rows and by the totals
    w = Window.partitionBy("_pid", *groups).orderBy(qcol(order_col))
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = [F.sum(qcol(v)).over(upto).alias(f"_l_{v}") for v in value_cols]
    local += [F.lag(qcol(v)).over(w).alias(f"_p_{v}") for v in value_cols] if previous else []
    sums = part.groupBy("_pid", *groups).agg(
        *[F.sum(qcol(v)).alias(f"_t_{v}") for v in value_cols],
        F.max_by(F.struct(*[qcol(v).alias(f"_{i}") for i, v in enumerate(value_cols)]), qcol(order_col)).alias("_last"))
    w2 = Window.partitionBy(*groups).orderBy("_pid")
    whole = Window.partitionBy(*groups)
    offsets = sums.select(
        "_pid", *groups,
        *[(F.sum(qcol(f"_t_{v}")).over(w2) - qcol(f"_t_{v}")).alias(f"_o_{v}") for v in value_cols],
        *[F.sum(qcol(f"_t_{v}")).over(whole).alias(f"_w_{v}") for v in value_cols],
        F.lag("_last").over(w2).alias("_before"))
    out = part.select("*", *local).join(offsets, on=["_pid", *group_cols], how="inner")
    first = lambda v: qcol(f"_p_{v}").isNull()
    more = [qcol(f"_w_{v}").alias(f"total_{v}") for v in value_cols] if totals else []
    more += [F.when(first(v), F.col(f"_before._{i}")).otherwise(qcol(f"_p_{v}")).alias(f"prev_{v}")
             for i, v in enumerate(value_cols)] if previous else []
    return out.select(*[qcol(c) for c in columns],
                      *[(qcol(f"_o_{v}") + qcol(f"_l_{v}")).alias(f"{prefix}{v}") for v in value_cols], *more)


def dense_codes(df: DataFrame, col: str, out: str = "code") -> DataFrame:
    """(value, code) with code = 0-based position of the value in sorted
    distinct order, computed without a single-partition window."""
    levels = df.select(qcol(col).alias("value")).where(F.col("value").isNotNull()).distinct()
    levels = levels.withColumn("_one", F.lit(1).cast("long"))
    ranked = running_totals(levels, "value", ["_one"])
    return ranked.select("value", (F.col("cum__one") - 1).alias(out))
