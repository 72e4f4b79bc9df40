"""Preparation: feature/target projection, categorical encoding, seeded
three-way split and train-only scaling.

Everything fitted (levels, codes, quotas, centres and scales) is a small
parameter set; applying it is a projection or a broadcast join on a table
whose size is checked first.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.hashing import order_hash, row_key
from tessera.functions.ranking import dense_codes, running_totals
from tessera.functions.stats import exact_quantiles
from tessera.functions.types import melt, numeric_cols, qcol, string_cols
from tessera.session import ensure_checkpoint_dir, stored

LOW_CARD_THRESHOLD = 10
MAX_ONEHOT_LEVELS = 1000
#: Rows that a cell of the split's hash range holds on average.
CELL_ROWS = 4096
NULL_LABEL = "nan"


# ---------------------------------------------------------------------------
# F1 projection
# ---------------------------------------------------------------------------

def prepare_features_target(df: DataFrame, target_col: str, feature_cols: Sequence[str]) -> DataFrame:
    """Features then target, in one DataFrame; unknown names raise."""
    missing = [c for c in [*feature_cols, target_col] if c not in df.columns]
    if missing:
        raise KeyError(f"unknown columns: {missing}")
    return df.select(*[qcol(c) for c in feature_cols], qcol(target_col))


# ---------------------------------------------------------------------------
# E1-E3 encoding
# ---------------------------------------------------------------------------

@dataclass
class FittedEncoder:
    """Levels per one-hot column and a (value, code) table per label column."""

    onehot: dict[str, list[str]] = field(default_factory=dict)
    label: dict[str, DataFrame] = field(default_factory=dict)
    label_sizes: dict[str, int] = field(default_factory=dict)
    skipped: list[str] = field(default_factory=list)

    def info(self) -> dict:
        return {"onehot": list(self.onehot), "label": dict(self.label_sizes), "skipped": list(self.skipped)}

    def transform(self, df: DataFrame) -> DataFrame:
        """Apply to any frame with the same columns.  Unseen one-hot levels
        give all zeros; unseen label values give code -1."""
        out = df
        for c, table in self.label.items():
            mapping = table.select(F.col("value").alias("__value"), F.col("code").alias("__code"))
            keyed = out.withColumn("__key", F.coalesce(qcol(c).cast("string"), F.lit(NULL_LABEL)))
            # broadcast or shuffled by the bytes that Spark measures
            out = keyed.join(mapping, F.col("__key") == F.col("__value"), "left")
            out = out.withColumn(c, F.coalesce("__code", F.lit(-1).cast("long"))).drop("__key", "__value", "__code")
        keep = [qcol(c) for c in df.columns if c not in self.onehot]
        dummies = []
        for c, levels in self.onehot.items():
            for lv in levels:
                dummies.append(F.coalesce((qcol(c) == F.lit(lv)).cast("long"), F.lit(0).cast("long"))
                               .alias(f"{c}_{lv}"))
        # label columns were rewritten in place; keep original order
        return out.select(*keep, *dummies)


def _levels(df: DataFrame, cols: Sequence[str]) -> tuple[dict, dict, dict]:
    """From one value-frequency table: ({column: sorted levels or None if
    more than MAX_ONEHOT_LEVELS}, {column: n_unique}, {column: has nulls})."""
    if not cols:
        return {}, {}, {}
    long = melt(df, [(c, qcol(c).cast("string")) for c in cols])
    freq = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    summary = freq.groupBy("column").agg(
        F.count("value").alias("n_unique"),
        F.max(F.col("value").isNull()).alias("has_null")).collect()
    card = {r["column"]: r["n_unique"] for r in summary}
    nulls = {r["column"]: bool(r["has_null"]) for r in summary}
    small = [c for c in cols if card.get(c, 0) <= MAX_ONEHOT_LEVELS]
    levels: dict[str, list | None] = {c: None for c in cols}
    for c in small:
        levels[c] = []
    if small:
        # second, narrower pass: only the few-level columns' cells are grouped
        # (the filter is applied before the shuffle); at most
        # MAX_ONEHOT_LEVELS values per column reach the driver
        few = long.where(F.col("column").isin(small) & F.col("value").isNotNull()) \
            .select("column", "value").distinct().collect()
        for r in few:
            levels[r["column"]].append(r["value"])
    for c in small:
        levels[c] = sorted(levels[c])
    return levels, card, nulls


def fit_encoder(df: DataFrame, method: str = "auto", low_card_threshold: int = LOW_CARD_THRESHOLD,
                exclude_cols: Sequence[str] | None = None) -> FittedEncoder:
    """Choose and fit encodings for the string columns of ``df``.

    auto: one-hot when the number of distinct non-null values is below the
    threshold (strict), label encoding otherwise; onehot / label force one
    method; anything else skips the columns."""
    exclude = set(exclude_cols or [])
    cats = [c for c in string_cols(df) if c not in exclude]
    enc = FittedEncoder()
    if method not in ("auto", "onehot", "label"):
        enc.skipped = cats
        return enc
    lv, card, has_null_col = _levels(df, cats)
    for c in cats:
        n_unique = card.get(c, 0)
        use = method if method != "auto" else ("onehot" if n_unique < low_card_threshold else "label")
        if use == "onehot":
            if lv[c] is None:
                raise ValueError(f"{c!r} has {n_unique} levels; one-hot is capped at {MAX_ONEHOT_LEVELS}")
            enc.onehot[c] = lv[c]
        else:
            filled = df.select(F.coalesce(qcol(c).cast("string"), F.lit(NULL_LABEL)).alias(c))
            if lv[c] is not None:
                # few levels: codes from the sorted list (nulls become 'nan')
                values = sorted(set(lv[c]) | ({NULL_LABEL} if has_null_col.get(c) else set()))
                table = df.sparkSession.createDataFrame(
                    list(zip(values, range(len(values)))), "value string, code long")
                enc.label_sizes[c] = len(values)
            else:
                ensure_checkpoint_dir(df.sparkSession)
                table = dense_codes(filled, c).checkpoint()
                enc.label_sizes[c] = table.count()
            enc.label[c] = table
    return enc


def encode_categoricals(df: DataFrame, method: str = "auto", low_card_threshold: int = LOW_CARD_THRESHOLD,
                        exclude_cols: Sequence[str] | None = None) -> tuple[DataFrame, FittedEncoder]:
    """Fit on ``df`` and apply to it (the reference behaviour).  Fit on the
    train split and call ``transform`` on the rest to avoid leakage."""
    enc = fit_encoder(df, method, low_card_threshold, exclude_cols)
    return enc.transform(df), enc


# ---------------------------------------------------------------------------
# E4 split
# ---------------------------------------------------------------------------

def _allocate(strata: DataFrame, weight: str, take: int, out: str) -> DataFrame:
    """Adds ``out``: ``take`` rows spread over strata in proportion to
    ``weight`` by largest remainder; ties go to the smaller stratum, null last.
    ``strata`` is read from storage."""
    total = strata.agg(F.sum(weight)).first()[0]
    share = f"(CAST({take} AS DECIMAL(19,0)) * CAST({weight} AS DECIMAL(19,0)))"
    based = strata.withColumn("__base", F.expr(f"{share} div {max(total, 1)}")).withColumn(
        "__o", F.struct((-F.expr(f"CAST({share} % {max(total, 1)} AS BIGINT)")).alias("rem"),
                        F.col("__g").isNull().alias("none"), F.col("__g").alias("g")))
    ranked = stored(running_totals(based.withColumn("__one", F.lit(1).cast("long")), "__o", ["__one"], written=True), "strata")
    left = take - ranked.agg(F.sum("__base")).first()[0]
    # columns of a stored table: the next allocation reads it again
    return ranked.select(*strata.columns, (F.col("__base") + (F.col("cum___one") <= left).cast("long")).alias(out))


def split_quotas(strata: DataFrame, val_size: float, test_size: float) -> DataFrame:
    """(__g, n) -> (__g, n, held, n_test): the held-out share first (ceil),
    then test within it (ceil), each spread over strata by largest remainder."""
    n = strata.agg(F.sum("n")).first()[0]
    held = math.ceil((val_size + test_size) * n)
    rel = test_size / (val_size + test_size) if (val_size + test_size) > 0 else 0.0
    return _allocate(_allocate(strata, "n", held, "held"), "held", math.ceil(rel * held), "n_test")


def split_data(df: DataFrame, label_col: str | None, key_cols: Sequence[str], train_size: float = 0.7,
               val_size: float = 0.15, test_size: float = 0.15, stratify: bool = True,
               seed: int = 42, split_col: str = "split", cell_rows: int = CELL_ROWS) -> DataFrame:
    """Add ``split`` in train | val | test.

    Rows are ordered by a seeded hash of their key within each class
    (stratified) or overall; the first ``n_test`` rows of a class go to
    test, the next ``n_val`` to val, the rest to train.  Class sizes are
    exact, for any number of classes; nothing of a class passes the driver.

    The hash is even, so equal slices of its range are a sketch of a class:
    about one cell for ``cell_rows`` rows. Cells are counted, running totals
    of the counts name the cell of each cut, and only the rows of those cells
    are ranked.  A class holding a third of the data is never sorted whole.
    """
    if abs(train_size + val_size + test_size - 1.0) > 1e-6:
        raise ValueError("train, val and test sizes must sum to 1")
    grp = qcol(label_col) if (stratify and label_col) else F.lit(0)
    base = df.withColumn("__g", grp).withColumn("__k", row_key(*key_cols)).withColumn("__h", order_hash(F.col("__k"), seed))
    strata = stored(base.groupBy("__g").agg(F.count(F.lit(1)).alias("n")), "strata")
    if strata.isEmpty():
        return df.withColumn(split_col, F.lit("train"))
    quotas = split_quotas(strata, val_size, test_size).withColumnRenamed("__g", "__q")
    placed = base.join(quotas, F.col("__g").eqNullSafe(F.col("__q"))).withColumn(
        "cell", F.expr(f"CAST(CAST(__h AS DOUBLE) / {1 << 60}D * greatest(1, n div {cell_rows}) AS BIGINT)"))
    cells = placed.groupBy("__g", "cell").agg(F.count(F.lit(1)).alias("rows"), F.first("held").alias("held"), F.first("n_test").alias("n_test"))
    # a null class is a group as any other: it is told apart by a flag
    cells = cells.withColumn("__none", F.col("__g").isNull()).withColumn("__s", F.coalesce(F.col("__g").cast("string"), F.lit("")))
    run = running_totals(cells, "cell", ["rows"], ["__s", "__none"])
    holds = lambda c: (F.col("cum_rows") - F.col("rows") < F.col(c)) & (F.col(c) <= F.col("cum_rows"))
    cut_cells = run.where(holds("held") | holds("n_test")).select(
        F.col("__g").alias("__c"), F.col("cell").alias("__cell"), (F.col("cum_rows") - F.col("rows")).alias("before"))
    inside = placed.join(cut_cells, F.col("__g").eqNullSafe(F.col("__c")) & (F.col("cell") == F.col("__cell")))
    w = Window.partitionBy("__g", "cell").orderBy("__h", "__k")
    at = F.struct("__h", "__k")
    ranked = inside.select("__g", "held", "n_test", at.alias("at"), (F.lead(at).over(w) == at).alias("tied"),
                           (F.col("before") + F.row_number().over(w)).alias("rank"))
    cuts = stored(ranked.where("rank = held OR rank = n_test").groupBy(F.col("__g").alias("__c")).agg(
        F.max(F.when(F.col("rank") == F.col("n_test"), F.col("at"))).alias("__test"),
        F.max(F.when(F.col("rank") == F.col("held"), F.col("at"))).alias("__held"),
        F.bool_or("tied").alias("tied")), "cuts")
    if not cuts.where("tied").isEmpty():
        raise ValueError(f"split key {list(key_cols)} is not unique; rows tie at a cut")
    cut = base.join(cuts, F.col("__g").eqNullSafe(F.col("__c")), "left")
    label = F.when(at <= F.col("__test"), "test").when(at <= F.col("__held"), "val").otherwise("train")
    return cut.select(*[qcol(c) for c in df.columns], label.alias(split_col))


# ---------------------------------------------------------------------------
# E5 scaling
# ---------------------------------------------------------------------------

SCALERS = ("standard", "minmax", "robust")


@dataclass
class FittedScaler:
    method: str
    params: dict[str, tuple[float, float]]  # column -> (centre, scale)

    def transform(self, df: DataFrame) -> DataFrame:
        out = []
        for c in df.columns:
            if c in self.params:
                centre, scale = self.params[c]
                out.append(((qcol(c).cast("double") - F.lit(centre)) / F.lit(scale)).alias(c))
            else:
                out.append(qcol(c))
        return df.select(*out)

    def table(self, spark) -> DataFrame:
        return spark.createDataFrame([(c, m, s) for c, (m, s) in self.params.items()],
                                     "column string, centre double, scale double")


def fit_scaler(df: DataFrame, method: str = "standard", columns: Sequence[str] | None = None) -> FittedScaler:
    """standard: mean / population std; minmax: min / range; robust:
    median / IQR (exact).  A zero or missing divisor becomes 1."""
    if method not in SCALERS:
        raise ValueError(f"unsupported method {method!r}; use 'standard', 'minmax' or 'robust'")
    cols = numeric_cols(df, list(columns) if columns is not None else None)
    params: dict[str, tuple[float, float]] = {}
    if not cols:
        return FittedScaler(method, params)

    def nz(v):
        return 1.0 if v is None or v == 0 or (isinstance(v, float) and math.isnan(v)) else v

    if method == "robust":
        q = exact_quantiles(df, cols, [0.25, 0.5, 0.75])
        for c in cols:
            med, q1, q3 = q[(c, 0.5)], q[(c, 0.25)], q[(c, 0.75)]
            params[c] = (med if med is not None else 0.0, nz(None if q1 is None else q3 - q1))
        return FittedScaler(method, params)
    aggs = []
    for c in cols:
        x = qcol(c).cast("double")
        if method == "standard":
            aggs += [F.avg(x).alias(f"a::{c}"), F.stddev_pop(x).alias(f"b::{c}")]
        else:
            aggs += [F.min(x).alias(f"a::{c}"), F.max(x).alias(f"b::{c}")]
    row = df.agg(*aggs).first()
    for c in cols:
        a, b = row[f"a::{c}"], row[f"b::{c}"]
        if method == "standard":
            params[c] = (a if a is not None else 0.0, nz(b))
        else:
            params[c] = (a if a is not None else 0.0, nz(None if a is None else b - a))
    return FittedScaler(method, params)


def scale_features(df: DataFrame, method: str = "standard", columns: Sequence[str] | None = None,
                   split_col: str = "split", fit_on: str = "train") -> tuple[DataFrame, FittedScaler]:
    """Fit on rows of the ``fit_on`` split only, transform every row."""
    train = df.where(F.col(split_col) == fit_on) if split_col in df.columns else df
    scaler = fit_scaler(train, method, columns)
    return scaler.transform(df), scaler
