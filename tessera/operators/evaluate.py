"""Classifier evaluation on a predictions DataFrame.

Every metric starts from one aggregate of the scored rows -- the
(label, prediction) count table for class metrics, the per-score
(positives, negatives) table for AUC and ROC -- so the scored data is read
once and only tables bounded by classes^2 or by distinct scores are
processed further.  Cumulative counts over scores use the distributed
running totals (no single-partition window).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.ranking import running_totals
from tessera.functions.types import qcol
from tessera.session import stored

AVERAGES = ("weighted", "macro", "binary")
MAX_CLASSES = 10_000
MAX_GRID_CLASSES = 1_000


def _r4(c: Column) -> Column:
    return F.bround(c, 4)


def _div(a: Column, b: Column) -> Column:
    """a / b, 0.0 when b is 0 (zero_division = 0)."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a.cast("double") / b.cast("double"))


def class_values(df: DataFrame, col: str) -> list:
    """Sorted distinct non-null values (bounded by MAX_CLASSES)."""
    rows = df.where(qcol(col).isNotNull()).select(qcol(col).alias("v")).distinct().limit(MAX_CLASSES + 1).collect()
    if len(rows) > MAX_CLASSES:
        raise ValueError(f"{col!r} has more than {MAX_CLASSES} classes")
    return sorted(r["v"] for r in rows)


def per_class_counts(df: DataFrame, label_col: str, pred_col: str) -> DataFrame:
    """(cls, tp, support, predicted) over the union of true and predicted
    classes, from one (label, prediction) count table: each count row
    contributes to its true class, its predicted class and, on the
    diagonal, to tp."""
    ltype = df.schema[label_col].dataType
    cnt = (df.select(qcol(label_col).alias("y"), qcol(pred_col).cast(ltype).alias("p"))
           .groupBy("y", "p").agg(F.count(F.lit(1)).alias("n")))
    zero = F.lit(0).cast("long")
    parts = F.array(
        F.struct(F.col("y").alias("cls"), F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(zero).alias("tp"),
                 F.col("n").alias("support"), zero.alias("predicted")),
        F.struct(F.col("p").alias("cls"), zero.alias("tp"), zero.alias("support"), F.col("n").alias("predicted")))
    spread = cnt.select(F.explode(parts).alias("e")).select("e.*").where(F.col("cls").isNotNull())
    return spread.groupBy("cls").agg(*[F.sum(c).cast("long").alias(c) for c in ("tp", "support", "predicted")])


def classification_metrics(df: DataFrame, label_col: str, pred_col: str, average: str = "weighted",
                           pos_label=None) -> DataFrame:
    """One row: accuracy, f1, precision, recall (4 dp), zero division -> 0.

    weighted: per-class values weighted by true support; macro: plain mean
    over the union of true and predicted classes; binary: the positive
    class only (``pos_label``, default: the larger of two classes).  The
    scored rows are read once; the rest works on the per-class table."""
    if average not in AVERAGES:
        raise ValueError(f"unsupported average {average!r}")
    pc = per_class_counts(df, label_col, pred_col)
    prec = _div(F.col("tp"), F.col("predicted"))
    rec = _div(F.col("tp"), F.col("support"))
    pc = pc.withColumn("precision", prec).withColumn("recall", rec).withColumn(
        "f1", F.when(F.col("precision") + F.col("recall") == 0, F.lit(0.0))
        .otherwise(2.0 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))))
    if average == "binary":
        if pos_label is None:
            classes = class_values(df, label_col)
            if len(classes) > 2:
                raise ValueError("binary average needs at most two classes")
            pos_label = classes[-1]
        is_pos = F.col("cls") == F.lit(pos_label)
        agg = [F.max(F.when(is_pos, F.col(m))).alias(m) for m in ("precision", "recall", "f1")]
    elif average == "weighted":
        w = F.col("support").cast("double")
        agg = [_div(F.sum(F.col(m) * w), F.sum(w)).alias(m) for m in ("precision", "recall", "f1")]
    else:
        agg = [F.avg(m).alias(m) for m in ("precision", "recall", "f1")]
    out = pc.agg(_div(F.sum("tp"), F.sum("support")).alias("accuracy"), *agg)
    return out.select(_r4(F.col("accuracy")).alias("accuracy"),
                      _r4(F.coalesce(F.col("f1"), F.lit(0.0))).alias("f1"),
                      _r4(F.coalesce(F.col("precision"), F.lit(0.0))).alias("precision"),
                      _r4(F.coalesce(F.col("recall"), F.lit(0.0))).alias("recall"))


# ---------------------------------------------------------------------------
# AUC / ROC
# ---------------------------------------------------------------------------

def _score_table(df: DataFrame, is_pos: Column, score: Column, group_cols: Sequence[str] = ()) -> DataFrame:
    """(group..., score, pos, neg): one row per distinct score."""
    return (df.select(*[qcol(g) for g in group_cols], score.cast("double").alias("score"),
                      is_pos.cast("long").alias("_p"))
            .where(F.col("score").isNotNull())
            .groupBy(*[qcol(g) for g in group_cols], "score")
            .agg(F.sum("_p").alias("pos"), F.sum(1 - F.col("_p")).alias("neg")))


def _auc_from_scores(st: DataFrame, group_cols: Sequence[str] = ()) -> DataFrame:
    """Mann-Whitney AUC per group: sum over scores of pos * (negatives
    below + half the tied negatives) / (P * N).  Terms are halves of
    integers, so the sum is exact."""
    groups = [qcol(g) for g in group_cols]
    return running_totals(st, "score", ["neg"], group_cols).groupBy(*groups).agg(*_auc_terms())


def _auc_terms() -> list[Column]:
    """Aggregates (auc, P, N) over scores with their ascending sums."""
    p, n = F.sum("pos"), F.sum("neg")
    u = F.sum(F.col("pos") * ((F.col("cum_neg") - F.col("neg")).cast("double") + 0.5 * F.col("neg")))
    return [F.when((p > 0) & (n > 0), u / (p.cast("double") * n.cast("double"))).alias("auc"), p.alias("P"), n.alias("N")]


def auc_binary(df: DataFrame, label_col: str, score_col: str, pos_label=None, digits: int | None = 4) -> DataFrame:
    """One row ``auc``: exact ROC AUC (ties count one half); null unless
    the labels have exactly two classes."""
    classes = class_values(df, label_col)
    spark = df.sparkSession
    if len(classes) != 2:
        return spark.createDataFrame([(None,)], "auc double")
    pos = classes[-1] if pos_label is None else pos_label
    st = _score_table(df, qcol(label_col) == F.lit(pos), qcol(score_col))
    a = _auc_from_scores(st)
    val = F.bround(F.col("auc"), digits) if digits is not None else F.col("auc")
    return a.select(val.alias("auc"))


def auc_ovr(df: DataFrame, label_col: str, prob_cols: Sequence[str], classes: Sequence | None = None,
            digits: int | None = 4) -> DataFrame:
    """One row ``auc``: one-vs-rest AUC per class weighted by class
    prevalence; probability column i belongs to ``classes[i]`` (sorted true
    classes by default).  Null for a single class."""
    spark = df.sparkSession
    classes = list(classes) if classes is not None else class_values(df, label_col)
    if len(classes) < 2 or len(classes) != len(prob_cols):
        return spark.createDataFrame([(None,)], "auc double")
    ltype = df.schema[label_col].dataType
    pairs = F.array(*[F.struct(F.lit(c).cast(ltype).alias("cls"), qcol(p).cast("double").alias("score"))
                      for c, p in zip(classes, prob_cols)])
    long = df.select(qcol(label_col).alias("y"), F.explode(pairs).alias("s")).select("y", "s.cls", "s.score")
    st = _score_table(long, F.col("y") == F.col("cls"), F.col("score"), ["cls"])
    a = _auc_from_scores(st, ["cls"])
    agg = a.agg(F.sum(F.col("auc") * F.col("P")).alias("num"), F.sum("P").alias("den"),
                F.count_if(F.col("auc").isNull()).alias("bad"))
    val = F.when(F.col("bad") == 0, F.col("num") / F.col("den"))
    return agg.select((F.bround(val, digits) if digits is not None else val).alias("auc"))


def roc_curve(df: DataFrame, label_col: str, score_col: str, group_cols: Sequence[str] = (),
              pos_label=None, drop_intermediate: bool = True, digits: int | None = 4) -> DataFrame:
    """ROC points per group: (group..., threshold, fpr, tpr, auc), starting at
    (inf, 0, 0); collinear interior points dropped by default.  The scored
    rows are aggregated once to (score, positives, negatives); running sums of
    those, with each score's lower neighbour beside it, are written once, and
    points and AUC are read from them."""
    spark = df.sparkSession
    if pos_label is None:
        classes = class_values(df, label_col)
        if len(classes) != 2:
            return spark.createDataFrame([], "threshold double, fpr double, tpr double, auc double")
        pos_label = classes[-1]
    groups = [qcol(g) for g in group_cols]
    st = _score_table(df, qcol(label_col) == F.lit(pos_label), qcol(score_col), group_cols).withColumn("_one", F.lit(1).cast("long"))
    cum = stored(running_totals(st, "score", ["pos", "neg", "_one"], group_cols, totals=True, previous=True), "roc")
    auc = cum.groupBy(*groups).agg(*_auc_terms())
    auc = auc.select(*groups, "P", "N", (F.bround("auc", digits) if digits is not None else F.col("auc")).alias("auc"))
    rate = lambda n, d: F.when(F.col(d) > 0, F.col(n) / F.col(d).cast("double"))
    # Ascending sums; a point counts the scores from its own up.
    pts = cum.select(*groups, F.col("score").alias("threshold"), F.col("total_pos").alias("P"), F.col("total_neg").alias("N"),
                     (F.col("total_pos") - F.col("cum_pos") + F.col("pos")).alias("tps"),
                     (F.col("total_neg") - F.col("cum_neg") + F.col("neg")).alias("fps"), "pos", "neg", "prev_pos", "prev_neg",
                     (F.col("total__one") - F.col("cum__one")).alias("i"), F.col("total__one").alias("D"))
    if drop_intermediate:
        # This point's step up is its own (pos, neg), the next one's that of the lower score: a corner if they differ.
        corner = (F.col("prev_pos") != F.col("pos")) | (F.col("prev_neg") != F.col("neg"))
        pts = pts.where((F.col("D") <= 2) | (F.col("i") == 0) | (F.col("i") == F.col("D") - 1) | corner)
    body = pts.select(*groups, "threshold", rate("fps", "N").alias("fpr"), rate("tps", "P").alias("tpr"))
    start = auc.select(*groups, F.lit(float("inf")).alias("threshold"), F.when(F.col("N") > 0, F.lit(0.0)).alias("fpr"),
                       F.when(F.col("P") > 0, F.lit(0.0)).alias("tpr"))
    both = start.unionByName(body)
    if group_cols:  # one row a group
        return both.join(auc.select(*groups, "auc"), list(group_cols)).select(*groups, "threshold", "fpr", "tpr", "auc")
    row = auc.first()
    return both.select("*", F.lit(row["auc"] if row else None).cast("double").alias("auc"))


def auc_by_group(df: DataFrame, label_col: str, score_col: str, group_cols: Sequence[str], pos_label,
                 digits: int | None = 4) -> DataFrame:
    """Exact AUC per group (e.g. per model when scores are stacked)."""
    st = _score_table(df, qcol(label_col) == F.lit(pos_label), qcol(score_col), group_cols)
    a = _auc_from_scores(st, group_cols)
    return a.select(*group_cols, (F.bround("auc", digits) if digits is not None else F.col("auc")).alias("auc"))


# ---------------------------------------------------------------------------
# confusion matrix
# ---------------------------------------------------------------------------

def confusion_matrix(df: DataFrame, label_col: str, pred_col: str) -> DataFrame:
    """Long form (true, predicted, count) over the classes present in the
    labels (sorted), zero cells kept; predictions of other classes drop out."""
    classes = class_values(df, label_col)
    spark = df.sparkSession
    ltype = df.schema[label_col].dataType
    cnt = (df.select(qcol(label_col).alias("true"), qcol(pred_col).cast(ltype).alias("predicted"))
           .groupBy("true", "predicted").agg(F.count(F.lit(1)).alias("count")))
    if len(classes) > MAX_GRID_CLASSES:
        raise ValueError(f"{len(classes)} classes; a dense confusion matrix is capped at {MAX_GRID_CLASSES}")
    # k class rows; the k x k cells are generated on the executors
    grid = (spark.createDataFrame([(c,) for c in classes], T.StructType([T.StructField("true", ltype)]))
            .select("true", F.explode(F.array(*[F.lit(c).cast(ltype) for c in classes])).alias("predicted")))
    return (grid.join(cnt, ["true", "predicted"], "left")
            .select("true", "predicted", F.coalesce("count", F.lit(0)).cast("long").alias("count")))


def confusion_binary(df: DataFrame, label_col: str, pred_col: str, pos_label=None) -> DataFrame:
    """One row: TP, TN, FP, FN, sensitivity, specificity, ppv (4 dp);
    positive = larger of the two classes unless given."""
    classes = class_values(df, label_col)
    spark = df.sparkSession
    if len(classes) != 2:
        return spark.createDataFrame([], "TP long, TN long, FP long, FN long, sensitivity double, "
                                         "specificity double, ppv double")
    pos = classes[-1] if pos_label is None else pos_label
    neg = [c for c in classes if c != pos][0]
    y, p = qcol(label_col), qcol(pred_col)
    a = df.agg(F.count_if((y == F.lit(pos)) & (p == F.lit(pos))).alias("TP"),
               F.count_if((y == F.lit(neg)) & (p == F.lit(neg))).alias("TN"),
               F.count_if((y == F.lit(neg)) & (p == F.lit(pos))).alias("FP"),
               F.count_if((y == F.lit(pos)) & (p == F.lit(neg))).alias("FN"))
    return a.select("TP", "TN", "FP", "FN",
                    _r4(_div(F.col("TP"), F.col("TP") + F.col("FN"))).alias("sensitivity"),
                    _r4(_div(F.col("TN"), F.col("TN") + F.col("FP"))).alias("specificity"),
                    _r4(_div(F.col("TP"), F.col("TP") + F.col("FP"))).alias("ppv"))
