import itertools

import pytest

from tessera.operators import evaluate


def _brute_auc(y, s):
    pos = [b for a, b in zip(y, s) if a == 1]
    neg = [b for a, b in zip(y, s) if a == 0]
    tot = sum(1.0 if p > n else 0.5 if p == n else 0.0 for p, n in itertools.product(pos, neg))
    return tot / (len(pos) * len(neg))


def test_auc_with_ties_matches_brute_force(spark):
    y = [1, 0, 1, 0, 1, 1, 0, 0, 1, 0, 0, 1]
    s = [0.9, 0.9, 0.5, 0.4, 0.5, 0.1, 0.1, 0.3, 0.8, 0.2, 0.5, 0.7]
    df = spark.createDataFrame(list(zip(y, s)), "y int, s double")
    assert evaluate.auc_binary(df, "y", "s", digits=None).first().auc == pytest.approx(_brute_auc(y, s))


def test_auc_single_class_is_null(spark):
    df = spark.createDataFrame([(1, 0.2), (1, 0.3)], "y int, s double")
    assert evaluate.auc_binary(df, "y", "s").first().auc is None


def test_metrics_zero_division_and_absent_class(spark):
    df = spark.createDataFrame([(0, 0), (1, 0), (0, 0)], "y int, p int")
    r = evaluate.classification_metrics(df, "y", "p", "binary").first()
    assert (r.precision, r.recall, r.f1) == (0.0, 0.0, 0.0) and r.accuracy == pytest.approx(0.6667)
    multi = spark.createDataFrame([("a", "a"), ("b", "c"), ("b", "b")], "y string, p string")
    cm = evaluate.confusion_matrix(multi, "y", "p").collect()
    assert len(cm) == 4 and sum(r["count"] for r in cm) == 2  # prediction 'c' drops out
    mac = evaluate.classification_metrics(multi, "y", "p", "macro").first()
    assert mac.recall == pytest.approx(round((1 + 0.5 + 0) / 3, 4))


def test_roc_points_keep_corners(spark):
    y = [0, 0, 1, 1]
    s = [0.1, 0.4, 0.35, 0.8]
    df = spark.createDataFrame(list(zip(y, s)), "y int, s double")
    pts = sorted((r.fpr, r.tpr) for r in evaluate.roc_curve(df, "y", "s").collect())
    assert pts == [(0.0, 0.0), (0.0, 0.5), (0.5, 0.5), (0.5, 1.0), (1.0, 1.0)]


def test_confusion_binary(spark):
    df = spark.createDataFrame([(1, 1), (1, 0), (0, 0), (0, 1), (0, 0)], "y int, p int")
    r = evaluate.confusion_binary(df, "y", "p").first()
    assert (r.TP, r.TN, r.FP, r.FN) == (1, 2, 1, 1) and r.specificity == pytest.approx(0.6667)
