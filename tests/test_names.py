"""Every operator on a table whose columns have dots, spaces and backticks in their names."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import chartdata, clean, evaluate, prep, profile, segment

X, Y, S, LABEL, KEY = "a.b", "c d.e", "s.`t`", "y.z", "k.id"


@pytest.fixture(scope="module")
def df(spark):
    rows = [(i, float(i % 17) if i % 5 else None, 100.0 if i == 7 else float(i % 3), ["u", "v.w", None][i % 3], i % 2) for i in range(60)]
    return spark.createDataFrame(rows, "id long, x double, w double, s string, l int").toDF(KEY, X, Y, S, LABEL).cache()


def test_profile(df):
    rows = {r.column: r for r in profile.profile(df).collect()}
    assert list(rows) and rows[X].null_pct == 20.0 and rows[S].top_value == "u" and rows[LABEL].target_rank == 0
    assert {r.column: r.null_pct for r in profile.null_percentages(df).collect()}[X] == 20.0
    assert profile.duplicate_count(df).first().n_duplicates == 0
    assert {r.column for r in profile.describe_numeric(df).collect()} == {KEY, X, Y, LABEL}
    assert {r.column for r in profile.cardinality(df).collect()} == {S}
    assert profile.describe_categorical(df).first().n_unique == 2
    assert profile.suggest_target(df).count() > 0


def test_parts_of_the_profile_agree_with_it(df):
    whole = {r.column: r for r in profile.profile(df).collect()}
    for r in profile.describe_numeric(df).collect():
        w = whole[r.column]
        assert (w.n_numeric, w.mean, w.std, w.min, w.q25, w.q50, w.q75, w.max) == (r["count"], r.mean, r.std, r.min, r.q25, r.q50, r.q75, r.max)
    assert {r.column: r.semantic_type for r in profile.semantic_types(df).collect()} == {c: r.semantic_type for c, r in whole.items()}


def test_clean(df):
    done = clean.handle_missing(df, {X: "median", S: "mode"})
    assert done.where(F.col(f"`{X}`").isNull() | F.col("`s.``t```").isNull()).count() == 0
    assert clean.handle_missing(df, {X: "mean", Y: "mean"}).columns == df.columns
    assert clean.handle_missing(df, {X: "drop"}).count() == 48
    assert {r.column: r.n_outliers for r in clean.outlier_summary(df).collect()}[Y] == 1
    for method in ("iqr", "zscore"):
        for action in ("keep", "remove", "cap"):
            assert set(df.columns) <= set(clean.handle_outliers(df, method, action).columns)
    assert clean.remove_duplicates(df.union(df)).count() == 60


def test_prepare(df):
    for method in ("onehot", "label", "auto"):
        out, _ = prep.encode_categoricals(df, method)
        assert out.count() == 60
    cut = prep.split_data(df, LABEL, [KEY])
    assert {r.split: r["count"] for r in cut.groupBy("split").count().collect()} == {"train": 42, "val": 9, "test": 9}
    for method in ("standard", "minmax", "robust"):
        assert prep.scale_features(cut, method, [X, Y])[0].count() == 60
    assert prep.prepare_features_target(df, LABEL, [X, Y]).columns == [X, Y, LABEL]


def test_segment(df):
    feats = segment.assemble(df, [X, Y])
    assert feats.count() == 48 and feats.columns == [*df.columns, "features"]
    res = segment.run_kmeans(feats, 2, n_init=1)
    lab = res.assign(feats).withColumnRenamed("cluster", "c.l")
    assert segment.silhouette_samples(lab, "features", "c.l", KEY).count() == 48
    prof = segment.cluster_profiles(lab, "c.l", [X, Y])
    assert segment.describe_clusters(prof, [X, Y]).count() == 2
    assert {r.feature for r in segment.profile_long(prof, [X, Y]).collect()} == {f"{X}_mean", f"{Y}_mean"}


def test_charts(df):
    assert chartdata.missing_ranked(df).first().column == S
    assert chartdata.correlation(df, [X, Y]).count() == 4
    rng = np.random.default_rng(1)
    wide = rng.normal(size=(300, 200)) * 1e-3 + 1e6
    wide[rng.random(wide.shape) < 0.1] = np.nan
    wide[:, 7] = 5.5
    rows = [[None if np.isnan(v) else float(v) for v in r] for r in wide]
    got = {(r.col_a, r.col_b): r.corr for r in chartdata.correlation(df.sparkSession.createDataFrame(rows, ", ".join(f"`v.{i}` double" for i in range(200))), digits=6).collect()}
    assert len(got) == 40_000 and got["v.7", "v.3"] is None and got["v.4", "v.4"] == 1.0
    for i, j in ((0, 1), (3, 199), (50, 60)):
        both = ~np.isnan(wide[:, i]) & ~np.isnan(wide[:, j])
        assert got[f"v.{i}", f"v.{j}"] == got[f"v.{j}", f"v.{i}"] == pytest.approx(np.corrcoef(wide[both, i], wide[both, j])[0, 1], abs=2e-6)
    assert chartdata.histogram(df, X).count() > 1 and chartdata.boxplot(df, [X, Y]).count() == 2
    assert chartdata.kde(df, X).count() > 1 and chartdata.value_counts(df, S).count() >= 2


def test_evaluate(df):
    d = df.where(F.col(f"`{X}`").isNotNull()).withColumn("p.r", (F.col(f"`{Y}`") > 1).cast("int"))
    assert evaluate.classification_metrics(d, LABEL, "p.r").count() == 1
    assert evaluate.auc_binary(d, LABEL, X).first().auc is not None
    assert evaluate.roc_curve(d, LABEL, X).count() > 2
    assert evaluate.confusion_matrix(d, LABEL, "p.r").count() == 4 and evaluate.confusion_binary(d, LABEL, "p.r").count() == 1
