"""Chart data, experiment log, streaming scoring and clustering invariants."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import chartdata, classify, experiments, segment
from tessera.streaming import score_stream


def test_histogram_and_kde(spark):
    vals = [float(v) for v in range(1, 101)]
    df = spark.createDataFrame([(v,) for v in vals] + [(None,)], "x double")
    h = sorted(chartdata.histogram(df, "x").collect())
    assert len(h) == math.ceil(math.log2(100) + 1) and sum(r["count"] for r in h) == 100
    width = h[0].upper - h[0].lower
    assert sum(r.density * width for r in h) == pytest.approx(1.0)
    k = chartdata.kde(df, "x", grid=50, digits=None).collect()
    sd = np.std(vals, ddof=1)
    hbw = sd * 100 ** -0.2
    g = sorted(k, key=lambda r: r.point)[25]
    expect = np.exp(-0.5 * ((g.x - np.array(vals)) / hbw) ** 2).sum() / (100 * hbw * math.sqrt(2 * math.pi))
    assert g.density == pytest.approx(expect)


def test_boxplot_and_correlation(spark):
    df = spark.createDataFrame([(float(i), 2.0 * i + 1, 5.0) for i in range(10)] + [(100.0, None, 5.0)],
                               "a double, b double, c double")
    box = {r.column: r for r in chartdata.boxplot(df).collect()}
    assert box["a"].n_outliers == 1 and box["a"].upper_whisker == 9.0
    corr = {(r.col_a, r.col_b): r.corr for r in chartdata.correlation(df).collect()}
    assert corr[("a", "b")] == 1.0 and corr[("a", "c")] is None


def test_experiment_log_widens_params(spark, tmpdir_path):
    d = tmpdir_path + "/log"
    experiments.log_experiment(spark, d, "tree", {"max_depth": 5}, {"accuracy": 0.9, "f1": 0.8}, "val")
    experiments.log_experiment(spark, d, "forest", {"n_estimators": 100}, {"accuracy": 0.95, "auc": 0.97})
    t = experiments.experiments_table(spark, d)
    assert {"param_max_depth", "param_n_estimators"} <= set(t.columns) and t.count() == 2
    long = experiments.metrics_long(t)
    assert long.where(F.col("value").isNotNull()).count() == 4


def test_stream_scoring_matches_batch(spark, tmpdir_path):
    rows = [(i, float(i % 50), float(i % 7), int(i % 50 >= 25)) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, x double, z double, y int")
    m = classify.train_decision_tree(df, ["x", "z"], "y", max_depth=3)
    src = tmpdir_path + "/in"
    df.select("id", "x", "z").repartition(3).write.parquet(src)
    q = score_stream(spark, m, src, df.select("id", "x", "z").schema, tmpdir_path + "/out",
                     tmpdir_path + "/ckpt", keep_cols=["id"])
    q.awaitTermination()
    streamed = {r.id: r.prediction for r in spark.read.parquet(tmpdir_path + "/out").collect()}
    batch = {r.id: r.prediction for r in m.predict(df).collect()}
    assert streamed == batch


def test_divisive_clusters_on_few_rows_and_pca(spark):
    pts = [(i, [float(v), 0.0]) for i, v in enumerate([0, 1, 2, 10, 11, 30])]
    df = spark.createDataFrame(pts, "id long, x array<double>")
    feats = segment.assemble(df, ["x"])
    lab = {r.id: r.cluster for r in segment.run_bisecting(feats, 3).collect()}
    # three clusters of neighbours: the label changes twice along the line
    assert len(set(lab.values())) == 3 and sum(lab[i] != lab[i + 1] for i in range(5)) == 2
    pca = segment.pca_2d(feats, ["id"]).collect()
    assert pca[0].var_ratio_1 == pytest.approx(1.0) and abs(sum(r.pc1 for r in pca)) < 1e-9


def test_log_keeps_all_metrics(spark, tmpdir_path):
    d = tmpdir_path + "/all-metrics"
    assert experiments.experiments_table(spark, d).count() == 0
    experiments.log_experiment(spark, d, "m", {}, {"accuracy": 1, "specificity": 0.25})
    experiments.log_experiment(spark, d, "n", {"a.b": 1}, {"f1": 0.5})
    rows = {r.model: r for r in experiments.experiments_table(spark, d).collect()}
    assert (rows["m"]["accuracy"], rows["m"]["specificity"], rows["n"]["specificity"], rows["n"]["param_a.b"]) == (1.0, 0.25, None, "1")
