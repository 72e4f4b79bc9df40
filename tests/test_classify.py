import pytest
from pyspark.sql import functions as F

from tessera.operators import classify, forest


def _separable(spark):
    rows = [(i, float(i % 50), float((i * 7) % 13), "hi" if i % 50 >= 25 else "lo") for i in range(400)]
    return spark.createDataFrame(rows, "id long, x double, z double, y string")


def test_forest_beats_baseline_and_probabilities(spark):
    df = _separable(spark)
    base = classify.train_baseline(df, "y", "most_frequent").transform(df, ["id"])
    rf = classify.train_random_forest(df, ["x", "z"], "y", n_estimators=10, max_depth=5)
    pred = rf.predict(df)
    acc = pred.where(F.col("y") == F.col("prediction")).count() / 400
    base_acc = base.where(F.col("y") == F.col("prediction")).count() / 400
    assert acc > 0.95 > base_acc
    sums = pred.select(F.aggregate("probability", F.lit(0.0), lambda a, b: a + b).alias("s")).collect()
    assert all(abs(r.s - 1) < 1e-9 for r in sums)
    imp = dict(rf.feature_importances())
    assert sum(imp.values()) == pytest.approx(1.0) and imp["x"] > imp["z"]


def test_model_roundtrip(spark, tmpdir_path):
    df = _separable(spark)
    dt = classify.train_decision_tree(df, ["x", "z"], "y", max_depth=3, class_weight="balanced")
    dt.save(tmpdir_path + "/m")
    again = classify.load_classifier(tmpdir_path + "/m", dt.classes, dt.features, "y")
    a = {r.id: r.prediction for r in dt.predict(df).collect()}
    b = {r.id: r.prediction for r in again.predict(df).collect()}
    assert a == b


def test_baselines(spark):
    df = spark.createDataFrame([(i, "a" if i % 4 else "b") for i in range(200)], "id long, y string")
    maj = classify.train_baseline(df, "y", "most_frequent").transform(df, ["id"])
    assert {r.prediction for r in maj.collect()} == {"a"}
    strat = classify.train_baseline(df, "y", "stratified", seed=1).transform(df, ["id"])
    share = strat.where(F.col("prediction") == "b").count() / 200
    assert 0.1 < share < 0.4
    uni = classify.train_baseline(df, "y", "uniform", seed=1).transform(df, ["id"])
    assert {r.prediction for r in uni.collect()} == {"a", "b"}
    w = {r.y: r.weight for r in classify.class_weights(df, "y").collect()}
    assert w["b"] == pytest.approx(200 / (2 * 50))


def test_evaluate_model_and_single_records(spark):
    df = _separable(spark)
    dt = classify.train_decision_tree(df, ["x", "z"], "y", max_depth=4)
    r = classify.evaluate_model(dt, df).first()
    assert r.accuracy > 0.95 and r.auc > 0.95
    roc = classify.roc_for_model(dt, df).collect()
    assert min(p.fpr for p in roc) == 0.0 and max(p.tpr for p in roc) == 1.0
    one = classify.score_records(spark, dt, [{"x": 40.0, "z": 1.0}, {"x": 3.0, "z": 2.0}]).collect()
    assert [p.prediction for p in one] == ["hi", "lo"]


def test_many_classes(spark):
    df = spark.range(6000).select(F.col("id"), (F.col("id") % 3000).cast("int").alias("c"))
    weights = df.select(classify.balanced_weight(df, "c").alias("w")).distinct().collect()
    assert [r.w for r in weights] == [1.0]
    drawn = classify.train_baseline(df, "c", "stratified").transform(df, ["id"])
    assert drawn.select("prediction").distinct().count() > 1000


def test_score_records_values(spark):
    df = spark.range(200).select((F.col("id") / 10).alias("f"), (F.col("id") > 100).cast("int").alias("y"))
    model = classify.train_decision_tree(df, ["f"], "y", max_depth=2)
    assert [r.prediction for r in classify.score_records(spark, model, [{"f": 5}, {"f": 15}]).collect()] == [0, 1]
    with pytest.raises(KeyError):
        classify.score_records(spark, model, [{"g": 5}])


def test_raw_records_through_a_saved_model(spark, tmp_path):
    from tessera.operators import prep

    rows = [(i, ["a", "b's", None][i % 3], f"v{i % 30}", float(i % 13), int(i % 3 == 1 and i % 13 > 4)) for i in range(390)]
    df = spark.createDataFrame(rows, "id long, `few.x` string, many string, `n m` double, y int")
    enc = prep.fit_encoder(df, "auto", exclude_cols=["y"])
    coded = enc.transform(df)
    scaler = prep.fit_scaler(coded, "standard", ["n m"])
    ready = scaler.transform(coded)
    feats = [c for c in ready.columns if c not in ("id", "y")]
    model = classify.train_decision_tree(ready, feats, "y")
    raw = ["few.x", "many", "n m"]
    classify.with_preparation(model, enc, scaler, raw).save(str(tmp_path / "m"))
    again = classify.load_classifier(str(tmp_path / "m"), model.classes, model.features, "y", raw)
    want = {r.id: (r.prediction, r.probability) for r in model.predict(ready).collect()}
    assert {r.id: (r.prediction, r.probability) for r in again.predict(df).collect()} == want
    assert {p for p, _ in want.values()} == {0, 1}
    one = classify.score_records(spark, again, [dict(zip(raw, r[1:4])) for r in rows[:6]] + [{"few.x": "new", "many": "new", "n m": 3}])
    assert [(r.prediction, r.probability) for r in one.collect()][:6] == [want[i] for i in range(6)]
    with pytest.raises(KeyError):
        classify.score_records(spark, again, [{"few.x": "a", "many": "v1"}])


def test_rows_of_a_task_are_bounded(spark, monkeypatch):
    from tessera.functions import types

    monkeypatch.setattr(types, "ROWS_PER_TASK", 10)
    df = spark.range(400).selectExpr("id % 2 AS y", "CAST(id AS DOUBLE) AS `a.b`", "id AS other")
    assert types.spread(df.coalesce(2), 400).rdd.getNumPartitions() == max(40, spark.sparkContext.defaultParallelism)
    seen = []
    monkeypatch.setattr(classify, "spread", lambda d, n: seen.append((d.columns, n)) or types.spread(d, n))
    classify.train_decision_tree(df, ["a.b"], "y", max_depth=2)
    assert seen == [(["a.b", "y", "__label"], 400)]


def test_rows_of_few_partitions_among_empty_ones_are_dealt_out(spark, monkeypatch):
    """As the splits of a file of one row group: enough partitions, all rows in one of them."""
    from tessera.functions import types

    many = 10 * spark.sparkContext.defaultParallelism
    df = spark.range(0, 400, 1, 1).unionByName(spark.range(0, many, 1, many).where("id % 2 = 5"))
    monkeypatch.setattr(types, "ROWS_PER_TASK", 100)
    assert df.rdd.getNumPartitions() == many + 1 and types.largest_partition(df) == 400
    dealt = types.spread(df, 400)
    assert types.largest_partition(dealt) <= 100
    assert sorted(r.id for r in dealt.collect()) == list(range(400))
    even = spark.range(0, 400, 1, many)
    assert types.spread(even, 400) is even


def test_forest_fit_keeps_no_node_ids(spark):
    rf = classify.train_random_forest(_separable(spark), ["x", "z"], "y", n_estimators=2, max_depth=3)
    assert rf.estimator.getCacheNodeIds() is False  # rows x trees numbers, on disk at size


def _lines(spark, path, n=200):
    spark.range(n).selectExpr(
        "id AS l_orderkey", "CAST(1 AS INT) AS l_linenumber", "id AS l_partkey", "id AS l_suppkey", "CAST(id % 50 + 1 AS DOUBLE) AS l_quantity",
        "CAST(id * 7 % 100 * 1000 AS DOUBLE) AS l_extendedprice", "0.05D AS l_discount", "0.01D AS l_tax").coalesce(1).write.parquet(f"{path}/lineitem.parquet")
    return path


def test_stream_files_are_bounded_and_split_is_found_once(spark, tmpdir_path, monkeypatch):
    from tessera.plans import catalog

    sf, made = _lines(spark, tmpdir_path), {}
    shared = catalog.shared_dir
    monkeypatch.setattr(catalog, "shared_dir", lambda s, name: made.setdefault(name, shared(s, name)))
    monkeypatch.setattr(catalog, "STREAM_FILE_ROWS", 20)
    assert catalog.q_stream_scoring(spark, sf).count() == 200
    assert len(spark.read.parquet(made["stream-in"]).inputFiles()) == 10
    assert catalog.lineitem_split(spark, sf) is catalog.lineitem_split(spark, sf)


def _hyperbola(spark, n=3000):
    return spark.range(n).selectExpr("id", "CAST(id % 50 AS DOUBLE) AS `a.q`", "CAST(id * 7919 % 2999 AS DOUBLE) AS p", "CAST(id % 3 AS DOUBLE) AS noise",
                                     "CASE WHEN id % 50 * (id * 7919 % 2999) > 60000 THEN 'hi' WHEN id % 50 < 10 THEN 'lo' ELSE 'mid' END AS y")


def test_large_forest_is_grown_a_tree_a_task(spark, monkeypatch):
    """Rows counted by bins: one Spark job of a task a tree, not a pass over the rows for each level of all trees."""
    df, cols = _hyperbola(spark), ["a.q", "p", "noise"]
    rf = lambda: classify.train_random_forest(df, cols, "y", n_estimators=30)
    mllib = rf()
    monkeypatch.setattr(forest, "GROUPED_ROWS", 0)
    real, grown = forest.grow, []
    monkeypatch.setattr(forest, "grow", lambda *a: grown.append(real(*a)) or grown[-1])
    ours = rf()
    assert grown[0] is not None and ours.estimator.getNumTrees == 30 and ours.estimator.numClasses == 3
    right = [m.predict(df).where("y = prediction").count() / 3000 for m in (mllib, ours)]
    assert right[1] > 0.97 and abs(right[0] - right[1]) < 0.02
    a, b = (dict(m.feature_importances()) for m in (mllib, ours))
    assert sum(b.values()) == pytest.approx(1.0) and all(abs(a[c] - b[c]) < 0.1 for c in cols)
    nodes = [m.estimator.totalNumNodes for m in (mllib, ours)]
    assert 0.8 < nodes[1] / nodes[0] < 1.25
    # the draws do not depend on the partitions (quantiles of a column of many values do)
    few = lambda d: {r.id: r.probability for r in classify.train_random_forest(d, ["a.q", "noise"], "y", n_estimators=3).predict(d).collect()}
    assert few(df) == few(df.repartition(5))
    weighted = classify.train_random_forest(df, cols, "y", n_estimators=5, class_weight="balanced", min_samples_leaf=20)
    assert grown[-1] is not None and min(r for t in weighted.estimator.trees for r in _leaf_rows(t)) >= 20


def _leaf_rows(tree):
    nodes = [tree._java_obj.rootNode()]
    while nodes:
        n = nodes.pop()
        if n.getClass().getSimpleName() == "LeafNode":
            yield n.impurityStats().rawCount()
        else:
            nodes += [n.leftChild(), n.rightChild()]


def test_forest_beyond_the_cells_is_mllibs(spark, monkeypatch):
    df = _hyperbola(spark, 400)
    fit = lambda d: classify.train_random_forest(d, ["a.q", "p"], "y", n_estimators=3)
    want = [r.probability for r in fit(df).predict(df).orderBy("id").collect()]
    monkeypatch.setattr(forest, "GROUPED_ROWS", 0)
    monkeypatch.setattr(forest, "CELL_BYTES", 100)
    assert [r.probability for r in fit(df).predict(df).orderBy("id").collect()] == want
    with pytest.raises(Exception):  # as MLlib
        fit(df.withColumn("p", F.expr("CASE WHEN id > 5 THEN p END")))


def test_one_tree_of_all_features_is_mllibs(spark):
    """Without draws the rules leave no choice, but between splits of equal gain, by rounding."""
    import numpy as np

    rng = np.random.default_rng(5)
    x = rng.integers(0, 12, (600, 3))
    y = ((x[:, 0] * x[:, 1] > 30) ^ (rng.random(600) < 0.1)).astype("i4")
    df = spark.createDataFrame([(*map(float, r), int(c)) for r, c in zip(x, y)], "a double, b double, c double, y int")
    for depth, least in ((30, 1), (6, 1), (30, 8)):
        dt = classify.train_decision_tree(df, ["a", "b", "c"], "y", max_depth=depth, min_samples_leaf=least)
        once = type("Once", (), {"poisson": lambda self, n: n, "random": lambda self, shape: np.random.default_rng(1).random(shape)})()
        nodes = forest.tree(np.ascontiguousarray(x.T), y, np.ones(600, "i8"), np.ones(2), [12, 12, 12], once, 3, depth, least, 0.0)
        assert dt.estimator.numNodes == pytest.approx(len(nodes["left"]), rel=0.03)
        importance = np.bincount(np.maximum(nodes["feature"], 0), weights=np.where(nodes["left"] >= 0, nodes["gain"] * nodes["stats"].sum(1), 0), minlength=3)
        assert np.allclose(importance / importance.sum(), [v for _, v in dt.feature_importances()], atol=0.01)


def test_forest_scores_in_a_task_a_core(spark, tmpdir_path):
    from tessera.plans import catalog

    sf = _lines(spark, tmpdir_path, 400)
    assert spark.read.parquet(f"{sf}/lineitem.parquet").rdd.getNumPartitions() == 1
    cores = spark.sparkContext.defaultParallelism
    for q in (catalog.q_random_forest, catalog.q_predict_proba, catalog.q_score_batch):
        assert q(spark, sf).rdd.getNumPartitions() == cores
