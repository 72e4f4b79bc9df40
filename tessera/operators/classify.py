"""Classifiers: seeded baselines, decision tree and random forest.

Labels are indexed by their sorted class values (not by frequency), so
probability column i always belongs to ``classes[i]``.  Models are MLlib
``PipelineModel``s -- assembler, estimator, and a SQL step that decodes the
prediction back to the class value -- so they persist and reload with the
standard writer.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, RandomForestClassifier
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.hashing import row_key, uniform01
from tessera.functions.types import qcol, spread
from tessera.operators import forest
from tessera.operators.prep import NULL_LABEL, FittedEncoder, FittedScaler

STRATEGIES = ("most_frequent", "stratified", "uniform")
MAX_DEPTH_CAP = 30  # MLlib's limit; the reference's "no limit" maps here
# deep trees: let each pass over the data grow more nodes.  Node ids are not
# cached: that keeps, and checkpoints, rows x trees numbers, 400 bytes a row for
# 100 trees and several times over; a row's node is found by walking the tree
DEEP_TREE_PARAMS = {"cacheNodeIds": False, "maxMemoryInMB": 1024, "maxBins": 128}


def _sql_literal(v) -> str:
    if isinstance(v, str):
        return "'" + v.replace("'", "''") + "'"
    return repr(v)


def _lookup(values: Sequence, idx: Column) -> Column:
    """values[idx] for a 0-based integer index column."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), idx.cast("int") + 1)


def _of_class(label: Column, values: dict) -> Column:
    """The number of each label's class, null for others: one literal map, however many classes."""
    if not values:
        return F.lit(None).cast("double")
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), label)


def class_counts(df: DataFrame, label_col: str) -> dict:
    """{class: rows}; a label with more than MAX_CLASSES values is refused."""
    from tessera.operators.evaluate import MAX_CLASSES

    rows = (df.where(qcol(label_col).isNotNull()).groupBy(qcol(label_col).alias("c")).count()
            .limit(MAX_CLASSES + 1).collect())
    if len(rows) > MAX_CLASSES:
        raise ValueError(f"{label_col!r} has more than {MAX_CLASSES} classes")
    return {r["c"]: r["count"] for r in rows}


def balanced_weight(df: DataFrame, label_col: str, counts: dict | None = None) -> Column:
    """n / (k * n_c) as a column (class counts are few, so a literal map)."""
    counts = counts if counts is not None else class_counts(df, label_col)
    n, k = sum(counts.values()), len(counts)
    return _of_class(qcol(label_col), {c: n / (k * nc) for c, nc in counts.items()})


def class_weights(df: DataFrame, label_col: str) -> DataFrame:
    return df.withColumn("weight", balanced_weight(df, label_col))


# ---------------------------------------------------------------------------
# M1 baselines
# ---------------------------------------------------------------------------

@dataclass
class BaselineModel:
    strategy: str
    classes: list
    counts: dict
    seed: int
    dtype: object = None

    def transform(self, df: DataFrame, key_cols: Sequence[str]) -> DataFrame:
        """Add ``prediction`` and ``probability`` (array over classes)."""
        k = len(self.classes)
        n = sum(self.counts.values())
        if self.strategy == "most_frequent":
            top = sorted(self.counts.items(), key=lambda kv: (-kv[1], kv[0]))[0][0]
            pred = F.lit(top)
            prob = F.array(*[F.lit(1.0 if c == top else 0.0) for c in self.classes])
        else:
            u = uniform01(row_key(*key_cols), self.seed)
            if self.strategy == "uniform":
                idx = F.floor(u * F.lit(float(k)))
                pred = _lookup(self.classes, idx)
                prob = F.array(*[F.lit(1.0 / k) for _ in self.classes])
            else:
                running = 0
                cum = []
                for c in self.classes:
                    running += self.counts[c]
                    cum.append(running / n)
                # The class of the first share above the draw.
                pred = _lookup(self.classes, F.size(F.filter(F.array(*[F.lit(e) for e in cum[:-1]]).cast("array<double>"), lambda e: e <= u)))
                prob = F.transform(F.array(*[F.lit(c) for c in self.classes]), lambda c: (c == F.col("prediction")).cast("double"))
        if self.dtype is not None:
            pred = pred.cast(self.dtype)
        return df.withColumn("prediction", pred).withColumn("probability", prob)


def train_baseline(df: DataFrame, label_col: str, strategy: str = "most_frequent", seed: int = 42) -> BaselineModel:
    if strategy not in STRATEGIES:
        raise ValueError(f"unsupported strategy {strategy!r}")
    counts = class_counts(df, label_col)
    return BaselineModel(strategy, sorted(counts), counts, seed, df.schema[label_col].dataType)


# ---------------------------------------------------------------------------
# M2-M3 trees
# ---------------------------------------------------------------------------

@dataclass
class TrainedClassifier:
    model: PipelineModel
    classes: list
    features: list[str]
    label_col: str
    #: Columns of the rows it scores, where a preparation is part of the pipeline.
    raw_features: list[str] | None = None

    def predict(self, df: DataFrame) -> DataFrame:
        """Add ``prediction`` (class value) and ``probability`` (array in
        class order)."""
        out = self.model.transform(df)
        out = out.withColumn("probability", vector_to_array("__prob_vec"))
        return out.drop("features", "rawPrediction", "__pred_idx", "__prob_vec", *[f"__f{i}" for i in range(len(self.features))])

    @property
    def estimator(self):
        return next(s for s in self.model.stages if hasattr(s, "featureImportances"))

    def feature_importances(self) -> list[tuple[str, float]]:
        imp = self.estimator.featureImportances.toArray().tolist()
        return list(zip(self.features, imp))

    def save(self, path: str) -> None:
        self.model.write().overwrite().save(path)


def _index_label(df: DataFrame, label_col: str, classes: Sequence) -> Column:
    return _of_class(qcol(label_col), {c: float(i) for i, c in enumerate(classes)})


def _decoder(classes: Sequence) -> SQLTransformer:
    arr = ", ".join(_sql_literal(c) for c in classes)
    return SQLTransformer(statement=(
        f"SELECT *, element_at(array({arr}), CAST(__pred_idx AS INT) + 1) AS prediction FROM __THIS__"))


def _fit(df: DataFrame, feature_cols: Sequence[str], label_col: str, estimator, class_weight: str | None,
         ) -> TrainedClassifier:
    counts = class_counts(df, label_col)
    classes = sorted(counts)
    train = df.where(qcol(label_col).isNotNull()).withColumn("__label", _index_label(df, label_col, classes))
    # only what the fit reads is dealt out
    train = train.select(*[qcol(c) for c in dict.fromkeys([*feature_cols, label_col])], "__label")
    # every tree level is a pass over the training rows: enough tasks, of bounded rows each
    train = spread(train, sum(counts.values()))
    unweighted = train
    if class_weight == "balanced":
        train = train.withColumn("__weight", balanced_weight(train, label_col, counts))
        estimator.setWeightCol("__weight")
    elif class_weight is not None:
        raise ValueError("class_weight must be None or 'balanced'")
    # the assembler resolves its names, and splits them at dots
    plain = [f"__f{i}" for i in range(len(feature_cols))]
    named = SQLTransformer(statement=f"SELECT *, {', '.join(f'{_name(c)} AS {p}' for c, p in zip(feature_cols, plain))} FROM __THIS__")
    assembler = VectorAssembler(inputCols=plain, outputCol="features", handleInvalid="keep")
    estimator.setFeaturesCol("features").setLabelCol("__label") \
        .setPredictionCol("__pred_idx").setProbabilityCol("__prob_vec")
    stages = [named, assembler, estimator, _decoder(classes)]
    grown = None
    if isinstance(estimator, RandomForestClassifier) and sum(counts.values()) > forest.GROUPED_ROWS:
        n, k = sum(counts.values()), len(counts)
        weights = [n / (k * counts[c]) if class_weight else 1.0 for c in classes]
        grown = forest.grow(unweighted, feature_cols, "__label", weights, estimator)
    model = Pipeline(stages=stages).fit(train) if grown is None else PipelineModel([named, assembler, grown, _decoder(classes)])
    return TrainedClassifier(model, classes, list(feature_cols), label_col)


def _min_instances(min_samples_split: int, min_samples_leaf: int) -> int:
    # MLlib has no min_samples_split; a leaf minimum of ceil(s/2) is the
    # closest (stricter) bound
    return max(int(min_samples_leaf), int(math.ceil(min_samples_split / 2)))


def train_decision_tree(df: DataFrame, feature_cols: Sequence[str], label_col: str, max_depth: int | None = 5,
                        min_samples_split: int = 2, min_samples_leaf: int = 1, class_weight: str | None = None,
                        seed: int = 42, **params) -> TrainedClassifier:
    est = DecisionTreeClassifier(maxDepth=MAX_DEPTH_CAP if max_depth is None else min(max_depth, MAX_DEPTH_CAP),
                                 minInstancesPerNode=_min_instances(min_samples_split, min_samples_leaf),
                                 seed=seed, **{**DEEP_TREE_PARAMS, **params})
    return _fit(df, feature_cols, label_col, est, class_weight)


def train_random_forest(df: DataFrame, feature_cols: Sequence[str], label_col: str, n_estimators: int = 100,
                        max_depth: int | None = None, min_samples_split: int = 2, min_samples_leaf: int = 1,
                        max_features: str = "sqrt", class_weight: str | None = None, seed: int = 42,
                        **params) -> TrainedClassifier:
    est = RandomForestClassifier(numTrees=n_estimators,
                                 maxDepth=MAX_DEPTH_CAP if max_depth is None else min(max_depth, MAX_DEPTH_CAP),
                                 minInstancesPerNode=_min_instances(min_samples_split, min_samples_leaf),
                                 featureSubsetStrategy=max_features, seed=seed, **{**DEEP_TREE_PARAMS, **params})
    return _fit(df, feature_cols, label_col, est, class_weight)


def load_classifier(path: str, classes: Sequence, features: Sequence[str], label_col: str,
                    raw_features: Sequence[str] | None = None) -> TrainedClassifier:
    return TrainedClassifier(PipelineModel.load(path), list(classes), list(features), label_col,
                             None if raw_features is None else list(raw_features))


# ---------------------------------------------------------------------------
# M6 / S9 preparation as a part of the saved model
# ---------------------------------------------------------------------------

def _name(column: str) -> str:
    return "`" + column.replace("`", "``") + "`"


def preparation(encoder: FittedEncoder | None = None, scaler: FittedScaler | None = None) -> list[SQLTransformer]:
    """Fitted encoder and scaler as pipeline stages: one projection each, their
    levels, codes, centres and scales written into it, so that they are saved and
    loaded with the model.  They give what ``transform`` of each gives, in
    another order of columns.  Levels are part of a model and so pass the driver."""
    stages = []
    if encoder is not None:
        done = []
        for c, table in encoder.label.items():
            codes = ", ".join(f"{_sql_literal(r['value'])}, {r['code']}L" for r in table.collect())
            known = f"try_element_at(map({codes}), coalesce(CAST({_name(c)} AS STRING), {_sql_literal(NULL_LABEL)}))" if codes else "NULL"
            done.append(f"coalesce({known}, -1L) AS {_name(c)}")
        for c, levels in encoder.onehot.items():
            done += [f"CAST({_name(c)} <=> {_sql_literal(lv)} AS BIGINT) AS {_name(f'{c}_{lv}')}" for lv in levels]
        gone = [*encoder.label, *encoder.onehot]
        if gone:
            stages.append(SQLTransformer(statement=_projection(gone, done)))
    if scaler is not None and scaler.params:
        done = [f"(CAST({_name(c)} AS DOUBLE) - {float(m)!r}D) / {float(s)!r}D AS {_name(c)}" for c, (m, s) in scaler.params.items()]
        stages.append(SQLTransformer(statement=_projection(list(scaler.params), done)))
    return stages


def _projection(gone: Sequence[str], done: Sequence[str]) -> str:
    return f"SELECT {', '.join([f'* EXCEPT ({chr(44).join(map(_name, gone))})', *done])} FROM __THIS__"


def with_preparation(model: TrainedClassifier, encoder: FittedEncoder | None = None, scaler: FittedScaler | None = None,
                     raw_features: Sequence[str] | None = None) -> TrainedClassifier:
    """The model for raw rows: encoding and scaling are the pipeline's first stages."""
    stages = [*preparation(encoder, scaler), *model.model.stages]
    return TrainedClassifier(PipelineModel(stages), model.classes, model.features, model.label_col,
                             list(raw_features) if raw_features is not None else None)


# ---------------------------------------------------------------------------
# tree structure (chart data)
# ---------------------------------------------------------------------------

def tree_nodes(spark, tree_path: str, feature_names: Sequence[str], max_depth: int = 3) -> DataFrame:
    """Nodes of a saved decision tree (``TrainedClassifier.estimator``
    saved on its own) down to ``max_depth``: (depth, id, feature,
    threshold, gain, impurity, prediction, left, right), read from the
    model's node table and walked level by level with joins."""
    nodes = spark.read.parquet(tree_path.rstrip("/") + "/data")
    names = F.array(*[F.lit(n) for n in feature_names])
    n = nodes.select(
        "id", "prediction", "impurity", "gain", "leftChild", "rightChild",
        F.when(F.col("leftChild") >= 0, F.element_at(names, F.col("split.featureIndex") + 1)).alias("feature"),
        F.when(F.col("leftChild") >= 0, F.element_at(F.col("split.leftCategoriesOrThreshold"), 1)).alias("threshold"))
    level = n.where(F.col("id") == 0).withColumn("depth", F.lit(0))
    out = level
    for d in range(1, max_depth + 1):
        kids = level.select(F.explode(F.array("leftChild", "rightChild")).alias("id")).where(F.col("id") >= 0)
        level = n.join(kids, "id").withColumn("depth", F.lit(d))
        out = out.unionByName(level)
    return out.select("depth", "id", "feature", "threshold", "gain", "impurity", "prediction",
                      F.col("leftChild").alias("left"), F.col("rightChild").alias("right"))


def probability_frame(pred: DataFrame, classes: Sequence) -> DataFrame:
    """Probability array spread to one column per class (p_<class>)."""
    return pred.select("*", *[F.col("probability")[i].alias(f"p_{c}") for i, c in enumerate(classes)])



# ---------------------------------------------------------------------------
# model-level conveniences (the reference's evaluate / ROC / single-record
# entry points, expressed over DataFrames)
# ---------------------------------------------------------------------------

def evaluate_model(model: TrainedClassifier, df: DataFrame, average: str = "weighted") -> DataFrame:
    """One row: accuracy, f1, precision, recall and AUC (binary: positive =
    larger class; multi-class: one-vs-rest weighted by prevalence; null for
    a single class) of ``model`` on the labelled rows of ``df``."""
    from tessera.operators import evaluate

    pred = probability_frame(model.predict(df), model.classes).persist()
    m = evaluate.classification_metrics(pred, model.label_col, "prediction", average)
    present = evaluate.class_values(pred, model.label_col)
    if len(present) == 2:
        a = evaluate.auc_binary(pred, model.label_col, f"p_{present[-1]}", pos_label=present[-1])
    else:
        a = evaluate.auc_ovr(pred, model.label_col, [f"p_{c}" for c in model.classes], model.classes)
    auc = a.first()["auc"]
    return m.withColumn("auc", F.lit(auc).cast("double"))


def roc_for_model(model: TrainedClassifier, df: DataFrame) -> DataFrame:
    """ROC points of a binary model (empty unless the labels have two classes)."""
    from tessera.operators import evaluate

    pred = probability_frame(model.predict(df), model.classes)
    present = evaluate.class_values(pred, model.label_col)
    if len(present) != 2:
        return df.sparkSession.createDataFrame([], "threshold double, fpr double, tpr double, auc double")
    return evaluate.roc_curve(pred, model.label_col, f"p_{present[-1]}", pos_label=present[-1])


def score_records(spark, model: TrainedClassifier, records: Sequence[dict], scaler=None) -> DataFrame:
    """Score a handful of records given as dicts (column -> value): one small
    DataFrame, then the model's prediction and probabilities.  A model with
    its preparation takes raw values, any other the numbers of its features,
    optionally scaled with a fitted scaler.  A record without one of
    the columns is an error."""
    names = model.raw_features or model.features
    for r in records:
        if missing := [f for f in names if f not in r]:
            raise KeyError(f"record without {', '.join(map(repr, missing))}")

    def kind(f: str) -> str:
        values = [r[f] for r in records if r[f] is not None]
        return "string" if any(isinstance(v, str) for v in values) else "double"

    kinds = {f: kind(f) for f in names}
    rows = [tuple(None if r[f] is None else float(r[f]) if kinds[f] == "double" else str(r[f]) for f in names) for r in records]
    df = spark.createDataFrame(rows, ", ".join(f"{_name(f)} {k}" for f, k in kinds.items()))
    if scaler is not None:
        df = scaler.transform(df)
    return model.predict(df)
