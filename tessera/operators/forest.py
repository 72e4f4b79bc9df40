"""Random forest of large inputs: rows are counted by bins, a tree is a task.

MLlib's forest cuts each feature into at most ``maxBins`` bins and from then on
knows a row by its bins and its class alone, yet walks every row through every
tree at every level.  Here rows of the same bins and class become one cell with
its number of rows n.  A bootstrap draws each row a Poisson(1) number of times,
so a cell Poisson(n) times, the sum of n such draws: the forest is of the same
distribution, each of its trees from all rows.  A task grows one tree, level by
level with MLlib's rules: Gini gain over the bins of the drawn features, no
split below ``minInstancesPerNode`` rows a side or ``minInfoGain``, siblings of one
prediction merged.  The nodes are written in MLlib's format and loaded as its model.

Cells are at most the rows, and every task holds them all: ``grow`` gives None where
they take more than ``CELL_BYTES`` or the estimator asks for what is not here, and
MLlib fits the forest.  Draws are not those of MLlib, which depend on the partitions."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.types import qcol
from tessera.session import shared_dir

#: Training rows from which a forest is grown here; MLlib fits smaller ones.
GROUPED_ROWS = 100_000
#: Of all cells, in the driver and in each task.
CELL_BYTES = 64 << 20
HISTOGRAM = 4_000_000  # numbers of a histogram held at once
CHUNK_ROWS = 1 << 20  # binned together
EPSILON = 2.0 ** -52
NODE = ("treeID int, nodeData struct<id: int, prediction: double, impurity: double, impurityStats: array<double>, rawCount: bigint, gain: double, "
        "leftChild: int, rightChild: int, split: struct<featureIndex: int, leftCategoriesOrThreshold: array<double>, numCategories: int>>")


def features_per_node(strategy: str, n: int) -> int | None:
    """MLlib's number of features drawn at a node, None for strategies not known here."""
    return {"all": n, "auto": math.ceil(math.sqrt(n)), "sqrt": math.ceil(math.sqrt(n)),
            "onethird": math.ceil(n / 3), "log2": max(1, math.ceil(math.log2(n)))}.get(strategy)


def thresholds(df: DataFrame, cols: Sequence[str], bins: int) -> list[np.ndarray]:
    """Ascending cuts of each column into at most ``bins`` bins, x <= cut on the left: between
    all neighbours of at most ``bins`` values, else at quantiles of all rows, to a sixteenth of a bin."""
    found, many = {}, []
    for c in cols:
        values = np.array(sorted(r.v for r in df.select(qcol(c).alias("v")).distinct().limit(bins + 1).collect()))
        if len(values) > bins:
            many.append(c)
        else:
            found[c] = values[:-1] + (values[1:] - values[:-1]) / 2
    if many:
        plain = df.select(*[qcol(c).alias(f"_{i}") for i, c in enumerate(many)])
        points = plain.approxQuantile(plain.columns, [k / bins for k in range(1, bins)], 1 / (16 * bins))
        tops = plain.agg(*[F.max(c) for c in plain.columns]).first()
        found |= {c: np.array(sorted({q for q in p if q < top})) for c, p, top in zip(many, points, tops)}
    return [found[c] for c in cols]


def _binner(cuts: Sequence[np.ndarray]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(key, label, n): rows by the bins of their features, two bytes each, and class."""

    def counted(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(batches)
        label = rows.column(len(cuts)).to_numpy().astype("i8")
        code, size, keys = label, int(label.max()) + 1, np.empty((len(label), len(cuts)), "<u2")
        for f, cut in enumerate(cuts):
            keys[:, f] = np.searchsorted(cut, rows.column(f).to_numpy())
            if size * (len(cut) + 1) >= 1 << 62:  # numbered anew before they overflow
                values, code = np.unique(code, return_inverse=True)
                size = len(values)
            code, size = code * (len(cut) + 1) + keys[:, f], size * (len(cut) + 1)
        _, at, n = np.unique(code, return_index=True, return_counts=True)
        key = pa.FixedSizeBinaryArray.from_buffers(pa.binary(2 * len(cuts)), len(at), [None, pa.py_buffer(keys[at].tobytes())])
        return pa.RecordBatch.from_arrays([key.cast(pa.binary()), pa.array(label[at]), pa.array(n)], names=["key", "label", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.num_rows
            if size >= CHUNK_ROWS:
                yield counted(held)
                held, size = [], 0
        if held:
            yield counted(held)

    return run


def _gini(stats: np.ndarray) -> np.ndarray:
    total = stats.sum(-1)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(total > 0, 1 - (stats * stats).sum(-1) / (total * total), 0.0)


def _best_splits(x: np.ndarray, y: np.ndarray, w: np.ndarray, c: np.ndarray, node: np.ndarray, stats: np.ndarray, drawn: np.ndarray,
                 bins: Sequence[int], least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(gain, feature, bin) of the best split of each node; rows stand in the order of their nodes."""
    n, k = stats.shape
    best, feature, cut = np.full(n, -np.inf), np.zeros(n, "i4"), np.zeros(n, "i4")
    parent, weight = _gini(stats), stats.sum(1)
    for f, b in enumerate(bins):
        if b < 2:
            continue
        step = max(1, HISTOGRAM // (b * k))
        for lo in range(0, n, step):
            hi = min(n, lo + step)
            rows = slice(*np.searchsorted(node, (lo, hi)))
            with_f = drawn[lo:hi, f]
            if not with_f.any():
                continue
            place = np.cumsum(with_f) - 1
            at = node[rows] - lo
            of = with_f[at]
            at = place[at[of]] * b + x[f, rows][of]
            shape = (int(with_f.sum()), b, k)
            left = np.bincount(at * k + y[rows][of], weights=w[rows][of], minlength=math.prod(shape)).reshape(shape).cumsum(1)[:, :-1]
            count = np.bincount(at, weights=c[rows][of], minlength=shape[0] * b).reshape(shape[:2]).cumsum(1)
            whole = weight[lo:hi][with_f][:, None]
            right = stats[lo:hi][with_f][:, None] - left
            gain = parent[lo:hi][with_f][:, None] - left.sum(-1) / whole * _gini(left) - right.sum(-1) / whole * _gini(right)
            gain[(count[:, :-1] < least) | (count[:, -1:] - count[:, :-1] < least)] = -np.inf
            s = gain.argmax(1)
            g, ids = gain[np.arange(len(s)), s], lo + np.flatnonzero(with_f)
            better = g > best[ids]
            best[ids[better]], feature[ids[better]], cut[ids[better]] = g[better], f, s[better]
    return best, feature, cut


def tree(x: np.ndarray, y: np.ndarray, n: np.ndarray, weights: np.ndarray, bins: Sequence[int], rng: np.random.Generator, per_node: int,
         depth: int, least: int, min_gain: float) -> dict[str, np.ndarray]:
    """Nodes of one tree, parents before children: stats (weight by class), count, gain, feature, cut, left, right (-1: leaf)."""
    k = len(weights)
    c = rng.poisson(n)
    held = c > 0
    x, y, c = x[:, held], y[held], c[held]
    w, node = c * weights[y], np.zeros(len(c), "i8")
    stats, count = np.bincount(y, weights=w, minlength=k)[None], np.array([c.sum()])
    levels, born = [], 1
    for level in range(depth + 1):
        size = len(stats)
        here = {"stats": stats, "count": count, "gain": np.full(size, -1.0), "feature": np.full(size, -1, "i4"), "cut": np.zeros(size, "i4"),
                "left": np.full(size, -1, "i8"), "right": np.full(size, -1, "i8")}
        levels.append(here)
        open_ = np.flatnonzero(_gini(stats) >= EPSILON) if level < depth else np.array([], "i8")
        if not len(open_):
            break
        # rows of closed nodes go, the others stand by node
        place = np.full(size, -1)
        place[open_] = np.arange(len(open_))
        node = place[node]
        order = np.argsort(node, kind="stable")
        order = order[np.searchsorted(node[order], 0):]
        x, y, w, c, node = x[:, order], y[order], w[order], c[order], node[order]
        drawn = np.zeros((len(open_), len(bins)), bool)
        np.put_along_axis(drawn, rng.random(drawn.shape).argsort(1)[:, :per_node], True, 1)
        gain, feature, cut = _best_splits(x, y, w, c, node, stats[open_], drawn, bins, least)
        split = (gain > 0) & (gain >= min_gain)
        if not split.any():
            break
        parents = open_[split]
        here["gain"][parents], here["feature"][parents], here["cut"][parents] = gain[split], feature[split], cut[split]
        here["left"][parents] = born + 2 * np.arange(len(parents))
        here["right"][parents] = here["left"][parents] + 1
        born += 2 * len(parents)
        held = split[node]
        x, y, w, c, node = x[:, held], y[held], w[held], c[held], node[held]
        side = x[feature[node], np.arange(len(node))] > cut[node]
        node = 2 * (np.cumsum(split) - 1)[node] + side
        size = 2 * len(parents)
        stats = np.bincount(node * k + y, weights=w, minlength=size * k).reshape(size, k)
        count = np.bincount(node, weights=c, minlength=size).astype("i8")
    return _pruned({name: np.concatenate([lv[name] for lv in levels]) for name in levels[0]})


def _pruned(nodes: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """As MLlib: a split whose children are leaves of one prediction is a leaf."""
    says, left, right = nodes["stats"].argmax(1), nodes["left"], nodes["right"]
    alive = np.ones(len(says), bool)
    while True:
        at = np.flatnonzero(left >= 0)
        a, b = left[at], right[at]
        same = (left[a] < 0) & (left[b] < 0) & (says[a] == says[b])
        if not same.any():
            break
        alive[a[same]] = alive[b[same]] = False
        left[at[same]] = right[at[same]] = -1
    new = np.cumsum(alive) - 1
    out = {name: v[alive] for name, v in nodes.items()}
    leaf = out["left"] < 0
    for side in ("left", "right"):
        out[side] = np.where(leaf, -1, new[np.maximum(out[side], 0)])
    out["gain"][leaf], out["feature"][leaf] = -1.0, -1
    return out


def _grower(table: Broadcast, cuts: Sequence[np.ndarray], seed: int, **rules) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The nodes of each tree, by its number."""
    bins = [len(c) + 1 for c in cuts]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.column(0).to_pylist():
                nodes = tree(*table.value, bins, np.random.default_rng([seed & (1 << 63) - 1, t]), **rules)
                size, leaf = len(nodes["left"]), nodes["left"] < 0
                at = [[] if f < 0 else [float(cuts[f][s])] for f, s in zip(nodes["feature"], nodes["cut"])]
                split = pa.StructArray.from_arrays([pa.array(nodes["feature"].astype("i4")), pa.array(at, pa.list_(pa.float64())), pa.array(np.full(size, -1, "i4"))],
                                                   ["featureIndex", "leftCategoriesOrThreshold", "numCategories"])
                data = [pa.array(np.arange(size, dtype="i4")), pa.array(nodes["stats"].argmax(1).astype("f8")), pa.array(_gini(nodes["stats"])),
                        pa.array(list(nodes["stats"]), pa.list_(pa.float64())), pa.array(nodes["count"].astype("i8")), pa.array(np.where(leaf, -1.0, nodes["gain"])),
                        pa.array(nodes["left"].astype("i4")), pa.array(nodes["right"].astype("i4")), split]
                names = ["id", "prediction", "impurity", "impurityStats", "rawCount", "gain", "leftChild", "rightChild", "split"]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(size, t, "i4")), pa.StructArray.from_arrays(data, names)], names=["treeID", "nodeData"])

    return run


def grow(df: DataFrame, cols: Sequence[str], label: str, class_weights: Sequence[float], est: RandomForestClassifier) -> RandomForestClassificationModel | None:
    """The forest of ``est`` on rows of numbers ``cols`` and class numbers ``label``."""
    per_node = features_per_node(est.getFeatureSubsetStrategy(), len(cols))
    plain = est.getImpurity() == "gini" and est.getSubsamplingRate() == 1 and est.getBootstrap() and est.getMinWeightFractionPerNode() == 0
    if not plain or per_node is None or est.getNumTrees() < 2 or len(class_weights) < 2 or est.getMaxBins() > 1 << 16:
        return None
    spark, names = df.sparkSession, [f"f{i}" for i in range(len(cols))]
    rows = df.select(*[qcol(c).cast("double").alias(f) for c, f in zip(cols, names)], qcol(label).cast("int").alias("label")).persist()
    cells = None
    try:
        finite = " AND ".join(f"{f} IS NOT NULL AND NOT isnan({f}) AND abs({f}) < double('infinity')" for f in names)
        if rows.where(f"NOT ({finite})").limit(1).count():
            return None  # refused by MLlib
        cuts = thresholds(rows, names, est.getMaxBins())
        cells = rows.mapInArrow(_binner(cuts), "key binary, label long, n long").groupBy("key", "label").agg(F.sum("n").alias("n")).persist()
        if cells.count() * (2 * len(cols) + 16) > CELL_BYTES:
            return None
        got = cells.toArrow()
    finally:
        rows.unpersist()
        if cells is not None:
            cells.unpersist()
    y, n = got["label"].to_numpy(), got["n"].to_numpy()
    x = np.frombuffer(b"".join(got["key"].to_pylist()), "<u2").reshape(len(y), len(cols)).T
    order = np.lexsort([y, *x])  # the draws of a cell do not depend on where it was counted
    table = spark.sparkContext.broadcast((np.ascontiguousarray(x[:, order]), y[order].astype("i4"), n[order], np.array(class_weights, "f8")))
    rules = {"per_node": per_node, "depth": est.getMaxDepth(), "least": est.getMinInstancesPerNode(), "min_gain": est.getMinInfoGain()}
    trees = spark.range(0, est.getNumTrees(), 1, est.getNumTrees()).mapInArrow(_grower(table, cuts, est.getSeed(), **rules), NODE)
    # MLlib writes the model's parameters, from a forest of a row a class; its nodes are replaced
    path = shared_dir(spark, "grown")
    few = spark.createDataFrame([(Vectors.dense([0.0] * len(cols)), float(i), 1.0) for i in range(len(class_weights))], ["features", est.getLabelCol(), "__weight"])
    est.fit(few.coalesce(1)).write().overwrite().save(path)
    trees.write.mode("overwrite").parquet(path + "/data")
    table.destroy()
    return RandomForestClassificationModel.load(path)
