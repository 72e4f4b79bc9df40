import numpy as np
import pytest

from tessera.functions.ranking import dense_codes, running_totals
from tessera.functions.stats import exact_quantiles
from tessera.functions.types import nan_to_null, numeric_cols


def test_exact_quantiles_match_numpy_whole_and_bracketed(spark):
    rng = np.random.default_rng(3)
    xs = np.round(rng.normal(50, 20, 3000), 2).tolist() + [None] * 10
    ys = rng.integers(0, 7, len(xs)).tolist()
    df = spark.createDataFrame([(x, int(y)) for x, y in zip(xs, ys)], "x double, y long")
    vals = np.array([x for x in xs if x is not None])
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0]
    # whole column; sketch brackets; coarse sketch whose brackets need narrowing
    for mb, acc in ((10**6, 10000), (50, 10000), (50, 100)):
        q = exact_quantiles(df, ["x", "y"], probs, max_bracket=mb, accuracy=acc)
        for p in probs:
            assert q[("x", p)] == pytest.approx(np.quantile(vals, p), abs=1e-12)
            assert q[("y", p)] == pytest.approx(np.quantile(np.array(ys, dtype=float), p), abs=1e-12)


def test_exact_quantiles_between_two_frequent_values(spark):
    # the rank falls on the border of two values that each fill more than a bracket
    df = spark.range(8000).selectExpr("IF(id < 2000, 1, IF(id < 4000, 2, id % 7 + 3)) AS x", "IF(id < 4000, 0.5D, 7.5D) AS y", "IF(id % 2 = 0, 'a', NULL) AS g")
    for mb, acc in ((50, 10000), (500, 100)):
        q = exact_quantiles(df, ["x", "y"], [0.25, 0.5, 0.75], max_bracket=mb, accuracy=acc)
        for c in ("x", "y"):
            vals = np.array([float(r[0]) for r in df.select(c).collect()])
            assert [q[(c, p)] for p in (0.25, 0.5, 0.75)] == [np.quantile(vals, p) for p in (0.25, 0.5, 0.75)]
    assert exact_quantiles(df, ["y"], [0.5], ["g"], max_bracket=50) == {("a", "y", 0.5): 4.0, (None, "y", 0.5): 4.0}


def test_exact_quantiles_grouped_and_empty(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 4.0), ("b", 10.0), ("c", None)], "g string, x double")
    q = exact_quantiles(df, ["x"], [0.5], group_cols=["g"])
    assert q[("a", "x", 0.5)] == 2.0 and q[("b", "x", 0.5)] == 10.0
    assert exact_quantiles(df.where("x > 100"), ["x"], [0.5])[("x", 0.5)] is None


def test_running_totals_and_dense_codes(spark):
    df = spark.createDataFrame([(g, i, 1) for g in ("a", "b") for i in range(500)], "g string, o long, v long")
    out = {(r.g, r.o): r.cum_v for r in running_totals(df, "o", ["v"], ["g"], num_partitions=7).collect()}
    assert out[("a", 0)] == 1 and out[("a", 499)] == 500 and out[("b", 250)] == 251
    codes = {r.value: r.code for r in dense_codes(spark.createDataFrame([("b",), ("a",), ("c",), ("a",)], "s string"), "s").collect()}
    assert codes == {"a": 0, "b": 1, "c": 2}


def test_nan_to_null_and_numeric_rule(spark):
    df = spark.createDataFrame([(float("nan"), True, 1)], "x double, b boolean, i int")
    assert nan_to_null(df).first().x is None
    assert numeric_cols(df) == ["x", "i"]
