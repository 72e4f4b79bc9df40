import pytest

from tessera.operators import clean


def test_impute_stats_include_dropped_rows(spark):
    df = spark.createDataFrame([(1, 1.0, 1.0), (2, 2.0, 2.0), (3, None, 3.0), (4, 100.0, None)], "id long, x double, y double")
    out = {r.id: r for r in clean.handle_missing(df, {"x": "mean", "y": "drop", "zz": "mean"}).collect()}
    assert set(out) == {1, 2, 3}
    assert out[3].x == pytest.approx(103.0 / 3)  # mean over all rows, including the dropped one


def test_impute_mode_tie_smallest_and_empty(spark):
    df = spark.createDataFrame([(1, "b", None), (2, "a", None), (3, "b", None), (4, "a", None), (5, None, None)],
                               "id long, c string, n int")
    out = {r.id: r for r in clean.handle_missing(df, {"c": "mode", "n": "mode"}).collect()}
    assert out[5].c == "a" and out[5].n is None


def test_impute_constant_type_mismatch(spark):
    df = spark.createDataFrame([(1, None)], "id long, x double")
    with pytest.raises(TypeError):
        clean.handle_missing(df, {"x": "text"})


def _outliers(spark):
    vals = [1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0]
    rows = [(i, v, 5.0, "s") for i, v in enumerate(vals)]
    rows += [(100, 15.5, 5.0, "s"), (101, 16.0, 5.0, "s"), (102, None, 5.0, "s")]
    return spark.createDataFrame(rows, "id long, x double, k double, s string")


def test_iqr_fence_is_strict_and_null_never_flagged(spark):
    df = _outliers(spark)
    q1, q3 = 2.75, 7.25  # numpy linear quantiles of the 10 non-null values
    vals = sorted([1, 2, 3, 4, 5, 6, 7, 8, 15.5, 16.0])
    import numpy as np
    q1, q3 = np.quantile(vals, 0.25), np.quantile(vals, 0.75)
    hi = q3 + 1.5 * (q3 - q1)
    flagged = {r.id for r in clean.detect_outliers(df, "iqr").collect()}
    assert flagged == {i for i, v in zip([*range(8), 100, 101], [*range(1, 9), 15.5, 16.0]) if v > hi}
    assert 102 not in flagged


def test_zscore_constant_column_and_threshold(spark):
    df = _outliers(spark)
    assert clean.detect_outliers(df, "zscore", columns=["k"]).count() == 0
    assert clean.detect_outliers(df, "zscore", columns=["x"], threshold=1.5).count() == 2


def test_cap_keeps_nulls_and_validates(spark):
    df = _outliers(spark)
    capped = {r.id: r.x for r in clean.handle_outliers(df, "iqr", "cap", ["x"]).collect()}
    assert capped[102] is None and max(v for v in capped.values() if v is not None) < 16.0
    with pytest.raises(ValueError):
        clean.handle_outliers(df, "iqr", "shrink")
    with pytest.raises(ValueError):
        clean.detect_outliers(df, "mad")


def test_outlier_summary_counts_all_numeric(spark):
    rows = {r.column: (r.n_outliers, r.pct_outliers) for r in clean.outlier_summary(_outliers(spark)).collect()}
    assert set(rows) == {"id", "x", "k"} and rows["k"] == (0, 0.0)


def test_constant_widens_integers(spark):
    df = spark.createDataFrame([(1, 1), (None, 2)], "a int, b int")
    half = clean.handle_missing(df, {"a": 0.5})
    assert sorted(r.a for r in half.collect()) == [0.5, 1.0]
    big = clean.handle_missing(df, {"a": 1 << 40})
    assert sorted(r.a for r in big.collect()) == [1, 1 << 40]
    whole = clean.handle_missing(df, {"a": 7.0})
    assert whole.schema["a"].dataType.simpleString() == "int" and sorted(r.a for r in whole.collect()) == [1, 7]
