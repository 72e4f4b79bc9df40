from pyspark.sql import functions as F

from tessera.operators import profile


def _mixed(spark):
    rows = []
    for i in range(30):
        rows.append((i, 20 + i % 50 if i % 7 else None, float(1000 + i) if i % 5 else (float("nan") if i == 5 else None),
                     ["gold", "silver", "bronze"][i % 3] if i % 11 else None, i % 2 == 0,
                     f"2024-01-{(i % 28) + 1:02d}", f"note number {i}", "yes" if i % 3 else "no"))
    df = spark.createDataFrame(rows, "id long, age int, income double, segment string, active boolean, "
                                     "signup string, note string, target string")
    from tessera.functions.types import nan_to_null
    return nan_to_null(df)


def test_semantic_types(spark):
    t = {r.column: r.semantic_type for r in profile.semantic_types(_mixed(spark)).collect()}
    assert t == {"id": "numeric", "age": "numeric", "income": "numeric", "segment": "categorical",
                 "active": "numeric", "signup": "datetime", "note": "text", "target": "categorical"}


def test_all_null_string_is_datetime(spark):
    df = spark.createDataFrame([(1, None), (2, None)], "id long, s string")
    t = {r.column: r.semantic_type for r in profile.semantic_types(df).collect()}
    assert t["s"] == "datetime"


def test_target_suggestion_null_boundary(spark):
    rows = [(i, None if i < 3 else ["x", "y"][i % 2], None if i < 4 else ["p", "q"][i % 2]) for i in range(10)]
    df = spark.createDataFrame(rows, "id long, a string, b string")
    got = [r.column for r in profile.suggest_target(df).orderBy("rank").collect()]
    assert got == ["a", "id"]  # a is exactly 30 % null (kept), b 40 % (skipped); id: numeric with 10 values


def test_duplicates_with_nulls_and_triples(spark):
    rows = [(1, "a", 1.0), (1, "a", 1.0), (1, "a", 1.0), (2, None, None), (2, None, None), (3, "c", 3.0)]
    df = spark.createDataFrame(rows, "a int, b string, c double")
    r = profile.duplicate_count(df).first()
    assert r.n_duplicates == 3 and r.pct_duplicates == 50.0


def test_describe_categorical_tie_and_pct(spark):
    df = spark.createDataFrame([(1, "b"), (2, "a"), (3, "a"), (4, "b"), (5, None)], "id long, c string")
    r = profile.describe_categorical(df).where(F.col("column") == "c").first()
    assert (r.n_unique, r.top_value, r.top_freq, r.pct_top) == (2, "a", 2, 40.0)


def test_describe_numeric_rounds_half_even(spark):
    df = spark.createDataFrame([(0.125,), (0.125,)], "x double")
    r = profile.describe_numeric(df).first()
    assert r.mean == 0.125 and r.q50 == 0.125 and r.std == 0.0


def test_one_zero(spark):
    df = spark.createDataFrame([(0.0,), (-0.0,), (1.0,)], "x double")
    counts = {r.value: r.n for r in profile.value_frequencies(df).collect()}
    assert sorted(counts.values()) == [1, 2]
