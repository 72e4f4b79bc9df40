"""Property checks against brute force on random inputs."""

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tessera.functions.ranking import running_totals
from tessera.functions.stats import exact_quantiles

SETTINGS = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))


@SETTINGS
@given(st.lists(st.integers(-50, 50), min_size=1, max_size=300), st.sampled_from([10**6, 7]))
def test_quantiles_equal_numpy(spark, values, bracket):
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    probs = [0.0, 0.25, 0.5, 0.9, 1.0]
    q = exact_quantiles(df, ["x"], probs, max_bracket=bracket)
    for p in probs:
        assert q[("x", p)] == pytest.approx(float(np.quantile(np.array(values, dtype=float), p)), abs=1e-12)


@SETTINGS
@given(st.lists(st.tuples(st.sampled_from("abc"), st.integers(0, 5)), min_size=1, max_size=200, unique_by=lambda t: t),
       st.integers(1, 9))
def test_running_totals_equal_cumsum(spark, rows, parts):
    df = spark.createDataFrame([(g, o, o + 1) for g, o in rows], "g string, o long, v long")
    got = {(r.g, r.o): r.cum_v for r in running_totals(df, "o", ["v"], ["g"], num_partitions=parts).collect()}
    for g, o in rows:
        assert got[(g, o)] == sum(oo + 1 for gg, oo in rows if gg == g and oo <= o)


def _quotas(counts, val_size, test_size):
    """{class: (n_test, n_val)} by largest remainder, ties to the smaller class."""
    import math

    def spread(weights, take):
        n = sum(weights.values())
        base = {c: take * v // n if n else 0 for c, v in weights.items()}
        order = sorted(weights, key=lambda c: (-(take * weights[c] % n), c is None, c)) if n else []
        for c in order[: take - sum(base.values())]:
            base[c] += 1
        return base

    held = spread(counts, math.ceil((val_size + test_size) * sum(counts.values())))
    test = spread(held, math.ceil(test_size / (val_size + test_size) * sum(held.values())))
    return {c: (test[c], held[c] - test[c]) for c in counts}


@settings(max_examples=3, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.integers(1, 60), min_size=1, max_size=5))
def test_split_sizes_and_quotas(spark, sizes):
    import math

    from tessera.operators import prep

    rows = [(i, f"c{c}") for c, n in enumerate(sizes) for i in range(sum(sizes[:c]), sum(sizes[:c]) + n)]
    df = spark.createDataFrame(rows, "id long, y string")
    got = {r.id: (r.y, r.split) for r in prep.split_data(df, "y", ["id"], seed=3).collect()}
    n = len(rows)
    assert len(got) == n
    held = sum(1 for _, s in got.values() if s != "train")
    test = sum(1 for _, s in got.values() if s == "test")
    assert held == math.ceil(0.3 * n) and test == math.ceil(0.5 * held)
    quotas = _quotas({f"c{c}": s for c, s in enumerate(sizes)}, 0.15, 0.15)
    for cls, (t, v) in quotas.items():
        assert sum(1 for y, s in got.values() if y == cls and s == "test") == t
        assert sum(1 for y, s in got.values() if y == cls and s == "val") == v


def test_split_of_many_strata_is_exact(spark):
    """Thousands of classes of unlike sizes, one of them null and one hot."""
    from pyspark.sql import functions as F

    from tessera.operators import prep

    g = F.when(F.col("id") % 3 == 0, F.lit(-1)).when(F.col("id") % 1000 == 1, F.lit(None)).otherwise(F.pmod(F.xxhash64("id"), F.lit(5000))).cast("int")
    df = spark.range(40_000).withColumn("y.z", g)
    got = prep.split_data(df, "y.z", ["id"], seed=3, cell_rows=64).groupBy(F.col("`y.z`").alias("y")).pivot("split", ["train", "val", "test"]).count().na.fill(0, ["train", "val", "test"]).collect()
    assert sum(r.train + r.val + r.test for r in got) == 40_000
    quotas = _quotas({r.y: r.train + r.val + r.test for r in got}, 0.15, 0.15)
    assert {r.y: (r.test, r.val) for r in got} == quotas
