"""Running totals and AUC over many distinct order values."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions.ranking import bucket_of, running_totals
from tessera.operators import evaluate


def _scores(spark, n=200_000):
    x = F.xxhash64("id")
    return spark.range(n).select((F.pmod(x, F.lit(1 << 40)) / F.lit(float(1 << 40)) + F.col("id") / F.lit(1e12)).alias("score"), (F.pmod(F.xxhash64("id", F.lit(7)), F.lit(3)) == 0).cast("int").alias("y"))


def test_totals_equal_plain_window(spark):
    df = _scores(spark, 50_000).dropDuplicates(["score"]).withColumn("v", F.lit(1).cast("long"))
    plain = df.withColumn("want", F.sum("v").over(Window.orderBy("score").rowsBetween(Window.unboundedPreceding, 0)))
    got = running_totals(df, "score", ["v"], num_partitions=8)
    want = {r.score: r.want for r in plain.collect()}
    assert {r.score: r.cum_v for r in got.collect()} == want


def test_auc_exact_and_repeatable(spark):
    df = _scores(spark)
    ranked = df.withColumn("r", F.row_number().over(Window.orderBy("score")))
    r = ranked.agg(F.sum(F.col("y") * F.col("r")).alias("s"), F.sum("y").alias("p"), F.count(F.lit(1)).alias("n")).first()
    want = (r.s - r.p * (r.p + 1) / 2) / (r.p * (r.n - r.p))
    got = {round(evaluate.auc_binary(df, "y", "score", digits=None).first().auc, 12) for _ in range(3)}
    assert got == {round(want, 12)}


def _brute_roc(rows):
    """(threshold, fpr, tpr) from highest to lowest score, corners only, and the AUC."""
    p, n = sum(y for _, y in rows), sum(1 - y for _, y in rows)
    full = [(s, sum(1 - y for t, y in rows if t >= s), sum(y for t, y in rows if t >= s)) for s in sorted({s for s, _ in rows}, reverse=True)]
    keep = [x for i, x in enumerate(full) if len(full) <= 2 or i in (0, len(full) - 1)
            or any(full[i + 1][k] - 2 * x[k] + full[i - 1][k] for k in (1, 2))]
    rate = lambda a, b: a / b if b else None
    auc = sum((s > t) + 0.5 * (s == t) for s, y in rows if y for t, z in rows if not z) / (p * n) if p and n else None
    return sorted([(float("inf"), rate(0, n), rate(0, p)), *((s, rate(f, n), rate(t, p)) for s, f, t in keep)], key=lambda r: -r[0]), auc


def test_roc_and_auc_equal_brute_force_per_group(spark):
    rnd = random.Random(4)
    rows = [(g, float(rnd.randrange(top)), int(rnd.random() < share)) for g, top, share in (("a.", 40, 0.4), ("b", 3, 0.5), ("hot", 400, 0.1), ("one", 9, 1.0)) for _ in range(600 if g == "hot" else 60)]
    df = spark.createDataFrame(rows, "`m.x` string, score double, y int")
    got = evaluate.roc_curve(df, "y", "score", group_cols=["m.x"], pos_label=1, digits=None).collect()
    for g in ("a.", "b", "hot", "one"):
        mine = sorted((r for r in got if r["m.x"] == g), key=lambda r: -r.threshold)
        want, auc = _brute_roc([(s, y) for m, s, y in rows if m == g])
        assert [(r.threshold, r.fpr, r.tpr) for r in mine] == want
        assert len({r.auc for r in mine}) == 1 and mine[0].auc == (None if auc is None else pytest.approx(auc, abs=1e-12))


def test_more_buckets_than_a_literal_case_could_hold(spark):
    df = _scores(spark, 5_000).dropDuplicates(["score"]).withColumn("v", F.lit(1).cast("long"))
    got = running_totals(df, "score", ["v"], num_partitions=1500, totals=True, previous=True).collect()
    n = len(got)
    assert sorted(r.cum_v for r in got) == list(range(1, n + 1)) and {r.total_v for r in got} == {n}
    assert [r.cum_v for r in got if r.prev_v is None] == [1]


def test_bucket_of_counts_bounds(spark):
    bounds = ["b", "d", "f", "x"]
    df = spark.createDataFrame([(c,) for c in "abcdefgxyz"], "s string")
    got = {r.s: r.k for r in df.select("s", bucket_of(F.col("s"), bounds, df.schema["s"].dataType).alias("k")).collect()}
    assert got == {c: sum(b <= c for b in bounds) for c in "abcdefgxyz"}
