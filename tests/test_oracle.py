"""Spark queries against their DuckDB SQL on the smallest provided tables."""

import os

import duckdb
import pytest

from check_oracle import compare
from tessera.plans.catalog import ORACLE, QUERIES
from tessera.plans.fixtures import TABLES

SF = "/root/testdata/sf0.001"
CHEAP = ["null_pct", "duplicate_count", "describe_numeric", "describe_categorical", "outlier_summary", "impute_median",
         "dedup", "encode_auto", "split_stratified", "scale_robust", "metrics_weighted", "auc_ovr", "roc_curve",
         "confusion_matrix", "cluster_traits", "silhouette", "histogram", "correlation", "load_csv", "table_metadata"]


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(SF):
        pytest.skip("test tables not present")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", CHEAP)
def test_query_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    rows = df.collect()
    cur = duck.execute(ORACLE[name])
    drows = cur.fetchall()
    r = compare(rows, df.columns, [f.dataType.simpleString() for f in df.schema.fields], drows,
                [d[0] for d in cur.description], [str(d[1]) for d in cur.description])
    assert r["rows"][0] == r["rows"][1] and r["cols_ok"] and r["exact"], r
