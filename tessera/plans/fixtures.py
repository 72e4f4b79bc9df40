"""Derived inputs shared by the Spark queries and their SQL oracles.

The provided tables have no nulls, no duplicate rows and no signal in
``lineitem``; queries that test those features derive them with the *same*
SQL expression text on both sides (Spark SQL and DuckDB parse it alike).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.functions.types import nan_to_null

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A provided table, NaN turned into null; the same plain scan at every size."""
    return nan_to_null(spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet"))


# name -> (base table, select expressions)
DERIVED: dict[str, tuple[str, list[str]]] = {
    # lineitem with nulls injected in four columns (l_tax ~2/3 null, so it
    # is no target candidate)
    "lineitem_nulls": ("lineitem", [
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
        "CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_quantity END AS l_quantity",
        "CASE WHEN l_partkey % 13 = 0 THEN NULL ELSE l_extendedprice END AS l_extendedprice",
        "l_discount",
        "CASE WHEN l_orderkey % 3 <> 0 THEN NULL ELSE l_tax END AS l_tax",
        "CASE WHEN l_suppkey % 5 = 0 THEN NULL ELSE l_returnflag END AS l_returnflag",
        "l_linestatus",
        "l_shipdate",
    ]),
    # projection of lineitem that has many exact copies
    "lineitem_proj": ("lineitem", [
        "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus",
    ]),
    # projection of documents with a few exact copies
    "documents_proj": ("documents", ["text", "lang", "source"]),
    # lineitem numeric features plus a derived, correlated column and a
    # derived binary target with real signal
    "lineitem_model": ("lineitem", [
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
        "l_discount", "l_tax", "l_extendedprice * (1 - l_discount) AS l_revenue",
        "CAST(l_quantity * l_extendedprice > 1000000 AS INT) AS big_order",
    ]),
    # binary evaluation fixture on labels: a computed score and prediction
    "labels_scored": ("labels", [
        "doc_id", "quality", "toxic",
        "CAST(toxic AS DOUBLE) * 0.3 + CAST(doc_id % 10 AS DOUBLE) / 10.0 * 0.7 AS score",
        "CAST(CAST(toxic AS DOUBLE) * 0.3 + CAST(doc_id % 10 AS DOUBLE) / 10.0 * 0.7 >= 0.5 AS INT) AS prediction",
    ]),
    # multi-class evaluation fixture on labels: classes 0..2, per-class
    # scores and a prediction with some errors
    "labels_multi": ("labels", [
        "doc_id",
        "quality + toxic AS label",
        "CASE WHEN doc_id % 4 = 0 THEN (quality + toxic + 1) % 3 ELSE quality + toxic END AS prediction",
        "CAST((doc_id * 3) % 11 AS DOUBLE) / 20.0 + CASE WHEN quality + toxic = 0 THEN 0.5 ELSE 0.0 END AS p0",
        "CAST((doc_id * 5) % 11 AS DOUBLE) / 20.0 + CASE WHEN quality + toxic = 1 THEN 0.5 ELSE 0.0 END AS p1",
        "CAST((doc_id * 7) % 11 AS DOUBLE) / 20.0 + CASE WHEN quality + toxic = 2 THEN 0.5 ELSE 0.0 END AS p2",
    ]),
}


def derived(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    base, exprs = DERIVED[name]
    return load(spark, sf_dir, base).selectExpr(*exprs)


def derived_sql(name: str) -> str:
    """The same derivation as a DuckDB sub-select."""
    base, exprs = DERIVED[name]
    return f"(SELECT {', '.join(exprs)} FROM {base})"
