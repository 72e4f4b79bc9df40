"""Helpers shared by the operators of this package."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import ensure_checkpoint_dir

#: ASCII white space, the separator of words in every operator here.
WS = " \t\n\x0b\f\r"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
WS_CLASS = r"[\x20\x09-\x0D]"


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path (not created) in the folder that all executors share."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write `df` to the shared folder and read it back.
    A lost executor then costs a re-read, never a recomputation. What the
    write shuffled is dropped as soon as it has ended."""
    spark = df.sparkSession
    path = scratch(spark, name)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def words(text: Column) -> Column:
    """array<string> of the words `[^\\x20\\x09-\\x0D]+`; null and blank texts give an empty array."""
    body = F.btrim(F.coalesce(text, F.lit("")), F.lit(WS))
    return F.when(F.length(body) == 0, F.array().cast("array<string>")).otherwise(F.split(body, WS_CLASS + "+"))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
