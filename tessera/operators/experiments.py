"""Experiment log: an append-only table of (timestamp, model, split,
params, metrics), read back with one column per parameter name.

Each ``log_experiment`` call appends one small Parquet file to a folder
(on a cluster: under the shared checkpoint location), so concurrent
writers never rewrite each other's rows.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.types import qcol

METRICS = ["accuracy", "f1", "precision", "recall", "auc"]
LOG_SCHEMA = ("timestamp string, model string, split string, params map<string,string>, "
              "accuracy double, f1 double, precision double, recall double, auc double, metrics map<string,double>")


def log_experiment(spark: SparkSession, log_dir: str, name: str, params: Mapping[str, object],
                   metrics: DataFrame | Mapping[str, float | None], split: str = "test") -> DataFrame:
    """Append one entry.  ``metrics`` is a one-row metrics DataFrame (as
    returned by the evaluators; its numeric columns) or a mapping; of METRICS,
    the missing ones are null, and all further ones are kept by name."""
    if isinstance(metrics, DataFrame):
        m = metrics
    else:
        names = list(dict.fromkeys([*METRICS, *map(str, metrics)]))
        given = {str(k): v for k, v in metrics.items()}
        m = spark.createDataFrame([tuple(None if given.get(k) is None else float(given[k]) for k in names)],
                                  T.StructType([T.StructField(k, T.DoubleType()) for k in names]))
    more = [f.name for f in m.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in METRICS]
    extra = F.create_map(*[x for k in more for x in (F.lit(k), qcol(k).cast("double"))]) if more else F.create_map()
    p = F.create_map(*[x for k, v in params.items() for x in (F.lit(str(k)), F.lit(str(v)))]) if params \
        else F.create_map().cast("map<string,string>")
    row = m.select(
        F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss").alias("timestamp"),
        F.lit(name).alias("model"), F.lit(split).alias("split"), p.alias("params"),
        *[(F.col(k) if k in m.columns else F.lit(None)).cast("double").alias(k) for k in METRICS],
        extra.cast("map<string,double>").alias("metrics"))
    row.coalesce(1).write.mode("append").parquet(log_dir)
    return row


def experiments_table(spark: SparkSession, log_dir: str) -> DataFrame:
    """All entries with one ``param_<name>`` column per parameter name seen,
    METRICS, and one column per further metric seen (null where an entry
    lacks it); empty frame when the folder is not there."""
    try:
        log = spark.read.schema(LOG_SCHEMA).parquet(log_dir)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LOG_SCHEMA).drop("params", "metrics")

    def names(column: str) -> list[str]:
        return sorted(r["k"] for r in log.select(F.explode(F.map_keys(column)).alias("k")).distinct().collect())

    return log.select("timestamp", "model", "split",
                      *[F.try_element_at("params", F.lit(k)).alias(f"param_{k}") for k in names("params")], *METRICS,
                      *[F.try_element_at("metrics", F.lit(k)).alias(k) for k in names("metrics")])


def export_csv(df: DataFrame, path: str) -> str:
    """Write the table as CSV with a header (one file per partition)."""
    df.write.mode("overwrite").option("header", True).csv(path)
    return path


def metrics_long(experiments: DataFrame) -> DataFrame:
    """(model, metric, value) for the metric columns present."""
    present = [m for m in METRICS if m in experiments.columns]
    if not present or "model" not in experiments.columns:
        return experiments.sparkSession.createDataFrame([], "model string, metric string, value double")
    return experiments.select("model", *present).unpivot(["model"], present, "metric", "value")
