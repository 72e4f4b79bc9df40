"""Score rows as files arrive (batch scoring, re-aimed at a stream).

``score_stream`` reads new Parquet files from a folder with Structured
Streaming, applies a fitted classifier pipeline (stateless, so no
watermark is needed) and appends predictions to a Parquet sink.  The
checkpoint folder makes the query exactly-once and restartable after a
lost executor or driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tessera.operators.classify import TrainedClassifier


def score_stream(spark: SparkSession, model: TrainedClassifier, source_dir: str, schema: StructType,
                 sink_dir: str, checkpoint_dir: str, keep_cols: Sequence[str] = (),
                 available_now: bool = True, max_files_per_trigger: int = 100) -> StreamingQuery:
    rows: DataFrame = (spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger)
                       .parquet(source_dir))
    scored = model.predict(rows).select(*keep_cols, "prediction", "probability")
    writer = (scored.writeStream.format("parquet").option("path", sink_dir)
              .option("checkpointLocation", checkpoint_dir).outputMode("append"))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()
