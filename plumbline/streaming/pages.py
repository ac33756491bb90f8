"""Pages that arrive as files, classified as they come by the same columns as in batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from plumbline.functions.classify import RUSSIAN, Markers, classified, features


def page_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def classify_stream(pages: DataFrame, out: str, checkpoint: str, m: Markers = RUSSIAN) -> StreamingQuery:
    """Appends classified pages to out and stops when there are no more."""
    return classified(features(pages), m).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
