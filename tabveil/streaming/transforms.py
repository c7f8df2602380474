"""Transformations of streams: fitted transformers are stateless projections and run on streams as they are."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def transform_stream(spark: SparkSession, source: str, schema, transform: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str) -> StreamingQuery:
    """Apply a fitted transform to the Parquet files of a folder as they come, once for all that are there."""
    stream = transform(spark.readStream.schema(schema).parquet(source))
    return stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(sink)
