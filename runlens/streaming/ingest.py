"""Incremental ingest; what was read before is skipped."""

from __future__ import annotations

from pyspark.sql import SparkSession


def ingest(spark: SparkSession, source: str, target: str, checkpoint: str, schema: str) -> None:
    """Append all JSON files of ``source`` that were not there before to the Parquet table ``target``, then stop."""
    stream = spark.readStream.schema(schema).json(source)
    query = stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
