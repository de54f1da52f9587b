"""Streaming views: stateful aggregates over an event stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def events_stream(spark: SparkSession, folder: str, files: int = 1) -> DataFrame:
    """The event files of a folder as a stream; ts becomes a TIMESTAMP, which watermarks need."""
    schema = spark.read.parquet(folder).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def totals(stream: DataFrame) -> DataFrame:
    """COUNT and SUM per event type; run in update mode."""
    return stream.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def hourly(stream: DataFrame, late: str = "1 hour") -> DataFrame:
    """Counts per hour and type, closed once the watermark has passed."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count(F.lit(1)).alias("n"))


def run_to_table(df: DataFrame, name: str, checkpoint: str, mode: str = "complete"):
    """Process what is there into an in-memory table and stop."""
    query = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
