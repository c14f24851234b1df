"""Counts of events as they arrive: an extension, for files that keep coming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_stream(spark: SparkSession, folder: str, schema, files_per_batch: int = 100, pattern: str = "*.parquet") -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", pattern).parquet(folder)


def windowed_counts(events: DataFrame, at: str = "ts", key: str = "event_type", width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, key, n, total): tumbling windows; events later than ``late`` are not counted."""
    timed = events.withColumn("_ts", F.col(at).cast("timestamp")).withWatermark("_ts", late)
    out = timed.groupBy(F.window("_ts", width).alias("w"), key).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), key, "n", "total")


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process what has arrived, then stop."""
    stream.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path).awaitTermination()
