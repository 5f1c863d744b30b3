"""Live counts of a comment stream: an extension of the batch aggregates, equal to them once the stream has ended."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stream_of(spark: SparkSession, folder: str, schema: str, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def windowed_counts(stream: DataFrame, time: str, code: str, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """(start, code, n) in tumbling windows; rows later than the watermark are dropped. The time may lack a zone."""
    at = stream.withColumn("_at", F.col(time).cast("timestamp")).withWatermark("_at", late)
    return at.groupBy(F.window("_at", width).alias("w"), code).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), code, "n")


def session_counts(stream: DataFrame, time: str, key: str, gap: str = "30 minutes", late: str = "2 days") -> DataFrame:
    """(key, start, end, n) of sessions."""
    at = stream.withColumn("_at", F.col(time).cast("timestamp")).withWatermark("_at", late)
    return at.groupBy(F.session_window("_at", gap).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def run_to_end(counts: DataFrame, path: str, checkpoint: str) -> None:
    """Write finished windows to Parquet until the source has no more; restarts from the checkpoint."""
    counts.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
