"""Streaming forms of alerts, counters and state: an extension, the batch forms give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def alerts(events: DataFrame, limit: float) -> DataFrame:
    """Stateless threshold filter."""
    return events.where((F.col("event_type") == "purchase") & (F.col("value") >= limit)).select("event_id", "user_id", "value")


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Counts by event-time window and type; state older than the watermark is dropped."""
    stamped = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return stamped.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def latest_state(events: DataFrame, out: str, checkpoint: str):
    """Upserts the last event of each user into a Parquet table version per batch."""

    def merge(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        new = batch.groupBy("user_id").agg(F.max_by(F.struct("event_id", "event_type"), "event_id").alias("s")).select("user_id", "s.*")
        if epoch:
            old = spark.read.parquet(f"{out}/v{epoch - 1}")
            new = old.unionByName(new).groupBy("user_id").agg(F.max_by(F.struct("event_id", "event_type"), "event_id").alias("s")).select("user_id", "s.*")
        new.write.mode("overwrite").parquet(f"{out}/v{epoch}")

    return events.writeStream.option("checkpointLocation", checkpoint).foreachBatch(merge).trigger(availableNow=True).start()
