"""Streams over events and the audit log."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir


def counts_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events counted by user and type: a stream from the table's folder, into a table in the shared folder, until it is read up.

    State is one counter for each user and type; each batch's counters overwrite the ones before.
    """
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    base = f"{shared_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    source = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*")
    counted = source.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={number}")

    query = counted.writeStream.outputMode("complete").option("checkpointLocation", f"{base}/checkpoint").foreachBatch(write).trigger(availableNow=True).start()
    query.awaitTermination()
    found = spark.read.option("basePath", f"{base}/out").parquet(f"{base}/out")
    last = found.agg(F.max("batch").alias("batch"))
    return found.join(F.broadcast(last), "batch").select("user_id", "event_type", "n")


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Counts by window and type of a stream (ts, event_type) with a watermark, for sinks in append mode."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")
