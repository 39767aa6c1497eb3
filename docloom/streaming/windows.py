"""Windowed aggregation of an event stream, with late data bounded by a watermark."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, *, time: str = "ts", by: str = "event_type", window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Counts by tumbling window and key; works on a stream and on a table."""
    stamped = events.withColumn("_at", F.col(time).cast("timestamp"))
    stamped = stamped.withWatermark("_at", late) if events.isStreaming else stamped
    counts = stamped.groupBy(F.window("_at", window).alias("w"), by).agg(F.count("*").alias("n"))
    return counts.select(F.col("w.start").alias("bucket"), by, "n")


def hourly_counts(spark, sf_dir: str) -> DataFrame:
    """The ``events`` table as a stream, run to its end; the result as a table."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    source = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    name = f"windowed_{uuid.uuid4().hex}"
    counts = windowed_counts(source)
    stream = counts.writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start()
    stream.awaitTermination()
    return spark.table(name).withColumn("bucket", F.col("bucket").cast("timestamp_ntz"))
