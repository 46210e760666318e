"""The cube kept up to date from a stream of events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cellwise.functions.grid import GridSpec


def streaming_counts(events: DataFrame, spec: GridSpec, window: str = "1 day", lateness: str = "1 day") -> DataFrame:
    """Events per window and cell; an event later than lateness after the newest one is dropped, older windows are final."""
    placed = spec.assign(events.withColumn("datetime", F.col("datetime").cast("timestamp"))).withWatermark("datetime", lateness)
    counts = placed.groupBy(F.window("datetime", window), "row", "col", "flat_idx").agg(F.count("*").alias("n"))
    return counts.select(F.col("window.start").alias("period_start"), "row", "col", "flat_idx", "n")


def write_counts(counts: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Appends final windows as Parquet, exactly once; by default as much as there is, then ends."""
    writer = counts.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
