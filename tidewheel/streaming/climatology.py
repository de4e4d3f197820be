"""A running climatology of a stream: mean and count of each cell and phase by day, with late rows within a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def running(events: DataFrame, cell: str, time: str, value: str, late: str = "1 day") -> DataFrame:
    """cell, day, phase, mean, n. The time column is made a timestamp with time zone, which watermarks need."""
    timed = events.select(F.col(cell).alias("cell"), F.col(time).cast("timestamp").alias("ts"), F.col(value).alias("value")).withWatermark("ts", late)
    return timed.groupBy("cell", F.window("ts", "1 day").alias("w"), F.hour("ts").alias("phase")).agg(F.avg("value").alias("mean"), F.count("value").alias("n")).select("cell", F.col("w.start").alias("day"), "phase", "mean", "n")
