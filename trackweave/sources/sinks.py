"""Sinks: feature tables, stop markers and frames for plots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_features(features: DataFrame, path: str) -> None:
    features.write.mode("overwrite").parquet(path)


def stop_markers(stops: DataFrame) -> DataFrame:
    """Place and length of each group stop, for a map: stops carry group_stop_id."""
    return stops.groupBy("squad_id", "group_stop_id").agg(
        F.avg("x").alias("x"), F.avg("y").alias("y"), F.min("start_ts").alias("start_ts"), (F.max("end_ts") - F.min("start_ts")).alias("length")
    )


def sample_slice(frames: DataFrame, start: int, length: int = 200) -> DataFrame:
    """A contiguous slice of samples, for a figure."""
    return frames.where(F.col("t").between(start, start + length - 1))
