"""Streaming forms of the simplest series: centroid and spread per time window.

An extension: fixes arrive as a stream with event times; late ones are taken
up to the watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_centroid(fixes: DataFrame, window: str = "1 minute", late: str = "2 minutes", time: str = "ts") -> DataFrame:
    """(squad_id, start, end, cx, cy, n) of each squad and window."""
    g = fixes.withWatermark(time, late).groupBy("squad_id", F.window(time, window).alias("w"))
    out = g.agg(F.avg("utm_x").alias("cx"), F.avg("utm_y").alias("cy"), F.count("*").alias("n"))
    return out.select("squad_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "cx", "cy", "n")


def windowed_spread(fixes: DataFrame, window: str = "1 minute", late: str = "2 minutes", time: str = "ts") -> DataFrame:
    """(squad_id, start, end, width, height) of the box around each squad."""
    g = fixes.withWatermark(time, late).groupBy("squad_id", F.window(time, window).alias("w"))
    out = g.agg((F.max("utm_x") - F.min("utm_x")).alias("width"), (F.max("utm_y") - F.min("utm_y")).alias("height"))
    return out.select("squad_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "width", "height")
