"""Distances, hulls and Voronoi cells of the members at each time."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geometry
from ..schema import KEY, TICK, coords, no_nan


def centroid_distance(df: DataFrame, kind: str = "utm") -> DataFrame:
    """Distance of each member to the mean of the members present."""
    x, y = coords(kind)
    w = Window.partitionBy(*TICK)
    dx, dy = F.col(x) - F.avg(x).over(w), F.col(y) - F.avg(y).over(w)
    return df.select(*KEY, F.sqrt(dx * dx + dy * dy).alias("dist"))


def pairs(df: DataFrame, x: str, y: str) -> DataFrame:
    """Each member with each other one at the same time: dx, dy."""
    a = df.select(*KEY, F.col(x).alias("_x"), F.col(y).alias("_y"))
    b = df.select(*TICK, F.col("member_id").alias("other"), F.col(x).alias("_ox"), F.col(y).alias("_oy"))
    return a.join(b, TICK).where("member_id <> other").select(*KEY, "other", (F.col("_x") - F.col("_ox")).alias("dx"), (F.col("_y") - F.col("_oy")).alias("dy"))


def neighbour_distance(df: DataFrame, kind: str = "utm") -> DataFrame:
    """Distance to the nearest other member."""
    d = F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"))
    return pairs(df, *coords(kind)).groupBy(*KEY).agg(F.min(d).alias("dist"))


def hull(df: DataFrame, kind: str = "utm") -> DataFrame:
    """Perimeter and area of the convex hull at each time; null if a member is missing.

    A directed edge between two members is on the hull if nobody lies to its
    right, and on a straight line if nobody lies beyond or between.
    """
    x, y = coords(kind)
    w = Window.partitionBy(*TICK)
    full = df.select(*KEY, F.col(x).alias("x"), F.col(y).alias("y"))
    full = full.withColumn("ok", (F.count("x").over(w) == F.count("*").over(w)) & (F.count("y").over(w) == F.count("*").over(w)))
    p = full.groupBy(*TICK).agg(F.min("ok").alias("ok"), F.sort_array(F.collect_set(F.struct("x", "y"))).alias("p"))
    edges = """
        flatten(transform(p, a -> transform(filter(p, b -> b <> a AND NOT exists(p, c -> c <> a AND c <> b AND (
            (b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) < 0
            OR ((b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) = 0
                AND (c.x - a.x) * (c.x - b.x) + (c.y - a.y) * (c.y - b.y) > 0
                AND (c.x - a.x) * (b.x - a.x) + (c.y - a.y) * (b.y - a.y) > 0)
            OR ((b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) = 0
                AND (c.x - a.x) * (b.x - a.x) + (c.y - a.y) * (b.y - a.y) < 0)))),
            b -> struct(sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)) AS l, (a.x * b.y - b.x * a.y) / 2 AS s))))
    """
    sums = p.withColumn("e", F.expr(edges))
    total = lambda f: f"aggregate(e, 0D, (s, v) -> s + v.{f})"
    return sums.select(*TICK, F.when(F.col("ok"), F.expr(total("l"))).alias("perimeter"), F.when(F.col("ok"), F.abs(F.expr(total("s")))).alias("area"))


def voronoi(df: DataFrame, kind: str = "utm") -> DataFrame:
    """Area of each member's Voronoi cell within the hull, and its share of the hull.

    Null at times when a member is missing; an empty cell has area 0.
    """
    x, y = coords(kind)

    def cells(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, tick in pdf.groupby("t"):
            points = tick[[x, y]].to_numpy(float)
            if np.isfinite(points).all():
                areas, total = geometry.voronoi_areas(points)
                share = areas / total if total > 0 else np.full(len(areas), np.nan)
            else:
                areas = share = np.full(len(points), np.nan)
            out.append(tick[KEY].assign(area=areas, ratio=share))
        return pd.concat(out)

    block = F.floor(F.col("t") / 512).alias("_block")
    schema = f"squad_id {df.schema['squad_id'].dataType.simpleString()}, period_id int, member_id {df.schema['member_id'].dataType.simpleString()}, t int, area double, ratio double"
    rows = df.select("squad_id", F.col("period_id").cast("int"), "member_id", F.col("t").cast("int"), x, y, block)
    return no_nan(rows.groupBy("squad_id", "period_id", "_block").applyInPandas(cells, schema))
