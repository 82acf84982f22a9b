"""Path-adapted coordinates: place across and along the group's path."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import splines
from ..schema import KEY, MEMBER, PERIOD, TICK, coords


def rotate(x: Column, y: Column, angle: Column) -> tuple[Column, Column]:
    """(x, y) turned so that the heading ``angle`` points to +y."""
    a = F.lit(np.pi / 2) - angle
    return x * F.cos(a) - y * F.sin(a), x * F.sin(a) + y * F.cos(a)


def transform(df: DataFrame, kind: str = "utm", s: float | None = None, path: np.ndarray | None = None) -> DataFrame:
    """pacs_x: distance from the path, negative to its left; pacs_y: distance along it ahead of the centroid.

    The path is a smoothing spline of the centroid's track over its arc
    length, or of ``path``, an n x 2 array.  The last sample of a period is
    left out, as are times at which a member is missing.  Nearest points
    follow the one at the sample before: the valleys are found tick by tick,
    the points in them all at once.
    """
    x, y = coords(kind)
    s = s if s is not None else (100.0 if kind == "utm" else 1e-8)
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}

    def project(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["t", "member_id"])
        full = pdf.groupby("t")[[x, y]].transform(lambda c: c.notna().all()).all(axis=1)
        pdf = pdf[full]
        if pdf["t"].nunique() < 3:
            return pd.DataFrame(columns=[*KEY, "pacs_x", "pacs_y"])
        centre = pdf.groupby("t")[[x, y]].mean()
        track = centre.to_numpy(float)
        line = track if path is None else np.asarray(path, float)
        u, sx, sy = splines.path_splines(line[:, 0], line[:, 1], s, unit=False)
        curve = splines.Path(sx, sy)
        smooth = np.stack([sx(u), sy(u)], 1) if path is None else track
        reach = max(20.0 * np.median(np.hypot(*np.diff(track, axis=0).T)), (u[-1] - u[0]) / 20, 1e-9)
        rows = pdf.groupby("t").indices
        xy = pdf[[x, y]].to_numpy(float)
        members, last, home = pdf["member_id"].to_numpy(), {}, None
        cell, tick, homes = np.full(len(pdf), -1), np.zeros(len(pdf), int), []
        for k, t in enumerate(sorted(rows)[:-1]):
            homes.append(curve.valley(*smooth[k], home, reach))
            home = curve.grid[homes[-1]]
            for i in rows[t]:
                cell[i], tick[i] = curve.valley(*xy[i], last.get(members[i], home), reach), k
                last[members[i]] = curve.grid[cell[i]]
        ok = cell >= 0
        out, xy = pdf[ok][KEY].copy(), xy[ok]
        foot = curve.refine(xy[:, 0], xy[:, 1], cell[ok])
        base = curve.refine(smooth[: len(homes), 0], smooth[: len(homes), 1], np.array(homes))[tick[ok]]
        px, py = sx(foot), sy(foot)
        hx, hy = px - sx(foot - 1), py - sy(foot - 1)
        left = hx * (xy[:, 1] - py) - hy * (xy[:, 0] - px) > 0
        out["pacs_x"] = np.where(left, -1.0, 1.0) * np.hypot(xy[:, 0] - px, xy[:, 1] - py)
        out["pacs_y"] = curve.length(foot) - curve.length(base)
        return out

    schema = ", ".join(f"{c} {types[c]}" for c in KEY) + ", pacs_x double, pacs_y double"
    return df.select(*KEY, x, y).groupBy(*PERIOD).applyInPandas(project, schema)


def exploration(df: DataFrame, x: str = "pacs_x", y: str = "pacs_y") -> DataFrame:
    """Distance of each sample to the member's own mean place in the period."""
    w = Window.partitionBy(*MEMBER)
    dx, dy = F.col(x) - F.avg(x).over(w), F.col(y) - F.avg(y).over(w)
    return df.select(*KEY, F.sqrt(dx * dx + dy * dy).alias("sei"))


def neighbours(df: DataFrame, x: str = "pacs_x", y: str = "pacs_y") -> DataFrame:
    """Smallest distance to another member across, and on its own along, the path."""
    from .spatial import pairs

    return pairs(df, x, y).groupBy(*KEY).agg(F.min(F.abs("dx")).alias("x_near"), F.min(F.abs("dy")).alias("y_near"))


def length_width(df: DataFrame, x: str = "pacs_x", y: str = "pacs_y") -> DataFrame:
    """Length over width of the group; infinite without width, null without both."""
    length, width = F.max(y) - F.min(y), F.max(x) - F.min(x)
    both = df.groupBy(*TICK).agg(length.alias("l"), width.alias("w"))
    ratio = F.when(F.col("w") != 0, F.col("l") / F.when(F.col("w") != 0, F.col("w"))).when(F.col("l") != 0, F.lit(float("inf")))
    return both.select(*TICK, ratio.alias("lw"))


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int, keys: list[str], name: str = "n") -> DataFrame:
    """(keys, bin, n) for every bin; the last bin holds its upper edge, values outside are left out."""
    width = (high - low) / bins
    at = F.when(F.col(value) == high, bins - 1).otherwise(F.floor((F.col(value) - low) / width))
    found = df.where(F.col(value).between(low, high)).groupBy(*keys, at.cast("int").alias("bin")).agg(F.count("*").alias(name))
    every = df.select(*keys).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return every.join(found, [*keys, "bin"], "left").fillna(0, subset=[name])


def consistency_f(df: DataFrame, value: str, low: float = -50.0, high: float = 50.0, bins: int = 100) -> DataFrame:
    """One-way F of a member's density histograms over periods; null with one period.

    Densities sum to the same in every period, so F is rounding noise around 0.
    """
    h = histogram(df, value, low, high, bins, MEMBER)
    w = Window.partitionBy(*MEMBER)
    density = h.withColumn("d", F.col("n") / F.nullif(F.sum("n").over(w), F.lit(0)) / ((high - low) / bins))
    group = density.groupBy(*MEMBER).agg(F.avg("d").alias("m"), F.var_pop("d").alias("v"))
    all_ = group.groupBy("squad_id", "member_id").agg(F.count("m").alias("k"), F.var_pop("m").alias("between"), F.sum("v").alias("within"), F.min(F.col("m").isNotNull()).alias("ok"))
    k, n = F.col("k"), F.col("k") * bins
    f = (F.col("between") * n / F.nullif(k - 1, F.lit(0))) / (F.nullif(F.col("within"), F.lit(0.0)) * bins / (n - k))
    return all_.select("squad_id", "member_id", F.when((k > 1) & F.col("ok"), f).alias("f"))


def consistency_wasserstein(df: DataFrame, value: str, low: float = -50.0, high: float = 50.0, bins: int = 100, mode: str = "reference") -> DataFrame:
    """Mean over period pairs of the Wasserstein distance of bin heights taken as samples.

    reference: heights are counts in the earlier period and densities in the
    later one.  clean: densities in both.
    """
    h = histogram(df, value, low, high, bins, MEMBER)
    w = Window.partitionBy(*MEMBER)
    density = F.col("n") / F.nullif(F.sum("n").over(w), F.lit(0)) / ((high - low) / bins)
    ranked = h.withColumn("d", density).withColumn("k", F.row_number().over(w.orderBy("n")))
    first = F.col("n").cast("double") if mode == "reference" else F.col("d")
    a = ranked.select("squad_id", "member_id", "k", F.col("period_id").alias("p1"), first.alias("h1"))
    b = ranked.select("squad_id", "member_id", "k", F.col("period_id").alias("p2"), F.col("d").alias("h2"))
    pair = a.join(b, ["squad_id", "member_id", "k"]).where("p1 < p2")
    each = pair.groupBy("squad_id", "member_id", "p1", "p2").agg(F.avg(F.abs(F.col("h1") - F.col("h2"))).alias("w"))
    return each.groupBy("squad_id", "member_id").agg(F.avg("w").alias("wasserstein"))
