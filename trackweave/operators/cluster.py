"""Clusters of members at each time: who is apart from whom."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import density
from ..schema import KEY, PERIOD, TICK, coords, metres, no_nan


def first_as_zero(labels: np.ndarray) -> np.ndarray:
    """Labels with the first member's cluster, if it is 1 to 4, swapped with 0."""
    first = labels[0]
    if not 1 <= first <= 4:
        return labels
    return np.where(labels == first, 0, np.where(labels == 0, first, labels))


def clusters(df: DataFrame, kind: str = "utm", method: str = "HDBSCAN", epsilon: float = 10.0, min_cluster_size: int = 2) -> DataFrame:
    """(squad, period, member, t, label, prob): -1 is an outlier; null when a member is missing.

    Members count in the order of their ids.  DBSCAN has no prob.
    """
    return clusterings(df, [(method, epsilon)], kind, min_cluster_size).drop("method", "epsilon")


def clusterings(df: DataFrame, settings: list[tuple[str, float]], kind: str = "utm", min_cluster_size: int = 2) -> DataFrame:
    """The same for several (method, epsilon) in one pass over the tracks, with both as columns."""
    unknown = {m for m, _ in settings} - {"HDBSCAN", "DBSCAN"}
    if unknown:
        raise ValueError(f"unknown method: {', '.join(unknown)}")
    x, y = coords(kind)
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, tick in pdf.sort_values(["t", "member_id"]).groupby("t"):
            p = tick[["_x", "_y"]].to_numpy(float)
            for method, epsilon in settings:
                label, prob = np.full(len(p), np.nan), np.full(len(p), np.nan)
                if np.isfinite(p).all():
                    if method == "DBSCAN":
                        d = np.sqrt(((p[:, None] - p[None]) ** 2).sum(-1))
                        label = _dbscan(d <= epsilon, min_cluster_size)
                    else:
                        label, prob = density.hdbscan(p, min_cluster_size, 2, epsilon)
                    label = first_as_zero(label)
                out.append((tick[KEY].to_numpy(dtype=object), method, float(epsilon), label, prob))
        sizes = [len(k) for k, *_ in out]
        rows = pd.DataFrame(np.concatenate([k for k, *_ in out]), columns=KEY)
        rows["method"], rows["epsilon"] = np.repeat([m for _, m, *_ in out], sizes), np.repeat([e for _, _, e, *_ in out], sizes)
        rows["label"] = pd.array(np.concatenate([v[3] for v in out]).astype(float), dtype="Float64").astype("Int64")
        rows["prob"] = np.concatenate([v[4] for v in out])
        return rows

    block = F.floor(F.col("t") / 512).alias("_block")
    rows = df.select(*KEY, metres(kind, x).alias("_x"), metres(kind, y).alias("_y"), block)
    schema = ", ".join(f"{c} {types[c]}" for c in KEY) + ", method string, epsilon double, label int, prob double"
    return no_nan(rows.groupBy(*PERIOD, "_block").applyInPandas(fit, schema))


def _dbscan(near: np.ndarray, least: int) -> np.ndarray:
    """Density clusters where a core point has ``least`` neighbours, itself included."""
    if least <= 2:
        return density.components(near)
    core = near.sum(1) >= least
    label = np.full(len(near), -1)
    inner = density.components(near & core[:, None] & core[None])
    k = inner.max() + 1
    for i in np.flatnonzero(core):  # a lone core point is a cluster too
        if inner[i] < 0:
            inner[i], k = k, k + 1
    label[core] = inner[core]
    for i in np.flatnonzero(~core):
        close = np.flatnonzero(near[i] & core)
        if len(close):
            label[i] = label[close[0]]
    order = {c: j for j, c in enumerate(dict.fromkeys(label[label >= 0].tolist()))}
    return np.array([order.get(c, -1) for c in label.tolist()])


def silhouette(df: DataFrame, labels: DataFrame, kind: str = "utm") -> DataFrame:
    """Mean silhouette per time; outliers count as one cluster.

    Null unless some label is above 0 and some cluster has more than one
    member.
    """
    x, y = coords(kind)
    p = df.select(*KEY, metres(kind, x).alias("x"), metres(kind, y).alias("y")).join(labels.select(*KEY, "label"), KEY).where("label IS NOT NULL")
    q = p.select(*TICK, F.col("member_id").alias("o"), F.col("x").alias("ox"), F.col("y").alias("oy"), F.col("label").alias("ol"))
    dx, dy = F.col("x") - F.col("ox"), F.col("y") - F.col("oy")
    d = p.join(q, TICK).where("member_id <> o").withColumn("d", F.sqrt(dx * dx + dy * dy))
    mean = d.groupBy(*KEY, "label", "ol").agg(F.avg("d").alias("m"))
    own = F.max(F.when(F.col("label") == F.col("ol"), F.col("m")))
    other = F.min(F.when(F.col("label") != F.col("ol"), F.col("m")))
    s = mean.groupBy(*KEY, "label").agg(own.alias("a"), other.alias("b"))
    widest = F.greatest("a", "b")
    score = F.when(F.col("a").isNull() | (widest == 0), 0.0).otherwise((F.col("b") - F.col("a")) / F.nullif(widest, F.lit(0.0)))
    g = s.groupBy(*TICK).agg(F.avg(score).alias("s"), F.max("label").alias("top"), F.countDistinct("label").alias("k"), F.count("*").alias("n"))
    return g.select(*TICK, F.when((F.col("top") > 0) & (F.col("k") < F.col("n")), F.col("s")).alias("silhouette"))


def outlier_time(labels: DataFrame) -> DataFrame:
    """Samples that a member is an outlier, per period."""
    return labels.groupBy(*PERIOD, "member_id").agg(F.count_if(F.col("label") == -1).alias("outlier_time"))


def membership(labels: DataFrame) -> DataFrame:
    """Mean membership strength per member: over samples, then over periods."""
    return labels.groupBy(*PERIOD, "member_id").agg(F.avg("prob").alias("p")).groupBy("squad_id", "member_id").agg(F.avg("p").alias("membership"))


def frames(df: DataFrame, labels: DataFrame, every: int = 0, kind: str = "utm") -> DataFrame:
    """Long frames for plots: positions around the group's mean, with label and strength."""
    x, y = coords(kind)
    w = Window.partitionBy(*TICK)
    centred = df.select(*KEY, (F.col(x) - F.avg(x).over(w)).alias("x"), (F.col(y) - F.avg(y).over(w)).alias("y"))
    joined = centred.join(labels.select(*KEY, "label", "prob"), KEY, "left")
    return joined.where(F.col("t") % every == 0) if every else joined
