"""Entropies of places and metrics, and autoregressive forecast errors."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import forecast
from ..schema import KEY, MEMBER, PERIOD, no_nan
from .pacs import histogram


def place_entropy(df: DataFrame, x: str = "pacs_x", y: str = "pacs_y", low: float = -50.0, high: float = 50.0, bins: int = 100, mode: str = "reference") -> DataFrame:
    """Entropy in bits of a member's places in a period, on a grid of bins x bins.

    reference: of the distribution of distinct cell counts over all cells.
    clean: of the distribution of samples over cells.
    """
    width = (high - low) / bins
    at = lambda c: F.when(F.col(c) == high, bins - 1).otherwise(F.floor((F.col(c) - low) / width)).cast("int")
    inside = F.col(x).between(low, high) & F.col(y).between(low, high)
    cells = df.where(inside).groupBy(*MEMBER, at(x).alias("i"), at(y).alias("j")).agg(F.count("*").alias("n"))
    if mode == "clean":
        total = cells.groupBy(*MEMBER).agg(F.sum("n").alias("all"))
        p = cells.join(total, MEMBER).withColumn("p", F.col("n") / F.col("all"))
    else:
        kinds = cells.groupBy(*MEMBER, "n").agg(F.count("*").alias("k"))
        empty = cells.groupBy(*MEMBER).agg((F.lit(bins * bins) - F.count("*")).alias("k")).where("k > 0").select(*MEMBER, F.lit(0).cast("long").alias("n"), "k")
        p = kinds.unionByName(empty).withColumn("p", F.col("k") / F.lit(float(bins * bins)))
    return p.groupBy(*MEMBER).agg((-F.sum(F.col("p") * F.log2("p"))).alias("entropy"))


def metric_entropy(df: DataFrame, value: str, low: float, high: float, bins: int = 100, keys: list[str] | None = None) -> DataFrame:
    """Entropy of a metric's histogram: -mean ln of the share of bins with nearly the same height.

    Heights are nearly the same within 0.2 of their standard deviation over
    the bins.  Equal heights are compared once, with their multiplicity.
    """
    keys = keys or MEMBER
    h = histogram(df.where(F.col(value).isNotNull()), value, low, high, bins, keys)
    return histogram_entropy(h, keys)


def histogram_entropy(h: DataFrame, keys: list[str]) -> DataFrame:
    """The same from histograms with every bin: rows (keys, bin, n)."""
    total = h.groupBy(*keys).agg(F.sum("n").alias("_all"), (0.2 * F.stddev_pop("n")).alias("_r"), F.count("*").cast("double").alias("_bins"))
    heights = h.groupBy(*keys, "n").agg(F.count("*").alias("k"))
    a = heights.join(total.where("_all > 0"), keys)
    b = heights.select(*keys, F.col("n").alias("n2"), F.col("k").alias("k2"))
    near = a.join(b, keys).where(F.abs(F.col("n") - F.col("n2")) <= F.col("_r"))
    share = near.groupBy(*keys, "n", "k", "_bins").agg((F.sum("k2") / F.col("_bins")).alias("c"))
    return share.groupBy(*keys, "_bins").agg((-F.sum(F.col("k") * F.log("c")) / F.col("_bins")).alias("entropy")).drop("_bins")


def metric_entropy_mean(df: DataFrame, value: str, low: float, high: float, bins: int = 100) -> DataFrame:
    """Mean over periods, per member if there are members."""
    keys = MEMBER if "member_id" in df.columns else PERIOD
    out = [k for k in keys if k != "period_id"]
    return metric_entropy(df, value, low, high, bins, keys).groupBy(*out).agg(F.avg("entropy").alias("entropy"))


def _errors(df: DataFrame, x: str, y: str, window: int, resid: bool, others: bool) -> DataFrame:
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        table = pdf.pivot(index="t", columns="member_id", values=[x, y]).sort_index().dropna()
        out = []
        for m in table[x].columns:
            own = table.loc[:, [(x, m), (y, m)]].to_numpy(float)
            rest = table.drop(columns=[(x, m), (y, m)]).to_numpy(float) if others else None
            err = forecast.rolling_errors(own, rest, window, resid)
            out.append(pd.DataFrame({"squad_id": pdf.squad_id.iloc[0], "period_id": pdf.period_id.iloc[0], "member_id": m, "t": np.arange(len(err)), "err": err}))
        return pd.concat(out) if out else pd.DataFrame(columns=[*KEY, "err"])

    schema = ", ".join(f"{c} {types[c]}" for c in KEY) + ", err double"
    keys = PERIOD if others else MEMBER
    return no_nan(df.select(*KEY, x, y).groupBy(*keys).applyInPandas(run, schema))


def var_errors(df: DataFrame, x: str = "pacs_x", y: str = "pacs_y", window: int = 100, resid: bool = False) -> DataFrame:
    """err: mean squared forecast error of each rolling window by a first-order vector autoregression."""
    return _errors(df, x, y, window, resid, False)


def varx_errors(df: DataFrame, x: str = "pacs_x", y: str = "pacs_y", window: int = 100, resid: bool = False) -> DataFrame:
    """The same with all other members' places as outside variables."""
    return _errors(df, x, y, window, resid, True)
