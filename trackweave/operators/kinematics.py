"""Speeds, accelerations and how they go together.

The unit of time is the sample: nothing is divided by a duration.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..schema import KEY, MEMBER, TICK, along, coords


def speeds(df: DataFrame, kind: str = "utm") -> DataFrame:
    """v: distance from the sample before; null at the first."""
    x, y = coords(kind)
    w = along()
    dx, dy = F.col(x) - F.lag(x).over(w), F.col(y) - F.lag(y).over(w)
    return df.select(*KEY, F.sqrt(dx * dx + dy * dy).alias("v"))


def accelerations(velocity: DataFrame) -> DataFrame:
    """a: change of speed, signed; null at the first two samples."""
    return velocity.select(*KEY, (F.col("v") - F.lag("v").over(along())).alias("a"))


def spread(series: DataFrame, value: str = "v") -> DataFrame:
    """Variance over members and fastest less slowest, at each time."""
    return series.groupBy(*TICK).agg(F.var_samp(value).alias("var"), (F.max(value) - F.min(value)).alias("diff"))


def rolling_correlation(series: DataFrame, value: str = "v", window: int = 30) -> DataFrame:
    """Mean correlation of a member with all members, itself included, over samples [t, t + window).

    The last full window is left out.  A pair with a constant series (deviation up to 1e-9) or fewer
    than two common values has no correlation.
    """
    a = series.select(*KEY, F.col(value).alias("p"))
    b = series.select(*TICK, F.col("member_id").alias("other"), F.col(value).alias("q"))
    pairs = a.join(b, TICK)
    w = along(*MEMBER, "other").rowsBetween(0, window - 1)
    both = F.col("p").isNotNull() & F.col("q").isNotNull()
    p, q = F.when(both, F.col("p")), F.when(both, F.col("q"))
    n = F.count(p).over(w)
    sp, sq = F.stddev_pop(p).over(w), F.stddev_pop(q).over(w)
    moved = (sp > 1e-9) & (sq > 1e-9)
    last = F.max("t").over(along(*MEMBER, "other").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) + 1 - window
    r = F.when((n > 1) & moved, F.covar_pop(p, q).over(w) / F.when(moved, sp * sq))
    rolled = pairs.withColumns({"r": r, "_last": last}).where(F.col("t") < F.col("_last"))
    return rolled.groupBy(*KEY).agg(F.avg("r").alias("corr"))
