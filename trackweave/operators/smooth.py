"""Smoothing splines along each member's path."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..functions import splines
from ..schema import KEY, MEMBER, coords
from .clean import complete_ticks


def spline_smoothing(df: DataFrame, kind: str = "utm", s: float = 100.0) -> DataFrame:
    """Positions on a cubic smoothing spline per member and period.

    Times at which a member is missing are left out.  The parameter is the arc
    length from 0 to 1; per axis the squared residuals sum to at most s.
    """
    x, y = coords(kind)
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}

    def smooth(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        px, py = pdf[x].to_numpy(float), pdf[y].to_numpy(float)
        u, sx, sy = splines.path_splines(px, py, s, unit=True)
        return pdf.assign(**{x: np.asarray(sx(u)), y: np.asarray(sy(u))})

    ready = complete_ticks(complete_ticks(df.select(*KEY, x, y), x), y)
    return ready.groupBy(*MEMBER).applyInPandas(smooth, ", ".join(f"{c} {types[c]}" for c in [*KEY, x, y]))
