"""Tables and keys shared by all operators.

Everything stays long: one row per (squad_id, period_id, member_id, t), where
t counts the samples of a period from 0.  Squad and period are the keys that
work is distributed by.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window, WindowSpec

FIXES = T.StructType(
    [
        T.StructField("squad_id", T.StringType()),
        T.StructField("member_id", T.StringType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("longitude", T.DoubleType()),
        T.StructField("latitude", T.DoubleType()),
        T.StructField("utm_x", T.DoubleType()),
        T.StructField("utm_y", T.DoubleType()),
    ]
)
PERIOD = ["squad_id", "period_id"]
MEMBER = [*PERIOD, "member_id"]
TICK = [*PERIOD, "t"]
KEY = [*MEMBER, "t"]

# Fixed value: metres per degree, wherever degrees are turned into metres.
DEGREE = 111139.0


def coords(kind: str = "utm") -> tuple[str, str]:
    """The x and y columns of a coordinate kind, utm or lonlat."""
    return {"utm": ("utm_x", "utm_y"), "lonlat": ("longitude", "latitude")}[kind]


def metres(kind: str, column: Column | str) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    return c * DEGREE if kind == "lonlat" else c


def along(*keys: str, by: str = "t") -> WindowSpec:
    return Window.partitionBy(*(keys or MEMBER)).orderBy(by)


def require(df: DataFrame, *columns: str) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"columns missing: {', '.join(missing)}")
    return df


def no_nan(df: DataFrame) -> DataFrame:
    """NaN as null in every floating column: Spark would take NaN for a value."""
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({n: F.when(~F.isnan(n), F.col(n)) for n in names}) if names else df
