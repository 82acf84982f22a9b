"""Grid alignment, outlier masking, interpolation, smoothing windows, sections and periods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..schema import MEMBER, PERIOD, TICK, along


def pivot_grid(fixes: DataFrame, time: str = "ts", check: bool = True) -> DataFrame:
    """Every member at every time of its squad; missing combinations are null.

    A (squad, time, member) that occurs twice is an error when the rows are
    read.
    """
    own = ["squad_id", time, "member_id"]
    if check:
        rest = [c for c in fixes.columns if c not in own]
        held = fixes.groupBy(*own).agg(F.count("*").alias("_n"), *[F.first(c).alias(c) for c in rest])
        bad = F.raise_error(F.concat(F.lit("a member has two fixes at one time: "), F.col("member_id").cast("string")))
        fixes = held.withColumn("_n", F.when(F.col("_n") > 1, bad.cast("long")).otherwise(F.col("_n"))).where("_n = 1").drop("_n")
    times, members = fixes.select("squad_id", time).distinct(), fixes.select("squad_id", "member_id").distinct()
    return times.join(members, "squad_id").join(fixes, own, "left")


def wide(grid: DataFrame, value: str, members: list | None = None, time: str = "t") -> DataFrame:
    """One column per member, for display."""
    keys = [c for c in ("squad_id", "period_id", time) if c in grid.columns]
    return grid.groupBy(*keys).pivot("member_id", members).agg(F.first(value))


def numbered(grid: DataFrame, time: str, keys: tuple[str, ...] = ("squad_id", "member_id")) -> DataFrame:
    """t: the 0-based row of a member's track."""
    return grid.withColumn("t", F.row_number().over(Window.partitionBy(*keys).orderBy(time)) - 1)


def mask_outliers(df: DataFrame, columns: list[str], threshold: float = 0.99, keys: list[str] | None = None) -> DataFrame:
    """Null where the step from the row before is not below the quantile of steps.

    The first row has no step and becomes null too, as does any row next to a
    missing value; a constant column is masked whole.
    """
    keys = keys or ["squad_id", "member_id"]
    w = Window.partitionBy(*keys).orderBy("t")
    df = df.withColumns({f"_d_{c}": F.abs(F.col(c) - F.lag(c).over(w)) for c in columns})
    limits = df.groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys]).agg(*[F.percentile(f"_d_{c}", F.lit(threshold)).alias(f"_q_{c}") for c in columns])
    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    df = df.join(limits, same).drop(*[f"_k_{k}" for k in keys])
    df = df.withColumns({c: F.when(F.col(f"_d_{c}") < F.col(f"_q_{c}"), F.col(c)) for c in columns})
    return df.drop(*[f"_{k}_{c}" for c in columns for k in "dq"])


def interpolate(df: DataFrame, columns: list[str], keys: list[str] | None = None) -> DataFrame:
    """Nulls filled linearly by row position; ends take the nearest value."""
    keys = keys or ["squad_id", "member_id"]
    order = Window.partitionBy(*keys).orderBy("t")
    past, ahead = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(0, Window.unboundedFollowing)
    new: dict[str, Column] = {}
    for c in columns:
        at = F.when(F.col(c).isNotNull(), F.col("t"))
        v0, t0 = F.last(c, ignorenulls=True).over(past), F.last(at, ignorenulls=True).over(past)
        v1, t1 = F.first(c, ignorenulls=True).over(ahead), F.first(at, ignorenulls=True).over(ahead)
        share = (F.col("t") - t0).cast("double") / (t1 - t0).cast("double")
        new[c] = F.when(F.col(c).isNotNull(), F.col(c)).when(v0.isNull(), v1).when(v1.isNull(), v0).otherwise(v0 + (v1 - v0) * share)
    return df.withColumns(new)


def interpolate_tracks(grid: DataFrame, columns: list[str], threshold: float = 0.99, other: list[str] | None = None) -> DataFrame:
    """Masking, then interpolation; other text columns have nulls as empty text."""
    out = interpolate(mask_outliers(grid, columns, threshold), columns)
    return out.fillna("", subset=other) if other else out


def assert_filled(df: DataFrame, columns: list[str]) -> DataFrame:
    """df; reading a null in one of the columns is an error."""
    holes = F.lit(False)
    for c in columns:
        holes = holes | F.col(c).isNull()
    return df.withColumn(columns[0], F.when(holes, F.raise_error(F.lit("a column is null after interpolation")).cast("double")).otherwise(F.col(columns[0])))


def rolling_mean(df: DataFrame, columns: list[str], window: int = 5, keys: list[str] | None = None) -> DataFrame:
    """Centred moving mean; for an even window the frame reaches one row further back.

    Null until a window is full.
    """
    w = along(*(keys or MEMBER)).rowsBetween(-(window // 2), (window - 1) // 2)
    return df.withColumns({c: F.when(F.count(c).over(w) == window, F.avg(c).over(w)) for c in columns})


def trailing_mean(df: DataFrame, column: str, window: int, name: str, keys: list[str] | None = None) -> DataFrame:
    """Mean of a row and those before it; null until a window is full."""
    w = along(*(keys or MEMBER)).rowsBetween(-(window - 1), 0)
    return df.withColumn(name, F.when(F.count(column).over(w) == window, F.avg(column).over(w)))


def centroid(df: DataFrame, x: str = "utm_x", y: str = "utm_y", keys: list[str] | None = None) -> DataFrame:
    """Mean position of the members at each time, nulls apart."""
    return df.groupBy(*(keys or TICK)).agg(F.avg(x).alias("cx"), F.avg(y).alias("cy"))


def sections_by_rows(df: DataFrame, sections: int = 4, keys: tuple[str, ...] = ("squad_id",)) -> DataFrame:
    """section 1..n by row position: cuts at floor(k N / n)."""
    n = F.max("t").over(Window.partitionBy(*keys)) + 1
    section = F.lit(1)
    for k in range(1, sections):
        section = section + (F.col("t") >= F.floor(F.lit(k) * n / sections)).cast("int")
    return df.withColumn("section", section)


def with_whole(df: DataFrame) -> DataFrame:
    """Each section as text Q1..Qn, and all rows once more as section ``whole``."""
    return df.withColumn("section", F.lit("whole")).unionByName(df.withColumn("section", F.concat(F.lit("Q"), F.col("section").cast("string"))))


def cumulative_distance(track: DataFrame, keys: tuple[str, ...] = ("squad_id",)) -> DataFrame:
    """Path length of a centroid track (cx, cy) up to each row; null at the first."""
    w = Window.partitionBy(*keys).orderBy("t")
    dx, dy = F.col("cx") - F.lag("cx").over(w), F.col("cy") - F.lag("cy").over(w)
    stepped = track.withColumn("_step", F.sqrt(dx * dx + dy * dy))
    return stepped.withColumn("cum", F.sum("_step").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_step")


def sections_by_distance(track: DataFrame, sections: int = 4, mode: str = "reference", keys: tuple[str, ...] = ("squad_id",)) -> DataFrame:
    """section 1..n of a track with ``cum``.

    reference: cuts at the nearest-rank quantiles of the cumulative values,
    which are rows 1 + bround((N - 2) k / n); so sections have equal row counts.
    distance: cuts at equal shares of the total length.
    """
    whole = Window.partitionBy(*keys)
    if mode == "distance":
        share = F.col("cum") / F.max("cum").over(whole)
        return track.withColumn("section", F.least(F.floor(F.coalesce(share, F.lit(0.0)) * sections) + 1, F.lit(sections)).cast("int"))
    if mode != "reference":
        raise ValueError(mode)
    n = F.max("t").over(whole) + 1
    section = F.lit(1)
    for k in range(1, sections):
        section = section + (F.col("t") >= 1 + F.bround((n - 2) * F.lit(k) / F.lit(float(sections)))).cast("int")
    return track.withColumn("section", section)


def halve_lone_period(df: DataFrame) -> DataFrame:
    """A squad's only movement period becomes two halves by rows."""
    w = Window.partitionBy("squad_id")
    lone = F.min("period_id").over(w) == F.max("period_id").over(w)
    n = F.max("t").over(w) + 1
    second = F.col("t") >= F.floor(n / 2)
    half = F.when(second, F.col("t") - F.floor(n / 2)).otherwise(F.col("t"))
    marked = df.withColumns({"_lone": lone, "_half": second.cast("int"), "_t": half})
    return marked.withColumns({"period_id": F.when(F.col("_lone"), F.col("_half")).otherwise(F.col("period_id")), "t": F.when(F.col("_lone"), F.col("_t")).otherwise(F.col("t")).cast("int")}).drop("_lone", "_half", "_t")


def drop_empty_periods(df: DataFrame, columns: list[str]) -> DataFrame:
    """Without periods in which the columns are null throughout."""
    some = F.lit(False)
    for c in columns:
        some = some | F.col(c).isNotNull()
    return df.withColumn("_any", F.max(some.cast("int")).over(Window.partitionBy(*PERIOD))).where("_any = 1").drop("_any")


def complete_ticks(df: DataFrame, column: str, keys: list[str] | None = None) -> DataFrame:
    """Only the times at which no member's value is null."""
    w = Window.partitionBy(*(keys or TICK))
    return df.withColumn("_ok", F.count(column).over(w) == F.count("*").over(w)).where("_ok").drop("_ok")


def decimate(df: DataFrame, every: int) -> DataFrame:
    return df.where(F.col("t") % every == 0) if every else df


def named_members(df: DataFrame) -> DataFrame:
    """Without columns that only stood for an index or nothing."""
    name = F.col("member_id").cast("string")
    return df.where((name != "") & ~name.contains("Unnamed:"))


def pick_member(df: DataFrame, member) -> DataFrame:
    return df.where(F.col("member_id") == member)


def time_slice(df: DataFrame, start, end, time: str = "ts") -> DataFrame:
    """Rows with start <= time <= end."""
    return df.where(F.col(time).between(start, end))


def row_slice(df: DataFrame, start: int, end: int) -> DataFrame:
    """Rows start .. end - 1 of each track."""
    return df.where(F.col("t").between(start, end - 1))


def minutes(seconds: Column) -> Column:
    return F.round(seconds / 60.0, 3)
