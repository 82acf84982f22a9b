"""Stops, group stops and the rest and movement periods between them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geometry
from ..schema import PERIOD, coords, metres

BUCKET = 3600.0  # seconds; spans meet only in the buckets of time that they cover
STOPS = "start_ts double, end_ts double, x double, y double"


def find_stops(xy: np.ndarray, ts: np.ndarray, diameter: float, duration: float) -> list[tuple[int, int]]:
    """(first, last) rows of the maximal spans that stay within a diameter for a time.

    Points come in one by one.  Outside a stop, points older than the duration
    leave the window; a stop begins when the window spans the duration within
    the diameter and ends at the first point that breaks it.
    """
    out, first, stopped = [], 0, False
    for i in range(len(ts)):
        if not stopped:
            while i - first + 1 > 2 and ts[i] - ts[first] >= duration and geometry.rectangle_diagonal(xy[first : i + 1]) >= diameter:
                first += 1
        within = i > first and geometry.rectangle_diagonal(xy[first : i + 1]) < diameter
        if within and ts[i] - ts[first] >= duration:
            stopped = True
        elif stopped:
            out.append((first, i - 1))
            first, stopped = i, False
    if stopped:
        out.append((first, len(ts) - 1))
    return out


def trajectory_stops(df: DataFrame, diameter: float = 100.0, duration: float = 120.0, kind: str = "utm") -> DataFrame:
    """(squad_id, member_id, start_ts, end_ts, x, y) from tracks with ts in seconds.

    The scan starts anew after each stop, so it runs member by member.
    """
    x, y = coords(kind)
    squad, member = (df.schema[c].dataType.simpleString() for c in ("squad_id", "member_id"))

    def scan(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.dropna(subset=["_x", "_y"]).sort_values("ts")
        xy, ts = pdf[["_x", "_y"]].to_numpy(float), pdf["ts"].to_numpy(float)
        raw = pdf[[x, y]].to_numpy(float)
        rows = [(pdf.squad_id.iloc[0], pdf.member_id.iloc[0], ts[a], ts[b], *raw[a : b + 1].mean(0)) for a, b in find_stops(xy, ts, diameter, duration)]
        return pd.DataFrame(rows, columns=["squad_id", "member_id", "start_ts", "end_ts", "x", "y"])

    ready = df.select("squad_id", "member_id", F.col("ts").cast("double").alias("ts"), x, y, metres(kind, x).alias("_x"), metres(kind, y).alias("_y"))
    return ready.groupBy("squad_id", "member_id").applyInPandas(scan, f"squad_id {squad}, member_id {member}, {STOPS}")


def _buckets(start: str, end: str) -> Column:
    return F.explode(F.sequence(F.floor(F.col(start) / BUCKET), F.floor(F.col(end) / BUCKET))).alias("_bucket")


def overlaps(stops: DataFrame) -> DataFrame:
    """Each stop (anchor) with all stops of its squad that overlap it, itself included.

    Touching end to start is no overlap.  Stops need stop_id.
    """
    a = stops.select("squad_id", F.col("stop_id").alias("anchor"), F.col("start_ts").alias("_s"), F.col("end_ts").alias("_e"), _buckets("start_ts", "end_ts"))
    both = a.join(stops.select("*", _buckets("start_ts", "end_ts")), ["squad_id", "_bucket"]).where("start_ts < _e AND _s < end_ts")
    first = F.floor(F.greatest("start_ts", "_s") / BUCKET)  # a pair counts in the first bucket that both cover
    return both.where(F.col("_bucket") == first).drop("_bucket", "_s", "_e")


def complete_sets(sets: DataFrame, members: DataFrame) -> DataFrame:
    """Only the sets in which every member of the squad stops; members: (squad_id, member_id)."""
    size = members.groupBy("squad_id").agg(F.countDistinct("member_id").alias("_n"))
    w = Window.partitionBy("squad_id", "anchor")
    counted = sets.withColumn("_k", F.size(F.collect_set("member_id").over(w)))
    return counted.join(size, "squad_id").where("_k = _n").drop("_k", "_n")


def first_disjoint(sets: DataFrame) -> DataFrame:
    """Of sets that share a stop only the earliest, in the order of their anchors' start and member.

    Greedy and so one squad at a time; a squad has a few sets.
    """
    schema = sets.schema

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        taken: set = set()
        keep = []
        own = pdf[pdf.stop_id == pdf.anchor].sort_values(["start_ts", "member_id"])
        for anchor in own.anchor:
            rows = pdf[pdf.anchor == anchor]
            if not taken & set(rows.stop_id):
                taken |= set(rows.stop_id)
                keep.append(rows)
        return pd.concat(keep) if keep else pdf.iloc[:0]

    return sets.groupBy("squad_id").applyInPandas(pick, schema)


def stop_bounds(sets: DataFrame) -> DataFrame:
    """(squad_id, anchor, start_ts, end_ts): earliest start and latest end of each set."""
    return sets.groupBy("squad_id", "anchor").agg(F.min("start_ts").alias("start_ts"), F.max("end_ts").alias("end_ts"))


def merge_overlapping(bounds: DataFrame) -> DataFrame:
    """(squad_id, group_stop_id, start_ts, end_ts): overlapping group stops as one.

    A stop joins the island before it if it starts strictly before the
    island's latest end.
    """
    w = Window.partitionBy("squad_id").orderBy("start_ts", "end_ts")
    before = F.max("end_ts").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(before.isNull() | (F.col("start_ts") >= before), 1).otherwise(0)
    island = F.sum("_new").over(w) - 1
    marked = bounds.withColumn("_new", new).withColumn("group_stop_id", island.cast("int"))
    return marked.groupBy("squad_id", "group_stop_id").agg(F.min("start_ts").alias("start_ts"), F.max("end_ts").alias("end_ts"))


def group_stops(stops: DataFrame, members: DataFrame) -> DataFrame:
    return merge_overlapping(stop_bounds(first_disjoint(complete_sets(overlaps(stops), members))))


def rest_periods(groups: DataFrame, shave: float = 30.0) -> DataFrame:
    """(squad_id, period_id, start_ts, end_ts) of rests, less some seconds at both ends; may be empty."""
    return groups.select("squad_id", F.col("group_stop_id").alias("period_id"), (F.col("start_ts") + shave).alias("start_ts"), (F.col("end_ts") - shave).alias("end_ts"))


def move_periods(groups: DataFrame, recorded: DataFrame, shave: float = 60.0) -> DataFrame:
    """What lies between group stops within a squad's recording, less some seconds at both ends.

    recorded: (squad_id, first_ts, last_ts).  Numbered in time order; squads
    without stops have one period.
    """
    edges = recorded.select("squad_id", F.lit(None).cast("double").alias("start_ts"), F.col("first_ts").cast("double").alias("end_ts"))
    tail = recorded.select("squad_id", F.col("last_ts").cast("double").alias("start_ts"), F.lit(None).cast("double").alias("end_ts"))
    marks = groups.select("squad_id", F.col("start_ts").cast("double"), F.col("end_ts").cast("double")).unionByName(edges).unionByName(tail)
    w = Window.partitionBy("squad_id").orderBy(F.coalesce("start_ts", "end_ts"), F.col("end_ts").isNull())
    gap = marks.select("squad_id", F.lag("end_ts").over(w).alias("a"), F.col("start_ts").alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    gap = gap.select("squad_id", (F.col("a") + shave).alias("start_ts"), (F.col("b") - shave).alias("end_ts")).where("start_ts <= end_ts")
    return gap.withColumn("period_id", F.row_number().over(Window.partitionBy("squad_id").orderBy("start_ts")) - 1)


def in_periods(df: DataFrame, periods: DataFrame, time: str = "ts") -> DataFrame:
    """Rows of each period, both ends included, with period_id and t from 0."""
    p = periods.select("squad_id", "period_id", F.col("start_ts").alias("_a"), F.col("end_ts").alias("_b"), _buckets("start_ts", "end_ts"))
    joined = df.withColumn("_bucket", F.floor(F.col(time) / BUCKET)).join(p, ["squad_id", "_bucket"])
    joined = joined.where(F.col(time).between(F.col("_a"), F.col("_b"))).drop("_bucket", "_a", "_b")
    return joined.withColumn("t", F.row_number().over(Window.partitionBy(*PERIOD, "member_id").orderBy(time)) - 1)


def arrival_order(sets: DataFrame) -> DataFrame:
    """Ranks of members by arrival and by departure at each group stop."""
    a = Window.partitionBy("squad_id", "anchor").orderBy("start_ts", "member_id")
    d = Window.partitionBy("squad_id", "anchor").orderBy("end_ts", "member_id")
    return sets.select("squad_id", "anchor", "member_id", F.row_number().over(a).alias("arrival"), F.row_number().over(d).alias("departure"))


def rest_summary(rests: DataFrame, moves: DataFrame) -> DataFrame:
    """Rest count, rest samples and their ratio to move samples; rows with period_id and samples."""
    r = rests.groupBy("squad_id").agg(F.count("*").alias("rest_count"), F.sum("samples").alias("rest_time"))
    m = moves.groupBy("squad_id").agg(F.sum("samples").alias("_move"))
    share = F.when(F.col("_move") > 0, F.coalesce("rest_time", F.lit(0)) / F.col("_move"))
    return m.join(r, "squad_id", "left").select(
        "squad_id", F.coalesce("rest_count", F.lit(0)).alias("rest_count"), F.coalesce("rest_time", F.lit(0)).alias("rest_time"), share.alias("rest_percent")
    )


def rest_features(tracks: DataFrame, rests: DataFrame, moves: DataFrame) -> DataFrame:
    """rest_summary of rest and movement periods, whose samples are the squad's times with a fix; tracks have ts."""
    times = tracks.select("squad_id", "ts").distinct().withColumn("member_id", F.lit(0))

    def sampled(periods: DataFrame) -> DataFrame:
        return in_periods(times, periods).groupBy(*PERIOD).agg(F.count("*").alias("samples"))

    counted = rests.select("squad_id", "period_id").join(sampled(rests), PERIOD, "left").fillna(0, subset=["samples"])
    return rest_summary(counted, sampled(moves))


def runs(flags: DataFrame, flag: str, keys: tuple[str, ...] = ("squad_id",)) -> DataFrame:
    """Maximal runs of one value of a flag: (keys, flag, run_start, length)."""
    rank = F.row_number().over(Window.partitionBy(*keys, flag).orderBy("t"))
    marked = flags.withColumn("_island", F.col("t") - rank)
    return marked.groupBy(*keys, flag, "_island").agg(F.min("t").alias("run_start"), F.count("*").alias("length")).drop("_island")


def smoothed_speed(df: DataFrame, kind: str = "utm", window: int = 10, keys: tuple[str, ...] = ("squad_id", "member_id")) -> DataFrame:
    """v: step length of the trailing mean position, in metres; 1.1 where there is none."""
    x, y = coords(kind)
    w = Window.partitionBy(*keys).orderBy("t")
    frame = w.rowsBetween(-(window - 1), 0)
    means = {c: F.when(F.count(c).over(frame) == window, F.avg(c).over(frame)) for c in (x, y)}
    rolled = df.withColumns({f"_{c}": m for c, m in means.items()})
    step = lambda c: F.abs(metres(kind, F.col(f"_{c}") - F.lag(f"_{c}").over(w)))
    rolled = rolled.withColumns({"_dx": step(x), "_dy": step(y)})
    v = F.sqrt(F.col("_dx") * F.col("_dx") + F.col("_dy") * F.col("_dy"))
    return rolled.select(*keys, "t", F.coalesce(v, F.lit(1.1)).alias("v"))


def velocity_slices(df: DataFrame, kind: str = "utm", limit: float = 0.82, longer: int = 120, trim_move: int = 30, trim_rest: int = 15, window: int = 10) -> DataFrame:
    """(squad_id, moving, run_start, length): long runs of all moving, or not, trimmed at both ends."""
    flags = smoothed_speed(df, kind, window).groupBy("squad_id", "t").agg(F.bool_and(F.col("v") > limit).alias("moving"))
    found = runs(flags, "moving").where(F.col("length") > longer)
    trim = F.when(F.col("moving"), trim_move).otherwise(trim_rest)
    return found.select("squad_id", "moving", (F.col("run_start") + trim).alias("run_start"), (F.col("length") - 2 * trim).alias("length"))
