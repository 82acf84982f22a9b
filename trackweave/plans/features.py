"""The feature catalogue: one row per individual and one per squad.

A metric is a long table of values by (squad, period, member, t) or, for the
group as a whole, by (squad, period, t).  Values are aggregated within each
period, then averaged over periods without weights, then over members.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import breaks, clean, cluster, kinematics, leadership, pacs, regularity, smooth, spatial
from ..schema import MEMBER, PERIOD
from .scratch import Scratch

HOW = {"mean": F.avg, "maxs": F.max, "mins": F.min, "meds": F.median, "vars": F.var_samp, "sum": F.sum, "var": F.var_samp}


@dataclass
class Metric:
    """A metric, the features (name, aggregate) it gives, and its entropy (name, low, high, bins)."""

    name: str
    value: str
    features: list[tuple[str, str]]
    entropy: tuple[str, float, float, int] | None = None
    group: bool = False


# Features, aggregates and histogram ranges of the catalogue.
CATALOGUE = [
    Metric("speed", "v", [("vel_mean", "mean"), ("vel_maxs", "maxs"), ("vel_vars", "vars")], ("vel_ent", 0, 5, 100)),
    Metric("speed_var", "var", [("vel_var", "mean")], ("vel_var_ent", 0, 1, 1000), True),
    Metric("speed_diff", "diff", [("vel_diff", "mean")], ("vel_diffs_ent", 0, 5, 100), True),
    Metric("acceleration", "a", [("acc_mean", "mean"), ("acc_maxs", "maxs")], ("acc_dfs_ent", -1, 1, 100)),
    Metric("centroid_distance", "dist", [("cent_dist_mean", "mean"), ("cent_dist_meds", "meds"), ("cent_dist_maxs", "maxs"), ("cent_dist_mins", "mins")], ("cent_dists_ent", 0, 500, 1000)),
    Metric("neighbour_distance", "dist", [("dist_mean", "mean"), ("dist_var", "var")], ("neighbor_ds_ent", 0, 1000, 5000)),
    Metric("hull", "perimeter", [("SA_mean", "mean"), ("SA_meds", "meds"), ("SA_maxs", "maxs"), ("SA_mins", "mins")], ("SAs_ent", 0, 1000, 1000), True),
    Metric("voronoi_area", "area", [("VorArea_mean", "mean")], ("voronoi_areas_ent", 0, 1000, 1000)),
    Metric("voronoi_ratio", "ratio", [("VorRatio_mean", "mean")], ("voronoi_ratios_ent", 0, 1, 100)),
    Metric("length_width", "lw", [("LW_mean", "mean"), ("LW_maxs", "maxs"), ("LW_mins", "mins")], ("LW_ratios_ent", 0, 100, 1000), True),
    Metric("x_neighbour", "x_near", [("Xnn_mean", "mean")], ("x_neighbors_ent", 0, 50, 100)),
    Metric("y_neighbour", "y_near", [("Ynn_mean", "mean")], ("y_neighbors_ent", 0, 300, 1000)),
    Metric("exploration", "sei", [("SEI_mean", "mean"), ("SEI_maxs", "maxs")], ("SEIs_ent", 0, 250, 1000)),
    Metric("var_error", "err", [("VAR_mean", "mean")], ("VAR_errs_ent", 0, 15, 150)),
    Metric("varx_error", "err", [("VARX_mean", "mean")], ("VARX_errs_ent", 0, 15, 150)),
]
CLUSTERINGS = [(method, eps) for method in ("HDBSCAN", "DBSCAN") for eps in (5, 10, 25, 50)]


def two_level(df: DataFrame, value: str, how: str, keys: list[str]) -> DataFrame:
    """Aggregate within periods, then the plain mean over periods."""
    out = [k for k in keys if k != "period_id"]
    per = df.groupBy(*keys).agg(HOW[how](value).alias("_v"))
    return per.groupBy(*out).agg(F.avg("_v").alias("value"))


def all_metrics(raw: DataFrame, smoothed: DataFrame, path: DataFrame, window: int = 100, keep=lambda df, name: df) -> dict[str, DataFrame]:
    """Every series of CATALOGUE.  raw and smoothed are tracks; path is PACS output.

    keep(df, name) is asked to hold the series that several features share, or
    that Python computes.
    """
    v = keep(kinematics.speeds(smoothed), "speed")
    spread = keep(kinematics.spread(v), "spread")
    near, cells = keep(pacs.neighbours(path), "near"), keep(spatial.voronoi(raw), "cells")
    return {
        "speed": v,
        "speed_var": spread,
        "speed_diff": spread,
        "acceleration": kinematics.accelerations(v),
        "centroid_distance": spatial.centroid_distance(raw),
        "neighbour_distance": keep(spatial.neighbour_distance(raw), "neighbour"),
        "hull": keep(spatial.hull(raw), "hull"),
        "voronoi_area": cells,
        "voronoi_ratio": cells,
        "length_width": pacs.length_width(path),
        "x_neighbour": near,
        "y_neighbour": near,
        "exploration": pacs.exploration(path),
        "var_error": keep(regularity.var_errors(path, window=window), "var"),
        "varx_error": keep(regularity.varx_errors(path, window=window), "varx"),
    }


def _stacked(df: DataFrame, names: dict[str, str], group: bool, member: str) -> DataFrame:
    """(squad_id, member_id, feature, value) from columns; names: column -> feature."""
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(c).cast("double").alias("value")) for c, f in names.items()])
    who = F.lit(None).cast(member) if group else F.col("member_id")
    return df.select("squad_id", who.alias("member_id"), F.explode(pairs).alias("p")).select("squad_id", "member_id", "p.*")


def _blocks(raw: DataFrame, smoothed: DataFrame, path: DataFrame, window: int, rests: DataFrame | None, keep, leading: DataFrame):
    """(squad_id, member_id, feature, value) tables; features of the group as a whole have a null member."""
    member = raw.schema["member_id"].dataType.simpleString()
    series = all_metrics(raw, smoothed, path, window, keep)
    for m in CATALOGUE:
        keys = PERIOD if m.group else MEMBER
        out = [k for k in keys if k != "period_id"]
        per = series[m.name].groupBy(*keys).agg(*[HOW[how](m.value).alias(f) for f, how in m.features])
        yield _stacked(per.groupBy(*out).agg(*[F.avg(f).alias(f) for f, _ in m.features]), {f: f for f, _ in m.features}, m.group, member)
    for group, keys in ((False, MEMBER), (True, PERIOD)):  # all entropies of a level in one pass
        every = None
        for m in CATALOGUE:
            if m.entropy and m.group == group:
                name, low, high, bins = m.entropy
                rows = series[m.name].where(F.col(m.value).isNotNull())
                h = pacs.histogram(rows, m.value, float(low), float(high), bins, keys).withColumn("feature", F.lit(name))
                every = h if every is None else every.unionByName(h)
        out = [k for k in keys if k != "period_id"]
        mean = regularity.histogram_entropy(keep(every, f"histograms-{len(keys)}"), [*keys, "feature"]).groupBy(*out, "feature").agg(F.avg("entropy").alias("value"))
        yield mean.select("squad_id", (F.lit(None).cast(member) if group else F.col("member_id")).alias("member_id"), "feature", "value")
    late = keep(leadership.delays(leading), "delays")
    yield _stacked(leadership.leadership(late), {"leadership": "Leadership"}, False, member)
    yield _stacked(leadership.member_share(leadership.correlated_share(late)), {"hcs": "HCS"}, False, member)
    graph, nodes, periods = keep(leadership.edges(late), "edges"), raw.select("squad_id", "member_id").distinct(), raw.select(*PERIOD).distinct()
    edits = leadership.edit_distances(graph, nodes, periods).groupBy("squad_id").agg(F.avg("ratio").alias("value"))
    yield _stacked(edits, {"value": "lead_consist"}, True, member)
    change = leadership.adjacency_change(graph, nodes, periods).groupBy("squad_id", "member_id").agg(F.avg("change").alias("value"))
    yield _stacked(change, {"value": "lead_consist_adj"}, False, member)
    for axis in "xy":
        yield _stacked(pacs.consistency_f(path, f"pacs_{axis}"), {"f": f"Ftest_{axis.upper()}_mean"}, False, member)
        yield _stacked(pacs.consistency_wasserstein(path, f"pacs_{axis}"), {"wasserstein": f"Wass_{axis.upper()}_mean"}, False, member)
    entropy = regularity.place_entropy(path).groupBy("squad_id", "member_id").agg(F.avg("entropy").alias("value"))
    yield _stacked(entropy, {"value": "PACS_entropy"}, False, member)
    labels = cluster.clusterings(raw, [(m, float(e)) for m, e in CLUSTERINGS])
    per = labels.groupBy(*MEMBER, "method", "epsilon").agg(F.count_if(F.col("label") == -1).alias("o"), F.avg("prob").alias("p"))
    both = keep(per.groupBy("squad_id", "member_id", "method", "epsilon").agg(F.sum("o").alias("o"), F.avg("p").alias("p")), "clusters")
    stem = F.concat(F.col("method"), F.lit("_"), F.col("epsilon").cast("int").cast("string"))
    yield both.select("squad_id", "member_id", F.concat(stem, F.lit("_outlier_time_sum")).alias("feature"), F.col("o").cast("double").alias("value"))
    yield both.where("method = 'HDBSCAN'").select("squad_id", "member_id", F.concat(stem, F.lit("_membership_mean")).alias("feature"), F.col("p").alias("value"))
    if rests is not None:
        yield _stacked(rests, {f.lower(): f for f in ("Rest_Count", "Rest_time", "Rest_percent")}, True, member)


def feature_names(rests: bool = True) -> list[str]:
    names = []
    for m in CATALOGUE:
        names += [f for f, _ in m.features] + ([m.entropy[0]] if m.entropy else [])
    names += ["Leadership", "HCS", "lead_consist", "lead_consist_adj", "Ftest_X_mean", "Ftest_Y_mean", "Wass_X_mean", "Wass_Y_mean", "PACS_entropy"]
    for method, eps in CLUSTERINGS:
        names += [f"{method}_{eps}_outlier_time_sum"] + ([f"{method}_{eps}_membership_mean"] if method == "HDBSCAN" else [])
    return names + (["Rest_Count", "Rest_time", "Rest_percent"] if rests else [])


def feature_tables(raw: DataFrame, smoothed: DataFrame, path: DataFrame, rests: DataFrame | None = None, section: str = "whole", window: int = 100, leading: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(individuals, squads): wide tables of the catalogue, columns suffixed by the section.

    A group's own feature is the same for its members.  rests: (squad_id,
    rest_count, rest_time, rest_percent).  leading: the tracks that leadership
    is computed on, smoothed unless given.
    """
    scratch = Scratch(raw.sparkSession, "features")
    raw, smoothed, path = scratch.keep(raw, "raw"), scratch.keep(smoothed, "smoothed"), scratch.keep(path, "path")
    long = scratch.gather(_blocks(raw, smoothed, path, window, rests, scratch.keep, smoothed if leading is None else scratch.keep(leading, "leading")), "long")
    names = feature_names(rests is not None)
    members = raw.select("squad_id", "member_id").distinct()
    own, group = long.where("member_id IS NOT NULL"), long.where("member_id IS NULL").drop("member_id")
    each = own.unionByName(members.join(group, "squad_id"))
    rename = [F.col(n).alias(f"{n}_{section}") for n in names]
    individuals = each.groupBy("squad_id", "member_id").pivot("feature", names).agg(F.first("value")).select("squad_id", "member_id", *rename)
    level = each.groupBy("squad_id", "feature").agg(F.avg("value").alias("value"))
    squads = level.groupBy("squad_id").pivot("feature", names).agg(F.first("value")).select("squad_id", *rename)
    return individuals, squads


def prepare(fixes: DataFrame, kind: str = "utm", threshold: float = 0.99, diameter: float = 100.0, duration: float = 120.0, s: float = 30.0, moving_mean: int = 10) -> dict[str, DataFrame]:
    """From fixes with ts in seconds to movement periods: raw, spline, smoothed tracks and rests.

    A squad's only movement period is halved; squads that never move are left
    out.
    """
    grid = clean.numbered(clean.pivot_grid(fixes), "ts")
    columns = ["utm_x", "utm_y"] if kind == "utm" else ["longitude", "latitude"]
    tracks = clean.interpolate_tracks(grid, columns, threshold)
    stops = breaks.trajectory_stops(tracks, diameter, duration, kind)
    stops = stops.withColumn("stop_id", F.row_number().over(Window.partitionBy("squad_id").orderBy("start_ts", "member_id")))
    groups = breaks.group_stops(stops, tracks.select("squad_id", "member_id").distinct())
    recorded = tracks.groupBy("squad_id").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    rests = breaks.rest_periods(groups)
    moves = breaks.move_periods(groups, recorded)
    raw = clean.halve_lone_period(breaks.in_periods(tracks, moves))
    spline = smooth.spline_smoothing(raw, kind, s)
    smoothed = clean.rolling_mean(spline, columns, moving_mean)
    return {"tracks": tracks, "stops": stops, "groups": groups, "raw": raw, "spline": spline, "smoothed": smoothed, "rests": breaks.rest_features(tracks, rests, moves)}
