"""Queries: every operator on the tracks that the events table holds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import breaks, clean, cluster, kinematics, leadership, pacs, regularity, smooth, spatial
from ..schema import KEY, MEMBER, PERIOD, TICK
from ..sources import sinks, tracks as sources
from . import features, modeling

XY = ["utm_x", "utm_y"]
PERIOD_TICKS, EPS = 240, 1.5
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, without negative zero; NaN is null.

    Halves of the last digit, which other engines may take the other way after
    sums in another order, are first moved to one side.
    """
    new = {f.name: F.when(~F.isnan(f.name), F.round(F.col(f.name) + 3.7e-8, digits) + 0.0) for f in df.schema.fields if f.dataType.simpleString() == "double"}
    return df.withColumns(new) if new else df


# ---- the tracks that the queries share ----


def fixes(spark: SparkSession, d: str) -> DataFrame:
    return sources.tracks_from_events(spark.read.parquet(f"{d}/events.parquet").select("ts", "user_id", "value", "props"))


def grid(spark: SparkSession, d: str) -> DataFrame:
    return clean.numbered(clean.pivot_grid(fixes(spark, d), "tick", check=False), "tick")


def whole(spark: SparkSession, d: str) -> DataFrame:
    return clean.interpolate_tracks(grid(spark, d), XY)


def moves(spark: SparkSession, d: str) -> DataFrame:
    """Interpolated tracks in periods of equal length."""
    w = Window.partitionBy(*PERIOD, "member_id").orderBy("tick")
    p = whole(spark, d).withColumn("period_id", F.floor(F.col("tick") / PERIOD_TICKS).cast("int"))
    return p.withColumn("t", (F.row_number().over(w) - 1).cast("int")).select(*KEY, "tick", *XY)


def adapted(spark: SparkSession, d: str) -> DataFrame:
    """Places across and along a straight path: x less the tick, and y."""
    return moves(spark, d).select(*KEY, (F.col("utm_x") - F.col("tick")).alias("pacs_x"), F.col("utm_y").alias("pacs_y"))


def slow_stops(spark: SparkSession, d: str) -> DataFrame:
    """Runs of slow steps as stops, with ids in the order of start and member."""
    w = Window.partitionBy("squad_id", "member_id").orderBy("t")
    dx, dy = (F.col(c) - F.lag(c).over(w) for c in XY)
    v = whole(spark, d).select("squad_id", "member_id", "t", F.coalesce(F.sqrt(dx * dx + dy * dy) < 1.6, F.lit(False)).alias("slow"))
    runs = breaks.runs(v, "slow", ("squad_id", "member_id")).where("slow AND length >= 2")
    stops = runs.select("squad_id", "member_id", F.col("run_start").cast("double").alias("start_ts"), (F.col("run_start") + F.col("length")).cast("double").alias("end_ts"))
    return stops.withColumn("stop_id", F.row_number().over(Window.partitionBy("squad_id").orderBy("start_ts", "member_id")))


def slow_sets(spark: SparkSession, d: str) -> DataFrame:
    return breaks.complete_sets(breaks.overlaps(slow_stops(spark, d)), whole(spark, d).select("squad_id", "member_id").distinct())


def disjoint_sets(spark: SparkSession, d: str) -> DataFrame:
    return breaks.first_disjoint(slow_sets(spark, d))


def slow_groups(spark: SparkSession, d: str) -> DataFrame:
    return breaks.group_stops(slow_stops(spark, d), whole(spark, d).select("squad_id", "member_id").distinct())


def rests(spark: SparkSession, d: str) -> DataFrame:
    groups, tracks = slow_groups(spark, d), whole(spark, d).withColumn("ts", F.col("t").cast("double"))
    return breaks.rest_features(tracks, breaks.rest_periods(groups, 1.0), breaks.move_periods(groups, recorded(spark, d), 2.0))


def recorded(spark: SparkSession, d: str) -> DataFrame:
    return whole(spark, d).groupBy("squad_id").agg(F.min("t").cast("double").alias("first_ts"), F.max("t").cast("double").alias("last_ts"))


def delayed(spark: SparkSession, d: str) -> DataFrame:
    return leadership.delays(moves(spark, d))


def dbscan(spark: SparkSession, d: str) -> DataFrame:
    return cluster.clusters(moves(spark, d), method="DBSCAN", epsilon=EPS)


def table(spark: SparkSession, d: str) -> DataFrame:
    """A small feature table: one row per member."""
    m = moves(spark, d)
    v = kinematics.speeds(m)
    parts = [
        features.two_level(v, "v", "mean", MEMBER).withColumnRenamed("value", "vel_mean"),
        features.two_level(v, "v", "vars", MEMBER).withColumnRenamed("value", "vel_vars"),
        features.two_level(spatial.neighbour_distance(m), "dist", "mean", MEMBER).withColumnRenamed("value", "dist_mean"),
        features.two_level(spatial.centroid_distance(m), "dist", "mean", MEMBER).withColumnRenamed("value", "score"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, ["squad_id", "member_id"])
    key = F.concat(F.lit("Squad "), F.col("squad_id") * 5 + F.col("member_id") + 1)
    return out.select(key.alias("squad"), "vel_mean", "vel_vars", "dist_mean", "score")


# ---- flagship ----


@query
def flagship(spark, d):
    """Mean speed, stretch and nearest-neighbour distance of each member."""
    m = moves(spark, d)
    a = features.two_level(kinematics.speeds(m), "v", "mean", MEMBER).withColumnRenamed("value", "speed")
    b = features.two_level(spatial.centroid_distance(m), "dist", "mean", MEMBER).withColumnRenamed("value", "stretch")
    c = features.two_level(spatial.neighbour_distance(m), "dist", "mean", MEMBER).withColumnRenamed("value", "nearest")
    keys = ["squad_id", "member_id"]
    return rounded(a.join(b, keys).join(c, keys))


# ---- sources, cleaning, sections ----


@query
def s_tracks(spark, d):
    return rounded(fixes(spark, d))


@query
def p1_grid(spark, d):
    return rounded(clean.pivot_grid(fixes(spark, d), "tick"))


@query
def p2_masked(spark, d):
    return rounded(clean.mask_outliers(grid(spark, d), XY).select("squad_id", "member_id", "tick", *XY))


@query
def p3_interpolated(spark, d):
    return rounded(clean.assert_filled(whole(spark, d), XY).select("squad_id", "member_id", "tick", *XY))


@query
def p6_spline(spark, d):
    return rounded(smooth.spline_smoothing(moves(spark, d), s=30.0))


@query
def p7_rolling_mean(spark, d):
    return rounded(clean.rolling_mean(moves(spark, d), XY, 10).select(*KEY, *XY))


@query
def p8_centroid(spark, d):
    return rounded(clean.centroid(moves(spark, d)))


def _centre(spark, d):
    return clean.numbered(clean.centroid(whole(spark, d), keys=["squad_id", "tick"]), "tick", ("squad_id",))


@query
def p9_sections_by_rows(spark, d):
    rows = clean.with_whole(clean.sections_by_rows(whole(spark, d), 4))
    return rounded(rows.groupBy("squad_id", "section").agg(F.count("*").alias("n"), F.min("tick").alias("first"), F.max("tick").alias("last"), F.avg("utm_x").alias("x")))


@query
def p10_cumulative_distance(spark, d):
    return rounded(clean.cumulative_distance(_centre(spark, d)).select("squad_id", "tick", "cum"))


@query
def p11_sections_by_distance(spark, d):
    return clean.sections_by_distance(clean.cumulative_distance(_centre(spark, d)), 4).select("squad_id", "tick", "section")


@query
def p12_halved_period(spark, d):
    one = whole(spark, d).withColumn("period_id", F.lit(0)).withColumn("t", F.col("t").cast("int"))
    return clean.halve_lone_period(one).groupBy("squad_id", "period_id").agg(F.count("*").alias("n"), F.max("t").alias("last"), F.min("tick").alias("first"))


@query
def p14_decimated(spark, d):
    return rounded(clean.decimate(moves(spark, d), 100).select(*KEY, *XY))


@query
def f_slices(spark, d):
    """Time slice, row slice and one member's rows."""
    m = clean.named_members(clean.drop_empty_periods(moves(spark, d), XY))
    a = clean.time_slice(m, 100, 140, "tick").withColumn("kind", F.lit("time"))
    b = clean.row_slice(m, 10, 20).withColumn("kind", F.lit("rows"))
    c = clean.pick_member(m, 2).withColumn("kind", F.lit("member"))
    return rounded(a.unionByName(b).unionByName(c).groupBy("kind", "squad_id").agg(F.count("*").alias("n"), F.avg("utm_y").alias("y"), F.max(clean.minutes(F.col("tick"))).alias("minutes")))


# ---- breaks ----


@query
def b1_trajectory_stops(spark, d):
    return rounded(breaks.trajectory_stops(whole(spark, d).withColumn("ts", F.col("t").cast("double")), 4.0, 3.0))


@query
def b2_overlaps(spark, d):
    return breaks.overlaps(slow_stops(spark, d)).select("squad_id", "anchor", "stop_id", "member_id")


@query
def b3_complete_sets(spark, d):
    return slow_sets(spark, d).select("squad_id", "anchor", "stop_id", "member_id")


@query
def b4_disjoint_sets(spark, d):
    return disjoint_sets(spark, d).select("squad_id", "anchor", "stop_id", "member_id")


@query
def b5_group_stops(spark, d):
    return slow_groups(spark, d)


@query
def b6_stop_bounds(spark, d):
    return breaks.stop_bounds(disjoint_sets(spark, d))


@query
def b7_rest_periods(spark, d):
    rests = breaks.rest_periods(slow_groups(spark, d), 1.0)
    inside = breaks.in_periods(whole(spark, d).drop("t").withColumn("ts", (F.col("tick")).cast("double")), rests)
    return inside.groupBy(*PERIOD).agg(F.count("*").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"))


@query
def b8_move_periods(spark, d):
    return breaks.move_periods(slow_groups(spark, d), recorded(spark, d), 2.0)


@query
def b9_arrival_order(spark, d):
    first = disjoint_sets(spark, d).groupBy("squad_id", "anchor", "member_id").agg(F.min("start_ts").alias("start_ts"), F.max("end_ts").alias("end_ts"))
    return breaks.arrival_order(first)


@query
def a9_rest_summary(spark, d):
    return rounded(rests(spark, d))


@query
def b10_velocity_slices(spark, d):
    return breaks.velocity_slices(whole(spark, d), limit=0.6, longer=3, trim_move=1, trim_rest=1)


@query
def b11_runs(spark, d):
    flags = breaks.smoothed_speed(whole(spark, d)).groupBy("squad_id", "t").agg(F.bool_and(F.col("v") > 0.6).alias("moving"))
    return breaks.runs(flags, "moving")


@query
def s6_stop_markers(spark, d):
    stops = breaks.trajectory_stops(whole(spark, d).withColumn("ts", F.col("t").cast("double")), 4.0, 3.0)
    return rounded(sinks.stop_markers(stops.withColumn("group_stop_id", F.floor(F.col("start_ts") / 24).cast("int"))))


# ---- kinematics and space ----


@query
def v1_speed(spark, d):
    return rounded(kinematics.speeds(moves(spark, d)))


@query
def v2_acceleration(spark, d):
    return rounded(kinematics.accelerations(kinematics.speeds(moves(spark, d))))


@query
def v3_v4_spread(spark, d):
    return rounded(kinematics.spread(kinematics.speeds(moves(spark, d))))


@query
def v6_speed_correlation(spark, d):
    return rounded(kinematics.rolling_correlation(kinematics.speeds(moves(spark, d)), "v", 30))


@query
def v7_acceleration_correlation(spark, d):
    return rounded(kinematics.rolling_correlation(kinematics.accelerations(kinematics.speeds(moves(spark, d))), "a", 30))


@query
def g1_centroid_distance(spark, d):
    return rounded(spatial.centroid_distance(moves(spark, d)))


@query
def g2_neighbour_distance(spark, d):
    return rounded(spatial.neighbour_distance(moves(spark, d)))


@query
def g3_hull(spark, d):
    return rounded(spatial.hull(moves(spark, d)))


@query
def g5_voronoi(spark, d):
    return rounded(spatial.voronoi(moves(spark, d)))


@query
def a4_a6_speed_levels(spark, d):
    """Mean, median, largest, smallest and variance: per period, over periods, over members."""
    v = kinematics.speeds(moves(spark, d))
    per = v.groupBy(*MEMBER).agg(*[features.HOW[k]("v").alias(k) for k in ("mean", "maxs", "mins", "meds", "vars")])
    names = ["mean", "maxs", "mins", "meds", "vars"]
    member = per.groupBy("squad_id", "member_id").agg(*[F.avg(n).alias(n) for n in names])
    return rounded(member.groupBy("squad_id").agg(*[F.avg(n).alias(n) for n in names]))


# ---- path-adapted coordinates ----


@query
def t1_rotate(spark, d):
    x, y = pacs.rotate(F.col("utm_x"), F.col("utm_y"), F.lit(0.5))
    return rounded(moves(spark, d).select(*KEY, x.alias("rx"), y.alias("ry")))


@query
def t5_pacs(spark, d):
    return rounded(pacs.transform(moves(spark, d)))


@query
def t6_exploration(spark, d):
    return rounded(pacs.exploration(adapted(spark, d)))


@query
def t7_neighbours(spark, d):
    return rounded(pacs.neighbours(adapted(spark, d)))


@query
def t8_length_width(spark, d):
    return rounded(pacs.length_width(adapted(spark, d)))


@query
def t9_consistency_f(spark, d):
    """F is rounding noise around 0, so only that it is negligible is told."""
    out = pacs.consistency_f(adapted(spark, d), "pacs_y")
    return out.select("squad_id", "member_id", (F.abs("f") < 1e-20).alias("negligible"))


@query
def t10_consistency_wasserstein(spark, d):
    return rounded(pacs.consistency_wasserstein(adapted(spark, d), "pacs_y"))


@query
def a12_histogram(spark, d):
    return pacs.histogram(adapted(spark, d), "pacs_y", 0.0, 10.0, 20, MEMBER)


# ---- leadership ----


@query
def l2_l3_headings(spark, d):
    m = moves(spark, d)
    return rounded(leadership.headings(m).drop("x", "y").join(leadership.group_heading(m), TICK))


@query
def l5_delays(spark, d):
    return rounded(delayed(spark, d))


@query
def l6_edges(spark, d):
    return rounded(leadership.edges(delayed(spark, d)))


@query
def l7_leadership(spark, d):
    return rounded(leadership.order_by_leadership(leadership.leadership(delayed(spark, d))).drop("rank"))


@query
def l7_ties(spark, d):
    return leadership.lagged_ties(delayed(spark, d))


@query
def l8_correlated_share(spark, d):
    return rounded(leadership.member_share(leadership.correlated_share(delayed(spark, d))))


@query
def l8_correlated_share_reference(spark, d):
    return rounded(leadership.member_share(leadership.correlated_share(delayed(spark, d), mode="reference")))


@query
def l9_hierarchy_quality(spark, d):
    late = delayed(spark, d)
    return rounded(leadership.hierarchy_quality(leadership.edges(late), late))


@query
def l10_simple_cycles(spark, d):
    return leadership.simple_cycles(leadership.edges(delayed(spark, d)))


@query
def l11_period_minutes(spark, d):
    return leadership.period_minutes(moves(spark, d))


def _nodes_periods(spark, d):
    m = moves(spark, d)
    return m.select("squad_id", "member_id").distinct(), m.select(*PERIOD).distinct()


@query
def l12_edit_distance(spark, d):
    return rounded(leadership.edit_distances(leadership.edges(delayed(spark, d)), *_nodes_periods(spark, d)))


@query
def l13_adjacency_change(spark, d):
    return rounded(leadership.adjacency_change(leadership.edges(delayed(spark, d)), *_nodes_periods(spark, d)))


@query
def l14_mean_change(spark, d):
    change = leadership.adjacency_change(leadership.edges(delayed(spark, d)), *_nodes_periods(spark, d))
    return rounded(change.groupBy("squad_id", "member_id").agg(F.avg("change").alias("change")))


@query
def s11_walkers(spark, d):
    """Leadership of simulated walkers: the earliest to turn leads."""
    return rounded(leadership.order_by_leadership(leadership.leadership(leadership.delays(sources.walkers(spark)))))


# ---- clusters ----


@query
def c1_hdbscan(spark, d):
    return rounded(cluster.clusters(moves(spark, d), method="HDBSCAN", epsilon=EPS))


@query
def c2_dbscan(spark, d):
    return dbscan(spark, d).drop("prob")


@query
def c4_silhouette(spark, d):
    return rounded(cluster.silhouette(moves(spark, d), dbscan(spark, d)))


@query
def c6_outlier_time(spark, d):
    return cluster.outlier_time(dbscan(spark, d))


@query
def c7_membership(spark, d):
    return rounded(cluster.membership(cluster.clusters(moves(spark, d), method="HDBSCAN", epsilon=EPS)))


@query
def c8_frames(spark, d):
    return rounded(cluster.frames(moves(spark, d), dbscan(spark, d), 0).drop("prob"))


# ---- regularity ----


@query
def r1_place_entropy(spark, d):
    return rounded(regularity.place_entropy(adapted(spark, d)))


@query
def r1_place_entropy_clean(spark, d):
    return rounded(regularity.place_entropy(adapted(spark, d), mode="clean"))


@query
def r2_var_errors(spark, d):
    return rounded(regularity.var_errors(adapted(spark, d)))


@query
def r3_varx_errors(spark, d):
    return rounded(regularity.varx_errors(adapted(spark, d)))


@query
def r4_metric_entropy(spark, d):
    return rounded(regularity.metric_entropy_mean(kinematics.speeds(moves(spark, d)), "v", 0.0, 5.0, 100))


@query
def r5_trailing_mean(spark, d):
    return rounded(clean.trailing_mean(kinematics.speeds(moves(spark, d)), "v", 60, "smooth").select(*KEY, "smooth"))


# ---- models ----


@query
def m1_robust_scaled(spark, d):
    return rounded(modeling.robust_scaled(table(spark, d), ["vel_mean", "vel_vars", "dist_mean"]))


@query
def m2_lasso(spark, d):
    return rounded(modeling.lasso_model(table(spark, d), "squad", "score", 0.01))


@query
def m3_grid_search(spark, d):
    return rounded(modeling.grid_search(table(spark, d), "squad", "score", [0.001, 0.01, 0.1, 1.0], 5))


@query
def m4_leave_one_out(spark, d):
    return rounded(modeling.leave_one_out(table(spark, d), "squad", "score", alphas=[0.001, 0.01, 0.1]).drop("coefs", "selected"))


@query
def m5_zscored(spark, d):
    return rounded(modeling.zscored(table(spark, d), ["vel_mean", "vel_vars", "dist_mean", "score"]))


@query
def m6_random_experiments(spark, d):
    t = table(spark, d)
    return spark.createDataFrame([(n,) for n in modeling.select_features(t, "squad", "score", 0.5)], "feature string")


@query
def m7_linear_model(spark, d):
    return rounded(modeling.linear_model(table(spark, d), "squad", "score", ["vel_mean"])[0])


@query
def m8_selection_frequency(spark, d):
    return modeling.selection_frequency(modeling.leave_one_out(table(spark, d), "squad", "score", alphas=[0.001, 0.01]))


@query
def a15_fit_quality(spark, d):
    return rounded(modeling.fit_quality(table(spark, d).select(F.col("score").alias("actual"), F.col("dist_mean").alias("predicted"))))


# ---- the whole catalogue ----


def catalogue(spark: SparkSession, d: str):
    raw = moves(spark, d)
    smoothed = clean.rolling_mean(smooth.spline_smoothing(raw, s=30.0), XY, 10)
    return features.feature_tables(raw, smoothed, pacs.transform(clean.complete_ticks(smoothed, "utm_x")), rests(spark, d))


@query
def features_individual(spark, d):
    return rounded(catalogue(spark, d)[0])


@query
def features_squad(spark, d):
    return rounded(catalogue(spark, d)[1])
