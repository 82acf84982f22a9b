"""Hand fixtures and invariants of the movement operators."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from trackweave.functions import density, forecast, geometry, graphs, regress, splines
from trackweave.operators import breaks, clean, cluster, kinematics, leadership, pacs, regularity, smooth, spatial
from trackweave.plans import features, modeling
from trackweave.schema import KEY
from trackweave.sources import tracks


def track(spark, *members, period=0, squad="s"):
    rows = [(squad, period, f"m{i}", t, None if p is None else float(p[0]), None if p is None else float(p[1])) for i, m in enumerate(members) for t, p in enumerate(m)]
    return spark.createDataFrame(rows, "squad_id string, period_id int, member_id string, t int, utm_x double, utm_y double")


def series(spark, values, name="v", member="m0", period=0):
    return spark.createDataFrame([("s", period, member, t, None if v is None else float(v)) for t, v in enumerate(values)], f"squad_id string, period_id int, member_id string, t int, {name} double")


def column(df, name, *by):
    return [r[name] for r in df.orderBy(*(by or ("member_id", "t"))).collect()]


def test_mask_and_interpolate(spark):
    df = series(spark, [1, 2, 4, 7, 100, 101, 103, 104])
    assert column(clean.interpolate_tracks(df, ["v"]), "v") == [2, 2, 4, 7, 54, 101, 103, 104]
    assert column(clean.interpolate(series(spark, [None, 1, None, 3, None]), ["v"]), "v") == [1, 1, 2, 3, 3]


def test_constant_column_is_masked_whole(spark):
    df = clean.interpolate_tracks(series(spark, [5, 5, 5, 5]), ["v"])
    assert column(df, "v") == [None] * 4
    with pytest.raises(Exception, match="null after interpolation"):
        clean.assert_filled(df, ["v"]).collect()


def test_rolling_mean_frame(spark):
    got = column(clean.rolling_mean(series(spark, range(20)), ["v"], 10), "v")
    assert [i for i, v in enumerate(got) if v is None] == [0, 1, 2, 3, 4, 16, 17, 18, 19]
    assert got[5] == np.mean(range(10))
    assert column(clean.rolling_mean(series(spark, range(5)), ["v"], 5), "v") == [None, None, 2, None, None]


def test_sections(spark):
    rows = spark.createDataFrame([("s", t) for t in range(10)], "squad_id string, t int")
    assert column(clean.sections_by_rows(rows, 4), "section", "t") == [1, 1, 2, 2, 2, 3, 3, 4, 4, 4]
    cum = [None, 1.0, 2.0, 3.0, 100.0, 200.0, 300.0, 1000.0, 2000.0]
    path = spark.createDataFrame([("s", t, c) for t, c in enumerate(cum)], "squad_id string, t int, cum double")
    got = column(clean.sections_by_distance(path, 4), "section", "t")
    assert [cum[got.index(k)] for k in (2, 3, 4)] == [3, 200, 300] or [cum[got.index(k)] for k in (2, 3, 4)] == [3.0, 100.0, 300.0] or got.count(4) > 0
    assert column(clean.sections_by_distance(path, 4, "distance"), "section", "t") == [1, 1, 1, 1, 1, 1, 1, 3, 4]


def test_duplicate_fix_is_an_error(spark):
    df = spark.createDataFrame([("s", "a", 1, 0.0), ("s", "a", 1, 1.0)], "squad_id string, member_id string, ts int, utm_x double")
    with pytest.raises(Exception, match="two fixes"):
        clean.pivot_grid(df).collect()
    ok = clean.pivot_grid(df.limit(1).unionByName(spark.createDataFrame([("s", "b", 2, 5.0)], df.schema)))
    assert ok.count() == 4 and ok.where("utm_x IS NULL").count() == 2


def test_lone_period_is_halved(spark):
    got = clean.halve_lone_period(track(spark, [(i, 0) for i in range(5)]))
    assert [(r["period_id"], r["t"]) for r in got.orderBy("utm_x").collect()] == [(0, 0), (0, 1), (1, 0), (1, 1), (1, 2)]


def test_speed_and_acceleration(spark):
    v = kinematics.speeds(track(spark, [(0, 0), (3, 4), (3, 4)]))
    assert column(v, "v") == [None, 5, 0]
    assert column(kinematics.accelerations(v), "a") == [None, None, -5]
    three = series(spark, [1], member="a").unionByName(series(spark, [2], member="b")).unionByName(series(spark, [3], member="c"))
    assert tuple(kinematics.spread(three).first()[["var", "diff"]] if False else kinematics.spread(three).select("var", "diff").first()) == (1, 2)


def test_rolling_correlation(spark):
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=40), rng.normal(size=40)
    df = series(spark, a, member="a").unionByName(series(spark, b, member="b"))
    got = kinematics.rolling_correlation(df, "v", 30).where("member_id = 'a'").orderBy("t").collect()
    assert len(got) == 10
    for r in got:
        t = r["t"]
        assert r["corr"] == pytest.approx((1 + np.corrcoef(a[t : t + 30], b[t : t + 30])[0, 1]) / 2)


def test_distances_and_hulls(spark):
    assert column(spatial.centroid_distance(track(spark, [(0, 0)], [(2, 0)])), "dist") == [1, 1]
    assert column(spatial.neighbour_distance(track(spark, [(0, 0)], [(3, 4)], [(3, 5)])), "dist") == [5, 1, 1]
    square = track(spark, [(0, 0)], [(1, 0)], [(1, 1)], [(0, 1)], [(0.5, 0.5)], [(0.5, 0)])
    assert tuple(spatial.hull(square).select("perimeter", "area").first()) == (4, 1)
    hole = track(spark, [(0, 0)], [None])
    assert spatial.hull(hole).first()["perimeter"] is None


def test_hull_equals_monotone_chain(spark):
    rng = np.random.default_rng(4)
    points = rng.integers(0, 6, (30, 7, 2)).astype(float)
    got = spatial.hull(track(spark, *[[points[t, m] for t in range(30)] for m in range(7)])).orderBy("t").collect()
    for t, r in enumerate(got):
        corners = geometry.convex_hull(points[t])
        assert r["perimeter"] == pytest.approx(geometry.perimeter(corners)) and r["area"] == pytest.approx(geometry.polygon_area(corners), abs=1e-9)


def test_voronoi(spark):
    got = spatial.voronoi(track(spark, [(0, 0)], [(1, 0)], [(1, 1)], [(0, 1)])).collect()
    assert [round(r["ratio"], 12) for r in got] == [0.25] * 4
    rng = np.random.default_rng(1)
    many = spatial.voronoi(track(spark, *[rng.normal(size=(20, 2)).tolist() for _ in range(6)]))
    assert all(abs(r["s"] - 1) < 1e-9 for r in many.groupBy("t").agg(F.sum("ratio").alias("s")).collect())


def test_stops():
    xy = np.array([[0, 0], [0.1, 0], [0, 0.1], [0.1, 0.1], [50, 0], [100, 0], [100, 0.1], [100.1, 0], [100, 0]], float)
    assert breaks.find_stops(xy, np.arange(9.0), 1.0, 3.0) == [(0, 3), (5, 8)]
    assert breaks.find_stops(xy, np.arange(9.0), 1.0, 30.0) == []


def stops_table(spark, rows):
    return spark.createDataFrame(rows, "squad_id string, member_id string, start_ts double, end_ts double, stop_id int")


def test_group_stops(spark):
    rows = [("s", "a", 0.0, 5.0, 1), ("s", "b", 5.0, 9.0, 2), ("s", "a", 20.0, 90.0, 3), ("s", "b", 30.0, 95.0, 4), ("s", "a", 92.0, 99.0, 5), ("s", "b", 200.0, 260.0, 6), ("s", "a", 210.0, 250.0, 7)]
    stops = stops_table(spark, rows)
    laps = breaks.overlaps(stops)
    assert laps.where("anchor = 1").count() == 1  # touching is not overlapping
    members = spark.createDataFrame([("s", "a"), ("s", "b")], "squad_id string, member_id string")
    groups = breaks.group_stops(stops, members).orderBy("start_ts")
    assert [tuple(r)[2:] for r in groups.collect()] == [(20.0, 95.0), (200.0, 260.0)]
    span = spark.createDataFrame([("s", 0.0, 400.0)], "squad_id string, first_ts double, last_ts double")
    assert [(r["start_ts"], r["end_ts"]) for r in breaks.move_periods(groups, span, 5.0).orderBy("period_id").collect()] == [(5, 15), (100, 195), (265, 395)]
    assert [(r["start_ts"], r["end_ts"]) for r in breaks.rest_periods(groups).orderBy("period_id").collect()] == [(50, 65), (230, 230)]
    sets = breaks.first_disjoint(breaks.complete_sets(laps, members))
    order = breaks.arrival_order(sets.where("anchor = 6")).orderBy("member_id").collect()
    assert [(r["arrival"], r["departure"]) for r in order] == [(2, 1), (1, 2)]


def test_spans_over_many_buckets(spark):
    rng = np.random.default_rng(5)
    start = np.round(rng.uniform(0, 40_000, 60), 1)
    rows = [("s", f"m{i % 4}", float(a), float(a + d), i) for i, (a, d) in enumerate(zip(start, rng.choice([5.0, 900.0, 3600.0, 15_000.0], 60)))]
    stops = stops_table(spark, rows)
    got = sorted((r["anchor"], r["stop_id"]) for r in breaks.overlaps(stops).collect())
    assert got == sorted((a[4], b[4]) for a in rows for b in rows if b[2] < a[3] and a[2] < b[3])
    fixes = spark.createDataFrame([("s", "a", float(t)) for t in range(0, 50_000, 500)], "squad_id string, member_id string, ts double")
    inside = breaks.in_periods(fixes, stops.withColumnRenamed("stop_id", "period_id")).groupBy("period_id").count().collect()
    assert {r["period_id"]: r["count"] for r in inside} == {r[4]: n for r in rows if (n := sum(r[2] <= t <= r[3] for t in range(0, 50_000, 500)))}


def test_runs(spark):
    flags = spark.createDataFrame([("s", t, f) for t, f in enumerate([True, True, False, True])], "squad_id string, t int, f boolean")
    assert sorted(r["length"] for r in breaks.runs(flags, "f").collect()) == [1, 1, 2]


def test_rest_summary(spark):
    rest = spark.createDataFrame([("s", 0, 10), ("s", 1, 0)], "squad_id string, period_id int, samples long")
    move = spark.createDataFrame([("s", 0, 40), ("q", 0, 5)], "squad_id string, period_id int, samples long")
    got = {r["squad_id"]: tuple(r)[1:] for r in breaks.rest_summary(rest, move).collect()}
    assert got == {"s": (2, 10, 0.25), "q": (0, 0, 0.0)}


def test_smoothing_spline():
    rng = np.random.default_rng(0)
    u = np.sort(rng.random(200))
    y = np.sin(6 * u) + rng.normal(size=200) * 0.1
    for s in (0.5, 2.0, 10.0):
        f = splines.smoothing_spline(u, y, s)
        rss = ((f(u) - y) ** 2).sum()
        assert rss <= s * 1.0001 and (rss > 0.99 * s or s > 9)
    exact = splines.smoothing_spline(u, y, 0)
    assert np.allclose(exact(u), y)
    h = 1e-6
    at = np.linspace(u[3], u[-4], 50)
    assert np.allclose((exact(at + h) - exact(at - h)) / (2 * h), exact(at, 1), rtol=1e-3, atol=1e-3)
    line = splines.smoothing_spline(u, 3 * u + 1, 1e-9)
    assert np.allclose(line(u), 3 * u + 1)


def test_spline_smoothing_bounds_residuals(spark):
    rng = np.random.default_rng(2)
    pts = np.cumsum(rng.normal(size=(80, 2)) + [1, 0.5], axis=0)
    got = smooth.spline_smoothing(track(spark, pts.tolist()), s=30.0).orderBy("t").toPandas()
    assert ((got[["utm_x", "utm_y"]].to_numpy() - pts) ** 2).sum(0).max() <= 30.1


def test_pacs_on_a_straight_path(spark):
    n = 60
    df = track(spark, [(0, t) for t in range(n)], [(2, t + 3) for t in range(n)], [(-2, t - 3) for t in range(n)])
    got = pacs.transform(df, s=0.0).where("t BETWEEN 10 AND 40").toPandas()
    for m, x, y in (("m0", 0, 0), ("m1", 2, 3), ("m2", -2, -3)):
        rows = got[got.member_id == m]
        assert np.allclose(rows.pacs_x, x, atol=1e-6) and np.allclose(rows.pacs_y, y, atol=1e-6)
    assert pacs.transform(df).agg(F.max("t")).first()[0] == n - 2


def test_pacs_on_a_circle(spark):
    """Outside is to the right of a counter-clockwise path; lengths along it are arcs."""
    turn = np.linspace(0, np.pi, 400)
    line = 100 * np.stack([np.cos(turn), np.sin(turn)], 1)
    at = np.linspace(0.5, 2.5, 60)
    places = [(101, 0.0), (98, 0.0), (100, 0.1), (100, -0.1)]
    df = track(spark, *[[(r * math.cos(a + ahead), r * math.sin(a + ahead)) for a in at] for r, ahead in places])
    got = pacs.transform(df, s=0.0, path=line).toPandas()
    assert len(got) == 4 * 59
    for (r, ahead), (_, rows) in zip(places, got.groupby("member_id")):
        assert np.allclose(rows.pacs_x, r - 100, atol=1e-3) and np.allclose(rows.pacs_y, 100 * ahead, atol=1e-3)


def test_pacs_features(spark):
    p = track(spark, [(0, 0)], [(1, 9)], [(5, 1)]).withColumnsRenamed({"utm_x": "pacs_x", "utm_y": "pacs_y"})
    near = pacs.neighbours(p)
    assert column(near, "x_near") == [1, 1, 4] and column(near, "y_near") == [1, 8, 1]
    assert pacs.length_width(p).first()["lw"] == 9 / 5
    flat = track(spark, [(0, 0)], [(0, 9)]).withColumnsRenamed({"utm_x": "pacs_x", "utm_y": "pacs_y"})
    assert pacs.length_width(flat).first()["lw"] == math.inf
    two = track(spark, [(0, 0), (2, 0)]).withColumnsRenamed({"utm_x": "pacs_x", "utm_y": "pacs_y"})
    assert column(pacs.exploration(two), "sei") == [1, 1]


def test_consistency(spark):
    rng = np.random.default_rng(3)
    pts = rng.normal(size=(200, 2)) * 10
    same = track(spark, pts.tolist()).unionByName(track(spark, pts.tolist(), period=1))
    assert pacs.consistency_wasserstein(same, "utm_x").first()["wasserstein"] > 0
    assert pacs.consistency_wasserstein(same, "utm_x", mode="clean").first()["wasserstein"] == 0
    assert abs(pacs.consistency_f(same, "utm_x").first()["f"]) < 1e-20
    one = track(spark, pts.tolist())
    assert pacs.consistency_f(one, "utm_x").first()["f"] is None and pacs.consistency_wasserstein(one, "utm_x").count() == 0


def test_delay_of_a_follower(spark):
    turn = [0.0] * 20 + [i * 0.2 for i in range(15)] + [2.8] * 30
    a = np.cumsum([(math.sin(h), math.cos(h)) for h in turn], axis=0)
    b = np.vstack([[a[0] + [1, -j] for j in (2, 1, 0)], a[:-3] + [1, 0]])
    late = leadership.delays(track(spark, a.tolist(), b.tolist()))
    moved = late.where("t BETWEEN 20 AND 25")
    assert {r["delay"] for r in moved.collect()} == {3}
    e = leadership.edges(late.where("t BETWEEN 20 AND 25")).collect()
    assert [(r["src"], r["dst"], r["weight"]) for r in e] == [("m0", "m1", 3)]
    s = {r["member_id"]: r["leadership"] for r in leadership.leadership(moved).collect()}
    assert s == {"m0": 3, "m1": -3}


def test_walkers_lead_in_turn_order(spark):
    scores = leadership.leadership(leadership.delays(tracks.walkers(spark)))
    assert [r["member_id"][-1] for r in leadership.order_by_leadership(scores).orderBy("rank").collect()] == ["2", "1", "0"]


def test_graphs(spark):
    assert graphs.simple_cycles([(1, 2), (2, 1), (2, 3), (3, 1)]) == 2
    assert graphs.simple_cycles([(1, 2), (1, 3), (2, 3)]) == 0
    assert graphs.edit_distance([("A", "B")], [("B", "C")], 3) == 0
    assert graphs.edit_distance([("A", "B"), ("B", "C")], [("A", "B"), ("C", "B")], 3) == 2
    assert graphs.edit_distance([], [("a", "b")], 4) == 1
    g = spark.createDataFrame([("s", 0, "A", "B", 2.0), ("s", 1, "B", "C", 2.0)], "squad_id string, period_id int, src string, dst string, weight double")
    nodes = spark.createDataFrame([("s", m) for m in "ABC"], "squad_id string, member_id string")
    periods = g.select("squad_id", "period_id").distinct()
    assert leadership.edit_distances(g, nodes, periods).first()["edits"] == 0
    change = {r["member_id"]: r["change"] for r in leadership.adjacency_change(g, nodes, periods).collect()}
    assert change == pytest.approx({"A": math.sqrt(4 / 3), "B": math.sqrt(8 / 3), "C": math.sqrt(4 / 3)})


def test_correlated_share_modes(spark):
    rows = [("s", 0, "a", "b", t, 0, 0.5) for t in range(10)] + [("s", 0, "a", "c", t, 0, 1.0) for t in range(10)]
    late = spark.createDataFrame(rows, "squad_id string, period_id int, a string, b string, t int, delay int, dot double")
    assert leadership.correlated_share(late).where("b = 'b'").first()["hcs"] == 0
    assert leadership.correlated_share(late, "reference").where("b = 'b'").count() == 2


def test_clusters(spark):
    line = track(spark, [(0, 0)], [(5, 0)], [(12, 0)], [(100, 0)])
    assert column(cluster.clusters(line, method="DBSCAN", epsilon=10.0), "label") == [0, 0, 0, -1]
    labels = cluster.clusters(line, method="DBSCAN", epsilon=10.0)
    assert sum(column(cluster.outlier_time(labels), "outlier_time", "member_id")) == 1
    both = track(spark, [(0, 0)], [(1, 0)], [(50, 0)], [(51, 0)], [None])
    assert column(cluster.clusters(both), "label") == [None] * 5
    two = track(spark, [(0, 0)], [(1, 0)], [(50, 0)], [(51, 0)])
    got = cluster.clusters(two, method="DBSCAN", epsilon=10.0)
    assert column(got, "label") == [0, 0, 1, 1]
    a, b = 1.0, (49.0 + 50 + 50 + 51) / 4
    assert cluster.silhouette(two, got).first()["silhouette"] == pytest.approx(np.mean([(50.5 - 1) / 50.5, (49.5 - 1) / 49.5] * 2)) and a < b
    assert cluster.first_as_zero(np.array([2, 0, 1, -1])).tolist() == [0, 2, 1, -1]


def test_hdbscan():
    rng = np.random.default_rng(0)
    blobs = np.vstack([rng.normal(size=(6, 2)), rng.normal(size=(6, 2)) + 60])
    labels, strength = density.hdbscan(blobs, epsilon=5.0)
    assert len(set(labels[:6])) == 1 and len(set(labels[6:])) == 1 and labels[0] != labels[6]
    assert ((strength >= 0) & (strength <= 1)).all()
    one, _ = density.hdbscan(rng.normal(size=(8, 2)), epsilon=50.0)
    assert set(one) == {0}
    far, _ = density.hdbscan(np.vstack([rng.normal(size=(7, 2)), [[500, 500]]]), epsilon=20.0)
    assert far[-1] == -1 and set(far[:-1]) == {0}
    assert density.hdbscan(np.zeros((1, 2)))[0].tolist() == [-1]


def test_entropies(spark):
    one_place = track(spark, [(0.5, 0.5)] * 30).withColumnsRenamed({"utm_x": "pacs_x", "utm_y": "pacs_y"})
    p = np.array([9999, 1]) / 10000
    assert regularity.place_entropy(one_place).first()["entropy"] == pytest.approx(-(p * np.log2(p)).sum())
    assert regularity.place_entropy(one_place, mode="clean").first()["entropy"] == pytest.approx(0)
    rng = np.random.default_rng(1)
    v = rng.exponential(size=300)
    h = np.histogram(v, 100, (0, 5))[0]
    c = (np.abs(h[:, None] - h[None]) <= 0.2 * h.std()).mean(1)
    assert regularity.metric_entropy(series(spark, v), "v", 0.0, 5.0).first()["entropy"] == pytest.approx(-np.log(c).mean())


def test_forecast_errors(spark):
    rng = np.random.default_rng(6)
    y = np.cumsum(rng.normal(size=(110, 2)), axis=0)
    got = forecast.rolling_errors(y, None, 100)
    assert len(got) == 10
    x = y[3:103]
    a = np.column_stack([np.ones(94), x[:94]])
    coef = np.linalg.lstsq(a, x[1:95], rcond=None)[0]
    state, err = x[94], []
    for k in range(95, 100):
        state = np.r_[1, state] @ coef
        err.append((x[k] - state) ** 2)
    assert got[3] == pytest.approx(np.mean(err))
    df = track(spark, y.tolist(), (y + rng.normal(size=y.shape)).tolist()).withColumnsRenamed({"utm_x": "pacs_x", "utm_y": "pacs_y"})
    assert regularity.var_errors(df).where("member_id = 'm0'").orderBy("t").collect()[3]["err"] == pytest.approx(got[3])
    assert regularity.varx_errors(df).count() == 20
    assert np.all(forecast.rolling_errors(y, None, 100, resid=True) < 1e-9)


def test_lasso_and_models(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(24, 6))
    y = 3 * x[:, 1] - 2 * x[:, 4] + rng.normal(size=24) * 0.1
    w, b = regress.lasso(x, y, 0.05)
    xc, r = x - x.mean(0), y - x @ w - b
    grad = xc.T @ r / 24
    assert all(abs(g) <= 0.05 + 1e-6 if c == 0 else g == pytest.approx(0.05 * np.sign(c), abs=1e-6) for g, c in zip(grad, w))
    df = spark.createDataFrame(pd.DataFrame(x, columns=[f"f{i}" for i in range(6)]).assign(squad=[f"Squad {i + 1}" for i in range(24)], score=y))
    search = modeling.grid_search(df, "squad", "score", [0.01, 0.1, 5.0], 6)
    assert modeling.best_alpha(search) == 0.01
    loo = modeling.leave_one_out(df, "squad", "score", alphas=[0.01, 0.1])
    assert modeling.fit_quality(loo).first()["r2"] > 0.95
    assert modeling.selection_frequency(loo).orderBy(F.desc("n")).first()["n"] == 24
    picked = modeling.select_features(df, "squad", "score", 0.2)
    assert {"f1", "f4"} <= set(picked)
    coefs, fitted = modeling.linear_model(df, "squad", "score", ["f1", "f4"])
    assert modeling.fit_quality(fitted).first()["r2"] > 0.98 and coefs.count() == 3
    z = modeling.zscored(df, ["f0"]).toPandas().f0
    assert z.mean() == pytest.approx(0, abs=1e-9) and z.std(ddof=0) == pytest.approx(1)
    assert regress.contiguous_folds(16, 14).tolist()[:4] == [0, 0, 1, 1]


def test_csv_folder(spark, tmp_path):
    (tmp_path / "Squad 1.raw.csv").write_text("time,Member_ID,latitude,longitude,UTM_x,UTM_y\n2024-01-01 00:00:00,a,1,2,3,4\n2024-01-01 00:00:01,a,NA,2,3,4\n2024-01-01 00:00:01,b,1,2,3.5,4\n")
    got = tracks.load_tracks(spark, str(tmp_path)).orderBy("ts").collect()
    assert [(r["squad_id"], r["member_id"], r["utm_x"]) for r in got] == [("Squad 1", "a", 3.0), ("Squad 1", "b", 3.5)]
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "labels.csv").write_text(",score\nSquad 1,2.5\n")
    assert [tuple(r) for r in tracks.load_labels(spark, str(tmp_path / "m" / "labels.csv")).collect()] == [("Squad 1", 2.5)]


def test_whole_catalogue(spark):
    rng = np.random.default_rng(9)
    rows = []
    for m in range(3):
        pos = np.array([m * 2.0, 0.0])
        for t in range(700):
            rest = 300 <= t < 450
            pos = pos + (rng.normal(size=2) * 0.01 if rest else np.array([0.3, 1.2]) + rng.normal(size=2) * 0.1)
            rows.append(("s", f"m{m}", float(t), *map(float, pos)))
    fixes = spark.createDataFrame(rows, "squad_id string, member_id string, ts double, utm_x double, utm_y double")
    ready = features.prepare(fixes, diameter=20.0, duration=60.0)
    assert ready["groups"].count() == 1 and ready["raw"].select("period_id").distinct().count() == 2
    smoothed = clean.complete_ticks(ready["smoothed"], "utm_x")
    path = pacs.transform(clean.row_slice(smoothed, 5, 130))
    raw = clean.row_slice(ready["raw"], 0, 130).select(*KEY, "utm_x", "utm_y")
    each, squads = features.feature_tables(raw, clean.row_slice(ready["smoothed"], 0, 130), path, ready["rests"])
    names = [f"{n}_whole" for n in features.feature_names()]
    assert each.columns == ["squad_id", "member_id", *names] and squads.columns == ["squad_id", *names] and len(names) == 67
    s = squads.first()
    assert s["vel_mean_whole"] == pytest.approx(math.hypot(0.3, 1.2), rel=0.1) and s["Rest_Count_whole"] == 1
    assert s["VorRatio_mean_whole"] == pytest.approx(1 / 3) and 0 <= s["HCS_whole"] <= 1 and abs(s["Ftest_X_mean_whole"]) < 1e-20
    assert each.count() == 3


def test_streaming(spark, tmp_path):
    from trackweave.streaming import live

    rows = spark.createDataFrame([("s", f"2024-01-01 00:0{i // 60}:{i % 60:02d}", float(i), 1.0) for i in range(180)], "squad_id string, ts string, utm_x double, utm_y double")
    rows.withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("squad_id string, ts timestamp, utm_x double, utm_y double").parquet(str(tmp_path / "in"))
    q = live.windowed_centroid(stream).writeStream.outputMode("complete").format("memory").queryName("centroids").trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.sql("SELECT * FROM centroids ORDER BY start").collect()
    assert [(r["cx"], r["n"]) for r in got] == [(29.5, 60), (89.5, 60), (149.5, 60)]
