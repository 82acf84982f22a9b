"""The same queries in DuckDB SQL, built from shared common table expressions."""

from __future__ import annotations

BASE = """
tracks AS (
  SELECT squad_id, member_id, tick, CAST(tick AS DOUBLE) + (c / n - CAST(5000 AS DOUBLE)) / CAST(1000 AS DOUBLE) AS utm_x,
         (k / n) / CAST(10 AS DOUBLE) AS utm_y
  FROM (SELECT CAST(user_id % 3 AS INT) AS squad_id, CAST((user_id // 3) % 5 AS INT) AS member_id,
               CAST(floor((epoch(ts) - 1704067200) / 3600) AS INT) AS tick,
               CAST(sum(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) AS c,
               CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS DOUBLE) AS k,
               CAST(count(*) AS DOUBLE) AS n
        FROM events GROUP BY 1, 2, 3)),
cells AS (
  SELECT squad_id, tick, member_id, utm_x, utm_y
  FROM (SELECT DISTINCT squad_id, tick FROM tracks) JOIN (SELECT DISTINCT squad_id, member_id FROM tracks) USING (squad_id)
  LEFT JOIN tracks USING (squad_id, tick, member_id)),
numbered AS (SELECT *, CAST(row_number() OVER (PARTITION BY squad_id, member_id ORDER BY tick) - 1 AS INT) AS r FROM cells),
steps AS (
  SELECT *, abs(utm_x - lag(utm_x) OVER w) AS dx, abs(utm_y - lag(utm_y) OVER w) AS dy
  FROM numbered WINDOW w AS (PARTITION BY squad_id, member_id ORDER BY r)),
limits AS (SELECT squad_id, member_id, quantile_cont(dx, 0.99) AS qx, quantile_cont(dy, 0.99) AS qy FROM steps GROUP BY 1, 2),
masked AS (
  SELECT squad_id, member_id, tick, r, CASE WHEN dx < qx THEN utm_x END AS utm_x, CASE WHEN dy < qy THEN utm_y END AS utm_y
  FROM steps JOIN limits USING (squad_id, member_id)),
sides AS (
  SELECT squad_id, member_id, tick, r, utm_x, utm_y,
    last_value(utm_x IGNORE NULLS) OVER p AS x0, last_value(CASE WHEN utm_x IS NOT NULL THEN r END IGNORE NULLS) OVER p AS xr0,
    first_value(utm_x IGNORE NULLS) OVER n AS x1, first_value(CASE WHEN utm_x IS NOT NULL THEN r END IGNORE NULLS) OVER n AS xr1,
    last_value(utm_y IGNORE NULLS) OVER p AS y0, last_value(CASE WHEN utm_y IS NOT NULL THEN r END IGNORE NULLS) OVER p AS yr0,
    first_value(utm_y IGNORE NULLS) OVER n AS y1, first_value(CASE WHEN utm_y IS NOT NULL THEN r END IGNORE NULLS) OVER n AS yr1
  FROM masked
  WINDOW p AS (PARTITION BY squad_id, member_id ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         n AS (PARTITION BY squad_id, member_id ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
whole AS (
  SELECT squad_id, member_id, tick, r AS t,
    CASE WHEN utm_x IS NOT NULL THEN utm_x WHEN x0 IS NULL THEN x1 WHEN x1 IS NULL THEN x0
         ELSE x0 + (x1 - x0) * (CAST(r - xr0 AS DOUBLE) / CAST(xr1 - xr0 AS DOUBLE)) END AS utm_x,
    CASE WHEN utm_y IS NOT NULL THEN utm_y WHEN y0 IS NULL THEN y1 WHEN y1 IS NULL THEN y0
         ELSE y0 + (y1 - y0) * (CAST(r - yr0 AS DOUBLE) / CAST(yr1 - yr0 AS DOUBLE)) END AS utm_y
  FROM sides),
moves AS (
  SELECT squad_id, period_id, member_id, CAST(row_number() OVER (PARTITION BY squad_id, period_id, member_id ORDER BY tick) - 1 AS INT) AS t,
         tick, utm_x, utm_y
  FROM (SELECT *, CAST(tick // 240 AS INT) AS period_id FROM whole)),
speed AS (
  SELECT squad_id, period_id, member_id, t, sqrt(dx * dx + dy * dy) AS v
  FROM (SELECT *, utm_x - lag(utm_x) OVER w AS dx, utm_y - lag(utm_y) OVER w AS dy
        FROM moves WINDOW w AS (PARTITION BY squad_id, period_id, member_id ORDER BY t))),
accel AS (SELECT squad_id, period_id, member_id, t, v - lag(v) OVER (PARTITION BY squad_id, period_id, member_id ORDER BY t) AS a FROM speed),
stretch AS (
  SELECT squad_id, period_id, member_id, t, sqrt(dx * dx + dy * dy) AS dist
  FROM (SELECT *, utm_x - avg(utm_x) OVER w AS dx, utm_y - avg(utm_y) OVER w AS dy FROM moves WINDOW w AS (PARTITION BY squad_id, period_id, t))),
nearest AS (
  SELECT a.squad_id, a.period_id, a.member_id, a.t, min(sqrt((a.utm_x - b.utm_x) * (a.utm_x - b.utm_x) + (a.utm_y - b.utm_y) * (a.utm_y - b.utm_y))) AS dist
  FROM moves a JOIN moves b ON a.squad_id = b.squad_id AND a.period_id = b.period_id AND a.t = b.t AND a.member_id <> b.member_id
  GROUP BY 1, 2, 3, 4),
adapted AS (SELECT squad_id, period_id, member_id, t, utm_x - CAST(tick AS DOUBLE) AS pacs_x, utm_y AS pacs_y FROM moves)
"""

CENTRE = """
centre AS (SELECT squad_id, tick, row_number() OVER (PARTITION BY squad_id ORDER BY tick) - 1 AS t, avg(utm_x) AS cx, avg(utm_y) AS cy
           FROM whole GROUP BY squad_id, tick),
path AS (
  SELECT squad_id, tick, t, sum(step) OVER (PARTITION BY squad_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum
  FROM (SELECT *, sqrt((cx - lag(cx) OVER w) * (cx - lag(cx) OVER w) + (cy - lag(cy) OVER w) * (cy - lag(cy) OVER w)) AS step
        FROM centre WINDOW w AS (PARTITION BY squad_id ORDER BY t)))
"""

STOPS = """
slow AS (
  SELECT squad_id, member_id, t, coalesce(sqrt(dx * dx + dy * dy) < 1.6, false) AS slow
  FROM (SELECT *, utm_x - lag(utm_x) OVER w AS dx, utm_y - lag(utm_y) OVER w AS dy FROM whole WINDOW w AS (PARTITION BY squad_id, member_id ORDER BY t))),
stops AS (
  SELECT *, row_number() OVER (PARTITION BY squad_id ORDER BY start_ts, member_id) AS stop_id
  FROM (SELECT squad_id, member_id, CAST(min(t) AS DOUBLE) AS start_ts, CAST(min(t) + count(*) AS DOUBLE) AS end_ts
        FROM (SELECT *, t - row_number() OVER (PARTITION BY squad_id, member_id, slow ORDER BY t) AS island FROM slow)
        WHERE slow GROUP BY squad_id, member_id, island HAVING count(*) >= 2)),
laps AS (
  SELECT a.squad_id, a.stop_id AS anchor, b.stop_id, b.member_id, b.start_ts, b.end_ts
  FROM stops a JOIN stops b ON a.squad_id = b.squad_id AND b.start_ts < a.end_ts AND a.start_ts < b.end_ts),
sets AS (
  SELECT l.* FROM laps l
  JOIN (SELECT squad_id, anchor, count(DISTINCT member_id) AS k FROM laps GROUP BY 1, 2) USING (squad_id, anchor)
  JOIN (SELECT squad_id, count(DISTINCT member_id) AS n FROM whole GROUP BY 1) USING (squad_id) WHERE k = n),
ordered AS (
  SELECT squad_id, list({'anchors': [anchor], 'stops': stops} ORDER BY anchor) AS every
  FROM (SELECT squad_id, anchor, list(stop_id) AS stops FROM sets GROUP BY 1, 2) GROUP BY 1),
greedy AS (
  SELECT squad_id, list_reduce(every, lambda got, x: CASE WHEN list_has_any(got.stops, x.stops) THEN got
           ELSE {'anchors': list_concat(got.anchors, x.anchors), 'stops': list_concat(got.stops, x.stops)} END).anchors AS anchors
  FROM ordered),
disjoint AS (SELECT s.* FROM sets s JOIN (SELECT squad_id, unnest(anchors) AS anchor FROM greedy) USING (squad_id, anchor)),
bounds AS (SELECT squad_id, anchor, min(start_ts) AS start_ts, max(end_ts) AS end_ts FROM disjoint GROUP BY 1, 2),
islands AS (
  SELECT squad_id, start_ts, end_ts, sum(CASE WHEN before IS NULL OR start_ts >= before THEN 1 ELSE 0 END)
           OVER (PARTITION BY squad_id ORDER BY start_ts, end_ts, anchor ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS g
  FROM (SELECT *, max(end_ts) OVER (PARTITION BY squad_id ORDER BY start_ts, end_ts, anchor ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM bounds)),
grouped AS (SELECT squad_id, CAST(g AS INT) AS group_stop_id, min(start_ts) AS start_ts, max(end_ts) AS end_ts FROM islands GROUP BY 1, 2),
spanned AS (SELECT squad_id, CAST(min(t) AS DOUBLE) AS a, CAST(max(t) AS DOUBLE) AS b FROM whole GROUP BY 1)
"""

GAPS = """
gaps AS (
  SELECT squad_id, lag(e) OVER (PARTITION BY squad_id ORDER BY coalesce(s, e), e IS NULL) + 2 AS start_ts, s - 2 AS end_ts
  FROM (SELECT squad_id, start_ts AS s, end_ts AS e FROM grouped UNION ALL SELECT squad_id, NULL, a FROM spanned UNION ALL SELECT squad_id, b, NULL FROM spanned))
"""

FLAGS = """
rolled AS (
  SELECT squad_id, member_id, t, CASE WHEN count(*) OVER w = 10 THEN avg(utm_x) OVER w END AS x, CASE WHEN count(*) OVER w = 10 THEN avg(utm_y) OVER w END AS y
  FROM whole WINDOW w AS (PARTITION BY squad_id, member_id ORDER BY t ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)),
flags AS (
  SELECT squad_id, t, bool_and(coalesce(sqrt(dx * dx + dy * dy), 1.1) > 0.6) AS moving
  FROM (SELECT *, abs(x - lag(x) OVER w) AS dx, abs(y - lag(y) OVER w) AS dy FROM rolled WINDOW w AS (PARTITION BY squad_id, member_id ORDER BY t))
  GROUP BY 1, 2),
runs AS (
  SELECT squad_id, moving, min(t) AS run_start, count(*) AS length
  FROM (SELECT *, t - row_number() OVER (PARTITION BY squad_id, moving ORDER BY t) AS island FROM flags) GROUP BY squad_id, moving, island)
"""

_DOTS = ",\n         ".join(
    f"lead(ahx, 4) OVER w * lead(bhx, {4 + k}) OVER w + lead(ahy, 4) OVER w * lead(bhy, {4 + k}) OVER w AS d{4 + k}" for k in range(-4, 5)
)
_TOP = "greatest(" + ", ".join(f"d{i}" for i in range(9)) + ")"
_AT = "CASE " + " ".join(f"WHEN d{i} = top THEN {i - 4}" for i in range(9)) + " END"

DELAYS = f"""
stepped AS (
  SELECT *, sqrt(dx * dx + dy * dy) AS n
  FROM (SELECT *, utm_x - lag(utm_x) OVER w AS dx, utm_y - lag(utm_y) OVER w AS dy
        FROM moves WINDOW w AS (PARTITION BY squad_id, period_id, member_id ORDER BY t))),
heads AS (
  SELECT squad_id, period_id, member_id, t, utm_x AS x, utm_y AS y, dx / CASE WHEN n > 0 THEN n END AS hx, dy / CASE WHEN n > 0 THEN n END AS hy FROM stepped),
crowd AS (
  SELECT squad_id, period_id, t, dx / CASE WHEN n > 0 THEN n END AS fx, dy / CASE WHEN n > 0 THEN n END AS fy
  FROM (SELECT *, sqrt(dx * dx + dy * dy) AS n
        FROM (SELECT *, cx - lag(cx) OVER w AS dx, cy - lag(cy) OVER w AS dy
              FROM (SELECT squad_id, period_id, t, avg(utm_x) AS cx, avg(utm_y) AS cy FROM moves GROUP BY 1, 2, 3)
              WINDOW w AS (PARTITION BY squad_id, period_id ORDER BY t)))),
pairs AS (
  SELECT a.squad_id, a.period_id, a.member_id AS a, b.member_id AS b, a.t, a.hx AS ahx, a.hy AS ahy, b.hx AS bhx, b.hy AS bhy,
         coalesce(abs((a.x - b.x) * f.fx + (a.y - b.y) * f.fy) <= 10, false) AS near
  FROM heads a JOIN heads b ON a.squad_id = b.squad_id AND a.period_id = b.period_id AND a.t = b.t AND a.member_id < b.member_id
  JOIN crowd f ON a.squad_id = f.squad_id AND a.period_id = f.period_id AND a.t = f.t),
windows AS (
  SELECT squad_id, period_id, a, b, t, count(*) OVER f AS size, bool_and(near) OVER f AS held,
         {_DOTS}
  FROM pairs
  WINDOW w AS (PARTITION BY squad_id, period_id, a, b ORDER BY t),
         f AS (PARTITION BY squad_id, period_id, a, b ORDER BY t ROWS BETWEEN CURRENT ROW AND 8 FOLLOWING)),
delays AS (
  SELECT squad_id, period_id, a, b, t, CASE WHEN held THEN {_AT} END AS delay, CASE WHEN held THEN top END AS dot
  FROM (SELECT *, {_TOP} AS top FROM windows WHERE size = 9)),
means AS (SELECT squad_id, period_id, a, b, avg(delay) FILTER (WHERE dot > 0.99) AS m FROM delays GROUP BY 1, 2, 3, 4),
edges AS (
  SELECT squad_id, period_id, CASE WHEN m > 0 THEN a ELSE b END AS src, CASE WHEN m > 0 THEN b ELSE a END AS dst, abs(m) AS weight FROM means WHERE m <> 0),
samples AS (
  SELECT squad_id, period_id, a AS member_id, delay FROM delays WHERE dot > 0.99
  UNION ALL SELECT squad_id, period_id, b, -delay FROM delays WHERE dot > 0.99),
signed AS (SELECT squad_id, period_id, src, dst, weight FROM edges UNION ALL SELECT squad_id, period_id, dst, src, -weight FROM edges),
change AS (
  SELECT p.squad_id, p1, p2, dst.member_id, sqrt(avg((coalesce(s1.weight, 0) - coalesce(s2.weight, 0)) * (coalesce(s1.weight, 0) - coalesce(s2.weight, 0)))) AS change
  FROM (SELECT x.squad_id, x.period_id AS p1, y.period_id AS p2 FROM (SELECT DISTINCT squad_id, period_id FROM moves) x
        JOIN (SELECT DISTINCT squad_id, period_id FROM moves) y ON x.squad_id = y.squad_id AND x.period_id < y.period_id) p
  JOIN (SELECT DISTINCT squad_id, member_id FROM moves) dst ON dst.squad_id = p.squad_id
  JOIN (SELECT DISTINCT squad_id, member_id FROM moves) src ON src.squad_id = p.squad_id
  LEFT JOIN signed s1 ON s1.squad_id = p.squad_id AND s1.period_id = p1 AND s1.src = src.member_id AND s1.dst = dst.member_id
  LEFT JOIN signed s2 ON s2.squad_id = p.squad_id AND s2.period_id = p2 AND s2.src = src.member_id AND s2.dst = dst.member_id
  GROUP BY 1, 2, 3, 4),
smooth AS (
  SELECT *, CASE WHEN count(dot) OVER w = 6 THEN avg(dot) OVER w END AS r
  FROM delays WINDOW w AS (PARTITION BY squad_id, period_id, a, b ORDER BY t ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)),
shares AS (
  SELECT squad_id, period_id, a, b, count(dot) AS seen, count(r) AS prox, count(*) FILTER (WHERE r > 0.99) AS high FROM smooth GROUP BY 1, 2, 3, 4)
"""

CLUSTERS = """
near AS (
  SELECT a.squad_id, a.period_id, a.t, a.member_id AS a, b.member_id AS b
  FROM moves a JOIN moves b ON a.squad_id = b.squad_id AND a.period_id = b.period_id AND a.t = b.t
   AND sqrt((a.utm_x - b.utm_x) * (a.utm_x - b.utm_x) + (a.utm_y - b.utm_y) * (a.utm_y - b.utm_y)) <= 1.5),
reach AS (
  SELECT * FROM near
  UNION SELECT r.squad_id, r.period_id, r.t, r.a, n.b FROM reach r JOIN near n ON r.squad_id = n.squad_id AND r.period_id = n.period_id AND r.t = n.t AND r.b = n.a),
firsts AS (SELECT squad_id, period_id, t, a AS member_id, min(b) AS root, count(*) AS n FROM reach GROUP BY 1, 2, 3, 4),
roots AS (SELECT squad_id, period_id, t, root, row_number() OVER (PARTITION BY squad_id, period_id, t ORDER BY root) - 1 AS k
          FROM (SELECT DISTINCT squad_id, period_id, t, root FROM firsts WHERE n > 1)),
labels AS (
  SELECT f.squad_id, f.period_id, f.member_id, f.t, CAST(coalesce(r.k, -1) AS INT) AS label
  FROM firsts f LEFT JOIN roots r ON f.squad_id = r.squad_id AND f.period_id = r.period_id AND f.t = r.t AND f.root = r.root AND f.n > 1)
"""

TABLE = """
levels AS (
  SELECT squad_id, member_id, avg(m) AS vel_mean, avg(s) AS vel_vars
  FROM (SELECT squad_id, period_id, member_id, avg(v) AS m, var_samp(v) AS s FROM speed GROUP BY 1, 2, 3) GROUP BY 1, 2),
table_ AS (
  SELECT 'Squad ' || (squad_id * 5 + member_id + 1) AS squad, vel_mean, vel_vars, dist_mean, score
  FROM levels
  JOIN (SELECT squad_id, member_id, avg(m) AS dist_mean FROM (SELECT squad_id, period_id, member_id, avg(dist) AS m FROM nearest GROUP BY 1, 2, 3) GROUP BY 1, 2) USING (squad_id, member_id)
  JOIN (SELECT squad_id, member_id, avg(m) AS score FROM (SELECT squad_id, period_id, member_id, avg(dist) AS m FROM stretch GROUP BY 1, 2, 3) GROUP BY 1, 2) USING (squad_id, member_id))
"""

KEY = "squad_id, period_id, member_id, t"


def sql(body: str, *more: str) -> str:
    return "WITH RECURSIVE " + ",".join((BASE, *more)) + body


def r(expression: str, name: str = "") -> str:
    """A rounded column; the shift moves exact halves, at which engines differ, to one side."""
    return f"round({expression} + 3.7e-8, 6) + 0.0 AS {name or expression}"


def histogram(low: float, high: float, bins: int, value: str = "pacs_y", source: str = "adapted") -> str:
    width = (high - low) / bins
    at = f"CAST(CASE WHEN {value} = {high} THEN {bins - 1} ELSE floor(({value} - {low}) / {width}) END AS INT)"
    return f"""
found AS (SELECT squad_id, period_id, member_id, {at} AS bin, count(*) AS n FROM {source} WHERE {value} BETWEEN {low} AND {high} GROUP BY 1, 2, 3, 4),
hist AS (
  SELECT m.squad_id, m.period_id, m.member_id, CAST(b.bin AS INT) AS bin, coalesce(f.n, 0) AS n
  FROM (SELECT DISTINCT squad_id, period_id, member_id FROM {source} WHERE {value} IS NOT NULL) m CROSS JOIN (SELECT unnest(range({bins})) AS bin) b
  LEFT JOIN found f ON f.squad_id = m.squad_id AND f.period_id = m.period_id AND f.member_id = m.member_id AND f.bin = b.bin)
"""


def rolling_corr(series: str, value: str) -> str:
    return sql(
        f"""
SELECT squad_id, period_id, member_id, t, {r("avg(CASE WHEN n > 1 AND sp > 1e-9 AND sq > 1e-9 THEN c END)", "corr")}
FROM (SELECT squad_id, period_id, member_id, t, max(t) OVER g + 1 - 30 AS lim, count(p) OVER w AS n, stddev_pop(p) OVER w AS sp, stddev_pop(q) OVER w AS sq, corr(p, q) OVER w AS c
      FROM (SELECT a.squad_id, a.period_id, a.member_id, b.member_id AS other, a.t,
                   CASE WHEN b.{value} IS NOT NULL THEN a.{value} END AS p, CASE WHEN a.{value} IS NOT NULL THEN b.{value} END AS q
            FROM {series} a JOIN {series} b ON a.squad_id = b.squad_id AND a.period_id = b.period_id AND a.t = b.t)
      WINDOW w AS (PARTITION BY squad_id, period_id, member_id, other ORDER BY t ROWS BETWEEN CURRENT ROW AND 29 FOLLOWING),
             g AS (PARTITION BY squad_id, period_id, member_id, other))
WHERE t < lim GROUP BY 1, 2, 3, 4"""
    )


def shares_entries(reference: bool) -> str:
    share = "CASE WHEN prox > 0 THEN high / prox END"
    if not reference:
        rows = f"SELECT squad_id, period_id, a, b, 0 AS entry, CASE WHEN seen > 0 THEN {share} END AS hcs FROM shares"
    else:
        rows = f"""SELECT squad_id, period_id, a, b, 0 AS entry, CASE WHEN seen = 0 THEN NULL WHEN high = 0 OR prox = 0 THEN 0.0 ELSE {share} END AS hcs FROM shares
  UNION ALL SELECT squad_id, period_id, a, b, 1, {share} FROM shares WHERE seen > 0 AND (high = 0 OR prox = 0)"""
    return sql(
        f"""
SELECT squad_id, member_id, {r("avg(hcs)", "hcs")}
FROM (SELECT squad_id, period_id, member_id, entry, avg(hcs) AS hcs FROM (SELECT squad_id, period_id, a AS member_id, entry, hcs FROM entries UNION ALL SELECT squad_id, period_id, b, entry, hcs FROM entries) GROUP BY 1, 2, 3, 4)
GROUP BY 1, 2""",
        DELAYS,
        f"entries AS ({rows})",
    )


SQL: dict[str, str] = {
    "flagship": sql(
        f"""
SELECT squad_id, member_id, {r("speed")}, {r("stretch")}, {r("nearest")}
FROM (SELECT squad_id, member_id, avg(m) AS speed FROM (SELECT squad_id, period_id, member_id, avg(v) AS m FROM speed GROUP BY 1, 2, 3) GROUP BY 1, 2)
JOIN (SELECT squad_id, member_id, avg(m) AS stretch FROM (SELECT squad_id, period_id, member_id, avg(dist) AS m FROM stretch GROUP BY 1, 2, 3) GROUP BY 1, 2) USING (squad_id, member_id)
JOIN (SELECT squad_id, member_id, avg(m) AS nearest FROM (SELECT squad_id, period_id, member_id, avg(dist) AS m FROM nearest GROUP BY 1, 2, 3) GROUP BY 1, 2) USING (squad_id, member_id)"""
    ),
    "s_tracks": sql(f"SELECT squad_id, member_id, tick, {r('utm_x')}, {r('utm_y')} FROM tracks"),
    "p1_grid": sql(f"SELECT squad_id, member_id, tick, {r('utm_x')}, {r('utm_y')} FROM cells"),
    "p2_masked": sql(f"SELECT squad_id, member_id, tick, {r('utm_x')}, {r('utm_y')} FROM masked"),
    "p3_interpolated": sql(f"SELECT squad_id, member_id, tick, {r('utm_x')}, {r('utm_y')} FROM whole"),
    "p7_rolling_mean": sql(
        f"""SELECT {KEY}, {r("CASE WHEN count(utm_x) OVER w = 10 THEN avg(utm_x) OVER w END", "utm_x")}, {r("CASE WHEN count(utm_y) OVER w = 10 THEN avg(utm_y) OVER w END", "utm_y")}
FROM moves WINDOW w AS (PARTITION BY squad_id, period_id, member_id ORDER BY t ROWS BETWEEN 5 PRECEDING AND 4 FOLLOWING)"""
    ),
    "p8_centroid": sql(f"SELECT squad_id, period_id, t, {r('avg(utm_x)', 'cx')}, {r('avg(utm_y)', 'cy')} FROM moves GROUP BY 1, 2, 3"),
    "p9_sections_by_rows": sql(
        f"""SELECT squad_id, section, count(*) AS n, min(tick) AS first, max(tick) AS last, {r("avg(utm_x)", "x")}
FROM (SELECT *, unnest(['whole', 'Q' || CAST(1 + CAST(t >= floor(n / 4) AS INT) + CAST(t >= floor(2 * n / 4) AS INT) + CAST(t >= floor(3 * n / 4) AS INT) AS VARCHAR)]) AS section
      FROM (SELECT *, max(t) OVER (PARTITION BY squad_id) + 1 AS n FROM whole)) GROUP BY 1, 2"""
    ),
    "p10_cumulative_distance": sql(f"SELECT squad_id, tick, {r('cum')} FROM path", CENTRE),
    "p11_sections_by_distance": sql(
        """SELECT squad_id, tick, 1 + CAST(t >= 1 + round_even((n - 2) * 1 / 4.0, 0) AS INT) + CAST(t >= 1 + round_even((n - 2) * 2 / 4.0, 0) AS INT)
  + CAST(t >= 1 + round_even((n - 2) * 3 / 4.0, 0) AS INT) AS section FROM (SELECT *, max(t) OVER (PARTITION BY squad_id) + 1 AS n FROM path)""",
        CENTRE,
    ),
    "p12_halved_period": sql(
        """SELECT squad_id, CAST(t >= n // 2 AS INT) AS period_id, count(*) AS n, max(CASE WHEN t >= n // 2 THEN t - n // 2 ELSE t END) AS last, min(tick) AS first
FROM (SELECT *, max(t) OVER (PARTITION BY squad_id) + 1 AS n FROM whole) GROUP BY 1, 2"""
    ),
    "p14_decimated": sql(f"SELECT {KEY}, {r('utm_x')}, {r('utm_y')} FROM moves WHERE t % 100 = 0"),
    "f_slices": sql(
        f"""SELECT kind, squad_id, count(*) AS n, {r("avg(utm_y)", "y")}, {r("max(round(tick / 60.0, 3))", "minutes")}
FROM (SELECT *, 'time' AS kind FROM moves WHERE tick BETWEEN 100 AND 140 UNION ALL SELECT *, 'rows' FROM moves WHERE t BETWEEN 10 AND 19
      UNION ALL SELECT *, 'member' FROM moves WHERE member_id = 2) GROUP BY 1, 2"""
    ),
    "b2_overlaps": sql("SELECT squad_id, anchor, stop_id, member_id FROM laps", STOPS),
    "b3_complete_sets": sql("SELECT squad_id, anchor, stop_id, member_id FROM sets", STOPS),
    "b4_disjoint_sets": sql("SELECT squad_id, anchor, stop_id, member_id FROM disjoint", STOPS),
    "b5_group_stops": sql("SELECT * FROM grouped", STOPS),
    "b6_stop_bounds": sql("SELECT * FROM bounds", STOPS),
    "b7_rest_periods": sql(
        """SELECT w.squad_id, g.group_stop_id AS period_id, count(*) AS n, CAST(min(tick) AS DOUBLE) AS first, CAST(max(tick) AS DOUBLE) AS last
FROM whole w JOIN grouped g ON w.squad_id = g.squad_id AND w.tick BETWEEN g.start_ts + 1 AND g.end_ts - 1 GROUP BY 1, 2""",
        STOPS,
    ),
    "b8_move_periods": sql(
        """SELECT squad_id, start_ts, end_ts, row_number() OVER (PARTITION BY squad_id ORDER BY start_ts) - 1 AS period_id
FROM gaps WHERE start_ts <= end_ts""",
        STOPS,
        GAPS,
    ),
    "b9_arrival_order": sql(
        """SELECT squad_id, anchor, member_id, CAST(row_number() OVER (PARTITION BY squad_id, anchor ORDER BY s, member_id) AS INT) AS arrival,
  CAST(row_number() OVER (PARTITION BY squad_id, anchor ORDER BY e, member_id) AS INT) AS departure
FROM (SELECT squad_id, anchor, member_id, min(start_ts) AS s, max(end_ts) AS e FROM disjoint GROUP BY 1, 2, 3)""",
        STOPS,
    ),
    "a9_rest_summary": sql(
        f"""SELECT squad_id, coalesce(rest_count, 0) AS rest_count, coalesce(rest_time, 0) AS rest_time,
  {r("CASE WHEN moving > 0 THEN CAST(coalesce(rest_time, 0) AS DOUBLE) / CAST(moving AS DOUBLE) END", "rest_percent")}
FROM (SELECT squad_id, CAST(sum((SELECT count(DISTINCT w.t) FROM whole w WHERE w.squad_id = m.squad_id AND w.t BETWEEN m.start_ts AND m.end_ts)) AS BIGINT) AS moving
      FROM gaps m WHERE start_ts <= end_ts GROUP BY 1)
LEFT JOIN (SELECT squad_id, count(*) AS rest_count,
             CAST(sum((SELECT count(DISTINCT w.t) FROM whole w WHERE w.squad_id = g.squad_id AND w.t BETWEEN g.start_ts + 1 AND g.end_ts - 1)) AS BIGINT) AS rest_time
           FROM grouped g GROUP BY 1) USING (squad_id)""",
        STOPS,
        GAPS,
    ),
    "b10_velocity_slices": sql("SELECT squad_id, moving, run_start + 1 AS run_start, length - 2 AS length FROM runs WHERE length > 3", FLAGS),
    "b11_runs": sql("SELECT * FROM runs", FLAGS),
    "v1_speed": sql(f"SELECT {KEY}, {r('v')} FROM speed"),
    "v2_acceleration": sql(f"SELECT {KEY}, {r('a')} FROM accel"),
    "v3_v4_spread": sql(f"SELECT squad_id, period_id, t, {r('var_samp(v)', 'var')}, {r('max(v) - min(v)', 'diff')} FROM speed GROUP BY 1, 2, 3"),
    "v6_speed_correlation": rolling_corr("speed", "v"),
    "v7_acceleration_correlation": rolling_corr("accel", "a"),
    "g1_centroid_distance": sql(f"SELECT {KEY}, {r('dist')} FROM stretch"),
    "g2_neighbour_distance": sql(f"SELECT {KEY}, {r('dist')} FROM nearest"),
    "g3_hull": sql(
        f"""SELECT squad_id, period_id, t, {r("coalesce(sum(l), 0.0)", "perimeter")}, {r("abs(coalesce(sum(s), 0.0))", "area")}
FROM (SELECT DISTINCT squad_id, period_id, t FROM moves) LEFT JOIN (
  SELECT a.squad_id, a.period_id, a.t, sqrt((b.utm_x - a.utm_x) * (b.utm_x - a.utm_x) + (b.utm_y - a.utm_y) * (b.utm_y - a.utm_y)) AS l, (a.utm_x * b.utm_y - b.utm_x * a.utm_y) / 2 AS s
  FROM points a JOIN points b ON a.squad_id = b.squad_id AND a.period_id = b.period_id AND a.t = b.t AND (a.utm_x <> b.utm_x OR a.utm_y <> b.utm_y)
  WHERE NOT EXISTS (
    SELECT 1 FROM points c WHERE c.squad_id = a.squad_id AND c.period_id = a.period_id AND c.t = a.t
      AND (c.utm_x <> a.utm_x OR c.utm_y <> a.utm_y) AND (c.utm_x <> b.utm_x OR c.utm_y <> b.utm_y)
      AND ((b.utm_x - a.utm_x) * (c.utm_y - a.utm_y) - (b.utm_y - a.utm_y) * (c.utm_x - a.utm_x) < 0
        OR ((b.utm_x - a.utm_x) * (c.utm_y - a.utm_y) - (b.utm_y - a.utm_y) * (c.utm_x - a.utm_x) = 0
          AND (((c.utm_x - a.utm_x) * (c.utm_x - b.utm_x) + (c.utm_y - a.utm_y) * (c.utm_y - b.utm_y) > 0 AND (c.utm_x - a.utm_x) * (b.utm_x - a.utm_x) + (c.utm_y - a.utm_y) * (b.utm_y - a.utm_y) > 0)
            OR (c.utm_x - a.utm_x) * (b.utm_x - a.utm_x) + (c.utm_y - a.utm_y) * (b.utm_y - a.utm_y) < 0))))) USING (squad_id, period_id, t)
GROUP BY 1, 2, 3""",
        "points AS (SELECT DISTINCT squad_id, period_id, t, utm_x, utm_y FROM moves)",
    ),
    "a4_a6_speed_levels": sql(
        f"""SELECT squad_id, {", ".join(r(f"avg({n})", n) for n in ("mean", "maxs", "mins", "meds", "vars"))}
FROM (SELECT squad_id, member_id, avg(mean) AS mean, avg(maxs) AS maxs, avg(mins) AS mins, avg(meds) AS meds, avg(vars) AS vars
      FROM (SELECT squad_id, period_id, member_id, avg(v) AS mean, max(v) AS maxs, min(v) AS mins, median(v) AS meds, var_samp(v) AS vars FROM speed GROUP BY 1, 2, 3)
      GROUP BY 1, 2) GROUP BY 1"""
    ),
    "t1_rotate": sql(
        f"""SELECT {KEY}, {r("utm_x * cos(pi() / 2 - 0.5) - utm_y * sin(pi() / 2 - 0.5)", "rx")}, {r("utm_x * sin(pi() / 2 - 0.5) + utm_y * cos(pi() / 2 - 0.5)", "ry")} FROM moves"""
    ),
    "t6_exploration": sql(
        f"""SELECT {KEY}, {r("sqrt((pacs_x - avg(pacs_x) OVER w) * (pacs_x - avg(pacs_x) OVER w) + (pacs_y - avg(pacs_y) OVER w) * (pacs_y - avg(pacs_y) OVER w))", "sei")}
FROM adapted WINDOW w AS (PARTITION BY squad_id, period_id, member_id)"""
    ),
    "t7_neighbours": sql(
        f"""SELECT a.squad_id, a.period_id, a.member_id, a.t, {r("min(abs(a.pacs_x - b.pacs_x))", "x_near")}, {r("min(abs(a.pacs_y - b.pacs_y))", "y_near")}
FROM adapted a JOIN adapted b ON a.squad_id = b.squad_id AND a.period_id = b.period_id AND a.t = b.t AND a.member_id <> b.member_id GROUP BY 1, 2, 3, 4"""
    ),
    "t8_length_width": sql(
        f"""SELECT squad_id, period_id, t, {r("CASE WHEN w <> 0 THEN l / w WHEN l <> 0 THEN CAST('inf' AS DOUBLE) END", "lw")}
FROM (SELECT squad_id, period_id, t, max(pacs_y) - min(pacs_y) AS l, max(pacs_x) - min(pacs_x) AS w FROM adapted GROUP BY 1, 2, 3)"""
    ),
    "t9_consistency_f": sql(
        """SELECT squad_id, member_id, CASE WHEN k > 1 THEN abs((b * k * 100 / (k - 1)) / (w * 100 / (k * 100 - k))) < 1e-20 END AS negligible
FROM (SELECT squad_id, member_id, count(*) AS k, var_pop(m) AS b, sum(v) AS w
      FROM (SELECT squad_id, period_id, member_id, avg(d) AS m, var_pop(d) AS v FROM (SELECT *, n / sum(n) OVER (PARTITION BY squad_id, period_id, member_id) AS d FROM hist) GROUP BY 1, 2, 3)
      GROUP BY 1, 2)""",
        histogram(-50.0, 50.0, 100),
    ),
    "t10_consistency_wasserstein": sql(
        f"""SELECT squad_id, member_id, {r("avg(w)", "wasserstein")}
FROM (SELECT a.squad_id, a.member_id, a.period_id AS p1, b.period_id AS p2, avg(abs(a.n - b.d)) AS w
      FROM ranked a JOIN ranked b ON a.squad_id = b.squad_id AND a.member_id = b.member_id AND a.k = b.k AND a.period_id < b.period_id GROUP BY 1, 2, 3, 4) GROUP BY 1, 2""",
        histogram(-50.0, 50.0, 100),
        """ranked AS (SELECT *, CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY squad_id, period_id, member_id) AS d,
             row_number() OVER (PARTITION BY squad_id, period_id, member_id ORDER BY n) AS k FROM hist)""",
    ),
    "a12_histogram": sql("SELECT * FROM hist", histogram(0.0, 10.0, 20)),
    "l2_l3_headings": sql(f"SELECT {KEY}, {r('hx')}, {r('hy')}, {r('fx')}, {r('fy')} FROM heads JOIN crowd USING (squad_id, period_id, t)", DELAYS),
    "l5_delays": sql(f"SELECT squad_id, period_id, a, b, t, delay, {r('dot')} FROM delays", DELAYS),
    "l6_edges": sql(f"SELECT squad_id, period_id, src, dst, {r('weight')} FROM edges", DELAYS),
    "l7_leadership": sql(f"SELECT squad_id, member_id, {r('avg(delay)', 'leadership')} FROM samples GROUP BY 1, 2", DELAYS),
    "l7_ties": sql("SELECT squad_id, period_id, a, b, delay, count(*) AS n FROM delays WHERE delay IS NOT NULL GROUP BY 1, 2, 3, 4, 5", DELAYS),
    "l8_correlated_share": shares_entries(False),
    "l8_correlated_share_reference": shares_entries(True),
    "l9_hierarchy_quality": sql(
        f"""SELECT squad_id, period_id, {r("count(*) FILTER (WHERE s.d > t.d) / nullif(count(*) FILTER (WHERE s.d <> t.d), 0)", "quality")}
FROM edges e JOIN scores s USING (squad_id, period_id) JOIN scores t USING (squad_id, period_id) WHERE s.member_id = e.src AND t.member_id = e.dst GROUP BY 1, 2""",
        DELAYS,
        "scores AS (SELECT squad_id, period_id, member_id, avg(delay) AS d FROM samples GROUP BY 1, 2, 3)",
    ),
    "l10_simple_cycles": sql(
        """SELECT squad_id, period_id, count(trail) FILTER (WHERE closed) AS cycles
FROM (SELECT squad_id, period_id, NULL AS trail, false AS closed FROM edges UNION ALL SELECT squad_id, period_id, trail, closed FROM walks) GROUP BY 1, 2""",
        DELAYS,
        """walks AS (
  SELECT squad_id, period_id, [src, dst] AS trail, false AS closed FROM edges WHERE dst > src
  UNION ALL
  SELECT w.squad_id, w.period_id, list_append(w.trail, e.dst), e.dst = w.trail[1]
  FROM walks w JOIN edges e ON e.squad_id = w.squad_id AND e.period_id = w.period_id AND e.src = w.trail[-1]
  WHERE NOT w.closed AND (e.dst = w.trail[1] OR (e.dst > w.trail[1] AND NOT list_contains(w.trail, e.dst))))""",
    ),
    "l11_period_minutes": sql("SELECT squad_id, period_id, CAST((max(t) + 1) // 60 AS INT) AS minutes FROM moves GROUP BY 1, 2"),
    "l13_adjacency_change": sql(f"SELECT squad_id, p1, p2, member_id, {r('change')} FROM change", DELAYS),
    "l14_mean_change": sql(f"SELECT squad_id, member_id, {r('avg(change)', 'change')} FROM change GROUP BY 1, 2", DELAYS),
    "c2_dbscan": sql("SELECT * FROM labels", CLUSTERS),
    "c4_silhouette": sql(
        f"""SELECT squad_id, period_id, t, {r("CASE WHEN max(label) > 0 AND count(DISTINCT label) < count(*) THEN avg(CASE WHEN a IS NULL OR greatest(a, b) = 0 THEN 0.0 ELSE (b - a) / greatest(a, b) END) END", "silhouette")}
FROM (SELECT squad_id, period_id, t, m, label, min(CASE WHEN label = o THEN d END) AS a, min(CASE WHEN label <> o THEN d END) AS b
      FROM (SELECT p.squad_id, p.period_id, p.t, p.member_id AS m, p.label, q.label AS o,
                   avg(sqrt((p.utm_x - q.utm_x) * (p.utm_x - q.utm_x) + (p.utm_y - q.utm_y) * (p.utm_y - q.utm_y))) AS d
            FROM placed p JOIN placed q ON p.squad_id = q.squad_id AND p.period_id = q.period_id AND p.t = q.t AND p.member_id <> q.member_id GROUP BY 1, 2, 3, 4, 5, 6)
      GROUP BY 1, 2, 3, 4, 5) GROUP BY 1, 2, 3""",
        CLUSTERS,
        "placed AS (SELECT * FROM moves JOIN labels USING (squad_id, period_id, member_id, t))",
    ),
    "c6_outlier_time": sql("SELECT squad_id, period_id, member_id, count(*) FILTER (WHERE label = -1) AS outlier_time FROM labels GROUP BY 1, 2, 3", CLUSTERS),
    "c8_frames": sql(
        f"""SELECT squad_id, period_id, member_id, t, {r("x")}, {r("y")}, label
FROM (SELECT {KEY}, utm_x - avg(utm_x) OVER w AS x, utm_y - avg(utm_y) OVER w AS y FROM moves WINDOW w AS (PARTITION BY squad_id, period_id, t))
LEFT JOIN labels USING (squad_id, period_id, member_id, t)""",
        CLUSTERS,
    ),
    "r1_place_entropy": sql(
        f"""SELECT squad_id, period_id, member_id, {r("-sum(k / 10000.0 * log2(k / 10000.0))", "entropy")}
FROM (SELECT squad_id, period_id, member_id, n, count(*) AS k FROM spots GROUP BY 1, 2, 3, 4
      UNION ALL SELECT squad_id, period_id, member_id, 0, 10000 - count(*) FROM spots GROUP BY 1, 2, 3) WHERE k > 0 GROUP BY 1, 2, 3""",
        """spots AS (SELECT squad_id, period_id, member_id, CASE WHEN pacs_x = 50 THEN 99 ELSE floor(pacs_x + 50) END AS i, CASE WHEN pacs_y = 50 THEN 99 ELSE floor(pacs_y + 50) END AS j, count(*) AS n
  FROM adapted WHERE pacs_x BETWEEN -50 AND 50 AND pacs_y BETWEEN -50 AND 50 GROUP BY 1, 2, 3, 4, 5)""",
    ),
    "r1_place_entropy_clean": sql(
        f"""SELECT squad_id, period_id, member_id, {r("-sum(p * log2(p))", "entropy")}
FROM (SELECT *, n / sum(n) OVER (PARTITION BY squad_id, period_id, member_id) AS p FROM spots) GROUP BY 1, 2, 3""",
        """spots AS (SELECT squad_id, period_id, member_id, CASE WHEN pacs_x = 50 THEN 99 ELSE floor(pacs_x + 50) END AS i, CASE WHEN pacs_y = 50 THEN 99 ELSE floor(pacs_y + 50) END AS j, count(*) AS n
  FROM adapted WHERE pacs_x BETWEEN -50 AND 50 AND pacs_y BETWEEN -50 AND 50 GROUP BY 1, 2, 3, 4, 5)""",
    ),
    "r4_metric_entropy": sql(
        f"""SELECT squad_id, member_id, {r("avg(e)", "entropy")}
FROM (SELECT squad_id, period_id, member_id, -avg(ln(c)) AS e
      FROM (SELECT a.squad_id, a.period_id, a.member_id, a.bin, count(*) / 100.0 AS c
            FROM hist a JOIN hist b USING (squad_id, period_id, member_id) JOIN spread s USING (squad_id, period_id, member_id) WHERE s.n > 0 AND abs(a.n - b.n) <= s.r GROUP BY 1, 2, 3, 4)
      GROUP BY 1, 2, 3) GROUP BY 1, 2""",
        histogram(0.0, 5.0, 100, "v", "speed"),
        "spread AS (SELECT squad_id, period_id, member_id, sum(n) AS n, 0.2 * stddev_pop(n) AS r FROM hist GROUP BY 1, 2, 3)",
    ),
    "r5_trailing_mean": sql(
        f"""SELECT {KEY}, {r("CASE WHEN count(v) OVER w = 60 THEN avg(v) OVER w END", "smooth")}
FROM speed WINDOW w AS (PARTITION BY squad_id, period_id, member_id ORDER BY t ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)"""
    ),
    "m1_robust_scaled": sql(
        "SELECT squad, "
        + ", ".join(r(f"({c} - (SELECT median({c}) FROM table_)) / (SELECT quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) FROM table_)", c) for c in ("vel_mean", "vel_vars", "dist_mean"))
        + f", {r('score')} FROM table_",
        TABLE,
    ),
    "m5_zscored": sql(
        "SELECT squad, " + ", ".join(r(f"({c} - (SELECT avg({c}) FROM table_)) / (SELECT stddev_pop({c}) FROM table_)", c) for c in ("vel_mean", "vel_vars", "dist_mean", "score")) + " FROM table_", TABLE
    ),
    "m7_linear_model": sql(
        f"""SELECT 'vel_mean' AS feature, {r("regr_slope(score, vel_mean) * (quantile_cont(vel_mean, 0.75) - quantile_cont(vel_mean, 0.25))", "coef")} FROM table_
UNION ALL SELECT 'intercept', {r("regr_intercept(score, vel_mean) + regr_slope(score, vel_mean) * median(vel_mean)", "coef")} FROM table_""",
        TABLE,
    ),
    "a15_fit_quality": sql(
        f"""SELECT {r("1 - sum((score - dist_mean) * (score - dist_mean)) / (var_pop(score) * count(*))", "r2")}, {r("avg(abs(score - dist_mean))", "mae")} FROM table_""", TABLE
    ),
}
