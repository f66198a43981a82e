"""Queries on service indicators, data quality and live bunching."""

from __future__ import annotations

from pyspark.sql import functions as F

from kerbline.catalog import inputs as I
from kerbline.catalog import realtime as R
from kerbline.catalog.registry import query, r
from kerbline.functions import codes
from kerbline.operators import bunching as B
from kerbline.operators import headways as H
from kerbline.operators import quality as Q
from kerbline.operators import supply as S
from kerbline.operators import trajectory as T
from kerbline.session import materialize

P = I.pings
SEV = "CASE WHEN {e} IN (1, 2, 3) THEN 'high' WHEN {e} IN (4, 6, 9) THEN 'medium' ELSE 'low' END"
query("prj08_alert_severity", f"SELECT event_id, effect, {SEV.format(e='coalesce(effect, 8)')} AS severity FROM alerts", "alerts")(
    lambda s, d: I.alerts(s, d).select("event_id", "effect", codes.alert_severity(F.col("effect")).alias("severity")))
VEH = """SELECT lt // 300 * 300 AS bin_local, arg_max(veh, lt) AS vehicles_reporting FROM (SELECT poll_ts - 14400 AS lt, count(DISTINCT vehicle_id) AS veh FROM pings GROUP BY 1) GROUP BY 1"""
query("agg28_vehicles_reporting", VEH, "pings")(lambda s, d: Q.vehicles_reporting(P(s, d)))
ALB = f"""SELECT bin_local, count(*) FILTER (sev = 'high') AS alerts_high, count(*) FILTER (sev = 'medium') AS alerts_medium, count(*) FILTER (sev = 'low') AS alerts_low, count(*) AS alerts_total
FROM (SELECT bin_local, alert_id, {SEV.format(e='e')} AS sev FROM (SELECT (poll_ts - 14400) // 300 * 300 AS bin_local, alert_id, coalesce(effect, 8) AS e,
  row_number() OVER (PARTITION BY (poll_ts - 14400) // 300, alert_id ORDER BY poll_ts, coalesce(effect, 8)) AS rn FROM alerts) WHERE rn = 1) GROUP BY 1"""
query("agg29_alerts_by_bin", ALB, "alerts")(lambda s, d: Q.alerts_by_bin(I.alerts(s, d)))
DENSE = f"""SELECT b AS bin_local, vehicles_reporting AS v FROM (SELECT unnest(range(min(bin_local), max(bin_local) + 1, 300)) AS b FROM ({VEH})) LEFT JOIN ({VEH}) ON bin_local = b"""
query("win14_ffill", f"""SELECT bin_local, last_value(v IGNORE NULLS) OVER (ORDER BY bin_local) AS vehicles_reporting, CASE WHEN v IS NULL THEN 1 ELSE 0 END AS vehicles_reporting_stale FROM ({DENSE})""", "pings")(
    lambda s, d: (lambda v: Q.ffill(Q.dense_bins(v, "bin_local", 300).join(v, "bin_local", "left"), "vehicles_reporting"))(Q.vehicles_reporting(P(s, d))))
OBS = """SELECT arr_ts - 14400 AS arr_local, o.route_id, headway_s, sm FROM (SELECT *, CAST((arr_ts - 14400) % 86400 // 3600 AS INT) AS local_hour FROM (
  SELECT *, arr_ts - lag(arr_ts) OVER (PARTITION BY route_id, direction_id, stop_id ORDER BY arr_ts, trip_id) AS headway_s FROM arr) WHERE headway_s BETWEEN 30 AND 7200) o
LEFT JOIN (SELECT route_id, direction_id, stop_id, CAST(sched_arr_sec % 86400 // 3600 AS INT) AS local_hour, median(gap) AS sm FROM (
  SELECT *, sched_arr_sec - lag(sched_arr_sec) OVER (PARTITION BY route_id, direction_id, stop_id ORDER BY sched_arr_sec) AS gap FROM (SELECT DISTINCT route_id, direction_id, stop_id, sched_arr_sec FROM rt_sched))
  WHERE gap > 0 AND gap <= 7200 GROUP BY ALL) s ON s.route_id = o.route_id AND s.direction_id = o.direction_id AND s.stop_id = o.stop_id AND s.local_hour = o.local_hour"""


def observed(s, d):
    o = H.observed_headways(R.arrivals(s, d))
    return H.null_safe_join(o, H.scheduled_gaps(I.rt_schedule(s, d)), [*H.STOP_KEYS, "local_hour"]).select(
        "arr_local", "route_id", "direction_id", "headway_s", "sched_median_headway_s")


TRAIL = f"""SELECT bin_local, avg(dev) AS m, count(*) AS n FROM (SELECT arr_local, abs(headway_s - sm) AS dev FROM ({OBS}) WHERE sm IS NOT NULL) e
JOIN (SELECT unnest(range(min(arr_local) // 300 * 300, max(arr_local) + 7200, 300)) AS bin_local FROM ({OBS})) b ON arr_local > bin_local - 3600 AND arr_local <= bin_local GROUP BY 1"""
query("win15_trailing_mean", f"SELECT bin_local, round(m, 4) AS trailing_mean, n AS n_trailing FROM ({TRAIL})", "arr rt_sched")(
    lambda s, d: Q.trailing_mean(observed(s, d).withColumn("dev", F.abs(F.col("headway_s") - F.col("sched_median_headway_s"))), "arr_local", "dev").withColumn("trailing_mean", r("trailing_mean")))
ACTIVE = """SELECT CAST(bin_sec AS BIGINT) AS bin_sec, count(*) AS scheduled_active FROM range(0, 86400, 300) AS x(bin_sec)
JOIN (SELECT trip_id, min(sched_sec) AS a, max(sched_sec) AS b FROM stop_times GROUP BY 1) ON (a <= bin_sec AND bin_sec <= b) OR (a <= bin_sec + 86400 AND bin_sec + 86400 <= b) GROUP BY 1"""
FILL = "coalesce(last_value({c} IGNORE NULLS) OVER (ORDER BY d.bin_local), 0) AS {c}"
KPI = f"""SELECT d.bin_local, last_value(v IGNORE NULLS) OVER (ORDER BY d.bin_local) AS vehicles_reporting, CASE WHEN v IS NULL THEN 1 ELSE 0 END AS vehicles_stale,
  coalesce(scheduled_active, 0) AS scheduled_active, round(last_value(v IGNORE NULLS) OVER (ORDER BY d.bin_local) / nullif(scheduled_active, 0), 6) AS service_ratio,
  coalesce(p.n, 0) AS active_bunching_pairs, round(t.m, 4) AS mean_abs_headway_dev_s, coalesce(t.n, 0) AS n_arrivals_trailing60,
  {FILL.format(c='alerts_high')}, {FILL.format(c='alerts_medium')}, {FILL.format(c='alerts_low')}, {FILL.format(c='alerts_total')},
  d.bin_local + 14400 AS bin_utc, CAST(d.bin_local % 86400 // 3600 AS INT) AS local_hour
FROM ({DENSE}) d LEFT JOIN ({ACTIVE}) a ON a.bin_sec = d.bin_local % 86400
LEFT JOIN (SELECT arr_local // 300 * 300 AS bin_local, count(*) AS n FROM ({OBS}) WHERE headway_s < 0.25 * sm GROUP BY 1) p ON p.bin_local = d.bin_local
LEFT JOIN ({TRAIL}) t ON t.bin_local = d.bin_local LEFT JOIN ({ALB}) al ON al.bin_local = d.bin_local"""
KC = "pings alerts arr rt_sched stop_times"


def active(s, d):
    return S.active_in_bin(S.trip_spans(S.typed_stop_times(I.stop_times(s, d))))


def kpis(s, d):
    k = Q.kpis(P(s, d), active(s, d), materialize(observed(s, d), "observed"), I.alerts(s, d))
    return k.withColumns({"service_ratio": r("service_ratio", 6), "mean_abs_headway_dev_s": r("mean_abs_headway_dev_s")})


query("agg30_kpis", KPI, KC)(kpis)
NOW = 1704323400 - 14400
query("win23_last_available", f"""SELECT arg_max(mean_abs_headway_dev_s, bin_local) AS value, max(bin_local) AS bin_local, CAST(round(({NOW} - max(bin_local)) / 60) AS BIGINT) AS lag_min
FROM ({KPI}) WHERE mean_abs_headway_dev_s IS NOT NULL""", KC)(lambda s, d: Q.last_available(kpis(s, d), "mean_abs_headway_dev_s", NOW))
LIVE = f"SELECT bin_local, v AS vehicles_reporting FROM ({DENSE}) WHERE v IS NOT NULL"
query("str09_spliced_series", f"""
WITH h AS (SELECT bin_local, vehicles_reporting, 'rollup' AS basis FROM ({KPI}) WHERE bin_local > {NOW} - 43200 * 3 AND bin_local <= {NOW} - 20000),
s AS (SELECT max(bin_local) AS seam FROM h)
SELECT *, (SELECT seam FROM s) AS seam FROM (SELECT * FROM h UNION ALL SELECT bin_local, vehicles_reporting, 'live' FROM ({LIVE}) WHERE bin_local > (SELECT seam FROM s) AND bin_local <= {NOW})""", KC)(
    lambda s, d: Q.spliced_series(kpis(s, d).where(F.col("bin_local") <= NOW - 20000).select("bin_local", "vehicles_reporting"), Q.vehicles_reporting(P(s, d)), NOW, 432))

# ------------------------------------------------------------------ data quality
GAP = (1704160000, 1704175000)


def quality(s, d):
    c = materialize(Q.hourly_counts(P(s, d)), "counts")
    gaps = c.select("feed").distinct().where("feed = 'bus_a'").withColumns({"gap_start": F.lit(GAP[0]), "gap_end": F.lit(GAP[1])})
    return Q.data_quality(c, gaps, 1704326000, 20)


DQ = f"""WITH c AS (SELECT feed, strftime(make_timestamp(poll_ts * 1000000), '%Y-%m-%d') AS day, CAST(poll_ts % 86400 // 3600 AS INT) AS hour, count(*) AS n FROM pings GROUP BY ALL),
b AS (SELECT feed, hour, median(n) AS base FROM c WHERE (feed, day) IN (SELECT (feed, day) FROM c GROUP BY feed, day HAVING count(*) >= 20) GROUP BY 1, 2),
q AS (SELECT x.feed, x.day, CAST(h AS INT) AS hour, coalesce(c.n, 0) AS n, base, epoch(CAST(x.day AS TIMESTAMP)) + h * 3600 AS st FROM (SELECT DISTINCT feed, day FROM c) x CROSS JOIN range(0, 24) AS g(h)
  LEFT JOIN c ON c.feed = x.feed AND c.day = x.day AND c.hour = h LEFT JOIN b ON b.feed = x.feed AND b.hour = h),
v AS (SELECT *, CASE WHEN base > 0 THEN round(100.0::DOUBLE * n / base, 1) WHEN n > 0 THEN 100.0 END AS cov, feed = 'bus_a' AND st < {GAP[1]} AND st + 3600 > {GAP[0]} AS known FROM q),
z AS (SELECT feed, day, hour, n AS "rows", cov AS coverage_pct, CASE WHEN st + 3600 > 1704326000 AND n = 0 THEN 'in_progress' WHEN known AND (n = 0 OR cov < 100) THEN 'known_gap'
  WHEN n = 0 THEN 'missing' WHEN cov < 60 THEN 'partial' ELSE 'ok' END AS status FROM v)
SELECT *, status IN ('partial', 'known_gap', 'missing') AS excluded FROM z"""
query("agg31_data_quality", DQ, "pings")(quality)
query("str08_late_and_missing_hours", f"SELECT feed, day, count(*) FILTER (excluded) AS hours_excluded, count(*) FILTER (status = 'partial') AS hours_partial FROM ({DQ}) GROUP BY 1, 2", "pings")(
    lambda s, d: quality(s, d).groupBy("feed", "day").agg(F.count_if("excluded").alias("hours_excluded"), F.count_if(F.col("status") == "partial").alias("hours_partial")))
query("str07_stale_feed", """
WITH p AS (SELECT feed, poll_ts, max(ts // 1800 * 1800) AS header_ts FROM pings GROUP BY 1, 2),
m AS (SELECT *, CASE WHEN lag(header_ts) OVER w IS NULL OR lag(header_ts) OVER w <> header_ts THEN poll_ts END AS mv FROM p WINDOW w AS (PARTITION BY feed ORDER BY poll_ts))
SELECT feed, poll_ts, header_ts, since, poll_ts - since > 300 AS stale FROM (SELECT *, last_value(mv IGNORE NULLS) OVER (PARTITION BY feed ORDER BY poll_ts) AS since FROM m)""", "pings")(
    lambda s, d: Q.stale_runs(P(s, d).groupBy("feed", "poll_ts").agg(F.max(F.floor(F.col("ts") / 1800) * 1800).alias("header_ts"))))
query("src21_archive_depth", """SELECT feed, count(*) AS n, (SELECT count(DISTINCT ts // 86400) FROM pings) AS archive_depth_days, (SELECT count(DISTINCT ts // 86400) FROM pings) < 14 AS preliminary FROM pings GROUP BY 1""", "pings")(
    lambda s, d: Q.stamp_depth(P(s, d).groupBy("feed").agg(F.count(F.lit(1)).alias("n")), P(s, d).select(F.floor(F.col("ts") / 86400).alias("day"))))

# ------------------------------------------------------------------ alerts, lines, wall
CUR = f"""SELECT alert_id, {SEV.format(e='e')} AS severity, routes, subway FROM (SELECT alert_id, arg_min(coalesce(effect, 8), poll_ts * 100000000 + event_id) AS e,
  string_agg(DISTINCT route_id, ',' ORDER BY route_id) AS routes, bool_or(is_subway) AS subway FROM alerts WHERE poll_ts >= (SELECT max(poll_ts) FROM alerts) - {{w}} GROUP BY 1)"""
query("agg70_current_alerts", CUR.format(w=7200), "alerts")(lambda s, d: Q.current_alerts(I.alerts(s, d), 7200))
query("agg70_alert_tally", f"SELECT count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'medium') AS medium, count(*) FILTER (severity = 'low') AS low, count(*) AS total FROM ({CUR.format(w=7200)})", "alerts")(
    lambda s, d: Q.alert_tally(Q.current_alerts(I.alerts(s, d), 7200)))
LINES = ["1", "2", "3", "a", "C", "E", "B", "x9", "G", "J"]
query("agg69_line_status", f"""
WITH t AS (SELECT upper({I.sql_pick('CAST(vehicle_id AS BIGINT)', LINES)}) AS line, count(*) AS n FROM pings GROUP BY 1),
a AS (SELECT DISTINCT upper({I.sql_pick('CAST(alert_id AS BIGINT)', [*LINES, 'Q', 'zz'])}) AS line FROM alerts WHERE is_subway),
j AS (SELECT coalesce(t.line, a.line) AS line, n, a.line IS NOT NULL AS al FROM t FULL OUTER JOIN a ON a.line = t.line)
SELECT line, coalesce(n, 0) AS count, al AS alerted, CAST(nullif(coalesce(pos, 0), 0) AS INT) AS display_order FROM (SELECT *, list_position({codes.LINE_ORDER}, line) AS pos FROM j) WHERE n IS NOT NULL OR coalesce(pos, 0) > 0""", "pings alerts")(
    lambda s, d: Q.line_status(P(s, d).select(I.pick(F.col("vehicle_id").cast("long"), LINES).alias("route_id")),
                               I.alerts(s, d).where("is_subway").select(I.pick(F.col("alert_id").cast("long"), [*LINES, "Q", "zz"]).alias("route_id"))))


def latest(s, d):
    """Latest position per vehicle, spread out so that a route's vehicles are near each other."""
    return T.latest_two(P(s, d), 10**9).select("vehicle_id", "route_id", "direction_id", "lat", (F.lit(-74.0) + F.col("vehicle_id").cast("long") % 7 * 0.001).alias("lon"))


def route_headway(s, d):
    return P(s, d).groupBy("route_id", "direction_id").agg((F.count(F.lit(1)) % 7 * 100.0 + 200.0).alias("sched_median_headway_s"))


LAT = """SELECT vehicle_id, route_id, direction_id, lat, -74.0::DOUBLE + CAST(vehicle_id AS BIGINT) % 7 * 0.001::DOUBLE AS lon FROM pings QUALIFY row_number() OVER (PARTITION BY vehicle_id ORDER BY ts DESC, event_id DESC) = 1"""
CAND = f"""SELECT a.route_id, a.direction_id, a.vehicle_id AS vehicle_id_a, b.vehicle_id AS vehicle_id_b, 2 * 6371000 * asin(sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2)
  + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2))) AS gap_m, h.hw * 4.5::DOUBLE AS expected_m
FROM ({LAT}) a JOIN ({LAT}) b ON a.route_id = b.route_id AND a.direction_id = b.direction_id AND a.vehicle_id < b.vehicle_id
JOIN (SELECT route_id, direction_id, count(*) % 7 * 100.0::DOUBLE + 200.0 AS hw FROM pings GROUP BY 1, 2) h ON h.route_id = a.route_id AND h.direction_id = a.direction_id"""
CANDF = f"SELECT * FROM ({CAND}) WHERE gap_m < least(0.25 * expected_m, 500)"
query("jon18_bunching_candidates", f"SELECT route_id, direction_id, vehicle_id_a, vehicle_id_b, round(gap_m, 4) AS gap_m FROM ({CANDF})", "pings")(
    lambda s, d: B.candidate_pairs(latest(s, d), route_headway(s, d)).select("route_id", "direction_id", "vehicle_id_a", "vehicle_id_b", r("gap_m").alias("gap_m")))
GREEDY = f"""WITH RECURSIVE c AS (SELECT *, row_number() OVER (ORDER BY gap_m, vehicle_id_a, vehicle_id_b) AS i FROM ({CANDF})),
g(i, used, taken) AS (SELECT 0::BIGINT, []::VARCHAR[], []::BIGINT[] UNION ALL SELECT c.i, CASE WHEN list_contains(used, vehicle_id_a) OR list_contains(used, vehicle_id_b) THEN used ELSE list_concat(used, [vehicle_id_a, vehicle_id_b]) END,
  CASE WHEN list_contains(used, vehicle_id_a) OR list_contains(used, vehicle_id_b) THEN taken ELSE list_append(taken, c.i) END FROM g JOIN c ON c.i = g.i + 1),
w AS (SELECT unnest(taken) AS i FROM (SELECT taken FROM g ORDER BY i DESC LIMIT 1))"""


def pairs(s, d):
    return B.bunching_pairs(latest(s, d), route_headway(s, d))


def greedy_sql(tail):
    """The pings CTE has to sit inside the recursive WITH."""
    return f"WITH RECURSIVE pings AS ({I.CTE['pings'][1]}), " + GREEDY[len("WITH RECURSIVE "):] + tail


query("jon18_bunching_pairs", greedy_sql(" SELECT route_id, direction_id, vehicle_id_a, vehicle_id_b, round(gap_m, 4) AS gap_m, CASE WHEN gap_m / expected_m < 0.08 THEN 'high' WHEN gap_m / expected_m < 0.16 THEN 'medium' ELSE 'low' END AS severity FROM c JOIN w ON w.i = c.i"))(
    lambda s, d: pairs(s, d).select("route_id", "direction_id", "vehicle_id_a", "vehicle_id_b", r("gap_m").alias("gap_m"), "severity"))
query("top08_hotspots", greedy_sql(" SELECT vehicle_id_a, vehicle_id_b, round(gap_m, 4) AS gap_m FROM c JOIN w ON w.i = c.i ORDER BY c.i LIMIT 20"))(
    lambda s, d: B.hotspots(pairs(s, d), 20).select("vehicle_id_a", "vehicle_id_b", r("gap_m").alias("gap_m")))
query("str10_wall")(lambda s, d: Q.wall(1704323400, latest(s, d), active(s, d), pairs(s, d), Q.current_alerts(I.alerts(s, d), 7200)))
